"""Structured Streaming forms of admission and of job records."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from subtide.operators.admission import JOB_S, REQUESTS, RUNNING_S, TIMED_OUT, WINDOW_S, admit


def admissions_stream(hits: DataFrame, requests: int = REQUESTS, window_s: int = WINDOW_S) -> DataFrame:
    """A stream of hits (client, hit_id, ts, t_us; watermarked on ts) with accepted.

    The state of a client is its log of taken requests, at most `requests` long. It is dropped when the watermark
    has passed the last one by a window. A hit older than the log's last decision is decided at that time.
    """

    def run(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(groups), ignore_index=True).sort_values(["t_us", "hit_id"])
        taken = [admit(held, int(t), requests, window_s * 1_000_000) for t in rows["t_us"]]
        state.update((list(held),))
        last = max(int(rows["t_us"].max()), held[-1] if held else 0)
        mark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(last // 1000 + window_s * 1000 + 1, mark + 1))
        yield pd.DataFrame({"client": key[0], "hit_id": rows["hit_id"], "t_us": rows["t_us"], "accepted": taken})

    return hits.groupBy("client").applyInPandasWithState(run, "client long, hit_id long, t_us long, accepted boolean", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def job_states(events: DataFrame) -> DataFrame:
    """A stream of job events (job_id, ts, t_s, kind, srt_text) as (job_id, status, t_s, note).

    kind: start, finish or fail. A result of a job that does not run is dropped. A running job that hears nothing
    fails when the watermark has passed its limit; a finished one is forgotten after its life.
    """

    def run(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        status, since = state.get if state.exists else ("", 0.0)
        if state.hasTimedOut:
            if status != "running":
                state.remove()
                return
            since += RUNNING_S
            status = "error"
            out.append((key[0], status, since, TIMED_OUT))
        else:
            rows = pd.concat(list(groups), ignore_index=True).sort_values("t_s", kind="stable")
            for t, kind in zip(rows["t_s"], rows["kind"], strict=True):
                if kind == "start" and not status:
                    status, since = "running", float(t)
                elif kind in ("finish", "fail") and status == "running":
                    status, since = ("done", float(t)) if kind == "finish" else ("error", float(t))
                else:
                    continue
                out.append((key[0], status, since, ""))
        if status:
            state.update((status, since))
            life = RUNNING_S if status == "running" else JOB_S
            state.setTimeoutTimestamp(max(int((since + life) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job_id", "status", "t_s", "note"])

    return events.groupBy("job_id").applyInPandasWithState(run, "job_id long, status string, t_s double, note string", "status string, since double", "append", GroupStateTimeout.EventTimeTimeout)
