"""Admission by a sliding log of accepted requests, client keys, and job records."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.operators.folds import scan

# Requests a window, seconds of a window, a finished job's life, a running job's.
REQUESTS, WINDOW_S, JOB_S, RUNNING_S = 10, 60, 3600, 2100
TIMED_OUT = "Transcription timed out. Try a shorter audio file."


def client_key(forwarded: Column, host: Column) -> Column:
    """First forwarded address, else the peer, else unknown."""
    return F.when(F.length(forwarded) > 0, F.trim(F.substring_index(forwarded, ",", 1))).otherwise(F.coalesce(host, F.lit("unknown")))


def admit(held: deque, at_us: int, requests: int, window_us: int) -> bool:
    """Whether a request is taken; what is older than the window is forgotten, and only taken requests count."""
    while held and at_us - held[0] > window_us:
        held.popleft()
    if len(held) >= requests:
        return False
    held.append(at_us)
    return True


def admissions(hits: DataFrame, requests: int = REQUESTS, window_s: int = WINDOW_S) -> DataFrame:
    """hits (client, hit_id, t_us) with accepted. A window count would be wrong, as refused requests don't count."""

    window_us = window_s * 1_000_000

    def start():
        held: deque = deque()
        return lambda rows: [admit(held, t, requests, window_us) for t in rows.column("t_us").to_pylist()]

    return scan(hits.select("client", "hit_id", "t_us"), "client", ["t_us", "hit_id"], start, "accepted", "boolean")


def sweep(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs after a sweep: finished ones past their life are gone, running ones past theirs have failed."""
    finished = F.col("status").isin("done", "error") & (now - F.coalesce("updated_at", now) > JOB_S)
    stuck = (F.col("status") == "running") & (now - F.coalesce("created_at", now) > RUNNING_S)
    kept = jobs.filter(~F.coalesce(finished, F.lit(False))).withColumn("__stuck", F.coalesce(stuck, F.lit(False)))
    return kept.withColumns({
        "status": F.when(F.col("__stuck"), "error").otherwise(F.col("status")),
        "error": F.when(F.col("__stuck"), TIMED_OUT).otherwise(F.col("error")),
        "updated_at": F.when(F.col("__stuck"), now).otherwise(F.col("updated_at")),
    }).drop("__stuck")


def complete(jobs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Results (job_id, srt_text, failed) written into jobs that still run; later ones are dropped."""
    got = results.select(F.col("job_id").alias("__id"), F.col("srt_text").alias("__srt"), F.col("failed").alias("__failed"))
    out = jobs.join(got, F.col("job_id") == F.col("__id"), "left")
    hit = (F.col("status") == "running") & F.col("__id").isNotNull()
    bad = F.coalesce(F.col("__failed"), F.lit(False))
    return out.withColumn("__hit", hit).withColumns({
        "srt_text": F.when(F.col("__hit"), F.when(bad, "").otherwise(F.col("__srt"))).otherwise(F.col("srt_text")),
        "error": F.when(F.col("__hit"), F.when(bad, "Transcription failed. Check server logs.").otherwise("")).otherwise(F.col("error")),
        "updated_at": F.when(F.col("__hit"), now).otherwise(F.col("updated_at")),
        "status": F.when(F.col("__hit"), F.when(bad, "error").otherwise("done")).otherwise(F.col("status")),
    }).drop("__id", "__srt", "__failed", "__hit")


def lookup(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """(job_id, code): what a request for a job's text gets: 200, 404 unknown, 409 unfinished, 500 failed."""
    found = asked.select("job_id").join(jobs.select("job_id", "status"), "job_id", "left")
    return found.select("job_id", F.when(F.col("status").isNull(), 404).when(F.col("status") == "done", 200).when(F.col("status") == "error", 500).otherwise(409).alias("code"))
