"""Reading-quality issues of cues, each compared with the one before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subtide.functions.text import LINE_BREAK, PUNCTUATION, QUALITY, contains_cjk, cps_limit, line_limit, reading_chars, strip
from subtide.sources.srt import collected, cue_errors


def issues(cues: DataFrame, limits: dict | None = None) -> DataFrame:
    """(doc_id, pos, ord, issue): one row an issue, in the order of a reader's checks within a cue.

    cues: doc_id, pos, idx, start_s, end_s, text. One shuffle by document serves both lags.
    """
    at = QUALITY | (limits or {})
    w = W.partitionBy("doc_id").orderBy("pos")
    rows = cues.withColumns({"prev_start": F.lag("start_s").over(w), "prev_end": F.lag("end_s").over(w), "body": strip(F.coalesce("text", F.lit("")))})
    rows = rows.withColumns({"lines": F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.split("body", LINE_BREAK)), "dur": F.col("end_s") - F.col("start_s")})
    cps = cps_limit(F.col("body"), {"cjk_cps": at["cjk_cps"], "latin_cps": at["latin_cps"]})
    say = lambda what: F.concat(F.lit("Block "), F.col("idx").cast("string"), F.lit(f" {what}"))
    gap = F.col("start_s") - F.col("prev_end")
    whole = F.array(
        F.when(F.col("start_s") < F.col("prev_start"), say("starts before previous block")),
        F.when(gap < 0, say("overlaps previous block")).when(gap < at["min_gap"], say(f"gap is shorter than {at['min_gap']:.3f}s")),
        F.when(F.col("dur") < at["min_duration"], say(f"duration is shorter than {at['min_duration']:.3f}s")),
        F.when(F.col("dur") > at["max_duration"], say(f"duration is longer than {at['max_duration']:.3f}s")),
        F.when((F.col("dur") > 0) & (reading_chars(F.col("body")) / F.col("dur") > cps), F.concat(say("reading speed is above "), F.format_string("%.1f CPS", cps))),
        F.when(F.size("lines") > at["lines"], say(f"has more than {at['lines']} subtitle lines")),
        F.when(F.col("body").rlike(r"[A-Za-z]{2,}\n[A-Za-z]{2,}"), say("splits an ASCII word across lines")),
    )

    def of_line(line):
        text = strip(line)
        most = F.when(contains_cjk(text), at["cjk_line"]).otherwise(at["latin_line"])
        return F.array(
            F.when(text.rlike(f"^[{PUNCTUATION}]"), say("has punctuation at the start of a line")),
            F.when(reading_chars(text) > most, F.concat(say("line is longer than "), most.cast("string"), F.lit(" chars"))),
        )

    found = F.array_compact(F.concat(whole, F.flatten(F.transform("lines", of_line))))
    return rows.select("doc_id", "pos", F.posexplode(found).alias("ord", "issue"))


def first_fault(cues: DataFrame, limits: dict | None = None) -> DataFrame:
    """(doc_id, error): a document's first structural fault, else its first issue, else null."""
    whole = collected(cues).select("doc_id", cue_errors(F.col("cues")).alias("fault"))
    first = issues(cues, limits).groupBy("doc_id").agg(F.min(F.struct("pos", "ord", "issue"))["issue"].alias("issue"))
    return whole.join(first, "doc_id", "left").select("doc_id", F.coalesce("fault", "issue").alias("error"))


def metrics(cues: DataFrame) -> DataFrame:
    """Reading measures and the professional limits of each cue."""
    t = F.coalesce("text", F.lit(""))
    return cues.select("doc_id", "pos", reading_chars(t).cast("long").alias("chars"), contains_cjk(t).alias("cjk"), line_limit(t).cast("long").alias("line_limit"), cps_limit(t).alias("cps_limit"))
