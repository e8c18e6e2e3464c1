"""Rule-based cleaning: ordered dictionary replacement and format rules, with a log of every change."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.functions.text import chinese_punctuation, flatten, format_rules, strip
from subtide.sources.dictionaries import Corrections, load_corrections
from subtide.sources.srt import cue_errors, parse, serialize, serialize_error

CHANGE = "struct<idx:int,before:string,after:string,type:string,message:string>"
FALLBACK = "Clean SRT validation failed; returned Raw SRT unchanged."


def bounded(before: str) -> bool:
    """Short ASCII words are replaced as whole words only."""
    return len(before) <= 6 and re.fullmatch(r"[A-Za-z0-9_+-]+", before) is not None


def _change(idx: Column, before: Column, after: Column, kind: str) -> Column:
    return F.struct(idx.cast("int").alias("idx"), before.alias("before"), after.alias("after"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("message"))


def _state(text: Column, log: Column) -> Column:
    return F.struct(text.alias("text"), log.alias("log"))


def replace_all(state: Column, rules: dict[str, str], kind: str, idx: Column) -> Column:
    """Folds the rules over (text, log), longest first, each on the result of those before; a log entry a rule that changed something."""
    ordered = sorted((r for r in rules.items() if r[0] and r[0] != r[1]), key=lambda r: -len(r[0]))
    if not ordered:
        return state
    listed = F.array(*[
        F.struct(
            F.lit(b).alias("before"), F.lit(a).alias("after"), F.lit(bounded(b)).alias("bounded"),
            F.lit(r"(?<![A-Za-z0-9_])" + re.escape(b) + r"(?![A-Za-z0-9_])").alias("pattern"), F.lit(re.sub(r"([\\$])", r"\\\1", a)).alias("by"),
        )
        for b, a in ordered
    ])

    def step(s: Column, r: Column) -> Column:
        new = F.when(r["bounded"], F.regexp_replace(s["text"], r["pattern"], r["by"])).otherwise(F.replace(s["text"], r["before"], r["after"]))
        return F.when(F.contains(s["text"], r["before"]) & (new != s["text"]), _state(new, F.concat(s["log"], F.array(_change(idx, r["before"], r["after"], kind))))).otherwise(s)

    return F.aggregate(listed, state, step)


def _then(state: Column, rule, kind: str, idx: Column) -> Column:
    """One whole-text rule as a fold over one element, so that the state is worked out once."""
    return F.aggregate(F.array(F.lit(0)), state, lambda s, _: F.when(rule(s["text"]) != s["text"], _state(rule(s["text"]), F.concat(s["log"], F.array(_change(idx, s["text"], rule(s["text"]), kind))))).otherwise(s))


def clean(text: Column, idx: Column, rules: Corrections, language: str | None = "auto", contextual: bool = False) -> Column:
    """(text, log) of one cue text."""
    state = _state(flatten(text), F.array().cast(f"array<{CHANGE}>"))
    state = replace_all(state, rules.safe, "safe_replacement", idx)
    state = replace_all(state, rules.terms_map, "term_replacement", idx)
    if contextual:
        state = replace_all(state, rules.contextual, "contextual_replacement", idx)
    for rule in format_rules():
        state = _then(state, rule, "format_normalization", idx)
    if (language or "auto").strip().lower() == "zh":
        state = _then(state, chinese_punctuation, "punctuation_normalization", idx)
    return state


def clean_cues(cues: DataFrame, language: str | None = "auto", contextual: bool = False, custom_terms: list[str] | None = None) -> DataFrame:
    """cues with clean_text and changes."""
    made = cues.withColumn("__s", clean(F.coalesce("text", F.lit("")), F.col("idx"), load_corrections(language, custom_terms), language, contextual))
    return made.withColumns({"clean_text": strip(F.col("__s.text")), "changes": F.col("__s.log")}).drop("__s")


def clean_documents(docs: DataFrame, text: str = "srt_text", language: str | None = "auto", contextual: bool = False, custom_terms: list[str] | None = None) -> DataFrame:
    """docs with clean_srt and changes, without a shuffle. A document that can't be parsed, or not after cleaning, stays as it is."""
    rules = load_corrections(language, custom_terms)
    out = parse(docs, text).withColumn("__s", F.transform("cues", lambda c: F.struct(c.alias("cue"), clean(c["text"], c["idx"], rules, language, contextual).alias("state"))))
    out = out.withColumn("__c", F.transform("__s", lambda s: F.struct(s["cue"]["idx"].alias("idx"), s["cue"]["start_s"].alias("start_s"), s["cue"]["end_s"].alias("end_s"), strip(s["state"]["text"]).alias("text"))))
    good = F.col("parse_error").isNull() & cue_errors(F.col("__c")).isNull() & serialize_error(F.col("__c")).isNull()
    out = out.withColumn("__srt", F.when(good, serialize(F.col("__c"))))
    again = parse(out.drop("cues", "parse_error"), "__srt").withColumnRenamed("cues", "__again")
    same = F.coalesce(F.size("__again") == F.size("__c"), F.lit(False))
    fallback = F.array(F.struct(F.lit(None).cast("int").alias("idx"), F.lit("").alias("before"), F.lit("").alias("after"), F.lit("validation_fallback").alias("type"), F.lit(FALLBACK).alias("message")))
    again = again.withColumns({
        "changes": F.when(same, F.flatten(F.transform("__s", lambda s: s["state"]["log"]))).otherwise(fallback),
        "clean_srt": F.when(same, F.col("__srt")).otherwise(F.col(f"`{text}`")),
    })
    return again.drop("__s", "__c", "__srt", "__again", "parse_error")


def count_changes(docs: DataFrame) -> DataFrame:
    """(type, n) over all logs, without fallbacks."""
    return docs.select(F.explode_outer("changes").alias("c")).filter("c.type != 'validation_fallback'").groupBy(F.col("c.type").alias("type")).agg(F.count("*").alias("n"))
