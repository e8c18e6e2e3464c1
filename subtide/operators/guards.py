"""Checks of machine-made corrections before they replace a cue's text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.functions.text import hangul, kana, numeric_tokens, strip
from subtide.sources.srt import parse, serialize

# Marks of a model that thinks aloud, and the reasons given.
THINKING = ["Thought for", "Thinking Process", "<think>", "</think>", "Analyze the Request", "Detailed Correction Plan"]
PARTLY = "Some AI block corrections were rejected; rule-based text was used for those blocks."
ITEMS = "struct<full_error:string,items:array<struct<idx:long,clean_text:string>>>"


def thinking_error(text: Column) -> Column:
    hits = [F.when(F.contains(text, F.lit(m)), F.lit(f"AI response contained thinking output marker: {m}.")) for m in THINKING]
    return F.coalesce(*hits)


def max_length(n: Column) -> Column:
    n = n.cast("double")
    return F.when(n <= 20, F.ceil(F.greatest(n * F.lit(1.6).cast("double"), n + 8))).otherwise(F.ceil(n * F.lit(1.35).cast("double")))


def text_error(new: Column, old: Column) -> Column:
    """The first reason to refuse a text in place of another; null if there is none."""
    n, m = F.length(strip(old)), F.length(new)
    script = (
        F.when((kana(old) >= 2) & (kana(new) == 0), "AI clean_text removed Japanese kana, likely translating or changing script.")
        .when((hangul(old) == 0) & (hangul(new) >= 3), "AI clean_text introduced Hangul into a non-Korean block.")
        .when((hangul(old) >= 3) & (hangul(new) == 0), "AI clean_text removed Hangul, likely translating or changing script.")
    )
    size = F.when(m > max_length(n), "AI clean_text was excessively longer than the rule-based text.").when((n > 4) & (m < n * 0.5), "AI clean_text was excessively shorter than the rule-based text.")
    shape = (
        F.when(new.rlike(r"(?i)```|`+\s*json"), "AI clean_text contained markdown code fences.")
        .when(F.contains(new, F.lit("-->")), "AI clean_text contained an SRT timestamp separator.")
        .when(new.rlike(r"(?U)\d{2,}:[0-5]\d:[0-5]\d,\d{3}"), "AI clean_text contained an SRT timestamp.")
        .when(new.rlike(r"(?U)\n\s*\n"), "AI clean_text appeared to contain multiple SRT blocks.")
        .when(new.rlike(r"(?mU)^\s*\d+\s*$"), "AI clean_text contained a standalone SRT index.")
        .when(numeric_tokens(new) != numeric_tokens(old), "AI clean_text changed numeric tokens.")
    )
    return F.coalesce(F.when(new == "", "AI clean_text was empty."), thinking_error(new), shape, script, size)


def read_response(raw: str | None, indices: list[int]) -> dict:
    """A response's items by place, or why it is refused as a whole. Types are those of JSON: true is no number."""
    fail = lambda why: {"full_error": why, "items": None}
    try:
        payload = json.loads((raw or "").strip())
    except ValueError:
        return fail("AI response was not valid JSON.")
    if isinstance(payload, dict):
        payload = payload.get("items")
        if not isinstance(payload, list):
            return fail("AI response object did not contain a valid items list.")
    if not isinstance(payload, list):
        return fail("AI response top-level value was not a list or an object with an items list.")
    if len(payload) != len(indices):
        return fail("AI response block count did not match SRT block count.")
    items = []
    for item, want in zip(payload, indices, strict=True):
        if not isinstance(item, dict):
            return fail("AI response item was not an object.")
        idx, text = item.get("index"), item.get("clean_text")
        if type(idx) is not int:
            return fail("AI response item index was not an integer.")
        if idx != want:
            return fail("AI response indices did not match SRT block indices.")
        items.append({"idx": idx, "clean_text": text.strip() if isinstance(text, str) else None})
    return {"full_error": None, "items": items}


def same_cues(a: Column, b: Column, what: str) -> Column:
    """How two cue lists differ in count, numbers or times; null if they don't."""
    part = lambda cues, name: F.transform(cues, lambda c: c[name])
    return (
        F.when(F.size(a) != F.size(b), what.format("block count"))
        .when(part(a, "idx") != part(b, "idx"), what.format("indices"))
        .when(part(a, "start_s") != part(b, "start_s"), what.format("start times"))
        .when(part(a, "end_s") != part(b, "end_s"), what.format("end times"))
    )


def apply_responses(docs: DataFrame, enabled: bool = True) -> DataFrame:
    """docs (doc_id, srt_text, clean_srt, changes, ai_response, ai_error, ai_enabled) with final_srt, ai_used, reason and all changes.

    Every failure keeps the rule-based text and says why; the gates come in the order of the coalesce. Row by row, no shuffle.
    """

    @F.udf(ITEMS, useArrow=True)
    def read(raw, indices):
        return read_response(raw, list(indices) if indices is not None else [])

    out = parse(docs, "srt_text").withColumnsRenamed({"cues": "raw_cues", "parse_error": "raw_error"})
    out = parse(out, "clean_srt").withColumnsRenamed({"cues": "rule_cues", "parse_error": "rule_error"})
    out = out.withColumn("__r", read("ai_response", F.transform("rule_cues", lambda c: c["idx"])))

    def decided(cue: Column, item: Column) -> Column:
        text = item["clean_text"]
        error = F.when(text.isNull(), "AI clean_text was not a string.").otherwise(text_error(text, cue["text"]))
        return F.struct(cue.alias("cue"), text.alias("text"), error.alias("error"))

    out = out.withColumn("__d", F.zip_with("rule_cues", F.col("__r.items"), decided))
    final = F.transform("__d", lambda d: F.struct(d["cue"]["idx"].alias("idx"), d["cue"]["start_s"].alias("start_s"), d["cue"]["end_s"].alias("end_s"), F.when(d["error"].isNull(), d["text"]).otherwise(d["cue"]["text"]).alias("text")))
    out = out.withColumn("__srt", serialize(final))
    again = parse(out, "__srt").withColumnsRenamed({"cues": "__again", "parse_error": "__again_error"})
    taken = F.exists("__d", lambda d: d["error"].isNull())
    refused = F.filter("__d", lambda d: d["error"].isNotNull())
    reason = F.coalesce(
        F.when(F.col("raw_error").isNotNull() | F.col("rule_error").isNotNull(), "Input SRT is malformed; AI clean skipped."),
        same_cues(F.col("raw_cues"), F.col("rule_cues"), "Rule-based clean SRT changed {}; AI clean skipped."),
        F.when(~F.coalesce("ai_enabled", F.lit(True)), "AI clean disabled by request."),
        F.lit(None if enabled else "AI clean disabled by environment.").cast("string"),
        F.col("ai_error"),
        thinking_error(F.coalesce("ai_response", F.lit(""))),
        F.col("__r.full_error"),
        F.when(F.col("__again_error").isNotNull(), F.concat(F.lit("Final AI clean SRT did not parse: "), F.col("__again_error"))),
        same_cues(F.col("raw_cues"), F.col("__again"), "Final AI clean SRT changed {}."),
        F.when(~taken, F.coalesce(F.try_element_at(refused, F.lit(1))["error"], F.lit("All AI block corrections were rejected; used rule-based clean SRT."))),
    )
    again = again.withColumn("__why", reason)
    entry = lambda idx, before, after, kind, why: F.struct(idx.alias("idx"), before.alias("before"), after.alias("after"), F.lit(kind).alias("type"), why.alias("message"))
    none = F.lit(None).cast("string")
    made = F.transform(
        F.filter("__d", lambda d: d["error"].isNotNull() | (d["text"] != d["cue"]["text"])),
        lambda d: F.when(d["error"].isNotNull(), entry(d["cue"]["idx"], none, none, "ai_block_fallback", d["error"])).otherwise(entry(d["cue"]["idx"], d["cue"]["text"], d["text"], "ai_text_correction", none)),
    )
    used = F.col("__why").isNull()
    return again.select(
        "doc_id",
        F.when(used, F.col("__srt")).otherwise(F.col("clean_srt")).alias("final_srt"),
        used.alias("ai_used"),
        F.when(~used, F.col("__why")).when(F.size(refused) > 0, PARTLY).alias("reason"),
        F.concat("changes", F.when(F.coalesce(F.col("__d").isNotNull() & taken, F.lit(False)), made).otherwise(F.array().cast("array<struct<idx:int,before:string,after:string,type:string,message:string>>"))).alias("changes"),
    )
