"""Hints whose wrong form occurs in a document, and the terms to protect in it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.sources.dictionaries import HINTS, NUMERIC_RULES, PROTECTED_TERMS, load_hints


#: Lists up to this length are broadcast; longer ones are joined by their beginnings, of at most so many characters.
BROADCAST_LIST, BEGINNING = 2000, 4


def hint_table(spark: SparkSession, hints: list[tuple] | None = None) -> DataFrame:
    rows = [(n, *h) for n, h in enumerate(HINTS if hints is None else hints)]
    return spark.createDataFrame(rows, "ord int, wrong string, suggest string, language string, confidence string, condition string")


def term_table(spark: SparkSession, terms: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PROTECTED_TERMS if terms is None else terms)), "ord int, term string")


def hint_source(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[str, bool]]:
    """Hints, protected terms and numeric rules of a JSON file; what is no hint, term or rule is left out."""
    found = load_hints(path)
    listed = lambda key: got if isinstance(got := found.get(key), list) else []
    text = lambda h, key: str(h[key]) if h.get(key) is not None else None
    hints = [(h["wrong"], h.get("suggest") if isinstance(h.get("suggest"), str) else None, text(h, "language"), text(h, "confidence"), text(h, "condition")) for h in listed("correction_hints") if isinstance(h, dict) and isinstance(h.get("wrong"), str) and h["wrong"]]
    terms = [t for t in listed("protected_terms") if isinstance(t, str) and t]
    return hint_table(spark, hints), term_table(spark, terms), numeric_rules(found.get("numeric_rules"), {})


def contained(docs: DataFrame, side: DataFrame, column: str) -> DataFrame:
    """docs (doc_id, text) joined with the rows of side whose column their text contains.

    A short list is broadcast; for a longer one the text's distinct pieces of the length of a common beginning are
    joined with the beginnings by a shuffle.
    """
    if side.limit(BROADCAST_LIST + 1).count() <= BROADCAST_LIST:
        return docs.join(F.broadcast(side), F.contains("text", column))
    size = min(BEGINNING, side.agg(F.min(F.length(column))).first()[0])
    places = F.sequence(F.lit(1), F.length("text") - size + 1)
    cut = docs.filter(F.length("text") >= size).withColumn("__piece", F.explode(F.array_distinct(F.transform(places, lambda n: F.substring(F.col("text"), n, F.lit(size))))))
    found = cut.join(side.withColumn("__begin", F.substring(column, 1, size)), F.col("__piece") == F.col("__begin"))
    return found.filter(F.contains("text", column)).drop("__piece", "__begin")


def hint_matches(docs: DataFrame, language: str | None = "auto", hints: DataFrame | None = None) -> DataFrame:
    """(doc_id, ord, wrong, suggest): hints of the language whose wrong form a text contains."""
    lang = (language or "auto").strip().lower()
    side = hint_table(docs.sparkSession) if hints is None else hints
    tag = F.lower(F.trim(F.coalesce("language", F.lit("any"))))
    side = side.filter(tag.isin("any", "", lang) & (F.col("wrong") != "")).select("ord", "wrong", "suggest")
    return contained(docs.select("doc_id", "text"), side, "wrong").select("doc_id", "ord", "wrong", "suggest")


def protected_terms(docs: DataFrame, language: str | None = "auto", terms: DataFrame | None = None, hints: DataFrame | None = None) -> DataFrame:
    """(doc_id, ord, term): terms in the text, and terms that a matching hint suggests."""
    side = (term_table(docs.sparkSession) if terms is None else terms).filter("term != ''")
    inside = contained(docs.select("doc_id", "text"), side, "term").select("doc_id", "ord", "term")
    named = hint_matches(docs, language, hints).select("doc_id", "suggest").join(side, F.col("suggest") == F.col("term")).select("doc_id", "ord", "term")
    return inside.union(named).distinct()


def numeric_rules(rules: object = None, default: dict = NUMERIC_RULES) -> dict[str, bool]:
    """The boolean rules; none if none is on."""
    rules = default if rules is None else rules
    found = {str(k): v for k, v in rules.items() if isinstance(v, bool)} if isinstance(rules, dict) else {}
    return found if any(found.values()) else {}


def prompt(items: list[dict], language: str | None, hints: list[dict] | None = None, terms: list[str] | None = None, rules: dict | None = None) -> str:
    """The request to a language model for one document's (index, text) items."""
    known = {k: v for k, v in (("protected_terms", terms), ("numeric_rules", rules), ("correction_hints", hints)) if v}
    # The request's lines.
    lines = [
        f"Language: {language or 'auto'}",
        "Input subtitle blocks are JSON objects with index and text only.",
        "Correct each block independently and return JSON only.",
        "Output shape must be an object with an items array:",
        '{"items":[{"index":1,"clean_text":"..."}]}',
    ]
    if known:
        lines += [
            "The following correction hints are advisory, not mandatory replacements.",
            "Use them only when the current context strongly supports the correction.",
            "If unsure, keep the original text.",
            "Hard rules such as numeric preservation must always be followed.",
            "Relevant hints:",
            json.dumps(known, ensure_ascii=False),
        ]
    return "\n".join([*lines, "Input:", json.dumps(items, ensure_ascii=False)])


def prompts(docs: DataFrame, language: str | None = "auto") -> DataFrame:
    """(doc_id, prompt) of parsed documents (doc_id, cues)."""
    text = docs.select("doc_id", F.array_join(F.transform("cues", lambda c: c["text"]), "\n").alias("text"))
    matched = F.sort_array(F.collect_list("ord"))
    found = hint_matches(text, language).groupBy("doc_id").agg(matched.alias("hints"))
    kept = protected_terms(text, language).groupBy("doc_id").agg(matched.alias("terms"))
    rows = docs.select("doc_id", F.transform("cues", lambda c: F.struct(c["idx"].alias("index"), c["text"].alias("text"))).alias("items")).join(found, "doc_id", "left").join(kept, "doc_id", "left")
    names = ("wrong", "suggest", "language", "confidence", "condition")

    @F.udf("string", useArrow=True)
    def made(items, hints, terms):
        listed = [{"index": i["index"], "text": i["text"]} for i in items]
        return prompt(listed, language, [dict(zip(names, HINTS[n], strict=True)) for n in hints or []], [PROTECTED_TERMS[n] for n in terms or []], numeric_rules())

    return rows.select("doc_id", made("items", "hints", "terms").alias("prompt"))
