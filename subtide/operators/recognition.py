"""Speech recognition as a plan: which audio goes to a model and how, and what its answers become.

The model and the voice detector are a caller's (mapInPandas over these tables); here are the routing by language, the
windows with their context, the clamping of answers to what they were asked for, and the documents made of them.

files: doc_id, n_samples, language; ranges: doc_id, line_no, start_s, end_s, lang. A file with no range left is
recognised whole. Empty tables give empty tables; a file without an answer gives an empty document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.functions.text import strip
from subtide.operators.ranges import LEAST, PADDING, RATE, merge_speech, normalized, sliced, tiled
from subtide.operators.timing import optimize_documents, segment_words
from subtide.sources.srt import segments_to_cues, serialize, words_of

# How the model is asked, by route.
ASKED = {
    "target": {"beam_size": 5, "temperature": [0.0], "vad_filter": True, "multilingual": False},
    "mixed": {"beam_size": 10, "temperature": [0.0, 0.2, 0.4], "vad_filter": False, "multilingual": True},
}
# Silence, in ms, at which the voice detector ends an interval of a mixed piece; of all others, and of
# professional ones, the second.
SILENCE_MS, PRO_SILENCE_MS = 500, 700


def pieces(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, piece, route, lang, start_s, from_smp, to_smp): the parts of each file, in order.

    route: whole (the file, in its language), mixed, or target (a part in one language). Target parts under LEAST go.
    """
    known = files.select("doc_id", "n_samples", F.coalesce("language", F.lit("auto")).alias("language"))
    timed = ranges.join(known.select("doc_id", (F.col("n_samples") / RATE).alias("total_s")), "doc_id")
    left = normalized(timed).join(known.select("doc_id", "language"), "doc_id")
    parts = tiled(left, F.col("language")).join(known.select("doc_id", "n_samples"), "doc_id")
    route = F.when(F.col("lang") == "mixed", "mixed").otherwise("target")
    parts = sliced(parts).select("doc_id", F.struct("run", "nth").alias("at"), route.alias("route"), "lang", "start_s", "from_smp", "to_smp")
    parts = parts.filter((F.col("route") == "mixed") | ((F.col("to_smp") - F.col("from_smp")) / RATE >= LEAST))
    rest = known.join(left.select("doc_id").distinct(), "doc_id", "left_anti")
    at = F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).alias("nth"))
    rest = rest.select("doc_id", at.alias("at"), F.when(F.col("language") == "mixed", "mixed").otherwise("whole").alias("route"), F.col("language").alias("lang"), F.lit(0.0).alias("start_s"), F.lit(0).cast("long").alias("from_smp"), F.col("n_samples").cast("long").alias("to_smp"))
    place = (F.col("at.run") * 3 + F.col("at.nth")).cast("long")
    return parts.unionByName(rest).withColumn("piece", place).select("doc_id", "piece", "route", "lang", "start_s", "from_smp", "to_smp")


def _asked(route: Column, lang: Column, words: Column) -> Column:
    """The model's options."""
    mixed = route == "mixed"
    made = {k: F.when(mixed, F.lit(ASKED["mixed"][k])).otherwise(F.lit(ASKED["target"][k])) for k in ASKED["target"]}
    named = F.when(~mixed & (lang != "auto") & (lang != ""), lang)
    return F.struct(*[c.alias(k) for k, c in made.items()], named.alias("language"), words.alias("word_timestamps"))


def windows(parts: DataFrame, speech: DataFrame, professional: bool = False) -> DataFrame:
    """(doc_id, piece, win, lang, from_smp, to_smp, offset_s, min_s, max_s, words, asked): what the model is asked.

    speech: (doc_id, piece, pos, start_smp, end_smp) of the voice detector, in samples of the piece. Mixed pieces go by
    speech, and professional target pieces too; professional windows get context on both sides, and answers are clamped
    to the speech itself. A piece in which no voice was found is one window.
    """
    size = F.col("to_smp") - F.col("from_smp")
    rows = parts.withColumn("size", size)
    by_speech = (F.col("route") == "mixed") | (F.lit(professional) & (F.col("route") == "target"))
    found = speech.withColumn("__key", F.concat_ws(":", "doc_id", "piece"))
    heard = found.select("doc_id", "piece").distinct().withColumn("heard", F.lit(True))
    rows = rows.join(heard, ["doc_id", "piece"], "left").withColumn("by_speech", by_speech & F.coalesce("heard", F.lit(False))).drop("heard")
    if professional:
        found = merge_speech(found, "__key").join(found.select("__key", "doc_id", "piece").distinct(), "__key")
    own = rows.filter("by_speech").join(found.select("doc_id", "piece", F.col("pos").alias("win"), "start_smp", "end_smp"), ["doc_id", "piece"])
    own = own.withColumns({"a": F.greatest(F.lit(0), F.col("start_smp")), "z": F.least(F.col("size"), F.col("end_smp"))})
    pad = int(PADDING * RATE) if professional else 0
    own = own.withColumns({"from": F.greatest(F.lit(0), F.col("a") - pad), "to": F.least(F.col("size"), F.col("z") + pad)})
    # a target's speech must be some itself, a mixed piece's with its context
    own = own.filter((F.col("to") > F.col("from")) & ((F.col("route") == "mixed") | (F.col("z") > F.col("a"))) & ((F.col("to") - F.col("from")) / RATE >= LEAST))
    at = lambda c: F.col("start_s") + F.col(c) / RATE
    own = own.withColumns({
        "offset_s": at("from"), "min_s": at("a") if professional else F.lit(None).cast("double"), "max_s": at("z") if professional else at("to"),
        "words": F.lit(professional), "to_smp": F.col("from_smp") + F.col("to"), "from_smp": F.col("from_smp") + F.col("from"),
    })
    one = rows.filter("NOT by_speech AND (route != 'target' OR size > 0)").withColumns({
        "win": F.lit(0).cast("long"), "offset_s": F.col("start_s"), "min_s": F.lit(None).cast("double"),
        "max_s": F.when(F.col("route") != "whole", F.col("start_s") + F.col("size") / RATE), "words": F.lit(professional) & (F.col("route") != "target"),
    })
    names = ["doc_id", "piece", "win", "route", "lang", "from_smp", "to_smp", "offset_s", "min_s", "max_s", "words"]
    both = own.select(*names).unionByName(one.select(*names))
    return both.withColumn("asked", _asked(F.col("route"), F.col("lang"), F.col("words"))).drop("route")


def cues(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, piece, win, pos, start_s, end_s, text): the model's answers as cues.

    answers: (doc_id, piece, win, pos, start_s, end_s, text, words (array of start_s, end_s, word)), in seconds of the
    window. Windows with words are cut anew by their words, those without a word keep their segments.
    """
    order = ("piece", "win", "pos")
    rows = answers.join(asked.select("doc_id", "piece", "win", "lang", "offset_s", "min_s", "max_s", F.col("words").alias("by_words")), ["doc_id", "piece", "win"])
    names = ["doc_id", *order, "start_s", "end_s", "text"]
    plain = segments_to_cues(rows.filter("NOT by_words"), "offset_s", "min_s", "max_s", order).select(*names)
    spoken = rows.filter("by_words").withColumn("__key", F.struct("doc_id", "piece", "win"))
    known = spoken.select("__key").distinct().withColumn("__id", F.concat_ws(":", "__key.doc_id", "__key.piece", "__key.win"))
    spoken = spoken.withColumn("doc_id", F.concat_ws(":", "doc_id", "piece", "win"))
    told = words_of(spoken, "offset_s", "min_s", "max_s", keep=("lang",))
    made = segment_words(told.filter("is_word")).unionByName(told.filter("NOT is_word").select("doc_id", F.col("pos").cast("long").alias("pos"), "start_s", "end_s", "text"))
    made = made.filter((strip(F.col("text")) != "") & (F.col("end_s") > F.col("start_s"))).withColumnRenamed("doc_id", "__id")
    made = made.join(known, "__id").select("__key.doc_id", "__key.piece", "__key.win", F.col("pos").cast("long").alias("pos"), "start_s", "end_s", strip(F.col("text")).alias("text"))
    return plain.withColumn("pos", F.col("pos").cast("long")).unionByName(made.select(*names))


def documents(files: DataFrame, found: DataFrame, professional: bool = False) -> DataFrame:
    """(doc_id, srt_text) of every file, from cues(); professional ones are optimised in the file's language."""
    row = F.struct("piece", "win", "pos", "start_s", "end_s", "text")
    made = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("cues"))
    out = files.select("doc_id", F.coalesce("language", F.lit("auto")).alias("language")).join(made, "doc_id", "left")
    out = out.withColumn("srt_text", F.coalesce(serialize(F.col("cues")), F.lit(""))).drop("cues")
    if professional:
        out = optimize_documents(out, "srt_text", F.col("language"), "__better").withColumn("srt_text", F.col("__better"))
    return out.select("doc_id", "srt_text")


def segments_to_srt(segments: DataFrame, professional: bool = False, language: str = "auto") -> DataFrame:
    """(doc_id, srt_text): documents of a model's segments (doc_id, pos, start_s, end_s, text, words), without optimisation."""
    whole = segments.select("doc_id").distinct()
    asked = whole.select("doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("win"), F.lit(language).alias("lang"), F.lit(0.0).alias("offset_s"), F.lit(None).cast("double").alias("min_s"), F.lit(None).cast("double").alias("max_s"), F.lit(professional).alias("words"))
    answers = segments.withColumns({"piece": F.lit(0).cast("long"), "win": F.lit(0).cast("long")})
    return documents(whole.withColumn("language", F.lit(language)), cues(asked, answers))
