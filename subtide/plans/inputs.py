"""Inputs derived from the driver's tables by rules that SQL can follow; each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.sources.srt import collected, serialize

# What is added to a cue's text, by the rule's number.
ADDED = {4: " 第 10 課", 5: " 30%考材 PatternDrill", 6: " 吗?", 7: " 30 % ページ", 8: " 對戀,Chat GPT 몇시"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as cues with gaps, overlaps, regressions and texts that break rules."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.pmod(F.col("doc_id") * 31 + F.col("pos") * 17, F.lit(10)))
    start = F.col("pos") * F.lit(4.0).cast("double") - F.when((F.col("k") == 4) & (F.col("pos") > 0), 4.5).otherwise(0.0)
    rows = rows.withColumn("start_s", start)
    length = F.when(F.col("k") == 0, 0.4).when(F.col("k") == 1, 3.95).when(F.col("k") == 2, 3.916).when(F.col("k") == 3, 11.0).otherwise(F.least(F.lit(6.0), F.length("text") / 25.0 + 0.3))
    text = F.col("text")
    for k, more in ADDED.items():
        text = F.when(F.col("k") == k, F.concat("text", F.lit(more))).otherwise(text)
    text = F.when(F.col("k") == 9, F.concat(F.lit("、ab\ncd "), "text")).otherwise(text)
    return rows.select("doc_id", "pos", (F.col("pos") + 1).cast("int").alias("idx"), "start_s", (F.col("start_s") + length).alias("end_s"), text.alias("text"), "k")


CUES = "cues AS MATERIALIZED (WITH c AS (SELECT conv_id AS doc_id, turn AS pos, coalesce(text, '') AS text, (conv_id * 31 + turn * 17) % 10 AS k FROM conversations), s AS (SELECT *, pos * 4.0::DOUBLE - CASE WHEN k = 4 AND pos > 0 THEN 4.5::DOUBLE ELSE 0.0::DOUBLE END AS start_s FROM c) SELECT doc_id, pos, (pos + 1)::INT AS idx, start_s, start_s + CASE k WHEN 0 THEN 0.4::DOUBLE WHEN 1 THEN 3.95::DOUBLE WHEN 2 THEN 3.916::DOUBLE WHEN 3 THEN 11.0::DOUBLE ELSE least(6.0::DOUBLE, length(text) / 25.0::DOUBLE + 0.3::DOUBLE) END AS end_s, CASE k " + " ".join(f"WHEN {k} THEN text || '{v}'" for k, v in ADDED.items()) + " WHEN 9 THEN '、ab' || chr(10) || 'cd ' || text ELSE text END AS text, k FROM s)"
#: Time of SRT in SQL, from a column of seconds.
TIME = "(SELECT printf('%02d:%02d:%02d,%03d', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000) FROM (SELECT round_even(greatest({0}, 0.0::DOUBLE) * 1000, 0)::BIGINT AS m))"
STRIP = r"regexp_replace({0}, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"


def plain_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues in order without regressions, numbered from 1: what a well-formed document holds."""
    rows = cues(spark, sf_dir)
    start = F.col("pos") * F.lit(4.0)
    return rows.withColumns({"start_s": start, "end_s": start + 0.5 + (F.col("k") % 4) * 1.125}).filter(F.trim("text") != "")


PLAIN = "plain AS (SELECT doc_id, pos, idx, pos * 4.0::DOUBLE AS start_s, pos * 4.0::DOUBLE + 0.5::DOUBLE + (k % 4) * 1.125::DOUBLE AS end_s, text, k FROM cues WHERE trim(text) <> '')"


def srt_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, srt_text): well-formed documents."""
    return collected(plain_cues(spark, sf_dir)).select("doc_id", serialize(F.col("cues")).alias("srt_text"))


SRT = f"srt AS (SELECT doc_id, string_agg(n || chr(10) || {TIME.format('start_s')} || ' --> ' || {TIME.format('end_s')} || chr(10) || {STRIP.format('text')}, chr(10) || chr(10) ORDER BY pos) || chr(10) AS srt_text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM plain) GROUP BY doc_id)"


def faulty_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """srt_docs with a fault by doc_id: an arrow lost, a time of 61 minutes, a first number of 7, or nothing but space."""
    k = F.col("doc_id") % 5
    broken = F.when(k == 1, F.regexp_replace("srt_text", "^(1\n[^\n]*)-->", "$1 to ")).when(k == 2, F.regexp_replace("srt_text", "^1\n00:00:", "1\n00:61:")).when(k == 3, F.concat(F.lit("7"), F.substring("srt_text", 2, 1 << 30))).when(k == 4, " \n ").otherwise(F.col("srt_text"))
    return srt_docs(spark, sf_dir).select("doc_id", broken.alias("srt_text"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents, 0.3 s each, with 1.5 s of silence before every seventeenth."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("pos", "text"))
    start = F.col("pos") * 0.3 + F.floor(F.col("pos") / 17) * 1.5
    return rows.filter("text != ''").select("doc_id", "pos", start.alias("start_s"), (start + 0.3).alias("end_s"), "text")


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c: (F.greatest(F.col(c), F.lit(0.0)) * 16000).cast("long")
    return cues(spark, sf_dir).select("doc_id", "pos", at("start_s").alias("start_smp"), at("end_s").alias("end_smp"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("hit_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as job records: status by event_id, times from ts."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t"))
    status = F.element_at(F.array(*map(F.lit, ("running", "done", "error"))), (F.col("event_id") % 3 + 1).cast("int"))
    return rows.select(F.col("event_id").alias("job_id"), status.alias("status"), F.col("t").alias("created_at"), (F.col("t") + F.col("event_id") % 1000).alias("updated_at"), F.lit("").alias("srt_text"), F.lit("").alias("error"))


def range_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw): a list of ranges a conversation, in several ways of writing them, some wrong."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("t"))
    a, z = (F.col("t") * 10).cast("string"), (F.col("t") * 10 + 4).cast("string")
    k = F.pmod(F.col("doc_id") + F.col("t"), F.lit(6))
    item = (
        F.when(k == 0, F.concat(a, F.lit("-"), z)).when(k == 1, F.concat(a, F.lit(" ~ "), z, F.lit(",5")))
        .when(k == 2, F.concat(F.format_string("%d:%02d", F.floor(F.col("t") / 6).cast("long"), F.col("t") % 6 * 10), F.lit(" --> "), F.format_string("00:%02d:%02d,250", F.floor(F.col("t") / 6).cast("long"), F.col("t") % 6 * 10 + 4)))
        .when(k == 3, F.concat(a, F.lit("到"), z)).when(k == 4, F.concat(z, F.lit("-"), a)).otherwise(F.concat(F.lit("x"), a, F.lit("-"), z))
    )
    return rows.select("doc_id", "t", item.alias("item")).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", "item"))), lambda x: x["item"]), "\n").alias("raw"))
