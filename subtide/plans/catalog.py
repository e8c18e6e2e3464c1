"""Queries over the driver's tables, one per operator, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subtide.functions import text as T
from subtide.functions import timecode
from subtide.operators import admission, corrections, guards, hints, quality, ranges, recognition, timing
from subtide.plans import inputs as I
from subtide.plans import text_sql as S
from subtide.sources import audio, dictionaries, srt
from subtide.streaming import state
from subtide.streaming.folders import shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


def _ms(c: str):
    return F.rint(F.col(c) * 1000).cast("long").alias(c[:-2] + "_ms")


MS = "round_even({0} * 1000, 0)::BIGINT"
CHARS = r"length(regexp_replace({0}, '[\s\x0b]+', '', 'g'))"
CJK = "regexp_matches({0}, '[぀-ヿ㐀-鿿가-힯]')"

# --- parsing and writing -----------------------------------------------------------------------------------------


@query("cues", _with(I.CUES) + f"SELECT doc_id, pos, idx, {MS.format('start_s')} AS start_ms, {MS.format('end_s')} AS end_ms, length(text)::BIGINT AS n FROM cues")
def q_cues(spark: SparkSession, d: str) -> DataFrame:
    return I.cues(spark, d).select("doc_id", "pos", "idx", _ms("start_s"), _ms("end_s"), F.length("text").cast("long").alias("n"))


@query("srt_format_time", _with(I.CUES) + f"SELECT doc_id, pos, {I.TIME.format('start_s')} AS a, {I.TIME.format('end_s * 1000')} AS z FROM cues")
def q_format(spark, d):
    return I.cues(spark, d).select("doc_id", "pos", timecode.format_time(F.col("start_s")).alias("a"), timecode.format_time(F.col("end_s") * 1000).alias("z"))


@query("srt_serialize", _with(I.CUES, I.PLAIN, I.SRT) + "SELECT doc_id, srt_text FROM srt")
def q_serialize(spark, d):
    return I.srt_docs(spark, d)


@query("srt_parse_roundtrip", _with(I.CUES, I.PLAIN) + f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos))::INT AS idx, {MS.format('start_s')} AS start_ms, {MS.format('end_s')} AS end_ms, {I.STRIP.format('text')} AS text FROM plain")
def q_parse(spark, d):
    return srt.exploded(srt.parse(I.srt_docs(spark, d))).select("doc_id", "idx", _ms("start_s"), _ms("end_s"), "text")


@query("srt_parse_errors", _with(I.CUES, I.PLAIN, I.SRT) + "SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN CASE WHEN regexp_matches(srt_text, '^1\\n') THEN 'Block 1 has no time line' END WHEN 2 THEN CASE WHEN regexp_matches(srt_text, '^1\\n00:00:') THEN 'Invalid SRT time: 00:61:' || srt_text[9:14] END WHEN 3 THEN 'SRT indices are not consecutive' WHEN 4 THEN 'SRT text is empty' END AS parse_error FROM srt")
def q_errors(spark, d):
    return srt.parse(I.faulty_docs(spark, d)).select("doc_id", "parse_error")


@query("srt_parse_pages", "SELECT page_id AS doc_id, true AS failed, 0::BIGINT AS n_lenient FROM pages")
def q_pages(spark, d):
    pages = I.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("srt_text"))
    strict = srt.parse(pages).withColumn("failed", F.col("parse_error").isNotNull()).drop("cues", "parse_error")
    return srt.parse_lenient(strict).select("doc_id", "failed", F.size("cues").cast("long").alias("n_lenient"))


LENIENT = f"""WITH RECURSIVE {I.CUES}, {I.PLAIN}, r AS (SELECT doc_id, {MS.format('start_s')} + CASE WHEN doc_id % 5 = 2 AND n = 1 AND start_s < 60 THEN 3660000 ELSE 0 END AS a, {MS.format('end_s')} AS z, n
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM plain)),
g AS (SELECT doc_id, count(*)::BIGINT AS n, sum(z - a)::BIGINT AS total_ms FROM r WHERE z > a AND doc_id % 5 <> 4 AND NOT (doc_id % 5 = 1 AND n = 1) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n, coalesce(total_ms, 0)::BIGINT AS total_ms FROM (SELECT DISTINCT doc_id FROM plain) LEFT JOIN g USING (doc_id)"""


@query("srt_parse_lenient", LENIENT)
def q_lenient(spark, d):
    """Every faulty document; those whose cues are all passed over have none."""
    return _lenient(I.faulty_docs(spark, d))


def _lenient(docs: DataFrame) -> DataFrame:
    out = srt.exploded(srt.parse_lenient(docs)).withColumn("ms", F.rint(F.col("end_s") * 1000) - F.rint(F.col("start_s") * 1000))
    got = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("ms").cast("long").alias("total_ms"))
    return docs.select("doc_id").join(got, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("total_ms", F.lit(0)).cast("long").alias("total_ms"))


def _last(c: str):
    """The greatest value of a column in the conversation."""
    return F.max(c).over(W.partitionBy("doc_id"))


@query("segments_to_cues", _with(I.CUES) + f", m AS (SELECT *, max(end_s) OVER (PARTITION BY doc_id) + 0.5::DOUBLE AS most FROM cues), s AS (SELECT doc_id, pos, most, least(greatest(greatest(start_s, 0) + 0.5::DOUBLE, 2), most) AS a, least(greatest(greatest(end_s, 0) + 0.5::DOUBLE, 2), most) AS z, {I.STRIP.format('text')} AS text FROM m) SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INT AS idx, {MS.format('a')} AS start_ms, {MS.format('CASE WHEN z <= a THEN least(a + 0.2::DOUBLE, most) ELSE z END')} AS end_ms FROM s WHERE text <> '' AND (z > a OR a < most)")
def q_segments(spark, d):
    """Up to each conversation's own last end, moved by the offset as the segments are."""
    rows = srt.segments_to_cues(I.cues(spark, d).withColumn("most_s", _last("end_s") + 0.5), 0.5, 2.0, "most_s")
    return rows.select("doc_id", "pos", "idx", _ms("start_s"), _ms("end_s"))


@query("segments_to_srt", _with(I.CUES) + f", s AS (SELECT doc_id, pos, greatest(start_s, 0) AS a, greatest(end_s, 0) AS z, {I.STRIP.format('text')} AS text FROM cues), n AS (SELECT *, CASE WHEN z <= a THEN a + 0.2::DOUBLE ELSE z END AS e, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM s WHERE text <> '') SELECT doc_id, coalesce(string_agg(n || chr(10) || {I.TIME.format('a')} || ' --> ' || {I.TIME.format('e')} || chr(10) || n.text, chr(10) || chr(10) ORDER BY pos) || chr(10), '') AS srt_text FROM (SELECT DISTINCT doc_id FROM cues) LEFT JOIN n USING (doc_id) GROUP BY doc_id")
def q_segments_srt(spark, d):
    return recognition.segments_to_srt(I.cues(spark, d).withColumn("words", F.lit(None).cast("array<struct<start_s: double, end_s: double, word: string>>")))


def _recorded(spark, d):
    """Conversations as audio files that end with their last speech, their range lists, and their speech in the first piece."""
    files = I.speech(spark, d).groupBy("doc_id").agg(F.max("end_smp").alias("n_samples"))
    files = files.withColumn("language", F.element_at(F.array(*map(F.lit, ("zh", "mixed", "auto", "ja"))), (F.col("doc_id") % 4 + 1).cast("int")))
    listed = ranges.parse_ranges(I.range_lists(spark, d)).filter("error IS NULL AND doc_id % 3 != 0")
    listed = listed.withColumn("lang", F.when(F.col("line_no") % 3 == 0, "mixed").otherwise("ko"))
    return files, recognition.pieces(files, listed)


@query("recognition_pieces", _with(I.CUES) + """, f AS (SELECT doc_id, max(floor(greatest(end_s, 0) * 16000)::BIGINT) AS n, ['zh', 'mixed', 'auto', 'ja'][(doc_id % 4 + 1)::INT] AS language FROM cues GROUP BY doc_id),
l AS (SELECT conv_id AS doc_id, turn, (conv_id + turn) % 6 AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line_no FROM conversations),
g AS (SELECT l.doc_id, line_no, greatest(0, least(turn * 10.0::DOUBLE, n / 16000.0::DOUBLE)) AS a, greatest(0, least(turn * 10.0::DOUBLE + CASE k WHEN 1 THEN 4.5::DOUBLE WHEN 2 THEN 4.25::DOUBLE ELSE 4.0::DOUBLE END, n / 16000.0::DOUBLE)) AS z, CASE WHEN line_no % 3 = 0 THEN 'mixed' ELSE 'ko' END AS lang, language, n
  FROM l JOIN f USING (doc_id) WHERE k < 4 AND l.doc_id % 3 <> 0),
q AS (SELECT *, lag(z, 1, 0.0::DOUBLE) OVER w AS before, lead(a) OVER w AS next FROM g WHERE z - a >= 0.35::DOUBLE WINDOW w AS (PARTITION BY doc_id ORDER BY a, line_no)),
t AS (SELECT doc_id, before AS a, a AS z, language AS lang, n FROM q WHERE a > before UNION ALL SELECT doc_id, a, z, lang, n FROM q UNION ALL SELECT doc_id, z, n / 16000.0::DOUBLE, language, n FROM q WHERE next IS NULL AND z < n / 16000.0::DOUBLE),
p AS (SELECT doc_id, CASE WHEN lang = 'mixed' THEN 'mixed' ELSE 'target' END AS route, lang, a, floor(a * 16000)::BIGINT AS from_smp, least(n, floor(z * 16000)::BIGINT) AS to_smp FROM t)
SELECT doc_id, route, lang, round_even(a * 1000, 0)::BIGINT AS start_ms, from_smp, to_smp FROM p WHERE route = 'mixed' OR (to_smp - from_smp) / 16000.0::DOUBLE >= 0.35::DOUBLE
UNION ALL SELECT doc_id, CASE WHEN language = 'mixed' THEN 'mixed' ELSE 'whole' END, language, 0::BIGINT, 0::BIGINT, n FROM f WHERE doc_id NOT IN (SELECT doc_id FROM q)""")
def q_pieces(spark, d):
    """The range lists have a gap between any two ranges, so none are joined."""
    return _recorded(spark, d)[1].select("doc_id", "route", "lang", _ms("start_s"), "from_smp", "to_smp")


@query("recognition_windows")
def q_asked(spark, d):
    """What a professional recognition asks; the detector hears the conversation's speech in the first piece."""
    _, parts = _recorded(spark, d)
    first = parts.groupBy("doc_id").agg(F.min("piece").alias("piece"))
    asked = recognition.windows(parts, I.speech(spark, d).join(first, "doc_id"), True)
    return asked.select("doc_id", "piece", "win", "lang", "from_smp", "to_smp", _ms("offset_s"), "words", F.col("asked.beam_size").alias("beam_size"))


@query("words_of_segments", """WITH w AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS word, generate_subscripts(string_split(coalesce(text, ''), ' '), 1) - 1 AS pos FROM documents),
t AS (SELECT doc_id, pos, pos * 0.3::DOUBLE + floor(pos / 17) * 1.5::DOUBLE AS a, word FROM w WHERE word <> ''),
s AS (SELECT doc_id, floor(pos / 7) AS seg, max(a + 0.3::DOUBLE) AS z FROM t GROUP BY ALL),
u AS (SELECT doc_id, a + 0.3::DOUBLE AS z, true AS is_word FROM t WHERE doc_id % 3 <> 0 AND """ + S.strip("word") + """ <> '' UNION ALL SELECT doc_id, z, false FROM s WHERE doc_id % 3 = 0)
SELECT doc_id, count(*)::BIGINT AS n, bool_or(is_word) AS has_words, round_even(max(z) * 1000, 0)::BIGINT AS end_ms FROM u GROUP BY doc_id""")
def q_words(spark, d):
    """Segments of seven words, every third document without words."""
    w = I.words(spark, d).withColumn("seg", F.floor(F.col("pos") / 7))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "start_s", "end_s", "text"))), lambda x: F.struct(x["start_s"].alias("start_s"), x["end_s"].alias("end_s"), x["text"].alias("word")))
    seg = w.groupBy("doc_id", "seg").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), listed.alias("words"))
    seg = seg.select("doc_id", F.col("seg").alias("pos"), "start_s", "end_s", F.lit("segment").alias("text"), F.when(F.col("doc_id") % 3 != 0, F.col("words")).alias("words"))
    return srt.words_of(seg).groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("is_word").alias("has_words"), F.rint(F.max("end_s") * 1000).cast("long").alias("end_ms"))


# --- checks of cues --------------------------------------------------------------------------------------------


@query("cue_validate", _with(I.CUES) + "SELECT doc_id, CASE WHEN bool_or(end_s <= start_s) THEN 'Block ' || min(idx) FILTER (WHERE end_s <= start_s) || ' start time must be before end time' END AS error FROM cues GROUP BY doc_id")
def q_validate(spark, d):
    return srt.collected(I.cues(spark, d)).select("doc_id", srt.cue_errors(F.col("cues")).alias("error"))


ISSUES = f"""b AS (SELECT doc_id, pos, idx, start_s, end_s, end_s - start_s AS dur, {I.STRIP.format('text')} AS body,
  lag(start_s) OVER w AS ps, lag(end_s) OVER w AS pe FROM cues WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
l AS (SELECT *, string_split(body, chr(10)) AS lines, CASE WHEN {CJK.format('body')} THEN 12.0 ELSE 20.0 END::DOUBLE AS cps FROM b),
i AS (SELECT doc_id, pos, list_filter([
  CASE WHEN start_s < ps THEN 'starts before previous block' END,
  CASE WHEN start_s - pe < 0 THEN 'overlaps previous block' WHEN start_s - pe < 0.084::DOUBLE THEN 'gap is shorter than 0.084s' END,
  CASE WHEN dur < 0.5::DOUBLE THEN 'duration is shorter than 0.500s' END, CASE WHEN dur > 10 THEN 'duration is longer than 10.000s' END,
  CASE WHEN dur > 0 AND {CHARS.format('body')} / dur > cps THEN 'reading speed is above ' || printf('%.1f', cps) || ' CPS' END,
  CASE WHEN body <> '' AND len(lines) > 2 THEN 'has more than 2 subtitle lines' END,
  CASE WHEN regexp_matches(body, '[A-Za-z]{{2,}}\\n[A-Za-z]{{2,}}') THEN 'splits an ASCII word across lines' END] || flatten(list_transform(lines, lambda x: [
  CASE WHEN regexp_matches({I.STRIP.format('x')}, '^[{T.PUNCTUATION}]') THEN 'has punctuation at the start of a line' END,
  CASE WHEN {CHARS.format('x')} > CASE WHEN {CJK.format('x')} THEN 24 ELSE 42 END THEN 'line is longer than ' || CASE WHEN {CJK.format('x')} THEN 24 ELSE 42 END || ' chars' END])),
  lambda m: m IS NOT NULL) AS found, idx FROM l),
issues AS (SELECT doc_id, pos, unnest(generate_series(0, len(found) - 1))::INT AS ord, 'Block ' || idx || ' ' || unnest(found) AS issue FROM i WHERE len(found) > 0)"""


@query("cue_quality_issues", _with(I.CUES, ISSUES) + "SELECT doc_id, pos, ord, issue FROM issues")
def q_issues(spark, d):
    return quality.issues(I.cues(spark, d))


@query("cue_first_fault", _with(I.CUES, ISSUES) + "SELECT c.doc_id, coalesce(any_value(f), arg_min(issue, pos * 1000 + ord)) AS error FROM (SELECT DISTINCT doc_id FROM cues) c LEFT JOIN issues USING (doc_id) LEFT JOIN (SELECT doc_id, 'Block ' || min(idx) || ' start time must be before end time' AS f FROM cues WHERE end_s <= start_s GROUP BY doc_id) v USING (doc_id) GROUP BY c.doc_id")
def q_first(spark, d):
    return quality.first_fault(I.cues(spark, d))


@query("cue_metrics", _with(I.CUES) + f"SELECT doc_id, pos, {CHARS.format('text')}::BIGINT AS chars, {CJK.format('text')} AS cjk, CASE WHEN {CJK.format('text')} THEN 21 ELSE 42 END::BIGINT AS line_limit, CASE WHEN {CJK.format('text')} THEN 9.0 ELSE 17.0 END::DOUBLE AS cps_limit FROM cues")
def q_metrics(spark, d):
    return quality.metrics(I.cues(spark, d))


@query("cue_boundaries", _with(I.CUES) + r"""SELECT doc_id, pos, regexp_matches(text, '[。．！？!?…]+["''」』）\])]*\s*$') AS sentence_end, regexp_matches(text, '[、，,;；:：]+["''」』）\])]*\s*$') AS soft, regexp_matches(text, '[。．！？!?…、，,;；:：]+["''」』）\])]*\s*$') OR (""" + CJK.format("text") + r""" AND regexp_matches(text, '(了|嘛|吗|呢|吧|啊|哦|啦|咯|对|没错)\s*$')) AS natural_cut FROM cues""")
def q_boundaries(spark, d):
    t = F.col("text")
    return I.cues(spark, d).select("doc_id", "pos", T.sentence_end(t).alias("sentence_end"), T.soft_boundary(t).alias("soft"), T.natural_cut(t).alias("natural_cut"))


# --- cleaning --------------------------------------------------------------------------------------------------


@query("text_flatten", _with(I.CUES) + f"SELECT doc_id, pos, {S.flatten('text')} AS flat FROM cues")
def q_flatten(spark, d):
    return I.cues(spark, d).select("doc_id", "pos", T.flatten(F.col("text")).alias("flat"))


FORMAT = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(\d+)\s*[%％]\s*(ページ|頁)', '\1\2', 'g'), '第\s*(\d+)\s*課', '第\1課', 'g'), '第\s+(\d+)', '第\1', 'g'), '(\d+)\s+(ページ|頁|課|番)', '\1\2', 'g'), '\s+([、。，．！？!?])', '\1', 'g')"


@query("text_format_rules", _with(I.CUES) + f"SELECT doc_id, pos, {FORMAT.format('text')} AS text FROM cues")
def q_format_rules(spark, d):
    t = F.col("text")
    for rule in T.format_rules():
        t = rule(t)
    return I.cues(spark, d).select("doc_id", "pos", t.alias("text"))


@query("text_chinese_punctuation", _with(I.CUES) + f", f AS (SELECT doc_id, pos, {S.flatten('text')} AS flat FROM cues) SELECT doc_id, pos, {S.chinese_punctuation('flat')} AS text FROM f")
def q_chinese(spark, d):
    return I.cues(spark, d).select("doc_id", "pos", T.chinese_punctuation(T.flatten(F.col("text"))).alias("text"))


@query("text_join", _with(I.CUES) + f", f AS (SELECT doc_id, pos, {S.flatten('text')} AS flat FROM cues) SELECT x.doc_id, x.pos, {S.joined('x.flat', 'y.flat')} AS text, {S.page('x.flat', 'y.flat')} AS page FROM f x JOIN f y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1")
def q_join(spark, d):
    c = I.cues(spark, d).select("doc_id", "pos", "text")
    after = c.select("doc_id", (F.col("pos") - 1).alias("pos"), F.col("text").alias("next"))
    return c.join(after, ["doc_id", "pos"]).select("doc_id", "pos", T.joined(F.col("text"), F.col("next")).alias("text"), T.page_fragment(F.col("text"), F.col("next")).alias("page"))


CLEAN = ("zh", True, ["Language Reactor"])


@query("clean_text", _with(I.CUES) + f", c AS ({S.cleaned('cues', 'text', *CLEAN)}) SELECT doc_id, pos, {S.last(*CLEAN)} AS clean_text, len({S.changes(*CLEAN)})::BIGINT AS n_changes FROM c")
def q_clean(spark, d):
    return corrections.clean_cues(I.cues(spark, d), *CLEAN).select("doc_id", "pos", "clean_text", F.size("changes").cast("long").alias("n_changes"))


@query("clean_changes", _with(I.CUES) + f", c AS ({S.cleaned('cues', 'text', 'zh', True)}), l AS (SELECT doc_id, pos, {S.changes('zh', True)} AS log FROM c), u AS (SELECT doc_id, pos, unnest(log) AS c, generate_subscripts(log, 1) - 1 AS ord FROM l) SELECT doc_id, pos, ord::INT AS ord, c.before AS before, c.after AS after, c.type AS type FROM u")
def q_changes(spark, d):
    rows = corrections.clean_cues(I.cues(spark, d), "zh", True)
    return rows.select("doc_id", "pos", F.posexplode("changes").alias("ord", "c")).select("doc_id", "pos", "ord", "c.before", "c.after", "c.type")


@query("change_counts", _with(I.CUES) + "SELECT * FROM (SELECT 'term_replacement' AS type, sum(contains(text, 'PatternDrill')::INT + contains(text, 'Chat GPT')::INT)::BIGINT AS n FROM plain UNION ALL SELECT 'format_normalization', sum((k = 4)::INT + (k = 7)::INT * 1)::BIGINT FROM plain)".replace("FROM plain", "FROM (SELECT * FROM cues WHERE trim(text) <> '')"))
def q_counts(spark, d):
    return corrections.count_changes(corrections.clean_documents(I.srt_docs(spark, d), language="ja"))


CLEANED = f"""cl AS ({S.cleaned('plain', 'text', 'zh', True)}),
cb AS (SELECT doc_id, pos, start_s, end_s, {S.last('zh', True)} AS body, len({S.changes('zh', True)}) AS n_changes, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM cl),
cd AS (SELECT doc_id, bool_or(body = '') AS bad, sum(n_changes)::BIGINT AS n_changes, string_agg(n || chr(10) || {I.TIME.format('start_s')} || ' --> ' || {I.TIME.format('end_s')} || chr(10) || body, chr(10) || chr(10) ORDER BY pos) || chr(10) AS clean FROM cb GROUP BY doc_id),
cf AS (SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN regexp_replace(srt_text, '^(1\\n[^\\n]*)-->', '\\1 to ') WHEN 2 THEN regexp_replace(srt_text, '^1\n00:00:', '1' || chr(10) || '00:61:') WHEN 3 THEN '7' || substr(srt_text, 2) WHEN 4 THEN ' ' || chr(10) || ' ' ELSE srt_text END AS raw, srt_text FROM srt)"""


@query("clean_documents", _with(I.CUES, I.PLAIN, I.SRT, CLEANED) + "SELECT doc_id, CASE WHEN raw = srt_text AND NOT bad THEN clean ELSE raw END AS clean_srt, CASE WHEN raw = srt_text AND NOT bad THEN n_changes ELSE 1 END::BIGINT AS n_changes FROM cf JOIN cd USING (doc_id)")
def q_documents(spark, d):
    return corrections.clean_documents(I.faulty_docs(spark, d), language="zh", contextual=True).select("doc_id", "clean_srt", F.size("changes").cast("long").alias("n_changes"))


@query("generated_terms", "SELECT * FROM (VALUES ('Honestly,Ithink', 'Honestly, I think'), ('LanguageReactor', 'Language Reactor')) t(before, after)")
def q_terms(spark, d):
    rules = dictionaries.load_corrections("en", ["Language  Reactor"])
    terms = spark.createDataFrame([(n, t) for n, t in enumerate(rules.terms)], "ord int, after string").withColumn("before", F.regexp_replace("after", r"(?U)\s+", ""))
    known = spark.createDataFrame(list(dictionaries.SHARED["term_replacements"].items()), "before string, by string")
    return terms.filter("before != after").join(known, "before", "left_anti").select("before", "after")


# --- hints ------------------------------------------------------------------------------------------------------

VALUES = lambda rows: ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
HINTED = "t AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY pos) AS text FROM cues GROUP BY doc_id), h(ord, wrong, suggest, lang) AS (VALUES " + VALUES((n, *h[:3]) for n, h in enumerate(dictionaries.HINTS)) + "), m AS (SELECT doc_id, ord, wrong, suggest FROM t JOIN h ON contains(text, wrong) AND lang IN ('any', 'zh'))"


def _texts(spark, d):
    return I.cues(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))


@query("hint_matches", _with(I.CUES, HINTED) + "SELECT doc_id, ord, wrong, suggest FROM m")
def q_hints(spark, d):
    return hints.hint_matches(_texts(spark, d), "zh")


@query("protected_terms", _with(I.CUES, HINTED) + ", p(ord, term) AS (VALUES " + VALUES(enumerate(dictionaries.PROTECTED_TERMS)) + ") SELECT DISTINCT doc_id, p.ord, term FROM (SELECT doc_id, text FROM t) t JOIN p ON contains(text, term) OR EXISTS (SELECT 1 FROM m WHERE m.doc_id = t.doc_id AND m.suggest = p.term)")
def q_protected(spark, d):
    return hints.protected_terms(_texts(spark, d), "zh")


@query("numeric_rules", "SELECT * FROM (VALUES ('preserve_arabic_digits', true), ('do_not_convert_digits_to_kanji', true), ('do_not_convert_half_width_to_full_width', true)) t(rule, is_on)")
def q_rules(spark, d):
    return spark.createDataFrame(list(hints.numeric_rules().items()), "rule string, is_on boolean")


@query("prompts")
def q_prompts(spark, d):
    return hints.prompts(srt.parse(I.srt_docs(spark, d)).filter("cues is not null"), "zh").select("doc_id", F.length("prompt").cast("long").alias("n"), F.sha2("prompt", 256).alias("sha"))


# --- guards of machine corrections ------------------------------------------------------------------------------


@query("script_counts", _with(I.CUES) + "SELECT doc_id, pos, len(regexp_extract_all(text, '[가-힯]'))::BIGINT AS hangul, len(regexp_extract_all(text, '[぀-ヿ]'))::BIGINT AS kana, array_to_string(regexp_extract_all(text, '[0-9]+(?:[.,:/-][0-9]+)*'), ' ') AS numbers FROM cues")
def q_scripts(spark, d):
    t = F.col("text")
    return I.cues(spark, d).select("doc_id", "pos", T.hangul(t).cast("long").alias("hangul"), T.kana(t).cast("long").alias("kana"), F.array_join(T.numeric_tokens(t), " ").alias("numbers"))


@query("max_clean_length", "SELECT n, CASE WHEN n <= 20 THEN ceil(greatest(n * 1.6::DOUBLE, n + 8)) ELSE ceil(n * 1.35::DOUBLE) END::BIGINT AS most FROM (SELECT DISTINCT n_chars AS n FROM documents)")
def q_length(spark, d):
    return I.table(spark, d, "documents").select(F.col("n_chars").alias("n")).distinct().select("n", guards.max_length(F.col("n")).cast("long").alias("most"))


@query("guard_errors", _with(I.CUES) + """, g AS (SELECT doc_id, pos, text AS old, CASE pos % 8 WHEN 0 THEN text WHEN 1 THEN '' WHEN 2 THEN text || ' 7' WHEN 3 THEN '``` ' || text WHEN 4 THEN '00:00:01,000 --> x' WHEN 5 THEN text || text WHEN 6 THEN left(text, 3) ELSE 'Thought for a second' END AS new FROM cues WHERE trim(text) <> ''),
e AS (SELECT *, length(""" + I.STRIP.format("old") + """) AS n, length(new) AS m, regexp_extract_all(old, '[0-9]+(?:[.,:/-][0-9]+)*') AS a, regexp_extract_all(new, '[0-9]+(?:[.,:/-][0-9]+)*') AS b FROM g)
SELECT doc_id, pos, CASE WHEN new = '' THEN 'AI clean_text was empty.' WHEN contains(new, 'Thought for') THEN 'AI response contained thinking output marker: Thought for.' WHEN contains(new, '```') THEN 'AI clean_text contained markdown code fences.' WHEN contains(new, '-->') THEN 'AI clean_text contained an SRT timestamp separator.' WHEN a <> b THEN 'AI clean_text changed numeric tokens.'
  WHEN len(regexp_extract_all(old, '[぀-ヿ]')) >= 2 AND NOT regexp_matches(new, '[぀-ヿ]') THEN 'AI clean_text removed Japanese kana, likely translating or changing script.'
  WHEN m > CASE WHEN n <= 20 THEN ceil(greatest(n * 1.6::DOUBLE, n + 8)) ELSE ceil(n * 1.35::DOUBLE) END THEN 'AI clean_text was excessively longer than the rule-based text.' WHEN n > 4 AND m < n * 0.5 THEN 'AI clean_text was excessively shorter than the rule-based text.' END AS error FROM e""")
def q_guards(spark, d):
    c, t = I.cues(spark, d).filter("trim(text) != ''"), F.col("text")
    k = F.col("pos") % 8
    new = F.when(k == 0, t).when(k == 1, "").when(k == 2, F.concat(t, F.lit(" 7"))).when(k == 3, F.concat(F.lit("``` "), t)).when(k == 4, "00:00:01,000 --> x").when(k == 5, F.concat(t, t)).when(k == 6, F.substring(t, 1, 3)).otherwise("Thought for a second")
    return c.withColumn("new", new).select("doc_id", "pos", guards.text_error(F.col("new"), t).alias("error"))


@query("ai_responses")
def q_ai(spark, d):
    """Responses made by rule: right, a changed digit, one item too few, no JSON, true as an index, disabled, failed."""
    docs = corrections.clean_documents(I.srt_docs(spark, d), language="zh")
    parsed = srt.parse(docs, "clean_srt")
    k = F.col("doc_id") % 7
    item = lambda c, idx, text: F.struct(idx.alias("index"), text.alias("clean_text"))
    good = F.to_json(F.struct(F.transform("cues", lambda c: item(c, c["idx"], F.replace(c["text"], F.lit("the"), F.lit("The")))).alias("items")))
    digit = F.to_json(F.transform("cues", lambda c: item(c, c["idx"], F.when(c["idx"] == 1, F.concat(c["text"], F.lit(" 9"))).otherwise(c["text"]))))
    short = F.to_json(F.transform(F.slice("cues", 2, 1000), lambda c: item(c, c["idx"], c["text"])))
    flag = F.to_json(F.transform("cues", lambda c: item(c, F.lit(True), c["text"])))
    response = F.when(k == 0, good).when(k == 1, digit).when(k == 2, short).when(k == 3, "[1] x").when(k == 4, flag).otherwise(good)
    docs = parsed.withColumns({"ai_response": response, "ai_enabled": k != 5, "ai_error": F.when(k == 6, "AI clean provider timed out")}).drop("cues", "parse_error")
    return guards.apply_responses(docs).select("doc_id", "ai_used", "reason", F.size("changes").cast("long").alias("n_changes"), F.sha2("final_srt", 256).alias("sha"))


# --- timing ------------------------------------------------------------------------------------------------------


@query("target_ends", _with(I.CUES) + f", r AS (SELECT *, lead(start_s) OVER (PARTITION BY doc_id ORDER BY start_s, pos) - 0.084::DOUBLE AS lim, greatest(start_s, 0) AS a, {CHARS.format('text')} AS n, CASE WHEN {CJK.format('text')} THEN 9.0 ELSE 17.0 END::DOUBLE AS cps FROM cues), z AS (SELECT *, greatest(end_s, a + 0.2::DOUBLE) AS z FROM r WHERE n > 0), w AS (SELECT *, a + least(greatest(z - a, 1.0::DOUBLE, n / cps), 7.0::DOUBLE) AS want FROM z) SELECT doc_id, pos, round(a, 3) AS start_s, round(CASE WHEN lim IS NULL OR want <= lim THEN want WHEN lim > a + 0.5::DOUBLE THEN lim ELSE greatest(z, a + 0.2::DOUBLE) END, 3) AS target_end FROM w")
def q_targets(spark, d):
    return timing.target_ends(I.cues(spark, d)).select("doc_id", "pos", F.round("start_s", 3).alias("start_s"), F.round("target_end", 3).alias("target_end"))


STEPS = """o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_s, pos) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM cues),
f(doc_id, n, a, z, text, carry) AS (SELECT doc_id, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, '', NULL::DOUBLE FROM (SELECT DISTINCT doc_id FROM cues) UNION ALL
 SELECT doc_id, n, a, CASE WHEN z - a < 0.7::DOUBLE AND (b IS NULL OR a + 0.7::DOUBLE <= b) THEN a + 0.7::DOUBLE ELSE z END, text, b FROM (
  SELECT doc_id, n, a, CASE WHEN b0 IS NOT NULL AND z > b0 AND b0 > a THEN b0 ELSE z END AS z, text, CASE WHEN b0 IS NOT NULL AND z > b0 AND b0 <= a THEN z + 0.02::DOUBLE ELSE b0 END AS b FROM (
   SELECT o.doc_id, o.n, coalesce(f.carry, o.start_s) AS a, CASE WHEN o.end_s <= coalesce(f.carry, o.start_s) THEN coalesce(f.carry, o.start_s) + 0.2::DOUBLE ELSE o.end_s END AS z, o.text, x.start_s AS b0
   FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.n + 1 LEFT JOIN o x ON x.doc_id = o.doc_id AND x.n = o.n + 1)))"""


@query("fix_timings", _with(I.CUES, STEPS) + f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::BIGINT AS pos, {MS.format('a')} AS start_ms, {MS.format('z')} AS end_ms FROM f WHERE n > 0 AND trim(text) <> '' AND z > a")
def q_fix(spark, d):
    return timing.fix_timings(I.cues(spark, d)).select("doc_id", "pos", _ms("start_s"), _ms("end_s"))


def _timed(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "pos", _ms("start_s"), _ms("end_s"), "text")


MERGE = f"""o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, start_s AS a, end_s AS z, text, {S.flatten('text')} AS flat FROM cues),
f(doc_id, n, a, z, text, flat, run) AS (SELECT doc_id, n, a, z, text, flat, 0 FROM o WHERE n = 1 UNION ALL
 SELECT doc_id, n, CASE WHEN j THEN pa ELSE a END, CASE WHEN j THEN greatest(pz, z) ELSE z END, CASE WHEN j THEN pair ELSE text END, CASE WHEN j THEN {S.flatten('pair')} ELSE flat END, CASE WHEN j THEN run ELSE run + 1 END FROM (
  SELECT *, nb <= 50 AND ((pg AND gap <= 1.2::DOUBLE) OR (gap <= 0.25::DOUBLE AND greatest(pz, z) - pa <= 7 AND nb <= CASE WHEN {CJK.format('pair')} THEN 42 ELSE 84 END AND NOT {S.has(S.strip('ptext'), T.SENTENCE_END)})
    OR (gap <= 0.35::DOUBLE AND (pz - pa < 0.9::DOUBLE OR z - a < 0.9::DOUBLE OR {S.chars('ptext')} <= 4 OR {S.chars('text')} <= 4)) OR (pz - pa < 0.6::DOUBLE AND gap <= 0.8::DOUBLE)) AS j FROM (
   SELECT *, {S.chars('pair')} AS nb FROM (SELECT o.doc_id, o.n, o.a, o.z, o.text, o.flat, f.a AS pa, f.z AS pz, f.text AS ptext, f.run, greatest(0, o.a - f.z) AS gap, {S.page('f.flat', 'o.flat')} AS pg, {S.joined('f.flat', 'o.flat')} AS pair FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.n + 1))))"""


@query("merge_short", _with(I.CUES, MERGE) + f"SELECT doc_id, run::BIGINT AS pos, {MS.format('min(a)')} AS start_ms, {MS.format('arg_max(z, n)')} AS end_ms, arg_max(text, n) AS text FROM f GROUP BY doc_id, run")
def q_merge(spark, d):
    return _timed(timing.merge_short(I.cues(spark, d)))


@query("split_long")
def q_split(spark, d):
    return _timed(timing.split_long(I.cues(spark, d)))


STANDARD = f"""c0 AS ({S.cleaned('cues', 'text', 'zh')}),
c1 AS (SELECT doc_id, row_number() OVER w AS pos, {S.last('zh')} AS text, lead(start_s) OVER w - 0.084::DOUBLE AS lim, greatest(start_s, 0) AS a, end_s FROM c0 WINDOW w AS (PARTITION BY doc_id ORDER BY start_s, pos)),
c2 AS (SELECT *, greatest(end_s, a + 0.2::DOUBLE) AS z, {S.chars('text')} / CASE WHEN {CJK.format('text')} THEN 9.0::DOUBLE ELSE 17.0::DOUBLE END AS read_s FROM c1 WHERE text <> ''),
c3 AS (SELECT *, a + least(greatest(z - a, 1.0::DOUBLE, read_s), 7.0::DOUBLE) AS want FROM c2),
std AS (SELECT doc_id, pos, a AS start_s, CASE WHEN lim IS NULL OR want <= lim THEN want WHEN lim > a + 0.5::DOUBLE THEN lim ELSE greatest(z, a + 0.2::DOUBLE) END AS end_s, text FROM c3)"""


@query("industry_standard", _with(I.CUES, STANDARD, STEPS.replace("FROM cues", "FROM std")) + f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::BIGINT AS pos, {MS.format('a')} AS start_ms, {MS.format('z')} AS end_ms, text FROM f WHERE n > 0 AND trim(text) <> '' AND z > a")
def q_standard(spark, d):
    return _timed(timing.industry_standard(I.cues(spark, d), "zh"))


@query("segment_words")
def q_segment(spark, d):
    return _timed(timing.segment_words(I.words(spark, d)))


@query("wrap_text")
def q_wrap(spark, d):
    return timing.wrap_texts(I.cues(spark, d).select("doc_id", "pos", T.flatten(F.col("text")).alias("text"))).select("doc_id", "pos", "wrapped")


@query("optimize_documents")
def q_optimize(spark, d):
    return timing.optimize_documents(I.srt_docs(spark, d), language="zh").select("doc_id", "optimized")


# --- ranges and speech ------------------------------------------------------------------------------------------


@query("range_parse", "SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS line_no, CASE WHEN k IN (4, 5) THEN NULL ELSE turn * 10000 END::BIGINT AS start_ms, CASE k WHEN 1 THEN turn * 10000 + 4500 WHEN 2 THEN turn * 10000 + 4250 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE turn * 10000 + 4000 END::BIGINT AS end_ms, CASE k WHEN 4 THEN 'end is not after start' WHEN 5 THEN 'invalid time value' END AS error FROM (SELECT *, (conv_id + turn) % 6 AS k FROM conversations)")
def q_ranges(spark, d):
    rows = ranges.parse_ranges(I.range_lists(spark, d))
    good = F.col("error").isNull()
    return rows.select("doc_id", "line_no", F.when(good, F.rint(F.col("start_s") * 1000)).cast("long").alias("start_ms"), F.when(good, F.rint(F.col("end_s") * 1000)).cast("long").alias("end_ms"), "error")


@query("range_overlap", _with(I.CUES) + "SELECT doc_id, bool_or(coalesce(start_s < e, false)) AS overlaps FROM (SELECT *, lag(end_s) OVER (PARTITION BY doc_id ORDER BY start_s, pos) AS e FROM cues) GROUP BY doc_id")
def q_overlap(spark, d):
    return ranges.overlapping(I.cues(spark, d).withColumnRenamed("pos", "line_no"))


def _ranges(spark, d):
    """The time line ends with the conversation."""
    c = I.plain_cues(spark, d).withColumn("end_s", F.when(F.col("k") == 5, F.col("start_s") + 4).otherwise(F.col("end_s"))).withColumn("total_s", _last("end_s"))
    return c.filter("k != 3").select("doc_id", F.col("pos").alias("line_no"), "start_s", "end_s", F.when(F.col("pos") % 3 == 0, "ja").otherwise("ko").alias("lang"), "total_s")


TILES = """e AS (SELECT doc_id, pos, start_s AS a, CASE WHEN k = 5 THEN start_s + 4 ELSE end_s END AS z, CASE WHEN pos % 3 = 0 THEN 'ja' ELSE 'ko' END AS lang, k FROM plain),
r AS (SELECT * FROM (SELECT *, max(z) OVER (PARTITION BY doc_id) AS total FROM e) WHERE k <> 3),
g AS (SELECT *, coalesce(a > lag(z) OVER w OR lang <> lag(lang) OVER w, true)::INT AS new FROM r WHERE z - a >= 0.35::DOUBLE WINDOW w AS (PARTITION BY doc_id ORDER BY a, pos)),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a, pos) AS run FROM g), n AS (SELECT doc_id, min(a) AS a, max(z) AS z, any_value(lang) AS lang, any_value(total) AS total FROM s GROUP BY doc_id, run),
q AS (SELECT *, coalesce(lag(z) OVER w, 0) AS before, lead(a) OVER w AS next FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY a))"""


@query("timeline_tiling", _with(I.CUES, I.PLAIN, TILES) + f"SELECT doc_id, {MS.format('a')} AS start_ms, {MS.format('z')} AS end_ms, lang FROM (SELECT doc_id, before AS a, a AS z, 'zh' AS lang FROM q WHERE a > before UNION ALL SELECT doc_id, a, z, lang FROM q UNION ALL SELECT doc_id, z, total, 'zh' FROM q WHERE next IS NULL AND z < total)")
def q_tiles(spark, d):
    return ranges.tiled(ranges.normalized(_ranges(spark, d)), "zh").select("doc_id", _ms("start_s"), _ms("end_s"), "lang")


@query("merge_speech", _with(I.CUES) + """, v AS (SELECT doc_id, (greatest(start_s, 0) * 16000)::DOUBLE AS a0, pos, floor(greatest(start_s, 0) * 16000)::BIGINT AS a, floor(greatest(end_s, 0) * 16000)::BIGINT AS z FROM cues),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM v WHERE z > a),
f(doc_id, n, a, z, run) AS (SELECT doc_id, n, a, z, 0 FROM o WHERE n = 1 UNION ALL SELECT doc_id, n, CASE WHEN j THEN pa ELSE a END, CASE WHEN j THEN greatest(pz, z) ELSE z END, CASE WHEN j THEN run ELSE run + 1 END FROM (
  SELECT o.doc_id, o.n, o.a, o.z, f.a AS pa, f.z AS pz, f.run, (o.z - f.a) / 16000.0::DOUBLE <= 30 AND ((o.a - f.z) / 16000.0::DOUBLE <= 0.65::DOUBLE OR ((o.a - f.z) / 16000.0::DOUBLE <= 1.2::DOUBLE AND least((f.z - f.a) / 16000.0::DOUBLE, (o.z - o.a) / 16000.0::DOUBLE) < 1.2::DOUBLE)) AS j FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.n + 1))
SELECT doc_id, run::BIGINT AS pos, min(a)::BIGINT AS start_smp, max(z)::BIGINT AS end_smp FROM f GROUP BY doc_id, run""")
def q_speech(spark, d):
    return ranges.merge_speech(I.speech(spark, d))


@query("speech_windows", _with(I.CUES) + """, v AS (SELECT doc_id, pos, floor(greatest(start_s, 0) * 16000)::BIGINT AS a, floor(greatest(end_s, 0) * 16000)::BIGINT AS z FROM cues),
m AS (SELECT *, max(z) OVER (PARTITION BY doc_id) AS n FROM v)
SELECT doc_id, pos, greatest(0, a - 6400)::BIGINT AS from_smp, least(n, z + 6400)::BIGINT AS to_smp FROM m WHERE z > a AND least(n, z + 6400) - greatest(0, a - 6400) >= 5600""")
def q_windows(spark, d):
    """The audio ends with the last speech of the conversation."""
    rows = ranges.padded(I.speech(spark, d).withColumn("n_samples", _last("end_smp")))
    return rows.select("doc_id", "pos", F.col("from_smp").cast("long").alias("from_smp"), F.col("to_smp").cast("long").alias("to_smp"))


# --- admission and jobs -------------------------------------------------------------------------------------------

LOG = """h AS (SELECT user_id AS client, event_id AS hit_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f(client, n, held, hit_id, t_us, accepted) AS (SELECT client, 0::BIGINT, []::BIGINT[], 0::BIGINT, 0::BIGINT, false FROM (SELECT DISTINCT client FROM h) UNION ALL
 SELECT client, n, CASE WHEN len(kept) >= 5 THEN kept ELSE list_append(kept, t) END, hit_id, t, len(kept) < 5 FROM (SELECT h.client, h.n, h.hit_id, h.t, list_filter(f.held, lambda x: h.t - x <= 86400000000) AS kept FROM f JOIN h ON h.client = f.client AND h.n = f.n + 1))"""


@query("rate_limit_admission", _with(LOG) + "SELECT client, hit_id, t_us, accepted FROM f WHERE n > 0")
def q_admission(spark, d):
    return admission.admissions(I.hits(spark, d), 5, 86400)


@query("client_keys", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '10.0.0.' || user_id WHEN 1 THEN 'h' || user_id WHEN 2 THEN 'unknown' ELSE 'p' || user_id END AS client FROM events")
def q_keys(spark, d):
    e, u = I.table(spark, d, "events"), F.col("user_id").cast("string")
    k = F.col("event_id") % 4
    forwarded = F.when(k == 0, F.concat(F.lit(" 10.0.0."), u, F.lit(" , 10.1.1.1"))).when(k == 3, F.concat(F.lit("p"), u))
    host = F.when(k == 1, F.concat(F.lit("h"), u)).when(k == 3, "unused")
    return e.select("event_id", admission.client_key(forwarded, host).alias("client"))


JOBS = "j AS (SELECT event_id AS job_id, ['running', 'done', 'error'][(event_id % 3 + 1)::INT] AS status, epoch_us(ts) / 1000000.0::DOUBLE AS c, epoch_us(ts) / 1000000.0::DOUBLE + event_id % 1000 AS u FROM events), mid AS (SELECT (min(c) + max(c)) / 2 AS now FROM j)"


def _jobs_now(spark, d):
    rows = I.jobs(spark, d)
    now = rows.agg(((F.min("created_at") + F.max("created_at")) / 2).alias("now"))
    return rows.crossJoin(F.broadcast(now))


@query("job_sweep", _with(JOBS) + "SELECT job_id, CASE WHEN status = 'running' AND now - c > 2100 THEN 'error' ELSE status END AS status, round(CASE WHEN status = 'running' AND now - c > 2100 THEN now ELSE u END, 3) AS updated_at, CASE WHEN status = 'running' AND now - c > 2100 THEN 'Transcription timed out. Try a shorter audio file.' ELSE '' END AS error FROM j, mid WHERE NOT (status IN ('done', 'error') AND now - u > 3600)")
def q_sweep(spark, d):
    return admission.sweep(_jobs_now(spark, d), F.col("now")).select("job_id", "status", F.round("updated_at", 3).alias("updated_at"), "error")


@query("job_complete", "SELECT status, error, count(*)::BIGINT AS n FROM (SELECT CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN CASE WHEN event_id % 4 = 0 THEN 'error' ELSE 'done' END ELSE ['running', 'done', 'error'][(event_id % 3 + 1)::INT] END AS status, CASE WHEN event_id % 3 = 0 AND event_id % 4 = 0 THEN 'Transcription failed. Check server logs.' ELSE '' END AS error FROM events) GROUP BY ALL")
def q_complete(spark, d):
    jobs = _jobs_now(spark, d)
    results = jobs.filter("job_id % 2 = 0").select("job_id", F.lit("text").alias("srt_text"), (F.col("job_id") % 4 == 0).alias("failed"))
    return admission.complete(jobs, results, F.col("now")).groupBy("status", "error").agg(F.count("*").alias("n"))


@query("job_lookup", "SELECT (event_id * 2)::BIGINT AS job_id, CASE WHEN event_id * 2 NOT IN (SELECT event_id FROM events) THEN 404 ELSE [409, 200, 500][(event_id * 2 % 3 + 1)::INT] END AS code FROM events")
def q_lookup(spark, d):
    return admission.lookup(I.jobs(spark, d), I.table(spark, d, "events").select((F.col("event_id") * 2).alias("job_id")))


def _run_stream(spark: SparkSession, df: DataFrame) -> DataFrame:
    """All of a stream's output, through a Parquet sink in the shared folder."""
    base = shared_dir(spark)
    out = f"{base}/stream-{uuid.uuid4().hex}"
    df.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = I.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


@query("rate_limit_stream", _with(LOG) + "SELECT client, hit_id, t_us, accepted FROM f WHERE n > 0")
def q_stream(spark, d):
    rows = _event_stream(spark, d).select(F.col("user_id").alias("client"), F.col("event_id").alias("hit_id"), "ts", F.unix_micros("ts").alias("t_us"))
    return _run_stream(spark, state.admissions_stream(rows.withWatermark("ts", "1 hour"), 5, 86400))


@query("job_stream")
def q_job_stream(spark, d):
    rows = _event_stream(spark, d).select((F.col("event_id") % 997).alias("job_id"), "ts", (F.unix_micros("ts") / 1e6).alias("t_s"), F.element_at(F.array(*map(F.lit, ("start", "finish", "fail"))), (F.col("event_id") % 3 + 1).cast("int")).alias("kind"), F.lit("").alias("srt_text"))
    return _run_stream(spark, state.job_states(rows.withWatermark("ts", "1 hour"))).groupBy("status").agg(F.count("*").alias("n"))


# --- audio files ----------------------------------------------------------------------------------------------

HEADERS = ["49443304", "FFFB9000", "FF1F0000", "664C6143", "4F676753", "1A45DFA3", "52494646000000005741564500", "524946460000000041564920", "000000206674797000000000", "00", ""]


@query("audio_headers", "SELECT event_id, CASE WHEN event_id % 11 = 10 THEN 'Uploaded file is empty' WHEN event_id % 11 IN (2, 7, 9) THEN 'Unsupported or invalid audio file' END AS error FROM events")
def q_headers(spark, d):
    header = F.unhex(F.element_at(F.array(*map(F.lit, HEADERS)), (F.col("event_id") % 11 + 1).cast("int")))
    return I.table(spark, d, "events").select("event_id", audio.header_error(header).alias("error"))


@query("audio_extensions", "SELECT event_id, event_id % 4 < 2 AS allowed FROM events")
def q_extensions(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("a/b.c.MP3", "x.wav", ".mp3", "noext"))), (F.col("event_id") % 4 + 1).cast("int"))
    return I.table(spark, d, "events").select("event_id", audio.extension_allowed(name).alias("allowed"))


@query("string_maps", "SELECT * FROM (VALUES ('a', 'b')) t(before, after)")
def q_maps(spark, d):
    payload = json.loads('{"safe_replacements": {"a": "b", "": "x", "n": 1}, "terms": "no list"}')
    return spark.createDataFrame(list(dictionaries.merged(payload).safe.items()), "before string, after string")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
