import random

from pyspark.sql import functions as F

from subtide.functions import kernels as K
from subtide.functions import text as T
from subtide.functions import timecode
from subtide.operators import corrections, guards, quality, ranges, timing
from subtide.sources import audio, dictionaries, srt


def one(spark, value, *cols):
    return spark.createDataFrame([(value,)], "t string").select(*cols).first()


def cleaned(spark, text, language="zh", contextual=False, terms=None):
    rows = spark.createDataFrame([(1, text)], "idx int, text string")
    return corrections.clean_cues(rows, language, contextual, terms).first()["clean_text"]


def test_flatten_native_equals_kernel(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab1 \n\n,。一吗(」　.?-!\ue000\ue001\x1c\U0001f600") for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    # white space runs of any length, with breaks in them
    for _ in range(300):
        gap = "".join(rng.choice(["　" * rng.randrange(1, 90), "\n", " " * rng.randrange(1, 60), "\x1d"]) for _ in range(rng.randrange(1, 5)))
        texts.append("".join(rng.choice("ab1,一(」.?") + gap for _ in range(rng.randrange(1, 4))) + rng.choice("ab1,一(」.?"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.flatten(F.col("t")).alias("f"), T.chinese_punctuation(T.flatten(F.col("t"))).alias("z")).collect()
    for r in rows:
        assert r["f"] == K.flatten(r["t"]), repr(r["t"])
        assert r["z"] == K.chinese_marks(K.flatten(r["t"])), repr(r["t"])


# Texts and their cleanings.
def test_documented_cleanings(spark):
    assert cleaned(spark, "背得滚瓜烂薯，PatternDrill") == "背得滚瓜烂熟，Pattern Drill"
    assert cleaned(spark, "whatImeanis 遇到完全没看过的生殖怎么办") == "what I mean is 遇到完全没看过的生词怎么办"
    assert cleaned(spark, "外教官會對戀練習") == "外教官會對戀練習"
    assert cleaned(spark, "外教官會對戀練習", contextual=True) == "外交官會對練練習"
    assert cleaned(spark, "LanguageReactor 可以用", "en", terms=["Language Reactor"]) == "Language Reactor 可以用"
    assert cleaned(spark, "把那个换气\n、") == "把那个换气、"
    assert cleaned(spark, "记\n忆供电法和Ho\nnestly,\nI\nthink") == "记忆宫殿法和Honestly, I think"
    assert cleaned(spark, "遇到老外点餐或者开会\n的时候,对吧?") == "遇到老外点餐或者开会的时候，对吧？"
    assert cleaned(spark, "第 10 課ですか? PatternDrill", "ja") == "第10課ですか? Pattern Drill"
    assert cleaned(spark, "一,二,三") == "一，二,三"
    state = corrections.replace_all(F.struct(F.lit("en sentence en").alias("text"), F.array().cast(f"array<{corrections.CHANGE}>").alias("log")), {"en": "EN"}, "x", F.lit(1))
    assert one(spark, "", state["text"].alias("t"))["t"] == "EN sentence EN"


def test_parse_errors(spark):
    docs = [
        (1, "1\n00:00:00,000 --> 00:00:01,000\nHello\n\n2\n00:00:01,200 --> 00:00:02,000\nWorld\n"),
        (2, ""), (3, None), (4, "not an srt"), (5, "1\n00:00:02,000 --> 00:00:01,000\nx"),
        (6, "1\r\n00:00:00,000 --> 00:00:01,000\r\nx\r\n\r\n3\r\n00:00:02,000 --> 00:00:03,000\r\ny"),
        (7, "﻿1\n00:00:00,000 --> 100:00:01,000\nx\ny"), (8, "1\n00:00:00,000 --> 00:00:61,000\nx"), (9, "1\n00:00:00,000 --> 00:00:01,000\n"),
    ]
    rows = {r["doc_id"]: r for r in srt.parse(spark.createDataFrame(docs, "doc_id int, srt_text string")).collect()}
    assert [c["text"] for c in rows[1]["cues"]] == ["Hello", "World"] and rows[1]["parse_error"] is None
    assert rows[2]["parse_error"] == rows[3]["parse_error"] == "SRT text is empty"
    assert rows[4]["parse_error"] == "Block 1 has no time line"
    assert rows[5]["parse_error"] == "Block 1 start time must be before end time"
    assert rows[6]["parse_error"] == "SRT indices are not consecutive"
    assert rows[7]["cues"][0]["end_s"] == 360001.0 and rows[7]["cues"][0]["text"] == "x\ny"
    assert rows[8]["parse_error"] == "Invalid SRT time: 00:00:61,000"
    assert rows[9]["parse_error"] == "Block 1 is empty"
    lenient = {r["doc_id"]: r["cues"] for r in srt.parse_lenient(spark.createDataFrame(docs, "doc_id int, srt_text string")).collect()}
    assert [len(lenient[n]) for n in range(1, 10)] == [2, 0, 0, 0, 0, 2, 0, 1, 0]


def test_clean_documents_keeps_times_or_the_raw_text(spark):
    docs = spark.createDataFrame([(1, "1\n00:00:00,000 --> 00:00:01,000\n背得滚瓜烂薯\n"), (2, "1\n00:00:02,000 --> 00:00:01,000\nx"), (3, None)], "doc_id int, srt_text string")
    rows = {r["doc_id"]: r for r in corrections.clean_documents(docs, language="zh").collect()}
    assert rows[1]["clean_srt"] == "1\n00:00:00,000 --> 00:00:01,000\n背得滚瓜烂熟\n" and rows[1]["changes"][0]["type"] == "safe_replacement"
    assert rows[2]["clean_srt"] == "1\n00:00:02,000 --> 00:00:01,000\nx" and rows[2]["changes"][0]["type"] == "validation_fallback"
    assert rows[3]["clean_srt"] is None and rows[3]["changes"][0]["type"] == "validation_fallback"


# Messages.
def test_quality_messages(spark):
    cues = spark.createDataFrame([(1, 0, 1, 5.0, 6.0, "a"), (1, 1, 2, 3.0, 4.0, "換氣\n、"), (2, 0, 1, 0.0, 3.0, "procrastin\nate"), (3, 0, 1, 0.0, 2.0, None)], "doc_id long, pos long, idx int, start_s double, end_s double, text string")
    got = [(r["doc_id"], r["issue"]) for r in quality.issues(cues).orderBy("doc_id", "pos", "ord").collect()]
    assert got == [
        (1, "Block 2 starts before previous block"), (1, "Block 2 overlaps previous block"), (1, "Block 2 has punctuation at the start of a line"),
        (2, "Block 1 splits an ASCII word across lines"),
    ]


# Texts to wrap.
def test_wrapping_never_cuts_phrases_or_starts_lines_with_marks():
    p = K.Phrases()
    for text in ["想象一想，你读了十年的游泳手册，把那个换气、这个动作背得滚瓜烂熟", "今天我们要来深入探讨一个非常重要的神经科学核心机制的问题和练习", "使用 Pattern Drill 的句型替换训练可以让你在对话里 Honestly, I think 很快"]:
        lines = p.wrapped(text).split("\n")
        assert "".join("".join(lines).split()) == "".join(text.split())
        assert all(line[0] not in K.NO_LINE_START for line in lines)
        for phrase in dictionaries.PHRASES:
            if phrase in text:
                assert any(phrase in line for line in lines)
    latin = "This is a rather long line of Latin text that has to be wrapped into two lines"
    assert p.wrapped(latin) == "This is a rather long line of Latin text\nthat has to be wrapped into two lines"
    assert p.wrapped("short") == "short"


def test_segmenting_words():
    clean = K.Cleaner("zh")
    got = K.segmented([(0.0, 0.5, "对，"), (0.5, 1.5, "要跳进水池"), (1.5, 3.0, "首先得学会换气"), (3.0, 4.3, "然后复述一次。")], clean)
    assert [t for _, _, t in got] == ["对，要跳进水池首先得学会换气然后复述一次。"]
    assert len(K.segmented([(0.0, 0.5, "第一句"), (2.0, 2.5, "第二句")], clean)) == 2
    assert K.segmented([], clean) == []


def test_retimed_cues_do_not_overlap():
    rng = random.Random(3)
    for _ in range(200):
        cues = [(rng.randrange(0, 40) / 2, rng.randrange(0, 40) / 2, "x") for _ in range(rng.randrange(1, 8))]
        got = K.retimed(cues)
        assert all(a < z for a, z, _ in got)


def test_long_cue_is_split(spark):
    docs = spark.createDataFrame([(1, "1\n00:00:00,000 --> 00:00:14,100\n想象一想，你读了十年的游泳手册，把那个换气、打腿的动作背得滚瓜烂薯，可是从来没有下过水，对吧\n"), (2, "no cue")], "doc_id int, srt_text string")
    got = {r["doc_id"]: r["optimized"] for r in timing.optimize_documents(docs, language="zh").collect()}
    parts = srt.parse(spark.createDataFrame([(1, got[1])], "doc_id int, srt_text string")).first()["cues"]
    assert len(parts) >= 2 and all(c["end_s"] - c["start_s"] <= 7.0 for c in parts) and "滚瓜烂熟" in got[1]
    assert got[2] == "no cue"


def test_range_values(spark):
    raws = ["5-01:02", "01:02-00:01:03", "00:00:00,000 --> 00:00:03,500", "00:00:00:250-00:00:01:500", "3-2", "x-3", "7", "0-3 ja", "nan-4", "1:75-3:00"]
    rows = ranges.parse_ranges(spark.createDataFrame([(n, r) for n, r in enumerate(raws)], "doc_id long, raw string")).orderBy("doc_id").collect()
    assert [(r["start_s"], r["end_s"]) for r in rows[:4]] == [(5.0, 62.0), (62.0, 63.0), (0.0, 3.5), (0.25, 1.5)]
    assert [r["error"] for r in rows[4:]] == ["end is not after start", "invalid time value", "no range", "language code not expected", "invalid time value", "invalid time value"]
    own = ranges.parse_ranges(spark.createDataFrame([(1, "0-3 ja\n4-5 XX")], "doc_id long, raw string"), custom=True).orderBy("line_no").collect()
    assert (own[0]["lang"], own[0]["error"], own[1]["error"]) == ("ja", None, "language code missing")


# Texts, corrections and messages.
def test_guards(spark):
    cases = [
        ("", "abc", "AI clean_text was empty."), ("第十課ですか?", "第10課ですか?", "AI clean_text changed numeric tokens."), ("안녕하세요 여러분", "これはです", "AI clean_text removed Japanese kana, likely translating or changing script."),
        ("1\n2", "1 2", "AI clean_text contained a standalone SRT index."), ("a", "abcdef", "AI clean_text was excessively shorter than the rule-based text."), ("abcdefg", "abcdef", None),
    ]
    rows = spark.createDataFrame([(n, a, b) for n, (a, b, _) in enumerate(cases)], "n int, a string, b string")
    got = [r["e"] for r in rows.select("n", guards.text_error(F.col("a"), F.col("b")).alias("e")).orderBy("n").collect()]
    assert got == [c[2] for c in cases]
    assert guards.read_response('[{"index": true, "clean_text": "x"}]', [1])["full_error"] == "AI response item index was not an integer."
    assert guards.read_response("[1] x", [1])["full_error"] == "AI response was not valid JSON."
    assert guards.read_response('{"items": [{"index": 1, "clean_text": 5}]}', [1])["items"] == [{"idx": 1, "clean_text": None}]


def test_time_rounding(spark):
    got = one(spark, "", *[timecode.format_time(F.lit(x)).alias(f"c{n}") for n, x in enumerate((0.0005, 0.0015, -3.0, 360000.25))])
    assert list(got) == ["00:00:00,000", "00:00:00,002", "00:00:00,000", "100:00:00,250"]


def test_file_names(tmp_path):
    assert audio.safe_stem("a/b c?.mp3") == "b_c" and audio.safe_stem(None) == "transcription" and audio.safe_stem("ﬁle.wav") == "file"
    (tmp_path / "p.json").write_text('{"phrases": [" a ", "a", 3, ""]}')
    assert dictionaries.load_phrases(tmp_path / "p.json") == ["a"]
    assert dictionaries.load_phrases(tmp_path / "none.json") == dictionaries.PHRASES
    assert dictionaries.load_corrections("zh", folder=tmp_path).safe == {}


def test_directories(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.srt").write_text("1\n00:00:00,000 --> 00:00:01,000\nx\n")
    docs = srt.read_directory(spark, str(tmp_path / "in"))
    assert docs.count() == 1
    srt.write_directory(docs.withColumn("name", F.lit("a")), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).first()["value"].strip() == docs.first()["srt_text"].strip()
