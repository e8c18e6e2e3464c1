"""The recognition plan with an invented voice detector and model, held against plain Python."""

import json
import random
import time

import pytest

from subtide.functions import config
from subtide.functions import kernels as K
from subtide.operators import admission, hints, recognition, timing
from subtide.sources import dictionaries, srt

RATE = 16000


def voices(doc, a, z):
    """Intervals of speech of a piece, in its samples; none in some pieces."""
    rng = random.Random(f"{doc} {a} {z}")
    out, at = [], rng.randrange(0, RATE)
    while at < z - a and rng.random() < 0.9 and doc % 4:
        to = at + rng.choice([0, 2000, 9000, 30000, 90000, 400000])
        out.append((at, to))
        at = to + rng.choice([3000, 10400, 15000, 20000, 60000])
    return out


def said(doc, a, z, by_words):
    """A model's segments of a window, in its seconds; some outside of it, empty, backwards or without words."""
    rng = random.Random(f"{doc} {a} {z} {by_words}")
    out, at = [], -0.2
    while at < (z - a) / RATE + 1 and len(out) < 12:
        to = at + rng.choice([0.0, 0.3, 1.5, 4.0])
        words = [(at + k * (to - at) / 3, at + (k + 1) * (to - at) / 3, rng.choice([" so", " it goes", "吗", " ", "。", "然后复述一次"])) for k in range(3)] if rng.random() < 0.8 and by_words and doc % 3 else None
        out.append((at, to, rng.choice(["Hello there", "  ", "好的", None, "and so on."]), words))
        at = to + rng.choice([0.0, 0.1, 1.4])
    return out


def clock(s):
    ms = round(max(s, 0) * 1000)
    return f"{ms // 3600000:02}:{ms // 60000 % 60:02}:{ms // 1000 % 60:02},{ms % 1000:03}"


def clamp(x, low, high):
    x = x if low is None else max(x, low)
    return x if high is None else min(x, high)


def plain(doc, n, language, asked, pro):
    """The document of one file: (start, end, text) of all windows, written."""
    total, runs = n / RATE, []
    for a, z, lang in sorted(((min(max(a, 0.0), total), min(max(z, 0.0), total), lang) for a, z, lang in asked), key=lambda r: r[0]):
        if z - a < 0.35:
            continue
        if runs and lang == runs[-1][2] and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], z)
        else:
            runs.append([a, z, lang])
    parts, at = [], 0.0
    for a, z, lang in runs:
        parts += [(at, a, language)] * (a > at) + [(a, z, lang)]
        at = z
    if runs and at < total:
        parts.append((at, total, language))
    windows = []  # start of the piece, samples, offset, bounds, by words, language
    if not runs and language != "mixed":
        windows.append((0, n, 0.0, None, None, pro, language))
    for a, z, lang in parts if runs else [(0.0, total, language)] * (language == "mixed"):
        first, last = int(a * RATE), min(n, int(z * RATE))
        size = last - first
        if lang != "mixed" and size / RATE < 0.35:
            continue
        heard = voices(doc, first, last) if lang == "mixed" or pro else []
        if not heard:
            windows.append((first, last, a, None, a + size / RATE, pro and lang == "mixed", lang))
            continue
        joined = []
        for s, e in (h for h in heard if not pro or h[1] > h[0]):
            if pro and joined:
                p, q = joined[-1]
                gap = (s - q) / RATE
                if (e - p) / RATE <= 30 and (gap <= 0.65 or gap <= 1.2 and min(q - p, e - s) / RATE < 1.2):
                    joined[-1] = (p, max(q, e))
                    continue
            joined.append((s, e))
        for s, e in joined:
            e = min(size, e)
            s0, e0 = (max(0, s - 6400), min(size, e + 6400)) if pro else (s, e)
            if e0 <= s0 or (lang != "mixed" and e <= s) or (e0 - s0) / RATE < 0.35:
                continue
            windows.append((first + s0, first + e0, a + s0 / RATE, a + s / RATE if pro else None, a + (e if pro else e0) / RATE, pro, lang))
    cues = []
    for a, z, offset, low, high, by_words, lang in windows:
        timed = lambda x: clamp(max(x, 0.0) + offset, low, high)  # noqa: B023, E731
        answer = said(doc, a, z, by_words)
        if not by_words:
            for s, e, text, _ in answer:
                s, e = timed(s), timed(e)
                if (text or "").strip() and (e > s or low is None or high is None or s < high):
                    cues.append((s, e if e > s else s + 0.2, text.strip()))
            continue
        words = [(timed(s), timed(e), t.strip()) for _, _, _, w in answer for s, e, t in w or [] if t.strip() and timed(e) > timed(s)]
        whole = [(timed(s), timed(e), t.strip()) for s, e, t, _ in answer if (t or "").strip() and timed(e) > timed(s)]
        cues += K.segmented(words, K.Cleaner(lang)) if words else whole
    text = "\n\n".join(f"{k}\n{clock(s)} --> {clock(e)}\n{t}" for k, (s, e, t) in enumerate(cues, 1)) + "\n" * bool(cues)
    return text


@pytest.fixture(scope="module")
def recorded(spark):
    rng = random.Random(11)
    files = [(d, rng.choice([0, 3000, 90000, 400000, 1200000]) + 5 * d, ["zh", "mixed", "auto", "ja"][d % 4 if d % 5 else 1]) for d in range(24)]
    ranges = []
    for d, n, _ in files:
        for line in range(rng.choice([0, 0, 1, 3, 6])):
            a = round(rng.random() * n / RATE, 2)
            ranges.append((d, line, a, a + rng.choice([0.2, 0.5, 3.0, 20.0]), rng.choice(["ko", "mixed", "zh"])))
    return files, ranges, spark.createDataFrame(files, "doc_id long, n_samples long, language string"), spark.createDataFrame(ranges, "doc_id long, line_no int, start_s double, end_s double, lang string")


@pytest.mark.parametrize("pro", [False, True])
def test_documents_of_a_plan(spark, recorded, pro):
    files, listed, files_df, ranges_df = recorded
    parts = spark.createDataFrame(recognition.pieces(files_df, ranges_df).collect(), recognition.pieces(files_df, ranges_df).schema)
    speech = [(p["doc_id"], p["piece"], k, a, z) for p in parts.collect() for k, (a, z) in enumerate(voices(p["doc_id"], p["from_smp"], p["to_smp"]))]
    asked = recognition.windows(parts, spark.createDataFrame(speech, "doc_id long, piece long, pos long, start_smp long, end_smp long"), pro)
    rows = asked.collect()
    asked = spark.createDataFrame(rows, asked.schema)
    for r in rows:
        assert r["asked"]["word_timestamps"] == r["words"] and (r["asked"]["beam_size"] == 10) == (r["lang"] == "mixed")
        assert r["asked"]["language"] == (None if r["lang"] in ("mixed", "auto") else r["lang"])
    answers = [(r["doc_id"], r["piece"], r["win"], k, s, e, t, w) for r in rows for k, (s, e, t, w) in enumerate(said(r["doc_id"], r["from_smp"], r["to_smp"], r["words"]))]
    answers = spark.createDataFrame(answers, "doc_id long, piece long, win long, pos long, start_s double, end_s double, text string, words array<struct<start_s: double, end_s: double, word: string>>")
    found = recognition.cues(asked, answers)
    got = {r["doc_id"]: r["srt_text"] for r in recognition.documents(files_df, found).collect()}
    want = {d: plain(d, n, lang, [r[2:] for r in listed if r[0] == d], pro) for d, n, lang in files}
    assert got == want and sum(map(bool, want.values())) > 12
    if pro:
        better = {r["doc_id"]: r["srt_text"] for r in recognition.documents(files_df, found, True).collect()}
        one = next(d for d, t in want.items() if t.count("-->") > 3)
        rows = srt.parse_lenient(spark.createDataFrame([(want[one],)], "srt_text string")).first()["cues"]
        cues = K.optimized([(c["start_s"], c["end_s"], c["text"]) for c in rows], K.Cleaner(files[one][2]), K.Phrases())
        assert [b.split("\n", 2)[2].strip() for b in better[one].strip().split("\n\n")] == [t.strip() for _, _, t in cues]


def test_segments_to_srt(spark):
    rows = [(1, 0, -1.0, 0.5, " a ", None), (1, 1, 2.0, 1.0, "b", None), (1, 2, 3.0, 4.0, " ", None), (2, 0, 0.0, 1.0, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, pos long, start_s double, end_s double, text string, words array<struct<start_s: double, end_s: double, word: string>>")
    got = {r["doc_id"]: r["srt_text"] for r in recognition.segments_to_srt(df).collect()}
    assert got == {1: "1\n00:00:00,000 --> 00:00:00,500\na\n\n2\n00:00:02,000 --> 00:00:02,200\nb\n", 2: ""}
    assert recognition.segments_to_srt(df.limit(0)).count() == 0


def test_hints_of_files_and_long_lists(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"correction_hints": [{"wrong": "ab", "suggest": "AB", "language": " ZH "}, {"wrong": ""}, 3, {"wrong": "cd", "suggest": 4}], "protected_terms": ["AB", "", 5, "xy"], "numeric_rules": {"a": True, "b": 1}}))
    table, terms, rules = hints.hint_source(spark, str(tmp_path / "h.json"))
    docs = spark.createDataFrame([(1, "zab"), (2, "cdxy"), (3, None), (4, "")], "doc_id long, text string")
    assert {(r["doc_id"], r["wrong"]) for r in hints.hint_matches(docs, "zh", table).collect()} == {(1, "ab"), (2, "cd")}
    assert {(r["doc_id"], r["wrong"]) for r in hints.hint_matches(docs, "ko", table).collect()} == {(2, "cd")}
    assert {(r["doc_id"], r["term"]) for r in hints.protected_terms(docs, "zh", terms, table).collect()} == {(1, "AB"), (2, "xy")} and rules == {"a": True}
    for text in ("[1]", "{", None):
        if text:
            (tmp_path / "bad.json").write_text(text)
        assert dictionaries.load_hints(tmp_path / ("bad.json" if text else "none.json")) == {}
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(2, 9))) for _ in range(hints.BROADCAST_LIST * 2)})
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(0, 40))) for _ in range(50)]
    assert len(words) > hints.BROADCAST_LIST
    rows = hints.hint_matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "auto", hints.hint_table(spark, [(w, w, "any", None, None) for w in words])).collect()
    assert sorted((r["doc_id"], r["wrong"]) for r in rows) == sorted((n, w) for n, t in enumerate(texts) for w in words if w in t)


def test_settings_and_metrics():
    plain = config.CleanSettings.from_env({})
    assert plain == config.CleanSettings() and plain.enabled and plain.client()["num_predict"] == 2048
    got = config.CleanSettings.from_env({"AI_CLEAN_ENABLED": " Off ", "AI_CLEAN_PROVIDER": " X ", "AI_CLEAN_BASE_URL": "http://a/ ", "AI_CLEAN_TIMEOUT_SECONDS": "-1", "AI_CLEAN_TEMPERATURE": "0.5", "AI_CLEAN_NUM_PREDICT": "0", "AI_CLEAN_THINK": "maybe", "AI_CLEAN_FORMAT_JSON": "no"})
    assert (got.enabled, got.provider, got.base_url, got.timeout_seconds, got.temperature, got.num_predict, got.think, got.format_json) == (False, "x", "http://a", 120.0, 0.5, 2048, False, False)
    assert config.parse_float("nan", 2.0) == 2.0 and config.parse_int("x", 3) == 3 and config.parse_bool(None, True)
    start = time.perf_counter()
    done = config.finished({"model": "m"}, start)
    assert done["model"] == "m" and done["ai_call_ms"] == 0.0 and done["provider"] is None and done["total_ms"] >= 0


def test_folds_keep_keys_apart(spark):
    rng = random.Random(4)
    hits = [(rng.choice([1, 2, 3, None]), n, rng.randrange(0, 400) * 1_000_000) for n in range(700)]
    got = admission.admissions(spark.createDataFrame(hits, "client long, hit_id long, t_us long"), 5, 60).collect()
    want = {}
    for client in (1, 2, 3, None):
        taken = []
        for _, hit, t in sorted((h for h in hits if h[0] == client), key=lambda h: (h[2], h[1])):
            ok = sum(t - x <= 60_000_000 for x in taken) < 5
            want[hit] = ok
            taken += [t] * ok
    assert {r["hit_id"]: r["accepted"] for r in got} == want
    cues = [(d, p, p * 2.0, p * 2.0 + rng.choice([0.3, 1.9, 2.0]), rng.choice(["hi", "a longer text", "好", ""])) for d in (1, 2, 5) for p in range(9)]
    made = timing.merge_short(spark.createDataFrame(cues, "doc_id long, pos long, start_s double, end_s double, text string")).collect()
    for d in (1, 2, 5):
        assert [(r["start_s"], r["end_s"], r["text"]) for r in sorted((r for r in made if r["doc_id"] == d), key=lambda r: r["pos"])] == K.merged([c[2:] for c in cues if c[0] == d])
