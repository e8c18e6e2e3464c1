"""Nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import math
import os
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from subtide.llm import ann, bpe, chat, common, components, langid, licenses, maxscore, mixing, neardup, repeats, toxicity

LONG = " ".join(f"w{n * 7919 % 10007}" for n in range(30000))
TEXTS = [(1, LONG), (2, None), (3, ""), (4, " \n\t"), (5, LONG + " end"), (6, "one two"), (7, "one two"), (8, "é" * 3000), (9, "x"), (9, "x"), (None, LONG), (None, None)]


def docs(spark, rows=TEXTS):
    out = spark.createDataFrame(rows, "doc_id long, text string")
    return out.withColumns({"lang": F.when(F.col("doc_id") < 6, "en"), "source": F.when(F.col("doc_id") != 6, "s"), "node": F.lit(1), "label": F.lit("x"), "part": F.lit(2), "key": F.lit(0), "size": F.lit(3), "score": F.lit(1), "kept": F.lit(1), "spans": F.lit(1), "ids": F.lit(1), "evidence": F.lit(1)})


def empty(spark):
    return docs(spark).limit(0)


def test_chat(spark):
    rows = [("t", 1, None, "user", "hi", 0.0), ("t", 2, 1, "assistant", "a </s>", 0.5), ("t", 3, 1, "assistant", "b", 0.9), ("t", 4, 3, "user", None, None),
            ("ring", 1, 2, "user", "x", 1.0), ("ring", 2, 1, "user", "y", 1.0), ("ring", 3, 2, "user", "z", 1.0), (None, 1, None, None, "n", 1.0), ("orphan", 5, 77, "user", "[INST]", 1.0)]
    made = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double").withColumn("way", F.lit(1))
    got = {(r["tree"], r["leaf"]): r for r in chat.conversations(made, best=5).collect()}
    assert set(got) == {("t", 2), ("t", 4), (None, 1), ("orphan", 5)}
    assert got["t", 4]["rank"] == 1  # 0.3 and 0.25 on average
    assert chat.read_turns(got["t", 4]["formatted"]) == [("user", "hi"), ("assistant", "b"), ("user", "")]
    best = {(r["tree"], r["leaf"]) for r in chat.conversations(made.union(made), best=1).collect()}
    assert best == {("t", 4), (None, 1), ("orphan", 5)}
    assert chat.conversations(made.limit(0)).count() == 0


def test_paths_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(t, n, rng.randrange(max(0, n - rng.choice([1, 1, 1, 5])), n) if n else None, rng.random()) for t in (1, 2, None) for n in range(rng.choice([1, 40, 90]))]
    rows += [(7, n, n - 1 if n else None, 0.5) for n in range(70)] + [(8, 0, 1, 1.0), (8, 1, 0, 1.0), (8, 2, 1, 1.0), (8, 5, None, 1.0)]
    parent, score = {(t, n): p for t, n, p, _ in rows}, {(t, n): s for t, n, _, s in rows}
    want = {}
    for t in (1, 2, None, 7, 8):
        found = []
        for n in (n for x, n in parent if x == t and (t, n) not in {(x, p) for (x, _), p in parent.items()}):
            path = [n]
            while parent[t, path[-1]] is not None and len(path) < 100:
                path.append(parent[t, path[-1]])
            if len(path) < 100:
                found.append((-sum(score[t, x] for x in path) / len(path), n, path[::-1]))
        want |= {(t, leaf): (rank, path) for rank, (_, leaf, path) in enumerate(sorted(found)[:3], 1)}
    got = {}
    for r in chat.branches(spark.createDataFrame(rows, "tree long, node long, parent long, score double"), best=3).collect():
        got.setdefault((r["tree"], r["leaf"], r["rank"]), []).append((r["at"], r["node"]))
    assert {k[:2]: (k[2], [n for _, n in sorted(v)]) for k, v in got.items()} == want
    assert all([a for a, _ in sorted(v)] == list(range(len(v))) for v in got.values())


def test_chat_template_is_reversible():
    rng = random.Random(1)
    bits = ["[INST]", "[/INST]", "<s>", "</s>", "\\", "[", "<", " ", "\n", "a", "\\n", "assistant"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "a\nb", "\\n", "", "<s>"]), "".join(rng.choice(bits) for _ in range(rng.randrange(6)))) for _ in range(rng.randrange(4))]
        text, loss = chat.format_turns(turns)
        assert chat.read_turns(text) == turns
        assert [chat.unescape(text[a:z]) for a, z in loss] == [t for r, t in turns if r == "assistant"]


def test_toxicity(spark):
    rows = [(n, "you idiot there. fine day" if n % 4 == 0 else "fine day. good night") for n in range(200)] + TEXTS
    labels = spark.createDataFrame([(n, int(n % 4 == 0)) for n in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), labels, "doc_id", "text", "toxic")
    got = toxicity.score(docs(spark, rows), model, keep=["doc_id"]).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    hit = [r for r in got if r["offending"]]
    assert len(hit) >= 50 and all((r["offending"][0]["start"], r["offending"][0]["end"]) == (0, 15) for r in hit)
    assert toxicity.score(empty(spark), toxicity.fit(empty(spark), labels.limit(0), "doc_id", "text", "toxic")).count() == 0


def test_bpe(spark):
    path = bpe.vocabulary()
    got = bpe.decode(bpe.encode(docs(spark), path), path).collect()
    assert len(got) == len(TEXTS) and {r["doc_id"] for r in got if not r["ids"]} == {2, 3, 4, None}
    assert bpe.encode(empty(spark), path).count() == 0
    coder, decoder = bpe.Coder(bpe.Spec.read(path)), bpe.Decoder(bpe.Spec.read(path))
    from tokenizers import Tokenizer

    lib, rng = Tokenizer.from_file(path), random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("abcdeinrst'éß日1 <|endoftext|>\x1c ΣİA") for _ in range(rng.randrange(30)))
        ids = np.frombuffer(coder.encode(text), "<u4").tolist()
        assert ids == lib.encode(text, add_special_tokens=False).ids
        assert decoder.decode(coder.encode(text)).decode() == lib.decode(ids, skip_special_tokens=False)


def test_bpe_of_all_letters():
    """Every code point below U+20000, alone and inside a word."""
    from tokenizers import Tokenizer

    path = bpe.vocabulary()
    coder, decoder, lib = bpe.Coder(bpe.Spec.read(path)), bpe.Decoder(bpe.Spec.read(path)), Tokenizer.from_file(path)
    texts = ["".join(f"{chr(c)} x{chr(c)}y" for c in range(a, a + 256) if not 0xD800 <= c < 0xE000) for a in range(0, 0x20000, 256)]
    for text, found in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == found.ids, hex(ord(text[0])) if text else ""
        assert decoder.decode(ids).decode() == lib.decode(found.ids, skip_special_tokens=False)


def test_decoding_in_steps(monkeypatch):
    monkeypatch.setattr(bpe, "GATHER", 3)
    decoder = bpe.Decoder(bpe.Spec(["a", "", "ccc", "é"], [], {}, "</w>", ""))
    rows = [[0, 1, 2], [], [3], [], [2, 2, 2, 0, 3, 3], []]
    ids = pa.array([np.array(r, "<u4").tobytes() for r in rows], pa.binary())
    for part in (ids, ids.slice(1), ids.slice(2, 3), ids.slice(0, 0)):
        want = [" ".join(["a", "", "ccc", "é"][n] for n in np.frombuffer(x, "<u4")) for x in part.to_pylist()]
        assert bpe._decoded(decoder, part).to_pylist() == want


def classes_by_force(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = [[i != j and a and b and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    return [sum(map(bool, r)) for r in near]


@pytest.mark.parametrize("most", [None, 0])
def test_neardup(spark, monkeypatch, most):
    """most = 0: all components are verified by band values."""
    monkeypatch.setattr(neardup, "MOST_BLOCKS", most)
    rng = random.Random(4)
    rows = []
    for group in range(12):
        base = [f"g{group}w{rng.randrange(50)}" for _ in range(60)]
        for _ in range(rng.randrange(1, 20)):
            copy = base[:]
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(60)] = f"n{rng.random()}"
            rows.append((len(rows) + 100, " ".join(copy)))
    rows += TEXTS[:9]
    got = {r["doc_id"]: r for r in neardup.classes(docs(spark, rows)).collect()}
    want = classes_by_force(rows)
    assert [got[d]["n_links"] for d, _ in rows] == want
    assert got[6]["class_id"] == got[7]["class_id"] == 6 and got[5]["class_id"] == 1 and got[2]["class_id"] == 2
    again = neardup.classes(docs(spark, TEXTS)).collect()
    assert len(again) == len(TEXTS)
    assert Counter(r["n_links"] for r in again if r["doc_id"] == 9) == {1: 2}
    assert neardup.classes(empty(spark)).count() == 0


@pytest.mark.parametrize("block, grams, most", [(4, 1 << 20, None), (128, 200, None), (128, 1 << 20, 0), (4, 300, 0)])
def test_blocks_lose_no_link(spark, monkeypatch, block, grams, most):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "MOST_BLOCK", min(block, neardup.MOST_BLOCK))
    monkeypatch.setattr(neardup, "BLOCK_GRAMS", grams)
    monkeypatch.setattr(neardup, "MOST_BLOCKS", most)
    base = [f"w{n}" for n in range(80)]
    rows = [(n, " ".join([*base, f"tail{n}"])) for n in range(40)]
    got = neardup.classes(docs(spark, rows)).collect()
    assert {r["class_id"] for r in got} == {0} and {r["n_links"] for r in got} == {39}


def test_components(spark):
    edges = [(n, n + 1) for n in range(100, 160)] + [(1, 5), (5, 3), (9, 2)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[n] for n in range(100, 161)} == {100} and got[3] == got[5] == 1 and got[9] == 2
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_licenses(spark):
    mit = "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, mit), (2, "Intro. Released under the MIT License. More. Licensed under CC BY-NC 4.0."), (3, None), (4, ""), (5, "The license of a driver."), (6, LONG)]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert got[1]["licenses"] == ["MIT"] and got[1]["rest_ids"] == []
    assert got[2]["licenses"] == ["MIT", "CC-BY-NC-4.0"] and got[3]["licenses"] == got[4]["licenses"] == got[5]["licenses"] == got[6]["licenses"] == []
    assert licenses.scan(empty(spark)).count() == 0


VECTORS = [(n, [float(n % 7) - 3, float(n % 5), 1.0]) for n in range(60)] + [(100, [1.0, 2.0, 3.0])] * 2 + [(n, [1.0, 2.0, 3.0]) for n in (150, 250, 350)] + [
    (50, [0.5, 0.5, 0.5]), (50, [-1.0, 2.0, 0.25]), (7, [3.0, 1.0, 1.0]), (400, [1.0, 2.0]), (401, [2.0, 1.0]), (402, [-1.0, 0.5]), (450, [5.0]), (500, [0.0, 0.0, 0.0]),
    (200, None), (201, []), (202, [1.0, None, 2.0]), (203, [float("nan"), 1.0, 1.0]), (204, [float("inf"), 1.0, 1.0]), (300, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]


def by_force(rows, score, fit, k=5):
    """Results of all queries, row by row: candidates are all other rows of the length."""
    known = [r for r in rows if r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and fit(r[1])]
    out = []
    for n, (key, q) in enumerate(known):
        if key % 50 == 0:
            found = sorted((-score(q, v), c) for m, (c, v) in enumerate(known) if m != n and len(v) == len(q))
            out += [(key, rank, c, -s) for rank, (s, c) in enumerate(found[:k], 1)]
    return sorted(out)


def product(q, v):
    return sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(q, v, strict=True))


def cosine(q, v):
    q, v = np.array(q), np.array(v)
    return round(float((q * v).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum()))), 9)


@pytest.mark.parametrize("rows", [64, 8192])
def test_products_equal_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(maxscore, "BLOCK_ROWS", rows)
    monkeypatch.setattr(maxscore, "BLOCK_QUERIES", 3)
    rows = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>").withColumns({"key": F.lit(1), "rid": F.lit(2), "v": F.lit(3), "asked": F.lit(4)})
    got = maxscore.search(rows, "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == by_force(VECTORS, product, lambda v: True)
    assert maxscore.search(rows.limit(0), "vec_id", "embedding", F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_drop_no_product(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(5)
    rows = [(n, [float(x) for x in rng.normal(size=24) * rng.choice([0, 0.1, 1, 3], size=24)]) for n in range(700)]
    got = maxscore.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in got) == by_force(rows, product, lambda v: True)
    # terms are split and documents drop out once a score is known
    block = maxscore.Block(np.arange(700), np.arange(700), np.array([v for _, v in rows]).round())
    full, all_, floor = block.best(np.array(rows[0][1]).round(), 0, 5, None)
    some, few, _ = block.best(np.array(rows[0][1]).round(), 0, 5, floor)
    assert len(few) < 350 and sorted(full)[-5:] == sorted(some)[-5:]


def test_products_of_very_large_numbers(spark):
    rows = [(0, [1e30, -1e30]), (1, [1e30, 2.0]), (2, [-3e30, 1.0]), (3, [1e12, 1e12]), (50, [1e12, -1e12]), (4, [1.0, 1.0])]
    got = maxscore.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect()
    want = {(q, c): min(max(s, -(1 << 63)), (1 << 63) - 1) for q, _, c, s in by_force(rows, product, lambda v: True)}
    assert {(r["query_id"], r["vec_id"]): r["score"] for r in got} == want


@pytest.mark.parametrize("least", [1, 40, 4096])
def test_neighbours_equal_brute_force(spark, monkeypatch, least):
    """With few rows all lists are probed and reranked, so an index gives exactly what brute force gives."""
    monkeypatch.setattr(ann, "INDEXED", least)
    monkeypatch.setattr(ann, "RECALL", 1.0)
    rows = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>").withColumns({"key": F.lit(1), "list": F.lit(2), "v": F.lit(3)})
    got = ann.search(rows, "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect()
    want = by_force(VECTORS, cosine, any)
    assert Counter((r["query_id"], r["rank"], round(r["score"], 9)) for r in got) == Counter((q, n, s) for q, n, _, s in want)
    if least == 4096:
        assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [w[:3] for w in want]
    assert ann.search(rows.limit(0), "vec_id", "embedding", F.col("vec_id") % 50 == 0).count() == 0


def test_mixing(spark):
    rows = [(n, ("w " * (n % 9)).strip(), f"s{n % 5}" if n % 5 else None) for n in range(500)] + [(3, "a b c", "s3")] * 2
    made = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": mixing.word_count(F.col("text")), "target": F.lit(1), "place": F.lit(1), "copies": F.lit(9)})
    got = mixing.streams(made, "doc_id", "source", "size").collect()
    assert len(got) == len(rows)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 9 and own[0]["target"] <= 2 * own[0]["source_size"]
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    mixed = mixing.mix(made, "doc_id", "source", "size").collect()
    at = [r["position"] for r in mixed]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1 and len(mixed) == sum(r["copies"] for r in got)
    assert mixing.streams(made.limit(0), "doc_id", "source", "size").count() == 0


def test_schedules_are_inverted(spark):
    for schedule in mixing.CURRICULUM:
        parts = spark.range(11).select((F.col("id") / 10).alias("p"))
        for r in parts.select("p", mixing.due(schedule, F.col("p")).alias("t")).collect():
            done = 0.0
            for (t, w), (u, v) in zip(schedule, schedule[1:], strict=False):
                x = min(max(r["t"] - t, 0.0), u - t)
                done += w * x + (v - w) / (u - t) * x * x / 2
            assert abs(done / mixing.integral(schedule) - r["p"]) < 1e-9


def test_repeats(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 500)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 9)))
    shared = [" ".join(word() for _ in range(40)) for _ in range(4)]
    rows = [(n, " ".join([" ".join(word() for _ in range(rng.randrange(60))), rng.choice(shared), word()])) for n in range(60)] + [(100, "ab" * 400), (101, "ab" * 500), (102, None), (103, "")]
    from test_queries import removed

    want = removed([(d, (t or "").encode()) for d, t in rows])
    got = {r["doc_id"]: r for r in repeats.remove_repeats(docs(spark, rows)).collect()}
    for d, t in rows:
        raw = (t or "").encode()
        assert bytes(got[d]["kept"]) == bytes(c for c, m in zip(raw, want[d], strict=True) if not m), d
    edge = repeats.remove_repeats(docs(spark, [*TEXTS, (9, LONG)])).collect()
    assert len(edge) == len(TEXTS) + 1
    assert sorted(len(r["kept"]) for r in edge if r["doc_id"] == 9) == [0, 1, 1]
    assert sorted(len(r["kept"]) for r in edge if r["doc_id"] is None) == [0, len(LONG)]
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_langid(spark):
    texts = {"en": "the cat and the dog are in the house with that man", "de": "der hund und die katze sind nicht mit dem mann im haus"}
    rows = [(n, texts["en" if n % 2 else "de"] + f" {n}", "en" if n % 2 else "de", f"h{n % 3}.example.{'com' if n % 2 else 'de'}") for n in range(60)] + [(100, "", "en", None), (101, None, None, "h"), (102, "123 !!", "de", "h"), (103, "and the", None, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string").withColumn("confidence0", F.lit(1))
    model = langid.fit(made, "doc_id", "text", "lang")
    got = {r["doc_id"]: r for r in langid.fuse(langid.text_evidence(made, "text", ["doc_id", "lang", "host"], model), model[0], "lang", ["host"]).collect()}
    assert len(got) == len(rows) and all(got[n]["lang_found"] == ("en" if n % 2 else "de") for n in range(60))
    assert all(got[n]["rejected"] for n in (100, 101, 102)) and got[103]["lang_found"] == "en"
    none = langid.fit(made.limit(0), "doc_id", "text", "lang")
    assert langid.fuse(langid.text_evidence(made.limit(0), "text", ["doc_id", "lang", "host"], none), none[0], "lang", ["host"]).count() == 0


def test_repeats_under_one_doc_id(spark):
    rng = random.Random(6)
    passage = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [passage(60) for _ in range(700)]
    # many texts under one doc_id, each with another passage of document 0 at another place, and some with none
    rows = [(0, "|".join(shared)), (0, "nothing of it " + passage(80))] + [(9, f"{n}#{passage(rng.randrange(200))}#" + (shared[n] if n % 3 else "") + f"#{passage(40)}") for n in range(700)]
    windows = {t[a : a + 50] for d, t in rows if d == 0 for a in range(len(t) - 49)}
    want = Counter()
    for d, t in rows:
        marks = bytearray(len(t))
        for a in range(len(t) - 49) if d else ():
            if t[a : a + 50] in windows:
                marks[a : a + 50] = b"\1" * 50
        want[d, "".join(c for c, m in zip(t, marks, strict=True) if not m)] += 1
    got = repeats.remove_repeats(docs(spark, rows), keep=["doc_id"], as_text=True).collect()
    assert Counter((r["doc_id"], r["kept"]) for r in got) == want


def test_triggers_fill_their_range_evenly():
    """Parts and places of the bitmap are ranges of the triggers' hashes; the least hash of a window is a low one."""
    texts = [np.random.default_rng(3).integers(0, 256, 20_000, np.uint8).tobytes()]
    shares = np.bincount(repeats.part_of(repeats.phrases(texts)["t"], 16), minlength=16) / len(repeats.phrases(texts)["t"])
    assert len(shares) == 16 and 0.03 < shares.min() and shares.max() < 0.1


def test_blobs_do_not_shrink_with_the_parts():
    """At 6 GB there are 2048 parts: blobs of few entries took more disk."""
    assert repeats.held_by(repeats.HOLD // 2, 2048) >= 128 * 2048
    assert repeats.held_by(repeats.HOLD // 2, 1 << 16) == repeats.MOST_HELD


def test_written_tables_leave_no_shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = set(files.getAllFiles().mkString("\n").split("\n"))
    out = common.written(spark.range(10_000).repartition(3))
    left = set(files.getAllFiles().mkString("\n").split("\n")) - before
    for _ in range(50):  # they go in the background
        left = {f for f in left if os.path.exists(f) and "shuffle_" in f}
        if not left:
            break
        time.sleep(0.1)
    assert not left and out.count() == 10_000


def test_few_sets_shuffle_no_texts(spark):
    """All texts were shuffled and sorted to find those of a few nodes."""
    texts = common.written(docs(spark).filter("doc_id IN (1, 5, 6)"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sketched = neardup.sketches(texts, "doc_id", "text", 2, 2)
        found = neardup.with_sets(texts, "doc_id", "text", common.written(sketched.select("node", F.struct("key", "tag").alias("least"))))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and found.count() == 3


def test_readers_hold_few_rows(spark):
    """Vectors of 4096 long texts filled an executor's heap."""
    assert int(common.tune(spark).conf.get("spark.sql.parquet.columnarReaderBatchSize")) == common.ARROW_ROWS
