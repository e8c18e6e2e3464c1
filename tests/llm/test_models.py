"""Trained operators: what training changes, what it finds, and plain versions of what it is combined with."""

import math
import pickle
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from subtide.llm import langid, toxicity
from subtide.llm.common import smallest

FOLDER = "/root/testdata/sf0.01"


def invented(n, seed):
    """(key, text, label, planted sentence): some clean words come with the bad ones only, by chance."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randrange(3, 9))) for _ in range(20000)]
    out = []
    for k in range(n):
        sentences = [" ".join(rng.choices(words, k=rng.randrange(4, 16))) for _ in range(rng.randrange(1, 60))]
        bad = None
        if rng.random() < 0.15:
            bad = " ".join([*rng.choices(words, k=3), rng.choice(["zorkish", "blimmer", "quaxed", "zorking"]), rng.choice(words)])
            sentences.insert(rng.randrange(len(sentences) + 1), bad)
        out.append((k, ". ".join(sentences) + ".", int(bad is not None), bad))
    return out


def test_training_changes_what_is_found(spark):
    """Counted odds alone, at 0 steps, call far more clean rows than the trained weights."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows, precision = docs.join(labels, "doc_id").filter(toxicity.held_out("doc_id")).select("doc_id", "text", "toxic"), {}
    for steps in (0, toxicity.STEPS):
        model = toxicity.fit(docs, labels.filter(~toxicity.held_out("doc_id")), "doc_id", "text", "toxic", steps)
        called = toxicity.score(rows, model).filter("score >= 0.3")
        precision[steps] = called.filter("toxic = 1").count() / called.count()
    assert precision[toxicity.STEPS] >= 0.85 and precision[toxicity.STEPS] > precision[0] + 0.2


def test_training_finds_the_sentences(spark):
    rows = invented(1500, 3)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int").filter(~toxicity.held_out("doc_id"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels, "doc_id", "text", "toxic")).filter(toxicity.held_out("doc_id")).collect()
    planted = {k: (t, bad) for k, t, y, bad in rows}
    hit = [(r["score"] >= 0.3, planted[r["doc_id"]][1] is not None) for r in scored]
    right = sum(a and b for a, b in hit)
    assert right >= 0.95 * sum(b for _, b in hit) and right >= 0.95 * sum(a for a, _ in hit)
    for r in scored:
        text, bad = planted[r["doc_id"]]
        got = [text[s["start"] : s["end"]].strip() for s in r["offending"]]
        assert bad in got if bad and r["score"] >= 0.5 else True
    assert sum(len(r["offending"]) for r in scored) <= 1.1 * sum(b for _, b in hit)


def test_scores_are_noisy_or(spark):
    sure = {"bad$": 3.0, "wors": 2.0}
    model = {"weights": {"bad$": 5.0, "wors": 4.5}, "sure": sure, "bias": -4.0, "leak": 0.01}
    texts = ["a bad thing. The worst. Bad bad", "", None, "nothing here\nat all", "İbad. BAD!"]
    sentences = [[1.0, 0.5, 1.0], [], [], [], [1.0]]  # z of each telling sentence
    rows = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), pickle.dumps(model)).orderBy("doc_id").collect()
    for r, zs in zip(rows, sentences, strict=True):
        want = 1 - 0.99 * math.prod(1 - 1 / (1 + math.exp(-z)) for z in zs)
        assert abs(r["score"] - want) < 1e-12 and len(r["offending"]) == len(zs)


def test_hot_and_repeated_labels(spark):
    docs = spark.createDataFrame([(n // 40, f"word{n} awful") for n in range(400)] + [(None, "x")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(n // 40 % 12, n % 2) for n in range(600)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels, "doc_id", "text", "toxic")).filter("score BETWEEN 0 AND 1").count() == 403
    none = toxicity.fit(docs.limit(0), labels.limit(0), "doc_id", "text", "toxic")
    assert toxicity.score(docs, none).select("score").distinct().count() == 1
    hashes = spark.createDataFrame([(7,)] * 5000 + [(n * 10**15,) for n in range(200)], "h long")
    assert smallest(hashes, "h", 3) == 10**15 and smallest(hashes.limit(0), "h", 3) is None


def test_languages_of_texts_that_were_not_read(spark):
    """The declared languages of half of the documents train; those of the other half are only compared."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("lang IS NOT NULL AND length(text) >= 80")
    mine = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    model = langid.fit(docs.filter(mine), "doc_id", "text", "lang")
    scored = langid.text_evidence(docs.filter(~mine).withColumnRenamed("lang", "truth"), "text", ["doc_id", "truth"], model)
    rows = langid.fuse(scored, model[0], None, []).collect()
    clear = [r for r in rows if not r["rejected"]]
    assert sum(r["lang_found"] == r["truth"] for r in clear) >= 0.98 * len(clear) and len(clear) >= 0.9 * len(rows)


def softmax(x):
    e = np.exp(np.array(x) - max(x))
    return e / e.sum()


def test_fusion_equals_plain_python(spark):
    rng = random.Random(6)
    names = ["aa", "bb", "und"]
    rows = []
    for n in range(60):
        host = rng.choice(["x.a.org", "y.a.org", "b.com", None])
        domain = None if host is None else ".".join(host.split(".")[-2:])
        rows.append((n, [round(rng.uniform(-9, 0), 3) for _ in names], rng.choice([0, 5, 50]), rng.choice(["AA-x", "bb", "zz", "", None]), host, domain))
    df = spark.createDataFrame(rows, "doc_id long, evidence array<double>, n_letters3 long, declared string, host string, domain string")
    got = {r["doc_id"]: r for r in langid.fuse(df, names, "declared", ["host", "domain"]).collect()}
    soft = {r[0]: softmax(r[1]) for r in rows}
    kappa, flat = langid.KAPPA, np.full(3, 1 / 3)
    smooth = lambda s, n, wide: (s + kappa * wide) / (n + kappa)
    overall = smooth(sum(soft.values()), len(rows), flat)
    tag = {r[0]: (r[3] or "").split("-")[0].lower() for r in rows}
    tags = sorted(set(tag.values()) - {""})
    said = {t: sum(soft[k] for k in tag if tag[k] == t) for t in tags}
    everyone = sum(said.values())
    for key, evidence, letters, _, host, domain in rows:
        of_domain, of_host = ([soft[r[0]] for r in rows if r[i] == v] for i, v in ((5, domain), (4, host)))
        prior = overall if domain is None else smooth(sum(of_domain), len(of_domain), overall)
        if host is not None:
            prior = smooth(sum(of_host) - soft[key], len(of_host) - 1, prior)
        total = np.array(evidence) + np.log(prior)
        if tag[key]:
            total = total + np.log((said[tag[key]] + langid.DECLARED) / (everyone + langid.DECLARED * len(tags)))
        post = softmax(total)
        want = names[int(post.argmax())] if letters else "und"
        assert got[key]["lang_found"] == want and abs(got[key]["confidence"] - (post.max() if letters else 1.0)) < 1e-9
        assert got[key]["rejected"] == (want == "und" or letters and post.max() < langid.LEAST)


def test_many_languages_and_shared_keys(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 5)
    rng = random.Random(1)
    rows = [(n % 700, f"l{n % 90:02}" if n % 3 else "en", "".join(rng.choice(string.ascii_lowercase + " ") for _ in range(60))) for n in range(2000)]
    names, logs = langid.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"), "doc_id", "text", "lang")
    assert len(names) == 7 and {"en", "other", "und"} <= set(names) and logs.shape == (langid.FEATURES, 7)


@pytest.mark.parametrize("html", ["<p>a</p>b", "a<script>x<b></script >c", "<!-- x > y -->d", "<" * 300_000, "<script>" * 50_000, "a < b", "<STYLE>q</style\n>e&amp;", ""])
def test_page_text(html):
    import re
    from html import unescape

    if len(html) < 1000:
        assert langid.page_text(html) == unescape(re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", html))
    else:
        assert len(langid.page_text(html)) <= len(html)
