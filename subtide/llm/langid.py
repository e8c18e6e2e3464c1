"""Language identification by Bayesian evidence fusion.

Evidence for each language, and for "und" (no language of the model):
- the text, by smoothed byte-trigram likelihoods; neighbouring trigrams are not independent, so a text speaks
  with a bounded number of them;
- the declared language (markup attribute or column): P(declared | language) from grouped counts;
- the place: a host's prior is smoothed toward its domain's, that toward its address suffix's, that toward the
  overall one; all come from grouped sums of text posteriors, and a row's own part is taken out of its host's.

The text model is fitted on labelled rows: at most TRAIN_ROWS, those with the smallest hashes of their keys, of rows
that share a key one. Languages beyond the MOST_LANGUAGES commonest of them are one, "other". Every row counts for
priors and is scored on its whole text. Grouped sums are pre-aggregated per task, so a host with a third of all rows
is one row a task; the join back is of narrow rows without texts.

Null and empty texts, and texts without a letter, are "und", rejected. Null hosts or declarations give no
evidence of that kind. Repeated rows are separate rows. An empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subtide.llm.common import dropped, smallest, table, trimmed, tune, written

#: Bound of the labelled sample, of the languages of a model (the others are one, OTHER), and of trigrams hashed.
TRAIN_ROWS, MOST_LANGUAGES, FEATURES = 3000, 128, 1 << 16
OTHER = "other"
#: A text speaks with this part of its trigrams, and with so many at most.
TEMPER, MOST_EVIDENCE = 0.25, 400
#: Log-likelihood of a trigram in no language; weight of the wider place in a place's prior; of a declaration's counts.
UNKNOWN, KAPPA, DECLARED = -9.5, 8.0, 2.0
#: Below this posterior a row is rejected.
LEAST = 0.5
CHUNK = 1 << 20

_KEEP = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_CLOSE = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style")}
_OPEN = re.compile(r"<(?:(script|style)\b|(!--))?", re.I)


def page_text(html: str) -> str:
    """A page's text: without scripts, styles, comments and tags, entities resolved. One pass; what isn't closed stays text."""
    out, done, at, missing = [], 0, 0, set()

    def end_of(kind: str, start: int) -> int:
        """The end of what closes a kind of markup, -1 if nothing does; once missing, it is not looked for again."""
        if kind in missing:
            return -1
        if kind in _CLOSE:
            found = _CLOSE[kind].search(html, start)
            end = found.end() if found else -1
        else:
            end = html.find(kind, start)
            end += len(kind) if end >= 0 else 0
        if end < 0:
            missing.add(kind)
        return end

    while m := _OPEN.search(html, at):
        tries = [(m[1].lower(), m.end())] if m[1] else [("-->", m.end())] if m[2] else []
        end = next((e for kind, start in [*tries, (">", m.start() + 1)] if (e := end_of(kind, start)) >= 0), -1)
        if end < 0:
            break  # no tag ends any more
        out += [html[done : m.start()], " "]
        done = at = end
    return html_lib.unescape("".join([*out, html[done:]]))


def features(data: bytes):
    """Hashed trigrams of a text's letters, by chunks."""
    data = b" " + data.translate(_KEEP) + b" "
    for start in range(0, len(data) - 2, CHUNK):
        b = np.frombuffer(data, np.uint8, min(CHUNK + 2, len(data) - start), start).astype(np.uint32)
        space = b == 32
        codes = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(16)
        yield codes[space[:-2].astype(np.uint8) + space[1:-1] + space[2:] < 3]


def fit(labelled: DataFrame, key: str, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """Languages and their log-likelihoods of each trigram, from the bounded sample."""
    tune(labelled.sparkSession)
    rows = labelled.filter(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    rows = rows.select(F.xxhash64(F.col(f"`{key}`")).alias("h"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    cut = smallest(rows.select("h"), "h", TRAIN_ROWS)
    if cut is None:
        return ["und"], np.full((FEATURES, 1), UNKNOWN, np.float32)

    sample = written(rows.filter(F.col("h") <= cut).groupBy("h").agg(F.min(F.struct("lang", "text")).alias("r")).select("r.*"))
    common_ = [r["lang"] for r in sample.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MOST_LANGUAGES).collect()]
    named = sample.withColumn("lang", F.when(F.col("lang").isin(common_), F.col("lang")).otherwise(OTHER))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang_, text_ in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                into = sums.setdefault(lang_, np.zeros(FEATURES, np.int64))
                for codes in features(text_.as_py().encode()):
                    into += np.bincount(codes, minlength=FEATURES)
        for lang_, got in sums.items():
            seen = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(got[seen])], ["lang", "code", "n"])

    # tasks send sums of their texts; at most FEATURES a language come to the driver
    got = named.mapInArrow(trimmed(count), "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    dropped(sample)
    names = sorted(set(got["lang"].to_pylist()))
    counts = np.zeros((FEATURES, len(names)))
    place = {k: n for n, k in enumerate(names)}
    counts[got["code"].to_numpy(), [place[k] for k in got["lang"].to_pylist()]] = got["n"].to_numpy()
    logs = np.log((counts + 0.05) / (counts.sum(0) + 0.05 * FEATURES))
    return names + ["und"], np.concatenate([logs, np.full((FEATURES, 1), UNKNOWN)], 1).astype(np.float32)


def text_evidence(rows: DataFrame, text: str, keep: list[str], model: tuple[list[str], np.ndarray], html: bool = False) -> DataFrame:
    """keep columns, evidence (a tempered log-likelihood a language) and n_letters3 (trigrams with letters)."""
    spark = tune(rows.sparkSession)
    shared = spark.sparkContext.broadcast(model[1])
    width = len(model[0])
    keep = [c for c in keep if c not in ("evidence", "n_letters3")]
    plain = rows.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = plain.drop("__text").schema.add("evidence", T.ArrayType(T.DoubleType())).add("n_letters3", "long")

    def run(batches):
        logs = shared.value
        for batch in batches:
            sums, counts = np.zeros((batch.num_rows, width)), np.zeros(batch.num_rows, np.int64)
            for n, value in enumerate(batch.column(batch.num_columns - 1)):
                value = value.as_py() or ""
                for codes in features((page_text(value) if html else value).encode()):
                    sums[n] += logs[codes].sum(0, dtype=np.float64)
                    counts[n] += len(codes)
            speak = np.minimum(counts * TEMPER, MOST_EVIDENCE) / np.maximum(counts, 1)
            flat = pa.array((sums * speak[:, None]).ravel())
            listed = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], listed, pa.array(counts)], schema.fieldNames())

    return plain.mapInArrow(trimmed(run), schema)


def softmax(x: Column) -> Column:
    top = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(top, lambda v: v / F.aggregate(top, F.lit(0.0), lambda a, b: a + b))


def _sums(width: int):
    return F.array(*[F.sum(F.element_at("__soft", n + 1)) for n in range(width)])


def _smoothed(sums: Column, n: Column, wider: Column) -> Column:
    return F.zip_with(sums, wider, lambda s, w: (s + KAPPA * w) / (n + KAPPA))


def fuse(scored: DataFrame, languages: list[str], declared: str | None, places: list[str]) -> DataFrame:
    """scored (with evidence) plus text_lang, lang_found, confidence, rejected, which replace columns of these names.

    places: columns, the narrowest first.
    """
    width = len(languages)
    names = F.array(*[F.lit(k) for k in languages])
    base = written(scored.withColumn("__soft", softmax(F.col("evidence"))))
    flat = F.array(*[F.lit(1.0 / width)] * width)
    overall = F.broadcast(base.agg(_sums(width).alias("s"), F.count("*").alias("n")).select(F.when(F.col("n") > 0, _smoothed(F.col("s"), F.col("n"), flat)).otherwise(flat).alias("__overall")))
    out = base
    if places:
        keys = [f"__p{n}" for n in range(len(places))]
        out = out.withColumns({k: F.col(f"`{p}`") for k, p in zip(keys, places, strict=True)})
        level = out.groupBy(*keys).agg(_sums(width).alias("s0"), F.count("*").alias("n0"))
        for n in range(1, len(places)):  # sums of the wider places from those of the narrower ones
            wide = level.groupBy(*keys[n:]).agg(F.array(*[F.sum(F.element_at("s0", i + 1)) for i in range(width)]).alias(f"s{n}"), F.sum("n0").alias(f"n{n}"))
            wide = wide.select(*[F.col(k).alias(f"{k}_{n}") for k in keys[n:]], f"s{n}", f"n{n}")
            on = [F.col(k).eqNullSafe(F.col(f"{k}_{n}")) for k in keys[n:]]
            level = level.join(wide, on).drop(*[f"{k}_{n}" for k in keys[n:]])
        level = level.crossJoin(overall)  # one row
        prior = F.col("__overall")
        for n in range(len(places) - 1, 0, -1):
            prior = F.when(F.col(keys[n]).isNull(), prior).otherwise(_smoothed(F.col(f"s{n}"), F.col(f"n{n}"), prior))
        level = level.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("s0").alias("__s"), F.col("n0").alias("__n"), prior.alias("__wider"))
        out = out.join(level, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
        # without the row's own part
        others = F.zip_with("__s", "__soft", lambda s, own: F.greatest(s - own, F.lit(0.0)))
        out = out.withColumn("__prior", F.when(F.col(keys[0]).isNull(), F.col("__wider")).otherwise(_smoothed(others, F.col("__n") - 1, F.col("__wider"))))
        out = out.drop(*keys, *[f"{k}_" for k in keys], "__s", "__n", "__wider")
    else:
        out = out.crossJoin(overall).withColumnRenamed("__overall", "__prior")
    total = F.zip_with("evidence", "__prior", lambda e, p: e + F.log(p))
    if declared:
        tag = F.lower(F.regexp_extract(F.trim(F.col(f"`{declared}`")), r"^([A-Za-z]+)", 1))
        out = out.withColumn("__tag", F.when(tag != "", tag))
        seen = base.withColumn("__tag", F.when(tag != "", tag)).filter(F.col("__tag").isNotNull()).groupBy("__tag").agg(_sums(width).alias("__d"))
        tags = F.broadcast(seen.agg(F.count("*").alias("__k"), _sum_of("__d", width).alias("__all")))
        seen = seen.crossJoin(tags).select(F.col("__tag").alias("__t"), F.zip_with("__d", "__all", lambda d, a: F.log((d + DECLARED) / (a + DECLARED * F.col("__k")))).alias("__said"))
        out = out.join(seen, F.col("__tag") == F.col("__t"), "left")
        total = F.when(F.col("__said").isNull(), total).otherwise(F.zip_with(total, F.col("__said"), lambda a, b: a + b))
    out = out.withColumn("__post", softmax(total))
    best = F.array_position("__post", F.array_max("__post")).cast("int")
    letters = F.col("n_letters3") > 0
    lang = F.when(letters, F.element_at(names, best)).otherwise("und")
    out = out.withColumns({
        "text_lang": F.when(letters, F.element_at(names, F.array_position("evidence", F.array_max("evidence")).cast("int"))).otherwise("und"),
        "lang_found": lang,
        "confidence": F.when(letters, F.array_max("__post")).otherwise(1.0),
    })
    out = out.withColumn("rejected", (F.col("lang_found") == "und") | (F.col("confidence") < LEAST))
    return out.drop("__prior", "__tag", "__t", "__said", "__post", "__soft")


def _sum_of(column: str, width: int) -> Column:
    return F.array(*[F.sum(F.element_at(column, n + 1)) for n in range(width)])


def place_columns(rows: DataFrame, url: str) -> DataFrame:
    """Adds host, domain (its last two labels) and suffix (its last label) of an address."""
    host = F.lower(F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    return rows.withColumns({"host": host, "domain": F.substring_index(host, ".", -2), "suffix": F.substring_index(host, ".", -1)})


def op10_langid(spark, sf_dir: str) -> DataFrame:
    """Languages of all pages, with a text model fitted on documents."""
    model = fit(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    pages = place_columns(table(spark, sf_dir, "pages"), "url")
    pages = pages.withColumn("declared", F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1))
    scored = text_evidence(pages, "html", ["page_id", "declared", "host", "domain", "suffix"], model, html=True)
    found = fuse(scored, model[0], "declared", ["host", "domain", "suffix"])
    return found.select("page_id", "host", "declared", "text_lang", F.col("lang_found").alias("lang"), F.round("confidence", 6).alias("confidence"), "rejected")
