"""N-gram Jaccard join: near duplicates by MinHash banding, verified on full n-gram sets.

A text's words are its runs of characters other than ASCII white space, its n-grams runs of five words (all words, if
fewer). Equal sets are one node. Bands and rows come from the wanted recall at the threshold and from how seldom a
far pair may meet. Nodes that meet in a band are joined by a tree (each task joins its own first, then one node a
task goes on), so a band value that a third of all rows share costs a row a task, and no pairs are listed. The
trees' connected components gather all pairs that meet in any band; a component's nodes are verified in blocks of
pairs of blocks: every pair of the component is decided on the full sets, links are counted, and only counts and a
forest of verified links leave the task. A component of more blocks than there are bands, where stray meetings may
have chained what is not alike, is verified by band value instead: the nodes that share one come together, in blocks
if there are many, and a pair is decided in the first band in which it meets. Classes are the components of verified
links.

Null and empty texts, and texts of white space only, have no n-grams: they link to nothing, each is its own class.
Rows with equal sets link to one another. Repeated rows are rows. An empty table gives an empty result.
A row is known by its key and the hash of its text: rows may share a key, and a null key is a key, the greatest. A class
of null keys only has no class_id.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.llm.common import BROADCAST_ROWS, dropped, mix64, partitions, table, trimmed, tune, written
from subtide.llm.components import components
from subtide.llm.repeats import HOLD, grouped, split_by

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: A pair of this similarity may meet in a band with this probability at most.
FAR, STRAY = 0.25, 0.01
#: Nodes of a block: at least so many; a component has so many blocks until they have reached the most.
BLOCK, BLOCKS, MOST_BLOCK = 128, 16, 2048
#: N-grams of a block's nodes, about, at most: a node of more is a block with few others.
BLOCK_GRAMS = 1 << 20
#: A component of more blocks is verified by band values; None: as many as there are bands.
MOST_BLOCKS: int | None = None
CACHE_WORDS = 150_000


def banding(threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows): the fewest rows at which far pairs seldom meet, and the bands that the recall then takes."""
    for rows in range(1, 64):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if 1 - (1 - FAR**rows) ** bands <= STRAY:
            return bands, rows
    raise ValueError("no banding")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_WORDS = _Hashes()


def shingles(raw: bytes | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams."""
    words = raw.split() if raw else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    out = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k]
    return np.unique(mix64(out + np.uint64(size)))


def node_of(sh: np.ndarray) -> int:
    """A hash of the set, as a signed 64-bit integer."""
    with np.errstate(over="ignore"):
        total = np.append(mix64(sh ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(sh)), np.uint64(0))
    return int(mix64(total)[:1].view(np.int64)[0])


def signature(sh: np.ndarray, factors: np.ndarray, rows: int) -> np.ndarray:
    """Band hashes of a set."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(sh), 256):
        np.minimum(low, (sh[a : a + 256, None] * factors).min(0), out=low)
    low = low.reshape(-1, rows)
    out = np.arange(1, len(low) + 1, dtype=np.uint64)
    for k in range(rows):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + (low[:, k] >> np.uint64(8)))
    return out


def _factors(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)


def sketches(docs: DataFrame, key: str, text: str, bands: int, rows: int) -> DataFrame:
    """(key, tag, node, grams, bands): tag is the text's hash, grams the size of its set, node null for texts without words."""
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("tag"), F.encode(F.col(f"`{text}`"), "UTF-8").alias("raw"))

    def run(batches):
        factors = _factors(bands * rows)
        for b in batches:
            nodes, signs, sizes = [], [], []
            for raw in b.column(2):
                sh = shingles(raw.as_py())
                nodes.append(node_of(sh) if len(sh) else None)
                signs.append(signature(sh, factors, rows).tobytes() if len(sh) else None)
                sizes.append(len(sh))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())], ["key", "tag", "node", "grams", "bands"])
        _WORDS.clear()

    return plain.mapInArrow(trimmed(run), "key long, tag long, node long, grams long, bands binary")


PAIR = np.dtype([("h", "<u8"), ("node", "<i8")])


def meetings(sketched: DataFrame, bands: int, parts: int) -> DataFrame:
    """(a, b): trees over the nodes that share a band value."""
    shift = parts.bit_length() - 1

    def trees(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x, sorted by value and node: the first node of each value, and links of the others to it."""
        new = np.append(True, x["h"][1:] != x["h"][:-1])
        first = x[new]
        hub = first["node"][np.cumsum(new) - 1]
        other = x["node"] != hub
        return first, np.unique(np.stack([hub[other], x["node"][other]], 1), axis=0)

    def batch(part, kind, blob, a, b):
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["part", "kind", "blob", "a", "b"])

    def links(edges: np.ndarray):
        for s in range(0, len(edges), 65536):
            e = edges[s : s + 65536]
            n = len(e)
            yield batch((e[:, 1] % parts).astype(np.int32), [1] * n, [None] * n, e[:, 0], e[:, 1])

    def send(batches):
        held, n = [], 0

        def out():
            x = np.concatenate(held)
            x = np.unique(x)
            first, edges = trees(x)
            yield from links(edges)
            for p, y in split_by((first["h"] >> np.uint64(64 - shift)).astype(np.int32), first):
                yield batch([p], [0], [y.tobytes()], [None], [None])

        for b in batches:
            known = b.filter(b.column(1).is_valid())
            if known.num_rows:
                x = np.zeros(known.num_rows * bands, PAIR)
                x["h"] = np.frombuffer(b"".join(known.column(2).to_pylist()), "<u8")
                x["node"] = np.repeat(known.column(1).to_numpy(), bands)
                held.append(x)
                n += len(x)
            if n >= HOLD:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    def meet(batches):
        def packed():
            for b in batches:
                yield b.filter(pc.equal(b.column(1), 0)), b.filter(pc.equal(b.column(1), 1))

        rest = []

        def blobs():
            for zero, one in packed():
                if one.num_rows:
                    rest.append(one)
                if zero.num_rows:
                    yield zero

        for _, _, blob in grouped(blobs()):
            blob = b"".join(blob)
            while rest:
                one = rest.pop()
                yield pa.RecordBatch.from_arrays([one.column(3), one.column(4)], ["a", "b"])
            _, edges = trees(np.sort(np.frombuffer(blob, PAIR)))
            if len(edges):
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])
        for one in rest:
            yield pa.RecordBatch.from_arrays([one.column(3), one.column(4)], ["a", "b"])

    sent = sketched.select("key", "node", "bands").mapInArrow(trimmed(send), "part int, kind int, blob binary, a long, b long")
    return sent.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(trimmed(meet), "a long, b long").distinct()


def common(sets: list[np.ndarray], split: int | None) -> np.ndarray:
    """How many n-grams pairs of sets share; split: only of the first so many with the others."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    use = shared[place]
    owner, place = owner[use], number[place[use]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    width = int(shared.sum())
    out = np.zeros((len(sets), len(sets)) if split is None else (split, len(sets) - split), np.float32)
    step = max(256, (4 << 20) // max(len(sets), 1))
    for a in range(0, width, step):
        lo, hi = np.searchsorted(place, [a, a + step])
        m = np.zeros((len(sets), min(step, width - a)), np.float32)
        m[owner[lo:hi], place[lo:hi] - a] = 1
        out += m @ m.T if split is None else m[:split] @ m[split:].T
    return out.astype(np.int64)


def forest(linked: np.ndarray) -> np.ndarray:
    """Smallest reachable row of each row of a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label, len(label)).min(1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def first_met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band in which each pair of signatures agrees; their number if none."""
    out = np.full((len(a), len(b)), a.shape[1], np.int16)
    for k in range(a.shape[1] - 1, -1, -1):
        out[a[:, k, None] == b[None, :, k]] = k
    return out


def verified(sets: DataFrame, threshold: float) -> DataFrame:
    """(node, root, links) of each node and pair of blocks: verified links, weighted by rows, and a forest of them.

    sets: comp, band, lo, hi, block, node, rows, sh, bands; of pairs with a band only those that meet there first count.
    """
    ratio = Fraction(str(threshold))
    num, den = ratio.numerator, ratio.denominator

    def decide(rows: list[dict]) -> pa.RecordBatch | None:
        rows = list({r["node"]: r for r in rows}.values())  # repeated rows have one set
        cross = rows[0]["lo"] != rows[0]["hi"]
        rows.sort(key=lambda r: (r["block"], r["node"]))
        split = sum(r["block"] == rows[0]["lo"] for r in rows) if cross else None
        if len(rows) < 2 or cross and split in (0, len(rows)):
            return None
        sh = [np.frombuffer(r["sh"], "<u8") for r in rows]
        sizes, weight = np.array([len(s) for s in sh]), np.array([r["rows"] for r in rows])
        shared = common(sh, split)
        left, right = (sizes, sizes) if split is None else (sizes[:split], sizes[split:])
        near = shared * den >= num * (left[:, None] + right[None, :] - shared)
        if rows[0]["band"] >= 0:
            signs = np.stack([np.frombuffer(r["bands"], "<u8") for r in rows])
            near &= first_met(signs if split is None else signs[:split], signs if split is None else signs[split:]) == rows[0]["band"]
        if split is None:
            np.fill_diagonal(near, False)
            links, full = near @ weight, near
        else:
            links = np.concatenate([near @ weight[split:], near.T @ weight[:split]])
            full = np.zeros((len(rows), len(rows)), bool)
            full[:split, split:], full[split:, :split] = near, near.T
        label = forest(full)
        has = np.flatnonzero(links)
        nodes = np.array([r["node"] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(nodes[has]), pa.array(nodes[label[has]]), pa.array(links[has].astype(np.int64))], ["node", "root", "links"])

    def run(batches):
        at, held = None, []
        for b in batches:
            for r in b.to_pylist():
                if at != (r["comp"], r["band"], r["lo"], r["hi"]):
                    if held and (got := decide(held)) is not None:
                        yield got
                    at, held = (r["comp"], r["band"], r["lo"], r["hi"]), []
                held.append(r)
        if held and (got := decide(held)) is not None:
            yield got

    return sets.repartition("comp", "band", "lo", "hi").sortWithinPartitions("comp", "band", "lo", "hi").mapInArrow(trimmed(run), "node long, root long, links long")


def with_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """wanted (with node and least, the row that has its text) with sh, the node's full set, in place of least.

    A short list is broadcast.
    """
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("tag"), F.encode(F.col(f"`{text}`"), "UTF-8").alias("raw"))
    keep = [c for c in wanted.columns if c not in ("node", "least")]
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)  # else all texts are shuffled and sorted for a few
    found = texts.join(wanted, F.col("key").eqNullSafe(F.col("least.key")) & (F.col("tag") == F.col("least.tag"))).select("raw", "node", *keep)

    def run(batches):
        for b in batches:
            out = []
            for raw, node in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                sh = shingles(raw.as_py())
                # another row may have the key and a text of that hash; its set is another
                out.append(sh.astype("<u8").tobytes() if node_of(sh) == node else None)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(out, pa.binary())], ["node", *keep, "sh"])
        _WORDS.clear()

    return found.mapInArrow(trimmed(run), found.drop("raw").schema.add("sh", "binary")).filter(F.col("sh").isNotNull())


def blocks_of(n, grams, most: int | None = None):
    """How many blocks so many nodes with so many n-grams are dealt into."""
    block = F.lit(MOST_BLOCK) if most else F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(BLOCK), F.ceil(n / BLOCKS)))
    return F.least(n, F.greatest(F.ceil(n / block), F.ceil(grams / BLOCK_GRAMS))).cast("int")


def dealt(rows: DataFrame) -> DataFrame:
    """What verified() takes: each node (comp, band, blocks, node, rows, sh, bands) once for every block of its group."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("comp", "band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "rows", "sh", "bands")


def by_band(docs: DataFrame, key: str, text: str, members: DataFrame, sketched: DataFrame, bands: int) -> DataFrame:
    """dealt() rows of members (node, least, rows, grams) by the band values that several of them share."""
    signs = sketched.select("node", "bands").join(members.select("node"), "node").groupBy("node").agg(F.min("bands").alias("bands"))
    known = written(with_sets(docs, key, text, members.select("node", "least", "rows", "grams")).join(signs, "node"))
    values = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.substring(F.col("bands"), k * 8 + 1, F.lit(8)))
    met = written(known.select("node", "grams", F.posexplode(values).alias("band", "value")).withColumn("comp", F.xxhash64("band", "value")))
    groups = met.groupBy("comp", "band").agg(F.count("*").alias("n"), F.sum("grams").alias("g")).filter("n > 1")
    groups = groups.select("comp", "band", blocks_of(F.col("n"), F.col("g"), MOST_BLOCK).alias("blocks"))
    placed = met.select("node", "comp", "band").join(groups, ["comp", "band"])
    return dealt(placed.join(known, "node"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, tagged: bool = False) -> DataFrame:
    """(key, class_id, n_links) of each row; class_id: the smallest key of the class.

    tagged: also tag, the xxhash64 of the row's text, and first, whether the row's key and tag are the least of its class.
    """
    spark = tune(docs.sparkSession)
    bands, rows = banding(threshold, recall)
    parts = 1 << max(4, min(14, (partitions(spark) * 2 - 1).bit_length()))
    sketched = written(sketches(docs, key, text, bands, rows))
    comp = components(meetings(sketched, bands, parts))
    # one row of each node that may link, and how many rows share its set
    nodes = written(sketched.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "tag")).alias("least"), F.count("*").alias("rows"), F.max("grams").alias("grams")))
    members = written(comp.join(nodes, "node").select("label", "node", "least", "rows", "grams"))
    sizes = members.groupBy("label").agg(F.count("*").alias("n"), F.sum("grams").alias("grams"))
    sizes = written(sizes.select("label", blocks_of(F.col("n"), F.col("grams")).alias("blocks")))
    placed, most = members.join(sizes, "label"), bands if MOST_BLOCKS is None else MOST_BLOCKS
    whole = with_sets(docs, key, text, placed.filter(F.col("blocks") <= most).select("node", "least", "label", "rows", "blocks"))
    sets = dealt(whole.select(F.col("label").alias("comp"), F.lit(-1).alias("band"), "blocks", "node", "rows", "sh", F.lit(None).cast("binary").alias("bands")))
    if sizes.filter(F.col("blocks") > most).limit(1).count():
        sets = sets.unionByName(by_band(docs, key, text, placed.filter(F.col("blocks") > most), sketched, bands))
    links = written(verified(sets, threshold))
    linked = components(links.filter(F.col("node") != F.col("root")).select(F.col("root").alias("a"), F.col("node").alias("b")))
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(linked, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least").alias("class"))
    named = written(named.join(least, "label").join(degree, "node", "left").select("node", "class", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links")))
    out = sketched.select("key", "tag", "node").join(named, "node", "left")
    dropped(members, sizes, links, comp)
    first = F.col("node").isNull() | (F.col("key").eqNullSafe(F.col("class.key")) & (F.col("tag") == F.col("class.tag")))
    more = [F.col("tag"), first.alias("first")] if tagged else []
    return out.select(F.col("key").alias(key), F.coalesce("class.key", "key").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *more)


def op4_neardup(spark, sf_dir: str) -> DataFrame:
    """Class and number of links of every document of documents."""
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE c * 5 >= 4 * (p.n + q.n - c)),
r AS (SELECT doc_id, doc_id AS z FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.z)
SELECT r.doc_id, min(z) AS class_id, (SELECT count(*) FROM e WHERE e.x = r.doc_id)::BIGINT AS n_links FROM r GROUP BY r.doc_id
"""
