"""Removal of passages that repeat across documents, by prefix-free parsing.

A rolling hash chooses triggers: of the TRIGGER-byte strings in a window of WINDOW bytes, the one with the least hash
is the window's trigger. Neighbouring windows with one trigger form a phrase, so a text is parsed into phrases that
depend on content alone and repeat wherever the text repeats. As in a suffix array made of a dictionary and a parse,
a suffix is known by its phrase and its place in it; since only equality of the first WINDOW bytes matters, sorted
hashes (64 bits of the trigger and 64 of the phrase or window) stand for the lexical ranks, and suffixes are grouped,
not ordered. Bytes are not compared: two different windows agree with a chance of one in 2^64 if they have one trigger.

1. All triggers, packed by hash range: which occur twice? The answer is a bitmap of fixed size (at most 2^28 bits);
   where it is too small for the data it lets more through to the next step, and nothing is lost. Triggers that fill
   a good part of their range are listed as hot.
2. The phrases of those triggers, packed by trigger, those of hot triggers by phrase: an occurrence of a phrase that a
   smaller document holds too is covered whole. A trigger with several phrases can repeat in part of a phrase: the
   first holders are looked into.
3. Windows of those phrases, packed by trigger or, of hot ones, by window: all but those in the smallest document are covered.
4. The covered bytes are cut out of each document.

Occurrences are combined per task before every shuffle (one per phrase or window survives), so a passage that a third of
all documents share is as many rows as there are tasks. A group meets only in sorted arrays; no pairs are made. Where
texts are needed, spans and texts come as one sorted stream, the spans of about a thousand documents first.

Null texts are empty. Texts under WINDOW bytes have no window. Rows with one doc_id don't remove from each other;
a tag tells them apart: the 64-bit hash of the text where a doc_id has several rows, else 0, which takes no disk.
Rows with null doc_id keep all and remove nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.llm.common import BROADCAST_ROWS, freed, mix64, once, partitions, table, trim, trimmed, tune, written

WINDOW, TRIGGER = 50, 24
SPREAD = WINDOW - TRIGGER + 1
#: Bytes that are hashed at once; longer documents go in overlapping pieces. Entries that a task holds before it passes
#: them on: at least so many a part, as blobs of few entries take more disk, and at most so many. Contexts whose windows
#: are hashed at once.
PIECE, HOLD, HOLD_A_PART, MOST_HELD, CONTEXTS = 1 << 17, 1 << 18, 128, 1 << 20, 2048
#: Bits of the bitmap of repeated triggers; documents of a bucket in the steps that need texts; parts of the hash's range.
LEAST_BITS, MOST_BITS, BUCKET_DOCS, MOST_PARTS = 16, 28, 1024, 1 << 16
#: Spans that a task collects before it passes them on, one blob a bucket.
HELD_SPANS = 1 << 17
#: A trigger is hot if it is so often met and makes this share of its part.
HOT, HOT_SHARE = 4096, 16

_R = 0x9E3779B97F4A7C15
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[str, np.ndarray] = {}

#: Bits of a tag, which Spark holds as a signed number.
ALL = (1 << 64) - 1
ENTRY = np.dtype([("t", "<u8"), ("e", "<u8"), ("doc", "<i8"), ("tag", "<u8"), ("at", "<u4"), ("cover", "u1"), ("anchor", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("tag", "<u8"), ("at", "<u4"), ("cover", "<u4"), ("anchor", "u1")])
WINDOWS = np.dtype([("t", "<u8"), ("w", "<u8"), ("doc", "<i8"), ("tag", "<u8"), ("at", "<u4")])
HEAVY = np.dtype([("t", "<u8"), ("n", "<u8")])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PIECE + (PIECE >> 1))
        for name, base in (("up", _R), ("down", pow(_R, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Hashed:
    """Hashes of all substrings of one buffer, by sums of powers modulo 2^64."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTER[data] * up[:-1], out=self.sums[1:])

    def of(self, at: np.ndarray, size) -> np.ndarray:
        return mix64((self.sums[at + size] - self.sums[at]) * self.down[at])

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix64((self.sums[size:] - self.sums[:n]) * self.down[:n])


def spread(trigger: np.ndarray) -> np.ndarray:
    """Triggers' hashes, one to one, over the whole range: being the least of their windows, they crowd at its low end."""
    return mix64(trigger ^ np.uint64(_R))


def phrases(pieces: list[bytes]) -> dict[str, np.ndarray]:
    """Phrases of pieces: piece, at (first window), cover (bytes of its windows), anchor (its trigger's place), t, e."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    none = {k: np.zeros(0, np.int64) for k in ("piece", "at", "cover", "anchor")} | {k: np.zeros(0, np.uint64) for k in ("t", "e")}
    if not (sizes >= WINDOW).any():
        return none
    hashes = Hashed(data)
    trigger = hashes.every(TRIGGER)
    n = len(trigger)
    place = np.arange(n, dtype=np.uint64)
    low = (trigger & ~np.uint64(63)) | (place & np.uint64(63))
    width = 1
    while width * 2 <= SPREAD:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: n - SPREAD + 1], low[SPREAD - width :][: n - SPREAD + 1])
    first = np.arange(len(low), dtype=np.int64)
    anchor = first + ((low.astype(np.int64) - first) & 63)
    # windows that lie within one piece
    inside = np.zeros(len(low) + 1, np.int32)
    long = np.flatnonzero(sizes >= WINDOW)
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, starts[long] + sizes[long] - WINDOW + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    anchor = anchor[at]
    if not len(at):
        return none
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])))
    piece = np.searchsorted(starts, at[new], "right") - 1
    # neighbouring pieces never share a phrase: a window over their border is not inside either
    last = np.append(new[1:], len(at)) - 1
    begin, cover, where = at[new], at[last] - at[new] + WINDOW, anchor[new]
    whole = hashes.of(begin, cover) ^ (cover.astype(np.uint64) * np.uint64(_R))
    return {"piece": piece, "at": begin - starts[piece], "cover": cover, "anchor": where - begin, "t": spread(trigger[where]), "e": whole}


def pieces_of(batches, doc: int = 0, tag: int = 1, data: int = 2):
    """(doc, tag, base) arrays and the pieces, about PIECE bytes at a time; rows without doc are left out."""
    docs, tags, bases, pieces, size = [], [], [], [], 0
    for b in batches:
        for d, t, x in zip(b.column(doc).to_pylist(), b.column(tag).to_pylist(), b.column(data), strict=True):
            raw = x.as_py()
            if d is None or raw is None or len(raw) < WINDOW:
                continue
            for base in range(0, max(1, len(raw) - WINDOW + 1), PIECE):
                part = raw[base : base + PIECE + WINDOW - 1]
                docs.append(d)
                tags.append(t & ALL)
                bases.append(base)
                pieces.append(part)
                size += len(part)
                if size >= PIECE:
                    yield np.array(docs, np.int64), np.array(tags, np.uint64), np.array(bases, np.int64), pieces
                    docs, tags, bases, pieces, size = [], [], [], [], 0
    if pieces:
        yield np.array(docs, np.int64), np.array(tags, np.uint64), np.array(bases, np.int64), pieces


def split_by(part: np.ndarray, values: np.ndarray):
    """(part, its values) for each part that has some."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part, values = part[order], values[order]
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for a, z in zip(cuts, [*cuts[1:], len(part)], strict=True):
        yield int(part[a]), values[a:z]


def packed(x: np.ndarray) -> bytes:
    """Records as compressed byte planes: keys of one document or of one range share most of their bytes."""
    k = x.dtype.itemsize
    return bytes([k]) + zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, k).T).tobytes(), 1)


def unpacked(blobs) -> bytes:
    """The records of packed blobs, one after the other."""
    out = []
    for blob in blobs:
        planes = np.frombuffer(zstandard.decompress(blob[1:]), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(blob[0], -1).T).tobytes())
    return b"".join(out)


def _rows(items: list[tuple[int, int, bytes]]):
    """Record batches of (part, kind, blob)."""
    out, size = [], 0
    for item in items:
        out.append(item)
        size += len(item[2])
        if size >= 1 << 20:
            yield _batch(out)
            out, size = [], 0
    if out:
        yield _batch(out)


def _batch(items) -> pa.RecordBatch:
    parts, kinds, blobs = zip(*items, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["part", "kind", "blob"])


BLOBS = "part int, kind int, blob binary"
COVERED, LOOK, ASK = 0, 1, 2


def grouped(batches):
    """(part, kind, blobs) of rows sorted by part and kind."""
    at, held = None, []
    for b in batches:
        for part, kind, blob in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True):
            if at != (part, kind):
                if held:
                    yield (*at, held)
                at, held = (part, kind), []
            held.append(blob)
    if held:
        yield (*at, held)


def spans_out(spans: np.ndarray, kind: int, buckets: int) -> list[tuple[int, int, bytes]]:
    return [(b, kind, packed(x)) for b, x in split_by((spans["doc"] ^ spans["tag"].view(np.int64)) % buckets, spans)]


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The range that a hash lies in."""
    return (hashes >> np.uint64(65 - parts.bit_length())).astype(np.int32)


def held_by(least: int, parts: int) -> int:
    """Entries that a task holds before it deals them to so many parts."""
    return max(least, min(MOST_HELD, HOLD_A_PART * parts))


def joined_spans(spans: np.ndarray) -> np.ndarray:
    """Covered spans with neighbours of one document joined."""
    spans = spans[np.lexsort((spans["at"], spans["tag"], spans["doc"]))]
    if len(spans) < 2:
        return spans
    end = spans["at"].astype(np.int64) + spans["cover"]
    same = (spans["doc"][1:] == spans["doc"][:-1]) & (spans["tag"][1:] == spans["tag"][:-1])
    new = np.flatnonzero(np.append(True, ~(same & (spans["at"][1:] <= end[:-1]))))
    out = spans[new]
    out["cover"] = np.maximum.reduceat(end, new) - out["at"]
    return out


def first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order by keys, and which of the sorted begin a new group of all keys but the last."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys[:-1]:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, new


def beaten(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys and doc, starts of groups, and which have a smaller doc in their group."""
    order, new = first_of(*keys, doc)
    group = np.cumsum(new) - 1
    least = doc[order][new]
    return order, new, doc[order] > least[group]


def as_spans(x: np.ndarray, cover=None) -> np.ndarray:
    out = np.zeros(len(x), SPAN)
    for k in ("doc", "tag", "at"):
        out[k] = x[k]
    out["cover"] = x["cover"] if cover is None else cover
    if "anchor" in x.dtype.names:
        out["anchor"] = x["anchor"]
    return out


class Collected:
    """Spans that a task has found, by kind: passed on together, so that there are few blobs."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.spans, self.n = buckets, {COVERED: [], LOOK: []}, 0

    def add(self, kind: int, spans: np.ndarray):
        """Rows to pass on, if there are enough spans now."""
        if len(spans):
            self.spans[kind].append(spans)
            self.n += len(spans)
        if self.n >= HELD_SPANS:
            yield from self.rest()

    def rest(self):
        for kind, held in self.spans.items():
            if held:
                x = np.concatenate(held)
                yield from _rows(spans_out(joined_spans(x) if kind == COVERED else x, kind, self.buckets))
        self.spans, self.n = {COVERED: [], LOOK: []}, 0


def repeated_triggers(rows: DataFrame, bits: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The bitmap of triggers that occur twice, and the hot triggers; a part is a range of hashes and makes its own slice."""
    shift, hold = parts.bit_length() - 1, held_by(2 * HOLD, parts)

    def send(batches):
        held, n = [], 0

        def out():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            often = np.flatnonzero(c >= max(16, n >> 10))
            heavy = np.zeros(len(often), HEAVY)
            heavy["t"], heavy["n"] = u[often], c[often]
            yield from _rows([(p, 1, x.tobytes()) for p, x in split_by(part_of(heavy["t"], parts), heavy)])
            u = np.concatenate([u, u[c > 1]])
            yield from _rows([(p, 0, x.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()) for p, x in split_by(part_of(u, parts), u.astype("<u8"))])
            trim()

        for _, _, _, pieces in pieces_of(batches):
            held.append(phrases(pieces)["t"])
            n += len(held[-1])
            if n >= hold:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    def meet(batches):
        size = 0
        for part, kind, blobs in grouped(batches):
            if kind == 1:
                x = np.sort(np.frombuffer(b"".join(blobs), HEAVY), order="t")
                new = np.flatnonzero(np.append(True, x["t"][1:] != x["t"][:-1]))
                n = np.add.reduceat(x["n"], new)
                hot = x["t"][new][n >= max(HOT, size // HOT_SHARE)]
                if len(hot):
                    yield _batch([(part, 1, hot.tobytes())])
                continue
            six = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
            size = len(six)
            t = np.zeros((size, 8), np.uint8)
            t[:, 2:] = six
            t = np.sort(t.view("<u8").ravel())
            twice = t[1:][t[1:] == t[:-1]]
            slots = np.unique((twice >> np.uint64(64 - bits)) - (np.uint64(part) << np.uint64(bits - shift)))
            slice_ = np.zeros(1 << (bits - shift), np.uint8)
            slice_[slots.astype(np.int64)] = 1
            yield _batch([(part, 0, np.packbits(slice_, bitorder="little").tobytes())])

    sent = rows.mapInArrow(trimmed(send), BLOBS).repartition(partitions(rows.sparkSession), "part").sortWithinPartitions("part", "kind")
    whole, hot = np.zeros(1 << (bits - 3), np.uint8), [np.zeros(0, "<u8")]
    width = len(whole) // parts
    # the slices of the bitmap, and at most HOT_SHARE hot triggers a part
    with once(rows.sparkSession):
        slices = sent.mapInArrow(trimmed(meet), BLOBS).toArrow()
    for b in slices.to_batches():
        for part, kind, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if kind:
                hot.append(np.frombuffer(blob, "<u8"))
            else:
                whole[part * width : (part + 1) * width] = np.frombuffer(blob, np.uint8)
    return whole, np.sort(np.concatenate(hot))


def listed(hot: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Which triggers are hot."""
    if not len(hot):
        return np.zeros(len(t), bool)
    return hot[np.minimum(np.searchsorted(hot, t), len(hot) - 1)] == t


def find_phrases(rows: DataFrame, shared, bits: int, parts: int, buckets: int) -> DataFrame:
    """Blobs by bucket: COVERED spans, and phrases whose windows need a LOOK. shared: the broadcast bitmap and hot triggers."""
    hold = held_by(HOLD // 2, parts)

    def send(batches):
        (seen, hot), held, n, spans = shared.value, [], 0, Collected(buckets)

        def out():
            x = np.concatenate(held)
            order, _, lost = beaten([x["t"], x["e"]], x["doc"])
            x = x[order]
            yield from spans.add(COVERED, joined_spans(as_spans(x[lost])))
            x = x[~lost]
            part = np.where(listed(hot, x["t"]), part_of(mix64(x["e"].copy()), parts), part_of(x["t"], parts))
            yield from _rows([(p, ASK, packed(y)) for p, y in split_by(part, x)])
            trim()

        for docs, tags, bases, pieces in pieces_of(batches):
            got = phrases(pieces)
            slot = (got["t"] >> np.uint64(64 - bits)).astype(np.int64)
            hit = np.flatnonzero((seen[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
            x = np.zeros(len(hit), ENTRY)
            piece = got["piece"][hit]
            x["doc"], x["tag"], x["at"] = docs[piece], tags[piece], got["at"][hit] + bases[piece]
            for k in ("t", "e", "cover", "anchor"):
                x[k] = got[k][hit]
            held.append(x)
            n += len(x)
            if n >= hold:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()
        yield from spans.rest()

    def meet(batches):
        hot, spans = shared.value[1], Collected(buckets)
        for part, kind, blobs in grouped(batches):
            if kind != ASK:
                yield from _rows([(part, kind, b) for b in blobs])
                continue
            x = np.frombuffer(unpacked(blobs), ENTRY)
            order, new, lost = beaten([x["t"], x["e"]], x["doc"])
            x = x[order]
            yield from spans.add(COVERED, as_spans(x[lost]))
            # triggers with several phrases; those of a hot one lie in several parts
            start_t = np.append(True, x["t"][1:] != x["t"][:-1])
            several = np.add.reduceat(new.astype(np.int64), np.flatnonzero(start_t)) > 1
            look = ~lost & (several[np.cumsum(start_t) - 1] | listed(hot, x["t"]))
            yield from spans.add(LOOK, as_spans(x[look]))
            trim()
        yield from spans.rest()

    sent = rows.mapInArrow(trimmed(send), BLOBS).repartition("part", "kind").sortWithinPartitions("part", "kind")
    return sent.mapInArrow(trimmed(meet), BLOBS)


def with_spans(texts: DataFrame, blobs: DataFrame) -> DataFrame:
    """One stream of both by bucket, in each the blobs before the texts."""
    left = texts.withColumns({"__kind": F.lit(1), "__blob": F.lit(None).cast("binary")}).select("__bucket", "__kind", "__blob", *[F.col(f"`{c}`") for c in texts.columns if c != "__bucket"])
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema.fields[3:]]
    right = blobs.select(F.col("part").alias("__bucket"), F.lit(0).alias("__kind"), F.col("blob").alias("__blob"), *nulls)
    return left.union(right).repartition(partitions(texts.sparkSession), "__bucket").sortWithinPartitions("__bucket", "__kind")


class Spans:
    """Spans of the documents of a bucket."""

    def __init__(self, blobs: list[bytes]) -> None:
        x = np.frombuffer(unpacked(blobs), SPAN)
        self.spans = x = x[np.lexsort((x["at"], x["tag"], x["doc"]))]
        new = np.flatnonzero(np.append(True, (x["doc"][1:] != x["doc"][:-1]) | (x["tag"][1:] != x["tag"][:-1]))) if len(x) else np.zeros(0, np.int64)
        ends = np.append(new[1:], len(x))
        self.where = {(d, t): (a, z) for d, t, a, z in zip(x["doc"][new].tolist(), x["tag"][new].tolist(), new.tolist(), ends.tolist(), strict=False)}

    def of(self, doc: int | None, tag: int) -> np.ndarray:
        a, z = self.where.get((doc, tag & ALL), (0, 0))
        return self.spans[a:z]


def met(batches):
    """(rows, Spans) of a stream of with_spans(): texts of one bucket at a time."""
    at, blobs, spans = None, [], None
    for b in batches:
        if not b.num_rows:
            continue
        where = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1)
        starts = np.flatnonzero(np.append(True, (where[1:] != where[:-1]).any(1))).tolist()
        for a, z in zip(starts, [*starts[1:], b.num_rows], strict=True):
            if where[a][0] != at:
                at, blobs, spans = where[a][0], [], None
                trim()
            if where[a][1] == 0:
                blobs += b.column(2).slice(a, z - a).to_pylist()
                continue
            if spans is None:
                spans, blobs = Spans(blobs), []
            yield b.slice(a, z - a), spans


def find_windows(texts: DataFrame, looked: DataFrame, hot: np.ndarray, parts: int, buckets: int) -> DataFrame:
    """Blobs by bucket: COVERED spans of windows that a smaller document holds. hot: the hot triggers."""

    hold = held_by(HOLD // 2, parts)

    def windows(look: np.ndarray, contexts: list[bytes]) -> np.ndarray:
        sizes = np.array([len(c) for c in contexts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        hashes = Hashed(np.frombuffer(b"".join(contexts), np.uint8))
        n = sizes - WINDOW + 1
        which = np.repeat(np.arange(len(contexts)), n)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        x = np.zeros(len(which), WINDOWS)
        x["w"] = hashes.of(starts[which] + offset, WINDOW)
        x["t"] = spread(hashes.of(starts + look["anchor"], TRIGGER))[which]
        x["doc"], x["tag"], x["at"] = look["doc"][which], look["tag"][which], look["at"][which] + offset
        return x

    def send(batches):
        held, n, look, contexts, covered = [], 0, [], [], Collected(buckets)

        def out():
            x = np.concatenate(held)
            order, _, lost = beaten([x["t"], x["w"]], x["doc"])
            x = x[order]
            yield from covered.add(COVERED, joined_spans(as_spans(x[lost], WINDOW)))
            x = x[~lost]
            part = np.where(listed(hot, x["t"]), part_of(x["w"], parts), part_of(x["t"], parts))
            yield from _rows([(p, ASK, packed(y)) for p, y in split_by(part, x)])
            trim()

        for rows, spans in met(batches):
            for d, t, raw in zip(rows.column(3).to_pylist(), rows.column(4).to_pylist(), rows.column(5), strict=True):
                wanted = spans.of(d, t) if d is not None else ()
                if not len(wanted):
                    continue
                text = raw.as_py()
                for s in range(0, len(wanted), CONTEXTS):
                    here = wanted[s : s + CONTEXTS]
                    look.append(here)
                    contexts += [text[a : a + c] for a, c in zip(here["at"].tolist(), here["cover"].tolist(), strict=True)]
                    if len(contexts) >= CONTEXTS:
                        held.append(windows(np.concatenate(look), contexts))
                        n += len(held[-1])
                        look, contexts = [], []
                    if n >= hold:
                        yield from out()
                        held, n = [], 0
        if contexts:
            held.append(windows(np.concatenate(look), contexts))
        if held:
            yield from out()
        yield from covered.rest()

    def meet(batches):
        covered = Collected(buckets)
        for part, kind, blobs in grouped(batches):
            if kind != ASK:
                yield from _rows([(part, kind, b) for b in blobs])
                continue
            x = np.frombuffer(unpacked(blobs), WINDOWS)
            order, _, lost = beaten([x["t"], x["w"]], x["doc"])
            yield from covered.add(COVERED, joined_spans(as_spans(x[order][lost], WINDOW)))
            trim()
        yield from covered.rest()

    sent = with_spans(texts.select("__bucket", "__doc", "__tag", "__data"), looked).mapInArrow(trimmed(send), BLOBS)
    dealt = sent.repartition("part", "kind").sortWithinPartitions("part", "kind")
    return dealt.mapInArrow(trimmed(meet), BLOBS)


def cut(data: bytes, spans: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """What is left of the bytes, and starts and ends of the maximal removed runs. spans: by start."""
    if not len(spans):
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = spans["at"].astype(np.int64)
    end = np.maximum.accumulate(at + spans["cover"])
    new = np.flatnonzero(np.append(True, at[1:] > end[:-1]))
    start, end = at[new], end[np.append(new[1:], len(at)) - 1]
    left = b"".join([data[a:z] for a, z in zip([0, *end.tolist()], [*start.tolist(), len(data)], strict=True)])
    return left, start, end


def _prime(n: int) -> int:
    n = max(n, 7) | 1
    while any(n % d == 0 for d in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


def with_tags(rows: DataFrame) -> DataFrame:
    """rows (__doc, __data) with __tag: the hash of the text where __doc has several rows, or where very many do, of all; else 0."""
    several = written(rows.filter("__doc IS NOT NULL").groupBy("__doc").count().filter("count > 1").select(F.col("__doc").alias("__several")))
    n = several.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return rows.withColumn("__tag", F.lit(0).cast("long"))
    if n > BROADCAST_ROWS:
        return rows.withColumn("__tag", F.xxhash64("__data"))
    found = rows.join(F.broadcast(several), rows["__doc"] == several["__several"], "left")
    return found.withColumn("__tag", F.when(F.col("__several").isNotNull(), F.xxhash64("__data")).otherwise(F.lit(0).cast("long"))).drop("__several")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """keep columns, kept (bytes left of each text) and spans (the removed runs, in bytes of the text).

    as_text: kept is a string, without the bytes of characters that a cut has split.
    """
    spark = tune(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text, "kept", "spans")]
    n = docs.count()
    parts = 1 << max(4, min(MOST_PARTS.bit_length() - 1, (partitions(spark) * 2 - 1).bit_length()))
    bits = max(LEAST_BITS, parts.bit_length() + 3, min(MOST_BITS, n.bit_length() + 9))
    buckets = _prime(n // BUCKET_DOCS)
    data = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    doc = F.col(f"`{key}`").cast("long")
    tagged = with_tags(docs.select(*[F.col(f"`{c}`") for c in keep], doc.alias("__doc"), data.alias("__data")))
    rows = tagged.select("__doc", "__tag", "__data")
    bitmap, hot = repeated_triggers(rows, bits, parts)
    shared = spark.sparkContext.broadcast((bitmap, hot))
    freed(spark)
    found = written(find_phrases(rows, shared, bits, parts, buckets))
    shared.unpersist()
    freed(spark)
    # rows without a key have no spans: they go anywhere
    bucket = F.pmod(F.coalesce(F.col("__doc").bitwiseXOR(F.col("__tag")), F.xxhash64("__data")), F.lit(buckets)).cast("int")
    texts = tagged.select(bucket.alias("__bucket"), "__doc", "__tag", "__data", *[F.col(f"`{c}`") for c in keep])
    more = written(find_windows(texts, found.filter(F.col("kind") == LOOK), hot, parts, buckets))
    freed(spark)
    covered = found.filter(F.col("kind") == COVERED).unionByName(more)
    schema = texts.select(*[F.col(f"`{c}`") for c in keep]).schema.add("kept", "string" if as_text else "binary").add("spans", _span_type())
    kind = pa.string() if as_text else pa.binary()

    def finish(batches):
        for rows, spans in met(batches):
            kept, starts, ends = [], [], []
            for d, t, raw in zip(rows.column(3).to_pylist(), rows.column(4).to_pylist(), rows.column(5), strict=True):
                left, a, z = cut(raw.as_py(), spans.of(d, t))
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
                starts.append(a)
                ends.append(z)
            offsets = np.concatenate([[0], np.cumsum([len(a) for a in starts])])
            runs = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (starts, ends)], ["start", "end"])
            yield pa.RecordBatch.from_arrays([*rows.columns[6:], pa.array(kept, kind), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)], [*keep, "kept", "spans"])

    return with_spans(texts, covered).mapInArrow(trimmed(finish), schema)


def _span_type():
    from pyspark.sql import types as T

    return T.ArrayType(T.StructType().add("start", "long").add("end", "long"))


def op8_repeats(spark, sf_dir: str) -> DataFrame:
    """What is left of every whole text of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    left = remove_repeats(docs.withColumn("n_bytes", n), keep=["doc_id", "n_bytes"])
    return left.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
