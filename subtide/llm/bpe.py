"""BPE encoding and decoding.

Encoding takes the longest token matches of one Aho-Corasick pass over a word and checks each against the one
before it in a table of compatible pairs; where a pair is not compatible, it goes on to the next shorter match at the
place and, after the last, steps back. Two neighbours are compatible if byte-pair merging of their concatenation gives
the two back, which the formation order along the right edge of one and the left edge of the other decides. A prefix
of a word has one such tokenization, so a position that failed once is never tried again: the walk is linear and its
result equals exact merging. Decoding gathers the bytes of all ids of a batch from one blob of token texts by an
offset table; it makes no Python object a token.

Null text counts as empty; empty text has no ids and decodes to "". Repeated rows give repeated results, an empty
table an empty one.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from subtide.llm.common import table, trimmed, tune

#: Distinct chunks, words and pairs whose results a task keeps, and those that it keeps from before; only saves time.
CACHE_CHUNKS, CACHE_WORDS, CACHE_PAIRS = 120_000, 60_000, 250_000
#: Bytes of results in one Arrow batch; ids that are gathered at once.
BATCH_BYTES, GATHER = 4 << 20, 1 << 17
INFINITE = 1 << 62
PAIR = 1 << 32


def byte_letters() -> dict[str, int]:
    """Printable letter of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


@dataclass
class Spec:
    """What the tables are built from: small, sent to every worker once."""

    tokens: list[str]
    merges: list[tuple[str, str]]
    special: dict[str, int]
    suffix: str
    split: str

    @staticmethod
    def read(path: str) -> "Spec":
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or whole.get("decoder") or not model.get("end_of_word_suffix"):
            raise ValueError(f"{path}: only byte-level BPE with word ends and without a decoder is known")
        special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        size = max([*model["vocab"].values(), *special.values()]) + 1
        tokens = [""] * size
        for text, n in [*model["vocab"].items(), *special.items()]:
            tokens[n] = text
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        split = next(p["pattern"]["Regex"] for p in whole["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        return Spec(tokens, merges, special, model["end_of_word_suffix"], split)


class Kept(dict):
    """A bounded cache: when it is full it becomes the older half, of which what is asked for comes back."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.older = most, {}

    def found(self, key):
        """The result of a key that is not in the newer half."""
        got = self.older.get(key)
        if got is not None:
            self.keep(key, got)
        return got

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value

    def forget(self) -> None:
        self.clear()
        self.older = {}


@dataclass
class Coder:
    spec: Spec
    _chunks: Kept = field(default_factory=lambda: Kept(CACHE_CHUNKS))
    _words: Kept = field(default_factory=lambda: Kept(CACHE_WORDS))
    _pairs: Kept = field(default_factory=lambda: Kept(CACHE_PAIRS))

    def __post_init__(self) -> None:
        letters, end = byte_letters(), self.spec.suffix
        special = set(self.spec.special.values())

        def packed(token: str) -> str:
            """One letter a byte; that of a word's last byte is 256 higher."""
            last = token.endswith(end)
            body = [letters[c] for c in (token[: -len(end)] if last else token)]
            return "".join(map(chr, body[:-1])) + chr(body[-1] + 256 * last) if body else ""

        ids = {t: n for n, t in enumerate(self.spec.tokens) if n not in special}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(self.spec.merges):
            whole = a + b
            left, right, to = ids[a], ids[b], ids[whole]
            self.rank.setdefault((left, right), r)
            self.made.setdefault(to, (left, right, r))
        # edge[t]: tokens at t's edge from its last step back to a single letter, with the step that forms each
        self.right_edge, self.left_edge = {}, {}
        for n in ids.values():
            self._edge(n)
        self.machine = ahocorasick.Automaton()
        found: dict[str, tuple[int, int]] = {}
        for text, n in ids.items():
            if text != end and self._reachable(n) and (key := packed(text)):
                found[key] = (len(key), n)
        # shorter[t]: the longest other token that t begins with
        self.shorter: list[tuple[int, int] | None] = [None] * len(self.spec.tokens)
        for key, match in found.items():
            self.machine.add_word(key, match)
            self.shorter[match[1]] = next((found[key[:k]] for k in range(match[0] - 1, 0, -1) if key[:k] in found), None)
        self.machine.make_automaton()
        self.split = regex.compile(self.spec.split)
        self.splitter = pre_tokenizers.Split(Regex(self.spec.split), "removed", invert=True)
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.spec.special, key=len, reverse=True))) + ")") if special else None

    def forget(self) -> None:
        """Lets kept results go."""
        for kept in (self._chunks, self._words, self._pairs):
            kept.forget()

    def _edge(self, n: int) -> None:
        for edges, side in ((self.right_edge, 1), (self.left_edge, 0)):
            steps, at = [], n
            while at in self.made:
                steps.append((at, self.made[at][2]))
                at = self.made[at][side]
            edges[n] = [(at, -1), *reversed(steps)]

    def _first_cross(self, a: int, b: int) -> tuple[int, bool]:
        """The first merge over the border of a and b while both form (INFINITE: none), and whether both were whole."""
        left, right, i, j = self.right_edge[a], self.left_edge[b], 0, 0
        while True:
            next_i = left[i + 1][1] if i + 1 < len(left) else INFINITE
            next_j = right[j + 1][1] if j + 1 < len(right) else INFINITE
            r = self.rank.get((left[i][0], right[j][0]), INFINITE)
            # of equal steps the left one is done first
            if r < next_i and r <= next_j:
                return r, next_i == next_j == INFINITE
            if next_i == next_j == INFINITE:
                return INFINITE, True
            if next_i <= next_j:
                i += 1
            else:
                j += 1

    def _reachable(self, n: int) -> bool:
        """Whether merging the token's own letters gives the token; others can't occur in a result."""
        todo = [n]
        while todo:
            at = todo.pop()
            if at in self.made:
                a, b, r = self.made[at]
                if self._first_cross(a, b) != (r, True):
                    return False
                todo += [a, b]
        return True

    def compatible(self, a: int, b: int) -> bool:
        key = a * PAIR + b
        got = self._pairs.get(key)
        if got is None and (got := self._pairs.found(key)) is None:
            got = self._first_cross(a, b)[0] == INFINITE
            self._pairs.keep(key, got)
        return got

    def merged(self, word: str) -> list[int]:
        """Ids of one word."""
        raw = word.encode()
        text = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        # the longest token from each place on; neighbours that are all compatible make the one right result
        chosen, last, at, pairs = [], -1, 0, self._pairs
        for end, match in self.machine.iter_long(text):
            size, n = match
            if end + 1 - size != at:
                raise ValueError("a letter of the word is not in the vocabulary")
            if at:
                ok = pairs.get(last * PAIR + n)
                if ok is False or ok is None and not self.compatible(last, n):
                    return self._walked(text, chosen, at, n)
            chosen.append(match)
            last, at = n, end + 1
        if at != len(text):
            raise ValueError("a letter of the word is not in the vocabulary")
        return [n for _, n in chosen]

    def _walked(self, text: str, chosen: list[tuple[int, int]], at: int, failed: int) -> list[int]:
        """Goes on from the place where a match failed, taking the next shorter match there or stepping back."""
        whole, compatible, shorter, longest, dead = len(text), self.compatible, self.shorter, self.machine.iter_long, set()
        match = shorter[failed]
        while at < whole:
            while match:
                size, n = match
                if at + size not in dead and (not chosen or compatible(chosen[-1][1], n)):
                    chosen.append(match)
                    at += size
                    match = next(longest(text, at))[1] if at < whole else None
                    break
                match = shorter[n]
            else:
                if not chosen:
                    raise ValueError("a letter of the word is not in the vocabulary")
                dead.add(at)
                size, n = chosen.pop()
                at -= size
                match = shorter[n]
        return [n for _, n in chosen]

    def _word(self, word: str) -> bytes:
        """Ids of one word, as little-endian 32-bit integers."""
        got = self._words.get(word)
        if got is None and (got := self._words.found(word)) is None:
            ids = self.merged(word)
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) <= 64:
                self._words.keep(word, got)
        return got

    def _chunk(self, chunk: str) -> bytes:
        """Ids of text without white space."""
        if chunk.isascii():
            chunk = chunk.lower()
            if chunk.isalpha():
                return self._word(chunk)
            words = self.split.findall(chunk)
        elif max(chunk) < "\u0250":  # no letter here changes under NFC
            words = self.split.findall(chunk.lower())
        else:  # letters newer than this Python's tables are known to the library
            words = [w for w, _ in self.splitter.pre_tokenize_str(self.normal.normalize_str(chunk))]
        return b"".join(map(self._word, words))

    def _plain(self, text: str) -> bytes:
        # str.split() also splits at four control characters that the vocabulary's white space lacks
        chunks = regex.split(r"[^\S\x1c-\x1f]+", text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        known = self._chunks
        out = list(map(known.get, chunks))
        if None in out:
            for n, (c, got) in enumerate(zip(chunks, out, strict=True)):
                if got is None:
                    got = known.get(c)  # it may have come before in this text
                    if got is None and (got := known.found(c)) is None:
                        got = self._chunk(c)
                        if len(c) <= 64:
                            known.keep(c, got)
                    out[n] = got
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.specials is None or not self.specials.search(text):
            return self._plain(text)
        ids = self.spec.special
        return b"".join(np.array([ids[p]], "<u4").tobytes() if p in ids else self._plain(p) for p in self.specials.split(text))


class Decoder:
    """Token texts in one blob, each with a space behind it, and an offset table; needs none of the encoder's tables."""

    def __init__(self, spec: Spec) -> None:
        texts = [t.encode() + b" " for t in spec.tokens]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        self.sizes = np.diff(self.offsets)
        self.blob = np.frombuffer(b"".join(texts), np.uint8)

    def texts(self, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows' texts, and where each begins (and the last ends). counts: ids of each row."""
        sizes = self.sizes[ids]
        last = np.cumsum(counts)[counts > 0] - 1
        sizes[last] -= 1  # no space behind a row's last token
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        for a in range(0, len(ids), GATHER):
            size = sizes[a : a + GATHER]
            begin = ends[a : a + GATHER] - size
            n = int(size.sum())
            shift = np.repeat(self.offsets[ids[a : a + GATHER]] - begin, size)
            out[begin[0] : begin[0] + n] = self.blob[np.arange(begin[0], begin[0] + n) + shift]
        row_ends = np.zeros(len(counts) + 1, np.int64)
        row_ends[1:] = np.append(ends, 0)[np.cumsum(counts) - 1] if len(ends) else 0
        return out, np.maximum.accumulate(row_ends)

    def decode(self, ids: bytes | None) -> bytes:
        one = np.frombuffer(ids or b"", "<u4").astype(np.int64)
        return self.texts(np.array([len(one)]), one)[0].tobytes()


_MADE: dict[tuple[str, type], Coder | Decoder] = {}


def _made(kind: type, path: str, shared):
    """The worker's coder or decoder, built once from the broadcast vocabulary."""
    if (path, kind) not in _MADE:
        _MADE[path, kind] = kind(shared.value)
    return _MADE[path, kind]


def _encoded(coder: Coder, batch: pa.RecordBatch, at: int):
    """(first row, ids of some rows) of a batch, until it is done."""
    done, size, start = [], 0, 0
    for n, value in enumerate(batch.column(at)):
        done.append(coder.encode(value.as_py()))
        size += len(done[-1])
        if size >= BATCH_BYTES:
            yield start, pa.array(done, pa.binary())
            done, size, start = [], 0, n + 1
    if done:
        yield start, pa.array(done, pa.binary())


def _decoded(decoder: Decoder, ids: pa.Array) -> pa.Array:
    """Texts of an array of ids."""
    ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
    data = ids.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    out, where = decoder.texts(np.diff(ends) // 4, np.frombuffer(flat.tobytes(), "<u4").astype(np.int64))
    return pa.StringArray.from_buffers(len(ids), pa.py_buffer(where.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes()))


def _mapped(df: DataFrame, column: str, path: str, keep: list[str], to: list[tuple[str, str]]) -> DataFrame:
    """df's keep columns and, named by to, (ids) or (decoded) or both of each value of column, a text or ids."""
    spark = df.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(Spec.read(path))
    value = F.col(f"`{column}`")
    kinds = [kind for _, kind in to]
    if "ids" not in kinds:
        value = F.coalesce(value, F.lit(b""))
    plain = df.select(*[F.col(f"`{c}`") for c in keep], value.alias("__value"))
    schema = plain.drop("__value").schema
    for name, kind in to:
        schema = schema.add(name, "binary" if kind == "ids" else "string")

    def run(batches):
        coder = _made(Coder, path, shared) if "ids" in kinds else None
        decoder = _made(Decoder, path, shared) if "decoded" in kinds else None
        try:
            for batch in batches:
                at = batch.num_columns - 1
                made = _encoded(coder, batch, at) if coder else [(0, batch.column(at))] if batch.num_rows else []
                for start, ids in made:
                    new = {"ids": ids} | ({"decoded": _decoded(decoder, ids)} if decoder else {})
                    rest = [batch.column(n).slice(start, len(ids)) for n in range(at)]
                    yield pa.RecordBatch.from_arrays([*rest, *[new[k] for k in kinds]], schema.fieldNames())
        finally:
            if coder:
                coder.forget()

    return plain.mapInArrow(trimmed(run), schema)


def encode(df: DataFrame, path: str, text: str = "text", to: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds the ids of each whole text as little-endian 32-bit integers; keep: columns that stay (default: all others)."""
    keep = [c for c in df.columns if c not in (text, to)] if keep is None else keep
    return _mapped(df, text, path, keep, [(to, "ids")])


def decode(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds the text of each row's ids; special tokens stay, null ids count as none."""
    keep = [c for c in df.columns if c != to] if keep is None else keep
    return _mapped(df, ids, path, keep, [(to, "decoded")])


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds the ids of each whole text and the text that they decode to, in one pass."""
    keep = [c for c in df.columns if c not in (text, ids, decoded)] if keep is None else keep
    return _mapped(df, text, path, keep, [(ids, "ids"), (decoded, "decoded")])


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Round trip of every whole text of documents, as digests."""
    path = path or vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = round_trip(docs, path)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
