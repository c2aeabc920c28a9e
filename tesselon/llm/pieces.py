"""SentencePiece encoding and decoding with a max-plus parallel scan.

The vocabulary is that of a public SentencePiece model; no tokenizer is trained. A
text is segmented as a unigram model does it, by the highest sum of piece scores;
of equal ones that whose last pieces are the longest. The public file holds merge
ranks, not probabilities, so a piece's probability follows Zipf's law in its rank,
1 / ((rank + 1) H) with H the sum of 1 / (rank + 1) over all pieces; scores are the
logarithms as integers of 1/UNIT, so that sums are exact in any order.
A character outside the vocabulary costs the least score less 10 and becomes its
UTF-8 byte pieces. As in the model, a space is put in front and spaces are part of
pieces; a literal U+2581 becomes byte pieces, so decoding returns every text exactly.

Where no piece of the vocabulary holds two neighbouring characters, every
segmentation has a boundary between them. Units between such places repeat, and each
worker keeps the best segmentation of those it has met (up to CACHE_UNITS).

A text of more than GIANT characters is cut anywhere into chunks of CHUNK. A piece
may cross a cut, by 0 to MAX-1 characters: these are the boundary states. Each chunk
gives a transfer matrix in the (max, +) algebra, from the state at its start to the
state at its end; matrices combine associatively, so a prefix scan yields the best
score of every state at every cut. From those, each chunk is segmented by itself,
backtracing from every state at its end, and the chunks of a text are chained from
the last to the first by (end state -> start state). The result equals that of
segmenting the text in one go, ties included.

Defined results: null text encodes as no tokens and is no round trip failure (it
stays null in decoding); empty text has no tokens; repeated rows repeat; null ids
pass; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tesselon.llm import text as T
from tesselon.llm.arrays import ranges
from tesselon.llm.common import bounded, free_name, scratch, table, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNIT = 1024
GIANT, CHUNK = 65_536, 32_768
CACHE_UNITS = 300_000
_NONE = -(1 << 60)
_SMALL = 1024  # characters below have a table of pairs


class Vocabulary:
    """Pieces (a space written as such), their ids and integer scores."""

    def __init__(self, pieces: list[str], ids: list[int], byte_ids: list[int], size: int):
        self.args = (pieces, ids, byte_ids, size)
        self.byte_ids, self.size = byte_ids, size
        whole = math.log(sum(1 / (rank + 1) for rank in range(1, len(pieces) + 1)) or 1)
        self.score = {p: (i, -round(UNIT * (math.log(rank + 1) + whole))) for rank, (p, i) in enumerate(zip(pieces, ids, strict=True), 1)}
        self.unknown = min(s for _, s in self.score.values()) - 10 * UNIT
        self.max = max(map(len, pieces))
        self.text = [b""] * size
        for p, i in zip(pieces, ids, strict=True):
            self.text[i] = p.encode()
        for b, i in enumerate(byte_ids):
            self.text[i] = bytes([b])
        self.starts = {p[:k]: None for p in pieces for k in range(1, len(p))}  # what goes on to a piece
        self.starts.update(self.score)
        self.pairs = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        near = np.zeros((_SMALL, _SMALL), bool)
        wide = np.zeros(1 << 16, bool)
        for a, b in self.pairs:
            if ord(a) < _SMALL and ord(b) < _SMALL:
                near[ord(a), ord(b)] = True
            for c in (a, b):
                wide[min(ord(c), 0xFFFF)] = True
        self.near, self.wide = near.reshape(-1), wide
        self._reset()

    def __reduce__(self):
        return Vocabulary, self.args

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, ids, bytes_ = [], [], [0] * 256
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                bytes_[int(p[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                pieces.append(p.replace("▁", " "))
                ids.append(i)
        return cls(pieces, ids, bytes_, m.get_piece_size())

    # units

    def _reset(self):
        self.code: dict[int, int] = {}
        self.arrays = None
        self.unit_at, self.unit_len, self.unit_score, self.pool = array("q"), array("q"), array("q"), array("i")

    def edges(self, text: str, at: int, end: int):
        """(end, id or None for an unknown character, score) of each piece at a place."""
        for z in range(at + 1, min(end, at + self.max) + 1):
            got = self.starts.get(text[at:z], False)
            if got is False:
                break
            if got is not None:
                yield z, got[0], got[1]
        if text[at] not in self.score:
            yield at + 1, None, self.unknown

    def best(self, text: str, start: int = 0, stop: int | None = None) -> tuple[list[int], int]:
        """(ids, score) of the best segmentation of text[start:stop]."""
        stop = len(text) if stop is None else stop
        starts, unknown = self.starts, self.unknown
        score = [_NONE] * (stop - start + 1)
        score[0] = 0
        back: list = [None] * (stop - start + 1)
        for at in range(start, stop):  # every place is reached: a character is a piece or unknown
            base, k = score[at - start], at - start
            if text[at] not in starts or starts[text[at]] is None:
                if base + unknown > score[k + 1]:
                    score[k + 1], back[k + 1] = base + unknown, (at, None)
            for z in range(at + 1, stop + 1):
                got = starts.get(text[at:z], False)
                if got is False:
                    break
                if got is not None and base + got[1] > score[z - start]:
                    score[z - start], back[z - start] = base + got[1], (at, got[0])
        return self._walk(text, {start + k: b for k, b in enumerate(back) if b}, start, stop), score[-1]

    def _walk(self, text: str, back: dict, start: int, stop: int) -> list[int]:
        out: list[int] = []
        at = stop
        while at > start:
            at, i = back[at]
            out += [i] if i is not None else [self.byte_ids[b] for b in reversed(text[at].encode())]
        return out[::-1]

    def fences(self, points: np.ndarray) -> np.ndarray:
        """True at i > 0 where no piece holds characters i - 1 and i."""
        out = np.zeros(len(points), bool)
        a, b = points[:-1], points[1:]
        small = (a < _SMALL) & (b < _SMALL)
        pair = np.where(small, a * np.uint32(_SMALL) + b, 0)
        out[1:] = np.where(small, ~self.near[pair], ~(self.wide[np.minimum(a, 0xFFFF)] & self.wide[np.minimum(b, 0xFFFF)]))
        return out

    def units(self, text: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The unit number of each stretch [start, end) of text."""
        if len(self.code) > CACHE_UNITS:
            self._reset()
        h = _stretch_hashes(points, starts, ends)
        codes, distinct = pd.factorize(h)
        first = np.zeros(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        number = np.empty(len(distinct), np.int64)
        for k, key in enumerate(distinct.tolist()):
            u = self.code.get(key)
            if u is None:
                a, z = int(starts[first[k]]), int(ends[first[k]])
                self.arrays = None  # arrays grow only while no view of them is held
                ids, score = self.best(text[a:z])
                u = self.code[key] = len(self.unit_at)
                self.unit_at.append(len(self.pool))
                self.unit_len.append(len(ids))
                self.unit_score.append(score)
                self.pool.extend(ids)
            number[k] = u
        return number[codes]

    def unit_arrays(self):
        if self.arrays is None:
            self.arrays = tuple(np.frombuffer(x, np.int64) for x in (self.unit_at, self.unit_len, self.unit_score)) + (np.frombuffer(self.pool, np.int32),)
        return self.arrays

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each text's ids start) of many texts."""
        full = ["" if not t else " " + t for t in texts]
        size = np.fromiter((len(t) for t in full), np.int64, len(full))
        text = "".join(full)
        if not text:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        cut = self.fences(points)
        begins = np.concatenate([[0], np.cumsum(size)])
        cut[begins[:-1][size > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(points))
        u = self.units(text, points, starts, ends)
        at, n, _, pool = self.unit_arrays()
        before = np.concatenate([[0], np.cumsum(n[u])])
        ids = pool[ranges(at[u], n[u])]
        return ids, before[np.searchsorted(starts, begins)]

    @functools.cached_property
    def bytes_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in self.text], np.int64)
        return np.concatenate([[0], np.cumsum(n)[:-1]]), n, np.frombuffer(b"".join(self.text), np.uint8)

    def decode_bytes(self, ids: np.ndarray, starts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of all texts, offsets) of encoded texts, the space in front gone."""
        at, n, pool = self.bytes_table
        raw = pool[ranges(at[ids], n[ids])]
        offsets = np.concatenate([[0], np.cumsum(n[ids])])[starts]
        some = np.flatnonzero(np.diff(offsets) > 0)
        keep = np.ones(len(raw), bool)
        keep[offsets[:-1][some]] = False
        lost = np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
        return raw[keep].tobytes(), offsets - lost

    # chunks of giant texts

    def _middle(self, text: str, n: int):
        """(first fence that no entry state passes, last fence up to n), or None."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        cut = np.flatnonzero(self.fences(points))
        cut = cut[(cut >= self.max - 1) & (cut <= n)]
        return (points, cut) if len(cut) else (points, None)

    def transfer(self, text: str, n: int) -> np.ndarray:
        """The (max, +) matrix of a chunk of n characters; text goes on by up to
        MAX - 1 more. Entry [i, j]: best score from i characters after the chunk's
        start to j after its end, over segmentations with a boundary at both."""
        s = self.max
        points, cut = self._middle(text, n)
        stop = int(cut[0]) if cut is not None else n
        best: dict[int, np.ndarray] = {}
        for k in range(min(s, len(text) + 1)):
            best[k] = np.full(s, _NONE, np.int64)
            best[k][k] = 0
        for at in range(stop):
            v = best.get(at)
            if v is None:
                continue
            for z, _, w in self.edges(text, at, len(text)):
                got = np.where(v > _NONE, v + w, _NONE)
                best[z] = np.maximum(best[z], got) if z in best else got
        out = np.full((s, s), _NONE, np.int64)
        if cut is None:
            for j in range(s):
                if n + j in best and (n + j <= len(text)):
                    out[:, j] = best[n + j]
            return out
        inner = 0
        if len(cut) > 1:
            u = self.units(text, points, cut[:-1], cut[1:])
            inner = int(self.unit_arrays()[2][u].sum())
        head, tail = best[stop], self._tail(text, int(cut[-1]), n)[0]
        for j in range(s):
            w = tail.get(n + j, _NONE)
            if w > _NONE:
                out[:, j] = np.where(head > _NONE, head + inner + w, _NONE)
        return out

    def _tail(self, text: str, start: int, n: int):
        score, back = {start: 0}, {}
        for at in range(start, n):
            base = score.get(at)
            if base is None:
                continue
            for z, i, w in self.edges(text, at, len(text)):
                if base + w > score.get(z, _NONE):
                    score[z], back[z] = base + w, (at, i)
        return score, back

    def backtraces(self, text: str, n: int, entry: np.ndarray):
        """(ids that all share, [(end state, start state, further ids)]) of a chunk
        whose start states have the scores of entry."""
        s = self.max
        points, cut = self._middle(text, n)
        stop = int(cut[0]) if cut is not None else n
        score = {k: int(entry[k]) for k in range(s) if entry[k] > _NONE}
        back: dict[int, tuple[int, int | None]] = {}
        origin = set(score)
        for at in range(stop):
            base = score.get(at)
            if base is None:
                continue
            for z, i, w in self.edges(text, at, len(text)):
                if base + w > score.get(z, _NONE):
                    score[z], back[z] = base + w, (at, i)
                    origin.discard(z)

        def walk(at):
            out = []
            while at not in origin:
                at, i = back[at]
                out += [i] if i is not None else [self.byte_ids[b] for b in reversed(text[at].encode())]
            return at, out[::-1]

        if cut is None:
            return [], [(j, *walk(n + j)) for j in range(s) if n + j in score and n + j <= len(text)]
        k_in, shared = walk(stop)
        if len(cut) > 1:
            u = self.units(text, points, cut[:-1], cut[1:])
            at, size, _, pool = self.unit_arrays()
            shared = shared + pool[ranges(at[u], size[u])].tolist()
        last = int(cut[-1])
        tail, pointers = self._tail(text, last, n)
        return shared, [(j, k_in, self._walk(text, pointers, last, n + j)) for j in range(s) if n + j in tail and n + j <= len(text)]


@functools.cache
def _point_values() -> np.ndarray:
    return T.mix64(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0xA0761D6478BD642F))


def _stretch_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of characters."""
    values = _point_values()[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        values[high] = T.mix64(points[high].astype(np.uint64) + np.uint64(0xE7037ED1A0B428DB))
    up, down = T._powers(1 << max(21, int(len(points)).bit_length()))
    sums = values * up[: len(points)]
    np.cumsum(sums, out=sums)
    sums = np.concatenate([np.zeros(1, np.uint64), sums])
    return T.mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product of stacks of matrices (or of row vectors and matrices)."""
    out = (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)
    return np.maximum(out, _NONE)


def prefix_scan(m: np.ndarray) -> np.ndarray:
    """Inclusive prefix products of a stack of matrices, in log2 steps."""
    out, step = m.copy(), 1
    while step < len(out):
        out[step:] = combine(out[:-step], out[step:])
        step *= 2
    return out


def encode(docs: DataFrame, keep: list[str], vocabulary: Vocabulary, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """The kept columns with n_tokens, token_ids and round_trip (decoding gives
    the text back)."""
    bounded(docs)
    added = ["n_tokens", "token_ids", "round_trip"]
    own = free_name("text", [*keep, *added, "key"])
    base = docs.select(*keep, F.col("text").alias(own))
    small = base.where(F.coalesce(F.length(own) <= giant, F.lit(True)))
    large = base.where(F.length(own) > giant)
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("token_ids", ArrayType(IntegerType())).add("round_trip", "boolean")

    def run(batches):
        for b in T.parts(batches, own):
            col = b.column(own).fill_null("")
            ids, starts = vocabulary.encode(col.to_pylist())
            raw, offsets = T.buffers(col)
            back, where = vocabulary.decode_bytes(ids, starts)
            same = np.ones(len(col), bool)
            if back != raw.tobytes() or not np.array_equal(where, offsets):
                whole = raw.tobytes()
                same = np.array([back[where[i] : where[i + 1]] == whole[offsets[i] : offsets[i + 1]] for i in range(len(col))])
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.diff(starts)), lists, pa.array(same)], names=[*keep, *added])

    short = small.mapInArrow(run, schema)
    giants = encode_giants(large.select(F.col(own).alias("text")), vocabulary, chunk)
    if not giants.limit(1).count():
        return short
    key = free_name("key", [*keep, *added])
    long = large.withColumn(key, F.sha2(F.col(own).cast("binary"), 256)).drop(own).join(giants.withColumnRenamed("key", key), key)
    return short.unionAll(long.select(*[F.col(f"`{c}`") for c in [*keep, *added]]))


def encode_giants(large: DataFrame, vocabulary: Vocabulary, chunk: int = CHUNK) -> DataFrame:
    """key (SHA-256 of the text), n_tokens, token_ids, round_trip of distinct texts. Each
    text is cut in one pass; what is shuffled are chunks."""
    with scratch(large.sparkSession) as keep:
        return written(_encoded_chunks(keep(_chunks(large, vocabulary.max, chunk), "chunks"), vocabulary), "giants")


def _chunks(large: DataFrame, s: int, chunk: int) -> DataFrame:
    """key, c, part (with the s - 1 characters after it), n of the chunks of each text."""

    def cut(batches):
        for b in batches:
            for text in b.column("text").to_pylist():
                key, text = hashlib.sha256(text.encode()).hexdigest(), " " + text
                rows = [(key, c, text[a : a + chunk + s - 1], min(chunk, len(text) - a)) for c, a in enumerate(range(0, len(text), chunk))]
                for i in range(0, len(rows), 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 16], strict=True), (pa.string(), pa.int32(), pa.string(), pa.int32()), strict=True)], names=["key", "c", "part", "n"])

    return large.mapInArrow(cut, "key string, c int, part string, n int").dropDuplicates(["key", "c"])


def _encoded_chunks(chunks: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    s = vocabulary.max

    def matrices(batches):
        for b in batches:
            got = [vocabulary.transfer(t, n).tobytes() for t, n in zip(b.column("part").to_pylist(), b.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("c"), pa.array(got, pa.binary())], names=["key", "c", "m"])

    def scan(batches):
        for b in batches:
            for key, ms in zip(b.column("key").to_pylist(), b.column("ms").to_pylist(), strict=True):
                stack = np.stack([np.frombuffer(x["m"], np.int64).reshape(s, s) for x in sorted(ms, key=lambda x: x["c"])])
                ahead = prefix_scan(stack)[:-1, 0]  # from state 0 at the text's start
                start = np.full(s, _NONE, np.int64)
                start[0] = 0
                entries = [start, *ahead]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(entries)), pa.array(range(len(entries)), pa.int32()), pa.array([np.ascontiguousarray(e).tobytes() for e in entries], pa.binary())], names=["key", "c", "entry"])

    matrix = chunks.mapInArrow(matrices, "key string, c int, m binary")
    entries = matrix.groupBy("key").agg(F.collect_list(F.struct("c", "m")).alias("ms")).mapInArrow(scan, "key string, c int, entry binary")
    traced = "key string, c int, shared array<int>, ends array<struct<j:int,i:int,ids:array<int>>>"

    def trace(batches):
        end = pa.list_(pa.struct([("j", pa.int32()), ("i", pa.int32()), ("ids", pa.list_(pa.int32()))]))
        for b in batches:
            out = [vocabulary.backtraces(t, n, np.frombuffer(e, np.int64)) for t, n, e in zip(b.column("part").to_pylist(), b.column("n").to_pylist(), b.column("entry").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("c"), pa.array([x for x, _ in out], pa.list_(pa.int32())), pa.array([[{"j": j, "i": i, "ids": w} for j, i, w in y] for _, y in out], end)],
                names=["key", "c", "shared", "ends"],
            )

    paths = chunks.join(entries, ["key", "c"]).select("key", "c", "part", "n", "entry").mapInArrow(trace, traced)

    def chain(batches):
        for b in batches:
            keys, n, lists, same = [], [], [], []
            for key, chunks_ in zip(b.column("key").to_pylist(), b.column("ps").to_pylist(), strict=True):
                state, pieces = 0, []
                for p in sorted(chunks_, key=lambda p: -p["c"]):
                    end = next(e for e in p["ends"] if e["j"] == state)
                    pieces += [end["ids"], p["shared"]]
                    state = end["i"]
                ids = np.concatenate([np.array(x, np.int32) for x in reversed(pieces)])
                raw, _ = vocabulary.decode_bytes(ids, np.array([0, len(ids)]))
                keys.append(key)
                n.append(len(ids))
                lists.append(ids)
                same.append(hashlib.sha256(raw).hexdigest() == key)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(n, pa.int64()), pa.array(lists, pa.list_(pa.int32())), pa.array(same, pa.bool_())], names=["key", "n_tokens", "token_ids", "round_trip"])

    return paths.groupBy("key").agg(F.collect_list(F.struct("c", "shared", "ends")).alias("ps")).mapInArrow(chain, "key string, n_tokens long, token_ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, keep: list[str], vocabulary: Vocabulary, column: str = "token_ids") -> DataFrame:
    """The kept columns with text; null ids give null, bytes that are no UTF-8 give
    U+FFFD, ids outside the vocabulary nothing."""
    bounded(encoded)
    schema, own = encoded.select(*keep).schema.add("text", "string"), free_name("ids", [*keep, "text"])

    def run(batches):
        for b in batches:
            col = b.column(own)
            texts = []
            for x in col:
                if not x.is_valid:
                    texts.append(None)
                    continue
                ids = x.values.fill_null(-1).to_numpy(zero_copy_only=False)
                ids = ids[(ids >= 0) & (ids < vocabulary.size)]
                raw, _ = vocabulary.decode_bytes(ids, np.array([0, len(ids)]))
                texts.append(raw.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    return encoded.select(*keep, F.col(column).alias(own)).mapInArrow(run, schema)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, ["doc_id"], Vocabulary.load())
