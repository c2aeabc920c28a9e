"""Interpolated modified Kneser-Ney model of order 2 or 3 over a whole corpus.

Tokens are 64-bit hashes of lowered words; each text starts at start marks and ends with
an end token. Counting runs in Spark in four steps, each bounded by a shuffle:

1. Each task counts the words of up to FLUSH tokens at a time and sends them to the shard
   of their hash; a shard stores its words, sorted, with their counts. A word's number is
   its place among all shards. Tasks also report pairs of words that make up 1/HEAVY of
   their tokens, so heavy words and pairs of the corpus are known (HEAVY a task at most).
2. Each task counts trigrams of word numbers in sorted arrays and sends them, as
   differences, byte by byte and compressed, to the shard of their middle word; those
   around a heavy word are spread by their first word too, those after a heavy pair by all
   words. So all that starts or ends with a middle word that isn't heavy meets in one
   shard, which stores the trigrams as a sorted hash array, what follows each pair of words
   (left out where that is one token), the bigrams with their numbers of distinct
   predecessors (after the start mark, plain counts), and what follows each word.
3. Bigrams after heavy words, of which each shard has a part, are summed by shards of
   their own, and stored.
4. The numbers of distinct predecessors of words are summed by the shards of step 1.

A shard has about SHARD tokens, so what a task holds doesn't grow with the corpus, and
the model does: every distinct n-gram of the training texts is in it. The arrays lie in
the shared folder; scoring workers map them into memory and search them for a batch of
texts at a time. The driver holds one number for each shard of words, and what follows
heavy words and pairs.

Discounts are estimated from the counts of counts (Chen and Goodman); the unigram
level is the Kneser-Ney continuation distribution, interpolated with the uniform one
over V + 1 words, the last of which stands for all unknown words. At order 2 the same
steps count bigrams as trigrams whose first word is the start mark.

Defined results: null or empty text is one end token; without training texts N and
V are 0, base scores are 0 and so are scores; ids that are null learn and are not
held out; repeated rows count repeatedly; an empty table gives no rows; other columns are
ignored; nothing depends on order, so there are no ties. Two words with one 64-bit hash
count as one. An n-gram that isn't held is taken for one of its shard with chance
8 / 2**32 at most, which only moves its score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm import arrays
from tesselon.llm import text as T
from tesselon.llm.common import bounded, crc_mod, free_name, new_folder, table

ORDER = 3
#: Tokens counted at once (their words have local numbers below 2**21), tokens of a shard.
FLUSH, SHARD = (1 << 21) - 8, 1 << 20
HEAVY = 512
#: Entries in one row that is sent; text scored at once, in bytes.
ROW, SCORED = 1 << 15, 1 << 22
_START = np.uint64(0x5354415254)
_END = np.uint64(0x454E44454E44)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SENT = "dest int, kind int, size int, data binary, key long, f0 long, f1 long, f2 long, f3 long, f4 long"
_NAMES = ["dest", "kind", "size", "data", "key", "f0", "f1", "f2", "f3", "f4"]
# kinds of rows: a mark that a shard exists, packed counts, and numbers that are summed by key
_MARK, _GRAMS, _PARTS, _WORDS, _AFTER_WORD, _AFTER_PAIR, _TRIGRAMS, _BIGRAMS, _UNIGRAMS, _FOLLOWED = range(10)


def _words(column) -> tuple[np.ndarray, np.ndarray]:
    """(tokens with each text's end token, where each text starts)."""
    raw, offsets = T.buffers(column)
    h, first = T.tokens(raw, offsets)
    n = len(first) - 1
    at = first + np.arange(n + 1)
    out = np.empty(len(h) + n, np.uint64)
    word = np.ones(len(out), bool)
    word[at[1:] - 1] = False
    out[word] = h
    out[~word] = _END
    return out, at


def _line(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Tokens with two start marks before each text."""
    n = len(at) - 1
    line = np.full(len(w) + 2 * n, _START, np.uint64)
    line[np.arange(len(w)) + 2 * (np.repeat(np.arange(n), np.diff(at)) + 1)] = w
    return line


def _pair(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A 64-bit key of two word numbers."""
    return T.mix64((u.astype(np.uint64) + np.uint64(1)) * _MULT + v.astype(np.uint64))


def _triple(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return T.mix64(_pair(u, v) * _MULT + w.astype(np.uint64))


def _flushes(batches, column: str):
    """(at most FLUSH tokens with start marks, how many of them were given before): whole
    texts, or parts of a long one that begin with the last two tokens of the part before."""
    held, size = [], 0
    for b in T.parts(batches, column):
        line = _line(*_words(b.column(column)))
        if size and size + len(line) > FLUSH:
            yield np.concatenate(held), 0
            held, size = [], 0
        if len(line) > FLUSH:
            for a in range(2, len(line), FLUSH - 2):
                yield line[a - 2 : a + FLUSH - 2], 2 * (a > 2)
        else:
            held.append(line)
            size += len(line)
    if held:
        yield np.concatenate(held), 0


def _rows(columns: dict[str, list]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = {"dest": pa.int32(), "kind": pa.int32(), "size": pa.int32(), "data": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else pa.nulls(n, kinds.get(c, pa.int64())) for c in _NAMES], names=_NAMES)


def _figures(kind: int, dest: int, keys, *figures) -> pa.RecordBatch:
    """Rows of numbers that are summed by kind and key in the end."""
    n = len(keys)
    return _rows({"dest": [dest] * n, "kind": [kind] * n, "key": np.asarray(keys).tolist(), **{f"f{i}": np.asarray(f).tolist() for i, f in enumerate(figures)}})


def _packed(streams: list[np.ndarray]) -> bytes:
    """Columns of numbers, byte by byte, compressed."""
    planes = b"".join(np.ascontiguousarray(s.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for s in streams)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, 8 * size * n, codec="zstd"), np.uint8).reshape(n, 8, size)
    return [np.ascontiguousarray(s.T).reshape(-1).view("<u8") for s in raw]


def _differences(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted columns as differences from the row before where all columns to the left
    are equal, else as they are."""
    out, same = [], np.ones(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        d = c.copy()
        d[1:][same] -= c[:-1][same]
        out.append(d)
        same = same & (c[1:] == c[:-1])
    return out


def _sums(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The columns that _differences was given."""
    out, new = [], np.zeros(len(columns[0]), bool)
    new[:1] = True
    for d in columns:
        total = np.cumsum(d)
        start = np.flatnonzero(new)
        base = total[start] - d[start]  # wraps like the sums
        c = total - np.repeat(base, np.diff(np.append(start, len(d))))
        out.append(c)
        new = new.copy()
        new[1:] |= c[1:] != c[:-1]
    return out


def _send(kind: int, shard: np.ndarray, columns: list[np.ndarray], n: np.ndarray):
    """Packed rows of sorted columns and their counts, for each shard."""
    for s, at in arrays.by_shard(shard):
        for a in range(0, len(at), ROW):
            part = at[a : a + ROW]
            yield _rows({"dest": [s], "kind": [kind], "size": [len(part)], "data": [_packed([*_differences([c[part] for c in columns]), n[part].astype(np.uint64)])]})


def _received(rows: list[tuple], n: int) -> list[np.ndarray]:
    """Columns and counts of packed rows (size, data); numbers are unsigned."""
    got = [_unpacked(data, size, n + 1) for size, data in rows]
    got = [[*_sums(x[:-1]), x[-1]] for x in got]
    return [np.concatenate([x[i] for x in got]) if got else np.zeros(0, np.uint64) for i in range(n + 1)]


def _by_destination(run, own: int):
    """A function over batches sorted by dest: run(dest, rows of the own kind) for each
    dest; rows of other kinds go on."""

    def each(batches):
        now, held = None, []
        for b in batches:
            dest, kind, size, data = (b.column(c).to_pylist() for c in _NAMES[:4])
            other = [k for k, x in enumerate(kind) if x not in (_MARK, own)]
            if other:
                yield b.take(pa.array(other))
            for d, x, n, raw in zip(dest, kind, size, data, strict=True):
                if x in (_MARK, own):
                    if d != now:
                        if now is not None:
                            yield from run(now, held)
                        now, held = d, []
                    if x == own:
                        held.append((n, raw))
        if now is not None:
            yield from run(now, held)

    return each


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """Rows at their destinations, with a mark for each, so that each shard stores its
    arrays, empty or not."""
    null = lambda c, t: F.lit(None).cast(t).alias(c)
    marks = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("dest"), F.lit(_MARK).alias("kind"), null("size", "int"), null("data", "binary"), *[null(c, "long") for c in _NAMES[4:]])
    return rows.unionAll(marks).repartitionById(n, F.pmod("dest", F.lit(n)).cast("int")).sortWithinPartitions("dest")


def _count_of_counts(n: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(n == k)) for k in range(1, 5)]


def _grouped(key: np.ndarray):
    """(number of each entry's group, places of the groups' first entries), groups in
    order of their keys."""
    codes, kinds = pd.factorize(key)
    order = np.argsort(kinds)
    rank = np.empty(len(kinds), np.int64)
    rank[order] = np.arange(len(kinds))
    first = np.empty(len(kinds), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return rank[codes], first[order]


def _one_two_more(code: np.ndarray, n: np.ndarray, size: int) -> list[np.ndarray]:
    """Numbers of entries of count 1, 2 and more in each group."""
    return [np.bincount(code[x], minlength=size) for x in (n == 1, n == 2, n >= 3)]


class Numbering:
    """Numbers of words: places in the stored shards of words."""

    def __init__(self, folder: str, types: np.ndarray):
        self.files = arrays.Files(folder)
        self.base = np.concatenate([[0], np.cumsum(types)]).astype(np.int64)
        self.start, self.unknown = int(self.base[-1]), int(self.base[-1]) + 1

    def shard(self, h: np.ndarray) -> np.ndarray:
        return (h % np.uint64(len(self.base) - 1)).astype(np.int64)

    def of(self, h: np.ndarray, *columns: str) -> list[np.ndarray]:
        """The number of each hash, and values of its word (0 for unknown ones)."""
        out = [np.full(len(h), self.unknown, np.int64), *(np.zeros(len(h), np.int64) for _ in columns)]
        for s, at in arrays.by_shard(self.shard(h)):
            held = self.files[f"word-{s}"]
            if len(held["w"]):
                p = np.minimum(np.searchsorted(held["w"], h[at]), len(held["w"]) - 1)
                hit = held["w"][p] == h[at]
                out[0][at[hit]] = self.base[s] + p[hit]
                for o, c in zip(out[1:], columns, strict=True):
                    o[at[hit]] = (held if c in held else self.files[f"cont-{s}"])[c][p[hit]]
        out[0][h == _START] = self.start
        return out


class Dealer:
    """Which shard an n-gram belongs to."""

    def __init__(self, shards: int, heavy: np.ndarray, heavy_pairs: np.ndarray):
        self.shards, self.heavy, self.heavy_pairs = shards, heavy, heavy_pairs

    def _mod(self, key: np.ndarray) -> np.ndarray:
        return (key % np.uint64(self.shards)).astype(np.int64)

    def is_heavy(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.int64)
        return self.heavy[np.minimum(np.searchsorted(self.heavy, v), len(self.heavy) - 1)] == v

    def word(self, v: np.ndarray) -> np.ndarray:
        return self._mod(T.mix64(v.astype(np.uint64) + _MULT))

    def pair(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self._mod(_pair(u, v))

    def triple(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = self.word(v)
        spread = np.flatnonzero(self.is_heavy(v))
        key = _pair(u[spread], v[spread])
        more = np.isin(key, self.heavy_pairs)
        key[more] = _triple(u[spread], v[spread], w[spread])[more]
        out[spread] = self._mod(key)
        return out


def count_words(docs: DataFrame, folder: str, parts: int):
    """Store the words by shards; (types of each shard, tokens, counts of counts, heavy
    words and heavy pairs as hashes)."""

    def run(batches):
        for line, old in _flushes(batches, "text"):
            codes, kinds = pd.factorize(line)
            n = np.bincount(codes[old:], minlength=len(kinds))
            word = np.flatnonzero((kinds != _START) & (n > 0))
            order = word[np.argsort(kinds[word])]
            h, k = kinds[order], n[order]
            yield from _send(_GRAMS, (h % np.uint64(parts)).astype(np.int64), [h], k)
            often = n * HEAVY >= len(line)
            at = np.flatnonzero(often[codes[:-1]] & often[codes[1:]])
            pair, m = np.unique(codes[at].astype(np.int64) * len(kinds) + codes[at + 1], return_counts=True)
            pair, m = pair[m * HEAVY >= len(line)], m[m * HEAVY >= len(line)]
            if len(pair):
                yield _figures(_FOLLOWED, 0, kinds[pair // len(kinds)].view(np.int64), m, kinds[pair % len(kinds)].view(np.int64))

    def total(s, held):
        h, n = _received(held, 1)
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        h, n = h[new], np.add.reduceat(n, new) if len(new) else n
        arrays.save(folder, f"word-{s}", {"w": h, "n": n})
        yield _figures(_UNIGRAMS, s, [s], [len(h)], [int(n.sum())])
        top = np.argsort(-n, kind="stable")[:HEAVY]
        yield _figures(_AFTER_WORD, s, h[top].view(np.int64), n[top])

    got = _dealt(docs.select("text").mapInArrow(run, _SENT), parts).mapInArrow(_by_destination(total, _GRAMS), _SENT).persist()
    try:
        shards = {r["key"]: (r["f0"], r["f1"]) for r in got.where(f"kind = {_UNIGRAMS}").select("key", "f0", "f1").collect()}
        tokens = sum(n for _, n in shards.values())
        heavy = [r["key"] for r in got.where(f"kind = {_AFTER_WORD} AND f0 * {HEAVY} >= {tokens}").select("key").collect()]
        pairs = got.where(f"kind = {_FOLLOWED}").groupBy("key", "f1").agg(F.sum("f0").alias("n")).where(f"n * {2 * HEAVY} >= {tokens}").collect()
    finally:
        got.unpersist()
    types = np.array([shards[s][0] for s in range(parts)], np.int64)
    return types, tokens, np.array(heavy, np.int64).view(np.uint64), np.array([(r["key"], r["f1"]) for r in pairs], np.int64).reshape(-1, 2).view(np.uint64)


def store_model(docs: DataFrame, folder: str, order: int = 2) -> dict:
    """Count docs (text) and store the arrays of a model of that order under folder.
    Returns its figures: numbers of tokens, types and n-grams, counts of counts, and what
    follows heavy words and pairs."""
    if order not in (2, 3):
        raise ValueError(f"order {order}: 2 or 3")
    bounded(docs)
    parts = max(8, docs.rdd.getNumPartitions())
    types, tokens, heavy_h, pairs_h = count_words(docs, folder, parts)
    words = Numbering(folder, types)
    start = np.array([words.start], np.int64)
    heavy = np.union1d(words.of(heavy_h)[0], start)
    u, v = words.of(pairs_h[:, 0])[0], words.of(pairs_h[:, 1])[0]
    if order == 2:  # a bigram's pair is the start mark and its first word
        u, v = np.full(len(heavy), words.start), heavy
    pairs = np.unique(np.append(_pair(u, v), _pair(start, start)))
    shards = max(8, -(-tokens // SHARD))
    deal = Dealer(shards, heavy, pairs)

    def count(batches):
        numbering, low = Numbering(folder, types), np.uint64((1 << 21) - 1)
        for line, _ in _flushes(batches, "text"):
            codes, kinds = pd.factorize(line)
            number = numbering.of(kinds)[0]
            by = np.argsort(number)
            rank = np.empty(len(by), np.uint64)
            rank[by] = np.arange(len(by), dtype=np.uint64)
            codes, number = rank[codes], number[by].astype(np.uint64)
            third = np.flatnonzero(line[2:] != _START) + 2
            key = codes[third - 1] << np.uint64(42) | codes[third]
            if order == 3:
                key |= codes[third - 2] << np.uint64(21)
            key.sort()
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            n, key = np.diff(np.append(new, len(key))), key[new]
            v, u, w = (number[(key >> np.uint64(k) & low).astype(np.int64)] for k in (42, 21, 0))
            if order == 2:
                u = np.full(len(v), words.start, np.uint64)
            yield from _send(_GRAMS, deal.triple(u, v, w), [v, u, w], n)

    def sum_trigrams(s, held):
        v, u, w, n = _received(held, 3)
        n = n.astype(np.int64)
        key = _triple(u, v, w)
        by = np.argsort(key)
        new = np.flatnonzero(np.concatenate([[True], np.diff(key[by]) != 0])) if len(by) else np.zeros(0, np.int64)
        n = np.add.reduceat(n[by], new) if len(new) else n
        at = by[new]
        key, u, v, w = key[at], u[at], v[at], w[at]
        arrays.save(folder, f"trigram-{s}", {**arrays.HashArray.arrays(key), **arrays.small_counts("n", n)})
        yield _figures(_TRIGRAMS, s, [0], [len(key)], *([c] for c in _count_of_counts(n)))
        # what follows two words
        pair = _pair(u, v)
        code, first = _grouped(pair)
        after = [np.bincount(code, weights=n, minlength=len(first)).astype(np.int64), *_one_two_more(code, n, len(first))]
        hot = np.isin(pair[first], deal.heavy_pairs)
        kept = np.flatnonzero(~hot & (after[0] > 1))
        arrays.save(folder, f"pair-{s}", {**arrays.HashArray.arrays(pair[first][kept]), **{k: x for name, a in zip("tabc", after, strict=True) for k, x in arrays.small_counts(name, a[kept]).items()}})
        hot = np.flatnonzero(hot)
        yield _figures(_AFTER_PAIR, s, pair[first][hot].view(np.int64), *(a[hot] for a in after))
        # bigrams and what follows a word
        common = deal.is_heavy(v)
        yield from sum_bigrams(s, v[~common], w[~common], np.ones(np.count_nonzero(~common), np.int64), "bigram")
        v, w, n = v[common], w[common], np.where(v[common] == words.start, n[common], 1)
        by = np.lexsort((w, v))
        v, w, n = v[by], w[by], n[by]
        new = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])) if len(v) else np.zeros(0, np.int64)
        if len(new):
            yield from _send(_PARTS, deal.pair(v[new], w[new]), [v[new], w[new]], np.add.reduceat(n, new))

    def sum_bigrams(s, v, w, n, name):
        code, first = _grouped(_pair(v, w))
        cont = np.bincount(code, weights=n, minlength=len(first)).astype(np.int64)
        arrays.save(folder, f"{name}-{s}", {**arrays.HashArray.arrays(_pair(v[first], w[first])), **arrays.small_counts("n", cont)})
        yield _figures(_BIGRAMS, s, [0], [len(first)], *([c] for c in _count_of_counts(cont)))
        v, w = v[first], w[first]
        code, first = _grouped(v)
        after = [np.bincount(code, weights=cont, minlength=len(first)).astype(np.int64), *_one_two_more(code, cont, len(first))]
        if name == "bigram":
            arrays.save(folder, f"after-{s}", {"v": v[first].astype(np.int64), **dict(zip("tabc", after, strict=True))})
        else:
            yield _figures(_AFTER_WORD, s, v[first].astype(np.int64), *after)
        kinds, n = np.unique(w, return_counts=True)
        yield from _send(_WORDS, np.searchsorted(words.base, kinds.astype(np.int64), side="right") - 1, [kinds], n)

    def sum_heavy(s, held):
        v, w, n = _received(held, 2)
        yield from sum_bigrams(s, v, w, n.astype(np.int64), "heavy")

    def sum_words(s, held):
        w, n = _received(held, 1)
        cont = np.bincount(w.astype(np.int64) - words.base[s], weights=n, minlength=int(types[s])).astype(np.int64)
        arrays.save(folder, f"cont-{s}", {"cont": cont})
        yield _figures(_UNIGRAMS, s, [0], *([c] for c in _count_of_counts(cont)), [int(np.count_nonzero(cont >= 3))])

    one = _dealt(docs.select("text").mapInArrow(count, _SENT), shards).mapInArrow(_by_destination(sum_trigrams, _GRAMS), _SENT)
    two = _dealt(one, shards).mapInArrow(_by_destination(sum_heavy, _PARTS), _SENT)
    three = _dealt(two, parts).mapInArrow(_by_destination(sum_words, _WORDS), _SENT)
    figures = [f"f{i}" for i in range(5)]
    got = three.groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in figures]).collect()
    rows = {kind: [(r["key"], *(r[c] or 0 for c in figures)) for r in got if r["kind"] == kind] for kind in range(_FOLLOWED)}
    one_row = lambda kind: next(iter(rows[kind]), (0,) * 6)[1:]

    def hot(kind, dtype):
        names = np.array([r[0] for r in rows[kind]], np.int64).view(dtype)
        return np.sort(names), np.array([r[1:5] for r in rows[kind]], np.int64).reshape(-1, 4)[np.argsort(names)]

    trigrams, bigrams, unigrams = one_row(_TRIGRAMS), one_row(_BIGRAMS), one_row(_UNIGRAMS)
    return {
        "order": order, "folder": folder, "types": types, "n": int(tokens), "shards": shards, "heavy": heavy, "pairs": pairs,
        "trigrams": trigrams[0], "trigram_counts": list(trigrams[1:]), "bigrams": bigrams[0], "bigram_counts": list(bigrams[1:]),
        "word_counts": list(unigrams[:4]), "words_by": [unigrams[0], unigrams[1], unigrams[4]],
        "after_word": hot(_AFTER_WORD, np.int64), "after_pair": hot(_AFTER_PAIR, np.uint64),
    }


def discounts(counts: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from the counts of counts 1-4."""
    n1, n2, n3, n4 = counts
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))])


class Model:
    """The stored arrays of a model, mapped as they are needed."""

    def __init__(self, figures: dict):
        self.f = figures
        self.words = Numbering(figures["folder"], figures["types"])
        self.files = self.words.files
        self.deal = Dealer(figures["shards"], figures["heavy"], figures["pairs"])
        self.d1, self.d2, self.d3 = (discounts(figures[f"{k}_counts"]) for k in ("word", "bigram", "trigram"))
        self.total = max(1, figures["bigrams"])
        self.uniform = float(self.d1[1:] @ np.array(figures["words_by"])) / self.total / (len(self) + 1) if figures["bigrams"] else 1.0

    def __len__(self):
        return self.words.start

    def _counts(self, name: str, shard: np.ndarray, key: np.ndarray, columns: str) -> list[np.ndarray]:
        out = [np.zeros(len(key), np.int64) for _ in columns]
        for s, at in arrays.by_shard(shard):
            held = self.files[f"{name}-{s}"]
            place = arrays.HashArray.find(held, key[at])
            for o, c in zip(out, columns, strict=True):
                o[at] = arrays.counts_at(held, c, place)
        return out

    @staticmethod
    def _with_hot(key: np.ndarray, out: list[np.ndarray], hot: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        names, values = hot
        if len(names):
            p = np.minimum(np.searchsorted(names, key), len(names) - 1)
            hit = np.flatnonzero(names[p] == key)
            for k, o in enumerate(out):
                o[hit] = values[p[hit], k]
        return out

    def after_words(self, v: np.ndarray) -> list[np.ndarray]:
        """(total, n1, n2, n3) of what follows each word."""
        out = [np.zeros(len(v), np.int64) for _ in range(4)]
        for s, at in arrays.by_shard(self.deal.word(v)):
            held = self.files[f"after-{s}"]
            if len(held["v"]):
                p = np.minimum(np.searchsorted(held["v"], v[at]), len(held["v"]) - 1)
                hit = held["v"][p] == v[at]
                for o, c in zip(out, "tabc", strict=True):
                    o[at[hit]] = held[c][p[hit]]
        return self._with_hot(v, out, self.f["after_word"])

    def bigrams(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        out, key, common = np.zeros(len(v), np.int64), _pair(v, w), self.deal.is_heavy(v)
        for name, at in (("bigram", np.flatnonzero(~common)), ("heavy", np.flatnonzero(common))):
            out[at] = self._counts(name, self.deal.word(v[at]) if name == "bigram" else self.deal.pair(v[at], w[at]), key[at], "n")[0]
        return out

    def after_pairs(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, seen: np.ndarray) -> list[np.ndarray]:
        """(total, n1, n2, n3) of what follows two words; those that are seen and not
        stored are followed by one token."""
        key = _pair(u, v)
        out = self._counts("pair", self.deal.triple(u, v, w), key, "tabc")
        once = (out[0] == 0) & seen
        out[0][once] = out[1][once] = 1
        return self._with_hot(key, out, self.f["after_pair"])

    def score(self, h: np.ndarray, at: np.ndarray):
        """(known, base, log10 p) of each token; texts start at at[:-1]."""
        codes, kinds = pd.factorize(h)
        if not self.f["n"]:
            return np.zeros(len(h), bool), np.zeros(len(h)), np.zeros(len(h))
        number, n, cont = self.words.of(kinds, "n", "cont")
        base = np.log10((n + 0.1) / (self.f["n"] + 0.1 * (len(self) + 1)))
        low = np.maximum(cont - self.d1[np.minimum(cont, 3)], 0) / self.total + self.uniform
        w, p = number[codes], low[codes]
        v, u = np.full(len(w), self.words.start), np.full(len(w), self.words.start)
        inner = np.ones(len(w), bool)
        inner[at[:-1]] = False
        v[inner] = w[np.flatnonzero(inner) - 1]
        if self.f["order"] == 3:
            u[inner] = v[np.flatnonzero(inner) - 1]
            known = (v != self.words.unknown) & (w != self.words.unknown)
            seen = np.zeros(len(w), np.int64)
            seen[known] = self.bigrams(v[known], w[known])
            which, each = pd.factorize(v)
            p = self._mixed(seen, [x[which] for x in self.after_words(each)], self.d2, p)
            before = np.zeros(len(w), bool)  # whether the two words before were seen together
            before[inner] = (seen > 0)[np.flatnonzero(inner) - 1]
        else:
            before = np.zeros(len(w), bool)
            before[inner] = (n > 0)[codes][np.flatnonzero(inner) - 1]
        known = (u != self.words.unknown) & (v != self.words.unknown)
        after = [np.zeros(len(w), np.int64) for _ in range(4)]
        for o, x in zip(after, self.after_pairs(u[known], v[known], w[known], before[known]), strict=True):
            o[known] = x
        known &= w != self.words.unknown
        seen = np.zeros(len(w), np.int64)
        seen[known] = self._counts("trigram", self.deal.triple(u[known], v[known], w[known]), _triple(u[known], v[known], w[known]), "n")[0]
        return (n > 0)[codes], base[codes], np.log10(self._mixed(seen, after, self.d3, p))

    @staticmethod
    def _mixed(seen: np.ndarray, after: list[np.ndarray], d: np.ndarray, lower: np.ndarray) -> np.ndarray:
        total, n1, n2, n3 = after
        all_ = np.maximum(total, 1)
        rest = np.where(total > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / all_, 1.0)
        return np.where(total > 0, np.maximum(seen - d[np.minimum(seen, 3)], 0) / all_, 0.0) + rest * lower


def _gathered(batches, column: str, least: int):
    """Batches of at least so many bytes, joined from smaller ones."""
    held, size = [], 0
    for b in T.parts(batches, column):
        held.append(b)
        size += b.nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def score_texts(docs: DataFrame, figures: dict, keep: list[str]) -> DataFrame:
    """The kept columns with n_tokens, n_known, train_tokens, base_score, score."""
    bounded(docs)
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = docs.select(*keep).schema
    for c in added:
        schema = schema.add(c, "double" if c in ("base_score", "score") else "long")
    own = free_name("text", [*keep, *added])

    def run(batches):
        model = Model(figures)
        for b in _gathered(batches, own, SCORED):
            w, at = _words(b.column(own))
            known, base, score = model.score(w, at)
            sums = [np.add.reduceat(x, at[:-1]) for x in (known.astype(np.int64), base, score)]
            cols = [np.diff(at), sums[0], np.full(len(at) - 1, figures["n"], np.int64), sums[1], sums[2]]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *map(pa.array, cols)], names=[*keep, *added])

    return docs.select(*keep, F.col("text").alias(own)).mapInArrow(run, schema)


def op3_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False)).alias("held_out"))
    figures = store_model(docs.where("NOT held_out"), new_folder(spark, "ngrams"), ORDER)
    return score_texts(docs, figures, ["doc_id", "held_out"])
