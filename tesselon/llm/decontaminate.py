"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity with it, so one
signature length can't serve all documents. Documents are partitioned by set size:
partition p holds those with up to 2**p distinct shingles, and their signature has
2**p one-permutation bins (the top p bits of a shingle's hash; each bin keeps its
least hash). Each item is signed at the bins of every partition that occurs. An item
is a candidate for a document if their signatures agree in one bin. A document's bin
holds one shingle on average, so a shared shingle is its bin's least with chance
0.63 or more: an item of 16 shingles contained to 0.8 is missed with chance 3e-6,
and longer ones less. Items with fewer than FEW shingles have as many bins as there
are hashes: each of their shingles is compared with all of the document's.
Only a document's signature is looked up, one hash for each of its bins; candidates are
then verified on the full shingle sets: |item & document| / |item|.

Bins nest: a shingle that is its bin's least at p bits is so at more bits. So the
signatures of an item at all partitions are its shingles, each with the fewest bits at
which it is its bin's least. Tasks store them as sorted arrays in the shared folder, in
shards of about SHARD entries, and the items' sets beside them; the tasks that read
documents map these into memory, search them and verify there. No document is shuffled,
whatever the size of the benchmark, and there is one way for all sizes.

Defined results: shingles are of WIDTH words; an item with fewer words is one
shingle of all its words, searched as such in all documents; items and documents
without words (null, empty) match nothing; repeated items or documents repeat; rows with
a null id are rows like others, found and removed one by one; empty tables give no
rows; other columns are ignored. Nothing depends on order, so there are no ties.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm import arrays
from tesselon.llm import text as T
from tesselon.llm.common import bounded, new_folder, scratch, table

WIDTH, PERCENT, FEW = 5, 80, 16
#: Entries of one shard of the index, about; bits of a worker's filter of hashes at most.
SHARD, FILTER_BITS = 1 << 21, 24
_WHOLE, _NO_ID = 16, 1  # added to the width of items with a bin for each hash; mark of null item ids


def _sets(column, width: int):
    raw, offsets = T.buffers(column)
    hashes, first = T.tokens(raw, offsets)
    return _sets_of(hashes, first, width)


def _sets_of(hashes: np.ndarray, first: np.ndarray, width: int):
    """Distinct shingles by row; rows with fewer words than width have none."""
    rows, out = T.shingles(hashes, first, width)
    full = np.diff(first)[rows] >= width
    return T.distinct_by_row(rows[full], out[full], len(first) - 1)


def _partition(sizes: np.ndarray) -> np.ndarray:
    """p with 2**(p-1) < size <= 2**p."""
    return np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)


def _bin_leasts(sets: np.ndarray, row: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions of the bins' least hashes; sets ascend inside each row."""
    wide = np.minimum(bits[row], 62).astype(np.uint64)
    bins = np.where(wide > 0, sets >> (np.uint64(64) - np.maximum(wide, np.uint64(1))), np.uint64(0))
    first = np.ones(len(sets), bool)
    first[1:] = (row[1:] != row[:-1]) | (bins[1:] != bins[:-1])
    return np.flatnonzero(first)


def _bits(x: np.ndarray) -> np.ndarray:
    """The bit length of each number."""
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])


def _fewest_bits(s: np.ndarray) -> np.ndarray:
    """For each hash of a sorted set, the fewest bits at which it is its bin's least."""
    out = np.zeros(len(s), np.int64)
    out[1:] = 65 - _bits(s[1:] ^ s[:-1])
    return out


_ENTRY = "width int, hash long, least int, owner long, n int, item_id long, mark int"


def item_entries(items: DataFrame) -> DataFrame:
    """A row for each shingle of each item: its width in words (and _WHOLE, where the item has
    a bin for each hash), its hash, the fewest bits at which it is its bin's least, its item's
    row number, size and id."""

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in T.parts(batches, "text"):
            raw, offsets = T.buffers(b.column("text"))
            hashes, first = T.tokens(raw, offsets)
            words, ids, known = np.diff(first), b.column("item_id").fill_null(0).to_numpy(), b.column("item_id").is_valid().to_numpy(zero_copy_only=False)
            for w in np.unique(np.minimum(words[words > 0], WIDTH)):
                sets, starts = _sets_of(hashes, first, int(w))
                pick = np.flatnonzero((words == w) if w < WIDTH else (words >= w))
                got = [sets[starts[i] : starts[i + 1]] for i in pick]
                n = np.array([len(s) for s in got], np.int32)
                least = np.concatenate([_fewest_bits(s) for s in got])
                cols = [np.repeat(np.where(n < FEW, w + _WHOLE, w).astype(np.int32), n), np.concatenate(got).view(np.int64), least.astype(np.int32), np.repeat(row + pick, n), np.repeat(n, n), np.repeat(ids[pick], n), np.repeat(np.where(known[pick], 0, _NO_ID).astype(np.int32), n)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["width", "hash", "least", "owner", "n", "item_id", "mark"])
            row += len(b)

    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _ENTRY)


class Stored(NamedTuple):
    """The folder of an index, the bits that number its shards, and its entries by
    width."""

    folder: str
    bits: int
    widths: dict[int, int]


def store_items(items: DataFrame) -> Stored:
    """Index the items (item_id, text); every shard of every width has a file."""
    spark = items.sparkSession
    folder = new_folder(spark, "items")
    with scratch(spark) as keep:
        entries = keep(item_entries(items), "entries")
        widths = {r["width"]: r["count"] for r in entries.groupBy("width").count().collect()}  # 1 to WIDTH
        bits = max(0, (max(widths.values(), default=0) // SHARD).bit_length())
        number = F.shiftrightunsigned("hash", 64 - bits).cast("int") if bits else F.lit(0)
        every = spark.range(1 << bits).select(F.explode(F.array(*[F.lit(w) for w in widths] or [F.lit(0)])).alias("width"), F.col("id").cast("int").alias("shard"))
        dealt = entries.withColumn("shard", number).unionByName(every.withColumns({"hash": F.lit(0).cast("long"), "least": F.lit(-1), "owner": F.lit(0).cast("long"), "n": F.lit(0), "item_id": F.lit(0).cast("long"), "mark": F.lit(0)}))

        def store(g: pd.DataFrame) -> pd.DataFrame:
            w, s = int(g["width"].iloc[0]), int(g["shard"].iloc[0])
            g = g[g["least"] >= 0]
            h = g["hash"].to_numpy().view(np.uint64)
            order = np.argsort(h, kind="stable")
            kinds = {"least": np.uint8, "owner": np.int64, "n": np.int32, "item_id": np.int64, "mark": np.uint8}
            arrays.save(folder, f"{w}-{s}", {"hash": h[order], **{k: g[k].to_numpy()[order].astype(t) for k, t in kinds.items()}})
            return pd.DataFrame({"n": [len(g)]})

        def store_sets(g: pd.DataFrame) -> pd.DataFrame:
            w, s = int(g["width"].iloc[0]), int(g["shard"].iloc[0])
            h, owner = g["hash"].to_numpy().view(np.uint64), g["owner"].to_numpy()
            order = np.lexsort((h, owner))
            first = np.flatnonzero(np.diff(owner[order], prepend=owner[order[:1]] - 1))
            arrays.save(folder, f"set-{w}-{s}", {"owner": owner[order][first], "start": np.append(first, len(order)), "hash": h[order]})
            return pd.DataFrame({"n": [len(g)]})

        dealt.groupBy("width", "shard").applyInPandas(store, "n long").agg(F.sum("n")).first()
        sets = entries.where(F.col("width") < _WHOLE).select("width", "hash", "owner", _set_shard(F.col("owner"), bits).alias("shard"))
        sets.groupBy("width", "shard").applyInPandas(store_sets, "n long").agg(F.sum("n")).first()
    return Stored(folder, bits, widths)


def _set_shard(owner, bits: int):
    """The shard of an item's set; items are numbered within their tasks."""
    return owner % (1 << bits)


class Index:
    """The stored entries, mapped, and a filter of their hashes for each width."""

    def __init__(self, stored: Stored):
        self.stored, self.files = stored, arrays.Files(stored.folder)
        self.seen: dict[int, np.ndarray] = {}
        for w, n in stored.widths.items():
            seen = np.zeros(1 << min(FILTER_BITS, max(16, (4 * n).bit_length())), bool)
            for s in range(1 << stored.bits):
                seen[self.files[f"{w}-{s}"]["hash"] & np.uint64(len(seen) - 1)] = True
            self.seen[w] = seen

    def find(self, w: int, h: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(places in h, the entries there): every entry of every hash."""
        seen, names = self.seen[w], ("least", "owner", "n", "item_id", "mark")
        maybe = np.flatnonzero(seen[h & np.uint64(len(seen) - 1)])
        shard = (h[maybe] >> np.uint64(64 - self.stored.bits)).astype(np.int64) if self.stored.bits else np.zeros(len(maybe), np.int64)
        which, found = [np.zeros(0, np.int64)], {k: [np.zeros(0, np.int64)] for k in names}
        for s, at in arrays.by_shard(shard):
            held, asked = self.files[f"{w}-{s}"], h[maybe[at]]
            low, high = np.searchsorted(held["hash"], asked), np.searchsorted(held["hash"], asked, side="right")
            hit = np.flatnonzero(high > low)
            place = arrays.ranges(low[hit], high[hit] - low[hit])
            which.append(np.repeat(maybe[at[hit]], high[hit] - low[hit]))
            for k in names:
                found[k].append(held[k][place].astype(np.int64))
        return np.concatenate(which), {k: np.concatenate(v) for k, v in found.items()}

    def leaks(self, column, percent: int):
        """(row, item_id, mark, n_item, n_shared) arrays of the texts of a column, once
        for each width."""
        raw, offsets = T.buffers(column)
        hashes, first = T.tokens(raw, offsets)
        for code in sorted(self.stored.widths):
            w = code % _WHOLE
            sets, starts = _sets_of(hashes, first, w)
            sizes = np.diff(starts)
            row, p = np.repeat(np.arange(len(sizes)), sizes), _partition(sizes)
            bins = np.arange(len(sets)) if code > w else _bin_leasts(sets, row, p)
            which, entry = self.find(code, sets[bins])
            r = row[bins[which]]
            agree = np.ones(len(r), bool) if code > w else entry["least"] <= p[r]
            r, entry = r[agree], {k: v[agree] for k, v in entry.items()}
            if not len(r):
                continue
            order = np.lexsort((entry["owner"], r))
            new = np.flatnonzero(np.concatenate([[True], (np.diff(r[order]) != 0) | (np.diff(entry["owner"][order]) != 0)]))
            one = order[new]
            # with a bin for each hash, agreeing bins are the shared shingles
            shared = np.diff(np.append(new, len(order))) if code > w else self.shared(w, r[one], entry["owner"][one], sets, starts)
            ok = 100 * shared >= percent * entry["n"][one]
            yield r[one][ok], entry["item_id"][one][ok], entry["mark"][one][ok], entry["n"][one][ok], shared[ok]

    def shared(self, w: int, rows: np.ndarray, owners: np.ndarray, sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """How many shingles each candidate's item (owners) and document (rows) share."""
        out = np.zeros(len(rows), np.int64)
        for s, at in arrays.by_shard(_set_shard(owners, self.stored.bits)):
            held = self.files[f"set-{w}-{s}"]
            for i, k in zip(at.tolist(), np.searchsorted(held["owner"], owners[at]).tolist(), strict=True):
                item, mine = held["hash"][held["start"][k] : held["start"][k + 1]], sets[starts[rows[i]] : starts[rows[i] + 1]]
                place = np.minimum(np.searchsorted(mine, item), len(mine) - 1)
                out[i] = np.count_nonzero(mine[place] == item)
        return out


def leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of every document that holds
    percent or more of an item's shingles."""
    bounded(docs)
    stored = store_items(items)

    def run(batches):
        index = Index(stored)
        for b in T.parts(batches, "text"):
            for row, item, mark, n, shared in index.leaks(b.column("text"), percent):
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(row)), pa.array(item, pa.int64(), mask=mark == _NO_ID), pa.array(n), pa.array(shared), pa.array(shared / np.maximum(n, 1))], names=["doc_id", "item_id", "n_item", "n_shared", "containment"]
                )

    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return clean.mapInArrow(run, "doc_id long, item_id long, n_item long, n_shared long, containment double")


def decontaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose text holds no item, decided for each row where it is
    read."""
    bounded(docs)
    stored = store_items(items)

    def run(batches):
        index = Index(stored)
        for b in T.parts(batches, "text"):
            keep = np.ones(len(b), bool)
            for row, *_ in index.leaks(b.column("text"), percent):
                keep[row] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT item_id, least(len(w), 5) AS k, unnest(list_distinct(list_transform(range(0, len(w) - least(len(w), 5) + 1), lambda j: array_to_string(w[j + 1 : j + least(len(w), 5)], ' ')))) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
ks AS (SELECT DISTINCT k FROM i),
h AS (SELECT doc_id, k, unnest(list_distinct(list_transform(range(0, len(w) - k + 1), lambda j: array_to_string(w[j + 1 : j + k], ' ')))) AS s FROM d, ks WHERE len(w) >= k),
m AS (SELECT doc_id, item_id, count(*)::BIGINT AS n_shared FROM h JOIN i USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, n_item::BIGINT AS n_item, n_shared, n_shared::DOUBLE / n_item AS containment
FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""
