"""Exact top-k inner-product search in norm-sorted slabs.

Candidates are range-partitioned by descending length into slabs of at most
SLAB_ROWS vectors. Every query meets the LEAD_BYTES of longest vectors first, which gives
it a lower bound on its k-th score. By Cauchy-Schwarz |q| * (longest vector of a slab)
bounds all scores in it, so a query needs the slabs down to the length bound / |q| only;
queries are range-partitioned by that length into groups, so those that need many slabs
stand together. A unit of work is one slab and one group: the slab is sent once, the
queries that need it follow in chunks of CHUNK_BYTES, and no row holds more. Inside a
slab each query stops at the first vector too short for it. What is left is rotated by
the right singular vectors of a sample, so that a few leading components carry most of
each product: partial product + |rest of q| * |rest of c| bounds the score, and only
pairs whose bound reaches the query's k-th score are multiplied out. Bounds carry a
margin for rounding, and products are exact integers.

Where components are so large that floating-point sums of products would not be exact, a
unit is multiplied in floating point with a bound on its error, and only pairs that
reach the query's k-th score within it are multiplied out in Python's integers.

The rotation is fitted on at most SAMPLE_ROWS vectors (SAMPLE_BYTES in memory); it
changes speed only. Sent to all workers: the rotation, the longest vectors, and the
lengths of the slabs (8 bytes for each SLAB_ROWS vectors). The driver holds the last and
one length for each GROUP_ROWS queries.

Defined results: a vector that is null or has a null or non-finite component, and a null
id, take no part; shorter vectors are padded with zeros; ties go to the smaller id; a
query never meets rows of its own id; repeated rows of one id are candidates each, and
queries of one id are asked together; scores beyond the range of a long are ranked as
they are and shown as its nearest end; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tesselon.llm.common import bounded, scratch, side, table, written

SLAB_ROWS, GROUP_ROWS = 4096, 8192
CHUNK_BYTES, LEAD_BYTES = 1 << 16, 2 << 20
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 16 << 20
LEAD = 4  # one component in LEAD belongs to the partial product


def component_vectors(rows: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, norm and big (of the scaled floors), d, v (components as they are,
    little-endian) of the rows that take part."""

    def run(batches):
        for b in batches:
            ids, vec = b.column("i"), b.column("v")
            keep = [k for k, ok in enumerate(zip(ids.is_valid().to_pylist(), vec.is_valid().to_pylist(), strict=True)) if all(ok)]
            out: tuple[list, ...] = ([], [], [], [], [])
            for k in keep:
                x = vec[k].values
                if x.null_count:
                    continue
                x = x.to_numpy(zero_copy_only=False).astype("<f8")
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    y = np.floor(scale * x)
                    size = float(np.linalg.norm(y))
                for col, value in zip(out, (ids[k].as_py(), size, float(np.abs(y).max(initial=0)), len(x), x.tobytes()), strict=True):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.binary()), strict=True)], names=["vec_id", "norm", "big", "d", "v"])

    return rows.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, norm double, big double, d int, v binary")


class Numbers:
    """How components are stored: as scaled floors in few bytes where all products are
    exact in floating point, else as they are."""

    def __init__(self, scale: int, d: int, big: float):
        self.scale, self.d = scale, d
        self.exact = big * big * d < 2.0**53
        self.kind = "<f8" if not self.exact else "<i2" if big < 1 << 15 else "<i4"

    def matrix(self, blobs: list[bytes]) -> np.ndarray:
        """Rows of padded components, as they are stored."""
        out = np.zeros((len(blobs), self.d))
        for i, x in enumerate(blobs):
            y = np.frombuffer(x, "<f8")
            out[i, : len(y)] = y
        return np.floor(self.scale * out).astype(self.kind) if self.exact else out

    def unpacked(self, m: bytes) -> np.ndarray:
        return np.frombuffer(m, self.kind).reshape(-1, self.d)

    def floors(self, m: np.ndarray) -> np.ndarray:
        """Scaled floors of components that are stored as they are."""
        return np.floor(m.astype(np.longdouble) * self.scale)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score descending, id)."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _chosen(own, ids, scores, bound, k):
    ok = np.flatnonzero((scores >= bound) & (ids != own))
    return ok[_best(ids[ok], scores[ok], k)]


class Slab:
    """Candidates in descending order of length, ready for queries."""

    def __init__(self, numbers: Numbers, ids: np.ndarray, m: np.ndarray, rotation: np.ndarray | None):
        self.numbers, self.ids, self.rotation = numbers, ids, rotation
        if numbers.exact:
            self.c = m.astype(np.float64)
            self.norm = np.linalg.norm(self.c, axis=1)
            if rotation is not None:
                h = max(1, numbers.d // LEAD)
                turned = self.c @ rotation
                self.lead, self.rest = turned[:, :h], np.linalg.norm(turned[:, h:], axis=1)
        else:
            self.whole = numbers.floors(m)
            self.c, self.power = _scaled(self.whole)
            self.ints: dict[int, list[int]] = {}

    def search(self, q_ids: np.ndarray, m: np.ndarray, bound: np.ndarray, k: int):
        """For each query: (ids, scores) of its k best candidates that reach its bound."""
        return self._exact(q_ids, m.astype(np.float64), bound, k) if self.numbers.exact else self._wide(q_ids, self.numbers.floors(m), bound, k)

    def _exact(self, q_ids, q, bound, k):
        qn = np.linalg.norm(q, axis=1)
        slack = 1e-9 * (1 + qn * (self.norm[0] if len(self.norm) else 0))
        reach = np.where(np.isfinite(bound), bound - slack, -np.inf)
        # the first candidate too short for each query
        need = np.where(qn > 0, reach / np.where(qn > 0, qn, 1), np.where(reach <= 0, -np.inf, np.inf))
        width = int(np.searchsorted(-self.norm, -need, side="right").max(initial=0))
        if not width:
            return [(self.ids[:0], np.zeros(0, np.int64))] * len(q)
        c, ids, out = self.c[:width], self.ids[:width], []
        if not np.isfinite(bound).all() or self.rotation is None:
            full, alive = q @ c.T, None
        else:
            h = self.lead.shape[1]
            turned = q @ self.rotation
            upper = turned[:, :h] @ self.lead[:width].T
            upper += np.outer(np.linalg.norm(turned[:, h:], axis=1), self.rest[:width])
            alive = upper >= reach[:, None] - slack[:, None]
            full = q @ c.T if alive.mean() > 0.25 else None
        for i in range(len(q)):
            j = np.arange(width) if alive is None else np.flatnonzero(alive[i])
            s = (full[i, j] if full is not None else c[j] @ q[i]).astype(np.int64)
            p = _chosen(q_ids[i], ids[j], s, bound[i], k)
            out.append((ids[j][p], s[p]))
        return out

    def _wide(self, q_ids, whole, bound, k):
        q, power = _scaled(whole)
        near = (q @ self.c.T).astype(np.longdouble)
        err = (8 + len(self.c.T)) * 2.0**-50 * np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(self.c, axis=1)) + 2.0**-900
        scale = power[:, None] + self.power
        low, high = np.ldexp(near - err, scale), np.ldexp(near + err, scale)
        out = []
        for i in range(len(q)):
            other = np.flatnonzero(self.ids != q_ids[i])
            least = max(bound[i], np.sort(low[i, other])[-k]) if len(other) >= k else bound[i]
            own = [int(x) for x in whole[i]]
            got = sorted((-sum(map(int.__mul__, own, self._ints(j))), int(self.ids[j])) for j in other[high[i, other] >= least])[:k]
            out.append((np.array([x for _, x in got], np.int64), [-s for s, _ in got]))
        return out

    def _ints(self, j: int) -> list[int]:
        if j not in self.ints:
            self.ints[j] = [int(x) for x in self.whole[j]]
        return self.ints[j]


def _scaled(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of components up to 1, the power of two that each row was divided by)."""
    power = np.frexp(np.abs(m).max(axis=1, initial=0))[1]
    return np.ldexp(m, -power[:, None]).astype(np.float64), power.astype(np.int64)


_TOP, _LOW = (1 << 63) - 1, -(1 << 63)


def _shown(scores: list[int]) -> tuple[pa.Array, pa.Array]:
    """(scores as longs, bytes that order those at the ends of the range)."""
    beyond = [None if _LOW < s < _TOP else s for s in scores]
    return pa.array([min(max(s, _LOW), _TOP) for s in scores], pa.int64()), pa.array([None if s is None else _ordered(s) for s in beyond], pa.binary())


def _ordered(s: int) -> bytes:
    size = abs(s).to_bytes((abs(s).bit_length() + 7) // 8, "big")
    return ((1 << 31) + len(size)).to_bytes(4, "big") + size if s >= 0 else ((1 << 31) - len(size)).to_bytes(4, "big") + bytes(255 - x for x in size)


def _below(s: int) -> float:
    """A float at most an integer."""
    try:
        return math.nextafter(float(s), -math.inf)
    except OverflowError:
        return sys.float_info.max if s > 0 else -math.inf


def fit_rotation(vectors: DataFrame, numbers: Numbers, n: int) -> np.ndarray | None:
    """Right singular vectors of a sample chosen by a hash of the id."""
    d = numbers.d
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * d)))
    if rows < 2 * d or not numbers.exact:
        return None
    every = max(1, math.ceil(n / rows))
    got = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).select("v").limit(2 * rows).toPandas()["v"]
    if len(got) < 2 * d:
        return None
    return np.linalg.svd(numbers.matrix(list(got)).astype(np.float64), full_matrices=False)[2].T


_PACKED = "slab long, pos int, ids binary, m binary, bound binary, need double, top double"


def _packed(vectors: DataFrame, numbers: Numbers, size: int) -> DataFrame:
    """Each partition's rows (vec_id, norm, v; bound and need of queries), in order, packed
    into rows of at most CHUNK_BYTES of components, size vectors under one slab number.
    Slab numbers ascend with partitions and places."""
    most = max(1, min(size, CHUNK_BYTES // (8 * numbers.d)))

    def run(batches):
        from pyspark import TaskContext

        first, count, held = TaskContext.get().partitionId() << 32, 0, []

        def pack():
            ids, norm, v, bound, need = zip(*held, strict=True)
            at = count - len(held)
            cols = [[first + at // size], [at], [np.array(ids, "<i8").tobytes()], [numbers.matrix(list(v)).tobytes()], [np.array(bound, "<f8").tobytes()], [min(need)], [max(norm)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()), strict=True)], names=["slab", "pos", "ids", "m", "bound", "need", "top"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("vec_id", "norm", "v", "bound", "need")), strict=True):
                held.append(row)
                count += 1
                if len(held) == most or count % size == 0:
                    yield pack()
                    held.clear()
        if held:
            yield pack()

    return vectors.select("vec_id", "norm", "v", "bound", "need").mapInArrow(run, _PACKED)


def top_k(rows: DataFrame, is_query: Column, k: int, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k highest inner products of every row
    that is_query (a column over vec_id) marks, against every other row."""
    bounded(rows)
    spark = rows.sparkSession
    with scratch(spark) as keep:
        vectors = keep(component_vectors(rows, scale, id_col, vec_col), "vectors")
        n, d, big, nq = vectors.agg(F.count("*"), F.coalesce(F.max("d"), F.lit(0)), F.coalesce(F.max("big"), F.lit(0.0)), F.coalesce(F.sum(is_query.cast("long")), F.lit(0))).first()
        if not n or not nq:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        numbers = Numbers(scale, max(d, 1), big)
        rotation = fit_rotation(vectors, numbers, n)
        longest = vectors.orderBy(F.desc("norm"), "vec_id").limit(max(4 * k, min(SLAB_ROWS, LEAD_BYTES // (8 * numbers.d)))).select("vec_id", "v").collect()
        lead_ids, lead_m = np.array([r["vec_id"] for r in longest], np.int64), numbers.matrix([bytes(r["v"]) for r in longest])

        def bounds(batches):
            lead = Slab(numbers, lead_ids, lead_m, None)
            for b in batches:
                ids, m = b.column("vec_id").to_numpy(), numbers.matrix(b.column("v").to_pylist())
                got = lead.search(ids, m, np.full(len(ids), -np.inf), k) if len(ids) else []
                bound = np.array([_below(int(s[k - 1])) if len(s) >= k else -np.inf for _, s in got], np.float64)
                norm = b.column("norm").to_numpy()
                need = np.where((bound > 0) & np.isfinite(norm), bound / np.where(norm > 0, norm, 1) * (1 - 1e-9), 0.0) if numbers.exact else np.zeros(len(ids))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("norm"), b.column("v"), pa.array(bound), pa.array(need)], names=["vec_id", "norm", "v", "bound", "need"])

        none = vectors.withColumns({"bound": F.lit(0.0), "need": F.lit(0.0)})
        slabs = keep(_packed(none.repartitionByRange(math.ceil(n / SLAB_ROWS), F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id"), numbers, SLAB_ROWS), "slabs")
        asked = vectors.where(is_query).mapInArrow(bounds, "vec_id long, norm double, v binary, bound double, need double")
        asked = keep(asked, "asked")
        groups = keep(_packed(asked.repartitionByRange(math.ceil(nq / GROUP_ROWS), "need", "vec_id").sortWithinPartitions("need", "vec_id"), numbers, GROUP_ROWS).withColumnRenamed("slab", "group"), "groups")

        tops = [(r["slab"], r["top"]) for r in slabs.groupBy("slab").agg(F.max("top").alias("top")).orderBy("slab").collect()]
        needs = [(r["group"], r["need"]) for r in groups.groupBy("group").agg(F.min("need").alias("need")).orderBy("group").collect()]
        # a slab meets the first so many groups, a chunk of queries the first so many slabs
        down, least = -np.array([t for _, t in tops]), np.array([x for _, x in needs])
        slab_rank = spark.createDataFrame([(s, i, int(np.searchsorted(least, t, side="right"))) for i, (s, t) in enumerate(tops)], "slab long, rank int, groups int")
        group_rank = spark.createDataFrame([(g, i) for i, (g, _) in enumerate(needs)], "group long, g int")

        def reach(batches):
            for b in batches:
                last = np.searchsorted(down, -b.column("need").to_numpy(), side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(last)], names=[*b.schema.names[:-1], "last"])

        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = slabs.join(side(slab_rank), "slab").where("groups > 0").select("rank", upto("groups").alias("g"), F.lit(0).alias("query"), "pos", "ids", "m", "bound")
        sent = groups.join(side(group_rank), "group").select("g", "pos", "ids", "m", "bound", "need").mapInArrow(reach, "g int, pos int, ids binary, m binary, bound binary, last int")
        right = sent.where("last > 0").select(upto("last").alias("rank"), "g", F.lit(1).alias("query"), "pos", "ids", "m", "bound")
        units = left.unionAll(right).repartition("rank", "g").sortWithinPartitions("rank", "g", "query", "pos")

        def search(batches):
            unit, parts, slab = None, [], None
            for b in batches:
                for rank, g, query, ids, m, bound in zip(*(b.column(c).to_pylist() for c in ("rank", "g", "query", "ids", "m", "bound")), strict=True):
                    if (rank, g) != unit:
                        unit, parts, slab = (rank, g), [], None
                    ids, m = np.frombuffer(ids, "<i8"), numbers.unpacked(m)
                    if not query:
                        parts.append((ids, m))
                        continue
                    if slab is None:
                        slab = Slab(numbers, np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]), rotation)
                    got = slab.search(ids, m, np.frombuffer(bound, "<f8"), k)
                    score, beyond = _shown([int(x) for _, s in got for x in s]) if not numbers.exact else (pa.array(np.concatenate([s for _, s in got])), None)
                    beyond = pa.nulls(len(score), pa.binary()) if beyond is None else beyond
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(x) for x, _ in got])), pa.array(np.concatenate([x for x, _ in got])), score, beyond], names=["query_id", "vec_id", "score", "beyond"])

        found = units.mapInArrow(search, "query_id long, vec_id long, score long, beyond binary")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
        return written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "found")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""
