"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A document's terms are its words, the shapes of its words (runs of one character class made
one sign: ``Abc**`` has the shape ``ba*``), pairs of neighbouring shapes, and words equal to
the one before and runs of three words seen before in the text. Terms are hashed to columns,
WIDTH in all, a fixed part of them for each kind. A kind's counts become square roots of
shares, are weighted by kind and by inverse document frequency, and scaled to length 1.
Document frequencies are counted over all documents.

The labelled sample (at most SAMPLE documents of each label, chosen by a hash of the id, whole
texts) is decomposed on the driver by a randomised singular value decomposition: the leading
RANK directions are the latent space. Its vectors, WIDTH x RANK weights and at most 2 * SAMPLE
x RANK coordinates, a few MB, are broadcast. Every document is projected, its cosines with all
labelled vectors are computed exactly in blocks of matrix products, and its NEAREST neighbours
vote with their label, weighted by a power of the cosine and by how many labelled documents
each drawn one of its label stands for. Votes are smoothed by the share of label 1.

Defined results: null and empty texts, and texts near nothing, score the share of label 1;
without labelled documents every score is 0; with one label only every score is that label;
a document with both labels counts as 1; labels without an id, a text or one of the values 0
and 1 teach nothing; of rows that repeat an id the smallest text teaches; neighbours at the
same cosine (to six digits) as the last one all vote, so ties have no order; repeated rows
repeat; an empty table gives no rows; other columns are never read. A score of exactly the
threshold predicts 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType

from tesselon.llm import text as T
from tesselon.llm.common import bounded, crc_mod, free_name, table

SAMPLE, RANK, NEAREST = 2000, 64, 25
#: Columns of words, shapes, pairs of shapes and repetition, and the weights of these kinds.
PARTS = (("words", 4096, 0.5), ("shapes", 1024, 1.0), ("pairs", 3064, 1.0), ("repeats", 8, 1.0))
WIDTH = sum(n for _, n, _ in PARTS)
#: Texts worked on at once; the power of a cosine in votes; votes that the prior counts for.
BLOCK, POWER, SMOOTH = 256, 8, 0.05
THRESHOLD = 0.3

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = _CLASS[128:] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("b")
_CLASS[ord("0") : ord("9") + 1] = ord("0")


def shapes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the same texts with each run of one character class made one
    sign; words stay apart."""
    kind = _CLASS[raw]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    starts = offsets[:-1]
    keep[starts[starts < len(kind)]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return kind[keep], before[offsets]


def term_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x WIDTH: how often each text has each column's terms."""
    n = len(offsets) - 1
    h, first = T.tokens(raw, offsets)
    s, s_first = T.tokens(*shapes(raw, offsets))
    owner = lambda f: np.repeat(np.arange(n), np.diff(f))
    pair_row, pair = T.shingles(s, s_first, 2)
    row = owner(first)
    again = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1])) + 1
    run_row, run = T.shingles(h, first, 3)
    _, distinct = T.distinct_by_row(run_row, run, n)
    terms = {"words": (row, h), "shapes": (owner(s_first), s), "pairs": (pair_row, pair)}
    out, at = np.zeros((n, WIDTH), np.float32), 0
    for name, size, _ in PARTS:
        if name in terms:
            who, what = terms[name]
            out[:, at : at + size] = np.bincount(who * size + (what % np.uint64(size)).astype(np.int64), minlength=n * size).reshape(n, size)
        else:
            words, runs = np.diff(first), np.bincount(run_row, minlength=n)
            same = np.bincount(row[again], minlength=n)
            seen = runs - np.diff(distinct)
            for k, c in enumerate((words - same, same, runs - seen, seen)):
                out[:, at + k] = c
        at += size
    return out


def blocks(column):
    """(first row, term counts) of an Arrow string column, BLOCK texts at a time."""
    raw, offsets = T.buffers(column)
    for a in range(0, len(column), BLOCK):
        o = offsets[a : min(a + BLOCK, len(column)) + 1]
        yield a, term_counts(raw[o[0] : o[-1]], o - o[0])


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length 1 (or 0) from term counts."""
    x, at = np.empty_like(counts), 0
    for _, size, weight in PARTS:
        part = counts[:, at : at + size]
        total = part.sum(axis=1, keepdims=True)
        x[:, at : at + size] = np.float32(weight) * np.sqrt(part / np.maximum(total, 1))
        at += size
    x *= idf
    return unit(x)


def unit(x: np.ndarray) -> np.ndarray:
    """x, with its rows scaled to length 1 in place."""
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), np.float32(1e-12))[:, None]
    return x


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(how many texts have each column's terms, texts), over all of docs (text). A task
    sends one sum for each column on."""
    bounded(docs)

    def run(batches):
        total, n = np.zeros(WIDTH, np.int64), 0
        for b in T.parts(batches, "text"):
            for _, counts in blocks(b.column(0)):
                total += (counts > 0).sum(axis=0)
                n += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH + 1, dtype=np.int32)), pa.array(np.append(total, n))], names=["at", "n"])

    got = docs.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(WIDTH + 1, np.int64)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out[:WIDTH], int(out[WIDTH])


def leading_directions(x: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """Columns of x's leading right singular vectors, by subspace iteration from a random
    start."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(5):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ v.T)[:, :rank], np.float32)


@dataclass
class Neighbours:
    """idf by column, directions (WIDTH x rank), labelled unit vectors, their labels and
    vote weights, and the share of label 1."""

    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    stands_for: np.ndarray
    prior: float

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, idf: np.ndarray, totals: dict[int, int]) -> Neighbours:
        """From term counts of the sample; totals has the number of labelled documents by
        label."""
        x = weighted(counts, idf)
        directions = leading_directions(x) if len(x) else np.zeros((WIDTH, 1), np.float32)
        drawn = np.bincount(labels, minlength=2)
        stands = np.array([totals.get(k, 0) / max(drawn[k], 1) for k in (0, 1)])
        stands /= max(stands.max(), 1e-12)
        n = sum(totals.values())
        return cls(idf, directions, unit(x @ directions), labels, stands[labels].astype(np.float32), totals.get(1, 0) / n if n else 0.0)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The share of label 1 among the votes for each row of term counts."""
        out = np.full(len(counts), self.prior)
        if not len(self.labels) or self.prior in (0.0, 1.0):
            return out
        near = np.round(unit(weighted(counts, self.idf) @ self.directions) @ self.vectors.T, 6)
        k = min(NEAREST, near.shape[1])
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        who, which = np.nonzero(near >= np.maximum(last, 1e-6)[:, None])
        vote = near[who, which].astype(np.float64) ** POWER * self.stands_for[which]
        yes = np.bincount(who, vote * self.labels[which], minlength=len(counts))
        return (yes + SMOOTH * self.prior) / (np.bincount(who, vote, minlength=len(counts)) + SMOOTH)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Neighbours:
    """Labelled vectors from docs (doc_id, text) and labels (doc_id, quality)."""
    df, n = document_frequencies(docs)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(0.1)
    rows = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    rows = rows.join(docs.where("text IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi")
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    chosen = [(r["doc_id"], v) for v in (0, 1) for r in rows.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    if not chosen:
        return Neighbours.fit(np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64), idf, {})
    ids = docs.sparkSession.createDataFrame(chosen, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int")
    texts = docs.where("text IS NOT NULL").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches):
        for b in T.parts(batches, "text"):
            for a, counts in blocks(b.column(2)):
                at = [np.flatnonzero(r).astype(np.int32) for r in counts]
                part = b.slice(a, len(counts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(at), pa.array([r[i] for r, i in zip(counts, at, strict=True)])], names=["doc_id", "label", "at", "n"])

    schema = texts.drop("text").schema.add("at", ArrayType(IntegerType())).add("n", ArrayType(FloatType()))
    got = texts.mapInArrow(run, schema).toPandas().sort_values("doc_id")
    counts = np.zeros((len(got), WIDTH), np.float32)
    for i, (at, c) in enumerate(zip(got["at"], got["n"], strict=True)):
        counts[i, at] = c
    return Neighbours.fit(counts, got["label"].to_numpy().astype(np.int64), idf, totals)


def score(docs: DataFrame, model: Neighbours, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns with score and predicted, for every row of docs (text and the kept
    columns). model is broadcast: its size is bounded by SAMPLE, WIDTH and RANK."""
    bounded(docs)
    own = free_name("text", [*keep, "score", "predicted"])
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        held = sent.value
        for b in T.parts(batches, own):
            q = np.concatenate([held.scores(counts) for _, counts in blocks(b.columns[-1])])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(q, pa.float64()), pa.array((q >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*keep, F.col("text").alias(own)).mapInArrow(run, schema)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = learn(docs, labels.where(crc_mod("doc_id", 5) != 0))
    marked = docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)))
    return score(marked, model, ["doc_id", "held_out"])
