"""Importance resampling and quality votes against plain code."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesselon.llm import importance, quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def expected(docs, target, percent=5, least=20):
    code = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(code(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for n, (i, text) in enumerate(docs):
        w, f = features(text)
        weight = sum(math.floor(1000 * math.log((t[code(x)] + 1) * (all_s + 10000) / ((s[code(x)] + 1) * (all_t + 10000)))) for x in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w), n, None])
    fit = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for rank, x in enumerate(fit[: percent * len(fit) // 100], 1):
        x[6] = rank
    return [(x[0], x[1], x[2], x[3], x[6]) for x in out]


def plain(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    v = [f"W{i}" if i % 5 else f"é{i}Ü" for i in range(60)]
    texts = [r.choice([" ", "-", ", ", "\n\t", "\x7f"]).join(r.choice(v) for _ in range(r.randint(0, 60))) for _ in range(150)]
    return [*enumerate(texts), (900, None), (901, ""), (902, " ,.\x00 "), (None, texts[3]), (7, texts[7]), (7, texts[7]), (903, " ".join(r.choice(v) for _ in range(700)))]


def test_resampling_equals_plain_code(spark, corpus):
    df = spark.createDataFrame([(*x, "other", 5) for x in corpus], "doc_id long, text string, bucket string, row int").repartition(3)
    target = spark.createDataFrame([("w1 w2 é5Ü w6",), ("W7-w8",), (None,)], "text string")
    got = [tuple(x) for x in importance.resample(df, target, percent=30).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    want = expected(corpus, ["w1 w2 é5Ü w6", "W7-w8", None], 30)
    # equal ids with equal texts have neighbouring ranks in any order
    assert plain(got) == plain(want)


@pytest.mark.parametrize("piece", [1, 2, 7, 700])
def test_cut_texts_have_the_runs_of_whole_ones(spark, corpus, piece):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    rows = lambda at: Counter((x["doc_id"], x["b1"], x["b2"], x["b3"]) for x in at.collect())
    assert rows(importance.positions(df, long=20, piece=piece)) == rows(importance.positions(df))


def test_resampling_of_empty_tables(spark, corpus):
    docs = spark.createDataFrame(corpus[:40], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    got = [tuple(x) for x in importance.resample(docs, none).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert plain(got) == plain(expected(corpus[:40], []))
    assert importance.resample(docs.where("false"), docs.select("text")).collect() == []


def test_ranks_of_ties_and_hot_scores(spark):
    rows = [(i if i % 3 else None, 100, 7, 20) for i in range(500)] + [(1000 + i, 100, i, 20) for i in range(20)] + [(5000, 100, 99, 19)]
    df = spark.createDataFrame(rows, "doc_id long, n_features long, score long, n_words long").withColumn("row", F.monotonically_increasing_id())
    got = {(x["doc_id"], x["score"]): x["rank"] for x in importance.drawn(df, 20, 20).collect() if x["rank"]}
    fit = sorted(((i, s) for i, _, s, n in rows if n >= 20), key=lambda x: (-x[1], x[0] is None, x[0] or 0))
    assert got == {x: k for k, x in enumerate(fit[: 20 * len(fit) // 100], 1)}


# --- quality ---


def plain_counts(text):
    """Term kinds of a text, by plain code: words, shapes, pairs of shapes, repetition."""
    raw = (text or "").encode()
    shape = []
    for c in raw:
        k = "a" if 97 <= c <= 122 or c >= 128 else "b" if 65 <= c <= 90 else "0" if 48 <= c <= 57 else chr(c)
        if not shape or shape[-1] != k:
            shape.append(k)
    s = "".join(shape).encode().split()
    w = [x.lower() for x in raw.split()]
    pairs = list(zip(s, s[1:], strict=False)) if len(s) > 1 else [tuple(s)] if s else []
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)] or ([tuple(w)] if w else [])
    same = sum(a == b for a, b in zip(w, w[1:], strict=False))
    return w, s, pairs, (len(w) - same, same, len(set(runs)), len(runs) - len(set(runs)))


TEXTS = ["A plain line of words, and of words.", "", "WORD!! WORD!! WORD!!", "one", "a | b | c |", "x y z x y z x y z", "Ünïcode 12 345 ...", " \n ", "aA1 aB2 ** **"]


def test_term_counts_are_those_of_plain_code():
    got = np.concatenate([c for _, c in quality.blocks(pa.array(TEXTS))])
    at = np.cumsum([0, *(n for _, n, _ in quality.PARTS)])
    for text, row in zip(TEXTS, got, strict=True):
        for k, kind in enumerate(plain_counts(text)[:3]):
            assert sorted(row[at[k] : at[k + 1]][row[at[k] : at[k + 1]] > 0]) == sorted(Counter(kind).values())  # no two terms here share a column
        assert tuple(row[at[3] : at[3] + 4]) == plain_counts(text)[3] and not row[at[3] + 4 :].any()
    one_by_one = np.concatenate([c for t in TEXTS for _, c in quality.blocks(pa.array([t]))])
    assert (one_by_one == got).all()


def test_votes_equal_plain_code():
    r = np.random.default_rng(3)
    counts = r.poisson(0.02, (90, quality.WIDTH)).astype(np.float32)
    counts[7] = counts[8]
    counts[80] = 0
    labels = (np.arange(60) % 4 > 0).astype(np.int64)
    idf = np.linspace(0.1, 2, quality.WIDTH).astype(np.float32)
    m = quality.Neighbours.fit(counts[:60], labels, idf, {0: 45, 1: 90})
    got = m.scores(counts[60:])

    def vector(c):
        x, at = [], 0
        for _, n, weight in quality.PARTS:
            part = c[at : at + n].astype(float)
            x += (weight * np.sqrt(part / max(part.sum(), 1))).tolist()
            at += n
        x = np.array(x) * idf
        y = x / max(math.sqrt(x @ x), 1e-12) @ m.directions
        return y / max(math.sqrt(y @ y), 1e-12)

    held = [vector(c) for c in counts[:60]]
    for c, s in zip(counts[60:], got, strict=True):
        v = vector(c)
        near = sorted(((round(float(v @ h), 6), int(y)) for h, y in zip(held, labels, strict=True)), reverse=True)
        last = max(near[quality.NEAREST - 1][0], 1e-6)
        # 45 documents of label 0 for 15 drawn, 90 of label 1 for 45
        votes = [(x**quality.POWER * (1 if y == 0 else 2 / 3), y) for x, y in near if x >= last]
        want = (sum(x for x, y in votes if y) + quality.SMOOTH * m.prior) / (sum(x for x, _ in votes) + quality.SMOOTH)
        assert s == pytest.approx(want, abs=2e-3)
    assert got[20] == pytest.approx(m.prior)  # near nothing


def test_directions_are_the_leading_singular_vectors():
    r = np.random.default_rng(1)
    x = (r.standard_normal((80, 5)) * [9, 7, 5, 3, 2]) @ np.linalg.qr(r.standard_normal((200, 5)))[0].T
    got = quality.leading_directions(x.astype(np.float32), 3)
    _, _, v = np.linalg.svd(x, full_matrices=False)
    assert np.abs(np.diag(got.T @ v[:3].T)) == pytest.approx(1, abs=1e-3)


def test_document_frequencies_cover_all_documents(spark):
    df, n = quality.document_frequencies(spark.createDataFrame([(t,) for t in [*TEXTS, None]] * 3, "text string").repartition(4))
    counts = np.concatenate([c for _, c in quality.blocks(pa.array([*TEXTS, ""]))])
    assert n == 30 and (df == 3 * (counts > 0).sum(axis=0)).all()


def test_quality_of_odd_input(spark):
    docs = spark.createDataFrame([(1, "good words here", 5), (2, "BAD!! BAD!!", 5), (2, "BAD!! BAD!!", 5), (3, None, 5), (4, "", 5), (None, "more words here", 5), (6, "x " * 50_000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1), (None, 1), (77, 1), (4, None), (6, 3)], "doc_id long, quality int")
    m = quality.learn(docs, labels)
    assert len(m.labels) == 2 and m.prior == 0.5
    got = [(x["doc_id"], x["score"], x["predicted"]) for x in quality.score(docs.drop("score"), m, ["doc_id"]).collect()]
    by = {i: (s, p) for i, s, p in got}
    assert len(got) == 7 and by[1][1] == 1 and by[2][1] == 0 and by[3] == by[4] == (0.5, 1) and by[None][0] > 0.5 and all(0 <= s <= 1 for s, _ in by.values())
    for given, want in (([], 0.0), ([(1, 1)], 1.0), ([(2, 0)], 0.0), ([(1, 1), (1, 0)], 1.0)):
        m = quality.learn(docs, spark.createDataFrame(given, "doc_id long, quality int"))
        assert {x["score"] for x in quality.score(docs, m, ["doc_id"]).collect()} == {want}
    assert quality.score(docs.where("false"), m, ["doc_id"]).collect() == []


def test_held_out_quality(spark):
    docs = [(i, " ".join(random.Random(i).choice(["words", "plain", "of", "it"]) + ("%%%" if i % 4 == 0 else "") for _ in range(30)), 0 if i % 4 == 0 else 1) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, quality int")
    m = quality.learn(df.where("doc_id < 100"), df.where("doc_id < 100").select("doc_id", "quality"))
    got = quality.score(df.where("doc_id >= 100"), m, ["doc_id", "quality"]).collect()
    assert all(x["predicted"] == x["quality"] for x in got)


@pytest.mark.parametrize("m", [importance, quality])
def test_defined_results(m):
    assert "Defined results" in m.__doc__
