"""Near-duplicates, decontamination and components against brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesselon.llm import decontaminate, near_dup
from tesselon.llm import text as T
from tesselon.llm.components import components


def words(t):
    return (t or "").encode().lower().split()


def shingles(t, k):
    w = words(t)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_classes(docs, k, percent):
    sets = {d: shingles(t, k) for d, t in docs}
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for g in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(1, 120))]
        for _ in range(r.randint(1, 14)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 18))):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            docs.append(" ".join(t))
    chain = [r.choice(vocabulary) for _ in range(60)]
    for i in range(30):  # each like the one before, the ends unlike
        chain[(i * 2) % 60] = f"c{i}"
        docs.append(" ".join(chain))
    docs += ["", "one", "ONE", None, "two words", "Two\tWORDS\n", " ", "x " * 5000]
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("width", [2, 5])
def test_classes_equal_brute_force(spark, corpus, width):
    df = spark.createDataFrame([(i, t, "x") for i, t in corpus], "doc_id long, text string, component_id string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.classes(df, width, 80).collect()}
    assert got == brute_classes(corpus, width, 80)


def test_deduplicated_keeps_one_of_each(spark, corpus):
    df = spark.createDataFrame([(i, t) for i, t in corpus] + [(0, corpus[0][1]), (None, "free text"), (None, "free text")], "doc_id long, text string")
    want = {d for d, (_, c) in brute_classes(corpus, 5, 80).items() if d == c}
    got = [r["doc_id"] for r in near_dup.deduplicated(df).collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.classes(df).count() == 0
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.leaks(df, items).count() == 0
    assert decontaminate.leaks(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


def test_signatures_agree_with_similarity():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:889], r.integers(0, 1 << 63, 111).astype(np.uint64)])  # Jaccard about 0.8
    sets = np.concatenate([np.sort(a), np.sort(b)])
    s = near_dup.signatures(sets, np.array([0, 1000, 2000]))
    assert 0.65 < (s[0] == s[1]).mean() < 0.92
    small = near_dup.signatures(np.sort(a[:2]), np.array([0, 2]))
    assert set(small[0]) == set(a[:2])  # every empty bin borrows


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_components(spark, monkeypatch, limit):
    from tesselon.llm import components as module

    monkeypatch.setattr(module, "BROADCAST_BYTES", limit)
    e = [(1, 2), (2, 3), (9, 8), (8, 7), (20, 20)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert {got[x] for x in (1, 2, 3)} == {1} and {got[x] for x in (7, 8, 9)} == {7} and {got[100 + i] for i in range(41)} == {100} and 20 not in got


@pytest.mark.parametrize("shard", [decontaminate.SHARD, 20])
def test_leaks_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(decontaminate, "SHARD", shard)
    r = random.Random(5)
    v = [f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(v) for _ in range(n)]
    items = [text(n) for n in (3, 5, 6, 12, 30, 60)] + [[], ["same"] * 9]
    docs = []
    for _ in range(60):
        d = text(r.choice([4, 20, 300, 3000]))
        if r.random() < 0.6:
            it = list(r.choice(items))
            for _ in range(r.choice([0, 0, 1, 3])):
                if it:
                    it[r.randrange(len(it))] = r.choice(v)
            at = r.randrange(len(d))
            d[at:at] = it
        docs.append(" ".join(d).upper())
    docs += ["", None, "same " * 20, " ".join(items[1])]
    want = set()
    for i, it in enumerate(items):
        k = min(5, len(it))
        s = {tuple(it[j : j + k]) for j in range(len(it) - k + 1)} if it else set()
        for d, t in enumerate(docs):
            w = [x.decode() for x in words(t)]
            have = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
            if s and 100 * len(s & have) >= 80 * len(s):
                want.add((d, i, len(s), len(s & have)))
    dd = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(docs)], "doc_id long, text string, containment double")
    ii = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"], x["n_item"], x["n_shared"]) for x in decontaminate.leaks(dd, ii).collect()}
    assert got == want
    clean = {x["doc_id"] for x in decontaminate.decontaminated(dd, ii).collect()}
    assert clean == set(range(len(docs))) - {x[0] for x in want}


@pytest.mark.parametrize("shard", [decontaminate.SHARD, 3])
def test_null_ids_leak_alike(spark, monkeypatch, shard):
    monkeypatch.setattr(decontaminate, "SHARD", shard)
    one, two, three = (" ".join(f"{k}{i}" for i in range(9)) for k in "abc")
    docs = spark.createDataFrame([(1, f"x {one} y"), (None, f"{two} z"), (None, f"{one} {two}"), (2, three), (None, "clean words only"), (3, "q")], "doc_id long, text string")
    items = spark.createDataFrame([(7, two), (None, one), (None, "r s t u v w x y z")], "item_id long, text string")
    got = sorted(((x["doc_id"], x["item_id"], x["n_shared"]) for x in decontaminate.leaks(docs, items).collect()), key=repr)
    assert got == sorted([(1, None, 5), (None, 7, 5), (None, None, 5), (None, 7, 5)], key=repr)
    kept = decontaminate.decontaminated(docs, items).collect()
    assert sorted((x["doc_id"], x["text"]) for x in kept if x["doc_id"]) == [(2, three), (3, "q")] and [x["text"] for x in kept if x["doc_id"] is None] == ["clean words only"]


def test_fewest_bits_are_those_of_the_bins():
    s = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    s = np.unique(np.concatenate([s, s[:5] + np.uint64(2), np.array([0, 1, (1 << 64) - 1, (1 << 53) - 1, 1 << 53], np.uint64)]))
    need = decontaminate._fewest_bits(s)
    for p in range(41):
        assert set(np.flatnonzero(need <= p)) == set(decontaminate._bin_leasts(s, np.zeros(len(s), np.int64), np.array([p])))


def test_ids_with_several_texts_join_their_classes(spark):
    one, two = (" ".join(f"{k}{i}" for i in range(30)) for k in "ab")
    docs = [(9, one), (9, two), (4, one + " more"), (7, two), (8, "else where entirely so"), (3, None), (3, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in near_dup.classes(df).collect()}
    assert got == {(9, 4), (4, 4), (7, 4), (8, 8), (3, 3)}
    kept = [(r["doc_id"], r["text"]) for r in near_dup.deduplicated(df).collect()]
    assert sorted(x for x, _ in kept) == [3, 4, 8]
    assert sorted(near_dup.deduplicated(df.orderBy(F.desc("text"))).collect()) == sorted(near_dup.deduplicated(df).collect())


def test_links_hidden_from_the_hubs(spark, monkeypatch):
    """Every document of a cluster is compared, also in many blocks and units."""
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 2000)
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 10)
    monkeypatch.setattr(near_dup, "BLOCKS", 3)
    monkeypatch.setattr(near_dup, "UNIT", 3)
    monkeypatch.setattr(near_dup, "SHARD", 500)
    r = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    docs = []
    for g in range(25):
        own = list(base)
        for k in r.sample(range(100), 12):
            own[k] = f"g{g}x{k}"
        for c in range(3):
            t = list(own)
            t[r.randrange(100)] = f"c{c}"
            docs.append((len(docs), " ".join(t)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dup.classes(df, 2, 80).collect()}
    assert got == brute_classes(docs, 2, 80)


def test_token_hashes_follow_the_rule():
    import pyarrow as pa

    texts = ["A b\tC\n", "", None, "  x\x0by\x0cz  ", "É é", "a" * 5000 + " b", "   "]
    h, first = T.tokens(*T.buffers(pa.array(texts)))
    seen = {}
    for i, t in enumerate(texts):
        w = words(t)
        assert first[i + 1] - first[i] == len(w)
        for k, x in enumerate(w):
            assert seen.setdefault(x, h[first[i] + k]) == h[first[i] + k]
    assert len(set(seen.values())) == len(seen)


def test_segments_do_not_change_tokens(monkeypatch):
    import pyarrow as pa

    r = random.Random(1)
    texts = ["".join(r.choice("ab  \n") for _ in range(r.randint(0, 400))) for _ in range(50)] + ["q" * 300]
    whole = T.tokens(*T.buffers(pa.array(texts)))
    monkeypatch.setattr(T, "SEGMENT_BYTES", 64)
    cut = T.tokens(*T.buffers(pa.array(texts)))
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_query_columns(spark):
    df = near_dup.op9_near_dup(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"] and df.where(F.col("kept") != (F.col("doc_id") == F.col("component_id"))).count() == 0


def test_documents_look_up_their_signatures_only(spark, monkeypatch):
    """At most one look-up for each bin, sets counted only for items that a bin names, and
    every planted item found."""
    r = random.Random(12)
    word = lambda: f"w{r.randrange(5000)}"
    items = [(i, " ".join(word() for _ in range(r.choice([24, 40, 90])))) for i in range(60)]
    docs, want = [], set()
    for d in range(40):
        body = [word() for _ in range(r.randrange(200, 900))]
        if d % 2:
            i, text = items[r.randrange(60)]
            w, at = text.split(), r.randrange(len(body))
            keep = -(-85 * (len(w) - 4) // 100) + 4  # 85 of 100 shingles, in a row
            body[at:at] = w[:keep]
            want.add((d, i))
        docs.append((d, " ".join(body)))
    stored = decontaminate.store_items(spark.createDataFrame(items, "item_id long, text string"))
    index, looked, compared = decontaminate.Index(stored), [], []
    find, shared = index.find, index.shared
    monkeypatch.setattr(index, "find", lambda w, h: looked.append(len(h)) or find(w, h))
    monkeypatch.setattr(index, "shared", lambda w, rows, *a: compared.append(len(rows)) or shared(w, rows, *a))
    column = pa.array([t for _, t in docs])
    got = {(int(row), int(i)) for part in index.leaks(column, 80) for row, i in zip(part[0], part[1], strict=True)}
    sizes = [len(set(zip(*(t.split()[k:] for k in range(5)), strict=False))) for _, t in docs]
    assert got == want
    assert sum(looked) < 0.8 * sum(sizes) and sum(looked) <= sum(2 ** math.ceil(math.log2(n)) for n in sizes)
    assert len(want) <= sum(compared) < 3 * len(want)
