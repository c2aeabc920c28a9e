"""Language model, language ID, toxicity, pieces and top-k against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesselon.llm import lang_id, ngram_lm, pieces, topk_search, toxicity

SF = "/root/testdata/sf0.001"


def test_kneser_ney_equals_brute_force(spark, tmp_path):
    r = random.Random(2)
    v = [f"w{i}" for i in range(40)]
    docs = [" ".join(r.choice(v[: r.randint(2, 40)]) for _ in range(r.randint(0, 80))) for _ in range(60)] + ["the " * 3000, "", None, "Unseen WORDS only"]
    rows = [(i, t, i % 7 == 0) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(5)
    fig = ngram_lm.store_model(df.where("NOT held_out"), str(tmp_path / "m"))
    got = {x["doc_id"]: x for x in ngram_lm.score_texts(df, fig, ["doc_id"]).collect()}
    tok = {i: [*(t or "").encode().lower().split(), None] for i, t, _ in rows}
    c, bi = Counter(), Counter()
    for i, _, h in rows:
        if not h:
            c.update(tok[i])
            bi.update(zip(["<s>", *tok[i]], tok[i], strict=False))
    n, types = sum(c.values()), len(c)
    cont = Counter(w for _, w in bi)
    total, by = Counter(), defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), k in bi.items():
        total[a] += k
        by[a][min(k, 3)] += 1
    cc = lambda x: [sum(1 for k in x.values() if k == j) for j in (1, 2, 3, 4)]
    d1, d2 = ngram_lm.discounts(cc(cont)), ngram_lm.discounts(cc(bi))
    uni = sum(d1[min(k, 3)] for k in cont.values()) / len(bi) / (types + 1)
    low = lambda w: max(cont[w] - d1[min(cont[w], 3)], 0) / len(bi) + uni

    def p(a, w):
        if not total[a]:
            return low(w)
        return max(bi[a, w] - d2[min(bi[a, w], 3)], 0) / total[a] + sum(d2[k] * by[a][k] for k in (1, 2, 3)) / total[a] * low(w)

    for i, t in tok.items():
        x = got[i]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert x["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (types + 1))) for w in t), rel=1e-9)
        assert x["score"] == pytest.approx(sum(math.log10(p(a, w)) for a, w in zip(["<s>", *t], t, strict=False)), rel=1e-9)
    for a in ("<s>", b"w0", b"the"):  # a distribution over known words and one unknown
        assert sum(p(a, w) for w in c) + p(a, "?") == pytest.approx(1)


def test_language_model_without_training_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    fig = ngram_lm.store_model(df.where("false"), str(tmp_path / "m"))
    x = ngram_lm.score_texts(df, fig, ["doc_id"]).first()
    assert (x["n_tokens"], x["n_known"], x["train_tokens"], x["base_score"], x["score"]) == (3, 0, 0, 0, 0)


def _bundle(text, seed=7):
    """The vector of one text, letter by letter."""
    total, padded = np.zeros(lang_id.DIMENSIONS), [0, *(ord(c.lower()[0]) if c.isalpha() else 0 for c in text), 0]
    base = {p: lang_id.letter_vectors(np.array([p]), seed)[0].astype(float) for p in set(padded)}
    for a, b, c in zip(padded, padded[1:], padded[2:]):
        if b:
            total += np.roll(base[a], 2) * np.roll(base[b], 1) * base[c]
    return total


def test_trigram_sums_equal_bundled_vectors():
    texts = ["Hello, World", "", "çà 漢 \U00020000z", "x", "a.b", "".join(chr(0x4E00 + i) for i in range(400))]
    owner, kind, ids = lang_id.trigrams(texts)
    protos = np.stack([np.rint(_bundle(t)) for t in texts])
    got = lang_id.Products(protos, 7)
    dots = got.dots(owner, kind, ids, len(texts))
    for i, t in enumerate(texts):
        assert np.array_equal(lang_id.bundle(ids, np.bincount(kind[owner == i], minlength=len(ids)), 7), _bundle(t))
        assert np.array_equal(dots[:, i], protos @ _bundle(t))
    assert np.array_equal(got.of(ids[::2]), lang_id.products(ids[::2], protos, 7))  # kept ones
    assert set(owner) == {0, 2, 3, 4, 5} and (owner == 3).sum() == 1


def test_products_in_blocks_of_prototypes(monkeypatch):
    texts = ["one two three", "vier fünf", "шесть"]
    owner, kind, ids = lang_id.trigrams(texts)
    protos = np.stack([_bundle(t) for t in texts])
    whole = lang_id.Products(protos, 7).dots(owner, kind, ids, 3)
    monkeypatch.setattr(lang_id, "WIDE", 1)
    monkeypatch.setattr(lang_id, "HELD", 1)
    assert np.array_equal(lang_id.Products(protos, 7).dots(owner, kind, ids, 3), whole)


def test_each_letter_has_its_own_vector():
    letters = [ord(c) for c in map(chr, range(0x30000)) if c.isalpha() and c == c.lower()[0]]
    some = random.Random(3).sample(letters, 3000)
    v = lang_id.letter_vectors(np.array(sorted(some)), 7)
    assert len(np.unique(v, axis=0)) == 3000
    cosines = v[:500].astype(float) @ v[:500].T / lang_id.DIMENSIONS
    assert np.abs(cosines - np.eye(500)).max() < 0.15


def test_twenty_languages_of_three_scripts(spark):
    """Words of each language are drawn from letters that its script's other languages have too."""
    r = random.Random(11)
    scripts = ["abcdefghijklmnopqrstuvwxyzàáâãäåçèéêëìíîïñòóôõöùúûüý", "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x4E00, 0x4E00 + 300)))]
    rows = []
    for k in range(20):
        letters = scripts[k % 3]
        weights = [r.random() ** 3 for _ in letters]
        words = ["".join(r.choices(letters, weights, k=r.randint(2, 3) if k % 3 == 2 else r.randint(3, 8))) for _ in range(150)]
        rows += [(k * 100 + i, " ".join(r.choices(words, k=25)), f"l{k:02}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train, held = df.where("doc_id % 100 < 40"), df.where("doc_id % 100 >= 40")
    profiles = lang_id.learn(train)
    got = {x["doc_id"]: x for x in lang_id.predict(held, profiles, ["doc_id", "lang"]).collect()}
    assert len(got) == 400 and sum(x["lang"] == x["lang_pred"] for x in got.values()) >= 380
    again = lang_id.predict(held.repartition(7), lang_id.learn(train.repartition(5)), ["doc_id"]).collect()
    assert all((x["lang_pred"], x["score"]) == (got[x["doc_id"]]["lang_pred"], got[x["doc_id"]]["score"]) for x in again)


def test_language_accuracy_and_edges(spark):
    df = lang_id.op10_lang_id(spark, SF)
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = df.join(d, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got > 0.95
    none = lang_id.learn(d.limit(0).withColumn("text", F.lit("x")))
    odd = spark.createDataFrame([(1, None, "a"), (2, "123 !", "b"), (3, "abc", "c")], "doc_id long, text string, lang_pred string")
    rows = lang_id.predict(odd, none, ["doc_id"]).collect()
    assert {r["lang_pred"] for r in rows} == {"und"} and {r["score"] for r in rows} == {0.0}


def test_languages_equal_bundled_vectors(spark):
    """Predictions against cosines of vectors that are bound and bundled one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.substring("text", 1, 400).alias("text"), "lang").collect()
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs] + [(None, "der hund und die katze", None), (None, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = lang_id.predict(df.withColumn("text2", F.col("text")), lang_id.learn(df), ["doc_id", "text"]).collect()

    def vector(texts):
        return sum(map(_bundle, texts), np.zeros(lang_id.DIMENSIONS))

    langs = sorted({x for _, t, x in rows if x and t})
    proto = np.stack([vector([t for _, t, y in rows if y == x and t]) for x in langs])
    proto /= np.linalg.norm(proto, axis=1, keepdims=True)
    proto -= proto.mean(axis=0)
    proto /= np.linalg.norm(proto, axis=1, keepdims=True)
    assert len(got) == len(rows)
    for r in got:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        dots = proto @ vector([r["text"]])
        assert r["lang_pred"] == langs[int(np.argmax(dots))]
        assert r["score"] == pytest.approx(max(dots.max(), 0) / np.maximum(dots, 0).sum(), abs=1e-4)


def test_every_language_is_learned(spark):
    r = random.Random(0)
    words = {f"l{k:03}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4)] for k in range(140)}
    rows = [(i, " ".join(w), lang) for i, (lang, w) in enumerate(words.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    got = {x["doc_id"]: x["lang_pred"] for x in lang_id.predict(df, lang_id.learn(df), ["doc_id"]).collect()}
    assert got == {i: lang for i, _, lang in rows}
    same = spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a")], "doc_id long, text string, lang string")
    assert {x["lang_pred"] for x in lang_id.predict(same, lang_id.learn(same), ["doc_id"]).collect()} == {"a"}  # a tie


def test_recurrent_gradients():
    net = toxicity.Network(1)
    r = np.random.default_rng(0)
    x = r.standard_normal((5, 3, toxicity.DIM)).astype(np.float32)
    mask = np.ones((5, 3), bool)
    mask[3:, 1] = False
    y = np.array([1, 0, 1], np.float32)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    _, grad, dx = net.gradients(x.astype(np.float64), mask, y)
    for name in ("Wf", "Ub", "Bf", "u", "v", "c", "Uf", "Wb"):
        flat = net.p[name].reshape(-1)
        at = int(np.argmax(np.abs(grad[name].reshape(-1))))
        old, eps = flat[at], 1e-4
        loss = []
        for s in (1, -1):
            flat[at] = old + s * eps
            loss.append(net.gradients(x.astype(np.float64), mask, y)[0])
        flat[at] = old
        assert (loss[0] - loss[1]) / (2 * eps) == pytest.approx(grad[name].reshape(-1)[at], rel=2e-2, abs=1e-5), name


def test_scorer_equals_the_training_pass_and_covers_all_words():
    net = toxicity.Network(1)
    win, owner = toxicity.windows(np.arange(1, 101), np.array([0, 0, 5, 100]))
    assert owner.tolist() == [0, 1, 2, 2, 2, 2, 2] and set(win.ravel()) == set(range(101))
    x = np.random.default_rng(0).standard_normal((101, toxicity.DIM)).astype(np.float32)
    x[0] = 0
    s = toxicity.Scorer(net)
    gf, gb = (x @ net.p[f"W{d}"] + net.p[f"B{d}"] for d in "fb")
    assert np.allclose(s.logits(s.tables(x), win), net.logits(gf[win.T], gb[win.T], win.T > 0), atol=1e-5)


def test_toxicity_is_learned_from_words_and_spelling(spark):
    r = random.Random(0)
    syllables = ["ba", "do", "ki", "lu", "me", "no", "pa", "ri", "su", "ta"]
    word = lambda n: "".join(r.choice(syllables) for _ in range(n))
    docs, labels = [], []
    for i in range(400):
        t = [word(r.randint(1, 4)) for _ in range(r.randint(1, 200))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                t.insert(r.randrange(len(t) + 1), "zorg" + word(2))  # never the same word
        docs.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame(docs + [(1000, ""), (1001, None)], "doc_id long, text string")
    net = toxicity.learn(d, spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, toxic int"))
    got = {x["doc_id"]: x for x in toxicity.score(d, net, ["doc_id"]).collect()}
    held = [x for x in labels if x[0] % 5 == 0]
    assert np.mean([got[i]["predicted"] == y for i, y in held]) > 0.93
    assert all(0 <= x["score"] <= 1 for x in got.values()) and len(got) == 402
    none = toxicity.learn(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {x["score"] for x in toxicity.score(d, none, ["doc_id"]).collect()} == {0.0}


def test_order_three_equals_brute_force(spark, tmp_path):
    r = random.Random(3)
    v = [f"w{i}" for i in range(12)]
    docs = [" ".join(r.choice(v[: r.randint(2, 12)]) for _ in range(r.randint(0, 60))) for _ in range(60)] + ["the " * 3000, "", None, "Unseen WORDS only"]
    rows = [(i, t, i % 7 == 0) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(5)
    fig = ngram_lm.store_model(df.where("NOT held_out"), str(tmp_path / "m"), 3)
    got = {x["doc_id"]: x["score"] for x in ngram_lm.score_texts(df, fig, ["doc_id"]).collect()}
    tok = {i: ["<s>", "<s>", *(t or "").encode().lower().split(), None] for i, t, _ in rows}
    tri = Counter(g for i, _, h in rows if not h for g in zip(tok[i], tok[i][1:], tok[i][2:], strict=False))
    bi = Counter()
    for (_, b, c), k in tri.items():
        bi[b, c] += k if b == "<s>" else 1
    cont = Counter(c for _, c in bi)
    cc = lambda x: [sum(1 for k in x.values() if k == j) for j in (1, 2, 3, 4)]
    d1, d2, d3 = (ngram_lm.discounts(cc(x)) for x in (cont, bi, tri))
    uni = sum(d1[min(k, 3)] for k in cont.values()) / len(bi) / (len(cont) + 1)
    followers = defaultdict(dict)
    for table in (bi, tri):
        for g, k in table.items():
            followers[g[:-1]][g[-1]] = k

    def p(h, w):
        if not h:
            return max(cont[w] - d1[min(cont[w], 3)], 0) / len(bi) + uni
        f, d = followers.get(h, {}), d2 if len(h) == 1 else d3
        if not f:
            return p(h[1:], w)
        total, k = sum(f.values()), f.get(w, 0)
        return max(k - d[min(k, 3)], 0) / total + sum(d[min(x, 3)] for x in f.values()) / total * p(h[1:], w)

    for i, t in tok.items():
        assert got[i] == pytest.approx(sum(math.log10(p((a, b), c)) for a, b, c in zip(t, t[1:], t[2:], strict=False)), rel=1e-9), i
    for h in (("<s>", "<s>"), (b"w0", b"w1"), (b"the", b"the")):
        assert sum(p(h, w) for w in [*cont, "unknown"]) == pytest.approx(1)


def test_one_long_text_does_not_end_the_toxicity_sample(spark, monkeypatch):
    first = min(range(3000), key=lambda i: zlib.crc32(str(i).encode()))
    plain = lambda i: f"the words of text {i} are calm and mild "
    rows = [(i, plain(i) + ("zorgban" if i % 2 else "calm")) for i in range(200) if i != first] + [(first, "long calm words " * 600_000)]
    assert len(rows[-1][1]) > toxicity.SAMPLE_CHARS
    seen = {}
    monkeypatch.setattr(toxicity, "train", lambda texts, y, prior: seen.update(texts=texts, y=list(y)))
    toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    assert len(seen["y"]) == len(rows) and sum(map(len, seen["texts"])) <= toxicity.SAMPLE_CHARS
    part = next(t for t in seen["texts"] if t.startswith("long") or "zorgban" not in t and "mild" not in t)
    assert set(part.split()) == {"long", "calm", "words"} and 100_000 < len(part) <= toxicity.SAMPLE_CHARS // toxicity.SHARES


def test_toxicity_sample_is_filled_by_label():
    import pandas as pd

    sizes = pd.DataFrame([(1, 0, 60), (2, 0, 10), (3, 1, 70), (4, 0, 50), (5, 1, 20), (6, 0, 5)], columns=["doc_id", "toxic", "n"])
    assert set(toxicity.fitting(sizes, 100)) == {5, 1, 2, 6}
    assert set(toxicity.fitting(sizes, 1000)) == {1, 2, 3, 4, 5, 6}
    assert toxicity.fitting(sizes.iloc[:0], 100) == []


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


@pytest.mark.parametrize("alphabet", ["ab", "a", "the enabc ", "é▁ x\n漢\U0001f600"])
def test_chunks_equal_the_whole(spark, vocabulary, alphabet):
    r = random.Random(1)
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(41, 300))) for _ in range(12)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(90, None), (91, ""), (92, texts[0])], "doc_id long, text string")
    cut = {x["doc_id"]: x for x in pieces.encode(df, ["doc_id"], vocabulary, giant=40, chunk=19).collect()}
    whole = {x["doc_id"]: x for x in pieces.encode(df, ["doc_id"], vocabulary).collect()}
    assert len(cut) == 15 and cut[90]["n_tokens"] == cut[91]["n_tokens"] == 0
    for i, t in enumerate(texts):
        assert cut[i]["token_ids"] == whole[i]["token_ids"] == vocabulary.best(" " + t)[0]
        assert cut[i]["round_trip"] and whole[i]["round_trip"]
    back = {x["doc_id"]: x["text"] for x in pieces.decode(pieces.encode(df, ["doc_id"], vocabulary), ["doc_id"], vocabulary).collect()}
    assert all(back[i] == t for i, t in enumerate(texts))


def test_equal_to_the_library_as_a_unigram_model(vocabulary):
    """The installed library, given the same pieces and scores as a unigram model."""
    import struct

    import sentencepiece

    base = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    part = lambda f, b: number(f << 3 | 2) + number(len(b)) + b
    own = {i: (p, s) for p, (i, s) in vocabulary.score.items()}
    proto = b""
    for i in range(vocabulary.size):
        kind = 6 if base.is_byte(i) else 3 if base.is_control(i) else 2 if base.is_unknown(i) else 1
        proto += part(1, part(1, base.id_to_piece(i).encode()) + number(2 << 3 | 5) + struct.pack("<f", own[i][1] if i in own else 0) + number(3 << 3) + number(kind))
    proto += part(2, number(3 << 3) + number(1) + number(35 << 3) + number(1)) + part(3, part(1, b"identity") + number(3 << 3) + number(1) + number(4 << 3) + number(0) + number(5 << 3) + number(1))
    library = sentencepiece.SentencePieceProcessor(model_proto=proto)
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist() if 0 < len(t) < 500]
    ids, at = vocabulary.encode(texts)
    assert texts and all(library.encode(t) == ids[at[i] : at[i + 1]].tolist() for i, t in enumerate(texts))


def test_matrices_combine_associatively(vocabulary):
    text = " " + "thenationofthe" * 6
    m = np.stack([vocabulary.transfer(text[a : a + 10 + vocabulary.max - 1], min(10, len(text) - a)) for a in range(0, len(text), 10)])
    left = pieces.combine(pieces.combine(m[0], m[1]), m[2])
    right = pieces.combine(m[0], pieces.combine(m[1], m[2]))
    assert (left == right).all() and (pieces.prefix_scan(m)[2] == left).all()
    assert pieces.prefix_scan(m)[-1][0, 0] == vocabulary.best(text)[1]


@pytest.mark.parametrize("size", [1, 6, 500])
def test_top_k_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(topk_search, "SLAB_ROWS", size * 7)
    monkeypatch.setattr(topk_search, "GROUP_ROWS", size)
    monkeypatch.setattr(topk_search, "CHUNK_BYTES", size * 100)
    monkeypatch.setattr(topk_search, "LEAD_BYTES", size * 800)
    r = np.random.default_rng(size)
    v = (r.standard_normal((90, 9)) * r.exponential(size=(90, 1))).astype(np.float32)
    v[60:] = v[3]  # ties
    rows = [(i, x.tolist(), "x") for i, x in enumerate(v)]
    rows += [(200, None, "x"), (201, [1.0, None], "x"), (202, [float("inf")], "x"), (None, [1.0], "x"), (203, [], "x"), (220, [2.0], "x"), (5, v[5].tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = sorted(tuple(x) for x in topk_search.top_k(df, F.col("vec_id") % 20 == 0, 7).collect())
    assert got == brute_top([(i, x) for i, x, _ in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)], 7)


def brute_top(rows, k):
    """By the rule, with Python's integers; rows of one id are candidates each."""
    from fractions import Fraction

    ints = [(i, [int(Fraction(c) * 64 // 1) for c in x]) for i, x in rows]
    want = []
    for q in {i for i, _ in ints if i % 20 == 0}:
        pairs = [(-sum(a * b for a, b in zip(x, y, strict=False)), i) for j, x in ints if j == q for i, y in ints if i != q]
        want += [(q, n + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, i) in enumerate(sorted(pairs)[:k])]
    return sorted(want)


@pytest.mark.parametrize("huge", [[], [2.0**60], [1e308, -1e308, 3e300], [2.0**31, -(2.0**33)]])
def test_top_k_of_repeated_ids_and_huge_components(spark, monkeypatch, huge):
    monkeypatch.setattr(topk_search, "SLAB_ROWS", 9)
    monkeypatch.setattr(topk_search, "CHUNK_BYTES", 100)
    r = np.random.default_rng(4)
    rows = [(int(i), [float(c) for c in r.standard_normal(3) * 5]) for i in r.integers(0, 45, 60)] + [(20, [1.5]), (40, [2.0, 1.0, 0.25]), (40, [2.0, 1.0, 0.25]), (1, [2.0]), (1, [3.0])]
    rows += [(100 + i, [x, 1.0, 0.3]) for i, x in enumerate(huge)] + [(60, [x]) for x in huge[:1]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in topk_search.top_k(df, F.col("vec_id") % 20 == 0, 6).collect())
    assert got == brute_top(rows, 6)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_k(df, F.col("vec_id") % 20 == 0, 3).collect() == []


def test_word_features():
    assert toxicity.bare_word(b"Idiot,***") == "idiot" and toxicity.bare_word(b"***") == "***"
    words = ["a", "idiot", "é漢é"]
    rows, grams, count = toxicity.features(words)
    assert count.tolist() == [1, 5 + 4 + 3, 3 + 2 + 1] and len(grams) == count.sum()
    for k, w in enumerate(words):
        one = toxicity.features([w])
        assert one[0][0] == rows[k] == zlib.crc32(w.encode()) % toxicity.ROWS
        assert one[1].tolist() == grams[count[:k].sum() : count[: k + 1].sum()].tolist()
    lex = toxicity.Lexicon()
    n, at = lex.numbers(pa.array([None, "", "Idiot! idiot a"]))
    assert n.tolist() == [1, 2, 3] and at.tolist() == [0, 0, 0, 3] and lex.rows[1] == lex.rows[2]
