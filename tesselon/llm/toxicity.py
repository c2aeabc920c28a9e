"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is the embedding of the word (lowered, outer punctuation stripped,
hashed to a row) plus the mean embedding of its character n-grams, so words never
seen are read by their spelling. Windows of WINDOW words, one every STRIDE, cover the
whole text; a network of two gated recurrent layers, one in each direction, reads a
window, attention over its states pools them, and a linear layer gives a logit. A
text's score is the calibrated largest logit over all its windows.

Training is numpy on the driver, on a bounded sample of the labelled training rows:
at most SAMPLE texts of each label, SAMPLE_CHARS characters in all, chosen by a hash
of the id. Each label has half of the characters and what the other leaves; a text that
does not fit into the rest is passed over, later ones are not. Of a text longer than
1 / SHARES of all characters, STRETCHES stretches of whole words spread evenly over it
count and are learned from, that long in all. Only texts carry labels, so training windows are chosen by log odds of
words and n-grams in the sample: from toxic texts the strongest windows, from others
the strongest and random ones. The log odds also start the first components of the
embeddings; all parameters are then trained by Adam. A logistic fit of the largest
logits on the sample calibrates scores.

Scoring keeps, for each worker, the input products of words it has met, computes a
batch of windows step by step, and is linear in the text.

Defined results: null and empty texts are one empty window, so they get a score too;
without labelled texts, or with one label only, every score is the share of label 1
(0 if there are none); a document with both labels counts as 1, labels without a text, a
label or an id teach nothing; rows that repeat an id with several texts teach with all of
them; ids that are null are scored; repeated rows repeat; an empty table gives no rows;
other columns are never read. A score of exactly 0.5 predicts 1.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm import text as T
from tesselon.llm.common import bounded, crc_mod, free_name, table

SAMPLE, SAMPLE_CHARS = 3000, 8_000_000
SHARES, STRETCHES = 64, 16
WINDOW, STRIDE = 32, 16
DIM, HIDDEN = 8, 8
ROWS = 1 << 15
CACHE_WORDS = 300_000
#: Log odds of a feature seen in n texts count n / (n + SHRINK); in training a word's
#: own embedding is left out with chance DROP, so that its spelling must do.
SHRINK, DROP, DECAY = 12, 0.5, 0.002
#: Steps of training at least (in at most 60 passes over few windows).
STEPS = 300
_OUTER = " \t\n\r\x0b\x0c.,;:!?*#%&$|\"'`()[]{}<>~^_+=/\\-«»“”„‘’…"


def bare_word(token: bytes) -> str:
    """A raw token in lower case without outer punctuation."""
    word = token.decode("utf-8", "replace").lower()
    return word.strip(_OUTER) or word


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, rows of its character 3- to 5-grams with marked ends, how
    many of those each word has), hashed for all words at once."""
    rows = np.fromiter((zlib.crc32(w.encode()) % ROWS for w in words), np.int32, len(words))
    points = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    end = np.cumsum(size)
    count = sum(np.maximum(size - n + 1, 0) for n in (3, 4, 5))
    start = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int32)
    owner = np.repeat(np.arange(len(words)), size)
    local = np.arange(len(points)) - np.repeat(end - size, size)
    h, before = points.copy(), np.zeros(len(words), np.int64)
    for n in range(2, 6):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :]
        if n < 3:
            continue
        inside = np.flatnonzero(local[: len(h)] + n <= size[owner[: len(h)]])
        who = owner[inside]
        out[start[who] + before[who] + local[inside]] = (T.mix64(h[inside]) % np.uint64(ROWS)).astype(np.int32)
        before += np.maximum(size - n + 1, 0)
    return rows, out, count


class Lexicon:
    """Numbers words by their token hash and holds their features; number 0 is
    the padding word."""

    def __init__(self):
        self.number: dict[int, int] = {}
        self.rows, self.grams, self.at = array("i", [0]), array("i"), array("q", [0, 0])

    def __len__(self):
        return len(self.rows)

    def numbers(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers of all texts, where each text starts)."""
        raw, offsets = T.buffers(column)
        h, first, a, z = T.placed_tokens(raw, offsets)
        codes, kinds = pd.factorize(h)
        where = np.zeros(len(kinds), np.int64)
        where[codes[::-1]] = np.arange(len(codes))[::-1]
        out = np.fromiter((self.number.get(k, -1) for k in kinds.tolist()), np.int64, len(kinds))
        new = np.flatnonzero(out < 0)
        if len(new):
            data, at = raw.tobytes(), where[new]
            rows, grams, count = features([bare_word(data[i:j]) for i, j in zip(a[at].tolist(), z[at].tolist(), strict=True)])
            out[new] = np.arange(len(self.rows), len(self.rows) + len(new))
            self.number.update(zip(kinds[new].tolist(), out[new].tolist(), strict=True))
            self.at.frombytes((self.at[-1] + np.cumsum(count)).astype(np.int64).tobytes())
            self.rows.frombytes(rows.tobytes())
            self.grams.frombytes(grams.tobytes())
        return (out[codes] if len(codes) else np.zeros(0, np.int64)), first

    def arrays(self, start: int = 0):
        """(word rows, n-gram rows, where each word's n-grams start) from a word on."""
        base = self.at[start]
        return np.array(self.rows[start:], np.int32), np.array(self.grams[base:], np.int32), np.array(self.at[start:], np.int64) - base


def windows(numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW word numbers, the text of each window); every word is in
    one window at least, a text without words has one of padding."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(n)), count)
    local = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    at = (first[:-1][owner] + local)[:, None] + np.arange(WINDOW)
    inside = at < first[1:][owner][:, None]
    padded = np.append(numbers, 0)
    at[~inside] = len(numbers)
    return padded[at].astype(np.int32), owner


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, forward and backward passes; all arrays are float32."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"word": 0.02 * f(ROWS, DIM), "gram": 0.02 * f(ROWS, DIM), "u": 0.1 * f(2 * HIDDEN, 1)[:, 0], "v": f(2 * HIDDEN, 1)[:, 0], "c": np.full(1, -2.0, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": f(DIM, 3 * HIDDEN), f"U{d}": f(HIDDEN, 3 * HIDDEN), f"B{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.scale, self.shift, self.prior = 1.0, 0.0, None

    def inputs(self, rows, grams, at, kept=None) -> np.ndarray:
        """Input vectors of words by their features; the padding word's is 0. kept
        marks the words whose own embedding counts (all by default)."""
        sums = np.zeros((len(rows), DIM), np.float32)
        n = np.diff(at)
        some = np.flatnonzero(n)
        if len(some):
            sums[some] = np.add.reduceat(self.p["gram"][grams], at[:-1][some], axis=0) / n[some][:, None]
            own = self.p["word"][rows[some]]
            sums[some] += own if kept is None else own * kept[some][:, None]
        return sums

    def _layer(self, g: np.ndarray, d: str, keep: bool):
        """States of one direction from its input products g (steps, rows, 3H)."""
        u, steps = self.p[f"U{d}"], len(g)
        h = np.zeros((g.shape[1], HIDDEN), np.float32)
        states, held = np.empty((steps, g.shape[1], HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            hu = h @ u
            zr = _sigmoid(g[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            if keep:
                held.append((t, h, z, r, n, hu[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            states[t] = h
        return states, held

    def logits(self, gf: np.ndarray, gb: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Window logits from input products (steps, rows, 3H) and the mask of real
        words (steps, rows)."""
        sf, hf = self._layer(gf, "f", keep)
        sb, hb = self._layer(gb, "b", keep)
        s = np.concatenate([sf, sb], axis=2)
        e = np.where(mask, s @ self.p["u"], -1e4)
        e = np.exp(e - e.max(axis=0))
        a = e / e.sum(axis=0)
        pooled = np.einsum("tbh,tb->bh", s, a)
        out = pooled @ self.p["v"] + self.p["c"][0]
        return (out, (s, a, pooled, hf, hb)) if keep else out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray):
        """(loss, gradients, gradient of x) of inputs x (steps, rows, DIM)."""
        gf, gb = x @ self.p["Wf"] + self.p["Bf"], x @ self.p["Wb"] + self.p["Bb"]
        out, (s, a, pooled, hf, hb) = self.logits(gf, gb, mask, True)
        q = _sigmoid(out)
        loss = -np.mean(np.log(np.where(y > 0, q, 1 - q) + 1e-7))
        d = ((q - y) / len(y)).astype(np.float32)
        grad = {"c": np.array([d.sum()], np.float32), "v": pooled.T @ d}
        dp = d[:, None] * self.p["v"]
        da = np.einsum("tbh,bh->tb", s, dp)
        de = a * (da - (a * da).sum(axis=0))
        grad["u"] = np.einsum("tbh,tb->h", s, de)
        ds = a[:, :, None] * dp + de[:, :, None] * self.p["u"]
        dx = np.zeros_like(x)
        for k, (name, held) in enumerate((("f", hf), ("b", hb))):
            u = self.p[f"U{name}"]
            dg = np.empty((len(x), x.shape[1], 3 * HIDDEN), np.float32)
            du, dh = np.zeros_like(u), np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, z, r, n, hun in reversed(held):
                dh = dh + ds[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * hun * r * (1 - r)
                dg[t] = np.concatenate([dz, dr, dn], axis=1)
                dhu = np.concatenate([dz, dr, dn * r], axis=1)
                du += h.T @ dhu
                dh = dh * z + dhu @ u.T
            flat = dg.reshape(-1, 3 * HIDDEN)
            grad |= {f"U{name}": du, f"W{name}": x.reshape(-1, DIM).T @ flat, f"B{name}": flat.sum(axis=0)}
            dx += dg @ self.p[f"W{name}"].T
        return loss, grad, dx


def _log_odds(hit1: np.ndarray, hit0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    odds = np.log((hit1 + 0.5) / (n1 + 1)) - np.log((hit0 + 0.5) / (n0 + 1))
    return odds * (hit1 + hit0) / (hit1 + hit0 + SHRINK)


def _logistic_fit(x: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """(scale, shift) of a ridge logistic fit of labels on x, label 1 weighted to have
    the given share. Newton steps of bounded length on standardised x: the ridge keeps
    the optimum finite where x separates the labels."""
    mean, sd = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([(x - mean) / sd, np.ones(len(x))])
    y = labels.astype(np.float64)
    w = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9)) / len(x)
    theta, ridge = np.array([1.0, 0.0]), np.array([1e-5, 1e-7])
    for _ in range(200):
        q = _sigmoid(theta @ z)
        step = np.linalg.solve((z * (w * q * (1 - q))) @ z.T + np.diag(ridge), z @ (w * (q - y)) + ridge * theta)
        size = np.linalg.norm(step)
        theta = theta - step * min(1.0, 0.5 / max(size, 1e-12))
        if size < 1e-9:
            break
    scale = max(theta[0], 1e-3) / sd
    return float(scale), float(theta[1] - scale * mean)


def train(texts: list[str], labels: np.ndarray, epochs: int = 5, batch: int = 256, seed: int = 11, prior: float | None = None, seeded: bool = True) -> Network:
    """A network fitted on whole labelled texts; prior is the share of label 1 among all
    labelled rows, where the texts are a sample with another share. Without seeded,
    embeddings start at random and two random windows of each text are learned from."""
    net = Network(seed)
    share = float(np.mean(labels)) if len(labels) else 0.0
    if share in (0.0, 1.0):
        net.prior = share
        return net
    r = np.random.default_rng(seed)
    lex = Lexicon()
    numbers, first = lex.numbers(pa.array(texts, pa.large_string()))
    rows, grams, at = lex.arrays()
    words = len(rows)

    # log odds by texts, of words and of n-grams
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    pair = np.unique(text * words + numbers)
    t, w = pair // words, pair % words
    n1, n0 = int(labels.sum()), int(len(labels) - labels.sum())

    word_hits, gram_hits = np.zeros((2, ROWS)), np.zeros((2, ROWS))

    def count(row_of: np.ndarray, owner: np.ndarray, hits: np.ndarray) -> None:
        one = np.unique(owner * ROWS + row_of)
        for k in (0, 1):
            hits[k] += np.bincount(one[labels[one // ROWS] == k] % ROWS, minlength=ROWS)

    for a in range(0, len(texts), 200):  # some texts at a time, for memory
        here = slice(*np.searchsorted(t, [a, a + 200]))
        tt, ww = t[here], w[here]
        count(rows[ww], tt, word_hits)
        size = np.diff(at)[ww]
        inner = np.repeat(at[:-1][ww] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        count(grams[inner], np.repeat(tt, size), gram_hits)
    by_word, by_gram = (_log_odds(h[1], h[0], n1, n0) for h in (word_hits, gram_hits))
    del text, pair, t, w
    if seeded:
        net.p["word"][:, 0] = 0.5 * by_word
        net.p["gram"][:, 1] = by_gram
    strength = np.maximum(by_word[rows], 0)
    some = np.flatnonzero(np.diff(at))
    strength[some] += np.maximum(np.add.reduceat(by_gram[grams], at[:-1][some]) / np.diff(at)[some], 0)
    strength[0] = 0

    # training windows
    win, owner = windows(numbers, first)
    power = np.concatenate([np.sort(strength[win[a : a + 8192]], axis=1)[:, -6:].sum(axis=1) for a in range(0, len(win), 8192)])
    order = np.lexsort((-power if seeded else r.random(len(owner)), owner))
    place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
    strong = order[place < 2]
    extra = np.flatnonzero((labels[owner] == 0) & (r.random(len(owner)) < 2 * len(texts) / len(owner)))
    chosen = np.unique(np.concatenate([strong, extra]))
    target = labels[owner[chosen]].astype(np.float32)
    win_t = win[chosen]

    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    epochs = max(epochs, min(60, -(-STEPS * batch // len(chosen))))
    for epoch in range(epochs):
        rate = 0.01 * (1 - 0.8 * epoch / epochs)
        mix = r.permutation(len(chosen))
        for a in range(0, len(mix), batch):
            pick = mix[a : a + batch]
            kinds, inverse = np.unique(win_t[pick].T, return_inverse=True)
            inverse = inverse.reshape(WINDOW, -1)
            n = np.diff(at)[kinds]
            inner = np.repeat(at[:-1][kinds] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            starts = np.concatenate([[0], np.cumsum(n)])
            kept = (r.random(len(kinds)) >= DROP).astype(np.float32)
            x = net.inputs(rows[kinds], grams[inner], starts, kept)[inverse]
            _, grad, dx = net.gradients(x, win_t[pick].T > 0, target[pick])
            dk = np.stack([np.bincount(inverse.reshape(-1), weights=dx[:, :, d].reshape(-1), minlength=len(kinds)) for d in range(DIM)], axis=1)
            dk[n == 0] = 0
            spread = np.repeat(dk / np.maximum(n, 1)[:, None], n, axis=0)
            grad["word"] = np.stack([np.bincount(rows[kinds], weights=dk[:, d] * kept, minlength=ROWS) for d in range(DIM)], axis=1).astype(np.float32)
            grad["gram"] = np.stack([np.bincount(grams[inner], weights=spread[:, d], minlength=ROWS) for d in range(DIM)], axis=1).astype(np.float32)
            step += 1
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
                if k in ("word", "gram"):
                    net.p[k] *= 1 - DECAY

    # calibration on the largest logits of whole texts, weighted to the labels' shares
    scorer = Scorer(net)
    best = scorer.largest(scorer.tables(net.inputs(rows, grams, at)), win, owner, len(texts)).astype(np.float64)
    net.scale, net.shift = _logistic_fit(best, labels, share if prior is None else prior)
    return net


class Scorer:
    """Window logits without gradients. Arrays are feature-major, the logistic function
    is a halved tanh (its halves are folded into the weights), and only the two
    projections of each state that attention needs are kept."""

    def __init__(self, net: Network):
        self.net = net
        half = np.repeat(np.float32([0.5, 0.5, 1.0]), HIDDEN)
        p = net.p
        self.half = half
        self.u = {d: np.ascontiguousarray((p[f"U{d}"] * half).T) for d in "fb"}
        self.out = {d: np.stack([p["u"][k : k + HIDDEN], p["v"][k : k + HIDDEN]]) for d, k in (("f", 0), ("b", HIDDEN))}

    def tables(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Input products of words by their input vectors."""
        return {d: (x @ self.net.p[f"W{d}"] + self.net.p[f"B{d}"]) * self.half for d in "fb"}

    def logits(self, tables: dict[str, np.ndarray], win: np.ndarray) -> np.ndarray:
        rows, steps = win.shape
        at = np.ascontiguousarray(win.T)
        marks = np.zeros((steps, 2, rows), np.float32)
        g, x = np.empty((rows, 3 * HIDDEN), np.float32), np.empty((3 * HIDDEN, rows), np.float32)
        for d in "fb":
            h = np.zeros((HIDDEN, rows), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                np.copyto(x, np.take(tables[d], at[t], axis=0, out=g, mode="clip").T)
                hu = self.u[d] @ h
                zr = np.tanh(x[: 2 * HIDDEN] + hu[: 2 * HIDDEN])
                zr *= 0.5
                zr += 0.5
                n = hu[2 * HIDDEN :]
                n *= zr[HIDDEN:]
                n += x[2 * HIDDEN :]
                np.tanh(n, out=n)
                h -= n
                h *= zr[:HIDDEN]
                h += n
                marks[t] += self.out[d] @ h
        e = np.where(at > 0, marks[:, 0], np.float32(-1e4))
        e = np.exp(e - e.max(axis=0))
        return (e * marks[:, 1]).sum(axis=0) / e.sum(axis=0) + self.net.p["c"][0]

    def largest(self, tables, win: np.ndarray, owner: np.ndarray, n: int, batch: int = 2048) -> np.ndarray:
        """The largest window logit of each text; windows stand in order of texts, and
        every text has one."""
        out = np.concatenate([self.logits(tables, win[a : a + batch]) for a in range(0, len(win), batch)])
        return np.maximum.reduceat(out, np.searchsorted(owner, np.arange(n))) if n else out


def fitting(sizes: pd.DataFrame, chars: int) -> list[int]:
    """The ids of sizes (doc_id, toxic, n), in order, that so many characters hold."""
    fit: list[int] = []
    labels = sizes.groupby("toxic")["n"].sum().sort_values(kind="stable")  # what the smaller leaves, the other has
    for k, label in enumerate(labels.index):
        left = chars // (len(labels) - k)
        for i, n in sizes.loc[sizes["toxic"] == label, ["doc_id", "n"]].itertuples(index=False):
            if n <= left:
                fit.append(i)
                left -= n
                chars -= n
    return fit


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Network:
    """A network from docs (doc_id, text) and labels (doc_id, toxic)."""
    rows = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = rows.join(docs.where(F.length("text") > 0).select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = []
    for value in (0, 1):
        chosen += [(r["doc_id"], value) for r in rows.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    if not chosen:
        net = Network()
        net.prior = 0.0
        return net
    ids = docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int")
    most = max(1, chars // SHARES // STRETCHES)
    long = F.length("text") > most * STRETCHES
    start = lambda i: (i * (F.length("text") - most) / (STRETCHES - 1)).cast("int") + 1
    stretch = lambda i: F.regexp_replace(F.substring(F.col("text"), start(i), F.lit(most)), r"^\S+\s|\s\S+$", " ")
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), stretch), " ")
    texts = docs.where(F.length("text") > 0).join(F.broadcast(ids), "doc_id")
    size = F.sum(F.least(F.length("text"), F.lit(most * STRETCHES)).cast("long"))
    sizes = texts.groupBy("doc_id", "toxic").agg(size.alias("n")).toPandas().sort_values("doc_id", key=lambda s: s.map(lambda x: zlib.crc32(str(x).encode())), kind="stable")
    fit = fitting(sizes, chars)
    got = texts.join(F.broadcast(docs.sparkSession.createDataFrame([(int(x),) for x in fit] or [(-1,)], "doc_id long")), "doc_id", "left_semi").select("doc_id", "toxic", F.when(long, spread).otherwise(F.col("text")).alias("text")).toPandas()
    got = got.sort_values(["doc_id", "text"])
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    return train(got["text"].tolist(), got["toxic"].to_numpy(), prior=n.get(1, 0) / sum(n.values()))


def score(docs: DataFrame, net: Network, keep: list[str]) -> DataFrame:
    """The kept columns with score and predicted."""
    bounded(docs)
    own = free_name("text", [*keep, "score", "predicted"])
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        scorer, lex, known = Scorer(net), Lexicon(), None
        for b in T.parts(batches, own):
            if net.prior is not None:
                q = np.full(len(b), net.prior)
            else:
                if len(lex) > CACHE_WORDS:
                    lex, known = Lexicon(), None
                numbers, first = lex.numbers(b.column(own))
                done = len(known["f"]) if known else 0
                if len(lex) > done:
                    more = scorer.tables(net.inputs(*lex.arrays(done)))
                    known = {d: np.concatenate([known[d], more[d]]) for d in "fb"} if known else more
                win, owner = windows(numbers, first)
                q = _sigmoid(net.scale * scorer.largest(known, win, owner, len(b)).astype(np.float64) + net.shift)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(q, pa.float64()), pa.array((q >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*keep, F.col("text").alias(own)).mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    net = learn(docs, labels.where(crc_mod("doc_id", 5) != 0))
    marked = docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)))
    return score(marked, net, ["doc_id", "held_out"])
