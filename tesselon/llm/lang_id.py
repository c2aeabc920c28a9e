"""Language identification with hyperdimensional n-gram profiles.

Every letter, of any script, has a vector of +1 and -1 of its own, made of the bits of a
seeded hash of its code point; so has the boundary of a word. A trigram's vector binds its
letters' vectors, permuted by position: ``roll(L[a], 2) * roll(L[b], 1) * L[c]``. A
text's vector bundles (adds) the vectors of its trigrams, a language's prototype
those of its training texts; the language is the prototype with the largest
cosine. Prototypes are scaled to length 1 and the mean prototype is taken away, so
what languages share does not count.

Bundling is linear: a task counts the trigrams of its texts, bundles what it counted, and
hands on one vector a language, never trigrams. Likewise the product of a text's vector
and a prototype is the sum over the text's trigrams of (trigram vector . prototype), so
each distinct trigram of a batch is bound and multiplied once. Prototypes lie in the shared
folder, 8 KiB a language, as whole numbers (multiples of 2**-GRAIN), which keeps sums exact
and results free of how rows are dealt. Every language that occurs is learned, however many
there are; the driver holds their names, a worker their prototypes (16 KiB each).
A text's own length divides all its cosines alike; it cancels in the choice and in the
score, the largest cosine's share of the positive ones.

Defined results: null text or a text without a letter is ``und`` with score 0, and
so is every text when nothing could be learned; rows with a null label or text teach
nothing; ties go to the smaller language; rows with a null id learn and are not held
out; repeated rows repeat, and count repeatedly; an empty table gives no rows; other
columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm import arrays
from tesselon.llm.common import bounded, crc_mod, free_name, new_folder, scratch, table
from tesselon.llm.text import mix64, parts

DIMENSIONS = 2048
UNKNOWN = "und"
#: Bits of a trigram id for each letter; letters lie below the end of plane 3.
POINT_BITS, PLANES = 21, 0x40000
#: Prototypes are held in multiples of 2**-GRAIN.
GRAIN = 20
#: Trigrams bound at a time; counted ones that a task holds before it bundles them, and
#: products that a worker keeps; products of a batch made at a time.
BLOCK, HELD, WIDE = 1024, 1 << 20, 1 << 23
#: Partial prototypes of a language are summed in this many groups, then together.
SPREAD = 64


@functools.cache
def _letter_table() -> np.ndarray:
    """The lowered code point of each letter, 0 for what is no letter."""
    return np.array([ord(c.lower()[0]) if (c := chr(cp)).isalpha() else 0 for cp in range(PLANES)], np.int32)


def letter_vectors(points: np.ndarray, seed: int) -> np.ndarray:
    """The vectors of some code points, as rows of +1 and -1."""
    words = np.arange(DIMENSIONS // 64, dtype=np.uint64)
    salt = mix64(np.array([seed], np.uint64))
    keys = mix64(mix64(points.astype(np.uint64) + salt)[:, None] + (words + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(keys.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def trigram_vectors(ids: np.ndarray, seed: int) -> np.ndarray:
    """The bound vectors of some trigrams."""
    mask = (1 << POINT_BITS) - 1
    points = np.stack([ids >> 2 * POINT_BITS, ids >> POINT_BITS & mask, ids & mask])
    letters, at = np.unique(points, return_inverse=True)
    one = letter_vectors(letters, seed)
    a, b, c = at.reshape(points.shape)
    return np.roll(one, 2, axis=1)[a] * np.roll(one, 1, axis=1)[b] * one[c]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, place of the kind) of every trigram of every text, and the ids of the
    kinds in order; runs of non-letters count as one boundary, and each text has one at
    either end."""
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), dtype=np.uint32)
    codes = _letter_table()[np.minimum(points, PLANES - 1)]
    owner = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    keep = codes > 0
    keep[1:] |= codes[:-1] > 0
    codes, owner = codes[keep], owner[keep]
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.zeros(PLANES, bool)
    seen[codes] = True
    seen[0] = True
    letters = np.flatnonzero(seen)
    place = np.zeros(PLANES, np.int32 if len(letters) < 1290 else np.int64)  # cubes fit
    place[letters] = np.arange(len(letters))
    n, at = len(letters), place[codes]
    before = np.concatenate([at[:1] * 0, at[:-1]])  # what stands before a text's first letter is a boundary
    after = np.concatenate([at[1:], at[:1] * 0])
    inner = at > 0
    tri = ((before * n + at) * n + after)[inner]
    if n**3 <= 1 << 22:
        there = np.zeros(n**3, bool)
        there[tri] = True
        kinds = np.flatnonzero(there)
        index = np.zeros(n**3, np.int64)
        index[kinds] = np.arange(len(kinds))
        kind = index[tri]
    else:
        kinds, kind = np.unique(tri, return_inverse=True)
    ids = letters[kinds // n // n] << 2 * POINT_BITS | letters[kinds // n % n] << POINT_BITS | letters[kinds % n]
    return owner[inner], kind, ids


def bundle(ids: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    """The sum of counts[i] copies of each trigram's vector, exact."""
    total = np.zeros(DIMENSIONS)
    for i in range(0, len(ids), BLOCK):
        total += counts[i : i + BLOCK].astype(np.float64) @ trigram_vectors(ids[i : i + BLOCK], seed).astype(np.float64)
    return total


def products(ids: np.ndarray, protos: np.ndarray, seed: int) -> np.ndarray:
    """(vector of a trigram) . prototype, a row for each trigram. Prototypes are whole
    numbers, so that no order of summing changes a product."""
    out = np.empty((len(ids), len(protos)))
    for i in range(0, len(ids), BLOCK):
        out[i : i + BLOCK] = trigram_vectors(ids[i : i + BLOCK], seed).astype(np.float64) @ protos.T
    return out


class Products:
    """Products with all prototypes that a worker keeps from batch to batch; once more than
    HELD numbers are kept, those of the last batch only."""

    def __init__(self, protos: np.ndarray, seed: int):
        self.protos, self.seed = protos, seed
        self.ids, self.rows = np.zeros(0, np.int64), np.zeros((0, len(protos)))

    def of(self, ids: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.ids, ids)
        held = np.zeros(len(ids), bool)
        inside = at < len(self.ids)
        held[inside] = self.ids[at[inside]] == ids[inside]
        out = np.empty((len(ids), len(self.protos)))
        out[held] = self.rows[at[held]]
        out[~held] = products(ids[~held], self.protos, self.seed)
        if not held.all():
            if self.rows.size + out.size > HELD:
                self.ids, self.rows = ids, out
            else:
                every = np.concatenate([self.ids, ids[~held]])
                order = np.argsort(every, kind="stable")
                self.ids, self.rows = every[order], np.concatenate([self.rows, out[~held]])[order]
        return out

    def dots(self, owner: np.ndarray, kind: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        """Prototypes x texts: the products of n texts' vectors with each prototype."""
        out, k = [], len(self.protos)
        step = max(1, WIDE // max(len(ids), 1))  # prototypes at a time; nearly always all
        for i in range(0, k, step):
            rows = self.of(ids) if step >= k else products(ids, self.protos[i : i + step], self.seed)
            out += [np.bincount(owner, weights=r[kind], minlength=n) for r in np.ascontiguousarray(rows.T)]
        return np.stack(out)


def bundled(labelled: DataFrame, seed: int) -> DataFrame:
    """lang, vector (bytes of doubles): partial prototypes of a frame with text and lang, at
    least one a task and language."""
    bounded(labelled)

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def emit():
            for lang, got in held.items():
                ids, n = (np.concatenate(c) for c in zip(*got, strict=True))
                kinds, at = np.unique(ids, return_inverse=True)
                vector = bundle(kinds, np.bincount(at, weights=n), seed)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang], pa.string()), "vector": pa.array([vector.tobytes()], pa.binary())})
            held.clear()

        for b in parts(batches, "text"):
            owner, kind, ids = trigrams(b.column("text").to_pylist())
            lang = b.column("lang").dictionary_encode()
            code = lang.indices.to_numpy(zero_copy_only=False)[owner]
            for k, name in enumerate(lang.dictionary.to_pylist()):
                n = np.bincount(kind[code == k], minlength=len(ids))
                some = np.flatnonzero(n)
                held.setdefault(name, []).append((ids[some], n[some]))
                size += len(some) + 1
                if size > HELD:
                    yield from emit()
                    size = 0
        yield from emit()

    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    return rows.mapInArrow(run, "lang string, vector binary")


class Profiles(NamedTuple):
    """Learned languages, in order, the folder of their prototypes, and their seed."""

    folder: str
    langs: list[str]
    seed: int = 7


def learn(labelled: DataFrame, seed: int = 7) -> Profiles:
    """Profiles of every language of labelled (text, lang). Each task hands on one vector a
    language; the driver gets names and one summed vector a task."""
    spark = labelled.sparkSession
    folder = new_folder(spark, "languages")

    def added(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [g["lang"].iloc[0]], "vector": [sum(map(np.frombuffer, g["vector"])).tobytes()]})

    def scaled(v: np.ndarray) -> np.ndarray:
        return np.rint(v * (2.0**GRAIN / max(float(np.linalg.norm(v)), 1e-12)))

    def total(batches):
        held = np.zeros(DIMENSIONS)
        for b in batches:
            for v in b.column("vector").to_pylist():
                held += scaled(np.frombuffer(v))
        yield pa.RecordBatch.from_pydict({"vector": pa.array([held.tobytes()], pa.binary())})

    with scratch(spark) as keep:
        some = bundled(labelled, seed).withColumn("part", F.spark_partition_id() % SPREAD)
        few = some.groupBy("lang", "part").applyInPandas(added, "lang string, vector binary")
        protos = keep(few.groupBy("lang").applyInPandas(added, "lang string, vector binary"), "prototypes")
        langs = sorted(r["lang"] for r in protos.select("lang").collect())
        if not langs:
            return Profiles(folder, [], seed)
        mean = sum(np.frombuffer(r["vector"]) for r in protos.select("vector").mapInArrow(total, "vector binary").collect()) / len(langs)

        def store(batches):
            place = {x: i for i, x in enumerate(langs)}
            for b in batches:
                done = []
                for lang, v in zip(b.column("lang").to_pylist(), b.column("vector").to_pylist(), strict=True):
                    own = scaled(np.frombuffer(v))
                    own = scaled(own - mean) if len(langs) > 1 else own
                    arrays.save(folder, str(place[lang]), {"prototype": own.astype(np.int32)})
                    done.append(lang)
                yield pa.RecordBatch.from_pydict({"lang": pa.array(done, pa.string())})

        protos.mapInArrow(store, "lang string").agg(F.count("*")).first()
    return Profiles(folder, langs, seed)


def predict(docs: DataFrame, profiles: Profiles, keep: list[str], into: tuple[str, str] = ("lang_pred", "score"), text: str = "text") -> DataFrame:
    """The kept columns of docs with the language of a text column and its score, named
    by into."""
    bounded(docs)
    schema = docs.select(*keep).schema.add(into[0], "string").add(into[1], "double")
    langs = profiles.langs
    own = free_name("text", [*keep, *into])

    def run(batches):
        names = pa.array([*langs, UNKNOWN], pa.string())
        protos = np.array([arrays.mapped(profiles.folder, str(i))["prototype"] for i in range(len(langs))], np.float64)
        known = Products(protos, profiles.seed)
        for b in parts(batches, own):
            texts = b.column(own).fill_null("").to_pylist()
            owner, kind, ids = trigrams(texts)
            n, k = len(texts), len(langs)
            best, score = np.full(n, k), np.zeros(n)
            if k:
                dots = known.dots(owner, kind, ids, n)
                some = np.bincount(owner, minlength=n) > 0
                share = np.maximum(dots, 0)
                top = share.max(axis=0)
                total = share.sum(axis=0)
                best = np.where(some, dots.argmax(axis=0), k)
                score = np.where(some & (total > 0), top / np.where(total > 0, total, 1), 0.0)
            cols = [b.column(i) for i in range(len(keep))] + [names.take(pa.array(best)), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *into])

    return docs.select(*keep, F.col(text).alias(own)).mapInArrow(run, schema)


def op10_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    marked = docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)))
    return predict(marked, learn(marked.where("NOT held_out")), ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")
