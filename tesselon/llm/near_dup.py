"""Near-duplicates by one-permutation MinHash with optimal densification.

A text's set of word shingles is hashed once; the hash's top bits choose one of BINS
bins and each bin keeps its least hash. An empty bin borrows the value of a bin that
a fixed random walk from it meets first (optimal densification). BANDS bands of
BINS / BANDS values give the buckets. At similarity s, two texts share no bucket
with chance (1 - s**4)**32, which is 5e-8 at 0.8.

Texts with equal sets are one class from the start: only the smallest id of each
class goes on. Every bucket links its members in stars: first those that one task
sees, to the smallest of them, then these smallest ones to the smallest of all. So a
bucket of m texts gives m - 1 candidate pairs, and a task sends one entry for a
bucket, however large it is. Pairs are confirmed on the full sets, at most UNIT of a
star beside one copy of its hub. Confirmed links are joined to components by rounds of
star contraction on written tables.

Candidates that aren't links join components to clusters. Where a cluster holds
several components, a link could hide between two members that are both unlike their
hubs. There, all members outside the cluster's largest component are searched for links
to all members of the cluster, in blocks of a bounded number of shingles on both sides:
sets of the required similarity share one of their first few hashes, so an index of
those gives the pairs, an index of all hashes the shared ones of each, and components
that are joined already are not compared again. No pair becomes a row unless it is a link, so a link is lost only if its
texts share no bucket and lie in different clusters.

Defined results: null and empty texts have an empty set, link with nothing and stay;
a text with fewer words than the shingle width has its whole sequence as one
shingle; repeated rows of one doc_id repeat in the result, and if their texts
differ, links of either count for that doc_id; a null doc_id takes no
part and gets its own row with a null component; an empty table gives no rows; other
columns are ignored. The components don't depend on order, so there are no ties.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm import text as T
from tesselon.llm.arrays import ranges
from tesselon.llm.common import bounded, scratch, side, table, written
from tesselon.llm.components import components

BINS, BANDS = 128, 32
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@functools.cache
def _walk(attempt: int) -> np.ndarray:
    """Where each bin looks at its attempt-th try."""
    return (T.mix64(np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt + 1)) % np.uint64(BINS)).astype(np.int64)


def signatures(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The densified signature of each row's sorted set; rows without a set keep
    the empty value."""
    n = len(starts) - 1
    out = np.full((n, BINS), _EMPTY)
    if not len(sets):
        return out
    row = np.repeat(np.arange(n), np.diff(starts))
    slot = row * BINS + (sets >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]  # hashes ascend in a row, so the first of a bin is its least
    out.reshape(-1)[slot[first]] = sets[first]
    filled = np.zeros(n * BINS, bool)
    filled[slot[first]] = True
    open_ = np.flatnonzero(~filled & np.repeat(np.diff(starts) > 0, BINS))
    flat, attempt = out.reshape(-1), 0
    while len(open_):
        at = open_ // BINS * BINS + _walk(attempt)[open_ % BINS]
        hit = filled[at]
        flat[open_[hit]] = flat[at[hit]]
        open_ = open_[~hit]
        attempt += 1
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row and band."""
    n, wide = len(signature), BINS // BANDS
    key = np.tile(T.mix64(np.arange(BANDS, dtype=np.uint64)), (n, 1))
    for k in range(wide):
        key = T.mix64(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, k::wide])
    return key


def _sets(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = T.buffers(column)
    hashes, first = T.tokens(raw, offsets)
    rows, out = T.shingles(hashes, first, width)
    return T.distinct_by_row(rows, out, len(column))


def sketch(texts: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set, and the band keys as
    bytes (null for an empty set)."""

    def run(batches):
        for b in T.parts(batches, "text"):
            sets, starts = _sets(b.column("text"), width)
            n = np.diff(starts)
            some = np.flatnonzero(n)
            f1, f2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            bands: list[bytes | None] = [None] * len(n)
            if len(some):
                f1[some] = np.add.reduceat(T.mix64(sets ^ np.uint64(0x5851F42D4C957F2D)), starts[:-1][some])
                f2[some] = np.bitwise_xor.reduceat(T.mix64(sets + np.uint64(0x14057B7EF767814F)), starts[:-1][some])
                for i, keys in zip(some.tolist(), band_keys(signatures(sets, starts)[some]).astype("<u8"), strict=True):
                    bands[i] = keys.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(bands, pa.binary())], names=["doc_id", "n_shingles", "f1", "f2", "bands"]
            )

    return texts.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, bands binary")


#: Band entries that a task holds at once, entries of a shard, and entries in one row.
HELD, SHARD, ROW = 1 << 21, 1 << 19, 4096


def _hubs(key: np.ndarray, rep: np.ndarray):
    """(entries sorted by key with the smallest rep of each, (hub, member) pairs)."""
    order = np.lexsort((rep, key))
    key, rep = key[order], rep[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    hub = rep[first][np.cumsum(first) - 1] if len(key) else rep
    pairs = np.stack([hub, rep], axis=1)[hub != rep]
    return key[first], rep[first], np.unique(pairs, axis=0) if len(pairs) else pairs


def star_pairs(reps: DataFrame) -> DataFrame:
    """Distinct pairs a < b that the buckets of reps (rep, bands) give."""
    shards = max(1, -(-reps.count() * BANDS // SHARD))
    schema = "shard int, key binary, rep binary, a long, b long"
    names = ["shard", "key", "rep", "a", "b"]

    def pairs_batch(pairs, n_shards):
        n = len(pairs)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n, dtype=np.int32) % n_shards), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=names
        )

    def local(batches):
        keys, ids, size = [], [], 0

        def flush():
            key, rep, pairs = _hubs(np.concatenate(keys), np.concatenate(ids))
            yield pairs_batch(pairs, shards)
            where = (key % np.uint64(shards)).astype(np.int32)
            order = np.argsort(where, kind="stable")
            edge = np.searchsorted(where[order], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(edge)).tolist():
                cuts = list(range(edge[s], edge[s + 1], ROW))
                parts = [order[a : min(a + ROW, edge[s + 1])] for a in cuts]
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s] * n, pa.int32()), pa.array([key[x].tobytes() for x in parts], pa.binary()), pa.array([rep[x].tobytes() for x in parts], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names
                )

        for b in batches:
            keys.append(np.frombuffer(b"".join(b.column("bands").to_pylist()), "<u8"))
            ids.append(np.repeat(b.column("rep").to_numpy(), BANDS))
            size += len(keys[-1])
            if size >= HELD:
                yield from flush()
                keys, ids, size = [], [], 0
        if size:
            yield from flush()

    def whole(batches):
        now, keys, ids = None, [], []

        def flush():
            if keys:
                yield _pair_rows(_hubs(np.frombuffer(b"".join(keys), "<u8"), np.frombuffer(b"".join(ids), "<i8"))[2])

        for b in batches:
            done = np.flatnonzero(b.column("a").is_valid().to_numpy(zero_copy_only=False))
            if len(done):
                yield b.select(["a", "b"]).take(pa.array(done))
            for s, key, rep in zip(b.column("shard").to_pylist(), b.column("key").to_pylist(), b.column("rep").to_pylist(), strict=True):
                if key is None:
                    continue
                if s != now:
                    yield from flush()
                    now, keys, ids = s, [], []
                keys.append(key)
                ids.append(rep)
        yield from flush()

    sent = reps.select("rep", "bands").mapInArrow(local, schema)
    return sent.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(whole, "a long, b long").distinct()


def _pair_rows(pairs) -> pa.RecordBatch:
    pairs = np.asarray(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are as similar as that."""
    few, many = (x, y) if len(x) <= len(y) else (y, x)
    if not len(few) or 100 * len(few) < percent * len(many):
        return False
    inter = int(np.count_nonzero(many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few))
    return 100 * inter >= percent * (len(x) + len(y) - inter)


#: Pairs of one star that are confirmed together.
UNIT = 256


def verified(texts: DataFrame, stars: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b, linked and the sizes of both sets, for every pair."""
    heavy = stars.groupBy("a").agg(F.count("*").alias("size")).where(F.col("size") > UNIT)
    group = F.coalesce(F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / UNIT)), F.lit(0))
    dealt = stars.join(side(heavy), "a", "left").select("a", "b", group.alias("g"))
    asked = dealt.select(F.col("a").alias("node"), "a", "g", F.lit(0).alias("member")).distinct().unionAll(dealt.select(F.col("b").alias("node"), "a", "g", F.lit(1).alias("member")))

    def run(batches):
        unit, hubs = None, []
        for batch in T.parts(batches, "text"):
            sets, starts = _sets(batch.column("text"), width)
            a, g, member, node = (batch.column(c).to_pylist() for c in ("a", "g", "member", "doc_id"))
            out = []
            for i in range(len(a)):
                own = sets[starts[i] : starts[i + 1]]
                if not member[i]:
                    if (a[i], g[i]) != unit:
                        unit, hubs = (a[i], g[i]), []
                    hubs.append(own.copy())
                else:
                    out.append((a[i], node[i], any(_linked(own, h, percent) for h in hubs), max(map(len, hubs), default=0), len(own)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["a", "b", "linked", "na", "nb"])

    rows = texts.join(side(asked), texts["doc_id"] == asked["node"]).select("doc_id", "text", "a", "g", "member")
    return rows.repartition("a", "g").sortWithinPartitions("a", "g", "member").mapInArrow(run, "a long, b long, linked boolean, na long, nb long")


#: Shingles in one block of a cluster's members, about; blocks of so many rows are cut
#: further, as far as a cluster has fewer than so many of them.
BLOCK_SHINGLES, BLOCK_ROWS, BLOCKS = 1_000_000, 200, 24


class _Strays:
    """The members of a block that are searched for links, with an index of the hashes of
    their sets, and one of the first hashes of each."""

    def __init__(self, percent: int):
        self.percent = percent
        self.sets: list[np.ndarray] = []
        self.part: list[int] = []
        self.heads = None

    def first(self, s: np.ndarray) -> np.ndarray:
        """A set shares one of these with every set that is as similar as required."""
        return s[: len(s) + 1 - -(-self.percent * len(s) // 100)]

    def add(self, part: int, s: np.ndarray) -> None:
        if len(s):
            self.sets.append(s.copy())
            self.part.append(part)

    @staticmethod
    def _index(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(key, kind="stable")
        return key[order], owner[order]

    def build(self) -> None:
        self.heads, self.whole = self._index([self.first(s) for s in self.sets]), self._index(self.sets)
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self.joined = np.array(self.part, np.int64)  # the component that each one's component has become

    @staticmethod
    def _owners(index: tuple[np.ndarray, np.ndarray], s: np.ndarray) -> np.ndarray:
        """Whose hashes those of a set are, once for each that is shared."""
        key, owner = index
        low, high = np.searchsorted(key, s), np.searchsorted(key, s, side="right")
        hit = np.flatnonzero(high > low)
        return owner[ranges(low[hit], high[hit] - low[hit])]

    def links(self, part: int, s: np.ndarray, up: dict[int, int]):
        """The components that a member's set links its component with."""
        if self.heads is None:
            self.build()
        if not len(s) or not len(self.sets):
            return
        who = self._owners(self.heads, self.first(s))
        if not len(who):
            return
        while part in up:
            part = up[part]
        who = np.unique(who)
        small, large = np.minimum(self.size[who], len(s)), np.maximum(self.size[who], len(s))
        who = who[(100 * small >= self.percent * large) & (self.joined[who] != part)]
        if not len(who):
            return
        inter = np.bincount(self._owners(self.whole, s), minlength=len(self.sets))[who]
        for k in who[100 * inter >= self.percent * (self.size[who] + len(s) - inter)].tolist():
            other = int(self.joined[k])
            if other != part:
                yield part, other
                up[other] = part
                self.joined[self.joined == other] = part


def hidden_links(texts: DataFrame, placed: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: components that a link joins, of placed (node, n, component, cluster)."""
    sizes = placed.groupBy("cluster", "component").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    main = F.max_by(F.struct("component", "size", "n"), F.struct("size", "component"))
    info = sizes.groupBy("cluster").agg(main.alias("main"), F.sum("size").alias("size"), F.sum("n").alias("n"))
    blocks = lambda rows, n: F.ceil(F.greatest(F.least(rows / BLOCK_ROWS, F.lit(float(BLOCKS))), n / BLOCK_SHINGLES, F.lit(0.5))).cast("int")
    left = [F.col(c) - F.col(f"main.{c}") for c in ("size", "n")]
    info = info.select("cluster", F.col("main.component").alias("main"), blocks(F.col("size"), F.col("n")).alias("blocks"), blocks(*left).alias("stray_blocks"))
    own = lambda c, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(c)).cast("int")
    dealt = placed.join(side(info), "cluster").select("node", "component", "cluster", (F.col("component") != F.col("main")).alias("stray"), "blocks", "stray_blocks", own("stray_blocks", 1).alias("own_s"), own("blocks", 2).alias("own_m"))
    unit = lambda s, m, member: F.struct(s.alias("s"), m.alias("m"), F.lit(member).alias("member"))
    every = lambda c, f: F.transform(F.sequence(F.lit(0), F.col(c) - 1), f)
    strays = F.when(F.col("stray"), every("blocks", lambda m: unit(F.col("own_s"), m, 0))).otherwise(F.expr("cast(array() as array<struct<s:int,m:int,member:int>>)"))
    members = every("stray_blocks", lambda s: unit(s, F.col("own_m"), 1))
    rows = texts.join(side(dealt), texts["doc_id"] == dealt["node"]).select("text", "component", "cluster", F.explode(F.concat(strays, members)).alias("u")).select("text", "component", "cluster", "u.s", "u.m", "u.member")

    def run(batches):
        unit, held, up = None, None, {}
        for batch in T.parts(batches, "text"):
            sets, starts = _sets(batch.column("text"), width)
            out = []
            for i, (*key, member, part) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cluster", "s", "m", "member", "component")), strict=True)):
                if key != unit:
                    unit, held, up = key, _Strays(percent), {}
                own = sets[starts[i] : starts[i + 1]]
                if member:
                    out += held.links(part, own, up)
                else:
                    held.add(part, own)
            yield _pair_rows(out)

    keys = ["cluster", "s", "m"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "member").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text): texts
    are linked if 100 * |intersection| >= percent * |union| of their shingle sets."""
    bounded(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(docs.sparkSession) as keep:
        sig = written(sketch(texts, width), "sketch")
        whole = sig.where("doc_id IS NOT NULL AND n_shingles > 0")
        reps = keep(whole.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "reps")
        stars = keep(star_pairs(reps), "stars")
        checked = keep(verified(texts, stars, width, percent), "checked")
        links = checked.where("linked").select("a", "b")
        again = keep(whole.groupBy("doc_id").agg(F.min(F.struct("f1", "f2")).alias("x"), F.max(F.struct("f1", "f2")).alias("y")).where("x <> y").select("doc_id"), "again")
        if again.limit(1).count():  # ids of several texts join the classes of these
            several = whole.join(side(again), "doc_id").join(reps, ["f1", "f2"]).select("doc_id", "rep")
            links = links.unionAll(several.join(several.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")))
        found = keep(components(links), "components")

        # components that candidates join although these are no links
        lost = checked.where("NOT linked")
        up = lambda x: side(found.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")))
        apart = lost.join(up("a"), "a", "left").join(up("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b").distinct()
        cluster = keep(components(apart), "clusters").select(F.col("node").alias("component"), F.col("component").alias("cluster"))
        nodes = checked.select(F.col("a").alias("node"), F.col("na").alias("n")).unionAll(checked.select(F.col("b").alias("node"), F.col("nb").alias("n"))).groupBy("node").agg(F.max("n").alias("n"))
        nodes = nodes.join(found, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"))
        placed = keep(nodes.join(side(cluster), "component").select("node", "n", "component", "cluster"), "placed")
        hidden = keep(hidden_links(texts, placed, width, percent), "hidden")
        more = keep(components(hidden), "more")

        joined = more.select(F.col("node").alias("__part"), F.col("component").alias("__whole"))
        label = reps.select("f1", "f2", "rep", "copies").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        label = label.join(side(joined), F.col("component") == F.col("__part"), "left").select("f1", "f2", "rep", "copies", F.coalesce("__whole", "component").alias("component_id"))
        label = written(label.where("copies > 1 OR component_id <> rep").select("f1", "f2", "component_id"), "labels")
    of = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return sig.select("doc_id", "n_shingles", "f1", "f2").join(side(label), ["f1", "f2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, of).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs but one for each component, the one of the smallest doc_id.
    Rows with a null doc_id stay; of rows that repeat a doc_id one stays, the one whose
    values (but for maps) have the smallest hash."""
    found = classes(docs, width, percent)
    gone = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    again = written(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again")), "again")
    key = docs["doc_id"].cast("long")
    kept = docs.join(side(gone), key == gone["__gone"], "left_anti")
    if not again.limit(1).count():
        return kept
    once = kept.join(side(again), key == again["__again"], "left_anti")
    many = kept.join(side(again), key == again["__again"], "left_semi")
    plain = [F.col(f.name) for f in docs.schema if f.dataType.typeName() != "map"]
    marked = many.withColumn("__hash", F.xxhash64(*plain))
    least = marked.groupBy(F.col("doc_id").alias("__id")).agg(F.min("__hash").alias("__least"))
    one = marked.join(least, (F.col("doc_id") == F.col("__id")) & (F.col("__hash") == F.col("__least"))).dropDuplicates(["doc_id"])
    return once.unionByName(one.select(*docs.columns))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs, 2, 80).withColumn("kept", F.col("doc_id") == F.col("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
    ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS sh FROM w),
u AS (SELECT doc_id, unnest(sh) AS sh FROM s),
n AS (SELECT doc_id, len(sh) AS n FROM s),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM u x JOIN u y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
dir AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN dir l ON r.b = l.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = n.doc_id
"""
