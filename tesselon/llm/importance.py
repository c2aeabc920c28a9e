"""Importance resampling towards a target distribution of hashed n-grams.

A position table holds one row for each word of the corpus: words are posexploded, and
window lead() over a document's words concatenates the following ones, which gives the
run of every order from 1 to ORDER that starts there. Each run is hashed to one of BUCKETS
buckets. Counts by bucket over all of the corpus and all of the target texts give a gain
for each bucket, gains are joined to the positions and summed by document, and a Gumbel
variate drawn from a hash of the id makes the highest scores a sample without replacement
whose odds are the importance weights.

Scale: texts are dealt to tasks by row, before they are exploded, so the window needs no
shuffle of words; a text of over LONG characters is cut into pieces of PIECE words (each
with the next ORDER - 1 as context), so no window holds a giant document, and pieces are
dealt separately. The position table is written once, hashed. Counts read one of its
columns at a time. Gains (BUCKETS rows) are broadcast. Ranks come from a range partitioning
and running totals of the partitions' sizes, not from one sorted task.

Defined results: a null or empty text, or one without words, has no features and weight 0; a
null id is hashed as empty text and ordered last; repeated rows and repeated ids are
documents of their own, with one score if their texts are equal and places next to each
other; ties go to the smaller id; an empty target gives every bucket the gain of T = 0, an
empty corpus no rows; with fewer than 100 / PERCENT documents of LEAST words nothing is
drawn; other columns are never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselon.llm.common import scratch, table, written

ORDER, BUCKETS = 3, 10_000
PERCENT, LEAST, SEED = 5, 20, 42
#: Texts of more characters are cut; words of a piece.
LONG, PIECE = 32_768, 4096

_UPPER = "".join(map(chr, range(65, 91)))
_OTHER = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def spaced(text: Column) -> Column:
    """A text with A-Z lowered and everything that is no word made spaces."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER + _OTHER, _UPPER.lower() + " " * len(_OTHER))


def words(text: Column) -> Column:
    """The words of a spaced text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def positions(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS, long: int = LONG, piece: int = PIECE) -> DataFrame:
    """row, doc_id, b1, b2, ...: the buckets of the runs that start at each word (null
    where the text ends before); a text without words has one row without buckets."""
    plain = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", spaced(F.col("text")).alias("text"))
    giant = F.length("text") > long
    last = F.greatest(F.ceil(F.size("w") / piece).cast("int") - 1, F.lit(0))
    cut = (
        plain.withColumn("w", F.when(giant, words(F.col("text"))))
        .select(
            "row", "doc_id", giant.alias("giant"),
            F.explode(
                F.when(
                    giant,
                    F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("part"), F.array_join(F.slice("w", i * piece + 1, F.lit(piece + order - 1)), " ").alias("text"))),
                ).otherwise(F.array(F.struct(F.lit(0).alias("part"), F.col("text"))))
            ).alias("p"),
        )
        .select("row", "doc_id", "giant", "p.*")
    )
    each = cut.repartition("row", "part").select("row", "doc_id", "giant", "part", F.posexplode_outer(words(F.col("text"))).alias("pos", "w1"))
    following = Window.partitionBy("row", "part").orderBy("pos")
    runs = each.withColumns({f"w{k + 1}": F.lead("w1", k).over(following) for k in range(1, order)})
    own = F.col("pos").isNull() | ~F.col("giant") | (F.col("pos") < piece)
    run = lambda k: F.concat(*[c for i in range(1, k + 1) for c in ([F.lit(" ")] if i > 1 else []) + [F.col(f"w{i}")]])
    bucket = lambda k: (F.crc32(run(k).cast("binary")) % buckets).cast("int").alias(f"b{k}")
    return runs.where(own).select("row", "doc_id", *(bucket(k) for k in range(1, order + 1)))


def bucket_counts(at: DataFrame, order: int = ORDER) -> DataFrame:
    """bucket, n: features in each bucket that has any."""
    each = [at.where(f"b{k} IS NOT NULL").groupBy(F.col(f"b{k}").alias("bucket")).agg(F.count("*").alias("n")) for k in range(1, order + 1)]
    return reduce(DataFrame.unionAll, each).groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of every bucket: 1000 times the log of its smoothed share of the target
    over that of the corpus, rounded down. corpus, target: bucket, n."""
    n = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionAll(target.select("bucket", F.lit(0).cast("long"), "n"))
    spark = corpus.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    each = n.unionAll(every).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    whole = each.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    share = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return each.crossJoin(F.broadcast(whole)).select("bucket", F.floor(F.lit(1000.0) * F.log(share)).cast("long").alias("gain"))  # whole is one row


def weights(at: DataFrame, gains: DataFrame, order: int = ORDER) -> DataFrame:
    """row, doc_id, n_words, n_features, weight of every document. gains: bucket, gain, a
    table of fixed size."""
    for k in range(1, order + 1):
        at = at.join(F.broadcast(gains.select(F.col("bucket").alias(f"b{k}"), F.col("gain").alias(f"g{k}"))), f"b{k}", "left")
    each = lambda c: sum((c(k) for k in range(2, order + 1)), c(1))
    return at.groupBy("row", "doc_id").agg(
        F.count("b1").alias("n_words"),
        F.sum(each(lambda k: F.col(f"b{k}").isNotNull().cast("long"))).alias("n_features"),
        F.sum(each(lambda k: F.coalesce(f"g{k}", F.lit(0).cast("long")))).alias("weight"),
    )


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel variate, rounded down, from the first 32 bits of the hash of
    seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def drawn(scored: DataFrame, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """scored with rank: 1, 2, ... by descending score and ascending id among the rows of
    at least so many words, for the highest percent of them, else null."""
    fit = F.col("n_words") >= least
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    dealt = written(scored.withColumn("fit", fit).repartitionByRange(*order).withColumn("slice", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("slice").agg(F.count("*").alias("n"), F.count_if("fit").alias("n_fit"))
    # one row for each partition of the range partitioning
    before = sizes.select(
        "slice",
        F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.floor(F.sum("n_fit").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * percent / 100).alias("take"),
    )
    place = F.row_number().over(Window.partitionBy("slice").orderBy(*order)) + F.col("before")
    ranked = dealt.join(F.broadcast(before), "slice").withColumn("place", place.cast("long"))
    return ranked.select(*scored.columns, F.when(F.col("fit") & (F.col("place") <= F.col("take")), F.col("place")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """row, doc_id, n_words, n_features, weight, score, rank of every row of docs (doc_id,
    text): rank orders the drawn ones, null for the others. target: text."""
    with scratch(docs.sparkSession) as keep:
        at = keep(positions(docs, buckets=buckets), "positions")
        aim = keep(positions(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets=buckets), "target")
        gains = keep(bucket_gains(bucket_counts(at), bucket_counts(aim), buckets), "gains")
        scored = keep(weights(at, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
        return drawn(scored, percent, least)


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    target = table(spark, sf_dir, "benchmark").select("text")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def _words_sql(texts: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({texts}, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_RUNS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"

#: CRC-32 from its definition: a table of 256 remainders, then one step a byte.
ORACLE = f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_words_sql("text")} AS w FROM documents),
b AS (SELECT {_words_sql("text")} AS w FROM benchmark),
df AS (SELECT rid, f, count(*) AS n FROM (SELECT rid, unnest({_RUNS}) AS f FROM d) GROUP BY ALL),
bf AS (SELECT f, count(*) AS n FROM (SELECT unnest({_RUNS}) AS f FROM b) GROUP BY ALL),
names AS (SELECT f, encode(f) AS e FROM (SELECT f FROM df UNION SELECT f FROM bf)),
codes AS (SELECT f, xor(list_reduce(list_transform(range(octet_length(e)), lambda k: ('0x' || substr(hex(e), 2 * k + 1, 2))::BIGINT),
  lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM names, crc),
s AS (SELECT bucket, sum(n) AS n FROM df JOIN codes USING (f) GROUP BY ALL),
t AS (SELECT bucket, sum(n) AS n FROM bf JOIN codes USING (f) GROUP BY ALL),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE)
  / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT rid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM df JOIN codes USING (f) JOIN g USING (bucket) GROUP BY rid),
x AS (SELECT rid, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN w USING (rid)),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, rid) AS place FROM x WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 5 * count(*) // 100 FROM r) THEN place END AS rank
FROM x LEFT JOIN r USING (rid)
"""
