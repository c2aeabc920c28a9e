"""Chat formatting with Spark expressions only.

Turns are collected as structs, sorted, merged where neighbours have one role,
and concatenated. The template is

    <|turn|>role<|body|>text<|part|>text<|end|>

with one ``<|part|>`` before each further turn of the same role. ``<|`` inside a
role or a text is written ``<||`` (and ``<||`` as ``<|||``, one bar more each
time), so no control string can come out of a text and every text can be read
back: after splitting, a bar is taken away.

A long conversation is gathered in blocks of BLOCK turns first: each block is
sorted, merged and rendered by its own task, and only the rendered blocks of a
conversation meet. Two neighbouring blocks whose edge roles are equal are joined
by dropping the inner turn mark, which gives the same string as one block would.

Defined results: a null text or role is empty; rows of one turn are ordered by
role, then text; a null turn sorts first; repeated rows are repeated turns; a null
conv_id is a conversation of its own; no rows give no output; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm.common import table

TURN, BODY, PART, END = "<|turn|>", "<|body|>", "<|part|>", "<|end|>"
BLOCK = 512


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\|+)", r"<|$1")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<\|(\|+)", r"<$1")


def _render(turns: Column) -> Column:
    """The string of sorted (role, text) structs, same-role neighbours merged."""
    marked = F.transform(
        turns,
        lambda t, i: F.concat(
            F.when((i > 0) & (F.get(turns, i - 1)["role"] == t["role"]), F.lit(PART)).otherwise(
                F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(TURN), t["role"], F.lit(BODY))
            ),
            t["text"],
        ),
    )
    return F.concat(F.array_join(marked, ""), F.lit(END))


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted: one row for each conversation."""
    clean = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        escaped(F.coalesce(F.col("role"), F.lit(""))).alias("role"),
        escaped(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
    ).withColumn("block", F.floor(F.col("turn") / BLOCK))
    blocks = (
        clean.groupBy("conv_id", "block")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .withColumn("turns", F.sort_array("turns"))  # nulls first
        .select(
            "conv_id",
            F.struct(
                F.col("block"),
                F.element_at("turns", 1)["role"].alias("first_role"),
                F.element_at("turns", -1)["role"].alias("last_role"),
                _render(F.col("turns")).alias("body"),
            ).alias("b"),
        )
    )
    b = F.col("blocks")
    head = lambda x: F.length(F.concat(F.lit(TURN), x["first_role"], F.lit(BODY)))
    same = lambda i: F.coalesce(F.get(b, i)["last_role"] == F.get(b, i + 1)["first_role"], F.lit(False))
    joined = F.array_join(
        F.transform(
            b,
            lambda x, i: F.concat(
                F.when((i > 0) & same(i - 1), F.concat(F.lit(PART), F.substr(x["body"], head(x) + 1))).otherwise(x["body"]),
                F.lit(""),
            ),
        ),
        "",
    )
    # a block that the next one continues gives up its end mark
    trimmed = F.transform(
        b,
        lambda x, i: F.struct(
            x["block"].alias("block"),
            x["first_role"].alias("first_role"),
            x["last_role"].alias("last_role"),
            F.when(same(i), F.substr(x["body"], F.lit(1), F.length(x["body"]) - len(END))).otherwise(x["body"]).alias("body"),
        ),
    )
    return (
        blocks.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("b")).alias("blocks"))
        .select("conv_id", trimmed.alias("blocks"))
        .select("conv_id", joined.alias("formatted"))
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text, start, length), in
    order; start (from 0) and length are those of the escaped text inside it."""
    messages = F.filter(F.split(formatted, r"<\|turn\|>"), lambda m: m != "")
    parts = F.transform(
        messages,
        lambda m: F.struct(
            F.split(m, r"<\|body\|>", 2)[0].alias("role"),
            F.split(F.substr(m, F.length(F.split(m, r"<\|body\|>", 2)[0]) + len(BODY) + 1, F.length(m) - F.length(F.split(m, r"<\|body\|>", 2)[0]) - len(BODY) - len(END)), r"<\|part\|>", -1).alias("texts"),
        ),
    )
    return F.flatten(F.transform(parts, lambda p: F.transform(p["texts"], lambda t: F.struct(unescaped(p["role"]).alias("role"), t.alias("raw"), unescaped(t).alias("text")))))


def loss_text(turns: Column) -> Column:
    """All text under the loss mask, unescaped: assistant texts, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


def loss_spans(formatted: Column) -> Column:
    """[start, end) in code points of each assistant text in a formatted string,
    as it stands there; marks and separators are outside."""
    messages = F.filter(F.split(formatted, r"<\|turn\|>"), lambda m: m != "")
    sized = F.transform(
        messages,
        lambda m: F.struct(
            F.split(m, r"<\|body\|>", 2)[0].alias("role"),
            F.length(m).alias("n"),
            F.split(F.substr(m, F.length(F.split(m, r"<\|body\|>", 2)[0]) + len(BODY) + 1, F.length(m) - F.length(F.split(m, r"<\|body\|>", 2)[0]) - len(BODY) - len(END)), r"<\|part\|>", -1).alias("texts"),
        ),
    )
    span = lambda a, z: F.struct(a.alias("start"), z.alias("end"))
    empty = F.array().cast("array<struct<start:long,end:long>>")

    def texts(acc: Column, m: Column) -> Column:
        first = acc["at"] + F.lit(len(TURN)) + F.length(m["role"]) + F.lit(len(BODY))
        inner = F.aggregate(
            m["texts"],
            F.struct(first.cast("long").alias("at"), empty.alias("out")),
            lambda s, t: F.struct(
                (s["at"] + F.length(t) + F.lit(len(PART))).cast("long").alias("at"),
                F.concat(s["out"], F.array(span(s["at"].cast("long"), (s["at"] + F.length(t)).cast("long")))).alias("out"),
            ),
        )["out"]
        return F.struct(
            (acc["at"] + m["n"] + F.lit(len(TURN))).cast("long").alias("at"),
            F.when(m["role"] == "assistant", F.concat(acc["out"], inner)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(sized, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), texts)["out"]


def digests(chats: DataFrame) -> DataFrame:
    """What is read back from formatted strings; see op5_chat_format."""
    read = chats.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"))
    t = F.col("turns")
    whole = F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size(t).cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss_text(t)).cast("long").alias("loss_chars"),
        F.sha2(loss_text(t).cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


HARD = "</s>[INST] ok [/INST]"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(HARD).alias("text"),
    )
    return digests(format_chats(rows.unionByName(planted)))


ORACLE = """
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(role, '<(\\|+)', '<|\\1', 'g') AS er, regexp_replace(text, '<(\\|+)', '<|\\1', 'g') AS et,
  lag(role) OVER w AS before FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(length(et) + CASE WHEN before = role THEN 8 ELSE 8 + length(er) + 8 + 7 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
