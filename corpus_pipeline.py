"""The corpus pipeline over documents.

Five stages, each a function of (spark, docs, sf_dir):

1. lang_id: learn language profiles from the documents' own labels, drop documents
   without an identifiable language (no letters), fill in missing labels;
2. near_dup: keep one document of each group of near copies (five-word shingles,
   similarity 0.8 or more);
3. decontaminate: drop documents that hold a benchmark item (0.8 of its five-word
   shingles or more);
4. secrets: replace every secret, also those in encoded layers, by a mask;
5. pieces: encode the texts; the result is doc_id, n_tokens, token_ids, round_trip.

All stages but the last return the columns that they are given. Each works on all rows
that the stage before kept.

Defined results: a null or empty text has no letter and goes in stage 1; without any
labelled text nothing can be told there, and all documents stay; a null doc_id passes
every stage that its text passes (near copies among such rows are kept, since there is no
id to choose by); rows that repeat a doc_id are one document to stage 2, which keeps one
of them; an empty benchmark removes nothing; an empty table gives no rows; columns that
the stages don't know pass unchanged, whatever their names. Ties have no influence but in
stage 1 (the smaller language) and for repeated ids (near_dup.deduplicated).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm import decontaminate, lang_id, near_dup, pieces, secret_scan
from tesselon.llm.common import dropped, free_name, new_folder, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose language is undetermined (no letter); null labels become
    the predicted language, others stay. Without labelled texts: docs as they are."""
    profiles = lang_id.learn(docs.select("text", "lang"))
    if not profiles.langs:
        return docs
    found = free_name("lang_found", docs.columns)
    score = free_name("lang_score", docs.columns)
    marked = lang_id.predict(docs, profiles, docs.columns, (found, score)).where(F.col(found) != lang_id.UNKNOWN)
    return marked.withColumn("lang", F.coalesce("lang", found)).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without near copies: of each group the row of the smallest doc_id. Texts
    without words are near nothing; rows with a null doc_id stay."""
    return near_dup.deduplicated(docs).select(*docs.columns)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows whose text holds an item of the table benchmark."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate.decontaminated(docs, items).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with every found span of text masked, and n_chars, if there is such a column,
    the new length; null texts stay null."""
    out = secret_scan.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and round_trip of every row of docs; a null text has
    no tokens."""
    return pieces.encode(docs.select("doc_id", "text"), ["doc_id"], pieces.Vocabulary.load())


STAGES = [
    ("lang_id", identify),
    ("near_dup", deduplicate),
    ("decontaminate", remove_leaks),
    ("secrets", mask_secrets),
    ("pieces", encode),
]

#: SQL can't express language profiles, decoded layers or piece segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents. Each stage's rows are written
    to the shared folder, and deleted when the next stage's are."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = new_folder(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            dropped(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
