"""A training corpus from raw documents: five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with the columns
of documents (the last one returns packed pieces). n_chars follows the text.

Defined results of every stage: a null or empty text is an empty document (the classifier scores
it like any other; it has one empty line, no shingles, no words to mix and one token, the end);
texts may be of any length and are treated whole; ids may be null or repeated, as documents are
told apart by id and text; an empty table stays empty; columns beyond those of documents are
dropped, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.llm.jaccard_join import NO_ID, class_leaders
from barline.llm.line_dedup import line_dedup
from barline.llm.mixing import drawn
from barline.llm.packing import packed
from barline.llm.quality_classifier import accepted, train
from barline.llm.shared import drop_table, tables_dropped, text_of, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not reject; it learns from the labels of sf_dir (without usable ones nothing is rejected)."""
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return accepted(docs.select(*COLUMNS), net)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them hold; a document that loses all its words goes."""
    out = line_dedup(docs.select(*COLUMNS))
    stays = (F.col("n_dropped") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(stays).select("doc_id", F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("kept_text")).alias("text"), "lang", "source", "n_chars").withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (by id, null last, then by hash of text) of each class of near duplicates; a text without words stands alone."""
    keep = class_leaders(docs.select("doc_id", "text")).select(F.col("doc_id").alias("id"), "th")
    row_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id")
    has_words = text_of().rlike(r"[^\x20\x09-\x0D]")
    first = docs.where(has_words).select(row_id, F.xxhash64(text_of()).alias("th"), *COLUMNS).join(keep, ["id", "th"], "left_semi")
    one = first.groupBy("id", "th").agg(F.min(F.struct("source", "lang", "n_chars", "doc_id", "text")).alias("row"))  # rows that agree in id and text
    return one.select(*(F.col(f"row.{c}") for c in COLUMNS)).union(docs.where(~has_words).select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document for each pass that takes from it, cut after the words taken (a pass reads it from its first word).

    Documents come in the order of the shards, shuffled within each, by the block that holds
    their first word. Ids may be null or repeated, so a document is known by the hash of its id
    and text.
    """
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), text_of())
    draw = drawn(docs.select(key.alias("doc_id"), "source", "text")).select(F.col("doc_id").alias("key"), "size", F.inline("pieces"))
    takes = draw.groupBy("key", "size", "pass").agg(F.sum("words").alias("taken"), F.min_by(F.struct("shard", "slot"), "start").alias("place"))
    copy = F.row_number().over(Window.partitionBy("key").orderBy("source", "lang", "n_chars")) - 1  # rows that agree in id and text share what is taken
    both = docs.select(key.alias("key"), *COLUMNS).withColumn("copy", copy).join(takes, "key")
    both = both.withColumn("taken", F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))).where("taken > 0")
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    first = F.array_join(F.slice(words, F.lit(1), F.col("taken").cast("int")), "")
    text = F.when(F.col("taken") == F.col("size"), F.col("text")).otherwise(first)
    out = both.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.repartitionByRange("place").sortWithinPartitions("place").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048; a null or empty text is the piece of its end token."""
    return packed(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("mixing", mixture),
    ("packing", packing),
]

#: The classifier and the draw cannot be told in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's own tables, and what it has read, go as soon as its result is written."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with tables_dropped(spark) as made:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        for path in read:
            drop_table(spark, path)
        read = made
    return STAGES[-1][1](spark, docs, sf_dir)
