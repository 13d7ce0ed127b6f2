"""Exact duplicates through an extendible-hash index kept as shared Parquet files.

Building. Equal texts meet on the map side already, in an aggregation on (hash, text) that
compares bytes, so a text that a third of all rows share costs one row per task. Each
different text becomes an entry. The directory doubles while a bucket is overfull: a bucket
is a prefix of the hash, and an entry's bucket is its shortest prefix that holds at most
``capacity`` entries. Buckets are contiguous in hash order; the owner tasks take key ranges,
write their buckets in order and chain the entries of one hash: ``link`` counts them, and
``links`` says how many there are. The bytes of texts on chains of several links are stored
beside the index.

Looking up. A row knows the hash of its text. The directory's cell of the hash names the
bucket, the bucket holds the chain, and the chain gives the id that stays, the size of the
group and the text's SHA-256. A chain of one link needs no further look (its only text was
compared byte by byte when the index was built); on longer ones the row's bytes are compared
with those of each link. Only hashes travel, but for texts whose hash collides.

Defined results: a null text counts as an empty one; an empty table gives an empty result;
rows with a null id take part, rank below every id and are kept only if their whole group
has null ids; a repeated row counts once per repetition in ``group_size`` and every
repetition of the keeping row says ``kept``; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import broadcast_few, new_path, text_of

#: Entries that a bucket holds before it splits.
CAPACITY = 4096
#: Bits of the directory beyond those that even buckets would need.
SLACK_BITS = 3


@dataclass(frozen=True)
class ExactIndex:
    """directory: cell -> depth, bucket; entries: bucket, h, link, links, text_sha256, n_bytes, keep_id, group_size in key ranges; chains: h, text_sha256, text of links that share a hash."""

    path: str
    directory: DataFrame
    entries: DataFrame
    chains: DataFrame
    bits: int
    hashed: Callable[[Column], Column]

    def cell(self, h: str = "h") -> Column:
        return F.expr(f"shiftrightunsigned({h}, {64 - self.bits})")


def _hashed(docs: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    text = text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), hashed(text).alias("h"))


def _sha(text: str = "text") -> Column:
    return F.unhex(F.sha2(text, 256))


def _among(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """rows whose h is one of hashes; where these are counted to be few, no text is shuffled for it."""
    return rows.join(broadcast_few(hashes), "h", "left_semi")


def directory_of(cells: DataFrame, bits: int, capacity: int) -> DataFrame:
    """cells: cell (first `bits` bits of the hash), n -> cell, depth, bucket (its first cell).

    depth is the number of doublings after which the bucket of the cell is no longer
    overfull; an overfull bucket at the last depth stays one, with a longer chain.
    """
    prefix = F.expr(f"shiftleft(shiftright(cell, {bits} - depth), {bits} - depth)")
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")).withColumn("bucket", prefix)
    fits = levels.groupBy("depth", "bucket").agg(F.sum("n").alias("held")).where((F.col("held") <= capacity) | (F.col("depth") == bits))
    return levels.join(fits, ["depth", "bucket"]).groupBy("cell").agg(F.min(F.struct("depth", "bucket")).alias("at")).select("cell", "at.depth", "at.bucket")


def build_index(docs: DataFrame, capacity: int = CAPACITY, hashed: Callable[[Column], Column] = F.xxhash64) -> ExactIndex:
    """Index every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    path = new_path(spark, "exact-index")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    texts = _hashed(docs, hashed).groupBy("h", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    loose = stored(texts.select("h", _sha().alias("text_sha256"), F.octet_length("text").cast("long").alias("n_bytes"), "keep_id", "group_size"), "loose")
    bits = min(40, max(1, math.ceil(math.log2(max(1, loose.count()) / capacity + 1)) + SLACK_BITS))
    index = ExactIndex(path, loose, loose, loose, bits, hashed)
    loose = loose.withColumn("cell", index.cell())
    directory = stored(directory_of(loose.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), bits, capacity), "directory")
    owned = loose.join(directory, "cell").repartitionByRange("bucket", "h")
    chain = Window.partitionBy("bucket", "h")
    linked = owned.withColumns({"link": F.row_number().over(chain.orderBy("text_sha256")), "links": F.count(F.lit(1)).over(chain)})
    entries = stored(linked.select("bucket", "h", "link", "links", "text_sha256", "n_bytes", "keep_id", "group_size"), "entries")
    shared_hash = entries.where("links > 1").select("h").distinct()
    chains = stored(_among(_hashed(docs, hashed), shared_hash).select("h", "text").distinct().select("h", _sha().alias("text_sha256"), "text"), "chains")
    return ExactIndex(path, directory, entries, chains, bits, hashed)


def look_up(docs: DataFrame, index: ExactIndex) -> DataFrame:
    """doc_id, keep_id, group_size, text_sha256 of every row of docs whose text the index holds."""
    rows = _hashed(docs, index.hashed)
    found = ["doc_id", "keep_id", "group_size", "text_sha256"]
    probes = rows.select("doc_id", "h", index.cell().alias("cell")).join(index.directory.select("cell", "bucket"), "cell")
    single = probes.join(index.entries.where("links = 1"), ["bucket", "h"]).select(*found)
    # several texts share the hash: the row's bytes are compared with those of each link
    along = index.entries.where("links > 1").join(index.chains, ["h", "text_sha256"]).select("bucket", "h", "text_sha256", "keep_id", "group_size", F.col("text").alias("link_text"))
    colliding = _among(rows, index.chains.select("h").distinct()).withColumn("cell", index.cell()).join(index.directory.select("cell", "bucket"), "cell")
    chained = colliding.join(along, ["bucket", "h"]).where(F.col("text") == F.col("link_text")).select(*found)
    return single.union(chained)


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    return look_up(docs, build_index(docs, capacity, hashed)).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("text_sha256")).alias("text_sha256"))


def op9_exact_dedup(spark, sf_dir) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
