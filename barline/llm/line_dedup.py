r"""Lines that recur across documents, dropped through per-document keep bitmaps.

Every line key (stripped of ``[\x20\x09-\x0D]``, A-Z lower-cased) becomes two 64-bit hashes.
Hash rows are written once and then range-partitioned on (hash, document) with a secondary sort on the position,
so a line that every document holds spreads over as many ranges as its documents need. Each
range streams the first occurrence of a line in a document; those are counted per hash, a
task's count being one row. Lines of frequent hashes return to their documents as a
compressed bitmap: 64-line words, of which only those with a dropped line are stored.

Defined results: a null or empty text is one empty line; an empty key is never dropped; an
empty table gives an empty result; rows that agree in id and text are one document for the
count and get equal results; a null id is an id like any other; other columns pass by,
whatever their names, but for n_lines, n_dropped and kept_text, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WHITE, fresh, text_of, written

MIN_DOCS = 10
MIN_CHARS = 1


def _identity() -> list[Column]:
    """What tells documents apart: the hash of the text, and the id."""
    return [F.xxhash64(text_of()).alias("th"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id")]


def line_keys(text: Column) -> Column:
    """Keys of all lines, in order."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.split(lower, "\n", -1), lambda x: F.trim(x, F.lit(WHITE)))


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, id, th, pos, first: range-partitioned by hash and document, sorted by position."""
    keys = docs.select(*_identity(), text_of().alias("text")).select("id", "th", F.posexplode(line_keys(F.col("text"))).alias("pos", "key"))
    hashed = keys.where(F.length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "th", "pos")
    ranged = written(hashed, "line-hashes").repartitionByRange("h1", "h2", "id", "th")  # as a table, so that finding the ranges doesn't split the texts again
    inside = Window.partitionBy("h1", "h2", "id", "th").orderBy("pos")
    return ranged.withColumn("first", F.row_number().over(inside) == 1)


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """id, th, dropped: map of word number to the 64 bits of its dropped lines; documents that keep all lines have no row."""
    seen = written(occurrences(docs, min_chars), "line-occurrences")
    counts = seen.where("first").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))
    frequent = written(counts.where(F.col("n_docs") >= min_docs), "frequent-lines")  # a table, so that the join's hot keys can be split
    hits = seen.join(frequent, ["h1", "h2"]).groupBy("id", "th", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return hits.groupBy("id", "th").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def is_dropped(dropped: Column, pos: Column) -> Column:
    word = F.try_element_at(dropped, (pos / 64).cast("int"))
    return dropped.isNotNull() & word.isNotNull() & (F.getbit(F.coalesce(word, F.lit(0).cast("long")), pos % 64) == 1)


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with n_lines, n_dropped and the text of the lines that stay (kept_text)."""
    row_id, th, gone = fresh(docs, "id", "th", "dropped")
    maps = keep_bitmaps(docs, min_docs, min_chars).withColumnsRenamed({"id": row_id, "th": th, "dropped": gone})
    text_hash, doc = _identity()
    lines = F.split(text_of(), "\n", -1)
    dropped = F.col(gone)
    both = docs.withColumns({row_id: doc, th: text_hash}).join(maps, [row_id, th], "left")
    kept = F.when(dropped.isNull(), text_of()).otherwise(F.array_join(F.filter(lines, lambda _, i: ~is_dropped(dropped, i)), "\n"))
    count = F.coalesce(F.aggregate(F.map_values(dropped), F.lit(0), lambda n, w: n + F.bit_count(w)), F.lit(0))
    return both.withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": count.cast("long"), "kept_text": kept}).drop(row_id, th, gone)


def op5_line_dedup(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (key) GROUP BY doc_id
"""
