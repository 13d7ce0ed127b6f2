r"""How far the sources of a language differ in their words: DuckDB counts shards, Spark merges.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. Each task counts the
terms of its documents in DuckDB (occurrences, documents), so a frequent term is one row per
task, source and language. The counts are hashed by language and term; each such shard is summed
by a SQL query that keeps the terms in at least ``MIN_DOCS`` documents of the language. With the
totals of every source known, the kept counts are sharded again by (language, term), and each
shard gives partial sums for every pair of sources and its best terms for every source. Spark
adds the partial sums and ranks.

A pair's sum of |p - q| over all kept terms is not taken over the terms that neither has. With
p0 for the p of a term that a source lacks, it is V |p0 - q0|, plus |p - q0| - |p0 - q0| for each
term of the one, which depends on the count alone and so goes by the histogram of p, the like for
the other, and a correction for each term that both have. All of it is integer arithmetic.

DuckDB has ``MEMORY`` in each task and spills to the task's temporary folder beyond; texts over
``PIECE`` characters are cut between terms.

Defined results: null text, lang and source are empty strings; a document without terms still
makes its group occur; a language without kept terms has pairs of value 0 and no terms; ranks
break ties by the UTF-8 order of the item; repeated rows are documents of their own; ids are not
looked at; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_of, written

MIN_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Memory of DuckDB in a task; characters of a text that are split into terms at once, and of all texts that are counted together.
MEMORY, PIECE, CHUNK = "256MB", 1 << 20, 1 << 22
#: Kept counts of a shard, about.
SHARD = 50_000

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = f"SELECT doc, lang, source, unnest(regexp_extract_all({_LOWER}, '{TERM}')) AS term FROM pieces"
_PER_DOC = f"INSERT INTO words SELECT doc, lang, source, term, count(*) FROM ({_SPLIT}) GROUP BY ALL"
_PER_CHUNK = "INSERT INTO counts SELECT lang, source, term, sum(n), count(*) FROM (SELECT doc, lang, source, term, sum(n) AS n FROM words GROUP BY ALL) GROUP BY ALL"
_PER_TASK = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM counts GROUP BY ALL"
_KEPT = """
WITH terms AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL HAVING sum(docs) >= {min_docs})
SELECT lang, source, term, sum(n)::BIGINT AS n FROM counts SEMI JOIN terms USING (lang, term) GROUP BY ALL
UNION ALL SELECT lang, NULL, term, n::BIGINT FROM terms
"""
_P = "(1 + {scale}::HUGEINT * ({n} + {smoothing}) // (total + {smoothing} * v))::BIGINT"
_SHARD = """
WITH groups AS (
  SELECT lang, source, n AS total, terms AS v, {p0} AS p0 FROM rows WHERE term IS NULL AND terms > 0),
bare AS (SELECT lang, source FROM rows WHERE term IS NULL AND terms = 0 AND source IS NOT NULL),
whole AS (
  SELECT r.lang, r.term, {p} AS q FROM rows r JOIN groups g ON g.lang = r.lang AND g.source IS NULL
  WHERE r.term IS NOT NULL AND r.source IS NULL),
sources AS (
  SELECT g.*, w.here FROM groups g JOIN (SELECT lang, count(*) AS here FROM whole GROUP BY lang) w USING (lang)
  WHERE source IS NOT NULL
  UNION ALL SELECT g.*, 0 FROM groups g WHERE {first} AND source IS NOT NULL AND lang NOT IN (SELECT lang FROM whole)
  UNION ALL SELECT lang, source, 0, 0, 0, 0 FROM bare WHERE {first}),
cells AS (
  SELECT r.lang, r.source, r.term, {p} AS p, p0 FROM rows r JOIN groups g ON g.lang = r.lang AND g.source = r.source
  WHERE r.term IS NOT NULL AND r.n > 0),
shapes AS (SELECT lang, source, p, p0, count(*) AS m FROM cells GROUP BY ALL),
sums AS (
  SELECT a.lang, a.source AS s, b.source AS r, sum(abs(a.p - b.p) - abs(a.p - b.p0) - abs(b.p - a.p0) + abs(a.p0 - b.p0)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
  UNION ALL
  SELECT h.lang, least(h.source, g.source), greatest(h.source, g.source), sum(m * (abs(h.p - g.p0) - abs(h.p0 - g.p0)))
  FROM shapes h JOIN sources g ON g.lang = h.lang AND g.source <> h.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, b.source, a.here * abs(a.p0 - b.p0) FROM sources a JOIN sources b ON a.lang = b.lang AND a.source < b.source)
SELECT lang, s AS source, 'pair' AS part, r AS item, sum(value)::BIGINT AS value FROM sums GROUP BY ALL
UNION ALL
SELECT lang, source, 'term', term, p - q FROM cells JOIN whole USING (lang, term) WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {top}
"""

COUNTS = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, source string, term string, n long"
PARTIAL = "lang string, source string, part string, item string, value long"


@contextmanager
def database() -> Iterator[duckdb.DuckDBPyConnection]:
    """A DuckDB of one thread and bounded memory that spills to a folder of the task's own."""
    with tempfile.TemporaryDirectory() as folder:
        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False})
        try:
            yield con
        finally:
            con.close()


def pieces_of(text: str, size: int = PIECE) -> Iterator[str]:
    """text in pieces of about size characters, cut where no term is."""
    gap = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")
    at = 0
    while len(text) - at > size:
        cut = gap.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _batches(con: duckdb.DuckDBPyConnection, sql: str) -> Iterator[pa.RecordBatch]:
    yield from con.sql(sql).to_arrow_reader(1 << 14)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text: the terms that the task's documents count."""
    with database() as con:
        con.execute("CREATE TABLE words (doc BIGINT, lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT)")
        con.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        held: list[tuple] = []
        size = doc = 0

        def split() -> None:
            nonlocal size
            if held:
                con.register("pieces", pa.table(list(map(list, zip(*held, strict=True))), names=["doc", "lang", "source", "text"]))
                con.execute(_PER_DOC)
                con.unregister("pieces")
            held.clear()
            size = 0

        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for piece in pieces_of(text):
                    held.append((doc, lang, source, piece))
                    size += len(piece)
                    if size >= CHUNK:
                        split()
                if not held:  # the chunk ends with the document
                    con.execute(_PER_CHUNK)
                    con.execute("TRUNCATE words")
                doc += 1
        split()
        con.execute(_PER_CHUNK)
        yield from _batches(con, _PER_TASK)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: partial counts, one row per task at most."""
    return docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of().alias("text")).mapInArrow(_counted, COUNTS)


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n of the terms in at least min_docs documents of the language; source null: of the whole language."""
    sql = _KEPT.format(min_docs=int(min_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with database() as con:
            con.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
            for b in batches:
                con.register("part", pa.Table.from_batches([b]))
                con.execute("INSERT INTO counts SELECT * FROM part")
                con.unregister("part")
            yield from _batches(con, sql)

    return term_counts(docs).repartition("lang", "term").mapInArrow(run, KEPT)


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n (occurrences of kept terms), terms (kept ones of the language); source null: the whole language."""
    found = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source")).distinct()
    counted = kept.where(F.col("source").isNotNull()).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    whole = kept.where(F.col("source").isNull()).groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("terms"))
    zero = F.lit(0).cast("long")
    sources = found.join(counted, ["lang", "source"], "left").join(whole.select("lang", "terms"), "lang", "left").select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("terms", zero).alias("terms"))
    return sources.union(whole.select("lang", F.lit(None).cast("string"), "n", "terms"))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, smoothing: int = SMOOTHING) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language the others by distance, and the terms it has more of."""
    kept = written(kept_counts(docs, min_docs), "kept-terms")
    totals = written(group_totals(docs, kept), "source-totals")
    shards = max(1, -(-kept.count() // SHARD))
    numbers = {"scale": SCALE, "smoothing": int(smoothing)}
    p, p0 = (_P.format(n=n, **numbers) for n in ("r.n", "0"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        with database() as con:
            con.register("rows", rows)
            return con.sql(_SHARD.format(p=p, p0=p0, top=int(top), first=key[0].as_py() == 0)).to_arrow_table()

    cells = kept.select(F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard"), "lang", "source", "term", "n", F.lit(None).cast("long").alias("terms"))
    everywhere = totals.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "lang", "source", F.lit(None).cast("string").alias("term"), "n", "terms")
    partial = written(cells.union(everywhere).groupBy("shard").applyInArrow(run, PARTIAL), "shard-sums")

    pairs = partial.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.inline(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = partial.where("part = 'term'").select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)
    return ranked.union(terms)


def op12_source_divergence(spark, sf_dir) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents),
words AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
per_doc AS (SELECT doc, lang, source, term, count(*) AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM per_doc GROUP BY lang, term HAVING count(*) >= 30),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, sum(n) AS n FROM per_doc SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, s.v, s.n AS lang_n, k.n AS term_n,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS source_n
  FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c USING (lang, source, term)),
ps AS (
  SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 5) // (source_n + 5 * v) AS p,
         1 + 1000000000::HUGEINT * (term_n + 5) // (lang_n + 5 * v) AS q
  FROM cells),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value
             FROM ps x JOIN ps y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) d
    ON d.lang = a.lang AND d.source = a.source AND d.other = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM ps WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 50
"""
