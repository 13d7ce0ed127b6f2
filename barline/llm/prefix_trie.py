r"""Prefix trie of conversations, by smallest-member ownership.

A conversation is rebuilt from the head of another one (see ``rebuilt``) and is a path of turns
from the textless root. A node, a distinct sequence of first turns, belongs to the smallest
conversation that runs through it, so every conversation owns a suffix of its path, which may be
empty. Windows mark what each owns; running sums from the end of the path then give every row
the words below it that its conversation does not own and whether its end is an owned leaf; and
one group-by of the prefixes adds these up: occurrences minus owned ones are what sharing the
prefixes saves.

Where a conversation or a prefix may hold a third of all rows:

* places, prefix keys and the sums from the end run in blocks of a conversation, which the totals
  of its other blocks then shift (``carried``);
* a prefix is marked in two windows, first among a share of its conversations, then among the
  smallest of each share; there are about as many shares as a share has rows;
* the ids that end at a node are joined in blocks of a sorted range; one task per node streams
  the blocks, not the ids.

Turns are compared by MD5 (128 bits) of role and text, prefixes by depth and 128 bits of hash.

Defined results: a null role or text is empty; turns are ordered by turn, null first, then by
MD5 of role and text, and repeated rows are turns of their own; rows without a conv_id belong to
no conversation and take no part; a conversation that is left without turns is a member of the
root; texts may be of any length; an empty table has no node, as nothing runs through the root;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_of, word_count, written

#: Conversations whose heads are alike: those of one multiple of FAMILY; HEADS turns of the first one at most, less one.
FAMILY, HEADS = 20, 4
#: Turns of a conversation that are summed together.
BLOCK = 4096
#: Ids that are joined to one string.
IDS = 1 << 16

NODE = ("depth", "k1", "k2")
BLOCKS = "depth long, k1 long, k2 long, first long, ids string"
DIGESTS = "depth long, k1 long, k2 long, ends_sha256 string"


def carried(df: DataFrame, key: str, block: str, order: list[Column], sums: dict[str, Column], fold: Callable = F.sum) -> DataFrame:
    """df with a running ``fold`` (sum or bit_xor) of each column in ``sums`` over ``order`` within ``key``.

    Blocks follow each other in the order of ``block``; each is folded alone and then shifted by
    what the blocks before it come to, so no task holds more than a block of a key, or the
    totals of its blocks.
    """
    inside = Window.partitionBy(key, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(key, block).agg(*(fold(c).alias(f"_{n}") for n, c in sums.items()))
    shifts = totals.select(key, block, *(fold(f"_{n}").over(before).alias(f"_{n}") for n in sums)).where(F.col(f"_{next(iter(sums))}").isNotNull())
    both = df.withColumns({n: fold(c).over(inside) for n, c in sums.items()}).join(shifts, [key, block], "left")
    join = (lambda a, b: a.bitwiseXOR(b)) if fold is F.bit_xor else (lambda a, b: a + b)
    return both.withColumns({n: join(F.col(n), F.coalesce(F.col(f"_{n}"), F.lit(0).cast("long"))) for n in sums}).drop(*(f"_{n}" for n in sums))


def head_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return (F.crc32(conv_id.cast("string")) % HEADS).cast("long")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, len) and their paths (conv_id, depth, x1, x2, words, len; a row at depth 0 for the root).

    Conversation c is the first h turns of conversation c - c % FAMILY (all if it has fewer) and
    then its own turns after its first h.
    """
    role, text = text_of("role"), text_of("text")
    turn = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("t")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn, word_count(text).alias("words"))
    order = [F.col("turn").asc_nulls_first(), F.col("t").asc()]
    turns = written(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    placed = carried(turns, "conv_id", "part", order, {"pos": F.lit(1).cast("long")})

    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    firsts = lengths.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    head = F.least("h", F.coalesce("base_n", F.lit(0).cast("long")))
    known = lengths.withColumns({"h": head_turns(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % FAMILY}).join(firsts, "base", "left")
    convs = written(known.select("conv_id", "base", "h", (F.col("h") - head).alias("gap"), (head + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))).alias("len")), "conversations")

    parts = turns.select("conv_id", "part").distinct().join(convs, "conv_id")
    own = placed.join(parts, ["conv_id", "part"]).where(F.col("pos") > F.col("h")).select("conv_id", (F.col("pos") - F.col("gap")).alias("depth"), "t", "words", "len")
    heads = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "t", "words")
    given = convs.join(heads, "base").where(F.col("depth") <= F.col("h")).select("conv_id", "depth", "t", "words", "len")
    hashes = [F.xxhash64("depth", "t").alias("x1"), F.xxhash64("t", "depth").alias("x2")]
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), zero.alias("words"), "len")
    return convs, own.unionByName(given).select("conv_id", "depth", *hashes, "words", "len").unionByName(roots)


def marked(paths: DataFrame, shares: int) -> DataFrame:
    """paths with the key of the node (k1, k2) and of its parent (p1, p2), and whether its conversation owns the node (owned) and a leaf in it (leaf)."""
    keyed = carried(paths.withColumn("block", F.expr(f"depth div {BLOCK}")), "conv_id", "block", [F.col("depth").asc()], {"k1": F.col("x1"), "k2": F.col("x2")}, F.bit_xor)
    keyed = keyed.withColumns({"p1": F.col("k1").bitwiseXOR(F.col("x1")), "p2": F.col("k2").bitwiseXOR(F.col("x2")), "share": F.pmod(F.xxhash64("conv_id"), F.lit(shares))}).drop("block", "x1", "x2")
    among = Window.partitionBy(*NODE, "share")
    first = keyed.withColumns({"least": F.min("conv_id").over(among), "deep": F.max("len").over(among)})
    ahead = F.col("conv_id") == F.col("least")
    overall = Window.partitionBy(*NODE, F.when(ahead, -1).otherwise(F.col("share")))
    both = first.withColumns({"owner": F.min("conv_id").over(overall), "deepest": F.max("deep").over(overall)})
    owned = ahead & (F.col("conv_id") == F.col("owner"))
    leaf = owned & (F.col("len") == F.col("depth")) & (F.col("deepest") == F.col("depth"))
    return both.select("conv_id", *NODE, "p1", "p2", "words", "len", owned.alias("owned"), leaf.alias("leaf"))


def _id_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of nodes and ids, sorted: the ids of a node in blocks."""
    node, first, ids = None, 0, []
    out: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=["depth", "k1", "k2", "first", "ids"])

    for b in batches:
        for d, k1, k2, c in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if node != (d, k1, k2) or len(ids) == IDS:
                if ids:
                    out.append((*node, first, ",".join(ids)))
                node, first, ids = (d, k1, k2), c, []
                if len(out) >= 4096 or sum(len(x[4]) for x in out[-8:]) > 1 << 20:
                    yield flushed()
            ids.append(str(c))
    if ids:
        out.append((*node, first, ",".join(ids)))
    if out:
        yield flushed()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of ids, sorted by node and first id: SHA-256 of each node's ids."""
    node, sha = None, None
    for b in batches:
        out = []
        for i in range(b.num_rows):
            at = tuple(b.column(j)[i].as_py() for j in range(3))
            if at != node:
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = at, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(b.column(4)[i].as_buffer())
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("depth", "k1", "k2", "ends_sha256"), x, strict=True)) for x in out])
    if node:
        yield pa.RecordBatch.from_pylist([dict(zip(("depth", "k1", "k2", "ends_sha256"), (*node, sha.hexdigest()), strict=True))])


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256: of the ids that end at a node, ascending and parted by commas."""
    blocks = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_id_blocks, BLOCKS)
    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, DIGESTS)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, words (of its last turn)."""
    convs, paths = rebuilt(conversations)
    marks = written(marked(written(paths, "paths"), 1 + math.isqrt(convs.count())), "marks")
    one = F.col("owned").cast("long")
    sums = {"lost": F.when(F.col("owned"), 0).otherwise(F.col("words")), "leaves": F.col("leaf").cast("long"), "owns": one}
    below = carried(marks.withColumn("block", F.expr(f"-(depth div {BLOCK})")), "conv_id", "block", [F.col("depth").desc()], sums)
    child = (F.col("len") > F.col("depth")) & (F.col("owns") - one == F.col("len") - F.col("depth"))  # it owns all below this node, so the next one too
    nodes = below.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(child.cast("long")).alias("n_children"),
        F.sum("leaves").alias("n_leaves"),
        F.sum("lost").alias("saved_tokens"),
        *(F.min(c).alias(c) for c in ("p1", "p2", "words")),
    )
    nodes = written(nodes, "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    digests = end_digests(marks.where(F.col("depth") == F.col("len")))
    both = nodes.join(digests, list(NODE), "left").join(parents, ["depth", "p1", "p2"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return both.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), "words")


def op11_prefix_trie(spark, sf_dir) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("words")


OP11_SQL = r"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
             lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
               lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
turns AS (
  SELECT c.conv_id, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL
  SELECT c.conv_id, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h),
deep AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth,
         md5(strlen(role) || ':' || role || text) AS t,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM turns),
steps AS (
  SELECT conv_id, 0 AS depth, '' AS t, 0 AS words FROM convs
  UNION ALL SELECT conv_id, depth, t, words FROM deep),
paths AS (
  SELECT conv_id, depth, words, md5(array_to_string(list(t) OVER (PARTITION BY conv_id ORDER BY depth), ',')) AS node,
         max(depth) OVER (PARTITION BY conv_id) AS len
  FROM steps),
linked AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM paths),
nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         any_value(words) AS words, max(len) = any_value(depth) AS leaf,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len = depth), '')) AS ends_sha256
  FROM linked GROUP BY node),
below AS (
  SELECT x.node, count(*) FILTER (WHERE n.leaf) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM (SELECT DISTINCT a.node, b.node AS under FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth >= a.depth) x
  JOIN nodes n ON n.node = x.under GROUP BY x.node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
       b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (node) LEFT JOIN children c USING (node) LEFT JOIN nodes p ON p.node = n.parent
"""
