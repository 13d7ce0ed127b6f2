r"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is a stream: its documents in the order of a seeded hash, one word after the
other, read again once it ends (two passes at most). A mix takes the first ``quota`` words of
each stream, cut into blocks of ``block_words``; a seeded bijection permutes the blocks of a
source. The tree hands the exact block quotas of all sources to the output shards: a node that
covers shards [a, b) gives its left half as many blocks as those shards hold, drawn over the
sources by a multivariate hypergeometric whose seed is the node; the rest goes right. A shard
thus draws a random share of every source, and the blocks of that share are neighbours in the
permuted order, so they come from all over the source. The quotas are met exactly, no two
shards get the same block, and any task can walk down the tree for its own blocks without a
table of all shards. Inside a shard the blocks are shuffled by a seeded hash, their ``slot``.

Word offsets within a source come from two small sums: within a hash range of about 512
documents, and over the ranges of a source; no task sees a whole source's documents.

Only one row per source (its size) passes through the driver: the recipe.

Defined results: a null text has size 0 and is never taken; null is a source of its own and
comes last; an empty table gives an empty result; repeated rows are documents of their own;
a null id is an id; sources without words have target 0; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import give_back, text_of, word_count, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_PASSES = 2
BLOCK_WORDS = 1024
SHARD_WORDS = 1 << 20
SEED = 20240229
_MASK = (1 << 64) - 1
#: Documents of a hash range, about.
RANGE_DOCS = 512

RECIPE = "source string, idx int, source_size long, target double, quota long, bits int"
PIECES = "array<struct<pass:int,start:long,words:long,shard:long,slot:long>>"


def targets(sizes: list[int], weights: list[float], total: float, most: float = MAX_PASSES) -> list[float]:
    """Shares of total by weight; what exceeds `most` times a size is shared again until none does."""
    caps, out, free = [float(most * s) for s in sizes], [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free:
        unit = left / sum(weights[i] for i in free)
        over = {i for i in free if unit * weights[i] > caps[i]}
        for i in over or free:
            out[i] = caps[i] if over else unit * weights[i]
        if not over:
            break
        left = max(0.0, left - sum(caps[i] for i in over))
        free -= over
    return out


def hashed(*numbers: int) -> int:
    """A 64-bit hash of some numbers."""
    h = 0
    for x in numbers:
        h = (h + x + 0x9E3779B97F4A7C15) & _MASK
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & _MASK
        h = (h ^ h >> 27) * 0x94D049BB133111EB & _MASK
        h ^= h >> 31
    return h


def permuted(x: int, n: int, *seed: int) -> int:
    """The place of x in a seeded permutation of range(n): a Feistel network on the next even number of bits, walked until it is below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low = (1 << half) - 1
    key = hashed(*seed)
    while True:
        left, right = x >> half, x & low
        for turn in range(4):
            left, right = right, left ^ hashed(key, turn, right) & low
        x = left << half | right
        if x < n:
            return x


@dataclass
class SplitTree:
    """Block quotas of the sources split among shards; splits are drawn when first asked for."""

    quotas: tuple[int, ...]
    shards: int
    seed: int

    def __post_init__(self) -> None:
        self.known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        total = sum(self.quotas)
        self.bounds = lambda j: total * j // self.shards  # blocks before shard j

    def split(self, a: int, b: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            mid = (a + b) // 2
            rng = np.random.default_rng([self.seed, a, b])
            left = rng.multivariate_hypergeometric(held, self.bounds(mid) - self.bounds(a), method="marginals") if held.sum() else held
            self.known[a, b] = left, held - left
        return self.known[a, b]

    def shard(self, source: int, block: int) -> int:
        """The shard of a permuted block of a source."""
        a, b, held = 0, self.shards, np.array(self.quotas, dtype=np.int64)
        while b - a > 1:
            left, right = self.split(a, b, held)
            if block < left[source]:
                b, held = (a + b) // 2, left
            else:
                a, block, held = (a + b) // 2, block - int(left[source]), right
        return a


def recipe(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> list[tuple]:
    """One tuple per source, by code point, null last: source, idx, source_size, target, quota, bits."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs")).collect()
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    goal = targets([r["n"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share * sum(r["n"] for r in rows))
    return [(r["source"], i, r["n"], g, round(g), max(0, math.ceil(math.log2(r["docs"] / RANGE_DOCS)))) for i, (r, g) in enumerate(zip(rows, goal, strict=True))]


def placed(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """sizes (doc_id, source, size, h) with the recipe and at: the document's first word in its source's stream."""
    cell = F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(h, 64 - bits)"))
    both = sizes.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).drop(F.col("p.source")).withColumn("cell", cell)
    ranges = both.groupBy("idx", "cell").agg(F.sum("size").alias("held"))
    before = ranges.select("idx", "cell", (F.sum("held").over(Window.partitionBy("idx").orderBy("cell")) - F.col("held")).alias("base"))
    inside = Window.partitionBy("idx", "cell").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("upto", F.sum("size").over(inside)).join(before, ["idx", "cell"]).withColumn("at", F.col("base") + F.col("upto") - F.col("size"))


def drawn(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, pieces (pass, first word, words, shard, slot), one for each block it lies in."""
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    sizes = written(docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text_of()).alias("size"), F.xxhash64(F.lit(seed), doc_id).alias("h")), "mix-sizes")
    rows = recipe(sizes, weights, share)
    plan = spark.createDataFrame(rows, RECIPE)
    quotas = tuple(-(-r[4] // block_words) for r in rows)
    shards = max(1, -(-sum(r[4] for r in rows) // shard_words))

    @F.pandas_udf(PIECES)
    def cut(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        give_back()
        tree = SplitTree(quotas, shards, seed)
        for idx, at, size, whole, quota in batches:
            out = []
            for i, a, n, w, q in zip(idx.to_numpy(), at.to_numpy(), size.to_numpy(), whole.to_numpy(), quota.to_numpy(), strict=True):
                i, a, n, w, q = int(i), int(a), int(n), int(w), int(q)
                pieces = []
                for p in range(MAX_PASSES):
                    x, end = p * w + a, min(p * w + a + n, q)
                    while x < end:
                        block = x // block_words
                        stop = min(end, (block + 1) * block_words)
                        shard = tree.shard(i, permuted(block, quotas[i], seed, i))
                        slot = hashed(seed, shard, i, block) >> 1
                        pieces.append({"pass": p, "start": x - p * w - a, "words": stop - x, "shard": shard, "slot": slot})
                        x = stop
                out.append(pieces)
            yield pd.Series(out)

    return placed(sizes, plan).withColumn("pieces", cut("idx", "at", "size", "source_size", "quota")).select("doc_id", "source", "size", "source_size", "target", "pieces")


def mixed(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """The mix itself: a row per piece, range-partitioned by shard and in the shuffled order of its blocks."""
    piece = drawn(docs, seed=seed, **how).select("doc_id", "source", F.inline("pieces"))
    return piece.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot", "pass", "start")


def op3_mixing(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    return drawn(docs).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "pieces")
