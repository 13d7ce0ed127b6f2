r"""Nearest neighbours by inner product through a hierarchical k-means tree.

The tree is fitted on the driver on a bounded sample (about ``SAMPLE`` vectors, those with the
smallest hashes); every vector of the table then goes down it to a leaf. Vectors get one more
component that makes all of them equally long, so that near in the tree means a large inner
product whatever the norms. A query walks the tree best bin first: a priority queue holds the
nodes not yet opened, the one whose centre has the largest inner product is opened next, leaves
are visited as they come out. How many is found by widening: about ``CALIBRATION`` queries are
held against all vectors, and visits grow until the leaves visited hold ``RECALL`` of their true
neighbours.

Neighbouring leaves make a shard of at most about ``SHARD`` vectors; a larger leaf is dealt over
several. A shard meets the queries that visit it in blocks of ``QUERIES`` at most, so no task
holds more than these two. Scores there are matrix products; whatever comes within their rounding
of the k-th is scored again component by component in double precision, so equal vectors get
equal scores.

Copies may be a third of all rows: equal vectors (128-bit hashes of the components) are one class
with its k + 1 smallest ids, which are all that can be among anybody's k nearest, ties going to
the smaller id; equal queries are searched once.

Defined results: vectors that are null, all zero, or hold a null or non-finite component take no
part, neither do those of another length than the most frequent one (the longest of these), nor
rows without an id; repeated rows count once; rows of one id with several vectors are each a
query and a candidate, and no query meets its own id; with fewer candidates all are found; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

K, EVERY = 20, 20
#: Vectors that the tree is fitted on, about.
SAMPLE = 16384
#: Children of a node; rows of a leaf, about; least vectors of the sample in a leaf, about.
BRANCH, LEAF, LEAST = 8, 512, 8
ROUNDS, SEED = 8, 5
#: Queries that tell how many leaves to visit, about, and the share of their true neighbours to be found.
CALIBRATION, RECALL = 256, 0.95
SHARD, QUERIES = 8192, 4096
#: Queries whose products with a shard are held at once.
AT_ONCE = 256

HASH = ("h1", "h2")


@dataclass
class Tree:
    """Nodes in the order of a walk: centre of each, its children (none: a leaf) and its leaf number."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0
    norm: float = 1.0

    def added(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.leaf) - 1


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """x with a component that brings every vector to length norm."""
    return np.hstack([x, np.sqrt(np.maximum(norm**2 - (x * x).sum(1), 0))[:, None]])


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres * centres).sum(1) / 2).argmax(1)


def split(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """k-means: the centres that keep a vector, and the centre of each vector."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        there = np.unique(own)
        centres = np.stack([x[own == j].mean(0) for j in there])
    return centres, nearest(x, centres)


def fitted(sample: np.ndarray, rows: int, norm: float) -> Tree:
    """A tree whose leaves hold about LEAF of all rows, as far as the sample can tell them apart."""
    tree, rng = Tree(norm=norm), np.random.default_rng(SEED)
    x = lifted(sample, norm)

    def grow(node: int, members: np.ndarray) -> None:
        k = min(BRANCH, int(np.ceil(len(members) * rows / len(x) / LEAF)), len(members) // LEAST)
        parts = []
        if k > 1:
            centres, own = split(x[members], k, rng)
            parts = [(c, members[own == j]) for j, c in enumerate(centres) if (own == j).any()]
        if len(parts) < 2:
            tree.leaf[node] = tree.leaves
            tree.leaves += 1
            return
        for c, part in parts:
            child = tree.added(c)
            tree.children[node].append(child)
            grow(child, part)

    grow(tree.added(x.mean(0)), np.arange(len(x)))
    return tree


def leaf_of(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    """The leaf that each vector comes down to."""
    x, out = lifted(vectors, tree.norm), np.zeros(len(vectors), np.int32)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, members = todo.pop()
        below = tree.children[node]
        if not below:
            out[members] = tree.leaf[node]
            continue
        own = nearest(x[members], np.stack([tree.centres[c] for c in below]))
        todo += [(c, members[own == j]) for j, c in enumerate(below) if (own == j).any()]
    return out


def visits(tree: Tree, queries: np.ndarray, most: int) -> Iterator[list[int]]:
    """The first leaves that each query comes to, best bin first."""
    near = queries @ np.stack(tree.centres)[:, :-1].T
    for row in near:
        queue, found = [(-row[0], 0)], []
        while queue and len(found) < most:
            _, node = heapq.heappop(queue)
            if tree.leaf[node] >= 0:
                found.append(tree.leaf[node])
            for c in tree.children[node]:
                heapq.heappush(queue, (-row[c], c))
        yield found


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products, added component by component."""
    total = np.zeros(len(vectors))
    for j in range(len(query)):
        total += query[j] * vectors[:, j]
    return total


def best(query: np.ndarray, scores: np.ndarray, vectors: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[float, int]]:
    """The k best of the vectors' ids by exact score; scores: as the matrix product has them, -inf where not visited."""
    if len(scores) > k:
        least = np.partition(scores, -k)[-k]
        near = np.flatnonzero(scores >= least - 1e-9 * max(1.0, abs(least), float(np.abs(scores[np.isfinite(scores)]).max(initial=0)))) if np.isfinite(least) else np.flatnonzero(np.isfinite(scores))
    else:
        near = np.flatnonzero(np.isfinite(scores))
    sure = exact(query, vectors[near])
    return heapq.nsmallest(k, ((-s, i) for s, at in zip(sure.tolist(), near.tolist(), strict=True) for i in ids[at]))


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, v, h1, h2 of the rows that take part."""
    kind = dict(embeddings.dtypes)["embedding"]
    v = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(good, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (common["n"] if common else 0)).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})


def share(column: Column, part: float) -> Column:
    """True for about the given part of the values."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), column), 33) < F.lit(int(min(part, 1.0) * 2**31))


@dataclass
class Index:
    tree: Tree
    table: DataFrame  # h1, h2, ids (smallest first), v, leaf, shard: of every class of equal vectors
    places: list[tuple[int, int]]  # first shard of a leaf and the number of shards it is dealt over


def indexed(rows: DataFrame, k: int = K) -> Index | None:
    """rows: of usable()."""
    spark = rows.sparkSession
    first = Window.partitionBy(*HASH).orderBy("vec_id")
    few = rows.withColumn("at", F.dense_rank().over(first)).where(F.col("at") <= k + 1)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    classes = written(few.groupBy(*HASH).agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("v").alias("v")), "vector-classes")
    n, longest = classes.agg(F.count(F.lit(1)), F.max(square)).first()
    if not n:
        return None
    sample = classes.where(share(F.col("h1"), SAMPLE / n)).select("h1", "h2", "v").toArrow().sort_by([("h1", "ascending"), ("h2", "ascending")])
    if not sample.num_rows:
        sample = classes.select("h1", "h2", "v").limit(1).toArrow()
    tree = fitted(matrix(sample["v"].combine_chunks()), n, float(np.sqrt(longest)))
    held = spark.sparkContext.broadcast(tree)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf_of(held.value, matrix(b.column(3))), pa.int32())], names=[*b.schema.names, "leaf"])

    kind = classes.schema["v"].dataType.simpleString()
    table = written(classes.mapInArrow(down, f"h1 long, h2 long, ids array<long>, v {kind}, leaf int"), "vector-leaves")
    counts = dict(table.groupBy("leaf").count().collect())  # a row per leaf: the sample bounds them
    places, at, filled = [], 0, 0
    for leaf in range(tree.leaves):
        size = counts.get(leaf, 0)
        if filled and filled + size > SHARD:
            at, filled = at + 1, 0
        dealt = max(1, -(-size // SHARD))
        places.append((at, dealt))
        at, filled = (at + dealt, 0) if dealt > 1 else (at, filled + size)
    place = F.array(*(F.struct(F.lit(a).alias("at"), F.lit(d).alias("dealt")) for a, d in places))
    mine = F.element_at(place, F.col("leaf") + 1)
    table = table.withColumn("shard", mine["at"] + F.pmod(F.col("h2"), mine["dealt"]).cast("int"))
    return Index(tree, table, places)


def calibrated(index: Index, queries: DataFrame, k: int = K, recall: float = RECALL) -> int:
    """How many leaves to visit so that about recall of the true neighbours are found; queries: h1, h2, v."""
    n = queries.count()
    few = queries.where(share(F.col("h1"), CALIBRATION / max(n, 1))).toArrow()
    if not few.num_rows:
        return index.tree.leaves
    q, own = matrix(few["v"].combine_chunks()), few["h1"].to_numpy()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_s, top_l = np.full((len(q), 0), 0.0), np.full((len(q), 0), 0)
        for b in batches:
            if not b.num_rows:
                continue
            s = q @ matrix(b.column(1)).T
            s[own[:, None] == b.column(0).to_numpy()[None, :]] = -np.inf
            leaf = np.broadcast_to(b.column(2).to_numpy(), s.shape)
            top_s, top_l = np.hstack([top_s, s]), np.hstack([top_l, leaf])
            if top_s.shape[1] > k:
                keep = np.argpartition(-top_s, k - 1, axis=1)[:, :k]
                top_s, top_l = np.take_along_axis(top_s, keep, 1), np.take_along_axis(top_l, keep, 1)
        at = np.repeat(np.arange(len(q)), top_s.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(top_s.ravel(), pa.float64()), pa.array(top_l.ravel(), pa.int32())], names=["q", "score", "leaf"])

    all_near = index.table.select("h1", "v", "leaf").mapInArrow(compared, "q int, score double, leaf int").where(F.col("score") > float("-inf"))
    true = all_near.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "leaf"))).where(F.col("at") <= k).select("q", "leaf").collect()
    order = [{leaf: i for i, leaf in enumerate(v)} for v in visits(index.tree, q, index.tree.leaves)]
    needed = np.array([order[r["q"]][r["leaf"]] for r in true])
    most = 1
    while most < index.tree.leaves and len(needed) and (needed < most).mean() < recall:
        most += max(1, most // 8)
    return min(most, index.tree.leaves)


def searched(index: Index, queries: DataFrame, most: int, k: int = K) -> DataFrame:
    """h1, h2, vec_id, score: the k + 1 best ids in the leaves that each query (h1, h2, v) visits."""
    held, places, kind = queries.sparkSession.sparkContext.broadcast(index.tree), index.places, queries.schema["v"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(i, AT_ONCE)
                row, shard, leaves = [], [], []
                for r, found in enumerate(visits(held.value, matrix(b.column(2)), most)):
                    by_shard: dict[int, list[int]] = {}
                    for leaf in found:
                        at, dealt = places[leaf]
                        for s in range(at, at + dealt):
                            by_shard.setdefault(s, []).append(leaf)
                    row += [r] * len(by_shard)
                    shard += by_shard
                    leaves += by_shard.values()
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row, pa.int64())) for c in b.columns), pa.array(shard, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], names=["h1", "h2", "v", "shard", "leaves"])

    asked = written(queries.mapInArrow(walk, f"h1 long, h2 long, v {kind}, shard int, leaves array<int>"), "leaf-visits")
    blocks = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
    asked = asked.join(blocks, "shard").withColumn("block", F.pmod(F.col("h1"), "blocks").cast("int")).drop("blocks")
    there = index.table.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("shard", "block", "ids", "v", "leaf")

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            q, x = matrix(left["v"].chunk(0)), matrix(right["v"].chunk(0))
            own, ids = right["leaf"].to_numpy(), right["ids"].to_pylist()
            names = np.unique(own)
            column = np.searchsorted(names, own)
            h1, h2, leaves = left["h1"].to_pylist(), left["h2"].to_pylist(), left["leaves"].to_pylist()
            for i in range(0, len(q), AT_ONCE):
                s = q[i : i + AT_ONCE] @ x.T
                for r, row in enumerate(s):
                    visited = np.isin(names, leaves[i + r])
                    if not visited.all():
                        row[~visited[column]] = -np.inf
                    for minus, vec_id in best(q[i + r], row, x, ids, k + 1):
                        for o, value in zip(out, (h1[i + r], h2[i + r], vec_id, -minus), strict=True):
                            o.append(value)
        return pa.table([*(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.float64())], names=["h1", "h2", "vec_id", "score"])

    return asked.groupBy("shard", "block").cogroup(there.groupBy("shard", "block")).applyInArrow(met, "h1 long, h2 long, vec_id long, score double")


def nearest_vectors(embeddings: DataFrame, k: int = K, every: int = EVERY, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose vec_id is divisible by every, among all other rows."""
    rows = usable(embeddings)
    index = indexed(rows, k)
    if index is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asking = rows.where(F.col("vec_id") % every == 0)
    queries = written(asking.groupBy(*HASH).agg(F.first("v").alias("v")), "vector-queries")
    found = searched(index, queries, calibrated(index, queries, k, recall), k)
    order = Window.partitionBy(*HASH).orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    lists = written(top.groupBy(*HASH).agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("near")), "nearest")
    own = asking.select(F.col("vec_id").alias("query_id"), *HASH).distinct().join(lists, list(HASH))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    each = own.select("query_id", F.posexplode(others).alias("place", "x"))
    return each.select("query_id", (F.col("place") + 1).alias("rank"), "x.vec_id", "x.score")


def op13_vector_search(spark, sf_dir) -> DataFrame:
    return nearest_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
