r"""Documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more, and their classes.

T-occurrence search: two sets are linked only if they share T = ceil(0.75 n) shingles of
either. In one global order of shingles, rare before frequent, linked sets share a shingle
among the first n - T + 1 of both. All shingles are counted, by 32 bits of their hash; those
that many documents hold are "long" and come last, those before and after ordered by hash. How
many are too many does not depend on the input, so that lists of unlike documents do not grow
with it. Any order gives the same links, a good one keeps the lists short.

1. Every document becomes a node, the 128-bit hash of its set; equal sets are one node.
2. The first n - T + 1 shingles of each node go to inverted lists, a row per shingle and node
   (by 64 bits of its hash, which may only add candidates). A task streams its sorted lists:
   lists with one node end there, the nodes of the others go to the group of the list's first
   node. Linked nodes share a list, so they share a group.
3. In a group of more than ``TIE`` nodes or ``SHINGLES`` shingles every node is held against the
   first one, in parts of the group, a set at a time. Nodes linked to it are one class already.
   Jaccard distance is a metric, so a node further from the first than twice the allowed
   distance links to none of these, and one at distance d only to those at d less the allowed
   distance or more: near copies without such a neighbour need no search at all. What is left
   is worked on by pairs of blocks of ``SHINGLES`` shingles.
4. In a group, nodes without any partner that could reach the overlap are dropped: sizes must
   fit, and bitmaps of the sets must not differ in more bits than linked sets differ in
   shingles. Both tests are exact bounds.
5. The sets of the nodes that stay are brought together and searched by DivideSkip: a node's
   short inverted lists are merged (they are sorted runs, which a stable sort merges) and the
   runs of equal members counted; members whose count cannot reach T with all long lists drop
   out, and the long lists are probed for the rest by binary search, or merged where that is
   less work. Nodes of one class need not be compared, so the queries are the nodes outside the
   largest class. A group returns a spanning forest of its links, never all pairs.
6. Links become classes by connected components.

Defined results: a null text, an empty one or one without words has the empty set and stands
alone; fewer than five words are one shingle; an empty table gives an empty result; repeated
rows and rows with the same id are told apart by their texts (component ids are the smallest
id of the class); a null id ranks after all ids; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import sliced, tables_dropped, text_of, written
from .shingles import shingle_sets

#: Least similarity in percent.
PERCENT = 75
#: Documents from which on a shingle is long, or longer, and the number of its hash's first bits by which a table of fixed size tells it: shingles that share them with a long one are long too.
LONG = ((8, 26), (128, 23))
#: First bits of a hash: shingles that share them are counted together.
PART = 10
#: Shingles that a task sorts at once to be counted.
COUNTED = 1 << 21
#: List entries that a task sends off together.
RUN = 1 << 19
#: Nodes that a task remembers to have sent.
SEEN = 100_000
#: Nodes of a block, and its shingles but for its last node's.
BLOCK, SHINGLES = 2048, 1 << 20
#: A group of more nodes, or of more shingles than a block, is first held against its first node.
TIE = BLOCK
#: A list in a group that is long enough to be probed instead of merged.
LONG_LIST = 32
#: Bytes of the groups' first sets that are few enough to be sent to every task.
FIRST_BYTES = 32 << 20
#: Bits of the table that says which documents a join may want: at most SLOTS / 64 rows go to every task, whatever the input.
SLOTS = 1 << 26
NO_ID = 2**63 - 1

_U = np.uint64


def node_of(tokens: np.ndarray) -> bytes:
    """The set's hash; nothing for the empty set."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else b""


def short_of(node: bytes) -> int:
    """64 bits of a node."""
    return int.from_bytes(node[:8], "little", signed=True)


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each shingle, in a power of two of at least 2 n and 64 bits."""
    size = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(tokens >> _U(20) & _U(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.encode(text_of(), "UTF-8").alias("raw"), *more)


def texts_of(docs: DataFrame, some: DataFrame) -> DataFrame:
    """some (doc_id, th: the text's hash, ...) with raw, the text. Ids may be null or shared, so a text is known by both.

    Texts that nobody wants don't travel: a bit for each wanted row goes to every task first.
    """
    key = ["doc_id", "th"]
    slot = F.pmod(F.xxhash64(*key), F.lit(SLOTS))
    words = some.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    rows = _rows(docs, F.xxhash64(text_of()).alias("th")).withColumn("slot", slot).withColumn("word", F.expr("slot div 64"))
    rows = rows.join(F.broadcast(words), "word").where(F.getbit("bits", (F.col("slot") % 64).cast("int")) == 1)
    return rows.select(*key, "raw").join(some, key)


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    return shingle_sets([x.as_buffer().to_pybytes() for x in column])


def packed(slots: np.ndarray) -> bytes:
    """Sorted numbers as gaps of 16 bits; a gap that begins with 0xFFFF goes on."""
    more, rest = np.divmod(np.diff(slots.astype(np.int64), prepend=0), 0xFFFF)
    out = np.full(len(rest) + int(more.sum()), 0xFFFF, np.uint16)
    out[np.cumsum(more + 1) - 1] = rest
    return out.tobytes()


def unpacked(data: bytes | pa.Buffer) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint16)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 0xFFFF].astype(np.uint32)


def count_shingles(docs: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """Documents (doc_id, node, h: 64 bits of it, n, bits, th: the text's hash), and a table of bits for each entry of LONG."""
    names = ["doc_id", "node", "h", "n", "bits", "th", "part", "slots"]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
    ddl = "doc_id long, node binary, h long, n long, bits binary, th long, part int, slots binary"

    def batch(size: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(given[k], t) if k in given else pa.nulls(size, t) for k, t in zip(names, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        seen: set[bytes] = set()

        def sent() -> pa.RecordBatch:
            slots = np.sort(np.concatenate(held))
            cuts = np.append(np.searchsorted(slots, np.arange(1 << PART, dtype=np.uint32) << np.uint32(32 - PART)), len(slots))
            parts = np.flatnonzero(np.diff(cuts)).tolist()
            return batch(len(parts), part=parts, slots=[packed(slots[cuts[p] : cuts[p + 1]] & np.uint32((1 << 32 - PART) - 1)) for p in parts])

        for b in sliced(batches):
            nodes, sizes, bits = [], [], []
            for s in _sets(b.column(1)):
                node = node_of(s)
                nodes.append(node)
                sizes.append(len(s))
                bits.append(bitmap(s))
                if len(s) and node not in seen:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(node)
                    held.append((s >> _U(32)).astype(np.uint32))
                    size += len(s)
                if size > COUNTED:
                    yield sent()
                    held, size = [], 0
            yield batch(len(nodes), doc_id=b.column(0), node=nodes, h=[short_of(x) for x in nodes], n=sizes, bits=bits, th=b.column(2))
        if held:
            yield sent()

    def told(held: list[np.ndarray]) -> list[bytes]:
        slots, counts = np.unique(np.concatenate(held), return_counts=True)
        out = []
        for least, first in LONG:
            bits = np.zeros(1 << first - PART, bool)
            bits[slots[counts >= least] >> np.uint32(32 - first)] = True
            out.append(np.packbits(bits, bitorder="little").tobytes())
        return out

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by part, so a task holds the shingles of one."""
        part, held = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([told(held)], pa.list_(pa.binary()))], names=["part", "bits"])

        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if p != part:
                    if held:
                        yield row()
                    part, held = p, []
                held.append(unpacked(x.as_buffer()))
        if held:
            yield row()

    with tables_dropped(docs.sparkSession):
        made = written(_rows(docs, F.xxhash64(text_of()).alias("th")).mapInArrow(run, ddl), "shingle-counts")
        slots = made.where("part is not null").select("part", "slots").repartition("part").sortWithinPartitions("part")
        found = written(slots.mapInArrow(tell, "part int, bits array<binary>"), "shingle-long").toArrow()
        rows = written(made.where("part is null").select("doc_id", "node", "h", "n", "bits", "th"), "shingle-documents")
    tables = [np.zeros((1 << PART, 1 << first - PART - 3), np.uint8) for _, first in LONG]
    for part, bits in zip(found["part"].to_pylist(), found["bits"].to_pylist(), strict=True):
        for table, x in zip(tables, bits, strict=True):
            table[part] = np.frombuffer(x, np.uint8)
    return rows, [x.ravel() for x in tables]


def ordered(tokens: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """A set's shingles (sorted by hash), long ones last and longer ones after them."""
    level = np.zeros(len(tokens), np.uint8)
    for table, (_, first) in zip(tables, LONG, strict=True):
        at = tokens >> _U(64 - first)
        level += table[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8) & 1
    return tokens[np.argsort(level, kind="stable")]


def prefix_lists(docs: DataFrame, tables: list[np.ndarray], percent: int = PERCENT) -> DataFrame:
    """Members of lists of two or more nodes, each pair once: leader (the list's first node), h; both by 64 bits."""
    told = docs.sparkSession.sparkContext.broadcast(tables)  # 9 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        tokens, nodes, size = [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes))], names=["token", "h"])

        for b in sliced(batches):
            for s in _sets(b.column(1)):
                node, n = node_of(s), len(s)
                if n and node not in seen:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(node)
                    first = ordered(s, told.value)[: n - -(-percent * n // 100) + 1]
                    tokens.append(first)
                    nodes.append(np.full(len(first), short_of(node), np.int64))
                    size += len(first)
                    if size >= RUN:
                        yield flush()
                        tokens, nodes, size = [], [], 0
        if size:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries come by shingle and node: of each list only its first node is remembered."""
        token = leader = None
        for b in batches:
            t, h = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(t):
                continue
            new = np.ones(len(t), bool)
            new[1:] = t[1:] != t[:-1]
            new[0] = token is None or t[0] != token
            at = np.maximum.accumulate(np.where(new, np.arange(len(t)), -1))
            lead = np.where(at < 0, leader if leader is not None else 0, h[np.maximum(at, 0)])
            token, leader = int(t[-1]), int(lead[-1])
            some = lead != h
            pairs = np.unique(np.stack([lead[some], h[some]], 1), axis=0) if some.any() else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["leader", "h"])

    entries = _rows(docs).mapInArrow(run, "token long, h long")
    lists = written(entries.repartition("token").sortWithinPartitions("token", "h").mapInArrow(meet, "leader long, h long").distinct(), "shingle-lists")
    told.destroy()
    return lists


def weighed(lists: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """leader, node, n, weight: the nodes of each group, by shingles; leader, parts, first: groups that are held against their first node."""
    weight = F.greatest(F.col("n"), F.lit(-(-SHINGLES // BLOCK)).cast("long")).alias("weight")
    pairs = lists.select("leader", "h").union(lists.select("leader", F.col("leader").alias("h"))).distinct()
    groups = written(pairs.join(nodes.select("h", "node", "n"), "h").select("leader", "node", "n", weight, (F.col("h") == F.col("leader")).alias("leads")), "shingle-groups")
    total = groups.groupBy("leader").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("held"), F.min(F.when(F.col("leads"), F.col("node"))).alias("first")).where((F.col("total") > SHINGLES) | (F.col("held") > TIE))
    parts = F.greatest(F.ceil(F.col("total") / SHINGLES), F.ceil(F.col("held") / TIE)).cast("int").alias("parts")
    return groups.drop("leads"), written(total.select("leader", parts, "first"), "shingle-large-groups")


def blocks(groups: DataFrame, large: DataFrame, held: DataFrame, percent: int = PERCENT) -> DataFrame:
    """leader, i, j, side, node: the nodes of block i (side 0) and of block j (side 1).

    held: leader, node, tied, away of the nodes of large groups: whether they are linked to
    the group's first node, and their distance from it.
    """
    zero, limit = F.lit(0), 1 - percent / 100
    small = groups.join(large, "leader", "left_anti").select("leader", zero.alias("i"), zero.alias("j"), zero.alias("side"), "node")
    near = F.min(F.when((F.col("tied") == 0) & (F.col("away") <= 2 * limit + 1e-9), F.col("away"))).alias("near")
    bound = held.groupBy("leader").agg(near)
    rows = groups.join(held, ["leader", "node"]).join(bound, "leader").where((F.col("tied") == 0) | (F.col("away") >= F.col("near") - limit - 1e-9))
    upto = F.sum("weight").over(Window.partitionBy("leader", "tied").orderBy("node").rowsBetween(Window.unboundedPreceding, 0))
    dealt = written(rows.select("leader", "node", "tied", F.floor((upto - F.col("weight")) / SHINGLES).cast("int").alias("own")), "shingle-blocks")
    count = lambda x: F.coalesce(F.max(F.when(F.col("tied") == x, F.col("own"))) + 1, zero)
    counts = dealt.groupBy("leader").agg(count(0).alias("free"), count(1).alias("ties")).where("free > 0")  # else all are one class
    # free blocks come first and meet all blocks; blocks of tied nodes meet free ones only
    last = F.when(F.col("tied") == 1, F.col("free") - 1).otherwise(F.col("free") + F.col("ties") - 1)
    own = F.col("own") + F.when(F.col("tied") == 1, F.col("free")).otherwise(zero)
    met = dealt.join(counts, "leader").select("leader", "node", own.alias("own"), F.explode(F.sequence(zero, last)).alias("other"))
    return small.union(met.select("leader", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of each (leader, i, j), which follow one another."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True):
            if held and row[:3] != held[-1][:3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def may_link(sides: np.ndarray, sizes: np.ndarray, bits: list[bytes], cross: bool, percent: int = PERCENT) -> np.ndarray:
    """Which nodes of a group have a partner that sizes and bitmaps allow."""
    order = np.argsort(sizes, kind="stable")
    n, side = sizes[order], sides[order]
    spread = (100 - percent) / (100 + percent)  # linked sets differ in at most this share of n + m
    width = np.array([len(bits[k]) for k in order])
    ok = np.zeros(len(n), bool)
    ends = np.searchsorted(n, n * 100 // percent, "right")
    for size in np.unique(width):
        # bitmaps of this size and the next, folded to this size; a partner's is not larger, and those of equal size follow one another
        lo, hi = np.searchsorted(width, [size, 2 * size + 1])
        maps = np.empty((hi - lo, size), np.uint8)
        for r in range(lo, hi):
            maps[r - lo] = np.bitwise_or.reduce(np.frombuffer(bits[order[r]], np.uint8).reshape(-1, size), axis=0)
        maps = maps.view(np.uint64)
        for r in range(lo, int(np.searchsorted(width, size, "right"))):
            e = int(ends[r])
            if e <= r + 1:
                continue
            differ = np.bitwise_count(maps[r + 1 - lo : e - lo] ^ maps[r - lo]).sum(1)
            fits = differ <= spread * (n[r + 1 : e] + n[r]) + 1e-6
            if cross:
                fits &= side[r + 1 : e] != side[r]
            if fits.any():
                ok[r] = True
                ok[r + 1 : e] |= fits
    out = np.zeros(len(n), bool)
    out[order] = ok
    return out


def forest(sets: list[np.ndarray], sides: np.ndarray, cross: bool, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets (between the sides only, if cross), by DivideSkip."""
    m, sizes = len(sets), np.array([len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    keys = np.sort(ids * m + owner)  # the lists one after the other, each by member
    members, counts = keys % m, np.bincount(ids)
    begins, cuts = np.cumsum(counts) - counts, np.cumsum(sizes) - sizes
    label, asked, out = np.arange(m), np.zeros(m, bool), []

    def merged(lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members of sorted lists and how many of the lists hold them."""
        k = counts[lists]
        at = np.arange(k.sum()) + np.repeat(begins[lists] - (np.cumsum(k) - k), k)
        found = np.sort(members[at], kind="stable")
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.empty(0, np.int64)
        return found[first], np.diff(np.append(first, len(found)))

    def query() -> int | None:
        """A node that may have a link to another class; a link is known once either end has been a query."""
        left = np.flatnonzero(~asked)
        if cross:
            one, two = left[sides[left] == 0], left[sides[left] == 1]
            left = one if len(one) <= len(two) else two
            if not len(one) or not len(two) or len(np.unique(label[np.append(one, two)])) == 1:
                return None
            return int(left[0])
        classes, size = np.unique(label[left], return_counts=True)
        if len(classes) < 2:
            return None
        return int(left[label[left] != classes[size.argmax()]][0])

    while (q := query()) is not None:
        asked[q] = True
        own = ids[cuts[q] : cuts[q] + sizes[q]]
        least = -(-percent * int(sizes[q]) // 100)
        by = np.argsort(counts[own], kind="stable")
        n_long = min(least - 1, int((counts[own] >= LONG_LIST).sum()))
        short, far = own[by[: len(own) - n_long]], own[by[len(own) - n_long :]]
        cand, seen = merged(short)
        need = -(-percent * (sizes[cand] + sizes[q]) // (100 + percent))
        fits = (seen >= need - n_long) & (np.minimum(sizes[cand], sizes[q]) >= need) & ~asked[cand] & (label[cand] != label[q])
        if cross:
            fits &= sides[cand] != sides[q]
        cand, seen, need = cand[fits], seen[fits], need[fits]
        if n_long and len(cand):
            if len(cand) * n_long <= counts[far].sum():
                probes = far[None, :] * m + cand[:, None]
                at = np.minimum(np.searchsorted(keys, probes), len(keys) - 1)
                seen = seen + (keys[at] == probes).sum(1)
            else:
                more, k = merged(far)
                at = np.minimum(np.searchsorted(more, cand), len(more) - 1)
                seen = seen + np.where(more[at] == cand, k[at], 0)
            cand = cand[seen >= need]
        for c in cand.tolist():
            if label[c] != label[q]:
                label[label == label[c]] = label[q]
                out.append((q, c))
    return out


def links(lists: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: a spanning forest of the links in every group; nodes: node, doc_id, th, n, bits."""
    key = ["leader", "i", "j"]

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for g in _groups(batches):
            ok = may_link(np.array([r[3] for r in g]), np.array([r[5] for r in g]), [r[6] for r in g], g[0][1] != g[0][2], percent)
            out += [r[:5] for r, x in zip(g, ok.tolist(), strict=True) if x]
            if len(out) > 50_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=[*key, "side", "node"])

    def sets_of(some: DataFrame) -> DataFrame:
        """some (node, further columns, a row per node) with tokens: the node's set."""
        wanted = written(some.join(nodes.select("node", "doc_id", "th"), "node"), "shingle-nodes")
        more = [c for c in some.columns if c != "node"]

        def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                rows = [(node, s.tobytes()) for node, s in zip(b.column(0).to_pylist(), _sets(b.column(1)), strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), *b.columns[2:]], names=["node", "tokens", *more])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in some.schema if f.name != "node")
        return texts_of(docs, wanted).select("node", "raw", *more).mapInArrow(to_sets, f"node binary, tokens binary{', ' if more else ''}{kinds}")

    def distance(s: np.ndarray, first: np.ndarray) -> tuple[int, float]:
        """Whether a set is linked to the first one of its group, and how far it is from it."""
        total, small = len(s) + len(first), min(len(s), len(first))
        # sets of too different sizes are further apart than any distance that matters
        both = len(np.intersect1d(s, first, assume_unique=True)) if 100 * small >= (2 * percent - 100) * (total - small) else 0
        return int(100 * both >= percent * (total - both)), 1 - both / (total - both)

    def ties(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.binary(), pa.int32(), pa.float64()), strict=True)], names=["leader", "node", "tied", "away"])

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets come to the first one of their group, whose row begins each part."""
        first = np.empty(0, _U)
        for b in batches:
            found = []
            for leader, other, node, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True):
                if other:
                    found.append((leader, node, *distance(np.frombuffer(x.as_buffer(), _U), first)))
                else:
                    first = np.frombuffer(x.as_py(), _U)
            if found:
                yield ties(found)

    def tie_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first sets have come to the texts."""
        for b in sliced(batches):
            found = []
            for leader, node, s, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _sets(b.column(2)), b.column(3), strict=True):
                found.append((leader, node, *distance(s, np.frombuffer(first.as_buffer(), _U))))
            if found:
                yield ties(found)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            seen = {r[4]: r for r in g}  # repeated rows bring a set twice
            g = list(seen.values())
            found = forest([np.frombuffer(r[5], _U) for r in g], np.array([r[3] for r in g]), g[0][1] != g[0][2], percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([g[x][4] for x, _ in found], pa.binary()), pa.array([g[y][4] for _, y in found], pa.binary())], names=["a", "b"])

    info = nodes.select("node", "n", "bits")
    groups, large = weighed(lists, nodes)
    held = docs.sparkSession.createDataFrame([], "leader long, node binary, tied int, away double")
    if not large.isEmpty():
        members = groups.join(large, "leader").select("leader", "node", "parts", (F.col("node") != F.col("first")).cast("int").alias("other"))
        firsts = written(members.where("other = 0").join(sets_of(members.where("other = 0").select("node").distinct()), "node").select("leader", "tokens").dropDuplicates(["leader"]), "shingle-firsts")
        out = "leader long, node binary, tied int, away double"
        if (firsts.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0) <= FIRST_BYTES:
            asked = written(members.where("other = 1").join(nodes.select("node", "doc_id", "th"), "node").select("leader", "node", "doc_id", "th"), "shingle-asked")
            met = texts_of(docs, asked).join(F.broadcast(firsts), "leader").select("leader", "node", "raw", "tokens").mapInArrow(tie_here, out)
        else:
            own = F.expr("cast(pmod(xxhash64(node), parts) as int)")
            parts = F.when(F.col("other") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
            sent = members.join(sets_of(members.select("node").distinct()), "node").select("leader", F.explode(parts).alias("part"), "other", "node", "tokens")
            met = sent.repartition("leader", "part").sortWithinPartitions("leader", "part", "other").mapInArrow(tie, out)
        held = written(met.distinct(), "shingle-ties")
    placed = blocks(groups, large, held, percent).join(info, "node").select(*key, "side", "node", "n", "bits")
    kept = written(placed.repartition(*key).sortWithinPartitions(*key).mapInArrow(screen, "leader long, i int, j int, side int, node binary"), "shingle-screened")
    places = kept.groupBy("node").agg(F.collect_list(F.struct(*key, "side")).alias("places"))  # at most one for each of the set's first shingles, or each block of a large group
    met = sets_of(places).select(F.inline("places"), "node", "tokens").select(*key, "side", "node", "tokens")
    found = met.repartition(*key).sortWithinPartitions(*key).mapInArrow(search, "a binary, b binary")
    tied = held.where("tied = 1").join(large, "leader").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return written(found.union(tied), "shingle-links")


def _labelled(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows of count_shingles; node, doc_id, label: the class of each node that isn't the empty set."""
    rows, tables = count_shingles(docs)
    classes = rows.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.first("h").alias("h"), F.first("n").alias("n"), F.first("bits").alias("bits")).select("node", "first.*", "h", "n", "bits")
    with tables_dropped(docs.sparkSession):
        labels = components(links(prefix_lists(docs, tables, percent), classes, docs, percent))
    return rows, classes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))


def class_leaders(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id (NO_ID for null), th: the first by id and hash of text of each class of docs (doc_id, text); rows without words are left out."""
    rows, least = _labelled(docs, percent)
    of_class = rows.where("n > 0").join(least.select("node", "label"), "node").groupBy("label")
    return of_class.agg(F.min(F.struct("doc_id", "th")).alias("first")).select("first.doc_id", "first.th")


def jaccard_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id."""
    rows, least = _labelled(docs, percent)
    smallest = least.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_node = least.join(smallest, "label").select("node", "component_id")
    known = rows.where("n > 0").join(of_node, "node").select("doc_id", "n", "component_id")
    alone = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    null_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return known.union(alone).select(null_id("doc_id"), F.col("n").alias("n_shingles"), null_id("component_id"))


def op4_jaccard_join(spark, sf_dir) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, words[i:i + 4] AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
overlap AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM overlap JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT w.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
FROM w LEFT JOIN size USING (doc_id) JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id
"""
