"""Repeated byte strings across documents: blockwise suffix sorting with a difference cover.

A byte goes if some ``LENGTH``-byte string that covers it also starts earlier (in a document
of smaller id, or before it in the same one).

1. Dealing. Each window of LENGTH bytes chooses the leftmost smallest hash of its
   ``GRAM``-byte strings as its anchor, so equal windows choose equal anchors at equal places.
   The windows of an anchor make runs, each with a key: the hash of bytes that all windows of
   the run hold. There are three levels: the halves of an anchor's windows (2 * GRAM bytes),
   ``CLASS`` windows side by side (LENGTH - CLASS + 1 bytes), and single windows (all bytes).
2. Keys. Only keys that occur twice matter; a row per key and document goes to the task of the
   key, which streams its sorted rows and tells the documents. A key that occurs more than
   ``HOT`` times is not used: its windows are dealt again at the next level, so the edges of a
   passage that very many documents share, with other text around each, spread over keys of
   their own; windows that a task sees to be repeated are marked before that and ask no more. A
   task that alone sees a key more often than ``HOT`` tells its documents itself and sends one
   row with the count.
3. Suffix buckets. The runs of repeated keys are cut out of their documents and sent to the
   task of their key, a row per run. A task sorts one block of buckets at a time. It first
   ranks the suffixes at the places of a difference cover of the block's text (a sixth of
   all places), with the common prefixes of neighbours. Windows are sorted by their first
   bytes, as many as the cover's period; those that still tie are split around pivots: for two
   places there is an offset below the period at which both meet the cover, and the ranks
   there, cut to what is left of the window, say which is smaller or that both are equal,
   however long the tie. Memory is bounded by the block, time by the cover.
4. Of equal windows all but the earliest become removed runs of their documents.

What a task already sees to be repeated it marks at once and sends no further: a passage
that a third of all documents share leaves a task once, not once per document.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing; an empty table
gives an empty result; rows that share an id are judged as one document's (a string is earlier
only by id or start), so repeated rows get equal results; a null id comes after all ids; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sliced, text_of, written

LENGTH, GRAM = 100, 32
#: Window starts that an anchor can have.
REACH = LENGTH - GRAM + 1
#: Windows of a run at each level: half an anchor's, some side by side, one.
LEVELS, CLASS = 3, 8
#: A difference cover: every difference modulo PERIOD is one of two members' (fixed values).
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Bytes whose grams are hashed together; positions in them take BLOCK_BITS bits.
BLOCK_BITS = 17
#: Keys, and runs, that a task holds before it sends them off; runs that are sorted at once.
KEYS, RUNS, BLOCK = 1 << 20, 1 << 16, 1 << 14
#: Occurrences beyond which a key is dealt at the next level.
HOT = 4096
NO_ID = 2**63 - 1

_U = np.uint64
_LOW = _U((1 << BLOCK_BITS) - 1)
_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = _mixed(np.arange(1, 257, dtype=_U))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place; doubling from single bytes."""
    h, k, base = _BYTES[data], 1, _BASE
    while k < GRAM:
        h = h[:-k] * _U(base) + h[k:]
        k, base = 2 * k, base * base % (1 << 64) | 1
    return _mixed(h)


def window_anchors(h: np.ndarray) -> np.ndarray:
    """For each window, the place of its leftmost smallest gram hash."""
    m = (h & ~_LOW) | np.arange(len(h), dtype=_U)
    k = 1
    while 2 * k <= REACH:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    if k < REACH:
        m = np.minimum(m[: len(m) - (REACH - k)], m[REACH - k :])
    return (m & _LOW).astype(np.int64)


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before; the first row always."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


@dataclass
class Windows:
    """Windows of a piece of text: gram hashes of the piece, and of each window its anchor, start, text number and that text's offset."""

    h: np.ndarray
    at: np.ndarray
    start: np.ndarray
    text: np.ndarray
    shift: np.ndarray

    def only(self, rows: np.ndarray) -> Windows:
        return Windows(self.h, self.at[rows], self.start[rows], self.text[rows], self.shift[rows])

    def dealt(self, level: int) -> tuple[np.ndarray, ...]:
        """(text number, key, anchor, first start, last start) of each run at a level; places count from the text's begin."""
        column = self.start - self.at + REACH - 1
        own = (self.start > self.at - GRAM) if level == 0 else column // CLASS if level == 1 else column
        first = np.flatnonzero(_edges(self.at, self.text, own))
        size = np.diff(np.append(first, len(self.at)))
        at, own = self.at[first], own[first].astype(np.int64)
        if level == 0:
            begin, gaps = np.where(own, at, at - GRAM), (0, GRAM)
        elif level == 1:
            begin, gaps = at - (REACH - 1) + own * CLASS + CLASS - 1, (0, GRAM, LENGTH - CLASS + 1 - GRAM)
        else:
            begin, gaps = self.start[first], (0, GRAM, 2 * GRAM, LENGTH - GRAM)
        key = own.astype(_U) + _U(100 * level + 1)
        for g in gaps:
            key = _mixed(key * _U(_BASE) + self.h[begin + g])
        shift = self.shift[first]
        return self.text[first], key, at + shift, self.start[first] + shift, self.start[first] + size - 1 + shift


def pieces(texts: list[bytes]) -> Iterator[Windows]:
    """All windows of the texts, a bounded piece at a time."""
    size = 1 << BLOCK_BITS
    held: list[tuple[int, int, bytes]] = []  # text, where the part begins, part
    total = 0

    def piece() -> Windows:
        data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        lengths = np.array([len(x) for _, _, x in held])
        begin = np.cumsum(lengths) - lengths
        h = gram_hashes(data)
        at = window_anchors(h)
        start = np.arange(len(at))
        part = np.repeat(np.arange(len(held)), lengths)[: len(at)]
        ok = start + LENGTH <= (begin + lengths)[part]
        part = part[ok]
        return Windows(h, at[ok], start[ok], np.array([t for t, _, _ in held])[part], (np.array([o for _, o, _ in held]) - begin)[part])

    for t, x in enumerate(texts):
        o = 0
        while len(x) - o >= LENGTH:
            part = x[o : o + size - total]
            held.append((t, o, part))
            total += len(part)
            o += len(part) - LENGTH + 1  # every window start lies in one part
            if size - total < LENGTH:
                yield piece()
                held, total = [], 0
    if held:
        yield piece()


def _segments(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each segment, one segment after the other."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


class Runs:
    """Runs of windows: key, document, text hash, anchor, first and last window column, and the bytes under the windows."""

    NAMES = ("key", "doc", "th", "at", "lo", "hi")

    def __init__(self, key: np.ndarray, doc: np.ndarray, th: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, data: np.ndarray) -> None:
        self.key, self.doc, self.th, self.at, self.lo, self.hi, self.data = key, doc, th, at, lo, hi, data
        self.count = hi - lo + 1
        self.width = self.count + LENGTH - 1
        self.begin = np.cumsum(self.width) - self.width

    def __len__(self) -> int:
        return len(self.key)

    def take(self, rows: np.ndarray) -> Runs:
        return Runs(*(getattr(self, k)[rows] for k in self.NAMES), self.data[_segments(self.begin[rows], self.width[rows])])

    def cut(self, lo: np.ndarray, hi: np.ndarray) -> Runs:
        """The same runs from column lo to column hi of each."""
        return Runs(self.key, self.doc, self.th, self.at, lo, hi, self.data[_segments(self.begin + lo - self.lo, hi - lo + LENGTH)])

    @staticmethod
    def joined(parts: list[Runs]) -> Runs:
        return Runs(*(np.concatenate([getattr(p, k) for p in parts]) for k in (*Runs.NAMES, "data")))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Run and column of each window."""
        return np.repeat(np.arange(len(self)), self.count), _segments(self.lo, self.count)


def runs_of(text: np.ndarray, doc: int, th: int, key: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> Runs:
    """Runs of windows of one text; column REACH - 1 is the anchor's first byte."""
    n, origin = len(key), at - (REACH - 1)
    return Runs(key.view(np.int64), np.full(n, doc), np.full(n, th), at, first - origin, last - origin, text[_segments(first, last - first + LENGTH)])


def _offsets() -> np.ndarray:
    """For two residues the least offset at which both meet the cover."""
    member = np.isin(np.arange(PERIOD), COVER)
    place = (np.arange(PERIOD)[:, None] + np.arange(PERIOD)) % PERIOD  # residue, offset
    return (member[place][:, None, :] & member[place][None, :, :]).argmax(2)


OFFSETS = _offsets()
_MEMBER = np.isin(np.arange(PERIOD), COVER)


class CoverRanks:
    """Ranks of the suffixes of data at chosen places of the difference cover, and a table for the least common prefix between two ranks."""

    def __init__(self, data: np.ndarray, places: np.ndarray, group: np.ndarray) -> None:
        tails = np.empty((len(places), 4 + LENGTH), np.uint8)
        tails[:, :4] = group.astype(">u4").view(np.uint8).reshape(-1, 4)  # only suffixes of one group are ever compared
        tails[:, 4:] = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(LENGTH, np.uint8)), LENGTH)[places]
        order = np.argsort(tails.view(f"V{4 + LENGTH}").ravel(), kind="stable")
        ranked = tails[order]
        differ = ranked[1:] != ranked[:-1]
        common = np.zeros(len(order), np.uint8)
        common[1:] = np.where(differ.any(1), np.maximum(differ.argmax(1) - 4, 0), LENGTH)
        self.rank = np.zeros(len(data) + LENGTH, np.int32)
        self.rank[places[order]] = np.arange(len(order))
        self.least = [common]
        while 2 * (k := 1 << len(self.least) - 1) <= len(common):
            self.least.append(np.minimum(self.least[-1][:-k], self.least[-1][k:]))
        self.flat, self.row = np.concatenate(self.least), np.cumsum([0, *(len(x) for x in self.least)])[:-1]

    def compared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each two windows x, y that agree in their first PERIOD bytes."""
        off = OFFSETS[x % PERIOD, y % PERIOD]
        a, b = self.rank[x + off], self.rank[y + off]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(np.maximum(high - low, 1).astype(np.float64))[1] - 1
        at = self.row[level]
        least = np.minimum(self.flat[at + np.minimum(low + 1, high)], self.flat[at + high - (1 << level) + 1])
        return np.where((a == b) | (least >= LENGTH - off), 0, np.sign(a - b))


def _repeated_block(s: Runs) -> np.ndarray:
    """Marks of the windows that occur earlier; s: whole buckets of a key, by (key, doc, at)."""
    run, column = s.windows()
    marks = np.zeros(len(run), bool)
    group = np.cumsum(_edges(s.key)) - 1
    turn = np.cumsum(_edges(group, s.doc, s.at))  # equal for rows that are the same place
    x = s.begin[run] + column - s.lo[run]
    bucket = group[run] * REACH + column
    rows = np.flatnonzero(np.bincount(bucket)[bucket] > 1)
    if not len(rows):
        return marks
    eight = np.ndarray((len(s.data) - 7,), ">u8", np.ascontiguousarray(s.data), 0, (1,))
    heads = [eight[x[rows] + k].astype(_U) for k in range(0, PERIOD + 1, 8)]
    by = np.lexsort((*heads[::-1], bucket[rows]))
    new = _edges(bucket[rows][by], *(k[by] for k in heads))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(by)))
    tied = np.repeat(size > 1, size)
    rows, tie = rows[by][tied], np.repeat(np.arange(len(size)), size)[tied]
    if not len(rows):
        return marks

    some = np.zeros(len(s), bool)
    some[run[rows]] = True
    mine = np.flatnonzero(some)
    places = _segments(s.begin[mine], s.count[mine] + PERIOD - 1)
    owner = np.repeat(group[mine], s.count[mine] + PERIOD - 1)
    sample = _MEMBER[places % PERIOD]
    ranks = CoverRanks(s.data, places[sample], owner[sample])

    leader = np.arange(len(rows))
    left, part, where = leader, tie, x[rows]
    while len(left):
        begin = np.flatnonzero(_edges(part))
        size = np.diff(np.append(begin, len(part)))
        pivot = left[np.repeat(begin + size // 2, size)]
        sign = ranks.compared(where[left], where[pivot])
        leader[left[sign == 0]] = pivot[sign == 0]
        rest = sign != 0
        part = np.repeat(np.arange(len(size)), size)[rest] * 2 + (sign[rest] > 0)
        by = np.argsort(part, kind="stable")
        left, part = left[rest][by], part[by]
        begin = np.flatnonzero(_edges(part))
        size = np.diff(np.append(begin, len(part)))
        several = np.repeat(size > 1, size)
        left, part = left[several], part[several]
    when = turn[run[rows]]
    earliest = np.full(len(rows), np.iinfo(np.int64).max)
    np.minimum.at(earliest, leader, when)
    marks[rows] = when > earliest[leader]
    return marks


def repeated(s: Runs) -> tuple[Runs, np.ndarray]:
    """s by (key, doc, at) and the marks of its windows; sorted one block of buckets after the other."""
    s = s.take(np.lexsort((s.at, s.doc, s.key)))
    begin = np.cumsum(s.count) - s.count
    marks = np.zeros(int(s.count.sum()), bool)
    starts = np.flatnonzero(_edges(s.key))
    sizes = np.diff(np.append(starts, len(s)))
    rows = np.flatnonzero(np.repeat(sizes, sizes) > 1)  # a bucket of one run repeats nothing
    at = 0
    while at < len(rows):
        end = min(at + BLOCK, len(rows))
        while end < len(rows) and s.key[rows[end]] == s.key[rows[end - 1]]:
            end += 1
        block = rows[at:end]
        marks[_segments(begin[block], s.count[block])] = _repeated_block(s.take(block))
        at = end
    return s, marks


def spans(s: Runs, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, th, start, end) of the bytes under marked windows, merged as far as they meet here."""
    run, column = s.windows()
    run, column = run[marks], column[marks]
    doc, th, at = s.doc[run], s.th[run], s.at[run] - (REACH - 1) + column
    order = np.lexsort((at, th, doc))
    doc, th, at = doc[order], th[order], at[order]
    new = _edges(doc, th)
    new[1:] |= at[1:] > at[:-1] + LENGTH
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return doc[first], th[first], at[first], at[last] + LENGTH


def _rows(docs: DataFrame) -> DataFrame:
    raw = F.encode(text_of(), "UTF-8")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(raw).alias("th"), raw.alias("raw"))


def open_keys(s: Runs, marks: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, keys at a level) of the windows that are not marked."""
    run, column = s.windows()
    zero = np.zeros(len(run), np.int64)
    w = Windows(gram_hashes(s.data), (s.begin + REACH - 1 - s.lo)[run], s.begin[run] + column - s.lo[run], run, zero).only(~marks)
    run, keys, *_ = w.dealt(level)
    return s.doc[run], keys


def repeated_keys(rows: DataFrame, level: int, hot: int) -> DataFrame:
    """doc_id, key, hot: each document's keys at a level that occur twice in all.

    Beyond level 0 rows have wanted, the keys of the level before whose windows are dealt, and
    the result has rows with th, start and stop instead: bytes that are known to be removed.
    """
    names = ["key", "doc_id", "n", *(["th", "start", "stop"] if level else [])]
    kinds = [pa.int64(), pa.int64(), pa.int32(), *([pa.int64()] * 3 if level else [])]

    def batch(*columns: np.ndarray) -> pa.RecordBatch:
        n = len(columns[0])
        given = [pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]
        return pa.RecordBatch.from_arrays([*given, *(pa.nulls(n, t) for t in kinds[len(given) :])], names=names)

    def counted(docs: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        """A row (key, document, 1) each; of keys met more than `hot` times here (key, document, 0), as they are known, and (key, -, count)."""
        o = np.argsort(keys, kind="stable")
        k, d = keys[o], docs[o]
        first = np.flatnonzero(_edges(k))
        n = np.diff(np.append(first, len(k)))
        many = n > hot
        state = np.where(np.repeat(many, n), 0, 1)
        return batch(np.append(k, k[first[many]]).view(np.int64), np.append(d, d[first[many]]), np.append(state, n[many]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, size = [], [], 0
        for b in sliced(batches):
            ids = b.column(0).to_numpy()
            for w in pieces([x.as_buffer().to_pybytes() for x in b.column(1)]):
                t, k, *_ = w.dealt(0)
                docs.append(ids[t])
                keys.append(k)
                size += len(k)
                if size >= KEYS:
                    yield counted(np.concatenate(docs), np.concatenate(keys))
                    keys, docs, size = [], [], 0
        if size:
            yield counted(np.concatenate(docs), np.concatenate(keys))

    def deal_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Runs] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            s, marks = repeated(Runs.joined(held))
            doc, th, start, stop = spans(s, marks)
            yield batch(start, doc, np.full(len(doc), -1), th, start, stop)
            yield counted(*open_keys(s, marks, level))

        for b in batches:
            for doc, th, raw, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                for s in wanted_runs(raw.as_buffer().to_pybytes(), doc, th, want.values.to_numpy().view(_U), (level - 1,)):
                    held.append(s)
                    size += len(s)
                    if size >= RUNS:
                        yield from flush()
                        held, size = [], 0
        if size:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key: a bucket is held only until it ends or is known to be hot."""
        none = np.empty(0, np.int64)
        held, known = (none, none, none), None
        out = ["doc_id", "key", "hot", *names[3:]]

        def told(k: np.ndarray, d: np.ndarray, is_hot: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(k), pa.array(is_hot, pa.bool_()), *(pa.nulls(len(k), t) for t in kinds[3:])], names=out)

        def decided(k: np.ndarray, d: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(_edges(k))
            total = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(k)))) if len(k) else n
            some = (total > 1) & (n < 2)
            return told(k[some], d[some], (total > hot)[some])

        for b in batches:
            k, d, n = (b.column(i).to_numpy() for i in range(3))
            if level and (n < 0).any():
                done = b.filter(pa.array(n < 0))
                yield pa.RecordBatch.from_arrays([done.column(1), pa.nulls(done.num_rows, pa.int64()), pa.nulls(done.num_rows, pa.bool_()), *(done.column(i) for i in (3, 4, 5))], names=out)
                k, d, n = k[n >= 0], d[n >= 0], n[n >= 0]
            if known is not None:  # this bucket is hot
                n = np.where((k == known) & (n == 1), 0, n)
                more = (k != known) | (n == 0)
                k, d, n = k[more], d[more], n[more]
            sure = n == 0
            if sure.any():
                yield told(k[sure], d[sure], np.ones(int(sure.sum()), bool))
            if sure.all():
                continue
            k, d, n = (np.append(x, y[~sure]) for x, y in zip(held, (k, d, n), strict=True))
            last = int(np.searchsorted(k, k[-1]))
            yield decided(k[:last], d[:last], n[:last])
            held, known = (k[last:], d[last:], n[last:]), None
            if held[2].sum() > hot:
                known = int(k[-1])
                yield decided(*held)
                held = (none, none, none)
        yield decided(*held)

    more = ", th long, start long, stop long" * (level > 0)
    where = F.when(F.col("n") < 1, F.xxhash64("doc_id", "key")).otherwise(F.col("key"))
    sent = rows.mapInArrow(deal_again, f"key long, doc_id long, n int{more}") if level else rows.select("doc_id", "raw").mapInArrow(deal, "key long, doc_id long, n int")
    return written(sent.repartition(where).sortWithinPartitions("key").mapInArrow(meet, f"doc_id long, key long, hot boolean{more}"), f"repeated-keys-{level}")


def wanted_runs(text: bytes, doc: int, th: int, want: np.ndarray, levels: tuple[int, ...] | range) -> Iterator[Runs]:
    """The runs of a text whose keys are wanted."""
    flat = np.frombuffer(text, np.uint8)
    for w in pieces([text]):
        for level in levels:
            _, key, at, first, last = w.dealt(level)
            mine = np.isin(key, want)
            if mine.any():
                yield runs_of(flat, doc, th, key[mine], at[mine], first[mine], last[mine])


def wanted_keys(rows: DataFrame, hot: int) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, wanted, levels: the keys whose runs a document sends, and of how many levels they are; tables doc_id, th, start, stop of what is removed already."""
    collected, removed, part = None, [], rows
    for level in range(LEVELS):
        met = repeated_keys(part, level, hot if level < LEVELS - 1 else 2**31 - 1)
        use = met.where("not hot").select("doc_id", "key", F.lit(level + 1).alias("levels"))
        collected = use if collected is None else collected.union(use)
        if level:
            removed.append(met.where("hot is null").select("doc_id", "th", "start", "stop"))
        again = met.where("hot")
        if again.isEmpty():
            break
        part = rows.join(again.groupBy("doc_id").agg(F.collect_set("key").alias("wanted")), "doc_id")
    return collected.groupBy("doc_id").agg(F.collect_set("key").alias("wanted"), F.max("levels").alias("levels")), removed


def removed_runs(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, th, start, stop: runs of bytes to remove (they may meet or overlap)."""
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2
    names = ["doc_id", "th", "start", "stop"]

    def binary(data: np.ndarray, width: np.ndarray) -> pa.Array:
        ends = np.append(0, np.cumsum(width)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(width), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per run; what is repeated here is known: (0, document, text, start, 0, length, no bytes)."""
        held: list[Runs] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            s, marks = repeated(Runs.joined(held))
            doc, th, start, stop = spans(s, marks)
            zero = np.zeros(len(doc), np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip((zero, doc, th, start, zero, stop - start), kinds, strict=True)), binary(np.empty(0, np.uint8), zero)], names=[*Runs.NAMES, "data"])
            run, column = s.windows()
            open_ = np.flatnonzero(~marks)
            first = np.flatnonzero(_edges(run[open_]))
            last = np.append(first[1:], len(open_))[: len(first)] - 1
            left = s.take(run[open_[first]]).cut(column[open_[first]], column[open_[last]])  # all windows marked: nothing left to ask
            yield pa.RecordBatch.from_arrays([*(pa.array(getattr(left, k), t) for k, t in zip(Runs.NAMES, kinds, strict=True)), binary(left.data, left.width)], names=[*Runs.NAMES, "data"])

        for b in batches:
            for doc, th, raw, want, levels in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4).to_pylist(), strict=True):
                for s in wanted_runs(raw.as_buffer().to_pybytes(), doc, th, want.values.to_numpy().view(_U), range(levels)):
                    held.append(s)
                    size += len(s)
                    if size >= RUNS:
                        yield from flush()
                        held, size = [], 0
        if size:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs come by key, document and place; whole buckets are sorted together, a very large one goes on with its runs that nothing before repeats."""
        held: list[Runs] = []
        size = 0

        def found(s: Runs) -> tuple[pa.RecordBatch, Runs]:
            s, marks = repeated(s)
            left = np.add.reduceat(~marks, np.cumsum(s.count) - s.count) > 0 if len(s) else np.zeros(0, bool)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in spans(s, marks)], names=names), s.take(np.flatnonzero(left))

        for b in batches:
            cols = [b.column(i).to_numpy().astype(np.int64) for i in range(6)]
            ends = np.frombuffer(b.column(6).buffers()[1], np.int32)[b.column(6).offset :][: b.num_rows + 1].astype(np.int64)
            raw = b.column(6).buffers()[2]
            flat = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
            known = np.diff(ends) == 0
            if known.any():
                doc, th, start, length = (cols[i][known] for i in (1, 2, 3, 5))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc, th, start, start + length)], names=names)
            if known.all():
                continue
            own = np.flatnonzero(~known)
            held.append(Runs(*(c[own] for c in cols), flat[_segments(ends[own], np.diff(ends)[own])]))
            size += len(own)
            if size >= 2 * BLOCK:
                s = Runs.joined(held)
                whole = int(np.searchsorted(s.key, s.key[-1]))  # rows come by key
                rest = s.take(np.arange(whole, len(s)))
                if whole:
                    yield found(s.take(np.arange(whole)))[0]
                elif len(s) >= 4 * BLOCK:
                    out, rest = found(s)
                    yield out
                held, size = [rest], len(rest) if whole else 0
        if held:
            yield found(Runs.joined(held))[0]

    ddl = "key long, doc long, th long, at long, lo int, hi int, data binary"
    where = F.when(F.octet_length("data") == 0, F.xxhash64("doc", "at")).otherwise(F.col("key"))
    sent = rows.join(wanted, "doc_id").select("doc_id", "th", "raw", "wanted", "levels").mapInArrow(send, ddl)
    return sent.repartition(where).sortWithinPartitions("key", "doc", "at").mapInArrow(merge, "doc_id long, th long, start long, stop long")


def suffix_dedup(docs: DataFrame, keep_bytes: bool = False, hot: int = HOT) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay)."""
    rows = _rows(docs)
    wanted, removed = wanted_keys(rows, hot)
    runs = removed_runs(rows, wanted)
    for known in removed:
        runs = runs.union(known)
    gone = runs.groupBy("doc_id").agg(F.collect_list(F.struct("th", "start", "stop")).alias("gone"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(5 + keep_bytes)]
            for doc, th, raw, gaps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                text = raw.as_buffer().to_pybytes()
                merged: list[list[int]] = []
                if gaps.is_valid:
                    v = gaps.values.flatten()
                    mine = v[0].to_numpy() == th
                    for a, e in sorted(zip(v[1].to_numpy()[mine].tolist(), v[2].to_numpy()[mine].tolist(), strict=True)):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(e, merged[-1][1])
                        else:
                            merged.append([a, e])
                edges = [0, *(x for m in merged for x in m), len(text)]
                kept = b"".join(text[a:e] for a, e in zip(edges[::2], edges[1::2], strict=True))
                for c, x in zip(cols, (None if doc == NO_ID else doc, len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept), strict=False):
                    c.append(x)
            types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_bytes
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=[x.split()[0] for x in out.split(", ")])

    return rows.join(gone, "doc_id", "left").select("doc_id", "th", "raw", "gone").mapInArrow(cut, out)


def op1_suffix_dedup(spark, sf_dir) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
