"""Mixture-controlled packing of tokenised documents by deficit round-robin.

Each source is a queue of tokens: the documents of a scan partition in the order read, the
partitions one after the other. The stream of windows is cut into spans of ``span_windows``
windows. Span p takes from source s the tokens [floor(p*G*w_s/W), floor((p+1)*G*w_s/W)) of
its queue (G tokens a span, w_s the source's weight of W; once a queue is empty the others
share its part), so the fractions that a source is owed pass from span to span, and so from
partition to partition, by arithmetic alone. Without given weights a source weighs what it
holds, which uses up all queues together. Inside a
span, deficit round-robin fills one window after the other: every queue is credited its share,
gives the whole part of its deficit, and the rest of the window goes to the largest deficits;
what is over or short is carried to the next window. The filling depends on counts only, so
whichever task holds a document works out its pieces without moving any token.

All windows are full but those of the last span's rest, which make up powers of two: at most 11
short ones in all, and no padding.

Tokens are made once, per white-space word with a bounded cache (the tokenizer splits at white
space, so words encode alone as they do in place), and kept in the shared folder.

Defined results: a null or empty text is the end token alone; an empty table gives no pieces;
repeated rows are documents of their own; null is a queue of its own; a null id is passed on;
other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from fractions import Fraction
from functools import lru_cache
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import KEPT, sliced, text_of, written

WINDOW = 2048
SPAN_WINDOWS = 64
END_ID = 1
#: Words that a task remembers.
CACHE_WORDS = 150_000
#: White space as the tokenizer's patterns have it; str.split() also cuts at U+001C to U+001F.
WORD = re.compile(r"[^\t-\r \x85\xa0  -     　]+")
ODD = "\x1c\x1d\x1e\x1f"
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#*$%&@+=~^/()\[\]{}\"_-]*)")

TOKENS = "doc_id long, source string, chunk int, start long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
PIECE_TYPES = [pa.int64()] * 7 + [pa.string()]
PIECE_NAMES = [x.split()[0] for x in PIECES.split(", ")]


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies spell bytes: printable Latin-1 stands for itself, the rest follows U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Ids of white-space words as bytes (little-endian unsigned 16-bit), remembered in two generations.

    A word of Latin-1 letters, with or without a run of marks at its end, is two pieces to the
    tokenizer, the lower-cased letters and the marks, so the letters go to its model directly
    and all spellings share them; every other word goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.letters = self.tok.model, byte_letters()
        self.written = [i.to_bytes(2, "little") for i in range(self.tok.get_vocab_size())]
        self.known, self.older = _Known(self.make), {}
        self.marks = _Known(self._whole)
        self.marks[""] = b""

    def _whole(self, word: str) -> bytes:
        return np.array(self.tok.encode(word, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def _piece(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)  # ASCII letters are spelt by themselves
        ids = self.written
        return b"".join([ids[x.id] for x in self.model.tokenize(spelt)])

    def make(self, word: str) -> bytes:
        """The ids of a word that is not known; the letters' ids are kept with it."""
        if (ids := self.older.get(word)) is not None:
            return ids
        marks = ""
        if word.isascii() and word.isalpha():
            core = word.lower()
        elif (m := SIMPLE.fullmatch(word)) is not None:
            core, marks = m[1].lower(), m[2]
        else:
            return self._whole(word)
        if (ids := self.known.get(core)) is None and (ids := self.older.get(core)) is None:
            ids = self._piece(core)
            if core != word:
                self.known[core] = ids
        return ids + self.marks[marks]

    def of(self, text: str) -> bytes:
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = _Known(self.make), self.known
        words = WORD.findall(text) if any(c in text for c in ODD) else text.split()
        return b"".join(map(self.known.__getitem__, words))


class _Known(dict):
    """A dictionary that makes what it lacks."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.make(word)
        return ids


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


KEPT["packing"] = _word_ids.cache_clear


def encode(path: str, texts: Iterable[str], end_id: int = END_ID) -> Iterator[bytes]:
    """The ids of each text and end_id, little-endian unsigned 16-bit (vocabularies of up to 65,536)."""
    words, tail = _word_ids(path), int(end_id).to_bytes(2, "little")
    for x in texts:
        yield words.of(x) + tail


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """TOKENS: ids as unsigned 16-bit (vocabularies of up to 65,536), start in the queue of (source, chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, upto = TaskContext.get().partitionId(), {}
        for b in sliced(batches, keep="packing"):
            ids, starts, counts = [], [], []
            for s, raw in zip(b.column(1).to_pylist(), encode(path, b.column(2).to_pylist(), end_id), strict=True):
                starts.append(upto.get(s, 0))
                counts.append(len(raw) // 2)
                upto[s] = starts[-1] + counts[-1]
                ids.append(raw)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([chunk] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "source", "chunk", "start", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_of().alias("text"))
    return written(rows.mapInArrow(run, TOKENS), "packing-tokens")


class Spans:
    """What each window of each span takes from each queue; totals: tokens of the sources.

    Token j (from 0) of source s is due at (2j + 1) / 2w_s, and a span is the next G tokens in
    the order in which they are due, ties to the first source: the allotment of seats by the
    divisor method of odd numbers, which never takes back what it has given. So every span but
    the last holds whole windows, whatever the number of sources. Weights are the totals by
    default, so that no queue ends before another. With other weights a queue may run dry: from
    there on the others share its part by their weights; queues of weight 0 come when no other
    is left, in the proportion of what they hold.
    """

    def __init__(self, totals: list[int], window: int = WINDOW, span_windows: int = SPAN_WINDOWS, weights: list[int] | None = None) -> None:
        self.totals, self.all, self.window, self.size, self.stride = totals, sum(totals), window, window * span_windows, span_windows
        weights = weights or totals
        self.rates = [w or t for w, t in zip(weights, totals, strict=True)]
        held = [s for s, t in enumerate(totals) if t]
        self.tiers = [x for x in ([s for s in held if weights[s]], [s for s in held if not weights[s]]) if x]
        self.ends = {s: Fraction(totals[s], self.rates[s]) for s in held}
        self.places = {s: (sum(totals[o] for x in self.tiers[:i] for o in x), [(self.rates[o], totals[o]) for o in tier]) for i, tier in enumerate(self.tiers) for s in tier}
        self.bounds: dict[int, list[int]] = {}
        self.known: dict[int, tuple[list[list[int]], list[list[int]]]] = {}

    def due(self, at: int) -> list[Fraction | int]:
        """What is due from each source when `at` tokens have been taken."""
        out: list[Fraction | int] = [0] * len(self.totals)
        for tier in self.tiers:
            rate, before = sum(self.rates[s] for s in tier), 0  # of the queues that are not dry; held by the dry ones
            for s in sorted(tier, key=self.ends.__getitem__):
                if before + rate * self.ends[s] >= at:
                    break
                rate, before = rate - self.rates[s], before + self.totals[s]
            time = Fraction(at - before, rate) if rate else None
            for s in tier:
                out[s] = self.totals[s] if time is None else min(time * self.rates[s], self.totals[s])
            at -= min(at, sum(self.totals[s] for s in tier))
        return out

    def before(self, p: int) -> list[int]:
        """Tokens of each source before span p; together they are p whole spans, or all tokens."""
        if p in self.bounds:
            return self.bounds[p]
        at = min(p * self.size, self.all)
        out = [min(int(x + Fraction(1, 2)), t) for x, t in zip(self.due(at), self.totals, strict=True)]
        rest = at - sum(out)
        for tier in self.tiers if rest > 0 else self.tiers[::-1]:
            if rest > 0:
                line = [(Fraction(2 * out[s] + 1, self.rates[s]), s) for s in tier if out[s] < self.totals[s]]
            else:
                line = [(-Fraction(2 * out[s] - 1, self.rates[s]), -s) for s in tier if out[s]]
            heapify(line)
            while rest and line:
                s, step = abs(line[0][1]), 1 if rest > 0 else -1
                out[s] += step
                rest -= step
                if 0 < out[s] < self.totals[s]:
                    heapreplace(line, (step * Fraction(2 * out[s] + step, self.rates[s]), step * s))
                else:
                    heappop(line)
        if len(self.bounds) > 4096:
            self.bounds.clear()
        self.bounds[p] = out
        return out

    def bound(self, s: int, p: int) -> int:
        """Tokens of source s before span p."""
        return self.before(p)[s]

    def of(self, s: int, at: int) -> int:
        """The span of token `at` of source s."""
        early, tier = self.places[s]
        time = (at + 0.5) / self.rates[s]
        p = min(early + int(sum([min(time * r, t) for r, t in tier])), self.all - 1) // self.size  # nearly
        while self.bound(s, p + 1) <= at:
            p += 1
        while self.bound(s, p) > at:
            p -= 1
        return p

    def fill(self, p: int) -> tuple[list[list[int]], list[list[int]]]:
        """For each source its tokens before each window and after the last, and where its part of each window begins."""
        if p in self.known:
            return self.known[p]
        n = len(self.totals)
        low = self.before(p)
        held = np.array(self.before(p + 1), dtype=np.int64) - low
        owed = np.array([float(x - y) for x, y in zip(self.due(p * self.size), low, strict=True)])
        deficit, left, total = owed - owed.mean(), held.copy(), int(held.sum())
        rest = total % self.window
        sizes = [self.window] * (total // self.window) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
        takes, begins = [], []
        for w, size in enumerate(sizes):
            deficit += size * held / total
            take = np.minimum(np.maximum(np.floor(deficit), 0), left).astype(np.int64)
            while (room := size - int(take.sum())) != 0:
                can = np.flatnonzero(left > take if room > 0 else take > 0)
                order = np.argsort(deficit[can] - take[can], kind="stable")
                pick = can[order[::-1][:room] if room > 0 else order[:-room]]
                take[pick] += 1 if room > 0 else -1
            deficit -= take
            left -= take
            turn = np.roll(np.arange(n), -w % n)  # the queue that is served first moves on
            begin = np.empty(n, dtype=np.int64)
            begin[turn] = np.cumsum(take[turn]) - take[turn]
            takes.append(take)
            begins.append(begin)
        upto = np.vstack([np.zeros((1, n), dtype=np.int64), np.cumsum(np.array(takes).reshape(-1, n), axis=0)])
        if len(self.known) > 512:
            self.known.clear()
        self.known[p] = upto.T.tolist(), np.array(begins).reshape(-1, n).T.tolist()
        return self.known[p]

    def pieces(self, s: int, at: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, sequence_id, offset) of a document at token `at` of source s."""
        done = 0
        while done < n:
            p = self.of(s, at + done)
            upto, begins = self.fill(p)
            col, begin, first = upto[s], begins[s], p * self.stride
            x = at + done - self.bound(s, p)
            stop = min(col[-1], x + n - done)
            w = bisect_right(col, x) - 1
            while x < stop:
                k = min(col[w + 1], stop) - x
                if k > 0:
                    yield done, k, first + w, begin[w] + x - col[w]
                    x, done = x + k, done + k
                w += 1


def packed(docs: DataFrame, path: str, window: int = WINDOW, span_windows: int = SPAN_WINDOWS, end_id: int = END_ID, weights: dict[str | None, int] | None = None) -> DataFrame:
    """PIECES of all rows of docs (doc_id, source, text); weights: target proportions by source (sources left out have 0)."""
    spark = docs.sparkSession
    tokens = tokenised(docs, path, end_id)
    queues = tokens.groupBy("source", "chunk").agg(F.sum("n").alias("held"))
    bases = written(queues.select("source", "chunk", (F.sum("held").over(Window.partitionBy("source").orderBy("chunk")) - F.col("held")).alias("base"), "held"), "packing-bases")
    totals = sorted(((r["source"], r["n"]) for r in bases.groupBy("source").agg(F.sum("held").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    index, counts = {s: i for i, (s, _) in enumerate(totals)}, [n for _, n in totals]
    shares = None if weights is None else [weights.get(s, 0) for s, _ in totals]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Spans(counts, window, span_windows, shares)
        for b in sliced(batches):
            rows = []
            for doc_id, source, at, n, ids in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                wide = memoryview(np.frombuffer(ids, "<u2").astype("<u4")).cast("B")
                for start, k, seq, off in spans.pieces(index[source], at, n):
                    rows.append((doc_id, start, k, zlib.crc32(wide[4 * start : 4 * (start + k)]), n, seq, off, source))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), PIECE_TYPES, strict=True)], names=PIECE_NAMES)

    t, q = tokens.alias("t"), bases.alias("q")
    placed = t.join(q, F.col("t.source").eqNullSafe(F.col("q.source")) & (F.col("t.chunk") == F.col("q.chunk"))).select("doc_id", "t.source", (F.col("base") + F.col("start")).alias("at"), "n", "ids")
    return placed.mapInArrow(run, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and the documents' parts in order: one row per sequence."""
    part = F.struct("offset", "doc_id", "start", "length")
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(part)).alias("parts"))


def op2_packing(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("word_bpe_49k.json")))
