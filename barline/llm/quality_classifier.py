"""Document quality from a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters of
``WIDTH`` bytes slide over each chunk (a filter is a table of byte weights per place, so a
response is a sum of look-ups), every filter keeps its largest response in the chunk, and a
small hidden layer turns these and the chunk's fill into a logit. The document's probability
is the logistic of the chunks' logits, averaged by the bytes each chunk alone brings.

Training runs on the driver on at most ``TRAIN_DOCS`` labelled documents, those with the
smallest hashes of their id among the rows that may be learned from, each with at most
``TRAIN_CHUNKS`` evenly spread chunks; everything else covers all rows and whole texts.
The weights are of fixed size. Scoring is a map over the scan.

Defined results: a null or empty text is one chunk of padding; without usable labels every
score is 0.5; null labels and labels without a document are ignored; an empty table gives an
empty result; repeated rows score alike; a null id counts as held out; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, text_of

CHUNK, OVERLAP = 1024, 64
WIDTH, FILTERS, HIDDEN = 5, 24, 16
PAD = 256
TRAIN_DOCS, TRAIN_CHUNKS = 4000, 4
EPOCHS, BATCH, RATE, SEED = 10, 32, 0.01, 11
FOLDS = 5
THRESHOLD = 0.3
#: Chunks whose responses are held at once.
AT_ONCE = 16

SCORES = "doc_id long, score double"
SAMPLE = "quality int, chunk binary, fill double"


def chunk_starts(n: int) -> range:
    """Where the chunks of a text of n bytes begin."""
    return range(0, max(1, n - OVERLAP), CHUNK - OVERLAP)


def chunks_at(raw: bytes, starts: range | list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, CHUNK) of byte numbers, PAD past the end; bytes that each chunk alone brings."""
    x = np.full((len(starts), CHUNK), PAD, dtype=np.int16)
    for row, at in zip(x, starts, strict=True):
        part = np.frombuffer(raw[at : at + CHUNK], np.uint8)
        row[: len(part)] = part
    own = np.clip(len(raw) - np.array(starts), 0, CHUNK - OVERLAP).astype(float)
    return x, np.maximum(own, 1)


@dataclass
class Network:
    """filters: (WIDTH, 257, FILTERS); the rest is the layer above the pooled responses and the fill."""

    filters: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        f = lambda *shape, s=1.0: (rng.standard_normal(shape) * s).astype(np.float32)
        filters = f(WIDTH, 257, FILTERS, s=0.5)
        filters[:, PAD] = -1.0
        return Network(filters, f(FILTERS + 1, HIDDEN, s=0.2), np.zeros(HIDDEN, np.float32), f(HIDDEN, s=0.2), 0.0)

    def pooled(self, x: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of each filter in each chunk, and where."""
        n = x.shape[1] - WIDTH + 1
        out, at = np.empty((len(x), FILTERS), np.float32), np.empty((len(x), FILTERS), np.int64) if places else None
        for i in range(0, len(x), AT_ONCE):
            part = x[i : i + AT_ONCE]
            r = np.take(self.filters[0], part[:, :n], axis=0)
            for k in range(1, WIDTH):
                r += np.take(self.filters[k], part[:, k : n + k], axis=0)
            if places:
                at[i : i + AT_ONCE] = p = r.argmax(1)
                out[i : i + AT_ONCE] = np.take_along_axis(r, p[:, None], 1)[:, 0]
            else:
                out[i : i + AT_ONCE] = r.max(1)
        return out, at

    def logits(self, m: np.ndarray, fill: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.hstack([m, fill[:, None]]).astype(np.float32)
        h = np.maximum(z @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2, h, z


def fit(x: np.ndarray, fill: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on the weighted logistic loss; the filters learn from the places of their largest responses."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    names = ("filters", "w1", "b1", "w2", "b2")
    state = {k: (np.zeros_like(np.asarray(getattr(net, k), np.float32)), np.zeros_like(np.asarray(getattr(net, k), np.float32))) for k in names}
    t, places = 0, np.arange(WIDTH)
    steps = epochs * -(-len(x) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            b = order[i : i + BATCH]
            m, at = net.pooled(x[b], places=True)
            out, h, z = net.logits(m, fill[b])
            g = (weight[b] * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[b])).astype(np.float32) / len(b)
            gh = np.outer(g, net.w2) * (h > 0)
            gm = (gh @ net.w1.T)[:, :FILTERS]
            gf = np.zeros_like(net.filters)
            seen = x[b][np.arange(len(b))[:, None, None], at[:, :, None] + places]  # chunk, filter, place
            np.add.at(gf, (places[None, None, :], seen, np.arange(FILTERS)[None, :, None]), gm[:, :, None])
            t += 1
            rate = RATE * (1 - t / (steps + 1))
            for k, grad in zip(names, (gf, z.T @ gh, gh.sum(0), h.T @ g, np.float32(g.sum())), strict=True):
                a, v = state[k]
                a += 0.1 * (grad - a)
                v += 0.01 * (grad * grad - v)
                setattr(net, k, getattr(net, k) - rate * (a / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6))
    return net


def score(net: Network | None, raw: bytes) -> float:
    if net is None:
        return 0.5
    starts, out, weight = chunk_starts(len(raw)), 0.0, 0.0
    for i in range(0, len(starts), AT_ONCE):  # only so many chunks exist at a time, however long the text
        x, own = chunks_at(raw, starts[i : i + AT_ONCE])
        out += float((net.logits(net.pooled(x)[0], (x != PAD).mean(1))[0] * own).sum())
        weight += float(own.sum())
    return float(1 / (1 + np.exp(-np.clip(out / weight, -30, 30))))


def held_out() -> F.Column:
    """Whether a row's label must not be learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(True))


def training_chunks(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, chunks: int | None = TRAIN_CHUNKS) -> DataFrame:
    """SAMPLE rows of at most `most` labelled documents outside the held-out fold; all their chunks if `chunks` is None."""
    known = labels.where(~held_out() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    rows = docs.join(F.broadcast(some), "doc_id").select("quality", F.encode(text_of(), "UTF-8").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, held, fills = [], [], []
            for label, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = raw.as_buffer().to_pybytes()
                starts = chunk_starts(len(text))
                if chunks and len(starts) > chunks:
                    starts = [starts[i] for i in np.linspace(0, len(starts) - 1, chunks).astype(int)]
                x, _ = chunks_at(text, starts)
                for c in x:
                    q.append(label)
                    held.append(c.astype("<i2").tobytes())
                    fills.append(float((c != PAD).mean()) / len(x))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(held, pa.binary()), pa.array(fills, pa.float64())], names=["quality", "chunk", "fill"])

    return rows.mapInArrow(run, SAMPLE)


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, chunks: int | None = TRAIN_CHUNKS) -> Network | None:
    rows = training_chunks(docs, labels, most, chunks).toArrow().sort_by([("chunk", "ascending"), ("quality", "ascending"), ("fill", "ascending")])
    if not rows.num_rows:
        return None
    x = np.stack([np.frombuffer(c, "<i2") for c in rows["chunk"].to_pylist()])
    y, each = rows["quality"].to_numpy(), rows["fill"].to_numpy()
    fill = (x != PAD).mean(1)
    weight = np.where(fill > 0, each / np.maximum(fill, 1e-9), 1.0)  # every document weighs the same
    return fit(x, fill, y, weight / weight.mean())


def scored(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, score of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in batches:
            s = [score(net, x.as_buffer().to_pybytes()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_of(), "UTF-8").alias("raw")).mapInArrow(run, SCORES)


def accepted(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores at least threshold, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                good = [score(net, x.as_buffer().to_pybytes() if x.is_valid else b"") >= threshold for x in part.column(at)]
                yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_classifier(spark, sf_dir) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
