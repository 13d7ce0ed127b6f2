"""Token counts of whole texts; huge ones in overlapping chunks that are resynchronised.

A text above ``chunk_chars`` is encoded in chunks that overlap. The pre-tokenizer of a
byte-level BPE reads left to right and looks only ahead, and merges never cross its pieces;
so once two encodings both begin a piece at the same place, they agree from there on, as far
as both see the same text. Counts are therefore spliced at a place in the overlap where both
the left and the right chunk begin a piece, taken no nearer than ``guard`` characters to the
left chunk's end, where its view is cut. If there is none, the overlap is doubled, up to the
whole rest. Special strings of the vocabulary are pieces of their own; the guard is longer
than any of them, so none is cut by a splice.

Defined results: a null text is empty and has 0 tokens; an empty table gives an empty result;
repeated rows are counted alike; a null id is passed on; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sliced, text_of

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 256
GUARD_CHARS = 64
#: Characters handed to the library at once.
BATCH_CHARS = 1 << 18
LIMIT = 1024
COUNTS = "doc_id long, n_bytes long, n_tokens long"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The library's tokenizer for a .json file, on the task's own thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def piece_starts(enc) -> tuple[dict[int, int], list[int]]:
    """Offset of each pre-tokenizer piece -> index of its first token; the offsets in order.

    A special string has no word id; it is a piece by itself.
    """
    starts, last = {}, object()
    for i, (w, (a, _)) in enumerate(zip(enc.word_ids, enc.offsets, strict=True)):
        if w is None or w != last:
            starts.setdefault(a, i)
        last = object() if w is None else w
    return starts, sorted(starts)


def count_long(tok, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, guard: int = GUARD_CHARS) -> int:
    """Tokens of text, from overlapping chunks spliced at common piece starts."""
    at, total = 0, 0
    enc = tok.encode(text[: at + chunk], add_special_tokens=False)
    starts, order = piece_starts(enc)
    first = 0  # index of the first token of this chunk that is not yet counted
    end = min(len(text), chunk)
    while end < len(text):
        wide = overlap
        while True:
            begin = max(at, end - wide)
            if begin == at:  # no common start in the whole chunk: take it together with the next one
                right, begin = tok.encode(text[at : end + chunk], add_special_tokens=False), at
                r_starts, r_order = piece_starts(right)
                splice, left_index, right_index = None, 0, first
                break
            right = tok.encode(text[begin : begin + chunk + wide], add_special_tokens=False)
            r_starts, r_order = piece_starts(right)
            splice = next((p for p in reversed(order) if begin < at + p <= end - guard and at + p - begin in r_starts), None)
            if splice is not None:
                left_index, right_index = starts[splice], r_starts[at + splice - begin]
                break
            wide *= 2
        if splice is not None:
            total += left_index - first
            end = min(len(text), begin + chunk + wide)
        else:
            end = min(len(text), end + chunk)
            chunk *= 2
        at, starts, order, enc, first = begin, r_starts, r_order, right, right_index
    return total + len(enc.ids) - first


def count_all(path: str, texts: list[str], chunk: int = CHUNK_CHARS) -> list[int]:
    tok = tokenizer(path)
    out = [0] * len(texts)
    held: list[int] = []
    size = 0

    def flush() -> None:
        for i, e in zip(held, tok.encode_batch_fast([texts[i] for i in held], add_special_tokens=False), strict=True):
            out[i] = len(e)
        held.clear()

    for i, x in enumerate(texts):
        if len(x) > chunk:
            out[i] = count_long(tok, x, chunk)
            continue
        held.append(i)
        size += len(x)
        if size >= BATCH_CHARS:
            flush()
            size = 0
    flush()
    return out


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            n = pa.array(count_all(path, b.column(2).to_pylist(), chunk), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_of()).cast("long").alias("n_bytes"), text_of().alias("text"))
    return rows.mapInArrow(run, COUNTS)


def op7_token_counts(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    counts = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("byte_bpe_50k.json")))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
