"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import ctypes
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: of ``spark.checkpoint.dir``, or else the context's checkpoint folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isEmpty():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = own.get()
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/barline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


#: With this, Spark deletes the shuffle files of an execution as soon as it ends, not when the driver's garbage collector finds its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Executions begun in here leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


#: made: the tables written in each open tables_dropped() of this thread, the innermost last.
_open = threading.local()


@contextmanager
def tables_dropped(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written in here are deleted at the end, but for the last one, whose path is then left in the list; nothing else may be read later."""
    made: list[str] = []
    _open.made = [*getattr(_open, "made", []), made]
    try:
        yield made
    finally:
        _open.made = _open.made[:-1]
        if _open.made:
            _open.made[-1].extend(made[-1:])
    for path in made[:-1]:
        drop_table(spark, path)
    del made[:-1]


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors and leaves no shuffle files."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with shuffles_dropped(spark):
        df.write.option("compression", compression).parquet(path)
    if made := getattr(_open, "made", []):
        made[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables that this application's queries have written; results not yet stored are lost with them."""
    drop_table(spark, f"{shared_dir(spark)}/barline/{spark.sparkContext.applicationId}")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as tell it from the columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


#: Rows of a few numbers each that are few enough to be sent to every task.
FEW = 200_000


def broadcast_few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is counted to have at most FEW rows; df: a written table of narrow rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def text_of(col: str = "text") -> Column:
    """Whole text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in text."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


#: Rows of an Arrow batch that a task turns into Python objects at once.
SLICE = 512


#: What operators keep in a Python worker from task to task: name -> how to drop it.
KEPT: dict[str, Callable[[], None]] = {}


def give_back(keep: str | None = None) -> None:
    """Return to the system what earlier tasks of this worker have left: other operators' caches, free Arrow memory, free heap."""
    for name, drop in KEPT.items():
        if name != keep:
            drop()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = SLICE, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that memory is bounded by the slice; keep: the caches that this task goes on with."""
    give_back(keep)
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    give_back(keep)  # the worker may be idle from now on
