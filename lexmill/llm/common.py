"""What the operators of this subpackage share: guarded broadcasts, Arrow
batch sizing, names that clash with nothing and a grouped stream reader."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, shared_dir  # noqa: F401

#: Rows in one Arrow batch. Documents can hold 100,000 characters and more, so
#: the default of 10,000 rows could make a batch of a gigabyte.
ARROW_ROWS = 512
ARROW_BYTES = 16 << 20
#: A side is broadcast only if it was counted and has at most so many narrow rows.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers by bounding their batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a stored, narrow table for broadcast if it has few rows; else the
    join is left to the planner, which shuffles it."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def tasks_for(rows: int, each: int) -> int:
    """Tasks for work that costs time rather than bytes, which the planner,
    who counts bytes, would put into too few."""
    return max(1, min(-(-rows // each), 100_000))


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the tables has, in whatever case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text_col: str) -> F.Column:
    """128 bits of the text's SHA-256; null counts as empty. Equal keys are
    taken for equal texts: among 10^10 texts two meet with a chance of 10^-19."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)), 1, 16)


def fit_threshold(n_rows: int, wanted: int) -> int:
    """Rows whose 31-bit hash is below this make a sample of about ``wanted``."""
    return (1 << 31) if n_rows <= wanted else int((1 << 31) * (wanted / n_rows))


def hash31(*cols) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 33)


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys in batches that are sorted by them. One run is held
    at a time; the callers bound its rows by their block numbers."""
    held: list[pa.RecordBatch] = []
    now: tuple = ()
    for batch in batches:
        n = batch.num_rows
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        start = 0
        for end in range(1, n + 1):
            if end < n and rows[end] == rows[start]:
                continue
            if held and rows[start] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = rows[start]
            held.append(batch.slice(start, end - start))
            start = end
    if held:
        yield now, pa.Table.from_batches(held)


def release() -> None:
    """Gives memory that is no longer used back to the system: idle workers
    stay for a while, beside whatever runs next in their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library, which keeps what it keeps


def map_batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release()

    return df.mapInArrow(run, schema)
