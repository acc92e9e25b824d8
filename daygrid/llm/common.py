"""Helpers shared by the text and vector operators."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from inspect import getfullargspec

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows and bytes of an Arrow batch: bound what a Python worker holds of long texts at once.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20

# The C library's call that returns free memory; not every C library has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

# splitmix64 finalizer constants, fixed values.
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Let Arrow functions of this session see at most ``rows`` rows at once, and no more once they pass ``ARROW_BYTES``."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def parts(rows: int, each: int) -> int:
    """Number of groups of about ``each`` rows."""
    return max(1, math.ceil(rows / each))


def bucket_of(n: int, *cols) -> F.Column:
    """A bucket from 0 to n - 1 by the hash of the columns, the same on every retry."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (unsigned, wrapping)."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def give_back() -> None:
    """Returns what Arrow and the C library keep of freed memory; a worker lives on beside others, busy or not."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def giving_back(run: Callable) -> Callable:
    """A group's function of one or two arguments; the memory that it freed is given back after it."""

    def one(rows):
        try:
            return run(rows)
        finally:
            give_back()

    def two(first, second):
        try:
            return run(first, second)
        finally:
            give_back()

    return one if len(getfullargspec(run).args) == 1 else two


def giving_back_at_end(run: Callable) -> Callable:
    """``run`` over the batches of a task; the memory that it freed is given back at the end."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def texts_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Each batch with its texts; a null text counts as empty. Freed memory is given back batch by batch."""
    for batch in batches:
        yield batch, ["" if t is None else t for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
        del batch
        give_back()


def row_key(id_col: str = "doc_id", text_col: str = "text") -> F.Column:
    """What decisions about a row go by: its id, null or not, and the checksum of its text.

    Rows that share an id keep their own decisions; rows equal in both share theirs. Smaller ids
    come first, no id last.
    """
    text = F.md5(F.col(text_col).cast("binary"))
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), text.alias("text_md5"))


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with their row key, under a name that none of their columns has."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, row_key()), name
