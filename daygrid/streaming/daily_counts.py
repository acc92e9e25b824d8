"""Incremental daily counts over dropped files.

The table is a folder of partial counts: ``batches/batch=<id>`` of each micro-batch,
``bases/base=<id>`` with the sums of all batches up to an id, and ``pointer``, a table
whose largest id names the base that counts. A read takes that base and the batches
after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPACT_AFTER = 16


def update_counts(
    spark: SparkSession,
    drop_folder: str,
    schema: T.StructType,
    table: str,
    checkpoint: str,
    keys: Sequence[str],
    transform=lambda df: df,
    compact_after: int = COMPACT_AFTER,
) -> DataFrame:
    """Process the files not seen yet and return the accumulated counts.

    Each micro-batch is reduced to partial counts and written as one batch
    folder of the table, so its cost follows the new files and not the history,
    and no state store has to hold every key. A row of an old day in a new file
    raises that day, since reading re-sums the partials. A batch that is
    replayed after a failure overwrites its own folder, so nothing counts twice; one
    that a base already holds is not read again. Once ``compact_after`` batches lie
    after the base they are merged into a new one.
    """
    stream = transform(spark.readStream.schema(schema).parquet(drop_folder))

    def store(batch: DataFrame, batch_id: int) -> None:
        partial = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        partial.write.mode("overwrite").parquet(f"{table}/batches/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    compact(spark, table, keys, compact_after)
    return read_counts(spark, table, keys)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A part of the table, if it was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def base_ids(spark: SparkSession, table: str) -> list[int]:
    """Ids of the bases ever published, in order; the last one counts."""
    pointer = _read(spark, f"{table}/pointer")
    return sorted(r["base"] for r in pointer.select("base").distinct().collect()) if pointer is not None else []


def pending(spark: SparkSession, table: str) -> list[int]:
    """Ids of the batches after the base, in order."""
    batches = _read(spark, f"{table}/batches")
    after = max(base_ids(spark, table), default=-1)
    return sorted(r["batch"] for r in batches.select("batch").filter(F.col("batch") > after).distinct().collect()) if batches is not None else []


def read_counts(spark: SparkSession, table: str, keys: Sequence[str]) -> DataFrame:
    """The sums of the base that the pointer names and of the batches after it."""
    base, batches = max(base_ids(spark, table), default=-1), _read(spark, f"{table}/batches")
    parts = [] if batches is None else [batches.filter(F.col("batch") > base).select(*keys, "n")]
    if base >= 0:
        parts.insert(0, spark.read.parquet(f"{table}/bases/base={base}").select(*keys, "n"))
    if not parts:
        raise ValueError(f"no batch was written to {table}")
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return whole.groupBy(*keys).agg(F.sum("n").alias("n"))


def compact(spark: SparkSession, table: str, keys: Sequence[str], after: int = COMPACT_AFTER) -> bool:
    """Merge the batches into a new base if there are at least ``after``; whether it was done.

    The base is written whole before the pointer names it by one small appended file. A
    compaction that dies leaves a base that nothing names and the next one overwrites.
    What the last pointer but one had merged is removed, so that a read which began with the
    old pointer still finds its base and batches.
    """
    waiting = pending(spark, table)
    if not waiting or len(waiting) < after:
        return False
    named, upto = base_ids(spark, table), waiting[-1]
    read_counts(spark, table, keys).write.mode("overwrite").parquet(f"{table}/bases/base={upto}")
    spark.createDataFrame([(upto,)], "base long").coalesce(1).write.mode("append").parquet(f"{table}/pointer")
    if named:
        old = named[-1]
        _remove(spark, [f"{table}/bases/base={b}" for b in named[-3:-1]])
        batches = spark.read.parquet(f"{table}/batches").select("batch").filter(F.col("batch") <= old).distinct()
        _remove(spark, [f"{table}/batches/batch={r['batch']}" for r in batches.collect()])
    return True


def _remove(spark: SparkSession, folders: Sequence[str]) -> None:
    """Delete folders of the table in whatever file system they are."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    for folder in folders:
        path = paths(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
