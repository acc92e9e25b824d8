"""Readers and sinks."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygrid.session import stable


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType) -> DataFrame:
    """CSV with a header and a declared schema. Bad cells become null."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(paths)


def trim_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: c.strip() for c in df.columns if c != c.strip()})


def read_columnar_json(
    spark: SparkSession, path: str, variables: Sequence[str], block: str = "daily"
) -> DataFrame:
    """A JSON object of parallel arrays to one row per day.

    ``time`` holds the days; every variable is an array of the same length, anything else raises.
    """
    fields = ", ".join(f"{v}: array<double>" for v in variables)
    raw = spark.read.schema(f"{block} struct<time: array<string>, {fields}>").json(path, multiLine=True)
    return unpack_arrays(raw, variables, block, F.col("_metadata.file_path"))


def unpack_arrays(df: DataFrame, variables: Sequence[str], block: str = "daily", source: Column | None = None) -> DataFrame:
    """Parallel arrays to rows. A variable that is absent or not as long as ``time`` raises, with the path in ``source``.

    Zipping would fill a short array up with nulls, which then pass for missing days.
    """
    days = F.col(f"{block}.time")
    checked = F.arrays_zip(days, *(F.col(f"{block}.{v}") for v in variables))
    path = F.lit("the input") if source is None else source
    for v in ("time", *variables):
        uneven = ~F.size(F.col(f"{block}.{v}")).eqNullSafe(F.size(days)) | F.col(f"{block}.{v}").isNull()
        told = F.concat(F.lit(f"{block}.{v} is absent or not as long as {block}.time in "), path)
        checked = F.when(uneven, F.raise_error(told)).otherwise(checked)
    rows = df.select(F.explode(checked).alias("r"))
    names = ["time", *variables]
    cells = [F.col("r").getField(n).alias(n) for n in names]
    return rows.select(*cells).select(F.to_date("time").alias("date"), *variables)


def read_json_records(
    spark: SparkSession, path: str | Sequence[str], texts: Sequence[str], multi_line: bool = True
) -> DataFrame:
    """Flat JSON objects, every field read as text.

    ``multi_line`` reads a file as one array of objects, as web pages of results
    are saved; without it a file holds one object per line and can be split.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in texts])
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_result_csv(df: DataFrame, path: str, columns: Sequence[str], digits: int = 3) -> None:
    """Small result table as one CSV file: fixed column order, rounded numbers."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    cols = [F.bround(c, digits).alias(c) if c in doubles else F.col(c) for c in columns]
    df.select(*cols).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


MANIFEST = "file_key string, file_path string, version string, batch string"
FILES_IN_BATCH = 5_000


def list_files(spark: SparkSession, inputs: Sequence[str]) -> DataFrame:
    """(file_key, file_path, version, read_path) of the files below the inputs; contents are not read.

    The version is length and modification time, so a file that was written anew has another.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(inputs))
    path = F.col("_metadata.file_path")
    return found.select(
        F.concat(F.lit("f"), F.sha2(path, 256)).alias("file_key"),
        path.alias("file_path"),
        F.concat_ws("-", "length", F.unix_micros("modificationTime")).alias("version"),
        F.col("path").alias("read_path"),
    )


def _stored(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A table of the store; empty if it was never written. Any other fault is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def cached_counts(
    spark: SparkSession, inputs: Sequence[str], cache: str, keys: Sequence[str], transform=lambda df: df
) -> DataFrame:
    """Counts per key over many input files, each version of a file aggregated only once.

    The store holds the partial counts, one folder per input file, and a manifest of the
    file versions that are in it, also of those that left no row. A run lists the
    inputs, takes what the manifest lacks (an anti-join, no list of what is known passes
    through the driver) and reads those files only, ``FILES_IN_BATCH`` at a time. A
    file's folder is overwritten, and the manifest grows after the partials are written: a
    run that died in between is repeated without counting twice. The result re-sums the
    partials of the listed files in their present version, so that rows of one day found
    in several files add up, and a changed file counts as it is now.
    """
    keys = list(keys)
    listed = list_files(spark, inputs)
    manifest = f"{cache}/manifest"
    fresh = stable(listed.join(_stored(spark, manifest, MANIFEST), ["file_key", "version"], "left_anti"), "fresh_files")
    batches = math.ceil(fresh.count() / FILES_IN_BATCH)
    run = uuid.uuid4().hex

    def partials(paths: Sequence[str]) -> DataFrame:
        path = F.col("_metadata.file_path")
        raw = spark.read.option("recursiveFileLookup", True).parquet(*paths)
        rows = transform(raw.withColumn("source", path))
        return rows.groupBy(F.col("source").alias("file_path"), *keys).agg(F.count(F.lit(1)).alias("n"))

    for i in range(batches):
        mine = fresh.filter(F.pmod(F.xxhash64("file_key"), F.lit(batches)) == i)
        paths = [r["read_path"] for r in mine.select("read_path").collect()]  # about FILES_IN_BATCH
        if not paths:
            continue
        counted = partials(paths).join(F.broadcast(mine.select("file_path", "file_key", "version")), "file_path").drop("file_path")
        writer = counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("file_key").parquet(f"{cache}/partials")
        mine.select("file_key", "file_path", "version", F.lit(f"{run}-{i}").alias("batch")).write.mode("append").parquet(manifest)

    shape = T.StructType([*partials(inputs).drop("file_path").schema, T.StructField("version", T.StringType()), T.StructField("file_key", T.StringType())])
    held = _stored(spark, f"{cache}/partials", shape)
    present = listed.select("file_key", "version")
    return held.join(present, ["file_key", "version"], "left_semi").groupBy(*keys).agg(F.sum("n").alias("n"))
