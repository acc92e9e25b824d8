"""Session helper, reliable intermediate tables and size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A hinted side is a written table of at most this many bytes, or a table of at
# most this many rows by construction (calendar days, zones of a lookup, ...).
# Larger or unknown sides are left to the optimizer, which checks their size.
BROADCAST_BYTES = 16 << 20
BROADCAST_ROWS = 100_000
_LOCAL_FOLDERS: dict[str, str] = {}


def local_session(cores: int | str = 8, app: str = "daygrid") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a local-mode session without the setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="daygrid-")
    return _LOCAL_FOLDERS[app]


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stable(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage so that a lost executor never re-runs the raw scan, lets
    several consumers share one computation and gives the optimizer the real
    size, so that joins against it are broadcast only when it is small.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def planned_bytes(df: DataFrame) -> int:
    """Size that the optimizer gives ``df``; for a written table read back, the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def checked_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a written table, given only after its bytes were measured.

    A table over the limit is sent to a sort-merge join instead, which also keeps
    the optimizer from broadcasting the other side on a wrong estimate.
    """
    return F.broadcast(df) if planned_bytes(df) <= most else df.hint("merge")


def bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint for a side whose row count is bounded by construction."""
    return F.broadcast(df) if max_rows <= BROADCAST_ROWS else df
