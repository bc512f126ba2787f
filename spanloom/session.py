"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is sent to every executor only if it has at most so many rows and so many bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64_000_000

_written: list[str] = []


def build_session(app: str = "spanloom", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that tests and bench use; on a cluster the submitted settings hold."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPANLOOM_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a session on one machine may do without: it gets a temporary folder, deleted at exit."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that they all share")
        here = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, here, ignore_errors=True)
        where = "file://" + here
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    The result no longer depends on the stages before it, so a lost executor costs a read instead of a recomputation,
    and several consumers share one computation. Columns and types are kept. release() deletes what was written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete all tables that cut() has written in this process and give their number. Results that still read them must be done."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    n = 0
    while _written:
        path = hadoop.Path(_written.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most `rows` rows and about `size` bytes of values; reads no further than those rows."""
    parts = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("string", "binary"):
            parts.append(F.octet_length(c))
        elif kind in ("array", "struct", "map"):
            parts.append(F.octet_length(F.to_json(F.struct(c))))
    width = F.lit(8 * len(df.columns)).cast("bigint")
    for p in parts:
        width = width + F.coalesce(p, F.lit(0))
    r = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).head()
    return r["n"] <= rows and r["b"] <= size


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """df with the columns of a table that has exactly one row, such as a total, as scalar subqueries: no join at all."""
    return df.withColumns({c: one_row.select(c).scalar() for c in one_row.columns})
