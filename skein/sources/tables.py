"""Reading the project's tables, and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, which is set here only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local["):
            base = tempfile.mkdtemp(prefix="skein-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        else:
            base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def checkpoint(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read again: cuts the lineage, survives the loss of executors, and is worked out
    once (a reliable checkpoint of an RDD works out its last stage twice)."""
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df, "step"))


#: Rows of a few narrow columns that are broadcast at most.
BROADCAST_ROWS = 100_000


def hinted(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most ``most`` rows; these are counted, so df is best a checkpoint."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def write_shared(df: DataFrame, name: str) -> str:
    """Write df as Parquet into the shared folder and return the path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def read_shared(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def drop_shared(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that no later plan reads."""
    local = path.removeprefix("file://")
    if os.path.isdir(local):
        shutil.rmtree(local, ignore_errors=True)
    else:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def slash(col) -> F.Column:
    r"""A path with ``/`` in place of ``\``."""
    return F.replace(F.col(col) if isinstance(col, str) else col, F.lit("\\"), F.lit("/"))


def newest(df: DataFrame, key: str, at: str, cols: list[str]) -> DataFrame:
    """The newest row of each key: the greatest ``at``; ties go to the greatest values of ``cols`` in order.

    A null ``at`` is older than any other. Rows without a key are dropped. Only the
    columns named are read and shuffled; rows are combined before the shuffle.
    """
    rest = [F.col(c).alias(c) for c in cols]
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max(F.struct(F.col(at).alias("_at"), *rest)).alias("_m"))
        .select(key, F.col("_m._at").alias(at), *[F.col(f"_m.{c}").alias(c) for c in cols])
    )
