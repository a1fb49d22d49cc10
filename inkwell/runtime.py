"""Session helpers: tables written to the shared folder, and size checks before a broadcast."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Where the setting is missing, a folder of this machine is made, which is only right for a
    local master; on a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="inkwell-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete what lies at ``path`` when the driver ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts the lineage: later stages read the files, so a lost executor costs no recomputation of
    what lies before. Being columnar, a later read touches only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/inkwell-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Drop the shuffle files and broadcasts of what is done, between the turns of a long run.

    The engine's cleaner acts on what the driver's garbage collectors find, which by themselves run seldom.
    """
    gc.collect()
    spark._jvm.System.gc()


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Collect a table that must not grow, failing if it holds more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} holds more than {most} rows; it is not a bounded table")
    return rows


#: Up to this many rows of one number each, a table may be sent to every executor.
MOST_SENT = 1_000_000


def is_small(df: DataFrame, most: int = MOST_SENT) -> bool:
    """Does the table hold at most ``most`` rows? Counted before a broadcast; no row reaches the driver."""
    return df.limit(most + 1).count() <= most


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")
