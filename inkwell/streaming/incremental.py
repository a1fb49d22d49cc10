"""Runs that go on where the last one ended: manifests of finished years, anti-joins, available-now streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkwell.operators.articles import not_embedded
from inkwell.sources.jsonl import path_exists

MANIFEST = "year int, part string"
PARTS = ("fulltext", "metadata_only", "stats")


def finished_years(spark: SparkSession, manifest: str, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """Years of which every part is marked as done."""
    if not path_exists(spark, manifest):
        return spark.createDataFrame([], "year int")
    rows = spark.read.schema(MANIFEST).parquet(manifest).where(F.col("part").isin(*parts))
    return rows.groupBy("year").agg(F.count_distinct("part").alias("n")).where(F.col("n") == len(parts)).select("year")


def open_years(rows: DataFrame, manifest: str, year: str = "year") -> DataFrame:
    """Rows of years that are not finished; rows without a year stay."""
    return rows.join(finished_years(rows.sparkSession, manifest).withColumnRenamed("year", year), year, "left_anti")


def mark_done(years: DataFrame, manifest: str, part: str) -> None:
    years.select(F.col("year").cast("int"), F.lit(part).alias("part")).distinct().write.mode("append").parquet(manifest)


def resume_embedding(chunks: DataFrame, target: str, embed: Callable[[DataFrame], DataFrame], key: str = "chunk_id") -> None:
    """Embed what has no vector at ``target`` yet, and append it."""
    spark = chunks.sparkSession
    todo = not_embedded(chunks, spark.read.parquet(target), key) if path_exists(spark, target) else chunks
    embed(todo).write.mode("append").parquet(target)


def stream_new_files(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], format: str = "json") -> None:
    """Process the files that came since the last run, once each, and stop. A second run without new files adds nothing."""
    new = spark.readStream.schema(schema).format(format).load(source)
    query = transform(new).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_new_keys(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, key: str, format: str = "json") -> None:
    """As ``stream_new_files``, appending only the first row of each key that ``target`` does not hold."""

    def append(batch: DataFrame, _: int) -> None:
        fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        if path_exists(batch.sparkSession, target):
            fresh = fresh.join(batch.sparkSession.read.parquet(target).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(target)

    query = spark.readStream.schema(schema).format(format).load(source).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
