"""Whole-text files in <root>/<year>/<id>.txt directories, and tables instead of one file an article."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions.columns import norm_pmcid
from inkwell.sources.jsonl import path_exists


def fulltext_files(spark: SparkSession, root: str, *, missing_ok: bool = False, most_per_year: int | None = None) -> DataFrame:
    """(year, file_name, pmcid, text): '.txt' files, case ignored, below four-digit directories.

    With ``most_per_year``, the first files of each year by name. A missing root, or files that vanish
    while read, give no rows if ``missing_ok``, else an error.
    """
    schema = "year int, file_name string, pmcid string, text string"
    if missing_ok and not path_exists(spark, root):
        return spark.createDataFrame([], schema)
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][xX][tT]")
    path, name = F.col("_metadata.file_path"), F.col("_metadata.file_name")
    files = reader.option("ignoreMissingFiles", missing_ok).text(root, wholetext=True).select(F.nullif(F.regexp_extract(path, r"/(\d{4})/[^/]+$", 1), F.lit("")).cast("int").alias("year"), name.alias("file_name"), F.col("value").alias("text"))
    files = files.where("year is not null")
    if most_per_year is not None:
        w = Window.partitionBy("year").orderBy("file_name")
        files = files.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most_per_year).drop("rn")
    return files.select("year", "file_name", norm_pmcid("file_name").alias("pmcid"), "text")
