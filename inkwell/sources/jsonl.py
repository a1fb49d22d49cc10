"""JSON Lines in four tolerances, with a stable order of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def raw_lines(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """(value, file, block, line): every line as it is; (file, block, line) orders them as written.

    A missing path gives no lines if ``missing_ok``, else an error."""
    if missing_ok and not path_exists(spark, path):
        return spark.createDataFrame([], "value string, file string, block long, line long")
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def as_object(value: Column) -> Column:
    """The variant of a line that is a JSON object, out of its wrapper; null for any other line."""
    v = F.try_parse_json(value)
    v = F.when(F.schema_of_variant(v).startswith("OBJECT"), v)
    inner = _only_inner(v)
    return F.coalesce(inner, v)


def _only_inner(v: Column) -> Column:
    as_map = F.try_variant_get(v, "$", "map<string,variant>")
    only = F.try_element_at(F.map_values(as_map), F.lit(1))
    return F.when((F.size(as_map) == 1) & F.schema_of_variant(only).startswith("OBJECT"), only)


def tolerant(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``record`` (variant); blank, malformed and non-object lines are dropped. The last of duplicate keys counts."""
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return lines.withColumn("record", as_object(F.col(value))).where("record is not null")


def verbatim(lines: DataFrame, keep: Column, value: str = "value") -> DataFrame:
    """Raw lines for which ``keep`` (over ``record``, null for malformed lines) does not say no."""
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return lines.withColumn("record", as_object(F.col(value))).where(F.coalesce(keep, F.lit(True))).drop("record")


def strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A malformed line ends the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def known_ids(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Ids already written at ``path``, malformed lines ignored; none if it is not there."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"{key} string")
    return spark.read.schema(f"{key} string").json(path).where(F.col(key).isNotNull()).distinct()


def field(name: str) -> Column:
    """A top-level field of ``record`` as text."""
    return F.try_variant_get("record", f"$.{name}", "string")
