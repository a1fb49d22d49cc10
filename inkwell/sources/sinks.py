"""Sinks: JSON Lines by year, two sets from one scan, CSV, statistics, files on demand, tables for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.columns import shortened
from inkwell.runtime import written


def write_metadata(records: DataFrame, everything: str, matching: str, *, mode: str = "append", flag: str = "matches_keywords") -> None:
    """All records, and those that match the keywords, from one evaluation."""
    once = written(records, "metadata")
    once.write.mode(mode).json(everything)
    once.where(F.col(flag)).write.mode(mode).json(matching)


def write_by_year(rows: DataFrame, path: str, *, year: str = "year", order: list[str] | None = None, format: str = "json", overwrite_years: bool = True, files: int = 1) -> None:
    """A directory a year with up to ``files`` files; only the years in ``rows`` are replaced.

    Rows without a year go to the default directory. Rows are brought together by year, and a year that holds
    much of them is shared out over its files.
    """
    lot = F.pmod(F.xxhash64(*(order or [c for c in rows.columns if c != year])), F.lit(files))
    out = rows.repartition(F.col(year), lot)
    out = out.sortWithinPartitions(year, *order) if order else out
    writer = out.write.partitionBy(year).option("partitionOverwriteMode", "dynamic").mode("overwrite" if overwrite_years else "append")
    writer.format(format).save(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_stats(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)


def export_files(texts: DataFrame, write: object, *, path: str = "path", text: str = "text") -> None:
    """One file an article, on demand: ``write(path, text)`` is called on the executors."""
    texts.select(path, text).foreachPartition(lambda rows: [write(r[0], r[1]) for r in rows] and None)


def display_lines(rows: DataFrame, columns: dict[str, tuple[int, bool]]) -> DataFrame:
    """(line): fixed-width text; columns map a name to (width, right-aligned). Long names end in an ellipsis."""
    cells: list[Column] = []
    for name, (width, right) in columns.items():
        value = shortened(F.coalesce(F.col(name).cast("string"), F.lit("")), width)
        cells.append(F.lpad(value, width, " ") if right else F.rpad(value, width, " "))
    return rows.select(F.concat_ws(" ", *cells).alias("line"))
