"""Journal tiers and the relevance gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.columns import strip
from inkwell.functions.vocab import PILOT_DEFAULT_TIER, PILOT_TIERS


def pilot_tier(journal: str | Column) -> Column:
    """Tier of a journal name, blanks around it ignored; the default for any other and for null."""
    j = strip(F.col(journal) if isinstance(journal, str) else journal)
    found = F.lit(PILOT_DEFAULT_TIER)
    for tier, names in PILOT_TIERS.items():
        if tier != PILOT_DEFAULT_TIER:
            found = F.when(j.isin(names), tier).otherwise(found)
    return found


def with_tier(df: DataFrame, dim: DataFrame, journal: str = "journal", default: str = "UNKNOWN") -> DataFrame:
    """Adds ``tier`` by exact journal name; whether ``dim`` is broadcast is decided by its size."""
    names = dim.select(F.col("journal").alias("__j"), F.col("tier").alias("__t"))
    return df.join(names, df[journal] == F.col("__j"), "left").withColumn("tier", F.coalesce("__t", F.lit(default))).drop("__j", "__t")


def with_mark(df: DataFrame, ids: DataFrame, key: str, mark: str = "keyword_relevant") -> DataFrame:
    """Adds a flag: is the key among ``ids``? Null and empty keys are not."""
    known = ids.select(F.col(key).alias("__k")).where("__k <> ''").distinct()
    return df.join(known, df[key] == F.col("__k"), "left").withColumn(mark, F.col("__k").isNotNull()).drop("__k")


def gate(tier: str | Column = "tier", relevant: str | Column = "keyword_relevant") -> Column:
    """Tiers 1 and 2 always; tier 3 if relevant; any other never."""
    t = F.col(tier) if isinstance(tier, str) else tier
    r = F.col(relevant) if isinstance(relevant, str) else relevant
    return F.coalesce(t.isin(1, 2) | ((t == 3) & r), F.lit(False))
