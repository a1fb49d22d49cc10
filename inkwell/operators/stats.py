"""Counts by year, journal and tier; chunk statistics and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.columns import col, guarded_percent
from inkwell.functions.vocab import KEYWORD_SETS

#: The tiers in the order of the reports; other names can be given.
TIER_ORDER = ("Tier 1", "Tier 2", "Tier 3", "UNKNOWN")


def years(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))


def coverage_by_year(df: DataFrame, year: Column, open_access: Column, flags: dict[str, Column], first: int = 1990, last: int = 2025) -> DataFrame:
    """(year, category, total, oa, oa_ratio) for category 'all' and each flag, 0 for years without rows. One scan."""
    names = ["all", *flags]
    sums = [F.count_if(flag).alias(f"{name}_total") for name, flag in zip(names, [F.lit(True), *flags.values()])]
    sums += [F.count_if(flag & open_access).alias(f"{name}_oa") for name, flag in zip(names, [F.lit(True), *flags.values()])]
    counted = df.groupBy(year.alias("year")).agg(*sums)
    long = years(df.sparkSession, first, last).join(counted, "year", "left").select("year", F.explode(F.array(*[F.struct(F.lit(n).alias("category"), F.coalesce(f"{n}_total", F.lit(0)).alias("total"), F.coalesce(f"{n}_oa", F.lit(0)).alias("oa")) for n in names])).alias("c"))
    return long.select("year", "c.*").withColumn("oa_ratio", F.when(F.col("total") > 0, F.col("oa") / F.col("total")).otherwise(F.lit(0.0)))


def coverage_by_journal(df: DataFrame, dim: DataFrame, flags: dict[str, Column], where: Column | None = None) -> DataFrame:
    """For each journal of ``dim``: n_all, n_<flag> and pct_<flag> of all; 0 for journals without rows."""
    own = df if where is None else df.where(where)
    counted = own.groupBy("journal").agg(F.count(F.lit(1)).alias("n_all"), *[F.count_if(f).alias(f"n_{n}") for n, f in flags.items()])
    out = dim.select("journal").join(counted, "journal", "left").fillna(0)
    return out.withColumns({f"pct_{n}": guarded_percent(f"n_{n}", "n_all", 1) for n in flags})


def oa_by_journal(df: DataFrame, dim: DataFrame, open_access: Column) -> DataFrame:
    """(tier, journal, issns, total, oa, oa_percent) for each journal of ``dim``."""
    counted = df.groupBy("journal").agg(F.count(F.lit(1)).alias("total"), F.count_if(open_access).alias("oa"))
    out = dim.join(counted, "journal", "left").fillna(0, ["total", "oa"])
    return out.select(F.coalesce("tier", F.lit("UNKNOWN")).alias("tier"), "journal", F.array_join("issns", ";").alias("issns"), "total", "oa", guarded_percent("oa", "total").alias("oa_percent"))


def ranked(by_journal: DataFrame, tiers: tuple[str, ...] = TIER_ORDER) -> DataFrame:
    """Tier order, then share, open-access count and total descending; journal name breaks ties."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, tiers[:3])), F.col("tier")), F.lit(0)), F.lit(9))
    return by_journal.orderBy(rank, F.desc("oa_percent"), F.desc("oa"), F.desc("total"), "journal")


def tier_rollup(by_journal: DataFrame, tiers: tuple[str, ...] = TIER_ORDER) -> DataFrame:
    """A row for each tier in fixed order, zero rows included, and 'ALL'; shares from the sums."""
    spark = by_journal.sparkSession
    spine = spark.createDataFrame([(t, i) for i, t in enumerate([*tiers, "ALL"])], "tier string, place int")
    sums = by_journal.rollup("tier").agg(F.sum("total").alias("total"), F.sum("oa").alias("oa"), F.grouping("tier").alias("g"))
    sums = sums.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("tier")).alias("tier"), "total", "oa")
    out = spine.join(sums, "tier", "left").fillna(0, ["total", "oa"])
    return out.select("tier", "place", "total", "oa", guarded_percent("oa", "total").alias("oa_percent")).orderBy("place")


def chunk_stats(chunks: DataFrame, keys: list[str], *, document: str = "pmcid", tokens: str = "tokens", limit: int = 1000) -> DataFrame:
    """Articles, chunks, tokens, chunks over the soft limit and the truncated mean, by ``keys``."""
    return chunks.groupBy(*keys).agg(
        F.countDistinct(document).alias("articles"), F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens_total"),
        F.count_if(col(tokens) > limit).alias("chunks_over_limit"), F.floor(F.coalesce(F.sum(tokens), F.lit(0)) / F.count(F.lit(1))).alias("avg_tokens"),
    )


def global_stats(by_year: DataFrame) -> DataFrame:
    """One row from per-year, per-source rows: sums over known years, means from the sums, unknown years apart."""
    known = F.col("year").isNotNull()
    pick = lambda kind, c: F.coalesce(F.sum(F.when(known & (F.col("source_type") == kind), F.col(c))), F.lit(0))
    kinds = {"fulltext": "fulltext", "meta_only": "metadata_only"}
    cols = [F.count_distinct("year").alias("years_processed")]
    for name, kind in kinds.items():
        cols += [pick(kind, "articles").alias(f"articles_{name}"), pick(kind, "chunks").alias(f"chunks_{name}"), pick(kind, "tokens_total").alias(f"tokens_{name}_total"), pick(kind, "chunks_over_limit").alias(f"chunks_{name}_over_soft_limit")]
        cols.append(F.when(pick(kind, "chunks") > 0, F.floor(pick(kind, "tokens_total") / pick(kind, "chunks"))).otherwise(F.lit(0)).alias(f"avg_tokens_per_chunk_{name}"))
    lost = lambda c: F.coalesce(F.sum(F.when(~known, F.col(c))), F.lit(0))
    cols += [lost(c).alias(f"unknown_year_{n}") for n, c in (("articles", "articles"), ("chunks", "chunks"), ("tokens_total", "tokens_total"), ("chunks_over_soft_limit", "chunks_over_limit"))]
    return by_year.agg(*cols)


def pilot_totals(chunks: DataFrame) -> DataFrame:
    """One row: articles that gave chunks from a full text, from metadata only, and all chunks."""
    of = lambda kind: F.count_distinct(F.when(F.col("source_type") == kind, F.col("pmcid")))
    return chunks.agg(of("fulltext").alias("fulltext_articles"), of("metadata_only").alias("metadata_only_articles"), F.count(F.lit(1)).alias("chunks"))


def run_counters(records: DataFrame, *, full_text: str = "has_full_text", keywords: Column | None = None, open_access: str = "is_open_access") -> DataFrame:
    """One row: processed, with full text, keyword matches, eligible, and how eligible ones ended."""
    kw = F.col("matches_keywords") if keywords is None else keywords
    has, oa = F.coalesce(F.col(full_text), F.lit(False)), F.coalesce(F.col(open_access), F.lit(False))
    return records.agg(F.count(F.lit(1)).alias("processed"), F.count_if(has).alias("with_full_text"), F.count_if(kw).alias("keyword_matches"), F.count_if(oa).alias("oa_eligible"), F.count_if(oa & has).alias("oa_success"), F.count_if(oa & ~has).alias("oa_fail"))


def keyword_flags(*texts: Column | str) -> dict[str, Column]:
    from inkwell.functions.columns import mentions

    return {name: mentions(KEYWORD_SETS[name], *texts) for name in ("kw1", "kw2")}
