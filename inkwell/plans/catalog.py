"""The queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.columns import mentions, words
from inkwell.functions.vocab import KEYWORDS_1
from inkwell.operators import chunking, relevance
from inkwell.plans import queries as q
from inkwell.plans import roundtrips
from inkwell.plans.oracles import SQL as OWN
from inkwell.plans.oracles_roundtrips import MORE
from inkwell.runtime import read

QUERIES = {name: f for name, f in {**vars(q), **vars(roundtrips)}.items() if name.startswith(("q_", "p4_"))}


SQL = OWN | MORE


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, gated by tier and keywords, to chunks with a bridge, counted by tier."""
    docs = relevance.with_tier(read(spark, folder, "documents").withColumnRenamed("source", "journal"), read(spark, folder, "journal_dim"), default="tier3")
    gated = docs.where(relevance.gate(F.substring("tier", 5, 1).cast("int"), mentions(KEYWORDS_1, "text")))
    chunks = gated.select("tier", "doc_id", F.explode(chunking.bridged_paragraphs("text", 650, 120)).alias("chunk"))
    return chunks.groupBy("tier").agg(F.count_distinct("doc_id").alias("articles"), F.count(F.lit(1)).alias("chunks"), F.sum(F.size(words("chunk"))).alias("words"))


__all__ = ["QUERIES", "SQL", "flagship"]
