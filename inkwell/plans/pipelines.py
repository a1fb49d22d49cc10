"""Whole runs, composed of operators: build a corpus, chunk it, embed it, count it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.columns import first_truthy, labelled_payload, metadata_payload, norm_pmcid, scalar, strip, year_full, year_pilot
from inkwell.functions.tokens import with_token_count
from inkwell.functions.xmltext import read_xml
from inkwell.functions.vocab import CHAINS
from inkwell.operators import articles, chunking, embed, relevance, stats
from inkwell.runtime import written

KEYWORDS_OF = {"v1": "v1", "v2": "kw1", "v2-issn": "kw2", "v2-backfill": "kw1"}


def build_corpus(results: DataFrame, xml: DataFrame, *, variant: str = "v2", lite: DataFrame | None = None, lite_order: str | None = None, existing: DataFrame | None = None, order: str = "id", root: str = "corpus", issns: DataFrame | None = None) -> DataFrame:
    """Search results and landed XML (unique pmcid, xml) to metadata records with ``clean_text``.

    v1 fills journals from ``lite`` and the XML; v2-issn keeps results of the journals that ``issns``
    (journal, issns) gives an ISSN; v2-backfill leaves out what ``existing`` holds. Text is cleaned only for
    open-access articles. Results may repeat an id or lack it: each keeps its own row and text.
    """
    terms = KEYWORDS_OF[variant]
    own = articles.lite_backfill(results, lite, lite_order) if variant == "v1" and lite is not None else results
    if variant == "v2-issn":
        if issns is None:
            raise ValueError("v2-issn needs issns")
        listed = articles.issns_of(issns).select(F.col("journal").alias("__listed")).distinct()
        own = own.join(listed, F.col("journalTitle") == F.col("__listed"), "left_semi")
    if variant == "v2-backfill":
        if existing is None:
            raise ValueError("v2-backfill needs the existing corpus")
        own = articles.backfill(own, existing, order).drop("key")
    gate = articles.open_access("isOpenAccess", "pmcid", "v1" if variant == "v1" else "v2")
    texts = xml.select("pmcid", F.col("xml").alias("__xml"))
    own = own.join(texts, "pmcid", "left").withColumn("__xml", F.when(gate, F.col("__xml")))
    own = own.withColumn("__read", read_xml(F.col("__xml"), "v1" if variant == "v1" else "v2")).drop("__xml")
    own = own.withColumns({"clean_text": F.col("__read.clean_text"), "__journal": F.col("__read.journal")}).drop("__read")
    if variant != "v1":
        return articles.pass_through(own.drop("__journal"), F.col("clean_text"), root=root, terms=terms)
    own = own.withColumn("journalTitle", first_truthy("journalTitle", "__journal"))
    return articles.to_metadata(articles.to_articles(own, keep=("clean_text",)), F.col("clean_text"), root=root, terms=terms)


def chunk_pilot(docs: DataFrame, meta: DataFrame, keyword_ids: DataFrame, *, year: int, target: int = 650, overlap: int = 150, mode: str = "paragraph") -> DataFrame:
    """One year: full texts (pmcid, year, text) through the gate, then metadata of articles without a file.

    Every file counts as present, gated out or not. ``meta``: unique pmcid, year, title, journal, abstract, keywords."""
    files = docs.where(F.col("year") == year)
    known = files.select("pmcid", "year", "text").join(meta.select("pmcid", "title", "journal"), "pmcid", "left")

    def gated(df: DataFrame) -> DataFrame:
        marked = relevance.with_mark(df, keyword_ids, "pmcid").withColumn("journal_tier", relevance.pilot_tier("journal"))
        return marked.where(relevance.gate("journal_tier"))

    whole = chunking.pilot_chunks(gated(known), "text", "fulltext", target=target, overlap=overlap, mode=mode)
    absent = gated(meta.where(F.col("year") == year).join(files.select("pmcid"), "pmcid", "left_anti"))
    absent = absent.withColumn("payload", labelled_payload("title", "journal", "year", "abstract", "keywords"))
    return whole.unionByName(chunking.pilot_chunks(absent, "payload", "metadata_only", target=target, overlap=overlap, mode=mode))


def chunk_full(docs: DataFrame, meta: DataFrame, *, target: int = 650, overlap: int = 120, dedupe_unknown: bool = False, payload: Column | None = None, first_year: int | None = None, last_year: int | None = None, most_years: int | None = None, most_files: int | None = None, finished: DataFrame | None = None) -> DataFrame:
    """All years that have documents, then metadata without text, then metadata of unknown year.

    ``meta``: unique pmcid, year, title, journal, abstract, keywords. An article counts as present only if
    it gave chunks in its year. Unknown years are not checked against full texts unless ``dedupe_unknown``.

    A run may be cut to the years from ``first_year`` to ``last_year``, the first ``most_years`` of these,
    ``most_files`` documents a year in order of pmcid, and years that are not in ``finished`` (year)."""
    if first_year is not None:
        docs = docs.where(F.col("year") >= first_year)
    if last_year is not None:
        docs = docs.where(F.col("year") <= last_year)
    if most_years is not None:
        docs = articles.first_years(docs, "year", most_years)
    if finished is not None:
        docs = docs.join(finished.select("year"), "year", "left_anti")
    if most_files is not None:
        docs = articles.first_per_key(docs, "year", "pmcid", "text", number=most_files)
    pay = metadata_payload("title", "abstract", "keywords") if payload is None else payload
    whole = chunking.fulltext_chunks(docs, meta, target=target, overlap=overlap)
    present = docs.where(strip(F.coalesce("text", F.lit(""))) != "").select("year", "pmcid").distinct()
    spine = docs.select("year").where("year is not null").distinct()
    missing = meta.join(spine, "year", "left_semi").join(present, ["year", "pmcid"], "left_anti")
    unknown = meta.where("year is null")
    if dedupe_unknown:
        unknown = unknown.join(present.select("pmcid").distinct(), "pmcid", "left_anti")
    unknown = unknown.join(spine.limit(1).select(F.lit(1).alias("__any")), how="left_semi", on=F.lit(True))
    rest = chunking.metadata_chunks(missing.unionByName(unknown), pay, target=target, overlap=overlap)
    return whole.unionByName(rest)


def metadata_index(records: DataFrame, *order: Column | str) -> DataFrame:
    """One record per normalized PMCID, the last one, with the id as a fallback key."""
    keyed = records.withColumn("pmcid", norm_pmcid(first_truthy("pmcid", "id")))
    return articles.last_per_key(keyed, "pmcid", *order)


def aliased(lines: DataFrame, variant: str, record: str = "record") -> DataFrame:
    """Adds pmcid, title, journal, abstract and year of a variant ``record``, by the alias chains of ``variant``.

    Of each chain, the first value that is not falsy counts; objects and lists are no values here. The year is
    the first whole number (pilot) or the first run (19|20)dd (full) in the chain.
    """
    chains = CHAINS[variant]
    v = F.col(record)
    year = year_pilot if variant == "pilot" else year_full
    own = {name: first_truthy(*[scalar(v, n) for n in names]) for name, names in chains.items() if name != "year"}
    return lines.withColumns(own | {"pmcid": norm_pmcid(own["pmcid"]), "year": year(*[scalar(v, n) for n in chains["year"]])})


def chunk_statistics(chunks: DataFrame, tokens_of: Callable[[DataFrame], DataFrame] | None = None, limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Statistics by year and source type, and the global row. The chunks are evaluated once, to a written table of sums."""
    counted = tokens_of(chunks) if tokens_of else with_token_count(chunks, "text")
    by_year = written( stats.chunk_stats(counted, ["year", "source_type"], limit=limit), "sums")
    return by_year, stats.global_stats(by_year)


def embed_corpus(chunks: DataFrame, embedded: DataFrame | None, make: Callable[[], embed.Provider], model: str) -> DataFrame:
    todo = chunks if embedded is None else articles.not_embedded(chunks, embedded)
    return embed.embed_chunks(todo, make, model)
