"""One function (spark, folder) -> DataFrame for each query of the core. All run over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import columns as c
from inkwell.functions.tokens import with_token_count
from inkwell.functions.vocab import KEYWORD_SETS
from inkwell.operators import articles, chunking, embed, relevance, schema_drift, stats
from inkwell.plans import pipelines
from inkwell.runtime import delete_at_end, read, shared_folder
from inkwell.sources import jsonl, sinks
from inkwell.streaming.incremental import stream_new_files

TIERS = ("tier1", "tier2", "tier3", "UNKNOWN")


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "metadata_all")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents")


def results(spark: SparkSession, folder: str) -> DataFrame:
    """The metadata table under the names that search results have."""
    yes = lambda flag: F.when(F.col(flag), "Y").otherwise("N")
    return metadata(spark, folder).select("rec_no", "id", "source", "pmid", "pmcid", "doi", "title", F.col("abstract").alias("abstractText"), F.col("journal").alias("journalTitle"), F.col("pub_year").alias("pubYear"), F.col("author_string").alias("authorString"), yes("is_open_access").alias("isOpenAccess"), F.col("pub_type").alias("pubType"), yes("is_preprint").alias("isPreprint"))


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The last record of each normalized PMCID."""
    return pipelines.metadata_index(metadata(spark, folder), "rec_no").withColumn("year", c.year_full("pub_year"))


def q_article_projection(spark: SparkSession, folder: str) -> DataFrame:
    return articles.to_articles(results(spark, folder), "https://lit.example")


def q_metadata_record(spark: SparkSession, folder: str) -> DataFrame:
    return articles.to_metadata(articles.to_articles(results(spark, folder)), F.col("abstract")).select("id", "has_full_text", "xml_path", "text_path", "matches_keywords")


def q_norm_pmcid(spark: SparkSession, folder: str) -> DataFrame:
    return metadata(spark, folder).select("rec_no", c.norm_pmcid("pmcid").alias("pmcid"))


def q_base_ids(spark: SparkSession, folder: str) -> DataFrame:
    return metadata(spark, folder).select("rec_no", c.base_id_v1("pmcid", "pmid", "id").alias("v1"), c.base_id_v2("pmcid", "id", "doi", "title").alias("v2"), c.tagged_key("pmcid", "pmid", "id").alias("tagged"))


def q_output_path(spark: SparkSession, folder: str) -> DataFrame:
    return metadata(spark, folder).select("rec_no", c.output_path("corpus", c.year_full("pub_year"), c.base_id_v2("pmcid", "id", "doi", "title")).alias("path"))


def q_normalize_v1(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", F.md5(c.normalize("text", "v1").cast("binary")).alias("digest"))


def q_normalize_v2(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", F.md5(c.normalize("text", "v2").cast("binary")).alias("digest"))


def q_year_parse(spark: SparkSession, folder: str) -> DataFrame:
    return metadata(spark, folder).select("rec_no", c.year_pilot("pub_year").alias("pilot"), c.year_full("pub_year").alias("full"))


def q_keyword_flag(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", *[c.mentions(t, "text").alias(n) for n, t in KEYWORD_SETS.items()])


def q_html_sniff(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", c.looks_like_html("text").alias("plain"), c.looks_like_html(F.concat(F.lit(" \n<!DOCTYPE HTML>"), F.coalesce("text", F.lit("")))).alias("page"))


def q_section_titles(spark: SparkSession, folder: str) -> DataFrame:
    """The first line of each text taken as a section title."""
    line = F.coalesce(F.element_at(F.split("text", "\n"), 1), F.lit(""))
    return documents(spark, folder).select("doc_id", c.skipped_section(line, "v1").alias("v1"), c.skipped_section(line, "v2").alias("v2"))


def q_tier_lookup_default(spark: SparkSession, folder: str) -> DataFrame:
    both = relevance.with_tier(metadata(spark, folder), read(spark, folder, "journal_dim"))
    return both.select("rec_no", "tier", relevance.pilot_tier("journal").alias("pilot_tier"))


def q_relevance_gate(spark: SparkSession, folder: str) -> DataFrame:
    meta = metadata(spark, folder)
    ids = meta.where(c.mentions(KEYWORD_SETS["kw1"], "title", "abstract")).select("pmcid")
    both = relevance.with_tier(relevance.with_mark(meta, ids, "pmcid"), read(spark, folder, "journal_dim"), default="tier3")
    tier = F.substring("tier", 5, 1).cast("int")
    return both.select("rec_no", tier.alias("tier"), "keyword_relevant", relevance.gate(tier).alias("kept"))


def q_lite_backfill(spark: SparkSession, folder: str) -> DataFrame:
    core = results(spark, folder)
    blanked = core.withColumn("journalTitle", F.when(F.col("source") == "PPR", "").otherwise(F.col("journalTitle"))).withColumn("pubType", F.when(F.col("isOpenAccess") == "Y", F.col("pubType")))
    return articles.lite_backfill(blanked, core, "rec_no").select("rec_no", "journalTitle", "pubType")


def q_last_wins_index(spark: SparkSession, folder: str) -> DataFrame:
    return index(spark, folder).select("pmcid", "rec_no", "title")


def q_meta_missing_pilot(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata without any document, an empty one included."""
    return index(spark, folder).join(documents(spark, folder).select("pmcid"), "pmcid", "left_anti").select("pmcid", "rec_no")


def q_meta_missing_full(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata without a document of its year that gives chunks."""
    present = documents(spark, folder).where(c.strip(F.coalesce("text", F.lit(""))) != "").select("pmcid", F.col("pub_year").alias("year"))
    return index(spark, folder).join(present, ["pmcid", "year"], "left_anti").select("pmcid", "rec_no")


def q_backfill_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    meta = metadata(spark, folder)
    old, new = meta.where("batch_no <= 2"), meta.where("batch_no > 2")
    return articles.backfill(new, old, "rec_no").select("rec_no", "key")


def q_embedding_resume(spark: SparkSession, folder: str) -> DataFrame:
    chunks = read(spark, folder, "embedded_chunk")
    return articles.not_embedded(chunks, chunks.where("embedding is not null and embedding_model = 'lit-embed-64'")).select("chunk_id", "embedding_model")


def q_first_n_per_year(spark: SparkSession, folder: str) -> DataFrame:
    return articles.first_per_key(documents(spark, folder), "pub_year", "added_at", "doc_id", number=5).select("pub_year", "doc_id")


def q_first_years(spark: SparkSession, folder: str) -> DataFrame:
    later = documents(spark, folder).where("pub_year >= 2000")
    return articles.first_years(later, "pub_year", 3).groupBy("pub_year").agg(F.count(F.lit(1)).alias("documents"))


def q_drop_year(spark: SparkSession, folder: str) -> DataFrame:
    return articles.without_year(metadata(spark, folder), "pub_year", "2020").select("rec_no", "pub_year")


def q_drop_year_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Raw lines but those of 2020; malformed ones stay as they are."""
    lines = read(spark, folder, "metadata_raw").select("line_id", "raw")
    kept = jsonl.verbatim(lines, ~jsonl.field("pub_year").eqNullSafe(F.lit("2020")), "raw")
    return kept.select("line_id", F.md5(F.coalesce("raw", F.lit("")).cast("binary")).alias("digest"))


def q_drop_year_counts(spark: SparkSession, folder: str) -> DataFrame:
    dropped = F.col("pub_year").eqNullSafe(F.lit("2020"))
    return metadata(spark, folder).agg(F.count_if(~dropped).alias("kept"), F.count_if(dropped).alias("removed"))


def q_word_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder).select("doc_id", F.posexplode(chunking.word_windows("text", 100, 20)).alias("i", "chunk"))
    return rows.select("doc_id", (F.col("i") + 1).alias("chunk_index"), F.md5(F.col("chunk").cast("binary")).alias("digest"), c.word_count("chunk").alias("words"))


def _paragraphs(spark: SparkSession, folder: str, variant: str) -> DataFrame:
    rows = documents(spark, folder).select("doc_id", F.posexplode(chunking.paragraphs("text", variant)).alias("i", "p"))
    return rows.select("doc_id", F.col("i").alias("paragraph"), F.md5(F.col("p").cast("binary")).alias("digest"))


def q_paragraphs_pilot(spark: SparkSession, folder: str) -> DataFrame:
    return _paragraphs(spark, folder, "pilot")


def q_paragraphs_full(spark: SparkSession, folder: str) -> DataFrame:
    return _paragraphs(spark, folder, "full")


def _chunked(spark: SparkSession, folder: str, chunks) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", F.col("pub_year").alias("year"), "pmcid", "text")
    rows = chunking.exploded(docs, chunks, ["doc_id"])
    return rows.select("doc_id", "chunk_id", "chunk_index", F.md5(F.col("text").cast("binary")).alias("digest"))


def q_chunks_pilot(spark: SparkSession, folder: str) -> DataFrame:
    return _chunked(spark, folder, chunking.grouped_paragraphs("text", 100))


def q_chunks_bridge(spark: SparkSession, folder: str) -> DataFrame:
    return _chunked(spark, folder, chunking.bridged_paragraphs("text", 100, 20))


def q_metadata_payload(spark: SparkSession, folder: str) -> DataFrame:
    plain = c.metadata_payload("title", "abstract", F.col("pub_type"))
    labelled = c.labelled_payload("title", "journal", c.year_pilot("pub_year"), "abstract", F.col("pub_type"))
    return metadata(spark, folder).select("rec_no", F.md5(plain.cast("binary")).alias("plain"), F.md5(labelled.cast("binary")).alias("labelled"))


def _combined(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).where("pmcid is not null").select("pmcid", F.col("pub_year").alias("year"), "text")
    meta = index(spark, folder).select("pmcid", "year", "title", "journal", "abstract", F.col("pub_type").alias("keywords"))
    return pipelines.chunk_full(docs, meta, target=200, overlap=40)


def q_combined_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _combined(spark, folder).groupBy("year", "source_type").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("pmcid").alias("articles"), F.count("title").alias("titled"))


def q_chunk_stats_year(spark: SparkSession, folder: str) -> DataFrame:
    return pipelines.chunk_statistics(_combined(spark, folder), limit=190)[0]


def q_chunk_stats_global(spark: SparkSession, folder: str) -> DataFrame:
    return pipelines.chunk_statistics(_combined(spark, folder), limit=190)[1]


def q_counts_year_category(spark: SparkSession, folder: str) -> DataFrame:
    return stats.coverage_by_year(metadata(spark, folder), c.year_full("pub_year"), F.coalesce("is_open_access", F.lit(False)), stats.keyword_flags("title", "abstract"))


def q_counts_journal_kw(spark: SparkSession, folder: str) -> DataFrame:
    return stats.coverage_by_journal(metadata(spark, folder), read(spark, folder, "journal_dim"), stats.keyword_flags("title", "abstract"), F.col("is_open_access"))


def _oa(spark: SparkSession, folder: str) -> DataFrame:
    return stats.oa_by_journal(metadata(spark, folder), read(spark, folder, "journal_dim"), F.coalesce("is_open_access", F.lit(False)))


def q_oa_share_by_journal(spark: SparkSession, folder: str) -> DataFrame:
    return stats.ranked(_oa(spark, folder), TIERS)


def q_tier_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return stats.tier_rollup(_oa(spark, folder), TIERS)


def q_display_table(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.display_lines(_oa(spark, folder), {"tier": (7, False), "journal": (30, False), "total": (8, True), "oa": (8, True)})


def q_run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return stats.run_counters(metadata(spark, folder), keywords=articles.matches_keywords("title", "abstract"))


def q_issn_explode(spark: SparkSession, folder: str) -> DataFrame:
    return articles.issns_of(read(spark, folder, "journal_dim"))


def q_issn_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Records of journals with an ISSN that ends in X."""
    ids = articles.issns_of(read(spark, folder, "journal_dim")).where(F.col("issn").endswith("X"))
    return metadata(spark, folder).join(ids.select("journal").distinct(), "journal", "left_semi").select("rec_no")


def q_tolerant_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Object lines out of their wrappers: the PMCID by the alias chain."""
    lines = jsonl.tolerant(read(spark, folder, "metadata_raw").select("line_id", "raw"), "raw")
    chain = c.first_truthy(*[jsonl.field(n) for n in ("pmcid", "PMCID", "pmcid_upper", "pmcid_lower")])
    return lines.select("line_id", c.norm_pmcid(chain).alias("pmcid"), c.norm_pmcid(c.first_truthy(chain, jsonl.field("id"))).alias("with_id"))


def q_keywords_variant(spark: SparkSession, folder: str) -> DataFrame:
    lines = jsonl.tolerant(read(spark, folder, "metadata_raw").select("line_id", "raw"), "raw")
    both = F.coalesce(F.try_variant_get("record", "$.keywords", "variant"), F.try_variant_get("record", "$.keyword", "variant"))
    return lines.select("line_id", c.keywords_text(F.to_json(both)).alias("keywords"))


def q_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return with_token_count(documents(spark, folder).select("doc_id", "text"), "text").select("doc_id", "tokens", "tokenizer")


def q_embed_attach(spark: SparkSession, folder: str) -> DataFrame:
    chunks = read(spark, folder, "embedded_chunk").select("chunk_id", "text")
    return embed.embed_chunks(chunks, embed.hashed_provider, "hashed-16").select("chunk_id", "embedding_model", F.size("embedding").alias("width"))


def q_stream_available_now(spark: SparkSession, folder: str) -> DataFrame:
    """Events read as a stream of files, until no new file is left; equal to the batch result."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    delete_at_end(spark, root)
    events = read(spark, folder, "events")
    keep = lambda df: df.select("event_id", "user_id", "event_type", "value")
    stream_new_files(spark, f"{folder}/events.parquet*", events.schema, f"{root}/out", f"{root}/checkpoint", keep, "parquet")
    return spark.read.schema(keep(events).schema).parquet(f"{root}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"))


def q_event_props(spark: SparkSession, folder: str) -> DataFrame:
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return read(spark, folder, "events").select("event_id", v.alias("k"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    files = schema_drift.schemas(read(spark, folder, "metadata_raw"), "feed", "file_seq", "raw")
    return schema_drift.top_level(schema_drift.changes(files))


def p4_unified(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "metadata_raw")
    compiled = schema_drift.projections(schema_drift.schemas(lines, "feed", "file_seq", "raw"))
    return schema_drift.unified(lines, compiled, keep=["line_id", "feed", "file_seq", "landed_at"])


def p4_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The unified table without the time and what is left over."""
    return p4_unified(spark, folder).drop("rest", "landed_at")
