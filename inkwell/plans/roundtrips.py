"""Queries through sources, sinks and whole runs: written to the shared folder and read back, or asked of a local index."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import columns as c
from inkwell.functions.tokens import byte_pair_counter, with_token_count
from inkwell.functions.vocab import JOURNALS, KEYWORD_SETS
from inkwell.functions.xmltext import read_xml, unescape
from inkwell.operators import articles, embed, relevance, stats
from inkwell.plans import pipelines
from inkwell.plans.queries import _combined, documents, index, metadata, results
from inkwell.runtime import delete_at_end, read, shared_folder, written
from inkwell.sources import jsonl, rest, sinks, text
from inkwell.sources.local_index import LocalIndex, numbered_texts
from inkwell.streaming import incremental

#: Where the driver finds vocabulary files, and, a fixed value, the pattern they are given with.
VOCABULARIES = "/opt/tokenizers"
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"
ADDRESS = "http://localhost/search"
#: Not to be expanded twice: an escaped entity inside the escaped text of an element.
FIXTURE = ("<article xmlns='urn:a'><front><journal-title>J &amp; K</journal-title><article-title>Title &amp;amp; rest</article-title><abstract>", "</abstract><abstract>Second <i>abstract</i></abstract></front><body><sec><title>Results</title><p>", "</p><list><list-item>First item</list-item><li>Other item</li></list><sec><title>Nested part</title><p>Deep words</p></sec></sec><sec><title>References</title><p>gone</p><sec><title>Also</title><p>gone too</p></sec></sec><sec><title>Preferences</title><p>kept in v1</p></sec><p>Loose paragraph</p></body><back><sec><title>Appendix</title><p>", "</p></sec></back></article>")


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/inkwell-{name}-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    return path


def search(spark: SparkSession, folder: str, variant: str, **options: object) -> DataFrame:
    """All pages of the years 1990 to 2025 from the local index, as results; a source registered under its own name."""
    path = f"{folder}/metadata_all.parquet"

    class Local(rest.SearchSource):
        transport = LocalIndex(path)

        @classmethod
        def name(cls) -> str:
            return "local_search"

    spark.dataSource.register(Local)
    query = rest.base_query(journals=JOURNALS)
    reader = spark.read.format("local_search").option("address", ADDRESS).option("query", query).option("first", 1990).option("last", 2025).option("variant", variant).option("wait", 0)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def q_search_v1(spark: SparkSession, folder: str) -> DataFrame:
    """The first 30 results of each year, pages of 20 cut to what is left of the quota."""
    found = search(spark, folder, "v1", most=30, size=20)
    return articles.to_articles(found.select("year", F.from_json("value", articles.RESULT).alias("r")).select("year", "r.*"), keep=("year",)).select("year", "id", "pmcid", "title", "journal")


def q_search_v2(spark: SparkSession, folder: str) -> DataFrame:
    found = search(spark, folder, "v2", size=25)
    return found.select("year", F.get_json_object("value", "$.id").alias("id"), F.md5(F.coalesce(F.get_json_object("value", "$.abstractText"), F.lit("")).cast("binary")).alias("digest"))


def q_hit_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The hits of each year, one request a year, asked where the years are."""
    transport = LocalIndex(f"{folder}/metadata_all.parquet")
    query = rest.base_query(journals=JOURNALS)

    @F.udf("long")
    def hits(year: int) -> int:
        return rest.hit_count(ADDRESS, rest.with_years(query, year), transport, wait=0)

    return stats.years(spark, 1990, 2025).repartition(4).withColumn("hits", hits("year"))


def q_search_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that are asked of the index: one journal, the ISSNs of the table, a year, a range, keywords."""
    ids = [r[0] for r in articles.issns_of(read(spark, folder, "journal_dim")).select("issn").distinct().limit(10_000).collect()]
    rows = [
        ("single", rest.base_query(journals=["Gut"])),
        ("open", rest.with_years(rest.base_query(journals=["Gut", "Cell"], open_access=True), 2019)),
        ("range", rest.with_years("q", 2019, 2021)),
        ("issns", rest.base_query(issns=ids)),
        ("keywords", rest.keyword_clause(["gene", "gut flora"])),
    ]
    return spark.createDataFrame(rows, "name string, query string")


def _full_texts(spark: SparkSession, folder: str, variant: str) -> DataFrame:
    own = metadata(spark, folder).select(F.nullif(c.norm_pmcid("pmcid"), F.lit("")).alias("pmcid")).where(F.col("pmcid").rlike("^PMC[0-9]+$"))
    found = rest.full_texts(own, "http://localhost/{pmcid}", variant=variant, transport=numbered_texts, wait=0)
    return found.select("pmcid", F.md5(F.col("xml").cast("binary")).alias("digest"))


def q_full_text_v1(spark: SparkSession, folder: str) -> DataFrame:
    return _full_texts(spark, folder, "v1")


def q_full_text_v2(spark: SparkSession, folder: str) -> DataFrame:
    return _full_texts(spark, folder, "v2")


def _entities(spark: SparkSession, folder: str, variant: str) -> DataFrame:
    """Texts escaped once, entities expanded, normalized: as if never escaped."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&#60;")), F.lit("é"), F.lit("&eacute;"))
    return documents(spark, folder).select("doc_id", F.md5(c.normalize(unescape(escaped), variant).cast("binary")).alias("digest"))


def q_entities_v1(spark: SparkSession, folder: str) -> DataFrame:
    return _entities(spark, folder, "v1")


def q_entities_v2(spark: SparkSession, folder: str) -> DataFrame:
    return _entities(spark, folder, "v2")


def fixture_xml(text: str = "text") -> Column:
    """An article with entities, two abstracts, lists, nested, skipped and back sections, around a text."""
    own = F.replace(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("&"), F.lit(" and ")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit(FIXTURE[0]), own, F.lit(FIXTURE[1]), own, F.lit(FIXTURE[2]), own, F.lit(FIXTURE[3]))


def _xml(spark: SparkSession, folder: str, variant: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", read_xml(fixture_xml(), variant).alias("r")).select("doc_id", F.md5(F.col("r.clean_text").cast("binary")).alias("digest"), "r.journal")


def q_xml_article_v1(spark: SparkSession, folder: str) -> DataFrame:
    return _xml(spark, folder, "v1")


def q_xml_article_v2(spark: SparkSession, folder: str) -> DataFrame:
    return _xml(spark, folder, "v2")


def _landed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Search results and XML: an article for every id of an even record, the abstract its text."""
    found = results(spark, folder)
    xml = found.where("rec_no % 2 = 0 and pmcid <> ''").groupBy("pmcid").agg(F.min("rec_no").alias("first"))
    xml = xml.withColumn("xml", F.concat(F.lit("<article><front><journal-title>Filled</journal-title><article-title>On number "), F.col("first").cast("string"), F.lit("</article-title></front></article>")))
    return found, xml.select("pmcid", "xml")


def q_build_v1(spark: SparkSession, folder: str) -> DataFrame:
    found, xml = _landed(spark, folder)
    found = found.withColumn("journalTitle", F.when(F.col("rec_no") % 3 == 0, "").otherwise(F.col("journalTitle")))
    return pipelines.build_corpus(found, xml, variant="v1").drop("matches_keywords").groupBy("id", "pmcid", "journal", "pub_year", "is_open_access", "has_full_text", "text_path").agg(F.count(F.lit(1)).alias("rows"))


def _passed(built: DataFrame) -> DataFrame:
    return built.select("rec_no", "txt_path", "has_fulltext", "matches_keywords", "clean_text")


def q_build_v2(spark: SparkSession, folder: str) -> DataFrame:
    return _passed(pipelines.build_corpus(*_landed(spark, folder), variant="v2"))


def q_build_issn(spark: SparkSession, folder: str) -> DataFrame:
    dim = read(spark, folder, "journal_dim").where("tier = 'tier1'")
    return _passed(pipelines.build_corpus(*_landed(spark, folder), variant="v2-issn", issns=dim))


def q_build_backfill(spark: SparkSession, folder: str) -> DataFrame:
    found, xml = _landed(spark, folder)
    old = metadata(spark, folder).where("batch_no <= 2")
    new = found.join(metadata(spark, folder).where("batch_no > 2").select("rec_no"), "rec_no", "left_semi")
    return _passed(pipelines.build_corpus(new, xml, variant="v2-backfill", existing=old, order="rec_no"))


def q_metadata_full(spark: SparkSession, folder: str) -> DataFrame:
    """The seventeen columns, with the abstract as the text."""
    own = articles.to_articles(results(spark, folder), "https://lit.example")
    return articles.to_metadata(own, F.col("abstract"), terms="kw2")


def q_open_access_gate(spark: SparkSession, folder: str) -> DataFrame:
    said = F.when(F.col("rec_no") % 2 == 0, F.lower("isOpenAccess")).otherwise(F.col("isOpenAccess"))
    own = results(spark, folder).withColumn("said", said)
    return own.select("rec_no", articles.open_access("said", "pmcid", "v1").alias("v1"), articles.open_access("said", "pmcid", "v2").alias("v2"))


def q_base_filter(spark: SparkSession, folder: str) -> DataFrame:
    own = articles.journal_articles("pub_type", F.coalesce("is_preprint", F.lit(False)), "journal", JOURNALS)
    return metadata(spark, folder).select("rec_no", own.alias("kept"))


def _aliased(spark: SparkSession, folder: str, variant: str) -> DataFrame:
    lines = jsonl.tolerant(read(spark, folder, "metadata_raw").select("line_id", "raw"), "raw")
    return pipelines.aliased(lines, variant).select("line_id", "pmcid", "title", "journal", "abstract", "year")


def q_alias_pilot(spark: SparkSession, folder: str) -> DataFrame:
    return _aliased(spark, folder, "pilot")


def q_alias_full(spark: SparkSession, folder: str) -> DataFrame:
    return _aliased(spark, folder, "full")


def q_first_keys(spark: SparkSession, folder: str) -> DataFrame:
    """A look at the index: its first five keys."""
    return index(spark, folder).select("pmcid").orderBy("pmcid").limit(5)


def _pilot(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    meta = index(spark, folder).select("pmcid", "year", "title", "journal", "abstract", F.col("pub_type").alias("keywords"))
    ids = metadata(spark, folder).where(c.mentions(KEYWORD_SETS["kw1"], "title", "abstract")).select("pmcid")
    docs = documents(spark, folder).where("pmcid is not null").select("pmcid", F.col("pub_year").alias("year"), "text")
    return pipelines.chunk_pilot(docs, meta, ids, year=2019, target=100, overlap=20, mode=mode)


def _digested(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("text", F.md5(F.col("text").cast("binary")))


def q_pilot_year(spark: SparkSession, folder: str) -> DataFrame:
    return _digested(_pilot(spark, folder, "paragraph"))


def q_pilot_words(spark: SparkSession, folder: str) -> DataFrame:
    return _digested(_pilot(spark, folder, "words"))


def q_pilot_totals(spark: SparkSession, folder: str) -> DataFrame:
    return stats.pilot_totals(_pilot(spark, folder, "paragraph"))


def q_full_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All columns of the full and the metadata chunks."""
    return _digested(_combined(spark, folder))


def q_jsonl_strict(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata written as two sets of JSON lines, in two appends, read back strictly."""
    own = articles.to_metadata(articles.to_articles(results(spark, folder)))
    own, everything, matching = own.select("id", "title", "matches_keywords"), scratch(spark, "all"), scratch(spark, "matching")
    for part in (own.where("id is not null"), own.where("id is null")):
        sinks.write_metadata(part, everything, matching)
    both = [jsonl.strict(spark, p, "id string, title string, matches_keywords boolean").withColumn("kind", F.lit(k)) for p, k in ((everything, "all"), (matching, "matching"))]
    return both[0].unionByName(both[1]).groupBy("kind", "id", "title").agg(F.count(F.lit(1)).alias("rows"))


def q_resume_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose id was not written yet; a missing file knows none."""
    path, own = scratch(spark, "ids"), metadata(spark, folder)
    own.where("batch_no = 1").select("id").write.json(path)
    known = jsonl.known_ids(spark, path, "id").unionByName(jsonl.known_ids(spark, scratch(spark, "none"), "id"))
    return own.join(known, "id", "left_anti").select("rec_no")


def q_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """A file for each article of each year, exported and read back, the first three of each year by name."""
    root = scratch(spark, "texts")
    plain = root.removeprefix("file://")

    def write(path: str, text: str) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(text)

    docs = documents(spark, folder).where("pub_year is not null and text <> ''")
    sinks.export_files(docs.select(c.output_path(plain, "pub_year", F.format_string("PMC%09d", "doc_id")).alias("path"), "text"), write)
    found = text.fulltext_files(spark, root, most_per_year=3).unionByName(text.fulltext_files(spark, scratch(spark, "none"), missing_ok=True))
    return found.select("year", "file_name", "pmcid", F.md5(F.col("text").cast("binary")).alias("digest"))


def q_year_files(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks in a directory a year; a second run replaces the one year it holds."""
    path, docs = scratch(spark, "years"), documents(spark, folder).select(F.col("pub_year").alias("year"), "doc_id", "lang")
    sinks.write_by_year(docs.repartition("year"), path, order=["doc_id"])
    sinks.write_by_year(docs.where("year = 2019").withColumn("lang", F.lit("again")), path, order=["doc_id"])
    return spark.read.schema("doc_id long, lang string, year int").json(path).groupBy("year", "lang").agg(F.count(F.lit(1)).alias("documents"))


def q_stats_files(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of journals as CSV, the totals as JSON, read back."""
    table, total = scratch(spark, "csv"), scratch(spark, "stats")
    own = stats.oa_by_journal(metadata(spark, folder), read(spark, folder, "journal_dim"), F.coalesce("is_open_access", F.lit(False)))
    sinks.write_csv(own.select("tier", "journal", "total", "oa"), table)
    sinks.write_stats(own.agg(F.sum("total").alias("total"), F.sum("oa").alias("oa")), total)
    rows = spark.read.option("header", True).schema("tier string, journal string, total long, oa long").csv(table)
    return rows.unionByName(spark.read.schema("total long, oa long").json(total).select(F.lit("ALL").alias("tier"), F.lit("").alias("journal"), "total", "oa"))


def q_open_years(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of years that are not marked as done in all parts."""
    manifest, docs = scratch(spark, "done"), documents(spark, folder).withColumn("year", F.col("pub_year"))
    for part in incremental.PARTS:
        incremental.mark_done(docs.where("year < 2000" if part == "stats" else "year < 2010").select("year"), manifest, part)
    return incremental.open_years(docs, manifest).groupBy("year").agg(F.count(F.lit(1)).alias("documents"))


def q_bounded_run(spark: SparkSession, folder: str) -> DataFrame:
    """A run cut to years, documents a year and unfinished years."""
    docs = documents(spark, folder).where("pmcid is not null").select("pmcid", F.col("pub_year").alias("year"), "text")
    meta = index(spark, folder).select("pmcid", "year", "title", "journal", "abstract", F.col("pub_type").alias("keywords"))
    done = spark.createDataFrame([(2012,)], "year int")
    run = pipelines.chunk_full(docs, meta, target=200, overlap=40, first_year=2010, last_year=2020, most_years=4, most_files=5, finished=done)
    return run.where("source_type = 'fulltext'").groupBy("year").agg(F.count_distinct("pmcid").alias("articles"))


def q_embedding_appends(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors appended in three runs: a part, all, and all again, which adds nothing."""
    target, chunks = scratch(spark, "vectors"), read(spark, folder, "embedded_chunk").select("chunk_id", "year", "text")
    for part in (chunks.where("year < 2015"), chunks, chunks):
        incremental.resume_embedding(part, target, lambda df: embed.embed_chunks(df, embed.hashed_provider, "hashed-16"))
    return spark.read.parquet(target).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("rows"))


def q_embed_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """What has no vector of the model yet, embedded."""
    chunks = read(spark, folder, "embedded_chunk").select("chunk_id", "text", "embedding", "embedding_model")
    known = chunks.where("embedding is not null and embedding_model = 'lit-embed-64'")
    made = pipelines.embed_corpus(chunks.select("chunk_id", "text"), known, embed.hashed_provider, "hashed-16")
    return made.groupBy("chunk_id", "embedding_model").agg(F.count(F.lit(1)).alias("rows"))


def q_chunk_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of all chunks by year and kind, in tokens of a public byte-pair vocabulary."""
    make = byte_pair_counter(f"{VOCABULARIES}/byte_bpe_50k.tiktoken", PATTERN)
    counted = lambda chunks: with_token_count(chunks, "text", "byte_bpe_50k", make)
    return pipelines.chunk_statistics(_combined(spark, folder), counted, limit=250)[0]


def q_embed_values(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors themselves, under a provider that gives the length of what it is sent and whether a line break is in it."""

    def provider() -> embed.Provider:
        return lambda texts: [[float(len(t)), float("\n" in t)] for t in texts]

    chunks = read(spark, folder, "embedded_chunk").select("chunk_id", "text")
    made = embed.embed_chunks(chunks, provider, "lengths")
    return made.select("chunk_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), F.col("embedding")[0].cast("long").alias("length"), F.col("embedding")[1].cast("int").alias("broken"), "embedding_model")


def q_stream_new_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Users of the events as they come in two lots of files: each key is appended once."""
    source, target, checkpoint = (scratch(spark, n) for n in ("in", "out", "cp"))
    events = read(spark, folder, "events").select("user_id", "event_type")
    for k in range(2):
        events.where(F.col("user_id") % 2 >= 1 - k).write.mode("append").parquet(source)
        incremental.stream_new_keys(spark, source, events.schema, target, checkpoint, "user_id", "parquet")
    return spark.read.parquet(target).select("user_id")


def q_embedding_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks in batches of fifty, in order of their id."""
    ids = read(spark, folder, "embedded_chunk").select("chunk_id").where("chunk_id is not null").distinct()
    return embed.numbered(written(ids, "ids"), "chunk_id", 50).groupBy("batch").agg(F.count(F.lit(1)).alias("chunks"), F.min("chunk_id").alias("first"))


def q_tier_places(spark: SparkSession, folder: str) -> DataFrame:
    """Tier order of the journals that have articles, with the tier's place."""
    own = relevance.with_tier(metadata(spark, folder), read(spark, folder, "journal_dim")).groupBy("tier", "journal").agg(F.count(F.lit(1)).alias("total"))
    place = F.array_position(F.array(*map(F.lit, ("tier1", "tier2", "tier3", "UNKNOWN"))), F.col("tier"))
    return own.select("tier", "journal", "total", place.cast("int").alias("place")).orderBy("place", F.desc("total"), "journal")
