"""One function (spark, folder) -> DataFrame for each query pN_..."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import hash_forest, history, leakage, lookalike, packing, tokens, trie_join
from inkwell.runtime import bounded_rows, delete_at_end, read, release, shared_folder, written


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    links, members = trie_join.near_duplicates(read(spark, folder, "documents"), "doc_id", "text")
    return trie_join.pairs_of_records(links, members).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    chunks = read(spark, folder, "embedded_chunk").where("embedding_model = 'lit-embed-64'")
    near = hash_forest.most_similar(chunks, "chunk_id", "embedding", k=5, dim=64, least=0.85)
    return near.select(F.least("a", "b").alias("chunk_id_a"), F.greatest("a", "b").alias("chunk_id_b")).distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = history.check_backlog(read(spark, folder, "metadata_all"))
    return found.select(F.col("a").alias("rec_no_a"), F.col("b").alias("rec_no_b"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leakage.leaks(read(spark, folder, "documents"), read(spark, folder, "eval_items"), edits=1)
    return found.where("exact").drop("exact")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.lookalikes(read(spark, folder, "documents"), "doc_id", "text").select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.forms(read(spark, folder, "documents"), "doc_id", "text").select(F.col("rec").alias("doc_id"), "form")


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document with a non-blank text: its class of equal form, its copies and its number of links."""
    return lookalike.classes(read(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("rec", "doc_id")


def counted_documents(spark: SparkSession, folder: str, how: str = "pair_merge") -> DataFrame:
    """doc_id, source, lang, domain, source_type, tokens, under the tokenizer named in context_windows."""
    keep = ["doc_id", "source", "lang", "domain", "source_type"]
    return tokens.token_counts(read(spark, folder, "documents"), keep, "text", of=tokens.vocabulary(named_tokenizer(spark, folder)[1]), how=how)


def named_tokenizer(spark: SparkSession, folder: str) -> tuple[str, str]:
    """The tokenizer that context_windows names, and the vocabulary that is counted under."""
    names = {r[0] for r in bounded_rows(read(spark, folder, "context_windows").select("tokenizer").distinct(), 100, "the tokenizers in use")}
    if len(names) != 1:
        raise ValueError(f"context_windows must name one tokenizer, not {sorted(map(str, names))}")
    name = names.pop()
    return name, tokens.STAND_INS.get(name, name)


def said(totals: DataFrame, names: tuple[str, str]) -> DataFrame:
    """With the tokenizer asked for and the vocabulary that stands in for it."""
    return totals.withColumns({"tokenizer": F.lit(names[0]), "counted_with": F.lit(names[1])})


def p3_token_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Totals over documents and chunks; a chunk's journal is its source, its language and domain are its article's.

    Of several documents with one pmcid, the one with the smallest doc_id counts. Rows of a chunk repeated
    whole count once: they are brought together after counting, so that no text is shuffled.
    """
    articles = read(spark, folder, "documents").where("pmcid is not null").groupBy("pmcid").agg(F.min_by(F.struct("lang", "domain"), "doc_id").alias("of"))
    names = named_tokenizer(spark, folder)
    chunks = read(spark, folder, "embedded_chunk").withColumn("same", F.xxhash64("text"))
    counted = tokens.token_counts(chunks, ["chunk_id", "pmcid", "journal", "source_type", "same"], "text", of=tokens.vocabulary(names[1]))
    counted = counted.groupBy("chunk_id", "journal", "source_type", "same", "tokens").agg(F.min("pmcid").alias("pmcid"))
    counted = counted.join(articles, "pmcid", "left").select(F.col("journal").alias("source"), "of.lang", "of.domain", "source_type", "tokens")
    whole = tokens.budget(counted_documents(spark, folder)).withColumn("kind", F.lit("documents"))
    return said(whole.unionByName(tokens.budget(counted).withColumn("kind", F.lit("chunks"))), names)


def p3_longest_match(spark: SparkSession, folder: str) -> DataFrame:
    """The budget of documents under greedy longest match over the same vocabulary."""
    return said(tokens.budget(counted_documents(spark, folder, "longest_match")), named_tokenizer(spark, folder))


def p6_assignment(spark: SparkSession, folder: str) -> DataFrame:
    sizes = written(counted_documents(spark, folder).select("doc_id", "tokens"), "sizes")
    return packing.assign(sizes, read(spark, folder, "context_windows")).withColumnRenamed("item", "doc_id")


def p6_unused(spark: SparkSession, folder: str) -> DataFrame:
    return packing.unused(p6_assignment(spark, folder))


def p6_checks(spark: SparkSession, folder: str) -> DataFrame:
    """For each window: containers above the capacity, items split though they fit, items whose pieces don't sum to them, items laid."""
    sizes = written(counted_documents(spark, folder).select("doc_id", "tokens"), "sizes")
    laid = packing.assign(sizes, read(spark, folder, "context_windows"))
    return packing.checked(written(laid, "laid"), sizes)


def p2_last_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The cases of the newest batch, checked against the history that the batches before it leave."""
    meta = read(spark, folder, "metadata_all")
    last = meta.agg(F.max("batch_no")).first()[0]
    path = f"{shared_folder(spark)}/inkwell-history-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    history.check_batch(meta.where(F.col("batch_no") < last)).save(path, "overwrite")
    release(spark)
    found = history.check_batch(meta.where(F.col("batch_no") == last), history.History.load(spark, path)).cases
    return found.select(F.col("a").alias("rec_no_a"), F.col("b").alias("rec_no_b"))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: its class of equal shingle sets, the class's copies and its number of links.

    A document without a text of enough words is a class of its own, without links.
    """
    documents = read(spark, folder, "documents")
    links, members = trie_join.near_duplicates(documents, "doc_id", "text")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    classes = members.join(degree, "rep", "left").select(F.col("rec").alias("doc_id"), "rep", "copies", "links")
    every = documents.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    return every.join(classes, "doc_id", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))


def p7_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    """As p7_found, with one word of a window changed, added or missing; ``exact``: none is."""
    return leakage.leaks(read(spark, folder, "documents"), read(spark, folder, "eval_items"), edits=1)
