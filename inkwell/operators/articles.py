"""Search results to articles and metadata records; predicates, and one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.columns import base_id_v1, base_id_v2, clean_issn, col, first_truthy, mentions, output_path, tagged_key, truthy
from inkwell.functions.vocab import KEYWORD_SETS
from inkwell.schemas import ARTICLE, METADATA_V1, RESULT, SEARCH_PAGE

ARTICLE_COLUMNS = [part.split()[0] for part in ARTICLE.split(", ")]
METADATA_COLUMNS = [part.split()[0] for part in METADATA_V1.split(", ")]


def pages_to_results(pages: DataFrame, body: str = "value") -> DataFrame:
    """Landed response bodies (JSON) to one row per result; bodies that are no envelope give none."""
    page = F.from_json(F.col(body), SEARCH_PAGE)
    return pages.select(F.explode(page["resultList"]["result"]).alias("r")).select("r.*")


def last_per_key(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The last row of each key in ``order``, which must be total; rows without a key are left out."""
    w = Window.partitionBy(key).orderBy(*[col(c).desc() for c in order])
    return _first(df.where(truthy(key).isNotNull()), w, 1)


def first_per_key(df: DataFrame, key: str, *order: Column | str, number: int = 1) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[col(c).asc() for c in order])
    return _first(df.where(F.col(key).isNotNull()), w, number)


def _first(df: DataFrame, w, number: int) -> DataFrame:
    # a filter on row_number is planned as a group limit, which prunes before the shuffle
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= number).drop("__rn")


def first_years(df: DataFrame, year: str, number: int) -> DataFrame:
    """Rows of the ``number`` smallest years; filter the years before."""
    years = df.select(year).where(F.col(year).isNotNull()).distinct().orderBy(year).limit(number)
    return df.join(F.broadcast(years) if number <= 10_000 else years, year, "left_semi")


def lite_backfill(core: DataFrame, lite: DataFrame, *lite_order: Column | str) -> DataFrame:
    """Core results with journalTitle and pubType filled, where falsy, from the last lite result of the same id."""
    last = last_per_key(lite, "id", *lite_order).select("id", F.col("journalTitle").alias("__j"), F.col("pubType").alias("__t"))
    own_type = F.col("pubType").alias("ownType")
    return core.join(last, "id", "left").select(*[c for c in core.columns if c not in ("journalTitle", "pubType")], first_truthy("journalTitle", "__j").alias("journalTitle"), first_truthy("pubType", "__t").alias("pubType"), own_type)


def to_articles(results: DataFrame, site: str = "https://europepmc.org/article", keep: tuple[str, ...] = ()) -> DataFrame:
    """The fourteen columns of an article, and the columns ``keep``. Missing flags are false; the address is null without source or id."""
    own_type = "ownType" if "ownType" in results.columns else "pubType"
    yes = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    return results.select(
        "id", "source", "pmid", "pmcid", "doi", "title", F.col("abstractText").alias("abstract"), truthy("journalTitle").alias("journal"),
        F.col("pubYear").alias("pub_year"), F.col("authorString").alias("author_string"), yes("isOpenAccess", "Y").alias("is_open_access"),
        truthy("pubType").alias("pub_type"), (yes(own_type, "preprint") | yes("isPreprint", "Y")).alias("is_preprint"),
        F.concat(F.lit(site + "/"), truthy("source"), F.lit("/"), truthy("id")).alias("europe_pmc_url"), *keep,
    )


def matches_keywords(title: Column | str, abstract: Column | str, *text: Column | str, terms: str = "kw1") -> Column:
    return mentions(KEYWORD_SETS[terms], title, abstract, *text)


def to_metadata(articles: DataFrame, clean_text: Column | None = None, *, root: str = "corpus", terms: str = "v1") -> DataFrame:
    """Seventeen columns and matches_keywords; xml_path is always null, text_path only with a full text."""
    text = F.lit(None).cast("string") if clean_text is None else clean_text
    has = text.isNotNull()
    path = output_path(root, F.col("pub_year"), base_id_v1("pmcid", "pmid", "id"))
    own = articles.withColumn("__text", text)
    return own.withColumns({"has_full_text": has, "xml_path": F.lit(None).cast("string"), "text_path": F.when(has, path), "matches_keywords": matches_keywords("title", "abstract", "__text", terms=terms)}).drop("__text")


def pass_through(results: DataFrame, clean_text: Column | None = None, *, root: str = "corpus", terms: str = "kw1", title: str = "title", abstract: str = "abstractText") -> DataFrame:
    """Every upstream column, with txt_path, has_fulltext and matches_keywords."""
    text = F.lit(None).cast("string") if clean_text is None else clean_text
    own = results.withColumn("__text", text)
    base = base_id_v2("pmcid", "id", *[c for c in ("doi", "title") if c in results.columns])
    return own.withColumns({"txt_path": F.when(truthy("__text").isNotNull(), output_path(root, F.col("pubYear"), base)), "has_fulltext": truthy("__text").isNotNull(), "matches_keywords": matches_keywords(title, abstract, "__text", terms=terms)}).drop("__text")


def open_access(flag: Column | str, pmcid: Column | str, variant: str = "v2") -> Column:
    said = col(flag) if variant == "v1" else F.upper(col(flag))
    return F.coalesce(said == "Y", F.lit(False)) & truthy(pmcid).isNotNull()


def journal_articles(pub_type: Column | str, preprint: Column | str, journal: Column | str, journals: list[str]) -> Column:
    return F.coalesce(F.lower(col(pub_type)).isin("journal article", "research-article", "review") & ~col(preprint) & col(journal).isin(journals), F.lit(False))


def issns_of(dim: DataFrame) -> DataFrame:
    """(issn, journal): cleaned, distinct; blanks left out."""
    one = dim.select("journal", F.explode("issns").alias("issn")).select(clean_issn("issn").alias("issn"), "journal")
    return one.where("issn <> ''").distinct()


def without_year(df: DataFrame, year: Column | str, dropped: str) -> DataFrame:
    """Rows of any other year, and rows without one."""
    return df.where(~col(year).cast("string").eqNullSafe(F.lit(dropped)))


def backfill(new: DataFrame, existing: DataFrame, *order: Column | str, pmcid: str = "pmcid", pmid: str = "pmid", ident: str = "id") -> DataFrame:
    """New articles whose tagged key is not in the corpus, the first of each key; without a key, left out."""
    keyed = new.withColumn("key", tagged_key(pmcid, pmid, ident)).where("key is not null")
    known = existing.select(tagged_key(pmcid, pmid, ident).alias("key")).where("key is not null").distinct()
    return first_per_key(keyed.join(known, "key", "left_anti"), "key", *order)


def not_embedded(chunks: DataFrame, embedded: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks whose id has no vector yet; repeats within the input stay."""
    return chunks.join(embedded.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
