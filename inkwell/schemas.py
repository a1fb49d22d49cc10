"""Schemas of what the engine reads and writes, as DDL."""

RESULT = "id STRING, source STRING, pmid STRING, pmcid STRING, doi STRING, title STRING, abstractText STRING, journalTitle STRING, pubYear STRING, authorString STRING, isOpenAccess STRING, pubType STRING, isPreprint STRING"
SEARCH_PAGE = f"resultList STRUCT<result: ARRAY<STRUCT<{RESULT.replace(' STRING', ': STRING')}>>>, hitCount INT, nextCursorMark STRING"
ARTICLE = "id STRING, source STRING, pmid STRING, pmcid STRING, doi STRING, title STRING, abstract STRING, journal STRING, pub_year STRING, author_string STRING, is_open_access BOOLEAN, pub_type STRING, is_preprint BOOLEAN, europe_pmc_url STRING"
METADATA_V1 = f"{ARTICLE}, has_full_text BOOLEAN, xml_path STRING, text_path STRING"
CHUNK_PILOT = "chunk_id STRING, pmcid STRING, year INT, journal STRING, title STRING, chunk_index INT, text STRING, journal_tier INT, keyword_relevant BOOLEAN, source_type STRING"
CHUNK_FULL = "chunk_id STRING, pmcid STRING, year INT, chunk_index INT, title STRING, journal STRING, source_type STRING, text STRING"
EMBEDDED_CHUNK = f"{CHUNK_FULL}, embedding ARRAY<FLOAT>, embedding_model STRING"
