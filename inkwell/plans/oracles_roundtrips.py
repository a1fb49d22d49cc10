"""The SQL of the queries through sources, sinks and whole runs."""

from __future__ import annotations

from inkwell.functions.vocab import CHAINS, JOURNALS, KEYWORD_SETS
from inkwell.operators.schema_drift import JOINED, TARGETS
from inkwell.operators.schema_drift import meaning as meaning_of
from inkwell.plans.oracles import BASE_V1, BASE_V2, HAY, INDEX, KW, MEANING, NORM_V1, NORM_V2, OA, OBJECTS, PARAS_PILOT, PILOT_TIER, PLAIN_PAYLOAD, TAGGED, fold, has_any, norm_pmcid, paras_full, strip, text, truthy, words, year_full, year_pilot

YEARS = "regexp_full_match(pub_year, '[0-9]{4}') AND pub_year BETWEEN '1990' AND '2025'"
BASE = 'PUB_TYPE:"Journal Article" AND IN_EPMC:Y AND NOT PREPRINT:Y'
PMCIDS = f"SELECT DISTINCT k FROM (SELECT {norm_pmcid('pmcid')} AS k FROM metadata_all) WHERE regexp_full_match(k, 'PMC[0-9]+')"
ABOUT = "'<article><front><article-title>About ' || k || '</article-title></front></article>'"
PAGE = "chr(10) || '<!DOCTYPE HTML><p>' || k"


def xml_article(norm: str, before: str, after: str) -> str:
    """The fixture's text: what XML cannot hold makes a document malformed."""
    bad = "regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{fffe}\\x{ffff}]') OR contains(text, ']]>')"
    digest = f"md5(concat_ws(chr(10) || chr(10), 'Title & rest', n, 'Second abstract', {before}, {after}))"
    return f"SELECT doc_id, CASE WHEN NOT bad THEN {digest} END AS digest, CASE WHEN NOT bad THEN 'J & K' END AS journal FROM (SELECT doc_id, bad, nullif({norm}, '') AS n FROM (SELECT doc_id, coalesce({bad}, false) AS bad, replace(text, '&', ' and ') AS text FROM documents))"


RESULTS = "'Results', n, 'First item', 'Other item', 'Nested part', 'Deep words'"
#: What a run finds: the articles with a text of their own, which even records with a pmcid give.
LANDED = "x AS (SELECT pmcid, min(rec_no) AS first FROM metadata_all WHERE rec_no % 2 = 0 AND pmcid <> '' GROUP BY pmcid), b AS (SELECT m.*, CASE WHEN coalesce(m.is_open_access, false) AND m.pmcid <> '' THEN x.first END AS first FROM metadata_all m LEFT JOIN x USING (pmcid))"


def passed(where: str, terms: str, of: str = "b") -> str:
    return f"SELECT rec_no, CASE WHEN first IS NOT NULL THEN 'corpus/' || coalesce(pub_year, 'unknown') || '/' || {BASE_V2} || '.txt' END AS txt_path, first IS NOT NULL AS has_fulltext, {KW[terms]} AS matches_keywords, 'On number ' || first AS clean_text FROM {of} {where}"


def aliased(variant: str) -> str:
    one = lambda n: f"(CASE WHEN json_type(o, '$.{n}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN o->>'$.{n}' END)"
    year = year_pilot if variant == "pilot" else year_full
    cols = {name: truthy(*map(one, names)) for name, names in CHAINS[variant].items() if name != "year"}
    years = ", ".join(year(one(n)) for n in CHAINS[variant]["year"])
    return f"WITH {OBJECTS} SELECT line_id, {norm_pmcid(cols['pmcid'])} AS pmcid, {cols['title']} AS title, {cols['journal']} AS journal, {cols['abstract']} AS abstract, coalesce({years}) AS year FROM objects"


def windows(x: str) -> str:
    return f"(SELECT CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(0, 1 + greatest(0, CAST(ceil((len(w) - 100) / 80.0) AS BIGINT))), lambda i: array_to_string(w[i * 80 + 1 : i * 80 + 100], ' ')) END FROM (SELECT {words(x)} AS w))"


def paras_pilot(x: str) -> str:
    return PARAS_PILOT.replace("coalesce(text, '')", f"coalesce({x}, '')")


WHEN = "nullif(concat_ws(', ', nullif(journal, ''), CAST(year AS VARCHAR)), '')"
LABELLED = strip(f"concat_ws(chr(10) || chr(10), 'Title: ' || nullif(title, ''), 'Journal / Year: ' || {WHEN}, 'Abstract: ' || nullif(abstract, ''), 'Keywords: ' || nullif(pub_type, ''))")


def pilot(mode: str) -> str:
    cut = windows("body") if mode == "words" else fold(paras_pilot("body"), 100, 150, None)
    return (
        f"WITH {INDEX}, ids AS (SELECT DISTINCT pmcid FROM metadata_all WHERE {KW['kw1']} AND pmcid <> ''), files AS (SELECT pmcid, pub_year AS year, text FROM documents WHERE pmcid IS NOT NULL AND pub_year = 2019), "
        f"both_kinds AS (SELECT f.pmcid, f.year, i.journal, i.title, f.text AS body, 'fulltext' AS source_type FROM files f LEFT JOIN idx i ON i.pmcid = f.pmcid UNION ALL "
        f"SELECT pmcid, year, journal, title, {LABELLED} AS body, 'metadata_only' FROM idx WHERE year = 2019 AND NOT EXISTS (SELECT 1 FROM files f WHERE f.pmcid = idx.pmcid)), "
        f"marked AS (SELECT *, {PILOT_TIER} AS journal_tier, pmcid IN (SELECT pmcid FROM ids) AS keyword_relevant FROM both_kinds), "
        f"cut AS (SELECT * EXCLUDE (body), {cut} AS parts FROM marked WHERE (journal_tier IN (1, 2) OR keyword_relevant) AND {strip('body')} <> ''), "
        "chunk AS (SELECT year || '_' || pmcid || '_' || lpad(CAST(i AS VARCHAR), 4, '0') AS chunk_id, pmcid, year, journal, title, CAST(i AS INTEGER) AS chunk_index, md5(parts[i]) AS text, CAST(journal_tier AS INTEGER) AS journal_tier, keyword_relevant, source_type FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM cut)) "
    )


FULL = (
    f"WITH {INDEX}, docs AS (SELECT pmcid, pub_year AS year, text FROM documents WHERE pmcid IS NOT NULL), "
    f"present AS (SELECT DISTINCT year, pmcid FROM docs WHERE {strip('coalesce(text, chr(32))')} <> ''), spine AS (SELECT DISTINCT year FROM docs WHERE year IS NOT NULL), "
    f"both_kinds AS (SELECT d.year, d.pmcid, i.title, i.journal, 'fulltext' AS source_type, '_' AS mark, {fold(paras_full('d.text'), 200, 200, 40)} AS parts FROM docs d LEFT JOIN idx i ON d.pmcid = i.pmcid UNION ALL "
    f"SELECT i.year, i.pmcid, i.title, i.journal, 'metadata_only', '_META_', {fold(paras_full(strip(PLAIN_PAYLOAD)), 200, 200, 40)} FROM idx i WHERE "
    "(i.year IN (SELECT year FROM spine) AND NOT EXISTS (SELECT 1 FROM present p WHERE p.year = i.year AND p.pmcid = i.pmcid)) OR (i.year IS NULL AND EXISTS (SELECT 1 FROM spine))) "
    "SELECT coalesce(CAST(year AS VARCHAR), 'UNKNOWN_YEAR') || '_' || pmcid || mark || lpad(CAST(i AS VARCHAR), 4, '0') AS chunk_id, pmcid, year, title, journal, CAST(i AS INTEGER) AS chunk_index, source_type, md5(parts[i]) AS text FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM both_kinds)"
)

MORE: dict[str, str] = {
    "q_search_v1": f"SELECT CAST(pub_year AS INTEGER) AS year, id, pmcid, title, nullif(journal, '') AS journal FROM (SELECT *, row_number() OVER (PARTITION BY pub_year ORDER BY rec_no) AS rn FROM metadata_all WHERE {YEARS}) WHERE rn <= 30",
    "q_search_v2": f"SELECT CAST(pub_year AS INTEGER) AS year, id, md5(coalesce(abstract, '')) AS digest FROM metadata_all WHERE {YEARS}",
    "q_hit_counts": f"SELECT CAST(y AS INTEGER) AS year, count(m.rec_no) AS hits FROM range(1990, 2026) r(y) LEFT JOIN (SELECT * FROM metadata_all WHERE {YEARS}) m ON m.pub_year = CAST(y AS VARCHAR) GROUP BY y",
    "q_search_queries": f"""SELECT * FROM (VALUES ('single', '{BASE} AND (JOURNAL:"Gut")'), ('open', '({BASE} AND OPEN_ACCESS:Y AND (JOURNAL:"Gut" OR JOURNAL:"Cell")) AND PUB_YEAR:2019'), ('range', '(q) AND PUB_YEAR:[2019 TO 2021]'), ('keywords', '("gene" OR "gut flora")')) v(name, query)
UNION ALL SELECT 'issns', '{BASE} AND (' || string_agg('ISSN:"' || i || '"', ' OR ' ORDER BY i) || ')' FROM (SELECT DISTINCT upper(trim(i)) AS i FROM (SELECT unnest(issns) AS i FROM journal_dim) WHERE trim(i) <> '')""",
    "q_full_text_v1": f"SELECT k AS pmcid, md5({ABOUT}) AS digest FROM ({PMCIDS}) WHERE right(k, 1) IN ('3', '4', '6', '8', '9')",
    "q_full_text_v2": f"SELECT k AS pmcid, md5(CASE WHEN right(k, 1) IN ('2', '7') THEN {PAGE} ELSE {ABOUT} END) AS digest FROM ({PMCIDS}) WHERE right(k, 1) NOT IN ('0', '1', '5')",
    "q_xml_article_v1": xml_article(NORM_V1, RESULTS, "'Preferences', 'kept in v1'"),
    "q_xml_article_v2": xml_article(NORM_V2, RESULTS, "'Loose paragraph', 'Appendix', n"),
    "q_entities_v1": f"SELECT doc_id, md5({NORM_V1}) AS digest FROM documents",
    "q_entities_v2": f"SELECT doc_id, md5({NORM_V2}) AS digest FROM documents",
    "q_embed_corpus": "SELECT chunk_id, 'hashed-16' AS embedding_model, count(*) AS rows FROM embedded_chunk c WHERE NOT EXISTS (SELECT 1 FROM embedded_chunk e WHERE e.chunk_id = c.chunk_id AND e.embedding IS NOT NULL AND e.embedding_model = 'lit-embed-64') GROUP BY chunk_id",
    "q_build_v1": f"WITH {LANDED} SELECT id, pmcid, coalesce(nullif(CASE WHEN rec_no % 3 = 0 THEN '' ELSE journal END, ''), CASE WHEN first IS NOT NULL THEN 'Filled' END) AS journal, pub_year, coalesce(is_open_access, false) AS is_open_access, first IS NOT NULL AS has_full_text, CASE WHEN first IS NOT NULL THEN 'corpus/' || coalesce(pub_year, 'unknown') || '/' || {BASE_V1} || '.txt' END AS text_path, count(*) AS rows FROM b GROUP BY ALL",
    "q_build_v2": f"WITH {LANDED} {passed('', 'kw1')}",
    "q_build_issn": f"WITH {LANDED} {passed('WHERE journal IN (SELECT journal FROM (SELECT journal, unnest(issns) AS i FROM journal_dim WHERE tier = ' + text('tier1') + ') WHERE trim(i) <> ' + text('') + ')', 'kw2')}",
    "q_build_backfill": f"WITH {LANDED}, k AS (SELECT *, {TAGGED} AS key FROM b), n AS (SELECT * FROM k WHERE batch_no > 2 AND key IS NOT NULL AND key NOT IN (SELECT key FROM k WHERE batch_no <= 2 AND key IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY key ORDER BY rec_no) = 1) {passed('', 'kw1', 'n')}",
    "q_metadata_full": f"SELECT id, source, pmid, pmcid, doi, title, abstract, nullif(journal, '') AS journal, pub_year, author_string, coalesce(is_open_access, false) AS is_open_access, nullif(pub_type, '') AS pub_type, coalesce(pub_type = 'preprint', false) OR coalesce(is_preprint, false) AS is_preprint, 'https://lit.example/' || nullif(source, '') || '/' || nullif(id, '') AS europe_pmc_url, abstract IS NOT NULL AS has_full_text, CAST(NULL AS VARCHAR) AS xml_path, CASE WHEN abstract IS NOT NULL THEN 'corpus/' || coalesce(pub_year, 'unknown') || '/' || {BASE_V1} || '.txt' END AS text_path, {has_any(KEYWORD_SETS['kw2'], HAY[:-1] + ' || chr(32) || coalesce(abstract, ' + text('') + '))')} AS matches_keywords FROM metadata_all",
    "q_open_access_gate": "SELECT rec_no, coalesce(is_open_access AND pmcid <> '' AND rec_no % 2 = 1, false) AS v1, coalesce(is_open_access AND pmcid <> '', false) AS v2 FROM metadata_all",
    "q_base_filter": f"SELECT rec_no, coalesce(lower(pub_type) IN ('journal article', 'research-article', 'review') AND NOT coalesce(is_preprint, false) AND journal IN ({', '.join(map(text, JOURNALS))}), false) AS kept FROM metadata_all",
    "q_alias_pilot": aliased("pilot"),
    "q_alias_full": aliased("full"),
    "q_first_keys": f"WITH {INDEX} SELECT pmcid FROM idx ORDER BY pmcid LIMIT 5",
    "q_pilot_year": pilot("paragraph") + "SELECT * FROM chunk",
    "q_pilot_words": pilot("words") + "SELECT * FROM chunk",
    "q_pilot_totals": pilot("paragraph") + "SELECT count(DISTINCT pmcid) FILTER (source_type = 'fulltext') AS fulltext_articles, count(DISTINCT pmcid) FILTER (source_type = 'metadata_only') AS metadata_only_articles, count(*) AS chunks FROM chunk",
    "q_full_chunks": FULL,
    "q_jsonl_strict": f"SELECT 'all' AS kind, id, title, count(*) AS rows FROM metadata_all GROUP BY ALL UNION ALL SELECT 'matching', id, title, count(*) FROM metadata_all WHERE {KW['v1']} GROUP BY ALL",
    "q_resume_ids": "SELECT rec_no FROM metadata_all WHERE id IS NULL OR id NOT IN (SELECT id FROM metadata_all WHERE batch_no = 1 AND id IS NOT NULL)",
    "q_text_files": "SELECT year, file_name, replace(file_name, '.txt', '') AS pmcid, digest FROM (SELECT pub_year AS year, 'PMC' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.txt' AS file_name, md5(text) AS digest FROM documents WHERE pub_year IS NOT NULL AND text <> '') QUALIFY row_number() OVER (PARTITION BY year ORDER BY file_name) <= 3",
    "q_year_files": "SELECT pub_year AS year, CASE WHEN pub_year = 2019 THEN 'again' ELSE lang END AS lang, count(*) AS documents FROM documents GROUP BY ALL",
    "q_stats_files": f"WITH {OA} SELECT tier, journal, total, oa FROM oa UNION ALL SELECT 'ALL', '', CAST(sum(total) AS BIGINT), CAST(sum(oa) AS BIGINT) FROM oa",
    "q_open_years": "SELECT pub_year AS year, count(*) AS documents FROM documents WHERE pub_year >= 2000 OR pub_year IS NULL GROUP BY 1",
    "q_bounded_run": f"WITH d AS (SELECT pmcid, pub_year AS year, text FROM documents WHERE pmcid IS NOT NULL AND pub_year BETWEEN 2010 AND 2020), e AS (SELECT * FROM d WHERE year IN (SELECT DISTINCT year FROM d ORDER BY 1 LIMIT 4) AND year <> 2012 QUALIFY row_number() OVER (PARTITION BY year ORDER BY pmcid, text NULLS FIRST) <= 5) SELECT year, count(DISTINCT pmcid) AS articles FROM e WHERE {strip('coalesce(text, chr(32))')} <> '' GROUP BY year",
    "q_embedding_appends": "SELECT chunk_id, CASE WHEN chunk_id IS NULL THEN count(*) FILTER (year < 2015) + 2 * count(*) WHEN count(*) FILTER (year < 2015) > 0 THEN count(*) FILTER (year < 2015) ELSE count(*) END AS rows FROM embedded_chunk GROUP BY chunk_id",
    "q_embed_values": "SELECT chunk_id, md5(coalesce(text, '')) AS digest, CAST(length(coalesce(text, '')) AS BIGINT) AS length, CAST(0 AS INTEGER) AS broken, 'lengths' AS embedding_model FROM embedded_chunk",
    "q_stream_new_keys": "SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL",
    "q_embedding_batches": "SELECT CAST(floor((rn - 1) / 50) AS BIGINT) AS batch, count(*) AS chunks, min(chunk_id) AS first FROM (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) AS rn FROM (SELECT DISTINCT chunk_id FROM embedded_chunk WHERE chunk_id IS NOT NULL)) GROUP BY 1",
    "q_tier_places": "SELECT tier, journal, total, CAST(list_position(['tier1', 'tier2', 'tier3', 'UNKNOWN'], tier) AS INTEGER) AS place FROM (SELECT coalesce(d.tier, 'UNKNOWN') AS tier, m.journal, count(*) AS total FROM metadata_all m LEFT JOIN journal_dim d ON d.journal = m.journal GROUP BY ALL)",
}


def leaf(j: str, target: str) -> str:
    number = f"WHEN json_type({j}) IN ('UBIGINT', 'BIGINT') THEN 'PMC' || CAST({j} AS VARCHAR) " if target == "pmcid" else ""
    return f"(CASE WHEN {j} IS NULL OR json_type({j}) = 'NULL' THEN NULL WHEN json_type({j}) = 'VARCHAR' THEN {j}->>'$' {number}ELSE CAST({j} AS VARCHAR) END)"


def led(target: str) -> str:
    """The text that a JSON value ``v`` gives a target: the main part of an object, one text of a list."""
    meaning = MEANING.replace("WHEN k ", "WHEN n ").replace("lower(replace(k,", "lower(replace(n,")
    own = f"list_filter(json_keys(x), lambda n: {meaning} = {text(meaning_of(target))})[1]"
    main = "list_filter(['value', 'text', 'title', 'y'], lambda n: list_contains(json_keys(x), n))[1]"
    part = f"json_extract(x, '$.\"' || coalesce({own}, {main}) || '\"')"
    one = f"(CASE WHEN json_type(x) = 'OBJECT' AND coalesce({own}, {main}) IS NOT NULL THEN {leaf(part, target)} ELSE {leaf('x', target)} END)"
    items = f"list_filter(list_transform(CAST(v AS JSON[]), lambda x: {one}), lambda t: t <> '')"
    if target in JOINED:
        sep = JOINED[target]
        many = f"array_to_string(list_transform({items}, lambda t, i: CASE WHEN i = len({items}) THEN t WHEN ends_with(t, {text(sep.strip())}) THEN t || {text(sep[-1])} ELSE t || {text(sep)} END), '')"
    else:
        many = f"list_transform(list_filter(CAST(v AS JSON[]), lambda x: json_type(x) <> 'NULL'), lambda x: {one})[1]"
    return f"CASE WHEN json_type(v) = 'ARRAY' THEN nullif({many}, '') ELSE list_transform([v], lambda x: {one})[1] END"


def flagged(x: str) -> str:
    return f"(CASE WHEN lower(trim({x})) IN ('true', 'y', 'yes', '1') THEN true WHEN lower(trim({x})) IN ('false', 'n', 'no', '0') THEN false END)"


MORE["p4_targets"] = (
    f"WITH {OBJECTS}, keyed AS (SELECT line_id, o, unnest(json_keys(o)) AS k FROM objects), meant AS (SELECT line_id, k, json_extract(o, '$.\"' || k || '\"') AS v, {MEANING} AS m FROM keyed), "
    "given AS (" + " UNION ALL ".join(f"SELECT line_id, {text(t)} AS target, k, {led(t)} AS given FROM meant WHERE m = {text(meaning_of(t))}" for t in TARGETS) + "), "
    "taken AS (SELECT line_id, target, first(given ORDER BY k <> target, k) AS given FROM given WHERE given IS NOT NULL GROUP BY line_id, target) "
    "SELECT r.line_id, r.feed, r.file_seq, " + ", ".join((flagged(f"max(given) FILTER (target = {text(t)})") if kind == "boolean" else f"max(given) FILTER (target = {text(t)})") + f" AS {t}" for t, kind in TARGETS.items())
    + " FROM objects JOIN metadata_raw r USING (line_id) LEFT JOIN taken USING (line_id) GROUP BY 1, 2, 3"
)
