"""For each query of the core that SQL can express, the same result in DuckDB's SQL."""

from __future__ import annotations

from inkwell.functions.vocab import KEYWORD_SETS, PILOT_TIERS, SKIPPED_SECTIONS_V1, SKIPPED_SECTIONS_V2
from inkwell.operators.schema_drift import FAMILIES

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def words(x: str) -> str:
    return f"(CASE WHEN {collapse(x)} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({collapse(x)}, ' ') END)"


def truthy(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(CAST({x} AS VARCHAR), '')" for x in xs) + ")"


def has_any(terms: list[str], x: str) -> str:
    return "(" + " OR ".join(f"contains({x}, {text(t)})" for t in terms) + ")"


def norm_pmcid(x: str) -> str:
    up = f"regexp_replace(upper({strip(f'coalesce({x}, {text(str())})')}), '\\.TXT$', '')"
    return f"(CASE WHEN regexp_matches({up}, '^\\p{{Nd}}+$') THEN 'PMC' || {up} ELSE {up} END)"


def year_full(x: str) -> str:
    return f"CAST(nullif(regexp_extract({x}, '(19|20)[0-9]{{2}}'), '') AS INTEGER)"


def year_pilot(x: str) -> str:
    return f"(CASE WHEN regexp_matches({strip(x)}, '^[+-]?[0-9]+$') THEN TRY_CAST({strip(x)} AS INTEGER) END)"


def percent(part: str, whole: str, digits: int = 2) -> str:
    return f"(CASE WHEN {whole} > 0 THEN round({part} * 100.0::DOUBLE / {whole}, {digits}) ELSE 0.0::DOUBLE END)"


HAY = "lower(coalesce(title, '') || ' ' || coalesce(abstract, ''))"
KW = {n: has_any(t, HAY) for n, t in KEYWORD_SETS.items()}
BASE_V1 = "coalesce(nullif(pmcid, ''), 'PMID_' || nullif(pmid, ''), 'ID_' || nullif(id, ''))"
BASE_V2 = f"regexp_replace(coalesce(nullif(pmcid, ''), nullif(id, ''), 'unknown_' || substr(sha256(coalesce(doi, '') || chr(31) || coalesce(title, '')), 1, 8)), '[^A-Za-z0-9_.-]+', '_', 'g')"
TAGGED = "coalesce('PMCID:' || nullif(pmcid, ''), 'PMID:' || nullif(pmid, ''), 'ID:' || nullif(id, ''))"
NORM_V2 = collapse("coalesce(text, '')")
NORM_V1 = (
    "regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(coalesce(text, ''), '" + WS + "+', ' ', 'g'), '\\[[0-9,\\-–  ]+\\]', '', 'g')), "
    "'^([A-Za-z]+)([A-Z])', '\\1 \\2', 'g'), '([.!?])([A-Z]{2,})([A-Z][a-z])', '\\1 \\2 \\3', 'g')"
)
#: The index: last record of each normalized PMCID, the id standing in for a missing one.
KEYED = norm_pmcid("coalesce(nullif(pmcid, ''), nullif(id, ''))")
INDEX = f"idx AS (SELECT * EXCLUDE (pmcid, k, rn), k AS pmcid, {year_full('pub_year')} AS year FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rec_no DESC) AS rn FROM (SELECT *, {KEYED} AS k FROM metadata_all) WHERE k <> '') WHERE rn = 1)"
PARAS_PILOT = f"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n{WS}*\\n+'), lambda p: {strip('p')}), lambda p: p <> '')"


def paras_full(x: str) -> str:
    lines = f"regexp_replace(coalesce({x}, ''), '\\r\\n?', chr(10), 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({strip(lines)}, '\\n{WS}*\\n+'), lambda p: {collapse('p')}), lambda p: p <> '')"


def cut(w: str, target: int) -> str:
    return f"list_transform(range(0, CAST(ceil(len({w}) / {target}.0) AS BIGINT)), lambda i: array_to_string({w}[CAST(i * {target} + 1 AS BIGINT) : CAST(i * {target} + {target} AS BIGINT)], ' '))"


def fold(paras: str, target: int, huge: int, overlap: int | None) -> str:
    w = words("p")
    n = f"CAST(len({w}) AS BIGINT)"
    closed = "(CASE WHEN len(s.open) > 0 THEN list_append(s.done, array_to_string(s.open, chr(10) || chr(10))) ELSE s.done END)"
    if overlap is None:
        head, held = "[p]", n
    else:
        last = words("s.open[-1]")
        bridge = f"(CASE WHEN len({last}) > {overlap} THEN '[...] ' || array_to_string({last}[-{overlap}:], ' ') ELSE s.open[-1] END)"
        head, held = f"[{bridge}, p]", f"CAST(len({words(bridge)}) AS BIGINT) + {n}"
    state = lambda d, o, h: f"{{'done': {d}, 'open': {o}, 'held': CAST({h} AS BIGINT)}}"
    none = "CAST([] AS VARCHAR[])"
    step = f"CASE WHEN {n} > {huge} THEN {state(f'list_concat({closed}, {cut(w, target)})', none, 0)} WHEN len(s.open) = 0 OR s.held + {n} <= {target} THEN {state('s.done', 'list_append(s.open, p)', f's.held + {n}')} ELSE {state(closed, head, held)} END"
    folded = f"list_reduce({paras}, lambda s, p: {step}, {state(none, none, 0)})"
    return f"(SELECT {closed} FROM (SELECT {folded} AS s))"


def chunk_rows(chunks: str) -> str:
    return f"SELECT doc_id, coalesce(CAST(pub_year AS VARCHAR), 'UNKNOWN_YEAR') || '_' || coalesce(pmcid, '') || '_' || lpad(CAST(i AS VARCHAR), 4, '0') AS chunk_id, CAST(i AS INTEGER) AS chunk_index, md5(chunks[i]) AS digest FROM (SELECT doc_id, pub_year, pmcid, chunks, unnest(range(1, len(chunks) + 1)) AS i FROM (SELECT doc_id, pub_year, pmcid, {chunks} AS chunks FROM documents))"


def para_rows(paras: str) -> str:
    return f"SELECT doc_id, CAST(i AS INTEGER) AS paragraph, md5(ps[i + 1]) AS digest FROM (SELECT doc_id, ps, unnest(range(0, len(ps))) AS i FROM (SELECT doc_id, {paras} AS ps FROM documents))"


PLAIN_PAYLOAD = f"concat_ws(chr(10) || chr(10), nullif({strip(truthy('title'))}, ''), nullif({strip(truthy('abstract'))}, ''), 'Keywords: ' || nullif({strip(truthy('pub_type'))}, ''))"
WHERE_WHEN = f"nullif(concat_ws(', ', nullif(journal, ''), CAST({year_pilot('pub_year')} AS VARCHAR)), '')"
LABELLED = f"concat_ws(chr(10) || chr(10), 'Title: ' || nullif(title, ''), 'Journal / Year: ' || {WHERE_WHEN}, 'Abstract: ' || nullif(abstract, ''), 'Keywords: ' || nullif(pub_type, ''))"
COMBINED = (
    f"WITH {INDEX}, docs AS (SELECT pmcid, pub_year AS year, text FROM documents WHERE pmcid IS NOT NULL), "
    f"present AS (SELECT DISTINCT year, pmcid FROM docs WHERE {strip('coalesce(text, chr(32))')} <> ''), spine AS (SELECT DISTINCT year FROM docs WHERE year IS NOT NULL), "
    f"full_rows AS (SELECT d.year, d.pmcid, i.title, 'fulltext' AS source_type, {fold(paras_full('d.text'), 200, 200, 40)} AS chunks FROM docs d LEFT JOIN idx i ON d.pmcid = i.pmcid), "
    f"rest AS (SELECT i.year, i.pmcid, i.title, 'metadata_only' AS source_type, {fold(paras_full(strip(PLAIN_PAYLOAD)), 200, 200, 40)} AS chunks FROM idx i WHERE "
    "(i.year IN (SELECT year FROM spine) AND NOT EXISTS (SELECT 1 FROM present p WHERE p.year = i.year AND p.pmcid = i.pmcid)) OR (i.year IS NULL AND EXISTS (SELECT 1 FROM spine))), "
    "chunked AS (SELECT year, pmcid, title, source_type, unnest(chunks) AS text FROM (SELECT * FROM full_rows UNION ALL SELECT * FROM rest)) "
)
TOKENS = f"CAST(len({words('text')}) AS BIGINT)"
STATS = f"by_year AS (SELECT year, source_type, count(DISTINCT pmcid) AS articles, count(*) AS chunks, CAST(sum(tokens) AS BIGINT) AS tokens_total, CAST(count(*) FILTER (tokens > 190) AS BIGINT) AS chunks_over_limit, CAST(floor(sum(tokens) / count(*)) AS BIGINT) AS avg_tokens FROM (SELECT *, {TOKENS} AS tokens FROM chunked) GROUP BY year, source_type) "


def global_columns() -> str:
    out = ["count(DISTINCT year) AS years_processed"]
    for name, kind in (("fulltext", "fulltext"), ("meta_only", "metadata_only")):
        of = lambda c, kind=kind: f"CAST(coalesce(sum({c}) FILTER (year IS NOT NULL AND source_type = '{kind}'), 0) AS BIGINT)"
        out += [f"{of('articles')} AS articles_{name}", f"{of('chunks')} AS chunks_{name}", f"{of('tokens_total')} AS tokens_{name}_total", f"{of('chunks_over_limit')} AS chunks_{name}_over_soft_limit"]
        out.append(f"CAST(CASE WHEN {of('chunks')} > 0 THEN floor({of('tokens_total')} / {of('chunks')}) ELSE 0 END AS BIGINT) AS avg_tokens_per_chunk_{name}")
    for name, c in (("articles", "articles"), ("chunks", "chunks"), ("tokens_total", "tokens_total"), ("chunks_over_soft_limit", "chunks_over_limit")):
        out.append(f"CAST(coalesce(sum({c}) FILTER (year IS NULL), 0) AS BIGINT) AS unknown_year_{name}")
    return ", ".join(out)


OA = f"oa AS (SELECT coalesce(d.tier, 'UNKNOWN') AS tier, d.journal, array_to_string(d.issns, ';') AS issns, coalesce(n.total, 0) AS total, coalesce(n.oa, 0) AS oa, {percent('coalesce(n.oa, 0)', 'coalesce(n.total, 0)')} AS oa_percent FROM journal_dim d LEFT JOIN (SELECT journal, count(*) AS total, count(*) FILTER (is_open_access) AS oa FROM metadata_all GROUP BY journal) n ON d.journal = n.journal)"
SKIP_V1 = "regexp_replace(%s, '[^a-z\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', '', 'g') IN (" + ", ".join(map(text, SKIPPED_SECTIONS_V1)) + ")"
LINE = f"lower({strip('coalesce(string_split(text, chr(10))[1], chr(32))')})"
PILOT_TIER = "CASE " + " ".join(f"WHEN {strip('journal')} IN ({', '.join(map(text, names))}) THEN {tier}" for tier, names in PILOT_TIERS.items()) + " ELSE 3 END"
HTML = lambda x: f"(SELECT starts_with(h, '<!doctype html') OR starts_with(h, '<html') FROM (SELECT lower(substr(regexp_replace({x}, '^{WS}+', ''), 1, 200)) AS h))"
#: Object lines of metadata_raw, out of a wrapper of one key.
OBJECTS = "objects AS (SELECT line_id, CASE WHEN len(json_keys(j)) = 1 AND json_type(j, '$.\"' || json_keys(j)[1] || '\"') = 'OBJECT' THEN json_extract(j, '$.\"' || json_keys(j)[1] || '\"') ELSE j END AS o FROM (SELECT line_id, TRY_CAST(raw AS JSON) AS j FROM metadata_raw) WHERE j IS NOT NULL AND json_type(j) = 'OBJECT')"

SQL: dict[str, str] = {
    "q_article_projection": "SELECT id, source, pmid, pmcid, doi, title, abstract, nullif(journal, '') AS journal, pub_year, author_string, coalesce(is_open_access, false) AS is_open_access, nullif(pub_type, '') AS pub_type, coalesce(pub_type = 'preprint', false) OR coalesce(is_preprint, false) AS is_preprint, 'https://lit.example/' || nullif(source, '') || '/' || nullif(id, '') AS europe_pmc_url FROM metadata_all",
    "q_metadata_record": f"SELECT id, abstract IS NOT NULL AS has_full_text, CAST(NULL AS VARCHAR) AS xml_path, CASE WHEN abstract IS NOT NULL THEN 'corpus/' || coalesce(pub_year, 'unknown') || '/' || {BASE_V1} || '.txt' END AS text_path, {has_any(KEYWORD_SETS['v1'], HAY)} AS matches_keywords FROM metadata_all",
    "q_norm_pmcid": f"SELECT rec_no, {norm_pmcid('pmcid')} AS pmcid FROM metadata_all",
    "q_base_ids": f"SELECT rec_no, {BASE_V1} AS v1, {BASE_V2} AS v2, {TAGGED} AS tagged FROM metadata_all",
    "q_output_path": f"SELECT rec_no, 'corpus/' || coalesce(CAST({year_full('pub_year')} AS VARCHAR), 'unknown') || '/' || {BASE_V2} || '.txt' AS path FROM metadata_all",
    "q_normalize_v1": f"SELECT doc_id, md5({NORM_V1}) AS digest FROM documents",
    "q_normalize_v2": f"SELECT doc_id, md5({NORM_V2}) AS digest FROM documents",
    "q_year_parse": f"SELECT rec_no, {year_pilot('pub_year')} AS pilot, {year_full('pub_year')} AS \"full\" FROM metadata_all",
    "q_keyword_flag": "SELECT doc_id, " + ", ".join(f"{has_any(t, 'lower(coalesce(text, chr(32)))')} AS {n}" for n, t in KEYWORD_SETS.items()) + " FROM documents",
    "q_html_sniff": f"SELECT doc_id, {HTML('coalesce(text, chr(32))')} AS plain, {HTML('chr(32) || chr(10) || ' + text('<!DOCTYPE HTML>') + ' || coalesce(text, chr(32))')} AS page FROM documents",
    "q_section_titles": f"SELECT doc_id, {SKIP_V1 % LINE} AS v1, {has_any(SKIPPED_SECTIONS_V2, LINE)} AS v2 FROM documents",
    "q_tier_lookup_default": f"SELECT m.rec_no, coalesce(d.tier, 'UNKNOWN') AS tier, {PILOT_TIER.replace('journal,', 'm.journal,')} AS pilot_tier FROM metadata_all m LEFT JOIN journal_dim d ON m.journal = d.journal",
    "q_relevance_gate": f"WITH ids AS (SELECT DISTINCT pmcid FROM metadata_all WHERE {KW['kw1']} AND pmcid <> '') SELECT rec_no, t AS tier, k AS keyword_relevant, t IN (1, 2) OR (t = 3 AND k) AS kept FROM (SELECT m.rec_no, CAST(substr(coalesce(d.tier, 'tier3'), 5, 1) AS INTEGER) AS t, m.pmcid IS NOT NULL AND m.pmcid IN (SELECT pmcid FROM ids) AS k FROM metadata_all m LEFT JOIN journal_dim d ON m.journal = d.journal)",
    "q_lite_backfill": "WITH lite AS (SELECT id, journal, pub_type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rec_no DESC) AS rn FROM metadata_all WHERE id <> '') WHERE rn = 1) SELECT m.rec_no, coalesce(nullif(CASE WHEN m.source = 'PPR' THEN '' ELSE m.journal END, ''), nullif(l.journal, '')) AS \"journalTitle\", coalesce(nullif(CASE WHEN m.is_open_access THEN m.pub_type END, ''), nullif(l.pub_type, '')) AS \"pubType\" FROM metadata_all m LEFT JOIN lite l ON m.id = l.id",
    "q_last_wins_index": f"WITH {INDEX} SELECT pmcid, rec_no, title FROM idx",
    "q_meta_missing_pilot": f"WITH {INDEX} SELECT pmcid, rec_no FROM idx WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.pmcid = idx.pmcid)",
    "q_meta_missing_full": f"WITH {INDEX} SELECT pmcid, rec_no FROM idx WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.pmcid = idx.pmcid AND d.pub_year = idx.year AND {strip('coalesce(d.text, chr(32))')} <> '')",
    "q_backfill_dedupe": f"WITH k AS (SELECT rec_no, batch_no, {TAGGED} AS key FROM metadata_all) SELECT min(rec_no) AS rec_no, key FROM k WHERE batch_no > 2 AND key IS NOT NULL AND key NOT IN (SELECT key FROM k WHERE batch_no <= 2 AND key IS NOT NULL) GROUP BY key",
    "q_embedding_resume": "SELECT chunk_id, embedding_model FROM embedded_chunk c WHERE NOT EXISTS (SELECT 1 FROM embedded_chunk e WHERE e.chunk_id = c.chunk_id AND e.embedding IS NOT NULL AND e.embedding_model = 'lit-embed-64')",
    "q_first_n_per_year": "SELECT pub_year, doc_id FROM (SELECT pub_year, doc_id, row_number() OVER (PARTITION BY pub_year ORDER BY added_at NULLS FIRST, doc_id) AS rn FROM documents WHERE pub_year IS NOT NULL) WHERE rn <= 5",
    "q_first_years": "SELECT pub_year, count(*) AS documents FROM documents WHERE pub_year IN (SELECT DISTINCT pub_year FROM documents WHERE pub_year >= 2000 ORDER BY 1 LIMIT 3) GROUP BY pub_year",
    "q_drop_year": "SELECT rec_no, pub_year FROM metadata_all WHERE pub_year IS DISTINCT FROM '2020'",
    "q_drop_year_counts": "SELECT count(*) FILTER (pub_year IS DISTINCT FROM '2020') AS kept, count(*) FILTER (pub_year = '2020') AS removed FROM metadata_all",
    "q_drop_year_lines": f"WITH {OBJECTS} SELECT r.line_id, md5(coalesce(r.raw, '')) AS digest FROM metadata_raw r LEFT JOIN objects o ON r.line_id = o.line_id WHERE o.line_id IS NULL OR (o.o->>'$.pub_year') IS DISTINCT FROM '2020'",
    "q_word_windows": f"SELECT doc_id, CAST(i + 1 AS INTEGER) AS chunk_index, md5(array_to_string(w[i * 80 + 1 : i * 80 + 100], ' ')) AS digest, CAST(len(w[i * 80 + 1 : i * 80 + 100]) AS INTEGER) AS words FROM (SELECT doc_id, w, unnest(range(0, 1 + greatest(0, CAST(ceil((len(w) - 100) / 80.0) AS BIGINT)))) AS i FROM (SELECT doc_id, {words('coalesce(text, chr(32))')} AS w FROM documents) WHERE len(w) > 0)",
    "q_paragraphs_pilot": para_rows(PARAS_PILOT),
    "q_paragraphs_full": para_rows(paras_full("text")),
    "q_chunks_pilot": chunk_rows(fold(PARAS_PILOT, 100, 150, None)),
    "q_chunks_bridge": chunk_rows(fold(paras_full("text"), 100, 100, 20)),
    "q_metadata_payload": f"SELECT rec_no, md5({strip(PLAIN_PAYLOAD)}) AS plain, md5({strip(LABELLED)}) AS labelled FROM metadata_all",
    "q_combined_chunks": COMBINED + "SELECT year, source_type, count(*) AS chunks, count(DISTINCT pmcid) AS articles, count(title) AS titled FROM chunked GROUP BY year, source_type",
    "q_chunk_stats_year": COMBINED + ", " + STATS + "SELECT * FROM by_year",
    "q_chunk_stats_global": COMBINED + ", " + STATS + f"SELECT {global_columns()} FROM by_year",
    "q_counts_year_category": f"WITH m AS (SELECT {year_full('pub_year')} AS year, coalesce(is_open_access, false) AS oa, true AS a, {KW['kw1']} AS k1, {KW['kw2']} AS k2 FROM metadata_all), n AS (SELECT year, unnest([{{'category': 'all', 'hit': a}}, {{'category': 'kw1', 'hit': k1}}, {{'category': 'kw2', 'hit': k2}}]) AS x, oa FROM m), g AS (SELECT year, x.category AS category, count(*) FILTER (x.hit) AS total, count(*) FILTER (x.hit AND oa) AS oa FROM n GROUP BY ALL) SELECT CAST(s.year AS INTEGER) AS year, s.category, coalesce(g.total, 0) AS total, coalesce(g.oa, 0) AS oa, CASE WHEN coalesce(g.total, 0) > 0 THEN CAST(g.oa AS DOUBLE) / g.total ELSE 0.0::DOUBLE END AS oa_ratio FROM (SELECT y AS year, c AS category FROM range(1990, 2026) r(y), (VALUES ('all'), ('kw1'), ('kw2')) v(c)) s LEFT JOIN g ON g.year = s.year AND g.category = s.category",
    "q_counts_journal_kw": f"SELECT d.journal, coalesce(n_all, 0) AS n_all, coalesce(n_kw1, 0) AS n_kw1, coalesce(n_kw2, 0) AS n_kw2, {percent('coalesce(n_kw1, 0)', 'coalesce(n_all, 0)', 1)} AS pct_kw1, {percent('coalesce(n_kw2, 0)', 'coalesce(n_all, 0)', 1)} AS pct_kw2 FROM journal_dim d LEFT JOIN (SELECT journal, count(*) AS n_all, count(*) FILTER ({KW['kw1']}) AS n_kw1, count(*) FILTER ({KW['kw2']}) AS n_kw2 FROM metadata_all WHERE is_open_access GROUP BY journal) n ON n.journal = d.journal",
    "q_oa_share_by_journal": f"WITH {OA} SELECT * FROM oa",
    "q_tier_rollup": f"WITH {OA}, s AS (SELECT * FROM (VALUES ('tier1', 0), ('tier2', 1), ('tier3', 2), ('UNKNOWN', 3)) v(tier, place)), n AS (SELECT s.tier, s.place, coalesce(sum(total), 0) AS total, coalesce(sum(oa), 0) AS oa FROM s LEFT JOIN oa ON oa.tier = s.tier GROUP BY ALL UNION ALL SELECT 'ALL', 4, coalesce(sum(total), 0), coalesce(sum(oa), 0) FROM oa) SELECT tier, CAST(place AS INTEGER) AS place, CAST(total AS BIGINT) AS total, CAST(oa AS BIGINT) AS oa, {percent('oa', 'total')} AS oa_percent FROM n",
    "q_display_table": f"WITH {OA} SELECT rpad(tier, 7, ' ') || ' ' || rpad(CASE WHEN length(journal) > 30 THEN substr(journal, 1, 29) || '…' ELSE journal END, 30, ' ') || ' ' || lpad(CAST(total AS VARCHAR), 8, ' ') || ' ' || lpad(CAST(oa AS VARCHAR), 8, ' ') AS line FROM oa",
    "q_run_summary": f"SELECT count(*) AS processed, count(*) FILTER (has_full_text) AS with_full_text, count(*) FILTER ({KW['kw1']}) AS keyword_matches, count(*) FILTER (is_open_access) AS oa_eligible, count(*) FILTER (is_open_access AND has_full_text) AS oa_success, count(*) FILTER (is_open_access AND NOT coalesce(has_full_text, false)) AS oa_fail FROM metadata_all",
    "q_issn_explode": "SELECT DISTINCT upper(trim(i)) AS issn, journal FROM (SELECT journal, unnest(issns) AS i FROM journal_dim) WHERE trim(i) <> ''",
    "q_issn_filter": "SELECT rec_no FROM metadata_all WHERE journal IN (SELECT journal FROM (SELECT journal, unnest(issns) AS i FROM journal_dim) WHERE upper(trim(i)) LIKE '%X')",
    "q_tolerant_lines": f"WITH {OBJECTS}, f AS (SELECT line_id, {truthy(*[f'o->>{chr(39)}$.{n}{chr(39)}' for n in ('pmcid', 'PMCID', 'pmcid_upper', 'pmcid_lower')])} AS p, o->>'$.id' AS i FROM objects) SELECT line_id, {norm_pmcid('p')} AS pmcid, {norm_pmcid('coalesce(p, nullif(i, chr(0)))')} AS with_id FROM f",
    "q_keywords_variant": f"WITH {OBJECTS}, k AS (SELECT line_id, coalesce(CASE WHEN json_type(o, '$.keywords') <> 'NULL' THEN json_extract(o, '$.keywords') END, json_extract(o, '$.keyword')) AS j FROM objects) SELECT line_id, CASE json_type(j) WHEN 'VARCHAR' THEN nullif(j->>'$', '') WHEN 'ARRAY' THEN nullif(array_to_string(list_filter(list_transform(CAST(j AS JSON[]), lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN x->>'$' WHEN json_type(x, '$.term') = 'VARCHAR' THEN x->>'$.term' WHEN json_type(x, '$.keyword') = 'VARCHAR' THEN x->>'$.keyword' WHEN json_type(x, '$.kw') = 'VARCHAR' THEN x->>'$.kw' END), lambda y: y IS NOT NULL), '; '), '') END AS keywords FROM k",
    "q_token_counts": f"SELECT doc_id, CAST(len({words('coalesce(text, chr(32))')}) AS BIGINT) AS tokens, 'whitespace-words' AS tokenizer FROM documents",
    "q_stream_available_now": "SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "q_event_props": "SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events",
    "q_embed_attach": "SELECT chunk_id, 'hashed-16' AS embedding_model, 16 AS width FROM embedded_chunk",
}

MEANING = "CASE " + " ".join(f"WHEN k IN ({', '.join(map(text, names))}) THEN 'family {i}'" for i, names in enumerate(FAMILIES)) + " ELSE 'name ' || lower(replace(k, '_', '')) END"
SQL["p4_found"] = (
    f"WITH {OBJECTS}, files AS (SELECT feed, file_seq, lag(file_seq) OVER (PARTITION BY feed ORDER BY file_seq) AS before FROM (SELECT DISTINCT feed, file_seq FROM metadata_raw)), "
    "keyed AS (SELECT r.feed, r.file_seq, o.o, unnest(json_keys(o.o)) AS k FROM objects o JOIN metadata_raw r ON r.line_id = o.line_id), "
    "typed AS (SELECT feed, file_seq, k, CASE json_type(o, '$.\"' || k || '\"') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS t FROM keyed), "
    f"f AS (SELECT feed, file_seq, k, {MEANING} AS m, list_sort(list_distinct(list(t) FILTER (t IS NOT NULL))) AS ts FROM typed GROUP BY feed, file_seq, k), "
    "gone AS (SELECT x.feed, x.file_seq, f.k, f.m, f.ts FROM files x JOIN f ON f.feed = x.feed AND f.file_seq = x.before WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.feed = x.feed AND g.file_seq = x.file_seq AND g.k = f.k)), "
    "fresh AS (SELECT x.feed, x.file_seq, f.k, f.m, f.ts FROM files x JOIN f ON f.feed = x.feed AND f.file_seq = x.file_seq WHERE x.before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f g WHERE g.feed = x.feed AND g.file_seq = x.before AND g.k = f.k)), "
    "ren AS (SELECT g.feed, g.file_seq, g.k AS a, n.k AS b, g.ts AS ta, n.ts AS tb FROM gone g JOIN fresh n ON g.feed = n.feed AND g.file_seq = n.file_seq AND g.m = n.m), "
    "kept AS (SELECT x.feed, x.file_seq, p.k AS a, q.k AS b, p.ts AS ta, q.ts AS tb FROM files x JOIN f p ON p.feed = x.feed AND p.file_seq = x.before JOIN f q ON q.feed = x.feed AND q.file_seq = x.file_seq AND q.k = p.k) "
    "SELECT feed, file_seq, a AS field_before, b AS field_after, 'renamed' AS change FROM ren "
    "UNION ALL SELECT feed, file_seq, k, '', 'removed' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.feed = g.feed AND r.file_seq = g.file_seq AND r.a = g.k) "
    "UNION ALL SELECT feed, file_seq, '', k, 'added' FROM fresh g WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.feed = g.feed AND r.file_seq = g.file_seq AND r.b = g.k) "
    "UNION ALL SELECT feed, file_seq, a, b, 'retyped' FROM (SELECT * FROM ren UNION ALL SELECT * FROM kept) WHERE len(ta) > 0 AND len(tb) > 0 AND ta <> tb"
)
