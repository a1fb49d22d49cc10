"""Articles, keys, gates, statistics, sources and sinks on small rows with nulls, ties and clashing names."""

import json

import pytest
from pyspark.sql import functions as F

from inkwell.operators import articles, embed, relevance, stats
from inkwell.plans import pipelines
from inkwell.sources import jsonl, rest, sinks, text
from inkwell.streaming import incremental


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_pages_to_articles(spark):
    page = {"resultList": {"result": [{"id": "1", "source": "MED", "title": "T", "isOpenAccess": "Y", "pubType": "preprint"}, {"id": "", "source": "MED", "journalTitle": ""}]}, "hitCount": 2}
    df = spark.createDataFrame([(json.dumps(page),), ("no json",), (None,), ("{}",)], "value string")
    got = rows(articles.to_articles(articles.pages_to_results(df), "http://x").select("id", "is_open_access", "is_preprint", "europe_pmc_url", "journal"), F.col("id").desc())
    assert got == [("1", True, True, "http://x/MED/1", None), ("", False, False, None, None)]


def test_lite_backfill_takes_the_last(spark):
    core = spark.createDataFrame([("1", "", None), ("2", "J", "t"), ("3", None, None)], "id string, journalTitle string, pubType string")
    lite = spark.createDataFrame([("1", "old", "a", 1), ("1", "new", "b", 2), (None, "x", "x", 3)], "id string, journalTitle string, pubType string, n int")
    assert rows(articles.lite_backfill(core, lite, "n").select("id", "journalTitle", "pubType"), "id") == [("1", "new", "b"), ("2", "J", "t"), ("3", None, None)]


def test_backfill(spark):
    old = spark.createDataFrame([("PMC1", None, None)], "pmcid string, pmid string, id string")
    new = spark.createDataFrame([("PMC1", "5", "5", 1), (None, "5", "5", 2), ("", "5", "6", 3), (None, None, "", 4), (None, None, "7", 5)], "pmcid string, pmid string, id string, n int")
    assert [r[1] for r in rows(articles.backfill(new, old, "n").select("key", "n"))] == [5, 2]


def test_first_and_last_per_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("", 3), (None, 4), ("b", 5)], "k string, n int")
    assert rows(articles.last_per_key(df, "k", "n")) == [("a", 2), ("b", 5)]
    assert rows(articles.first_per_key(df, "k", "n")) == [("", 3), ("a", 1), ("b", 5)]
    assert articles.last_per_key(df.limit(0), "k", "n").count() == 0


def test_without_year_keeps_rows_without_one(spark):
    df = spark.createDataFrame([("2020",), (None,), ("2021",)], "y string")
    assert articles.without_year(df, "y", "2020").count() == 2


def test_gate_and_tiers(spark):
    df = spark.createDataFrame([(" Gut ", "p1"), ("Science", "p1"), ("Science", "p2"), (None, None), ("Nature Methods", "")], "journal string, pmcid string")
    ids = spark.createDataFrame([("p1",), ("p1",), ("",), (None,)], "pmcid string")
    got = relevance.with_mark(df, ids, "pmcid").withColumn("tier", relevance.pilot_tier("journal"))
    assert sorted((r["tier"], r["keyword_relevant"], r["kept"]) for r in got.withColumn("kept", relevance.gate()).collect()) == [(1, True, True), (2, False, True), (3, False, False), (3, False, False), (3, True, True)]


def test_rollup_has_zero_rows_and_recomputed_shares(spark):
    dim = spark.createDataFrame([("A", ["1"], "Tier 1"), ("B", ["2", "3"], "Tier 1"), ("C", [], None)], "journal string, issns array<string>, tier string")
    df = spark.createDataFrame([("A", True)] * 1 + [("A", False)] * 2 + [("B", True), ("Z", True), (None, True)], "journal string, oa boolean")
    by = stats.oa_by_journal(df, dim, F.col("oa"))
    assert [tuple(r) for r in stats.tier_rollup(by).select("tier", "total", "oa", "oa_percent").collect()] == [("Tier 1", 4, 2, 50.0), ("Tier 2", 0, 0, 0.0), ("Tier 3", 0, 0, 0.0), ("UNKNOWN", 0, 0, 0.0), ("ALL", 4, 2, 50.0)]
    assert [r["journal"] for r in stats.ranked(by).collect()] == ["B", "A", "C"]


def test_full_chunks_presence(spark):
    docs = spark.createDataFrame([("PMC1", 2019, "a b c"), ("PMC2", 2019, " "), ("PMC3", 2019, "x")], "pmcid string, year int, text string")
    meta = spark.createDataFrame([("PMC1", 2019, "T1"), ("PMC2", 2019, "T2"), ("PMC4", 1999, "T4"), ("PMC3", None, "T3")], "pmcid string, year int, title string").withColumns({"journal": F.lit("J"), "abstract": F.lit(None).cast("string"), "keywords": F.lit("")})
    got = rows(pipelines.chunk_full(docs, meta, target=5, overlap=1).select("chunk_id"))
    assert got == [("2019_PMC1_0001",), ("2019_PMC2_META_0001",), ("2019_PMC3_0001",), ("UNKNOWN_YEAR_PMC3_META_0001",)]
    assert len(rows(pipelines.chunk_full(docs, meta, target=5, overlap=1, dedupe_unknown=True).select("chunk_id"))) == 3
    assert pipelines.chunk_full(docs.limit(0), meta).count() == 0


def test_pilot_counts_gated_files_as_present(spark):
    docs = spark.createDataFrame([("PMC1", 2019, "a b"), ("PMC2", 2019, "c")], "pmcid string, year int, text string")
    meta = spark.createDataFrame([("PMC1", 2019, "T", "Gut"), ("PMC2", 2019, "T", "Science"), ("PMC3", 2019, "T", "Science"), ("PMC4", 2019, "T", "Gut"), ("PMC5", 2018, "T", "Gut")], "pmcid string, year int, title string, journal string").withColumns({"abstract": F.lit("A"), "keywords": F.lit(None).cast("string")})
    ids = spark.createDataFrame([("PMC3",)], "pmcid string")
    got = pipelines.chunk_pilot(docs, meta, ids, year=2019, target=10, overlap=2)
    assert rows(got.select("pmcid", "source_type")) == [("PMC1", "fulltext"), ("PMC3", "metadata_only"), ("PMC4", "metadata_only")]


XML = "<article xmlns='u'><front><article-title>A &amp;lt; title</article-title><abstract>One</abstract></front><body><p>body p</p><sec><title>Results</title><p>x <i>y</i> z</p><list><list-item>li</list-item></list></sec><sec><title>References</title><sec><p>gone</p></sec></sec><sec><title>Preferences</title><p>pref</p></sec></body><back><p>back</p></back></article>"


def test_build_corpus_variants(spark):
    found = spark.createDataFrame([("1", "MED", "PMC1", "y"), ("2", "MED", "PMC2", "Y"), ("3", "MED", "PMC3", "Y"), ("4", "MED", None, "N")], "id string, source string, pmcid string, isOpenAccess string")
    for name in ("pmid", "doi", "title", "abstractText", "journalTitle", "pubYear", "authorString", "pubType", "isPreprint"):
        found = found.withColumn(name, F.lit(None).cast("string"))
    xml = spark.createDataFrame([("PMC1", XML), ("PMC2", XML), ("PMC3", "<!DOCTYPE html><p>&nbsp;")], "pmcid string, xml string")
    v2 = {r["id"]: r for r in pipelines.build_corpus(found, xml, variant="v2").collect()}
    assert v2["1"]["clean_text"] == "A < title\n\nOne\n\nbody p\n\nResults\n\nx y z\n\nli\n\nback"
    assert v2["3"]["clean_text"] is None and v2["4"]["txt_path"] is None and v2["1"]["txt_path"] == "corpus/unknown/PMC1.txt"
    v1 = {r["id"]: r for r in pipelines.build_corpus(found, xml, variant="v1").collect()}
    assert len(pipelines.build_corpus(found.unionByName(found), xml, variant="v1").collect()) == 8
    nameless = pipelines.build_corpus(found.withColumn("id", F.lit(None).cast("string")), xml, variant="v1").where("has_full_text").collect()
    assert [r["pmcid"] for r in nameless] == ["PMC2", "PMC3"][: len(nameless)] and nameless[0]["clean_text"]
    assert not v1["1"]["has_full_text"] and v1["2"]["has_full_text"] and v1["2"]["text_path"] == "corpus/unknown/PMC2.txt"
    old = spark.createDataFrame([("PMC1", None, None)], "pmcid string, pmid string, id string")
    assert {r["id"] for r in pipelines.build_corpus(found, xml, variant="v2-backfill", existing=old).collect()} == {"2", "3", "4"}


def test_jsonl_tolerances(spark, tmp_path):
    lines = ['{"record": {"pmcid": "PMC1", "pmcid": "PMC2"}}', "", "{broken", "[1]", '{"pmcid": "PMC3", "pub_year": "2020"}', '{"a": {"b": 1}, "pub_year": 2020}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    raw = jsonl.raw_lines(spark, str(tmp_path))
    assert rows(jsonl.tolerant(raw).select(jsonl.field("pmcid").alias("p")), F.col("p").asc_nulls_last()) == [("PMC2",), ("PMC3",), (None,)]
    kept = jsonl.verbatim(raw, ~jsonl.field("pub_year").eqNullSafe(F.lit("2020")))
    assert sorted(r["value"] for r in kept.collect()) == sorted(lines[:4])
    assert jsonl.raw_lines(spark, str(tmp_path / "none"), missing_ok=True).count() == 0
    with pytest.raises(Exception):
        jsonl.strict(spark, str(tmp_path), "pmcid string").collect()
    assert jsonl.known_ids(spark, str(tmp_path / "none"), "chunk_id").count() == 0


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "c" / "2019").mkdir(parents=True)
    for n, t in (("pmc2.TXT", "two\nlines"), ("1.txt", "one"), ("x.xml", "no")):
        (tmp_path / "c" / "2019" / n).write_text(t)
    got = text.fulltext_files(spark, str(tmp_path / "c"))
    assert rows(got.select("year", "pmcid", "text"), "pmcid") == [(2019, "PMC1", "one"), (2019, "PMC2", "two\nlines")]
    assert rows(text.fulltext_files(spark, str(tmp_path / "c"), most_per_year=1).select("pmcid")) == [("PMC1",)]
    assert text.fulltext_files(spark, str(tmp_path / "none"), missing_ok=True).count() == 0
    out = str(tmp_path / "years")
    sinks.write_by_year(spark.createDataFrame([(2019, "a"), (2020, "b"), (None, "u")], "year int, v string"), out, order=["v"])
    sinks.write_by_year(spark.createDataFrame([(2020, "c")], "year int, v string"), out)
    assert sorted(r["v"] for r in spark.read.json(out).collect()) == ["a", "c", "u"]
    sinks.write_metadata(spark.createDataFrame([("é", True), ("b", False)], "t string, matches_keywords boolean"), str(tmp_path / "all"), str(tmp_path / "kw"))
    assert spark.read.json(str(tmp_path / "all")).count() == 2 and spark.read.json(str(tmp_path / "kw")).count() == 1
    sinks.write_csv(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["a"]
    assert [r[0] for r in sinks.display_lines(spark.createDataFrame([("abcdef", 1)], "a string, b int"), {"a": (4, False), "b": (3, True)}).collect()] == ["abc…   1"]


def test_search_pages_and_full_text():
    asked = []

    def transport(url, timeout):
        asked.append(url)
        cursor = url.split("cursorMark=")[1].split("&")[0]
        if len(asked) == 1:
            return 503, ""
        found = {"%2A": (["1", "2"], "n1"), "n1": (["3"], "n2"), "n2": ([], "n2")}[cursor]
        return 200, json.dumps({"resultList": {"result": [{"id": i} for i in found[0]]}, "hitCount": 9, "nextCursorMark": found[1]})

    assert [r["id"] for r in rest.pages("http://x", "q", transport, wait=0)] == ["1", "2", "3"]
    assert [r["id"] for r in rest.pages("http://x", "q", transport, most=1, wait=0)] == ["1"]
    with pytest.raises(ValueError):
        rest.hit_count("http://x", "q", lambda *_: (404, ""))
    assert rest.full_text("{pmcid}", "P", lambda *_: (200, " <HTML>")) is None
    assert rest.full_text("{pmcid}", "P", lambda *_: (200, " <HTML>"), refuse_html=False) == " <HTML>"
    assert rest.full_text("{pmcid}", "P", lambda *_: (404, "")) is None
    assert 'ISSN:"1-X" OR ISSN:"2"' in rest.base_query(issns=[" 2", "1-x", "2", " "])
    with pytest.raises(ValueError):
        rest.base_query(issns=[" "])
    assert rest.with_years("q", 2019) == "(q) AND PUB_YEAR:2019"


def test_retry_rules():
    answers = [(404, ""), (500, ""), (200, "ok")]
    ask = lambda url, timeout: answers.pop(0)
    assert rest.fetch("http://x", ask, wait=0, retry_all=True) == "ok"
    with pytest.raises(TimeoutError):
        rest.fetch("http://x", lambda *_: (503, ""), wait=0)


def test_connection_is_kept_and_opened_again():
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"
        ports = []

        def do_GET(self):
            self.ports.append(self.client_address[1])
            self.send_response(404 if "none" in self.path else 200)
            self.send_header("Content-Length", "2")
            self.end_headers()
            self.wfile.write(b"ok")
            self.close_connection = "close" in self.path

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask, at = rest.PooledTransport(), f"http://127.0.0.1:{server.server_port}"
    assert [ask(f"{at}/{p}", 5) for p in ("a?x=1", "none", "close", "b")] == [(200, "ok"), (404, "ok"), (200, "ok"), (200, "ok")]
    assert len(set(Handler.ports[:3])) == 1 and Handler.ports[3] != Handler.ports[0]
    server.shutdown()


def test_full_texts(spark):
    from inkwell.sources.local_index import numbered_texts

    own = spark.createDataFrame([("PMC3",), ("PMC3",), ("PMC2",), ("PMC1",), ("PMC0",), (None,), ("",)], "pmcid string")
    assert [r["pmcid"] for r in rest.full_texts(own, "http://x/{pmcid}", variant="v1", transport=numbered_texts, wait=0).collect()] == ["PMC3"]
    assert sorted(r["pmcid"] for r in rest.full_texts(own, "http://x/{pmcid}", transport=numbered_texts, wait=0).collect()) == ["PMC2", "PMC3"]


def test_byte_pair_counts(spark, tmp_path):
    pytest.importorskip("tiktoken")
    import base64

    from inkwell.functions import tokens

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257}
    (tmp_path / "v").write_text("\n".join(f"{base64.b64encode(t).decode()} {r}" for t, r in ranks.items()))
    df = spark.createDataFrame([("abcab a",), ("",), (None,)], "text string")
    got = tokens.with_token_count(df, "text", "own", tokens.byte_pair_counter(str(tmp_path / "v"), r" ?[a-z]+"))
    assert sorted(r["tokens"] for r in got.collect()) == [0, 0, 4] and {r["tokenizer"] for r in got.collect()} == {"own"}


def test_batch_numbers(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(120)], "k string")
    got = {r["k"]: r["batch"] for r in embed.numbered(df, "k", 50).collect()}
    assert got == {f"k{i:03d}": i // 50 for i in range(120)} and embed.numbered(df.limit(0), "k", 50).count() == 0


def test_search_source(spark):
    class Offline(rest.SearchSource):
        transport = staticmethod(lambda url, timeout: (200, json.dumps({"resultList": {"result": [{"id": "1"}]}, "hitCount": 1, "nextCursorMark": "x"})))

    spark.dataSource.register(Offline)
    got = spark.read.format("literature_search").option("address", "http://x").option("query", "q").option("first", 2019).option("last", 2020).load()
    assert rows(got) == [(2019, '{"id": "1"}'), (2020, '{"id": "1"}')]


def test_embedding(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "x\ny"), ("b", None), ("b", None)], "chunk_id string, text string")
    got = embed.embed_chunks(chunks, embed.hashed_provider, "m", batch=2).collect()
    assert [r["text"] for r in got if r["chunk_id"] == "a"] == ["x\ny"] and {len(r["embedding"]) for r in got} == {16}
    assert articles.not_embedded(chunks, spark.createDataFrame([("a",), (None,)], "chunk_id string")).count() == 2
    target = str(tmp_path / "v")
    run = lambda df: embed.embed_chunks(df, embed.hashed_provider, "m")
    incremental.resume_embedding(chunks.limit(1), target, run)
    incremental.resume_embedding(chunks, target, run)
    incremental.resume_embedding(chunks, target, run)
    assert spark.read.parquet(target).count() == 3
    tries = []

    def flaky(texts):
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return [[0.0]]

    assert embed.retried(flaky, most_wait=0)(["x"]) == [[0.0]]


def test_manifest_and_streams(spark, tmp_path):
    done = str(tmp_path / "done")
    years = spark.createDataFrame([(2019,), (2020,), (None,)], "year int")
    for part in incremental.PARTS:
        incremental.mark_done(years.where("year = 2019"), done, part)
    incremental.mark_done(years.where("year = 2020"), done, "stats")
    assert rows(incremental.open_years(years, done)) == [(None,), (2020,)]
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    args = (spark, str(source), "k string, v int", target, str(tmp_path / "cp"), "k")
    (source / "1.json").write_text('{"k": "a", "v": 1}\n{"k": "a", "v": 1}\n{"v": 3}\n')
    incremental.stream_new_keys(*args)
    incremental.stream_new_keys(*args)
    (source / "2.json").write_text('{"k": "a", "v": 9}\n{"k": "b", "v": 2}\n')
    incremental.stream_new_keys(*args)
    assert rows(spark.read.parquet(target)) == [("a", 1), ("b", 2)]
