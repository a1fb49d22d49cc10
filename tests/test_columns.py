"""Tables of inputs and expected values for the scalar functions."""

import pytest
from pyspark.sql import functions as F

from inkwell.functions import columns as c
from inkwell.functions.vocab import KEYWORD_SETS, KEYWORDS_1, PILOT_TIERS, minimal_terms


def evaluate(spark, make, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(make.alias("out")).collect()]


ONE = "x string"


@pytest.mark.parametrize(
    ("make", "cases"),
    [
        (lambda: c.norm_pmcid("x"), {"pmc123.txt": "PMC123", " 123 ": "PMC123", "PMC123": "PMC123", "": "", None: ""}),
        (lambda: c.strip("x"), {"  a ": "a", "\x1ca\x85": "a", "": ""}),
        (lambda: c.collapse("x"), {"a  b\x1cc\x85d": "a b c d", " \r\n": ""}),
        (lambda: c.normalize("x", "v1"), {"foo [1, 2–3] bar": "foo  bar", "x[ ]": "x", "DNA methylation": "DN A methylation", "IntroductionBackground here": "Introduction Background here", "Aa end.ABCDef": "Aa end. ABC Def", None: ""}),
        (lambda: c.normalize("x", "v2"), {" a\n b [1] ": "a b [1]", None: ""}),
        (lambda: c.year_pilot("x"), {"2019": 2019, " 2019 ": 2019, "2019-05-01": None, "n.d.": None, None: None}),
        (lambda: c.year_full("x"), {"2019-05-01": 2019, "12019": 2019, "n.d.": None, "1890": None, None: None}),
        (lambda: c.looks_like_html("x"), {" <!DOCTYPE HTML>": True, "<HTML lang=en>": True, "<article/>": False, None: False}),
        (lambda: c.mentions(KEYWORDS_1, "x"), {"General remarks": True, "generation of GENE maps": True, "T Cells": True, None: False, "": False}),
        (lambda: c.mentions(KEYWORD_SETS["kw2"], "x"), {"the gut–brain axis": True, "the gut-brain axis": False}),
        (lambda: c.skipped_section("x", "v1"), {"References": True, "Data availability statement": False, "Authors’ contributions": True, " Funding. ": True}),
        (lambda: c.skipped_section("x", "v2"), {"Preferences": True, "Bioethics": True, "Results": False}),
        (lambda: c.keywords_text("x"), {'"a; b"': "a; b", '["a", {"term": "b"}, {"kw": "c"}, 3]': "a; b; c", "[]": None, None: None, '""': None, "{}": None}),
        (lambda: c.word_count("x"), {" a  b\n": 2, "": 0, None: 0, " ": 0}),
    ],
)
def test_scalar(spark, make, cases):
    assert evaluate(spark, make(), [(k,) for k in cases], ONE) == list(cases.values())


def test_general_holds_gene(spark):
    assert evaluate(spark, c.mentions(["gene"], "x"), [("General",)], ONE) == [True]


def test_first_truthy_passes_over_empty_but_not_blank(spark):
    rows = [("", "b"), (" ", "b"), (None, None)]
    assert evaluate(spark, c.first_truthy("x", "y"), rows, "x string, y string") == ["b", " ", None]


def test_ids(spark):
    rows = [("", "7", "9"), (None, None, "9"), ("PMC1", "7", "9"), (None, "", None)]
    schema = "p string, m string, i string"
    assert evaluate(spark, c.base_id_v1("p", "m", "i"), rows, schema) == ["PMID_7", "ID_9", "PMC1", None]
    assert evaluate(spark, c.tagged_key("p", "m", "i"), rows, schema) == ["PMID:7", "ID:9", "PMCID:PMC1", None]
    safe = evaluate(spark, c.base_id_v2("p", "i", "m"), [("a b/c", "7", "9"), (None, "7", None)], schema)
    assert safe[0] == "a_b_c" and safe[1].startswith("unknown_") and len(safe[1]) == 16
    assert safe[1] == evaluate(spark, c.base_id_v2("p", "i", "m"), [(None, "7", None)], schema)[0]


def test_guarded_percent(spark):
    rows = [(1, 800), (0, 0), (1, 3)]
    assert evaluate(spark, c.guarded_percent("a", "b"), rows, "a long, b long") == [0.13, 0.0, 33.33]


def test_payloads(spark):
    rows = [("T", "J", 2019, "A", "k"), ("", None, None, None, None), (" T ", "", 2019, "", "")]
    schema = "t string, j string, y int, a string, k string"
    assert evaluate(spark, c.labelled_payload("t", "j", "y", "a", "k"), rows, schema) == ["Title: T\n\nJournal / Year: J, 2019\n\nAbstract: A\n\nKeywords: k", "", "Title:  T \n\nJournal / Year: 2019"]
    assert evaluate(spark, c.metadata_payload("t", "a", F.col("k")), rows, schema) == ["T\n\nA\n\nKeywords: k", "", "T"]


def test_vocabularies():
    sizes = {n: (len(t), len(minimal_terms(t))) for n, t in KEYWORD_SETS.items()}
    assert sizes == {"v1": (59, 35), "kw1": (85, 47), "kw2": (126, 74)}
    assert [len(v) for v in PILOT_TIERS.values()] == [11, 7, 6]
