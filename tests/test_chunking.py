"""Chunkers against plain Python, and their edge cases."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.operators import chunking


def chunks(spark, make, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", make.alias("out")).collect()
    return [r["out"] for r in sorted(rows)]


def windows(text, target, overlap):
    w, out, start = (text or "").split(), [], 0
    while start < len(w):
        out.append(" ".join(w[start : start + target]))
        if start + target >= len(w):
            break
        start += target - overlap
    return out


def grouped(text, target, overlap):
    """Expected chunks, by looking back from each paragraph instead of folding forward."""
    paras = [" ".join(p.split()) for p in __import__("re").split(r"\n\s*\n+", (text or "").strip()) if p.strip()]
    out, group = [], []
    size = lambda g: sum(len(p.split()) for p in g)
    for p in paras:
        if size([p]) > target:
            out += ["\n\n".join(group)] * bool(group) + windows(p, target, 0)
            group = []
        elif group and size([*group, p]) > target:
            out.append("\n\n".join(group))
            last = group[-1].split()
            group = [group[-1] if len(last) <= overlap else "[...] " + " ".join(last[len(last) - overlap :] if overlap else last), p]
        else:
            group.append(p)
    return out + ["\n\n".join(group)] * bool(group)


def words(n, letter="w"):
    return " ".join(f"{letter}{i}" for i in range(n))


def test_windows_at_the_edges(spark):
    texts = [None, "", " \n", words(10), words(11), words(18), words(19), words(100)]
    assert chunks(spark, chunking.word_windows("x", 10, 2), texts) == [windows(t, 10, 2) for t in texts]


def test_overlap_must_be_less_than_target():
    with pytest.raises(ValueError):
        chunking.word_windows("x", 10, 10)


def test_pilot_cuts_only_over_one_and_a_half(spark):
    text = "\n\n".join([words(3, "a"), words(15, "b"), words(16, "c"), words(4, "d"), words(6, "e"), words(1, "f")])
    got = chunks(spark, chunking.grouped_paragraphs("x", 10), [text])[0]
    assert [len(g.split()) for g in got] == [3, 15, 10, 6, 10, 1]


@pytest.mark.parametrize("overlap", [0, 2, 5])
def test_bridge(spark, overlap):
    texts = [None, "", words(30), "\n\n".join(words(n, c) for n, c in ((4, "a"), (5, "b"), (2, "c"), (30, "d"), (6, "e"), (6, "f"), (10, "g"), (1, "h")))]
    assert chunks(spark, chunking.bridged_paragraphs("x", 10, overlap), texts) == [grouped(t, 10, overlap) for t in texts]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(1, 25), max_size=8), min_size=1, max_size=10))
def test_bridge_against_python(spark, shapes):
    texts = ["\n \n".join(words(n, chr(97 + k)) for k, n in enumerate(shape)) for shape in shapes]
    assert chunks(spark, chunking.bridged_paragraphs("x", 12, 3), texts) == [grouped(t, 12, 3) for t in texts]


def test_long_text_is_taken_whole(spark):
    got = chunks(spark, chunking.bridged_paragraphs("x", 650, 120), [words(200_000)])[0]
    assert sum(len(g.split()) for g in got) == 200_000


def test_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([(2019, "PMC1", words(25), "kept"), (None, "PMC2", words(5), "kept")], "year int, pmcid string, x string, text string")
    rows = chunking.exploded(df, chunking.word_windows("x", 10, 0), [F.col("text").alias("old")]).collect()
    assert sorted(r["chunk_id"] for r in rows) == ["2019_PMC1_0001", "2019_PMC1_0002", "2019_PMC1_0003", "UNKNOWN_YEAR_PMC2_0001"]
