"""Edit scripts against definitions, and drifting files end to end."""

import itertools
import json
import random

from inkwell.operators import schema_drift as s


def node(**below):
    return s.Node(16, {k: v if isinstance(v, s.Node) else s.Node(v) for k, v in below.items()})


def kinds(a, b):
    return sorted((c.kind, ".".join(c.before), ".".join(c.after)) for c in s.script(a, b)[1])


def test_script():
    assert kinds(node(pmcid=1, x=1), node(PMCID=1, y=1)) == [("added", "", "y"), ("removed", "x", ""), ("renamed", "pmcid", "PMCID")]
    assert kinds(node(pub_year=1), node(pubYear=2)) == [("renamed", "pub_year", "pubYear"), ("retyped", "pub_year", "pubYear")]
    assert kinds(node(a=1), node(a=0)) == []
    assert kinds(node(Ab_c=1), node(abc=1)) == [("renamed", "Ab_c", "abc")]
    assert kinds(node(pmcid=1), node(pmcid=1, PMCID=1)) == [("added", "", "PMCID")]
    assert kinds(node(n=node(doi=1)), node(n=node(), doi=1)) == [("moved", "n.doi", "doi")]
    assert kinds(node(), node()) == []


def test_least_cost_assignment():
    """Two names of one meaning: the pairing that retypes nothing is cheaper."""
    cost, found = s.script(node(title=1, full_title=2), node(title_full=1, article_title=2))
    assert cost == 2 and sorted((c.before[0], c.after[0]) for c in found) == [("full_title", "article_title"), ("title", "title_full")]


def test_parse():
    assert s.parse_object('{"record": {"a": 1}}') == {"a": 1}
    assert s.parse_object('{"a": {}}') == {} and s.parse_object('{"a": 1}') == {"a": 1}
    for bad in (None, "", "[1]", "{", '{"a": NaN}', "1", "[" * 100_000):
        assert s.parse_object(bad) is None


def test_files(spark):
    files = {
        ("f", 1): ['{"pmcid": "PMC1", "pub_year": "2019", "old": 1}', "", "{cut", "[1]"],
        ("f", 2): [json.dumps({"w": {"PMCID": "PMC2", "pub_year": 2020, "abstractText": "x", "is_open_access": "Y"}}), '{"PMCID": null}'],
        ("f", 3): ["broken"],
        ("g", 1): [],
    }
    lines = [(i, f, q, raw) for i, ((f, q), rows) in enumerate(files.items()) for raw in rows]
    df = spark.createDataFrame([*lines, (90, None, 1, "{}"), (91, "g", 1, None)], "line_id long, feed string, file_seq int, raw string")
    found = s.schemas(df, "feed", "file_seq", "raw")
    top = {tuple(r) for r in s.top_level(s.changes(found)).collect()}
    assert top == {
        ("f", 2, "pmcid", "PMCID", "renamed"), ("f", 2, "pub_year", "pub_year", "retyped"), ("f", 2, "old", "", "removed"), ("f", 2, "", "abstractText", "added"), ("f", 2, "", "is_open_access", "added"),
        ("f", 3, "PMCID", "", "removed"), ("f", 3, "pub_year", "", "removed"), ("f", 3, "abstractText", "", "removed"), ("f", 3, "is_open_access", "", "removed"),
    }
    table = s.unified(df, s.projections(found), keep=["line_id"])
    got = {(r["pmcid"], r["pub_year"], r["abstract"], r["is_open_access"], tuple(r["rest"])) for r in table.collect()}
    assert got == {("PMC1", "2019", None, None, ("old",)), ("PMC2", "2020", "x", True, ()), (None, None, None, None, ())}
    assert s.changes(s.schemas(df.limit(0), "feed", "file_seq", "raw")).count() == 0


def test_values_are_led_into_the_target(spark):
    """Objects, lists and moved fields reach the scalar target; what they hold besides stays in rest."""
    files = [
        {"pmcid": "PMC1", "doi": "d1", "pub_year": 2019, "abstract": "A b", "journal": "J", "pub_type": "review"},
        {"PMCID": {"value": "PMC2", "version": 1}, "ids": {"doi": "d2", "x": 1}, "pubYear": {"y": 2020, "m": 4}, "abstract": {"text": "C d", "lang": "en"}, "journal": {"title": "K", "abbr": "k"}, "authorString": ["E F", "G H"]},
        {"PMCID": 3, "ids": {"DOI": "d3"}, "abstractText": ["I j", "K l.", "M n"], "journal": {"title": "{K}"}, "pub_type": ["review", "article"], "title": None},
        {"ids": {"DOI": "d4"}, "abstract": "{not an object}"},
    ]
    df = spark.createDataFrame([(i, "f", i, json.dumps(x)) for i, x in enumerate(files)], "line_id long, feed string, file_seq int, raw string")
    table = s.unified(df, s.projections(s.schemas(df, "feed", "file_seq", "raw")), keep=["line_id"])
    got = [(r["pmcid"], r["doi"], r["pub_year"], r["abstract"], r["journal"], r["title"], r["author_string"], r["pub_type"], r["rest"]) for r in table.orderBy("line_id").collect()]
    assert got == [
        ("PMC1", "d1", "2019", "A b", "J", None, None, "review", {}),
        ("PMC2", "d2", "2020", "C d", "K", None, "E F, G H", None, {"PMCID": '{"version":1}', "ids": '{"x":1}', "pubYear": '{"m":4}', "abstract": '{"lang":"en"}', "journal": '{"abbr":"k"}'}),
        ("PMC3", "d3", None, "I j. K l. M n", "{K}", None, None, "review", {"ids": "{}", "pub_type": '["article"]'}),
        (None, "d4", None, "{not an object}", None, None, None, None, {"ids": "{}"}),
    ]


def test_moves_into_new_fields():
    assert kinds(node(doi=1), node(n=node(doi=1, x=1))) == [("added", "", "n"), ("moved", "doi", "n.doi")]
    assert s.script(node(doi=1), node(n=node(doi=1, x=1)))[0] == 3
    assert kinds(node(m=node(doi=1)), node(n=node(doi=1))) == [("added", "", "n"), ("moved", "m.doi", "n.doi"), ("removed", "m", "")]


def test_assignment_is_the_cheapest():
    rng = random.Random(3)
    for _ in range(400):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        cost = [[rng.randint(-9, 9) for _ in range(m)] for _ in range(n)]
        got = s.assigned(cost)
        rows = [[*zip(range(n), p)] for p in itertools.permutations(range(m), n)] if n <= m else [[*zip(p, range(m))] for p in itertools.permutations(range(n), m)]
        assert sum(cost[i][j] for i, j in got) == min(sum(cost[i][j] for i, j in o) for o in rows) and len(got) == min(n, m)
    many = {f"a_{'_' * k}b": 1 if k % 2 else 2 for k in range(12)}
    after = {f"A_{'_' * k}b": 2 if k % 2 else 1 for k in range(12)}
    assert s.script(node(**many), node(**after))[0] == 12  # twelve names of one meaning: all renamed, none retyped


def test_duplicate_keys_and_json_in_a_string(spark):
    lines = ['{"pmcid":"A","pmcid":"B"}', '{"note":"{\\"pmcid\\":\\"Z\\"}"}']
    df = spark.createDataFrame([(i, "f", 1, x) for i, x in enumerate(lines)], "line_id long, feed string, file_seq int, raw string")
    table = s.unified(df, s.projections(s.schemas(df, "feed", "file_seq", "raw")), keep=["line_id"])
    assert [(r["pmcid"], r["rest"]) for r in table.orderBy("line_id").collect()] == [("B", {}), (None, {"note": '{"pmcid":"Z"}'})]
