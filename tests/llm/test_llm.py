"""Each operator against brute force, an exact round trip or measured recall, with nulls, empty and
very long texts, ties, repeated rows, empty tables and clashing column names."""

import itertools
import os
import random
import sys
import unicodedata
from pathlib import Path

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from inkwell.llm import catalog, hash_forest, history, leakage, lookalike, packing, prefixes, tokens, trie_join, words

RNG = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(400)]


def plain_words(text):
    text = unicodedata.normalize("NFKC", regex.sub(r"\p{Cf}+", "", text)).lower()
    return regex.findall(r"[\p{L}\p{N}]+", text)


def alike(a, b, width=3, least=30):
    wa, wb = plain_words(a or ""), plain_words(b or "")
    if min(len(wa), len(wb)) < least:
        return False
    sa, sb = ({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for w in (wa, wb))
    return len(sa & sb) * 5 >= len(sa | sb) * 3


def edited(text, share):
    out = text.split()
    for _ in range(max(1, int(share * len(out)))):
        k = RNG.randrange(len(out))
        match RNG.randrange(3):
            case 0:
                out[k] = RNG.choice(VOCABULARY)
            case 1:
                out.insert(k, RNG.choice(VOCABULARY))
            case 2 if len(out) > 5:
                del out[k]
    return " ".join(out)


def family_texts():
    """Texts with edited copies, moved sentences, cut ends, copies in other words' order, stubs."""
    texts = []
    for _ in range(40):
        base = " ".join(RNG.choices(VOCABULARY, k=RNG.randint(25, 90)))
        texts.append(base)
        for _ in range(RNG.randrange(5)):
            copy = edited(base, RNG.choice([0.01, 0.03, 0.06, 0.1]))
            cut = copy.split()
            k = RNG.randrange(len(cut))
            texts.append(RNG.choice([copy, copy.upper(), " ".join(cut[k:] + cut[:k]), " ".join(cut[: max(20, len(cut) * 2 // 3)])]))
    texts += [texts[0], texts[0].replace(" ", ", "), None, "", " \n", "one two", " ".join(["same"] * 50), " ".join(["same"] * 60), " ".join(RNG.choices(VOCABULARY, k=6_000))]
    return texts


def test_word_characters():
    assert all(chr(i).isalnum() == (unicodedata.category(chr(i))[0] in "LN") for i in range(sys.maxunicode + 1))
    for t in ("", "a_b­c ﬁ １２ Ⅷ x²", "Ünï​code ΑΒ", "日本 語"):
        assert words.words(t) == plain_words(t)


@pytest.fixture(scope="module")
def texts():
    return family_texts()


def clashing(spark, rows):
    """A table with columns named like the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"rec": F.lit("x"), "rep": F.lit(1), "a": F.lit(None).cast("string"), "gram": F.lit(0), "n": F.lit("n")})


def test_near_duplicates_are_all_found(spark, texts):
    links, members = trie_join.near_duplicates(clashing(spark, list(enumerate(texts))), "doc_id", "text")
    got = {tuple(r) for r in trie_join.pairs_of_records(links, members).collect()}
    assert got == {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if alike(a, b)}
    assert len(got) > 40


def test_near_duplicates_of_nothing(spark):
    links, members = trie_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    assert links.count() == members.count() == 0


def test_one_text_many_times_stays_one_class(spark):
    text = " ".join(VOCABULARY[:60])
    rows = [(i, text if i % 3 else " ".join(RNG.choices(VOCABULARY, k=60))) for i in range(600)]
    links, members = trie_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert links.count() == 0 and members.where("copies > 1").count() == 400 and members.select("rep").distinct().count() == 201


def test_trie_pairs_are_all_pairs_that_share_a_gram():
    seqs = sorted({tuple(sorted(RNG.sample(range(12), RNG.randint(1, 4)))) for _ in range(40)})
    sizes = [40] * len(seqs)  # large sets, places at the start: no bound prunes
    row = np.repeat(np.arange(len(seqs)), [len(x) for x in seqs])
    gram = np.array([g for x in seqs for g in x])
    t = trie_join.trie(row, gram)
    assert len(t.gram) == len({x[:k] for x in seqs for k in range(1, len(x) + 1)})
    pairs = trie_join.subtree_pairs(t, np.full(len(row), 40), np.full(len(row), 40), 1, 100)
    found = {(min(x, y), max(x, y)) for xs, ys in pairs for x, y in zip(row[xs].tolist(), row[ys].tolist())}
    assert found == {(i, j) for i, j in itertools.combinations(range(len(seqs)), 2) if {*seqs[i]} & {*seqs[j]}}


def accepted_in_order(rows):
    held, cases = [], []
    for rec, pmcid, ident, abstract in rows:
        keys = {history.named(pmcid, "pmcid"), history.named(ident, "id")} - {None}
        found = [r for r, k, a in held if keys & k or alike(a, abstract)]
        if found:
            cases.append((min(found), rec))
        else:
            held.append((rec, keys, abstract))
    return sorted(cases)


def test_backlog_in_turns(spark, texts, monkeypatch):
    """Turns over a backlog, with the order taken anew, give what one call and the definition give."""
    monkeypatch.setattr(history, "LEAST_TURN", 1)
    monkeypatch.setattr(history, "GROWTH", 3)
    rows = records(texts, 400)
    df = spark.createDataFrame([(*r, r[0] // 9 if r[0] % 50 else None) for r in rows], META + ", batch_no int")
    assert len(history.turns(df, "rec_no", "batch_no")) > 2
    assert sorted(map(tuple, history.check_backlog(df).collect())) == accepted_in_order(rows)
    assert history.check_backlog(df.limit(0)).count() == 0


def test_rounds_decide_as_one_task_does(spark, texts, monkeypatch):
    rows = records(texts)
    monkeypatch.setattr(history, "DECIDED", 10)
    assert sorted(map(tuple, history.check_batch(spark.createDataFrame(rows, META)).cases.collect())) == accepted_in_order(rows)


def test_hot_grams_are_dealt_to_tiles(spark, monkeypatch):
    """A family of unequal near-copies meets in tiles, no pair lost."""
    base = RNG.choices(VOCABULARY, k=80)
    rows = [(i, " ".join([*base[:i % 80], f"x{i}", *base[i % 80 + 1 :]])) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if alike(a, b)}
    monkeypatch.setattr(prefixes, "HOT", 12)
    links, members = trie_join.near_duplicates(df, "doc_id", "text")
    assert {(r["a"], r["b"]) for r in links.collect()} == want and len(want) == 90 * 89 // 2


def test_scale_of_counts_keeps_order():
    counts = np.array([0, 1, 2, 127, 128, 129, 4095, 4096, 10**6, 10**9])
    rank = prefixes.scaled(counts)
    assert (np.diff(rank.astype(int)) >= 0).all() and (prefixes.unscaled(rank[:-1]) >= counts[:-1]).all()


def test_named_numbers():
    assert history.named("ＰＭＣ５０００１", "pmcid") == "A50001" == history.named("x pmc​50001.1", "id")
    assert history.named("PPR0012345", "id") == "P12345" and history.named("12345", "id") == "M12345" and history.named("12345", "pmcid") == "A12345"
    assert {history.named(x, "id") for x in (None, "", "PMC0000000", "1234", "N/A", "-")} == {None}


def records(texts, n=160):
    pick = lambda: RNG.choice([None, "", "PMC", "PMC0000000", *(f"PMC{50000 + RNG.randrange(60)}" for _ in range(3))])
    ident = lambda: RNG.choice([None, "N/A", f"{70000 + RNG.randrange(80)}", f"ppr{60000 + RNG.randrange(40)}", f"PMC {50000 + RNG.randrange(60)}.1"])
    return [(i + 1, pick(), ident(), RNG.choice(texts)) for i in range(n)]


META = "rec_no long, pmcid string, id string, abstract string"


def test_batches_against_history(spark, texts, tmp_path):
    rows = records(texts)
    want = accepted_in_order(rows)
    assert sorted(map(tuple, history.check_batch(spark.createDataFrame(rows, META)).cases.collect())) == want
    path, got = str(tmp_path / "history"), []
    for start in (0, 20, 60, 140):  # the same in batches, each against what the ones before left
        batch = spark.createDataFrame(rows[start : {0: 20, 20: 60, 60: 140, 140: 160}[start]], META)
        checked = history.check_batch(batch, history.History.load(spark, path) if start else None)
        got += map(tuple, checked.cases.collect())
        checked.save(path, "append" if start else "overwrite")
    assert sorted(got) == want


def test_chain_of_records_and_hot_key(spark):
    rows = [(i, "PMC77777" if i % 3 == 0 else None, str(80000 + i // 2), None) for i in range(1, 200)]
    assert sorted(map(tuple, history.check_batch(spark.createDataFrame(rows, META)).cases.collect())) == accepted_in_order(rows)
    assert history.check_batch(spark.createDataFrame([], META)).cases.count() == 0


def windows_of(w, size):
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def test_leaks(spark, texts):
    long = [t for t in texts if t and len(t.split()) > 30]
    items = [(1, long[0]), (2, " ".join(long[1].split()[:7])), (3, None), (4, ""), (5, long[2]), (5, long[2])]
    docs = [(i, t) for i, t in enumerate([*texts, "x " + " ".join(long[2].split()[3:15]) + " y", " ".join(long[2].split()[3:14])])]
    found = leakage.leaks(clashing(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert all(r["exact"] for r in found) and len(found) == len(got)
    fuzzy = leakage.leaks(clashing(spark, docs), spark.createDataFrame(items, "item_id long, text string"), edits=1).collect()
    assert {(r["doc_id"], r["item_id"]) for r in fuzzy if r["exact"]} == got
    want = set()
    for d, t in docs:
        for i, x in items:
            w, size = plain_words(x or ""), min(12, len(plain_words(x or "")))
            if size and windows_of(w, size) & windows_of(plain_words(t or ""), size):
                want.add((d, i))
    assert got == want and len(got) > 3
    assert leakage.leaks(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert leakage.leaks(clashing(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_fuzzy_windows_reach_the_recall():
    base = [RNG.choices(VOCABULARY, k=12) for _ in range(400)]
    index = leakage.ItemIndex([(i, " ".join(b)) for i, b in enumerate(base)], 12, 1, 0.95)
    hit = 0
    for i, b in enumerate(base):
        changed = [*b]
        changed[RNG.randrange(12)] = "zz"
        flat = words.word_hashes(" ".join(changed))
        rows, items, exact = index.find(flat, np.array([0, len(flat)]))
        assert not exact.any()
        hit += i in items
    assert hit >= 0.9 * len(base)


@pytest.mark.parametrize("length", [12, 7])
@pytest.mark.parametrize("kind", ["added", "missing"])
def test_fuzzy_windows_with_a_word_more_or_less(length, kind):
    """The passage stands between other words, so no window of the item's own length is one edit away."""
    base = [RNG.sample(VOCABULARY, length) for _ in range(400)]
    index = leakage.ItemIndex([(i, " ".join(b)) for i, b in enumerate(base)], 12, 1, 0.95)
    hit = 0
    for i, b in enumerate(base):
        k = RNG.randrange(2, length - 2)
        passage = [*b[:k], "zz", *b[k:]] if kind == "added" else [*b[:k], *b[k + 1 :]]
        flat = words.word_hashes(" ".join(["yy", "xx", *passage, "vv", "uu"]))
        hit += i in index.find(flat, np.array([0, len(flat)]))[1]
    assert hit >= 0.9 * len(base)


def test_no_window_within_the_edits_is_left_out_before_the_walk():
    for length in (1, 2, 3, 7, 12):
        base = [RNG.sample(VOCABULARY, length) for _ in range(60)]
        index = leakage.ItemIndex([(i, " ".join(b)) for i, b in enumerate(base)], 12, 1, 0.95)
        (_, _, _, _, parts), k = index.tables[0], RNG.randrange(length)
        for b in base:
            for changed in ([*b[:k], "zz", *b[k + 1 :]], [*b[:k], "zz", *b[k:]], [*b[:k], *b[k + 1 :]], b):
                flat = words.word_hashes(" ".join(["yy", *changed, "xx"]))
                assert length < 2 or 1 in index.near(flat, np.arange(len(flat)), parts, {})


def test_distance_of_unequal_lengths():
    for n, m in ((8, 7), (7, 8), (8, 6), (5, 8)):
        a = np.array([[RNG.randrange(3) for _ in range(n)] for _ in range(200)])
        b = np.array([[RNG.randrange(3) for _ in range(m)] for _ in range(200)])
        for e in range(4):
            assert leakage.within(a, b, e).tolist() == [edit_distance(x, y) <= e for x, y in zip(a.tolist(), b.tolist())]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = next_row(row, i, x, b)
    return row[-1]


def next_row(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


def test_banded_distance():
    a = np.array([[RNG.randrange(3) for _ in range(8)] for _ in range(300)])
    b = np.array([[RNG.randrange(3) for _ in range(8)] for _ in range(300)])
    for e in range(4):
        assert leakage.within(a, b, e).tolist() == [edit_distance(x, y) <= e for x, y in zip(a.tolist(), b.tolist())]


def expected_form(text):
    shape = {ord(p[0]): p[1] for p in lookalike.SAME_SHAPE}
    text = "".join(" " if unicodedata.category(c) == "Zs" else c for c in text if unicodedata.category(c) != "Cf")
    text = text.translate({c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | lookalike.LIGATURES | {0xB5: "μ"})
    return unicodedata.normalize("NFD", text).translate(shape)


def test_forms(spark):
    pieces = ["a", "é", "é", "ﬁ", "fi", "Ａ", "А", "Α", "µ", "μ", "Ω", "Ω", "K", "K", "Å", "Å", " ", "　", " ", "​", "­", "²", "2", "\n", "日", "한", "한", "x̣́", "x̣́", "й", "ё", "😀", "́"]
    texts = [None, "", " ", "­"] + ["".join(RNG.choices(pieces, k=RNG.randint(1, 12))) for _ in range(800)] + ["é" * 700_000]
    df = clashing(spark, list(enumerate(texts)))
    forms = {r["rec"]: r["form"] for r in lookalike.forms(df, "doc_id", "text").collect()}
    for i, t in enumerate(texts):
        assert (forms[i] is None) == (t is None)
        if t is not None:
            assert unicodedata.normalize("NFD", forms[i]) == expected_form(t)
            assert expected_form(forms[i]) == expected_form(t)
    got = {tuple(r) for r in lookalike.lookalikes(df, "doc_id", "text").collect()}
    solid = [(i, t, expected_form(t)) for i, t in enumerate(texts) if t and expected_form(t).strip()]
    assert got == {(i, j) for (i, a, x), (j, b, y) in itertools.combinations(solid, 2) if x == y and a != b}
    assert lookalike.lookalikes(df.limit(0), "doc_id", "text").count() == 0
    rows = {r["rec"]: (r["class_id"], r["copies"], r["links"]) for r in lookalike.classes(df, "doc_id", "text").collect()}
    assert rows == {i: (min(j for j, _, y in solid if x == y), sum(b == a for _, b, _ in solid), sum(y == x and b != a for _, b, y in solid)) for i, a, x in solid}


def brute_neighbours(vectors, k):
    ids, x = [i for i, _ in vectors], np.array([v for _, v in vectors], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosines = x @ x.T
    np.fill_diagonal(cosines, -2)
    return {i: [ids[j] for j in np.argpartition(-row, k)[:k]] for i, row in zip(ids, cosines)}


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((100, 64))
    vectors = [(f"v{i:05d}", (centres[i % 100] + 0.35 * rng.standard_normal(64)).tolist()) for i in range(2000)]
    bad = [("n1", None), ("n2", [0.0] * 64), ("n3", [1.0] * 63), ("n4", [float("nan")] + [1.0] * 63), ("n5", [float("inf")] + [1.0] * 63), (None, [1.0] * 64), ("n6", [None] + [1.0] * 63)]
    df = spark.createDataFrame(vectors + vectors[:50] + bad, "chunk_id string, embedding array<float>").withColumns({"a": F.lit(1), "h1": F.lit("x"), "v": F.lit(0), "id": F.lit(None).cast("int")})
    found = hash_forest.most_similar(df, "chunk_id", "embedding").collect()
    got = {}
    for r in found:
        got.setdefault(r["a"], []).append(r["b"])
    want = brute_neighbours(vectors, 5)
    assert set(got) <= set(want) and all(len(set(v)) == len(v) <= 5 for v in got.values())
    assert sum(len({*got.get(a, ())} & {*b}) for a, b in want.items()) >= 0.9 * 5 * len(vectors)
    assert hash_forest.most_similar(df.limit(0), "chunk_id", "embedding").count() == 0


def test_large_nodes_of_full_depth_are_scored_whole(monkeypatch):
    """Nearly equal vectors have one hash string; each finds its nearest among all of them."""
    monkeypatch.setattr(hash_forest, "NODE", 64)
    rng = np.random.default_rng(6)
    unit = hash_forest.normalized(rng.standard_normal(64) + 0.05 * rng.standard_normal((1000, 64)))
    got = {}
    same = np.zeros(1000, np.int64)
    for r, c, v in hash_forest.scored(same, unit, same, np.full(1000, hash_forest.SYMBOLS), unit, 8, 0.5):
        for x in zip(r.tolist(), c.tolist(), v.tolist()):
            got.setdefault(x[0], []).append(x)
    want = brute_neighbours([*enumerate(unit.tolist())], 5)
    assert all({*want[a]} <= {c for _, c, _ in sorted(got[a], key=lambda x: -x[2])[:8]} for a in want)


def test_splits_lose_nothing(spark):
    """However many parts a tree has, and though half of all vectors have one string, the same neighbours are found."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal(64)
    vectors = [(f"v{i:04d}", (base + 1e-5 * rng.standard_normal(64) if i % 2 else rng.standard_normal(64)).tolist()) for i in range(800)]
    df = spark.createDataFrame(vectors, "chunk_id string, embedding array<float>")
    few, many = (sorted(map(tuple, hash_forest.most_similar(df, "chunk_id", "embedding", wanted=60, partitions=n).select("a", "b").collect())) for n in (10, 120))
    assert few == many
    code = np.array([3, 5, 5, 5, 9]) << 56
    splits = np.array([5, 5, 7]) << 56
    home, first, last = hash_forest.nodes_of(code, np.array([1, 1, 15, 1, 1]), splits, np.arange(5))
    assert home.tolist() == [0, 1, 2, 0, 3] and first.tolist() == [0, 0, 0, 0, 3] and last.tolist() == [0, 2, 2, 2, 3]


def test_packed_vectors_are_within_the_rounding():
    rng = np.random.default_rng(2)
    for dim in (3, 64):
        unit = hash_forest.normalized(rng.standard_normal((500, dim)))
        back = hash_forest.unquantized(hash_forest.quantized(unit), dim)
        assert np.abs(back - unit / np.abs(unit).max(1, keepdims=True) * hash_forest.STEPS).max() <= 0.501
        back /= np.linalg.norm(back, axis=1, keepdims=True)
        assert np.abs(back @ back.T - unit @ unit.T).max() <= hash_forest.rounding(dim)


def test_neighbours_in_tight_families(spark):
    """300 vectors with cosines of 0.9998 and more: rounding in the trees must not decide who is nearest."""
    rng = np.random.default_rng(8)
    vectors = [(f"v{i:04d}", x.tolist()) for i, x in enumerate((rng.standard_normal(64) + 0.01 * rng.standard_normal((300, 64))).astype(np.float32))]
    got = {}
    for r in hash_forest.most_similar(spark.createDataFrame(vectors, "chunk_id string, embedding array<float>"), "chunk_id", "embedding", least=0.85).collect():
        got.setdefault(r["a"], []).append(r["b"])
    want = brute_neighbours(vectors, 5)
    recall = sum(len({*got.get(a, ())} & {*b}) for a, b in want.items()) / (5 * len(vectors))
    print("recall in tight families", recall)
    assert recall >= 0.99


def test_neighbours_of_copies(spark):
    """A third of all rows are one vector: their neighbours are the smallest other keys among them."""
    rng = np.random.default_rng(4)
    same = rng.standard_normal(64).tolist()
    rows = [(f"c{i:04d}", same if i % 3 == 0 else rng.standard_normal(64).tolist()) for i in range(900)]
    got = {}
    for r in hash_forest.most_similar(spark.createDataFrame(rows, "chunk_id string, embedding array<float>"), "chunk_id", "embedding", least=0.9).collect():
        got.setdefault(r["a"], []).append(r["b"])
    copies = [i for i, v in rows if v is same]
    assert got == {i: [j for j in copies if j != i][:5] for i in copies} or {a: sorted(b) for a, b in got.items()} == {i: [j for j in copies if j != i][:5] for i in copies}


needs_vocabularies = pytest.mark.skipif(not os.path.isdir(tokens.VOCABULARIES), reason="no vocabulary files")


@needs_vocabularies
@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_token_counts_are_exact(name):
    tiktoken = pytest.importorskip("tiktoken")
    of = tokens.vocabulary(name)
    own = tiktoken.Encoding("own", pat_str=of.pattern, mergeable_ranks=of.ranks(), special_tokens={})
    count = tokens.counter(of, "pair_merge")
    letters = "abcdefgh ABC 0123 .,;-\n\téüñ日本語Ωж😀'st"
    for t in ["", " ", "<|endoftext|>", "don't", *("".join(RNG.choices(letters, k=RNG.randint(1, 60))) for _ in range(400)), "ab" * 3000]:
        assert count(t) == len(own.encode_ordinary(t))


def greedy(text, vocabulary):
    n = i = 0
    while i < len(text):
        i += max((k for k in range(1, 9) if text[i : i + k] in vocabulary), default=1)
        n += 1
    return n


def test_longest_match():
    for _ in range(50):
        vocabulary = {bytes(RNG.choices(b"abc", k=RNG.randint(1, 6))) for _ in range(15)} | {b"a", b"b", b"c"}
        automaton = tokens.LongestMatch(sorted(vocabulary))
        for _ in range(20):
            t = bytes(RNG.choices(b"abcx", k=RNG.randint(0, 30)))
            assert automaton.count(t) == greedy(t, vocabulary)


@needs_vocabularies
def test_longest_match_over_a_public_vocabulary(data):
    """The failure links count what a plain greedy scan of the bytes does, over whole documents."""
    import pyarrow.parquet as pq

    of = tokens.vocabulary(tokens.STAND_INS["cl100k_base"])
    count, table = tokens.counter(of, "longest_match"), of.ranks()
    longest = max(map(len, table))
    for t in pq.read_table(f"{data}/documents.parquet", columns=["text"])["text"].to_pylist()[::8]:
        raw, n, i = (t or "").encode(), 0, 0
        while i < len(raw):
            i += next((k for k in range(longest, 1, -1) if raw[i : i + k] in table), 1)
            n += 1
        assert count(t or "") == n


@needs_vocabularies
def test_budget(spark):
    rows = [(1, "Open  Omics ", "EN", "META", "Genomics", "a b"), (2, "OPEN OMICS", "en-XX", "metadata_only", "genomics", None), (3, None, "und", "", None, ""), (4, " ", None, None, " ", "c"), (5, "x", "de ", "full_text", "y", "d")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, source_type string, domain string, text string").withColumn("tokens", F.lit("clash"))
    counted = tokens.token_counts(df.drop("tokens"), ["doc_id", "source", "lang", "domain", "source_type"], "text", of=tokens.vocabulary("byte_bpe_50k.tiktoken"))
    got = {tuple(r) for r in tokens.budget(counted).collect()}
    assert got == {("open omics", "en", "genomics", "metadata_only", 2, 1, 2), ("unknown", "unknown", "unknown", "unknown", 2, 1, 1), ("x", "de", "y", "fulltext", 1, 1, 1)}


@needs_vocabularies
def test_budget_of_chunks_has_language_and_domain(spark, tmp_path):
    docs = [(1, "P1", "s", "EN", "Genomics", "full_text", "a"), (2, "P1", "s", "de", "other", "full_text", "b"), (3, None, "s", "fr", "x", "full_text", "c")]
    chunks = [("c1", "P1", "J", "full_text", "d"), ("c1", "P1", "J", "full_text", "d"), ("c2", None, "J", "full_text", "e")]
    tables = {"documents": (docs, "doc_id long, pmcid string, source string, lang string, domain string, source_type string, text string"), "embedded_chunk": (chunks, "chunk_id string, pmcid string, journal string, source_type string, text string"), "context_windows": ([("cl100k_base",)], "tokenizer string")}
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r["lang"], r["domain"]) for r in catalog.QUERIES["p3_token_budget"](spark, str(tmp_path)).where("kind = 'chunks'").collect()}
    assert got == {("en", "genomics"), ("unknown", "unknown")}


def test_packing(spark):
    sizes = [(i, RNG.choice([RNG.randint(1, 400), RNG.randint(300, 1000), 1000, 0, 2500])) for i in range(3000)] + [(9000, None), (9001, 123_456)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long").withColumns({"item": F.lit("x"), "capacity": F.lit(1)})
    kinds = spark.createDataFrame([("small", 1000), ("large", 8192), ("none", 0)], "window_name string, capacity_tokens int")
    rows = packing.assign(df, kinds).collect()
    for name, capacity in (("small", 1000), ("large", 8192)):
        own = [r for r in rows if r["window_name"] == name]
        fill, pieces = {}, {}
        for r in own:
            fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
            pieces.setdefault(r["item"], []).append(r["tokens"])
        assert max(fill.values()) <= capacity and all(fill[r["container"]] == r["used"] for r in own)
        assert {i: sum(p) for i, p in pieces.items()} == {i: t for i, t in sizes if t}
        assert all(len(p) == -(-sum(p) // capacity) for p in pieces.values())
        assert len(fill) <= 1.01 * sum(fill.values()) / capacity + 1
    assert packing.assign(df.limit(0), kinds).count() == 0


def test_local_search_empties_a_container():
    """Best fit leaves three containers here; two hold all."""
    shard = packing.Shard(10)
    shard.bins, shard.fill = [[(2, 1), (6, 0)], [(3, 3), (5, 2)], [(4, 4)]], [8, 8, 4]
    shard.search()
    assert sorted(f for f in shard.fill if f) == [10, 10]


def test_search_leaves_no_step():
    shard = packing.Shard(100)
    shard.lay([(RNG.randint(20, 60), i) for i in range(300)])
    before = [f for f in shard.fill if f]
    shard.search()
    after = [f for f in shard.fill if f]
    assert sum(before) == sum(after) and len(after) <= len(before) and max(after) <= 100
    assert len(after) == -(-sum(after) // 100) or not any(shard.step(b) for b in range(len(shard.bins)) if 0 < shard.fill[b] < 100)


def test_items_that_fill_badly_stay_in_their_shards(spark, monkeypatch):
    """Items of 60 % of the capacity fill no container well; no level gathers them in one group."""
    monkeypatch.setattr(packing, "BINS", 16)
    sizes = spark.createDataFrame([(i, RNG.randint(590, 610)) for i in range(2000)], "doc_id long, tokens long")
    kinds = spark.createDataFrame([("w", 1000)], "window_name string, capacity_tokens int")
    rows = packing.assign(sizes, kinds).collect()
    groups = {}
    for r in rows:
        groups[r["container"].rsplit("-", 1)[0]] = groups.get(r["container"].rsplit("-", 1)[0], 0) + 1
    assert len(rows) == len({r["container"] for r in rows}) == 2000 and max(groups.values()) < 80 and len(groups) > 30


def test_same_rows_in_sql(spark, data):
    """Every query with SQL gives the same rows in Spark and DuckDB, over the whole small tables."""
    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    for name, sql in catalog.SQL.items():
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        got = catalog.QUERIES[name](spark, data)
        assert sorted(got.columns) == sorted(columns), name
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall()), name


def test_other_queries_run(spark, data):
    for name in {*catalog.QUERIES} - {*catalog.SQL}:
        assert catalog.QUERIES[name](spark, data).count() >= 0, name


def test_classes_have_every_document(spark, tmp_path):
    text = " ".join(VOCABULARY[:60])
    rows = [(1, text), (2, text.upper()), (3, None), (4, ""), (5, "few words"), (6, " ".join(VOCABULARY[2:60]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalog.QUERIES["p5_classes"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 2, 1), (2, 1, 2, 1), (3, 3, 1, 0), (4, 4, 1, 0), (5, 5, 1, 0), (6, 6, 1, 1)}


def test_incremental_query_agrees(spark, data):
    last = spark.read.parquet(f"{data}/metadata_all.parquet").agg(F.max("batch_no")).first()[0]
    want = catalog.QUERIES["p2_found"](spark, data).join(spark.read.parquet(f"{data}/metadata_all.parquet").where(F.col("batch_no") == last).select(F.col("rec_no").alias("rec_no_b")), "rec_no_b", "left_semi")
    got = catalog.QUERIES["p2_last_batch"](spark, data)
    assert sorted(map(tuple, got.select("rec_no_a", "rec_no_b").collect())) == sorted(map(tuple, want.select("rec_no_a", "rec_no_b").collect()))
