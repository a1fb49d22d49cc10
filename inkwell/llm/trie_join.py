"""Near-duplicate records with small edits: a prefix-tree join over shingle sets (problem 5).

Sets of word shingles are put in one global order, rarest gram first. The grams of each set's prefix
are dealt to parts; in a part, the sets' gram sequences form a trie, built a level of all sequences at a
time. Sets below one node share its path, so they are tested together: nodes of the same gram are
paired, unless the nodes above them hold the same gram too, for then they shared that already; and a pair
of subtrees is dropped as a whole if the longest remainders below them cannot reach the overlap that the
smallest sets below them need. What is left is tested set by set, then by signatures, then on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.prefixes import bits_for, by_part, classes, counted, near_enough, only, prefix_rows, ranks_of, sized, unpacked, verified
from inkwell.llm.words import shingle_sets
from inkwell.runtime import MOST_SENT, written

AT_ONCE = 1 << 20
FOUND = "a long, b long, old boolean"


class Trie(NamedTuple):
    """Nodes, and the entries (a gram of a sequence) sorted by node."""

    gram: np.ndarray
    above: np.ndarray  # the node's parent; -1 for a root
    start: np.ndarray  # its entries: from here
    end: np.ndarray  # to here
    entry: np.ndarray


def trie(row: np.ndarray, gram: np.ndarray) -> Trie:
    """The trie of the sequences of grams; ``row`` ascends, and tells which sequence a gram is of."""
    begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    depth = np.arange(len(row)) - np.repeat(begins, np.diff(np.r_[begins, len(row)]))
    level = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[level], np.arange(depth.max() + 2))
    node = np.full(len(row), -1)
    grams, above, made = [], [], 0
    for d in range(len(bounds) - 1):
        own = level[bounds[d] : bounds[d + 1]]
        parent = node[own - 1] if d else np.full(len(own), -1)
        order = np.lexsort((gram[own], parent))
        g, p = gram[own][order], parent[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (p[1:] != p[:-1])]
        node[own[order]] = made + np.cumsum(new) - 1
        grams.append(g[new])
        above.append(p[new])
        made += int(new.sum())
    entry = np.argsort(node, kind="stable")
    start = np.searchsorted(node[entry], np.arange(made + 1))
    return Trie(np.concatenate(grams), np.concatenate(above), start[:-1], start[1:], entry)


def crossed(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of each range a and its range b, about ``AT_ONCE`` at a time."""
    wide = b1 - b0
    steps = np.maximum(1, AT_ONCE // np.maximum(wide, 1))
    cuts = -(-(a1 - a0) // steps)
    at = np.repeat(np.arange(len(a0)), cuts)
    a0 = a0[at] + (np.arange(len(at)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * steps[at]
    a1, b0, wide = np.minimum(a0 + steps[at], a1[at]), b0[at], wide[at]
    number = (a1 - a0) * wide
    for own in np.split(np.arange(len(a0)), np.flatnonzero(np.diff(np.cumsum(number) // AT_ONCE)) + 1):
        if len(own):
            each = number[own]
            i = np.repeat(own, each)
            k = np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each)
            yield a0[i] + k // wide[i], b0[i] + k % wide[i]


def subtree_pairs(t: Trie, rest: np.ndarray, size: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries that share a gram and survive the bounds on their subtrees; ``rest`` and ``size`` by entry."""
    most, least = np.maximum.reduceat(rest[t.entry], t.start), np.minimum.reduceat(size[t.entry], t.start)
    reach = lambda u, v: np.minimum(most[u], most[v]) * (num + den) >= num * (least[u] + least[v])
    alone = np.flatnonzero((t.above < 0) & (t.end - t.start > 1))
    alone = alone[reach(alone, alone)]
    for x, y in crossed(t.start[alone], t.end[alone], t.start[alone], t.end[alone]):
        yield t.entry[x[x < y]], t.entry[y[x < y]]
    order = np.argsort(t.gram, kind="stable")
    gram = t.gram[order]
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    last = np.r_[first[1:], len(gram)]
    first, last = first[last - first > 1], last[last - first > 1]
    for i, j in crossed(first, last, first, last):
        u, v = order[i[i < j]], order[j[i < j]]
        pu, pv = t.above[u], t.above[v]
        ok = reach(u, v) & ((pu < 0) | (pv < 0) | (t.gram[pu] != t.gram[pv]))
        u, v = u[ok], v[ok]
        for x, y in crossed(t.start[u], t.end[u], t.start[v], t.end[v]):
            yield t.entry[x], t.entry[y]


def candidate_pairs(rows: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """(a, b, old): pairs of records that may be alike, found by the tries of all parts.

    Of two records of one table a < b; where a table of side 0 is compared with one of side 1, a is of side
    0 and ``old`` is true. Two records of side 0 are not paired.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        rec, n, side, row, place, gram = unpacked(batches)
        if not len(row):
            return
        size = n[row].astype(np.int64)
        rest = size - place
        found, held = [], 0

        def flush() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(found), axis=0)
            return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2] > 0)], names=["a", "b", "old"])

        for x, y in subtree_pairs(trie(row, gram), rest, size, num, den):
            ok = (np.minimum(rest[x], rest[y]) * (num + den) >= num * (size[x] + size[y])) & (np.minimum(size[x], size[y]) * den >= np.maximum(size[x], size[y]) * num)
            u, v = row[x[ok]], row[y[ok]]
            ok = (rec[u] != rec[v]) & (side[u] + side[v] > 0)
            u, v = u[ok], v[ok]
            swap = np.where(side[u] == side[v], rec[u] > rec[v], side[u] > side[v])
            found.append(np.stack([np.where(swap, rec[v], rec[u]), np.where(swap, rec[u], rec[v]), side[u] != side[v]], 1))
            held += len(u)
            if held > AT_ONCE:
                yield flush()
                found, held = [], 0
        if found:
            yield flush()

    return by_part(rows, parts, run, FOUND).distinct()


def near_duplicates(df: DataFrame, key: str, text: str, *, num: int = 3, den: int = 5, width: int = 3, least_words: int = 30) -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal sets, and the classes' members.

    Returns (a, b, similarity) with a < b representatives, and (rec, rep, copies). Texts of fewer
    than ``least_words`` words, null and empty texts are in no class. ``key`` must be unique and
    integral; rows with a null key are left out. Other columns are not read, whatever their names.
    """
    sets = written(shingle_sets(df, key, text, width=width, least_words=least_words), "sets")
    members = written(classes(sets), "members")
    number, grams, parts = sized(sets)
    reps = only(sets, members.where("rec <> rep").select("rec"), "left_anti", number <= MOST_SENT)
    seen = ranks_of(counted(sets, bits_for(grams)))
    sent = df.sparkSession.sparkContext.broadcast((seen, seen))
    pairs = candidate_pairs(prefix_rows(reps, sent, parts, num, den), parts, num, den)
    pairs = written(near_enough(pairs, sets, num, den), "pairs")
    return verified(pairs, sets, num, den).drop("old"), members


def pairs_of_records(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of records in one class or in linked classes."""
    pair = members.where("copies > 1").select("rec", "rep")
    same = pair.select("rep", F.col("rec").alias("a")).join(pair.select("rep", F.col("rec").alias("b")), "rep").where("a < b").select("a", "b")
    left = members.select(F.col("rep").alias("a"), F.col("rec").alias("x"))
    right = members.select(F.col("rep").alias("b"), F.col("rec").alias("y"))
    linked = links.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.unionByName(linked)
