"""Evaluation texts leaking into training text (problem 7).

Windows of ``window`` words slide over items and documents; an item with fewer words is one window
of its own length. The CGK walk maps a window to a string of 3 x length symbols: at each step it
writes the word under its pointer and moves on by one or not, as a random function of step and word
says. The walks of two windows at a small edit distance meet again after each difference, so their
strings differ in few places. Bit-sampling LSH then hashes a few sampled places of the string;
windows that agree in one of several samples are candidates, and each is verified on the words
themselves, with a banded edit distance of at most ``edits``. Document windows have up to ``edits`` words
more or fewer than the item's, so that an added or missing word costs one edit and not two; the
windows of all these sizes that start at one word share its walk and differ only in where it ends.

Equal windows have equal walks, so for them recall is 1. Otherwise the number of samples follows from the
target recall (``samples_for``). Only windows that can be within the edits are walked: of an item's window
in ``edits + 1`` parts, one is left whole, at most ``edits`` words from its place; this loses nothing.

Items come as a bounded table: their number of words is checked before they are sent to the
executors. The corpus is read once, by columns, and nothing of it is shuffled but the leaks found.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.words import M1, M2, hashed, mix, run_hashes, word_hashes
from inkwell.runtime import bounded_rows

STRETCH = 3
SAMPLED = 2
PLACES = 4
SEED = 20240117
#: Items are sent to every executor; a larger test set must be given in parts.
MOST_ITEMS = 100_000
WORDS_AT_ONCE = 1 << 19
#: Candidates that are verified in one go.
AT_ONCE = 1 << 17
BITS = 20


def places_in(edits: int, window: int) -> int:
    """Places of a sample. In a short window one, for with more each sample would hold the first word."""
    return min(PLACES, SAMPLED * window) if edits == 0 or window >= PLACES else 1


def samples_for(edits: int, window: int, recall: float) -> int:
    """Samples needed for ``recall`` of windows ``edits`` apart.

    After an edit, the pointers of two walks are off by one and meet again as random walks do: the share of
    places where they differ falls with the root of the length. Over changed, dropped and added words at
    any place, the worst share measured is 1.09 to 1.14 over that root, for windows of 4 to 12 words.
    """
    if edits == 0:
        return 1
    agree = max(0.05, 1 - 1.15 * edits / math.sqrt(SAMPLED * window)) ** places_in(edits, window)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def sampled_places(length: int, samples: int, number: int) -> list[np.ndarray]:
    """For each sample, the places of the walk that it hashes, ascending: one in each part of the walk.

    They lie in the first ``SAMPLED`` x length steps, for later ones are past the end of most windows, and a
    sample that holds little but the end agrees with nearly all windows.
    """
    rng = np.random.default_rng([SEED, length])
    parts = np.linspace(0, SAMPLED * length, number + 1).astype(int)
    return [rng.integers(parts[:-1], parts[1:]) for _ in range(samples)]


def embed(hashes: np.ndarray, starts: np.ndarray, length: int, sample: int, places: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """For each size, the key of each window: the CGK walk, hashed at the sampled places."""
    rng = np.random.default_rng([SEED, length, sample])
    odd = rng.integers(1, 1 << 63, STRETCH * length, dtype=np.uint64) | np.uint64(1)
    at, end = starts.copy(), starts + max(sizes)
    padded = np.append(hashes, np.uint64(0))
    keys = [np.full(len(starts), np.uint64(length)) for _ in sizes]
    last, sampled = int(places[-1]), set(places.tolist())
    for step in range(last + 1):
        symbol = padded[np.minimum(at, len(hashes))]
        symbol[at >= end] = 0
        if step in sampled:
            keys = [mix(key * M2 + np.where(at < starts + size, symbol, np.uint64(0)) + M1) for key, size in zip(keys, sizes)]
        at += (symbol * odd[step] >> np.uint64(63)).astype(np.int64)
    return keys


def windows(starts: np.ndarray, length: int) -> np.ndarray:
    """First words of all windows of ``length`` words that lie within a row."""
    sizes = np.diff(starts)
    number = np.maximum(sizes - length + 1, 0)
    skip = np.concatenate([[0], np.cumsum(number)])
    return np.arange(skip[-1]) + np.repeat(starts[:-1] - skip[:-1], number)


def within(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """For rows of two matrices of words: is their edit distance at most ``edits``? Only the band is filled."""
    wide, high = b.shape[1], a.shape[1]
    if abs(wide - high) > edits:
        return np.zeros(len(a), bool)
    if edits == 0:
        return (a == b).all(1)
    far = edits + 1
    row = np.minimum(np.abs(np.arange(-edits, edits + 1)), far)[None].repeat(len(a), 0)
    row[:, :edits] = far
    for i in range(1, high + 1):
        new = np.full_like(row, far)
        for d in range(2 * edits + 1):
            j = i + d - edits
            if 0 <= j <= wide:
                best = row[:, d + 1] + 1 if d < 2 * edits else np.full(len(a), far)
                if j > 0:
                    best = np.minimum(best, row[:, d] + (a[:, i - 1] != b[:, j - 1]))
                    if d > 0:
                        best = np.minimum(best, new[:, d - 1] + 1)
                new[:, d] = np.minimum(best, far)
        row = new
    return row[:, edits + wide - high] <= edits


class Members:
    """A set of hashes: a table of bits first, then the sorted hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[self.hashes >> np.uint64(64 - BITS)] = True

    def held(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of ``hashes`` that are in the set."""
        k = np.flatnonzero(self.seen[hashes >> np.uint64(64 - BITS)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[k]), len(self.hashes) - 1)
        return k[self.hashes[at] == hashes[k]]


def part_bounds(length: int, edits: int) -> list[tuple[int, int]]:
    """A window in edits + 1 parts, the first word of each and the first behind it."""
    cuts = np.linspace(0, length, edits + 2).astype(int).tolist()
    return [*zip(cuts[:-1], cuts[1:])]


class ItemIndex:
    """The items' windows by length: sorted keys of each sample, with item and words, and the parts of windows."""

    def __init__(self, items: list[tuple[int, str]], window: int, edits: int, recall: float):
        words = [(item, word_hashes(text)) for item, text in items if item is not None]
        self.edits, self.tables = edits, []
        for length in sorted({min(window, len(h)) for _, h in words} - {0}):
            own = [(i, h) for i, h in words if min(window, len(h)) == length]
            flat = np.concatenate([h for _, h in own])
            starts = np.concatenate([[0], np.cumsum([len(h) for _, h in own])])
            first = windows(starts, length)
            ids = np.array([i for i, _ in own], np.int64)[np.searchsorted(starts, first, "right") - 1]
            content = flat[first[:, None] + np.arange(length)]
            samples = []
            for s, places in enumerate(sampled_places(length, samples_for(edits, length, recall), places_in(edits, length))):
                keys = embed(flat, first, length, s, places, [length])[0]
                order = np.argsort(keys, kind="stable")
                seen = np.zeros(1 << BITS, bool)
                seen[keys >> np.uint64(64 - BITS)] = True
                samples.append((places, keys[order], order, seen))
            parts = [(a, b - a, Members(run_hashes(flat, b - a)[first + a])) for a, b in part_bounds(length, edits) if b > a] if length > edits else []
            self.tables.append((length, ids, content, samples, parts))

    def near(self, flat: np.ndarray, first: np.ndarray, parts: list, runs: dict[int, np.ndarray]) -> np.ndarray:
        """Of windows that begin at ``first``, those with a part of an item's window near its place."""
        if not parts:
            return first
        begins = np.zeros(len(flat) + 1, bool)
        for offset, size, members in parts:
            if size not in runs:
                runs[size] = run_hashes(flat, size)
            hits = members.held(runs[size])
            for shift in range(-self.edits, self.edits + 1):
                at = hits - offset - shift
                begins[at[(at >= 0) & (at < len(flat))]] = True
        return first[begins[first]]

    def find(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (row, item, exact) of which a window of the row and one of the item agree, or are equal."""
        found, runs = [np.empty((0, 3), np.int64)], {}
        for length, ids, content, samples, parts in self.tables:
            sizes = [*range(max(1, length - self.edits), length + self.edits + 1)]
            first = self.near(flat, windows(starts, sizes[0]), parts, runs)
            room = starts[np.searchsorted(starts, first, "right")] - first if self.edits else np.full(len(first), length)
            for s, (places, keys, order, seen) in enumerate(samples):
                for size, own in zip(sizes, embed(flat, first, length, s, places, sizes)):
                    k = np.flatnonzero(seen[own >> np.uint64(64 - BITS)] & (room >= size))
                    low, high = np.searchsorted(keys, own[k], "left"), np.searchsorted(keys, own[k], "right")
                    number = high - low
                    k, low, number = k[number > 0], low[number > 0], number[number > 0]
                    before = np.cumsum(number) - number
                    for own_k, own_low, own_number in zip(*(np.split(x, np.flatnonzero(np.diff(before // AT_ONCE)) + 1) for x in (k, low, number))):
                        shift = np.arange(own_number.sum()) - np.repeat(np.cumsum(own_number) - own_number, own_number)
                        at, hit = np.repeat(first[own_k], own_number), order[np.repeat(own_low, own_number) + shift]
                        own, theirs = flat[at[:, None] + np.arange(size)], content[hit]
                        ok = within(own, theirs, self.edits)
                        exact = (own[ok] == theirs[ok]).all(1) if size == length else np.zeros(int(ok.sum()), bool)
                        found.append(np.unique(np.stack([np.searchsorted(starts, at[ok], "right") - 1, ids[hit[ok]], exact], 1), axis=0))
        return tuple(np.unique(np.concatenate(found), axis=0).T)


def leaks(documents: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 12, edits: int = 0, recall: float = 0.95) -> DataFrame:
    """(doc, item, exact), one row each: the document holds a window of the item, up to ``edits`` word edits; exact: none.

    Null and empty texts hold nothing and leak nothing; repeated rows of one document or item give
    one row. Whole texts are read. Other columns are not touched.
    """
    rows = bounded_rows(items.select(items[item].cast("long"), items[item_text].cast("string")), MOST_ITEMS, "the table of items")
    sent = documents.sparkSession.sparkContext.broadcast([tuple(r) for r in rows if r[1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(sent.value, window, edits, recall)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            own, parts, size = [], [], 0
            for k, words in zip([*keys, None], itertools.chain(hashed(v.as_py() for v in batch.column(1)), [None])):
                if words is not None:
                    if k is not None and len(words):
                        own.append(k)
                        parts.append(words)
                        size += len(words)
                    if size < WORDS_AT_ONCE:
                        continue
                if parts:
                    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                    row, hit, exact = index.find(np.concatenate(parts), starts)
                    yield pa.record_batch([pa.array(np.array(own, np.int64)[row]), pa.array(hit), pa.array(exact > 0)], names=["doc", "item", "exact"])
                own, parts, size = [], [], 0

    found = documents.select(documents[doc].cast("long"), documents[text].cast("string")).mapInArrow(run, "doc long, item long, exact boolean")
    return found.groupBy("doc", "item").agg(F.max("exact").alias("exact")).select(F.col("doc").alias(doc), F.col("item").alias(item), "exact")
