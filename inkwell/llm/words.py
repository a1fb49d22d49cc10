"""Words, word hashes and shingle sets of texts, in Arrow batches.

The words of a text: format characters (Cf) dropped, NFKC, lower case, then the maximal runs of
letters and digits (categories L and N). ``str.isalnum`` holds for exactly those categories, which
a test confirms, so the stdlib pattern ``[^\\W_]+`` finds the runs.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

WORD = re.compile(r"[^\W_]+")
CACHED_WORDS = 1 << 20
WORDS_AT_ONCE = 1 << 18
CHARS_AT_ONCE = 1 << 19
GRAM_BYTES = 6
LANES = 8
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@lru_cache(None)
def format_characters() -> re.Pattern:
    found = [chr(i) for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Cf"]
    return re.compile("[" + "".join(map(re.escape, found)) + "]+")


@lru_cache(None)
def format_table() -> np.ndarray:
    return np.array([unicodedata.category(chr(i)) == "Cf" for i in range(sys.maxunicode + 1)])


def words(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", format_characters().sub("", text))
    return WORD.findall(text.lower())


class WordHashes(dict):
    """64-bit hash of a word; remembers up to ``CACHED_WORDS`` words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


HASHES = WordHashes()


def without_format(texts: list[str]) -> list[str]:
    """The texts without format characters: one table lookup over the code points of all that are not ASCII."""
    mixed = [i for i, t in enumerate(texts) if not t.isascii()]
    points = np.frombuffer("\0".join([texts[i] for i in mixed]).encode("utf-32-le", "surrogatepass"), np.uint32)
    dropped = format_table()[points]
    if dropped.any():
        parts = points[~dropped].tobytes().decode("utf-32-le", "surrogatepass").split("\0")
        if len(parts) != len(mixed):  # a text holds the separator itself
            parts = [format_characters().sub("", texts[i]) for i in mixed]
        for i, part in zip(mixed, parts):
            texts[i] = part
    return texts


def word_hashes(text: str | None) -> np.ndarray:
    return next(hashed([text]))


def hashed(values: Iterable[str | None]) -> Iterator[np.ndarray]:
    """For each text in turn, the hashes of its words; none for a null or empty one."""

    def out() -> Iterator[np.ndarray]:
        for t in without_format(held):
            found = WORD.findall((t if t.isascii() else unicodedata.normalize("NFKC", t)).lower())
            yield np.fromiter(map(HASHES.__getitem__, found), np.uint64, len(found))

    held, size = [], 0
    for value in values:
        held.append(value or "")
        size += len(held[-1])
        if size >= CHARS_AT_ONCE:
            yield from out()
            held, size = [], 0
    yield from out()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    if len(hashes) < width:
        return np.empty(0, np.uint64)
    each = mix(hashes + M1)
    total = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        total = total * M2 + each[k : len(hashes) - width + 1 + k]
    return mix(total)


def to_bytes(grams: np.ndarray) -> np.ndarray:
    """Grams of 48 bits as rows of ``GRAM_BYTES`` bytes."""
    return np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :GRAM_BYTES])


def from_bytes(data: bytes | memoryview) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(-1, GRAM_BYTES)
    wide = np.zeros((len(rows), 8), np.uint8)
    wide[:, :GRAM_BYTES] = rows
    return wide.view("<u8").ravel()


def flat_grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All grams of a binary column, and where each row's begin."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return from_bytes(memoryview(data)[at[0] : at[-1]] if data is not None else b""), (at - at[0]) // GRAM_BYTES


def shingle_sets(df: DataFrame, key: str, text: str, *, width: int = 3, least_words: int = 30) -> DataFrame:
    """One row for each text of at least ``least_words`` words: rec, n, s1, s2, w0 to w7, grams.

    ``grams`` holds the distinct shingle hashes, of 48 bits and ascending, as bytes; ``n`` their number;
    (s1, s2, n) is the same for equal sets, whatever the order of their words; w0 to w7 are a parity
    signature: sets that differ in d shingles have signatures that differ in d bits at most. Null, empty
    and short texts give no row. Whole texts are read, however long.
    """

    def packed(recs: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
        grams = np.append(run_hashes(flat, width) >> np.uint64(16), np.zeros(min(len(flat), width - 1), np.uint64))
        # the runs of a row are those that begin at least ``width`` words before its end
        ends = np.maximum(starts[1:] - width + 1, starts[:-1])
        kept = np.zeros(len(flat), bool)
        for start, end in zip(starts[:-1].tolist(), ends.tolist()):
            grams[start:end].sort()
            kept[start:end] = True
        begins = np.zeros(len(flat) + 1, bool)
        begins[starts] = True
        kept[1:] &= (grams[1:] != grams[:-1]) | begins[1:-1]
        offsets = np.concatenate([[0], np.cumsum(kept)])[starts]
        grams = grams[kept]
        first = offsets[:-1]
        sums = [np.add.reduceat(mix(grams ^ m), first).view(np.int64) if len(recs) else np.empty(0, np.int64) for m in (M1, M3)]
        bit = np.uint64(1) << (grams & np.uint64(63))
        lane = grams >> np.uint64(6) & np.uint64(LANES - 1)
        lanes = [np.bitwise_xor.reduceat(np.where(lane == k, bit, np.uint64(0)), first).view(np.int64) if len(recs) else np.empty(0, np.int64) for k in range(LANES)]
        blob = pa.Array.from_buffers(pa.binary(), len(recs), [None, pa.py_buffer((offsets * GRAM_BYTES).astype(np.int32)), pa.py_buffer(to_bytes(grams))])
        return pa.record_batch(
            [pa.array(recs, pa.int64()), pa.array(np.diff(offsets).astype(np.int32)), *map(pa.array, sums), *map(pa.array, lanes), blob],
            names=["rec", "n", "s1", "s2", *(f"w{k}" for k in range(LANES)), "grams"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recs, parts, held = [], [], 0
            for rec, hashes in zip(batch.column(0).to_pylist(), hashed(v.as_py() for v in batch.column(1))):
                if rec is None or len(hashes) < max(least_words, width):
                    continue
                recs.append(rec)
                parts.append(hashes)
                held += len(hashes)
                if held >= WORDS_AT_ONCE:
                    yield packed(recs, parts)
                    recs, parts, held = [], [], 0
            yield packed(recs, parts)

    lanes = ", ".join(f"w{k} long" for k in range(LANES))
    return df.select(df[key].cast("long"), df[text].cast("string")).mapInArrow(run, f"rec long, n int, s1 long, s2 long, {lanes}, grams binary")
