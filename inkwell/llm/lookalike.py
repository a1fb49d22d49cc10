"""Visually identical text with different characters (problem 8).

Arrow text is copied to one numpy array of code points per batch, without a string call per row.
Each code point is looked up in tables that give the number of code points it becomes (0 for format
characters) and where they stand; offsets are the running sum of those numbers. Combining marks are
then put in canonical order and composed, a round of all rows at a time.

What becomes one form: ASCII of any width; canonical equivalents (composed and combining accents,
the ohm, kelvin and ångström signs); the micro sign; format characters (Cf), dropped; spaces
(category Zs), one for one to U+0020; the f-ligatures U+FB00-FB04; Cyrillic and Greek letters shaped
like a Latin letter (or like a Greek one), to that letter. Case, accents, digits, raised and lowered
digits, line breaks, the number of spaces and wording stay as they are.

A null text stays null; an empty or blank one stays blank and looks like no other. Ties do not arise:
the form is a function of the text alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.words import M1, M2, M3, mix
from inkwell.runtime import written

#: Letters of the same shape, as pairs (Cyrillic or Greek letter, letter it becomes).
SAME_SHAPE = (
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ԌG ԚQ ԜW ӀI "
    "аa еe ѕs іi јj оo рp сc уy хx һh ԁd ԛq ԝw ѵv үy ӏl "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ οo νv ϲc ϳj "
    "ГΓ ПΠ ФΦ"
).split()
LIGATURES = {0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl"}
BYTES_AT_ONCE = 1 << 20
LIMIT = 0x110000
L0, V0, T0, S0 = 0x1100, 0x1161, 0x11A7, 0xAC00


class Tables(NamedTuple):
    count: np.ndarray  # code points that a code point becomes
    first: np.ndarray  # the only one, or the place of the first in ``more``
    more: np.ndarray
    ccc: np.ndarray  # canonical combining class
    pairs: np.ndarray  # starter << 21 | mark, ascending
    composed: np.ndarray


@lru_cache(None)
def tables() -> Tables:
    shape = {ord(a): ord(b) for a, b in SAME_SHAPE}
    count, first, ccc = np.ones(LIMIT, np.uint8), np.arange(LIMIT, dtype=np.int32), np.zeros(LIMIT, np.uint8)
    more: list[int] = []
    pairs: dict[int, int] = {}

    def becomes(cp: int, text: str) -> None:
        out = [shape.get(ord(c), ord(c)) for c in text]
        count[cp] = len(out)
        if len(out) == 1:
            first[cp] = out[0]
        else:
            first[cp] = len(more)
            more.extend(out)

    for cp in range(LIMIT):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Cs", "Co"):
            continue
        if kind[0] == "M":
            ccc[cp] = unicodedata.combining(c)
        if kind == "Cf":
            becomes(cp, "")
        elif kind == "Zs":
            becomes(cp, " ")
        elif 0xFF01 <= cp <= 0xFF5E:
            becomes(cp, chr(cp - 0xFEE0))
        elif cp in LIGATURES:
            becomes(cp, LIGATURES[cp])
        elif cp == 0xB5:
            becomes(cp, "μ")
        elif not S0 <= cp < S0 + 11172 and (how := unicodedata.decomposition(c)) and how[0] != "<":
            becomes(cp, unicodedata.normalize("NFD", c))
            if len(parts := how.split()) == 2 and unicodedata.normalize("NFC", c) == c:
                pairs[int(parts[0], 16) << 21 | int(parts[1], 16)] = cp
        elif cp in shape:
            becomes(cp, c)
    keys = np.array(sorted(pairs), np.int64)
    return Tables(count, first, np.array(more or [0], np.int32), ccc, keys, np.array([pairs[k] for k in keys.tolist()], np.int32))


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets to code points and row offsets."""
    lead = (data & 0xC0) != 0x80
    if (data < 0x80).all():
        return data.astype(np.int32), offsets
    at = np.flatnonzero(lead)
    starts = np.concatenate([[0], np.cumsum(lead)])[offsets]
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    b0 = padded[at]
    out = b0.copy()
    for low, high, size, mask in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0x100, 4, 0x07)):
        k = np.flatnonzero((b0 >= low) & (b0 < high))
        if len(k):
            value = b0[k] & mask
            for j in range(1, size):
                value = value << 6 | (padded[at[k] + j] & 0x3F)
            out[k] = value
    return np.minimum(out, LIMIT - 1), starts


def utf8(cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and row offsets to UTF-8 bytes and row offsets."""
    size = 1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(ends[-1], np.uint8)
    for n, head in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        k = np.flatnonzero(size == n)
        if len(k):
            value, at = cps[k], ends[:-1][k]
            for j in range(n - 1, 0, -1):
                out[at + j] = 0x80 | (value & 0x3F)
                value = value >> 6
            out[at] = head | value
    return out, ends[starts]


def keep(cps: np.ndarray, starts: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return cps[kept], np.concatenate([[0], np.cumsum(kept)])[starts]


def compose(cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order of marks, then composition; no mark joins a letter of another row."""
    t = tables()
    rank = t.ccc[cps]
    marks = np.flatnonzero(rank)
    if len(marks):
        begins = np.zeros(len(cps) + 1, bool)
        begins[starts] = True
        run = np.cumsum((rank == 0) | begins[:-1])[marks]
        order = np.lexsort((np.arange(len(marks)), rank[marks], run))
        cps = cps.copy()
        cps[marks] = cps[marks][order]
        while True:
            marks = np.flatnonzero(t.ccc[cps])
            begins = np.zeros(len(cps) + 1, bool)
            begins[starts] = True
            marks = marks[(marks > 0) & ~begins[marks]]
            marks = marks[t.ccc[cps[marks - 1]] == 0]
            if not len(marks) or not len(t.pairs):
                break
            key = cps[marks - 1].astype(np.int64) << 21 | cps[marks]
            at = np.minimum(np.searchsorted(t.pairs, key), len(t.pairs) - 1)
            hit = t.pairs[at] == key
            if not hit.any():
                break
            cps[marks[hit] - 1] = t.composed[at[hit]]
            kept = np.ones(len(cps), bool)
            kept[marks[hit]] = False
            cps, starts = keep(cps, starts, kept)
    if ((cps >= V0) & (cps < T0 + 28)).any():
        cps, starts = hangul(cps, starts)
    return cps, starts


def hangul(cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Conjoining letters to syllables: first lead and vowel, then a tail."""
    for step in ("vowel", "tail"):
        begins = np.zeros(len(cps) + 1, bool)
        begins[starts] = True
        a, b = cps[:-1], cps[1:]
        if step == "vowel":
            hit = (a >= L0) & (a < L0 + 19) & (b >= V0) & (b < V0 + 21)
            joined = S0 + ((a - L0) * 21 + b - V0) * 28
        else:
            hit = (a >= S0) & (a < S0 + 11172) & ((a - S0) % 28 == 0) & (b > T0) & (b < T0 + 28)
            joined = a + b - T0
        hit &= ~begins[1:-1]
        at = np.flatnonzero(hit)
        cps = cps.copy()
        cps[at] = joined[at]
        kept = np.ones(len(cps), bool)
        kept[at + 1] = False
        cps, starts = keep(cps, starts, kept)
    return cps, starts


def canonical(cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = tables()
    count = t.count[cps]
    if (count == 1).all():
        return compose(t.first[cps], starts)
    ends = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
    out = np.empty(ends[-1], np.int32)
    one = count == 1
    out[ends[:-1][one]] = t.first[cps[one]]
    for j in range(int(count.max())):
        k = np.flatnonzero((count > 1) & (count > j))
        out[ends[k] + j] = t.more[t.first[cps[k]] + j]
    return compose(out, ends[starts])


def fingerprints(cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's code points and their order."""
    sizes = np.diff(starts)
    place = (np.arange(len(cps)) - np.repeat(starts[:-1], sizes)).astype(np.uint64)
    value = mix(cps.astype(np.uint64) * M1 + mix(place + M3))
    out = []
    for salt in (M2, M3):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ salt), dtype=np.uint64)])
        out.append((mix(total[starts[1:]] - total[starts[:-1]]) + sizes.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, code points, row offsets) of parts of about ``BYTES_AT_ONCE`` bytes; a null is an empty row."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BYTES_AT_ONCE, "right")) - 1)
        end = min(end, len(column))
        part = offsets[start : end + 1]
        yield start, end, *code_points(data[part[0] : part[-1]], part - part[0])
        start = end


def _run(batches: Iterator[pa.RecordBatch], hashed: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        for start, end, cps, starts in pieces(texts):
            own = texts.slice(start, end - start)
            new, at = canonical(cps, starts)
            if hashed:
                cols = [*fingerprints(new, at), *fingerprints(cps, starts)]
                solid = np.add.reduceat(np.concatenate([new > 32, [0]]).astype(np.int64), np.minimum(at[:-1], len(new))) if len(at) > 1 else np.zeros(0, np.int64)
                solid = np.where(np.diff(at) > 0, solid, 0) > 0
                out = [pa.array(c) for c in cols] + [pa.array(solid & own.is_valid().to_numpy(zero_copy_only=False))]
                yield pa.record_batch([keys.slice(start, end - start), *out], names=["rec", "f1", "f2", "r1", "r2", "solid"])
            else:
                data, offsets = utf8(new, at)
                valid = own.is_valid()
                text = pa.StringArray.from_buffers(len(own), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data), valid.buffers()[1] if own.null_count and valid.offset == 0 else None)
                yield pa.record_batch([keys.slice(start, end - start), text], names=["rec", "form"])


def forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(rec, form): the one consistent text of every row; null for a null text."""
    return df.select(df[key].cast("long"), df[text].cast("string")).mapInArrow(lambda b: _run(b, False), "rec long, form string")


def groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """(rec, f1, f2, r1, r2): hashes of the consistent form and of the text as it is, of non-blank texts."""
    return df.select(df[key].cast("long"), df[text].cast("string")).mapInArrow(lambda b: _run(b, True), "rec long, f1 long, f2 long, r1 long, r2 long, solid boolean").where("solid and rec is not null").drop("solid")


def spellings(hashed: DataFrame) -> DataFrame:
    """(f1, f2, r1, r2, copies): the spellings of forms that have several, pre-aggregated where the rows are."""
    spelled = hashed.groupBy("f1", "f2", "r1", "r2").agg(F.count(F.lit(1)).alias("copies"))
    several = spelled.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("spellings")).where("spellings > 1").select("f1", "f2")
    return spelled.join(several, ["f1", "f2"], "left_semi")


def lookalikes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b), a < b: records whose non-blank texts have one form but differ.

    Only forms with more than one spelling take part, so a form copied without end adds nothing. Two
    spellings of a form are paired once, and each pair is joined with the records on both sides: no
    two copies of one spelling meet.
    """
    hashed = written(groups(df, key, text), "forms")
    spelled = spellings(hashed)
    form, other = ["f1", "f2"], [F.col("r1").alias("v1"), F.col("r2").alias("v2")]
    pairs = spelled.select(*form, "r1", "r2").join(spelled.select(*form, *other), form).where("r1 < v1 or r1 = v1 and r2 < v2")
    left = hashed.select(*form, "r1", "r2", F.col("rec").alias("x"))
    right = hashed.select(*form, *other, F.col("rec").alias("y"))
    both = pairs.join(left, [*form, "r1", "r2"]).join(right, [*form, "v1", "v2"])
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(rec, class_id, copies, links): one row for each record with a non-blank text.

    ``class_id`` is the smallest rec of the same form, ``copies`` counts the records of the same spelling,
    ``links`` those of the same form in other spellings. No pair is made.
    """
    hashed = written(groups(df, key, text), "forms")
    form = hashed.groupBy("f1", "f2").agg(F.min("rec").alias("class_id"), F.count(F.lit(1)).alias("held"))
    spelled = hashed.groupBy("f1", "f2", "r1", "r2").agg(F.count(F.lit(1)).alias("copies"))
    both = hashed.join(spelled, ["f1", "f2", "r1", "r2"]).join(form, ["f1", "f2"])
    return both.select("rec", "class_id", "copies", (F.col("held") - F.col("copies")).alias("links"))
