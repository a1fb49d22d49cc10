"""What the set-similarity joins share: classes of equal sets, the order of shingles, prefix rows, bounds.

Two sets A, B are alike if |A∩B| / |A∪B| >= num/den. All bounds are in whole numbers, so no rounding
can lose a pair:

* the overlap needed is ``need(a, b) = ceil(num (a+b) / (num+den))``;
* with all sets in one global order, an alike pair shares a gram among the first
  ``prefix(n) = n - ceil(num n / den) + 1`` of each, and the first they share, at places i and j,
  leaves room for the rest: ``1 + min(a-i-1, b-j-1) >= need(a, b)``;
* sets that share s grams differ in ``a + b - 2 s``, which the bits where their signatures differ never exceed.

Any order is exact; a rare-first order is fast. It comes from counts over all sets, kept in a sketch of
bounded size (a byte a bin, 32 MB at most): a gram's rank is its bin's count, on a scale that is exact up to 128 and
logarithmic above, then the gram. A gram alone in its bin is held by one set only and matches nothing,
so it only shifts places. The sketch is sent to the executors.

Prefix grams travel as packed columns of bytes, one row for each part of the grams and batch of sets, so
the shuffle moves about ten bytes a gram. A gram that more than ``HOT`` sets may hold is dealt to tiles
of classes of records, so that no task meets all its holders.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.words import LANES, M1, M3, flat_grams, from_bytes, mix, to_bytes
from inkwell.runtime import is_small

#: Bits of a bin's number: as many as the grams have, less one, between these.
LEAST_BITS, MOST_BITS = 16, 25
BLOCKS = 8
EXACT = 128
HOT = 4096
GRAMS_AT_ONCE = 1 << 20
GRAMS_A_PART = 1 << 22
GRAM = np.uint64((1 << 48) - 1)
PACKED = "part int, rows int, grams int, side byte, raw int, blob binary"


def ceil_div(top: Column, bottom: int) -> Column:
    return F.floor((top + (bottom - 1)) / bottom).cast("int")


def need(a: Column, b: Column, num: int, den: int) -> Column:
    return ceil_div((a + b) * num, num + den)


def classes(sets: DataFrame) -> DataFrame:
    """(rec, rep, copies): each set's smallest rec of the same set. One small row a set is shuffled."""
    heads = sets.groupBy("s1", "s2", "n").agg(F.min("rec").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return sets.select("rec", "s1", "s2", "n").join(heads, ["s1", "s2", "n"]).select("rec", "rep", "copies")


def sendable(recs: DataFrame) -> DataFrame:
    """The table, marked for a broadcast if it has few rows."""
    return F.broadcast(recs) if is_small(recs) else recs


def only(sets: DataFrame, recs: DataFrame, how: str = "left_semi", few: bool = False) -> DataFrame:
    """The sets with (or, "left_anti", without) a rec in ``recs``: sent to all executors if few, else joined by rec.

    ``few`` says that they are known to be few, and spares the count.
    """
    return sets.join(F.broadcast(recs) if few else sendable(recs), "rec", how)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts in one byte, in order: exact up to ``EXACT``, logarithmic above."""
    out = np.minimum(counts, EXACT).astype(np.uint8)
    many = np.flatnonzero(counts >= EXACT)
    out[many] = np.minimum(EXACT + np.floor(8 * np.log2(counts[many] / EXACT)), 255)
    return out


def unscaled(rank: np.ndarray) -> np.ndarray:
    """The largest count with this rank."""
    return np.where(rank < EXACT, rank, np.ceil(EXACT * 2.0 ** ((rank.astype(np.int64) - EXACT + 1) / 8)))


def bins_of(grams: np.ndarray, bits: int) -> np.ndarray:
    return (mix(grams + M3) >> np.uint64(64 - bits)).astype(np.int64)


def squeezed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def spread(data: bytes, size: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


class Counts(NamedTuple):
    """How many sets hold a gram of each bin: ``BLOCKS`` compressed blocks of bins."""

    bits: int
    blocks: list[bytes]

    @property
    def size(self) -> int:
        return (1 << self.bits) // BLOCKS

    def block(self, k: int) -> np.ndarray:
        return spread(self.blocks[k], self.size, np.uint32)

    def plus(self, other: Counts) -> Counts:
        return Counts(self.bits, [squeezed(self.block(k) + other.block(k)) for k in range(BLOCKS)])


class Ranks(NamedTuple):
    """The rank of each bin, or a mark of it, compressed: what is sent."""

    bits: int
    data: bytes

    def table(self) -> np.ndarray:
        return spread(self.data, 1 << self.bits, np.uint8)


def ranks_of(counts: Counts) -> Ranks:
    return Ranks(counts.bits, squeezed(np.concatenate([scaled(counts.block(k)) for k in range(BLOCKS)])))


def named_by(counts: Counts) -> Ranks:
    return Ranks(counts.bits, squeezed(np.concatenate([(counts.block(k) > 0).view(np.uint8) for k in range(BLOCKS)])))


def bits_for(grams: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, grams.bit_length() - 1))


def counted(sets: DataFrame, bits: int) -> Counts:
    """The counts of grams by bin over all sets.

    Each task counts what it reads and gives its counts compressed; blocks of bins are summed in parallel,
    and what reaches the driver is of bounded size.
    """
    size = (1 << bits) // BLOCKS

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            grams, _ = flat_grams(batch.column(0))
            for start in range(0, len(grams), 1 << 22):
                np.add.at(total, bins_of(grams[start : start + (1 << 22)], bits), 1)
        yield pa.record_batch([pa.array(range(BLOCKS), pa.int32()), pa.array(list(map(squeezed, np.split(total, BLOCKS))), pa.binary())], names=["block", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[block] = held.get(block, 0) + spread(data, size, np.uint32)
        for block, total in held.items():
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([squeezed(total)], pa.binary())], names=["block", "counts"])

    found = sets.select("grams").mapInArrow(own, "block int, counts binary").repartitionById(BLOCKS, "block").mapInArrow(merge, "block int, counts binary")
    blocks = {k: bytes(data) for k, data in found.collect()}
    return Counts(bits, [blocks.get(k) or squeezed(np.zeros(size, np.uint32)) for k in range(BLOCKS)])


def sized(sets: DataFrame) -> tuple[int, int, int]:
    """The numbers of sets and of their grams, and the parts of the grams: the cores there are, or more if a part would hold too many."""
    number, grams = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0))).first()
    return number, grams, max(sets.sparkSession.sparkContext.defaultParallelism, math.ceil(grams / GRAMS_A_PART))


def prefix_rows(sets: DataFrame, sent: object, parts: int, num: int, den: int, side: int = 1, tiles: bool = True) -> DataFrame:
    """Packed rows of the prefixes of (rec, n, grams). ``side`` tells two tables apart that are compared.

    ``sent`` is a broadcast pair: the ranks that order the grams, and those that tell which grams only one
    set holds, which are left out; None if sets are still to come that were not counted. Without ``tiles``
    the rows are to be stored, and ``touched`` deals them out.
    """

    def packed(recs: np.ndarray, sizes: np.ndarray, grams: np.ndarray, starts: np.ndarray, rank: tuple[int, np.ndarray], now: tuple[int, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        bits, rank = rank
        keys = rank[bins_of(grams, bits)].astype(np.uint64) << np.uint64(48) | grams
        for start, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
            keys[start:end].sort()
        row = np.repeat(np.arange(len(recs)), sizes)
        place = np.arange(len(keys)) - starts[row]
        most = sizes - -(-num * sizes // den) + 1
        kept = place < most[row]
        if now is not None:
            kept &= now[1][bins_of(keys & GRAM, now[0])] > 1
        keys, row, place = keys[kept], row[kept], place[kept]
        yield dealt(keys, row, place, recs, sizes, parts, side, tiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, now = (x and (x.bits, x.table()) for x in sent.value)
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += (batch.column(2).nbytes) // 6
            if size >= max(GRAMS_AT_ONCE, 64 * parts):
                yield from one(held, rank, now)
                held, size = [], 0
        if held:
            yield from one(held, rank, now)

    def one(held: list[pa.RecordBatch], rank: tuple[int, np.ndarray], now: tuple[int, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        flat = [flat_grams(b.column(2)) for b in held]
        recs = np.concatenate([b.column(0).to_numpy() for b in held])
        sizes = np.concatenate([b.column(1).to_numpy() for b in held]).astype(np.int64)
        yield from packed(recs, sizes, np.concatenate([g for g, _ in flat]), np.concatenate([[0], np.cumsum(sizes)]), rank, now)

    return sets.select("rec", "n", "grams").mapInArrow(run, PACKED)


def dealt(keys: np.ndarray, row: np.ndarray, place: np.ndarray, recs: np.ndarray, sizes: np.ndarray, parts: int, side: int, tiles: bool) -> pa.RecordBatch:
    """Packed rows, one a part, of grams under their ranks (``keys``)."""
    if tiles:
        keys, row, place = tiled(keys, row, place, recs)
    part = (mix(keys ^ M1) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part * (len(recs) + 1) + row, kind="stable")
    gram, row, place = keys[order] & GRAM, row[order], place[order]
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    return packed_rows((p, side, recs, sizes, row[ends[p] : ends[p + 1]], place[ends[p] : ends[p + 1]], gram[ends[p] : ends[p + 1]]) for p in np.flatnonzero(np.diff(ends)).tolist())


def tiled(keys: np.ndarray, row: np.ndarray, place: np.ndarray, recs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams that many may hold become several, one for each tile (class of a record, class of another)."""
    counts = unscaled((keys >> np.uint64(48)).astype(np.uint8))
    hot = np.flatnonzero(counts > HOT)
    if not len(hot):
        return keys, row, place
    tiles = np.ceil(counts[hot] / HOT).astype(np.int64)
    own = (mix(recs[row[hot]].astype(np.uint64) + M3) % tiles.astype(np.uint64)).astype(np.int64)
    at = np.repeat(np.arange(len(hot)), tiles)
    other = np.arange(len(at)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
    low, high = np.minimum(own[at], other).astype(np.uint64), np.maximum(own[at], other).astype(np.uint64)
    fresh = keys[hot][at] & ~GRAM | (mix(keys[hot][at] + low * M1 + mix(high + M3)) & GRAM)
    cold = np.ones(len(keys), bool)
    cold[hot] = False
    keys, row, place = np.concatenate([keys[cold], fresh]), np.concatenate([row[cold], row[hot][at]]), np.concatenate([place[cold], place[hot][at]])
    order = np.lexsort((place, row))
    return keys[order], row[order], place[order]


def packed_rows(cuts: Iterator[tuple]) -> pa.RecordBatch:
    """Packed rows of (part, side, rec and n by row, and by gram: row, ascending, place, gram)."""
    out = []
    for part, side, recs, sizes, row, place, gram in cuts:
        own, number = np.unique(row, return_counts=True)
        raw = b"".join([recs[own].tobytes(), sizes[own].astype(np.int32).tobytes(), number.astype(np.int32).tobytes(), place.astype(np.int32).tobytes(), to_bytes(gram).tobytes()])
        out.append((part, len(own), len(row), side, len(raw), pa.compress(raw, codec="zstd", asbytes=True)))
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int8(), pa.int32(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], names=["part", "rows", "grams", "side", "raw", "blob"])


def unpacked_rows(batches: list[pa.RecordBatch]) -> Iterator[tuple]:
    """The reverse of ``packed_rows``."""
    for batch in batches:
        for part, rows, grams, side, raw, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "rows", "grams", "side", "raw", "blob"))):
            data = memoryview(pa.decompress(blob, raw, codec="zstd", asbytes=True))
            recs, sizes, number, place = (np.frombuffer(data[i:j], t) for i, j, t in ((0, 8 * rows, np.int64), (8 * rows, 12 * rows, np.int32), (12 * rows, 16 * rows, np.int32), (16 * rows, 16 * rows + 4 * grams, np.int32)))
            yield part, side, recs, sizes, np.repeat(np.arange(rows), number), place, from_bytes(data[16 * rows + 4 * grams :])


def unpacked(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """(rec, n, side) of each row and (row, place, gram) of each gram, of the packed rows of one part."""
    recs, sizes, sides, rows, places, grams, base = [], [], [], [], [], [], 0
    for _, side, rec, size, row, place, gram in unpacked_rows(batches):
        for into, own in zip((recs, sizes, sides, rows, places, grams), (rec, size, np.full(len(rec), side, np.int8), base + row, place, gram)):
            into.append(own)
        base += len(rec)
    return tuple(np.concatenate(x) for x in (recs, sizes, sides, rows, places, grams))


def touched(rows: DataFrame, sent: object, parts: int, side: int) -> DataFrame:
    """Stored packed rows, dealt out, with only those grams whose bin is named; nothing else is shuffled.

    ``sent`` is a broadcast pair: the ranks that order the grams, and a mark for each bin that is named.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (order, marks), rank, named = sent.value, sent.value[0].table(), sent.value[1].table().view(bool)
        for batch in batches:
            if len(batch):
                recs, sizes, _, row, place, gram = unpacked([batch])
                ok = named[bins_of(gram, marks.bits)]
                keys = rank[bins_of(gram[ok], order.bits)].astype(np.uint64) << np.uint64(48) | gram[ok]
                yield dealt(keys, row[ok], place[ok], recs, sizes.astype(np.int64), parts, side, True)

    return rows.mapInArrow(run, PACKED)


def by_part(rows: DataFrame, parts: int, run: object, schema: str) -> DataFrame:
    """``run`` over the batches of each part, one task a part."""
    return rows.repartitionById(parts, "part").mapInArrow(run, schema)


def near_enough(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of candidate (a, b, old), those whose sizes and signatures allow that they are alike."""
    lanes = [f"w{k}" for k in range(LANES)]
    left = sets.select(F.col("rec").alias("a"), F.col("n").alias("na"), *(F.col(w).alias(f"a{w}") for w in lanes))
    right = sets.select(F.col("rec").alias("b"), F.col("n").alias("nb"), *(F.col(w).alias(f"b{w}") for w in lanes))
    differ = sum((F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in lanes), F.lit(0))
    return pairs.join(left, "a").join(right, "b").where(differ <= F.col("na") + F.col("nb") - 2 * need(F.col("na"), F.col("nb"), num, den)).select("a", "b", "old")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of candidate (a, b, old), a written table, those whose whole sets are alike, with their Jaccard similarity.

    Only the sets that take part are shuffled.
    """
    named = only(sets.select("rec", "n", "grams"), pairs.select(F.explode(F.array("a", "b")).alias("rec")).distinct())
    left = named.select(F.col("rec").alias("a"), F.col("grams").alias("ga"))
    right = named.select(F.col("rec").alias("b"), F.col("grams").alias("gb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                (a, at), (b, bt) = flat_grams(part.column(3)), flat_grams(part.column(4))
                na, nb = np.diff(at), np.diff(bt)
                row = np.concatenate([np.repeat(np.arange(len(part)), na), np.repeat(np.arange(len(part)), nb)])
                # equal neighbours once each pair's two sets are sorted together; 48 bits of gram below 10 of row
                keys = row.astype(np.uint64) << np.uint64(48) | np.concatenate([a, b])
                keys.sort()
                same = keys[1:][keys[1:] == keys[:-1]] >> np.uint64(48)
                shared = np.bincount(same.astype(np.int64), minlength=len(part))
                ok = shared * (num + den) >= (na + nb) * num
                kept = part.filter(pa.array(ok))
                yield pa.record_batch([*kept.columns[:3], pa.array((shared / (na + nb - shared))[ok])], names=["a", "b", "old", "similarity"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "old", "ga", "gb").mapInArrow(run, "a long, b long, old boolean, similarity double")
