"""Most similar vectors for every vector: a hash-prefix forest (problem 1).

Each of ``trees`` trees gives a vector a long hash string: ``SYMBOLS`` symbols, each the nearest axis,
with its sign, of a random rotation onto 8 dimensions (4 bits). A tree is the array of its strings
in sorted order, split by range over the cluster. A query descends all trees at once to the longest
prefix that others share and ascends, in all trees together, symbol by symbol, until the subtrees
under its prefixes hold ``wanted`` vectors; the vectors of those subtrees are its candidates. How far
it must ascend is read off a bounded sample of the vectors (``SAMPLE`` rows, which also gives the split
points); every vector is indexed and every vector is a query. In the arrays, the queries that stop
at one node are scored against the node's interval in one matrix product.

Trees carry vectors as 12-bit numbers. They keep every candidate whose score comes within the error of
that rounding of the k-th best, or of being returned, however many these are; the pairs are then scored
again on the vectors as they are.

A query is sent to every part of a tree that its node reaches into, so a node across split points is searched
whole. Vectors of one full string that are more than a part should hold lie in several parts.

Copies: equal vectors are one entry of the forest, whatever their number, and are expanded at the
end, so that a vector which a third of all rows repeat loads no task. Vectors that are nearly equal
have equal strings; their node is scored whole, in blocks, however many it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.runtime import written

SYMBOLS, SYMBOL_BITS, AXES = 15, 4, 8
SAMPLE = 16384
NODE = 4096
STEPS = 2047
#: Candidates a query ascends for, over up to WANTED_AT vectors; beyond, it grows as their square root.
WANTED, WANTED_AT = 1600, 250_000
SEED = 977
#: Vectors in a part of a tree.
PART = 64_000


@lru_cache(8)
def rotations(dim: int, trees: int) -> np.ndarray:
    """dim x (trees * SYMBOLS * AXES): columns of random orthonormal frames."""
    rng = np.random.default_rng([SEED, dim])
    frames = []
    for _ in range(trees * SYMBOLS):
        frame = np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-AXES // dim))], 1)
        frames.append(frame[:, :AXES])
    return np.concatenate(frames, 1).astype(np.float32)


def hash_strings(unit: np.ndarray, trees: int) -> np.ndarray:
    """rows x trees: the hash strings as whole numbers, first symbol highest."""
    out = np.empty((len(unit), trees), np.int64)
    frames = rotations(unit.shape[1], trees)
    for start in range(0, len(unit), 2048):
        part = unit[start : start + 2048]
        turned = (part @ frames).reshape(len(part), trees, SYMBOLS, AXES)
        axis = np.abs(turned).argmax(3)
        positive = np.take_along_axis(turned, axis[..., None], 3)[..., 0] > 0
        symbol = axis * 2 + positive
        code = np.zeros(symbol.shape[:2], np.int64)
        for s in range(SYMBOLS):
            code = code << SYMBOL_BITS | symbol[:, :, s]
        out[start : start + len(part)] = code
    return out


def levels(codes: np.ndarray, sample: np.ndarray, scale: float, wanted: int) -> np.ndarray:
    """Length of the prefix at which each query stops, ascending in all trees together."""
    level = np.zeros(len(codes), np.int64)
    todo = np.arange(len(codes))
    for length in range(SYMBOLS, 0, -1):
        shift = SYMBOL_BITS * (SYMBOLS - length)
        held = np.zeros(len(todo))
        for t in range(codes.shape[1]):
            low = codes[todo, t] >> shift << shift
            held += np.searchsorted(sample[:, t], low + (1 << shift), "left") - np.searchsorted(sample[:, t], low, "left")
        enough = held * scale >= wanted
        level[todo[enough]] = length
        todo = todo[~enough]
    level[todo] = 1
    return level


def packed_width(dim: int) -> int:
    return 3 * (-(-dim // 2))


def quantized(unit: np.ndarray) -> np.ndarray:
    """Vectors as whole numbers from -STEPS to STEPS, two in three bytes."""
    whole = (np.rint(unit / np.abs(unit).max(1, keepdims=True) * STEPS) + STEPS).astype(np.uint16)
    if whole.shape[1] % 2:
        whole = np.append(whole, np.full((len(whole), 1), STEPS, np.uint16), 1)
    a, b = whole[:, ::2], whole[:, 1::2]
    return np.stack([a >> 4, (a & 15) << 4 | b >> 8, b & 255], 2).astype(np.uint8).reshape(len(whole), packed_width(unit.shape[1]))


def unquantized(packed: np.ndarray, dim: int) -> np.ndarray:
    x, y, z = (packed[:, k::3].astype(np.int16) for k in range(3))
    return np.stack([x << 4 | y >> 4, (y & 15) << 8 | z], 2).reshape(len(packed), -1)[:, :dim].astype(np.float32) - STEPS


def rounding(dim: int, length: float = STEPS) -> float:
    """By how much at most the cosine of two quantized vectors, as long as this or longer, is wrong, or that of float32.

    A vector of that length is moved by half a step in each of its places, and normalized again.
    """
    return dim**0.5 / length + 2e-6


def normalized(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def best(query: np.ndarray, own: np.ndarray, other: np.ndarray, keep: int, least: float, margin: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, other, score) of all of ``other`` within ``margin`` of the ``keep`` best for each row of ``own``, itself not counted; positions of ``own`` are ``query``."""
    rows, cols, scores = [], [], []
    for start in range(0, len(own), 1024):
        s = own[start : start + 1024] @ other.T
        r, c = np.nonzero(s >= least) if least > -1 else (x.ravel() for x in np.indices(s.shape))
        v = s[r, c]
        if len(r) > keep * len(s) and s.shape[1] > keep + 1:
            ok = v >= np.partition(s, -keep - 1, axis=1)[r, -keep - 1] - margin
            r, c, v = r[ok], c[ok], v[ok]
        rows.append(query[start + r])
        cols.append(c)
        scores.append(v)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def near_best(r: np.ndarray, v: np.ndarray, keep: int, margin: float) -> np.ndarray:
    """Of (row, score) sorted by row and falling score: which come within ``margin`` of the row's ``keep``-th best?"""
    kth, last = np.searchsorted(r, r) + keep - 1, np.searchsorted(r, r, "right") - 1
    return (kth > last) | (v >= v[np.minimum(kth, last)] - margin)


def scored(code: np.ndarray, unit: np.ndarray, asked: np.ndarray, level: np.ndarray, query: np.ndarray, keep: int, least: float, margin: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, vector, score) along one sorted array: the queries that stop at one node against what the node holds here.

    ``asked``, ``level`` and ``query`` are the queries' codes, levels and vectors, ``code`` and ``unit`` the
    array's, ascending by code.
    """
    for length in np.unique(level):
        shift = SYMBOL_BITS * (SYMBOLS - int(length))
        own = np.flatnonzero(level == length)
        prefix = asked[own] >> shift
        order = np.argsort(prefix, kind="stable")
        own, prefix = own[order], prefix[order]
        starts = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
        low = np.searchsorted(code, prefix[starts] << shift, "left")
        high = np.searchsorted(code, prefix[starts] + 1 << shift, "left")
        for k, start, end in zip(range(len(starts)), starts, np.r_[starts[1:], len(own)]):
            for first in range(low[k], high[k], 2 * NODE):
                last = min(high[k], first + 2 * NODE)
                for some in np.split(own[start:end], range(1024, end - start, 1024)):
                    r, c, v = best(some, query[some], unit[first:last], keep, least, margin)
                    yield r, c + first, v


def nodes_of(code: np.ndarray, level: np.ndarray, splits: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector its own part of a tree, and the first and the last part that its node reaches into.

    Parts lie between split points. Where one code holds several split points, for more vectors have it than
    a part should hold, those vectors are dealt to the parts between by ``salt``.
    """
    low, high = np.searchsorted(splits, code, "left"), np.searchsorted(splits, code, "right")
    shift = SYMBOL_BITS * (SYMBOLS - level)
    node = code >> shift << shift
    first, last = np.searchsorted(splits, node, "left"), np.searchsorted(splits, node + (np.int64(1) << shift) - 1, "right")
    return low + (salt.view(np.uint64) % (high - low + 1).astype(np.uint64)).astype(np.int64), first, last


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), dim)


def usable(embedding: Column, dim: int) -> Column:
    """Exactly ``dim`` finite values, not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return embedding.isNotNull() & (F.size(embedding) == dim) & F.coalesce(finite, F.lit(False)) & F.exists(embedding, lambda x: x != 0)


def most_similar(df: DataFrame, key: str, embedding: str, *, k: int = 5, dim: int = 64, trees: int = 10, wanted: int | None = None, least: float = -1.0, partitions: int | None = None) -> DataFrame:
    """(a, b, similarity, place): the ``k`` most similar other vectors b of each a, found in the forest.

    Equal cosines are ordered by key bytes. Null, short, long, zero and not-finite vectors and null
    keys take no part. Rows repeated under one key must hold equal vectors and count once; if they
    differ, each distinct vector of the key takes part. With ``least``, only similarities from there on
    are returned. Cosine is computed in double precision from the stored values. Accuracy: see the
    README for the recall measured against brute force.
    """
    spark = df.sparkSession
    own = df.select(df[key].cast("string").alias("id"), df[embedding].cast("array<float>").alias("v")).where(usable(F.col("v"), dim) & F.col("id").isNotNull())
    own = own.select("id", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"), "v")
    entries = written(own.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")), "vectors")
    total = entries.count()
    if not total:
        return spark.createDataFrame([], "a string, b string, similarity double, place int")

    wanted = wanted or round(WANTED * max(1.0, total / WANTED_AT) ** 0.5)
    share = min(1.0, 1.2 * SAMPLE / total)
    drawn = entries.where(F.pmod(F.xxhash64("h1", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000)).select("v").limit(SAMPLE)
    drawn = np.array([r[0] for r in drawn.toLocalIterator()], np.float32).reshape(-1, dim)
    sample = np.sort(hash_strings(normalized(drawn), trees), axis=0) if len(drawn) else np.zeros((0, trees), np.int64)
    parts = partitions or max(trees, int(spark.conf.get("spark.sql.shuffle.partitions")), total * trees // PART)
    each = max(1, round(parts / trees))
    splits = sample[np.linspace(0, len(sample), each + 1).astype(int)[1:-1]] if len(sample) else sample
    scale = total / max(1, len(sample))
    sent = spark.sparkContext.broadcast((sample, splits, scale))
    keep, floor = k, least - rounding(dim) if least > -1 else -1.0

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, splits, scale = sent.value
        for batch in batches:
            if not len(batch):
                continue
            unit, h1 = normalized(matrix(batch.column(1), dim)), batch.column(0).to_numpy()
            codes = hash_strings(unit, trees)
            level = levels(codes, sample, scale, wanted).astype(np.int8)
            small = pa.Array.from_buffers(pa.binary(packed_width(dim)), len(unit), [None, pa.py_buffer(quantized(unit).tobytes())])
            for t in range(trees):
                home, first, last = nodes_of(codes[:, t], level.astype(np.int64), splits[:, t], h1)
                at = np.repeat(np.arange(len(unit)), last - first + 1)
                part = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
                own = pa.array(at)
                yield pa.record_batch([pa.array((t * each + part).astype(np.int32)), pa.array(codes[at, t]), batch.column(0).take(own), pa.array(level[at]), small.take(own).cast(pa.binary()), pa.array(part == home[at])], names=["part", "code", "h1", "level", "q", "home"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one partition holds a range of one tree; its size is set by ``partitions``
        cols = [[] for _ in range(5)]
        for batch in batches:
            for c, name in zip(cols, ("code", "h1", "level")):
                c.append(batch.column(name).to_numpy())
            cols[4].append(batch.column("home").to_numpy(zero_copy_only=False))
            q = batch.column("q")
            at = np.frombuffer(q.buffers()[1], np.int32)[q.offset : q.offset + len(q) + 1]
            cols[3].append(np.frombuffer(q.buffers()[2], np.uint8, at[-1] - at[0], at[0]).reshape(len(q), packed_width(dim)))
        if not cols[0]:
            return
        code, h1, level, home = (np.concatenate(c) for c in (*cols[:3], cols[4]))
        order = np.argsort(code, kind="stable")
        code, h1, level, home = code[order], h1[order], level[order].astype(np.int64), np.flatnonzero(home[order])
        unit = np.empty((len(code), dim), np.float32)
        place = np.empty(len(code), np.int64)
        place[order] = np.arange(len(code))
        for q in cols[3]:  # one batch after another, so that the vectors are held once
            unit[place[: len(q)]] = unquantized(q, dim)
            place = place[len(q) :]
        cols[3].clear()
        lengths = np.linalg.norm(unit, axis=1, keepdims=True)
        unit /= lengths
        margin = 2 * rounding(dim, float(lengths.min()))
        held: list[tuple] = []

        def merged() -> pa.RecordBatch:
            r, c, v = (np.concatenate(x) for x in zip(*held))
            c = home[c]
            ok = h1[r] != h1[c]
            r, c, v = r[ok], c[ok], v[ok]
            order = np.lexsort((-v, r))
            r, c, v = r[order], c[order], v[order]
            ok = near_best(r, v, keep, margin)
            return pa.record_batch([pa.array(h1[r[ok]]), pa.array(h1[c[ok]]), pa.array(v[ok].astype(np.float32))], names=["qa", "qb", "score"])

        size = 0
        whole = len(home) == len(code)
        for part in scored(code if whole else code[home], unit if whole else unit[home], code, level, unit, keep, floor, margin):
            held.append(part)
            size += len(part[0])
            if size > 1 << 20:
                yield merged()
                held, size = [], 0
        if held:
            yield merged()

    planted = entries.select("h1", "v").mapInArrow(plant, "part int, code long, h1 long, level byte, q binary, home boolean")
    found = planted.repartitionById(each * trees, "part").mapInArrow(walk, "qa long, qb long, score float")
    found = found.groupBy("qa", "qb").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("qa").orderBy(F.desc("score"), "qb")
    kth = F.min(F.when(F.col("r") <= k, F.col("score"))).over(Window.partitionBy("qa"))
    near = written(found.withColumn("r", F.row_number().over(rank)).withColumn("kth", kth).where(F.col("score") >= F.col("kth") - 2 * rounding(dim)).select("qa", "qb"), "near")

    left = entries.select(F.col("h1").alias("qa"), F.col("rep").alias("ra"), F.col("v").alias("va"))
    right = entries.select(F.col("h1").alias("qb"), F.col("rep").alias("rb"), F.col("v").alias("vb"))
    exact = _cosines(near.join(left, "qa").join(right, "qb"), dim).where("ra <> rb")
    if least > -1:
        exact = exact.where(F.col("similarity") >= least)
    return _with_copies(own, entries, exact, k)


def _cosines(pairs: DataFrame, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = matrix(batch.column(2), dim).astype(np.float64), matrix(batch.column(3), dim).astype(np.float64)
            cosine = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cosine)], names=["ra", "rb", "similarity"])

    return pairs.select("ra", "rb", "va", "vb").mapInArrow(run, "ra string, rb string, similarity double")


def _with_copies(own: DataFrame, entries: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Ranked pairs of keys from ranked pairs of entries; most entries stand for one key."""
    repeated = entries.where("rows > 1").select("h1", "h2", "rep")
    members = own.select("id", "h1", "h2").join(repeated, ["h1", "h2"]).select("rep", "id").distinct()
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).select("rep", "id")
    # of an entry that is paired, up to k+1 members can be among someone's k nearest
    b = exact.join(first.select(F.col("rep").alias("rb"), F.col("id").alias("b")), "rb", "left").withColumn("b", F.coalesce("b", "rb"))
    twins = first.select("rep", F.col("id").alias("b")).select(F.col("rep").alias("ra"), F.col("rep").alias("rb"), F.lit(1.0).alias("similarity"), "b")
    near = b.select("ra", "rb", "similarity", "b").unionByName(twins)
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("ra").orderBy(F.desc("similarity"), "b"))).where(F.col("r") <= k + 1)
    a = near.join(members.select(F.col("rep").alias("ra"), F.col("id").alias("a")), "ra", "left").withColumn("a", F.coalesce("a", "ra")).where("a <> b")
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    return a.select("a", "b", "similarity", place.alias("place")).where(F.col("place") <= k)
