"""Filling fixed-capacity containers with items (problem 6).

Items are dealt at random, by a hash of their key, to shards of about ``BINS`` containers each. In a
shard, items are first laid best-fit, largest first. Then local search over the underfull containers
raises the sum of squared fills: from the emptiest container on, an item moves to a fuller one,
changes places with a smaller item there, or, where neither gains, takes the place of two smaller ones;
each step leaves a fuller container fuller, until the emptiest are empty and fall away. The search ends
when no step is left, or no container can fall away because the items need that many in any case.

What lies in containers that remain underfull goes to the next level, in shards of ``BINS`` containers'
worth again, until one shard is left, or until a level no longer halves the shards of a window: then its
items fill no better (items of 60 % of the capacity, say), and the level's containers stand. So no group
ever holds more than a shard's worth of items, and the number of levels is at most the logarithm of the
number of shards.

An item is split only if it alone exceeds the capacity: into full containers and one rest, which is
packed like an item. Items of no tokens (null, empty texts) take no room and get no container.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.runtime import bounded_rows, written

BINS = 512
MOST_WINDOWS = 1000


class Shard:
    """Containers of one shard: ``bins[b]`` lists (size, item), by size; ``fill[b]`` is their sum."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.fill = capacity, [], []

    def lay(self, items: list[tuple[int, int]]) -> None:
        """Best fit, largest first: the fullest container with room, or a new one."""
        gaps: list[tuple[int, int]] = []
        for size, item in sorted(items, key=lambda x: (-x[0], x[1])):
            at = bisect_left(gaps, (size, -1))
            if at < len(gaps):
                gap, b = gaps.pop(at)
            else:
                gap, b = self.capacity, len(self.bins)
                self.bins.append([])
                self.fill.append(0)
            self.bins[b].append((size, item))
            self.fill[b] += size
            if gap > size:
                insort(gaps, (gap - size, b))
        for content in self.bins:
            content.sort()

    def put(self, source: int, own: list, target: int, theirs: list) -> None:
        for x in own:
            self.bins[source].remove(x)
            insort(self.bins[target], x)
        for y in theirs:
            self.bins[target].remove(y)
            insort(self.bins[source], y)
        change = sum(x[0] for x in own) - sum(y[0] for y in theirs)
        self.fill[target] += change
        self.fill[source] -= change

    def step(self, source: int) -> bool:
        """One exchange that takes most out of ``source`` into a container at least as full; False if there is none."""
        wide = self.capacity + 1
        fill = np.array(self.fill)
        targets = np.flatnonzero((fill < self.capacity) & (fill >= fill[source]))
        targets = targets[targets != source]
        if not len(targets):
            return False
        gap = self.capacity - fill[targets]
        content = [[size for size, _ in self.bins[t]] for t in targets]
        number = np.array([len(c) for c in content])
        starts = np.cumsum(number) - number
        size = np.concatenate([np.array(c, np.int64) for c in content])
        row = np.repeat(np.arange(len(targets)), number)
        keys = size + row * wide
        best, found = 0, None
        for k, (x, _) in enumerate(self.bins[source]):
            if k and x == self.bins[source][k - 1][0]:
                continue
            # an item that fits moves as it is; else the smallest of theirs that leaves a gain within the gap makes room
            fits = np.flatnonzero(gap >= x)
            if len(fits) and x > best:
                best, found = x, (k, fits[np.argmin(gap[fits])], ())
            at = np.searchsorted(keys, np.arange(len(targets)) * wide + np.maximum(x - gap, 0))
            ok = at < starts + number
            gain = np.where(ok, x - size[np.minimum(at, len(size) - 1)], 0)
            t = int(np.argmax(gain))
            if gain[t] > best:
                best, found = int(gain[t]), (k, t, (int(at[t] - starts[t]),))
        if not found:  # two for one
            for k, (x, _) in enumerate(self.bins[source]):
                first = np.flatnonzero(2 * size < x)
                second = np.maximum(np.searchsorted(keys, row[first] * wide + np.maximum(x - gap[row[first]] - size[first], 0)), first + 1)
                ok = second < (starts + number)[row[first]]
                gain = np.where(ok, x - size[first] - size[np.minimum(second, len(size) - 1)], 0)
                if len(first) and gain.max() > best:
                    j = int(np.argmax(gain))
                    t = int(row[first[j]])
                    best, found = int(gain[j]), (k, t, (int(first[j] - starts[t]), int(second[j] - starts[t])))
        if found:
            k, t, theirs = found
            target = int(targets[t])
            self.put(source, [self.bins[source][k]], target, [self.bins[target][i] for i in theirs])
        return bool(found)

    def search(self) -> None:
        """Steps until none is left, from the emptiest container on; what a step changes is looked at again."""
        least = -(-sum(self.fill) // self.capacity)
        while True:
            changed = False
            for source in sorted((b for b in range(len(self.bins)) if 0 < self.fill[b] < self.capacity), key=lambda b: (self.fill[b], b)):
                while self.fill[source] and sum(f > 0 for f in self.fill) > least and self.step(source):
                    changed = True
            if not changed:
                return


def pack(sizes: list[tuple[int, int]], capacity: int) -> list[list[tuple[int, int]]]:
    """Containers of (size, item) for items no larger than the capacity."""
    shard = Shard(capacity)
    shard.lay(sizes)
    shard.search()
    return [b for b in shard.bins if b]


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity = int(pdf["capacity"].iloc[0])
    pdf = pdf.sort_values(["item", "piece"], kind="stable").reset_index(drop=True)
    # the sizes reversed by position, so that a run of a task again gives the same containers
    shard, level = int(pdf["shard"].iloc[0]), int(pdf["level"].iloc[0])
    number = [-1] * len(pdf)
    used = [0] * len(pdf)
    for k, content in enumerate(pack(list(zip(pdf["tokens"].tolist(), range(len(pdf)))), capacity)):
        for size, at in content:
            number[at] = k
        total = sum(size for size, _ in content)
        for _, at in content:
            used[at] = total
    return pd.DataFrame({"window_name": pdf["window_name"], "capacity": pdf["capacity"], "item": pdf["item"], "piece": pdf["piece"], "tokens": pdf["tokens"], "container": [f"{level}-{shard}-{k}" for k in number], "used": used})


PACKED = "window_name string, capacity int, item long, piece int, tokens long, container string, used long"


def assign(sizes: DataFrame, containers: DataFrame, *, item: str = "doc_id", tokens: str = "tokens", loose: float = 0.98) -> DataFrame:
    """(window_name, capacity, item, piece, tokens, container, used): where each item lies.

    ``sizes``: unique item and its tokens; ``containers``: (window_name, capacity_tokens), a short
    table of unique names. Containers less than ``loose`` full are opened again at the next level.
    Null and non-positive sizes and capacities are left out.
    """
    kinds = containers.select("window_name", F.col("capacity_tokens").cast("int").alias("capacity")).where("capacity > 0 and window_name is not null")
    windows = bounded_rows(kinds, MOST_WINDOWS, "the table of containers")
    own = sizes.select(F.col(item).cast("long").alias("item"), F.col(tokens).cast("long").alias("tokens")).where("tokens > 0 and item is not null")
    pieces = own.withColumn("w", F.explode(F.array(*(F.struct(F.lit(n).alias("window_name"), F.lit(c).alias("capacity")) for n, c in windows)))) if windows else own.limit(0).withColumn("w", F.struct(F.lit("").alias("window_name"), F.lit(1).alias("capacity")))
    pieces = pieces.select("w.window_name", "w.capacity", "item", "tokens")
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / F.col("capacity")).cast("int"))))
    pieces = pieces.withColumn("tokens", F.least(F.col("capacity").cast("long"), F.col("tokens") - F.col("piece").cast("long") * F.col("capacity")))
    full = F.col("tokens") == F.col("capacity")
    done = [pieces.where(full).select("window_name", "capacity", "item", "piece", "tokens", F.concat_ws("-", F.lit("full"), "item", "piece").alias("container"), F.col("tokens").alias("used"))]

    def shards_of(rest: DataFrame) -> dict[str, int]:
        """The shards of each window, which are not more than there are windows, counted where the rows are."""
        totals = rest.groupBy("window_name").agg(F.sum("tokens").alias("tokens"), F.first("capacity").alias("capacity")).collect()
        return {r["window_name"]: -(-r["tokens"] // (r["capacity"] * BINS)) for r in totals}

    rest, level = pieces.where(~full).select("window_name", "capacity", "item", "piece", "tokens"), 0
    shards = shards_of(rest)
    while shards:
        number = F.create_map(*(F.lit(x) for pair in shards.items() for x in pair))[F.col("window_name")]
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64("item", "piece", F.lit(level)), number).cast("int")).withColumn("level", F.lit(level))
        laid = dealt.groupBy("window_name", "capacity", "shard").applyInPandas(_packed, PACKED)
        if max(shards.values()) == 1:
            done.append(laid)
            break
        laid = written(laid, "packed")
        open_ = (F.col("used") < F.col("capacity") * loose) & F.col("window_name").isin([n for n, k in shards.items() if k > 1])
        fewer = {n: k for n, k in shards_of(laid.where(open_)).items() if 2 * k <= shards[n]}
        open_ = open_ & F.col("window_name").isin([*fewer])
        done.append(laid.where(~open_))
        rest, shards, level = laid.where(open_).select("window_name", "capacity", "item", "piece", "tokens"), fewer, level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def unused(assigned: DataFrame) -> DataFrame:
    """Containers, tokens and unused share of each window."""
    bins = assigned.groupBy("window_name", "capacity", "container").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    return bins.groupBy("window_name", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"), F.sum(F.col("capacity") - F.col("used")).alias("unused"), F.round(F.sum(F.col("capacity") - F.col("used")) / (F.count(F.lit(1)) * F.first("capacity")), 6).alias("unused_share"))


def checked(assigned: DataFrame, sizes: DataFrame, *, item: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(window_name, capacity, overfull, wrongly_split, wrong_sum, items): what must be 0, and the items laid."""
    window = ["window_name", "capacity"]
    bins = assigned.groupBy(*window, "container").agg(F.sum("tokens").alias("used"), F.max("used").alias("said"))
    bins = bins.groupBy(*window).agg(F.count_if((F.col("used") > F.col("capacity")) | (F.col("used") != F.col("said"))).alias("overfull"))
    own = assigned.groupBy(*window, "item").agg(F.sum("tokens").alias("laid"), F.count(F.lit(1)).alias("pieces"))
    own = own.join(sizes.select(F.col(item).alias("item"), F.col(tokens).alias("size")), "item", "left")
    split = F.col("pieces") != F.ceil(F.col("size") / F.col("capacity"))
    own = own.groupBy(*window).agg(F.count_if(split).alias("wrongly_split"), F.count_if(~F.col("laid").eqNullSafe(F.col("size"))).alias("wrong_sum"), F.count(F.lit(1)).alias("items"))
    return bins.join(own, window)
