"""Deduplicating new batches against all history (problem 2).

A record is a string over shingles: the distinct three-word shingles of its abstract in one global
order, rarest first. Between two such strings the edit distance by insertion and deletion is the
size of the symmetric difference, so "alike" (|A∩B| / |A∪B| >= num/den) is the same as an edit
distance of at most ``floor((a+b) (den-num) / (num+den))``. The segment index stores of each accepted
string a fixed number of segments for its length, with length and place: its first
``prefix(n) = n - ceil(num n/den) + 1`` symbols, one each, and the remainder, which is never probed.
(Segments of even width would pair common shingles with each other by chance; the rare end of the
string holds as many segments as a bound needs.) A new batch probes the index with its own segments:
same content, compatible length, place within what the edits allow, and a signature within the bound.
Candidates are verified by their exact distance; segments of accepted records are appended.

The index is kept in packed rows. A batch sends the executors a bit for each bin of the sketch that counts
shingles, of fixed size; the index is read where it lies, and only segments in bins the batch has are
shuffled. The keys and sets of accepted records are joined with the batch's alone, which are sent to
where the history lies if they are few. The order of shingles is kept with the index and taken anew,
over all counts, whenever the sets have doubled since; so what becomes common later becomes common in the
index too, and the cost of ordering again is a constant share of all work.

Identifiers take part as keys: archive number, PMID, preprint number. All records that share a key,
or whose abstracts are alike, match. Acceptance runs in order of ``rec``: one task decides if at most
``DECIDED`` links are open; before, in each round, a record that is the first undecided one under all its
keys is accepted, and whatever shares a key with it is a case. A key that a third of all rows share
costs one pre-aggregated minimum a round.

Nulls, placeholders and texts under 30 words name nothing and match nothing. Whole abstracts are
read. Repeated rows must have their own ``rec``; rows without one are left out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.prefixes import Counts, Ranks, bits_for, classes, counted, named_by, near_enough, only, prefix_rows, ranks_of, sendable, sized, touched, verified
from inkwell.llm.trie_join import candidate_pairs
from inkwell.llm.words import format_characters, shingle_sets
from inkwell.runtime import MOST_SENT, bounded_rows, is_small, release, written

NUMBER = re.compile(r"\d{5,}")
ORDER = "bits int, blocks array<binary>, order_bits int, ranks binary, seen long, ordered long"
#: Links among undecided records that one task may decide.
DECIDED = 2_000_000
#: A turn over a backlog takes this many times the records of all turns before it.
GROWTH = 8
#: A turn costs some seconds however few its records are, so none but the last is smaller.
LEAST_TURN = 1000


def named(value: str | None, column: str) -> str | None:
    """The number that a ``pmcid`` or ``id`` names, with the letter of its kind: A, P or M."""
    if not value:
        return None
    if not value.isascii():
        value = unicodedata.normalize("NFKC", format_characters().sub("", value))
    found = NUMBER.search(value)
    if not found or not (number := int(found[0])):
        return None
    said = value.upper()
    return ("A" if column == "pmcid" or "PMC" in said else "P" if "PPR" in said else "M") + str(number)


def identifier_keys(df: DataFrame, rec: str, pmcid: str, ident: str) -> DataFrame:
    """(rec, key): the numbers that each record names, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recs, keys = [], []
            for r, p, i in zip(*(c.to_pylist() for c in batch.columns)):
                for key in {named(p, "pmcid"), named(i, "id")} - {None}:
                    recs.append(r)
                    keys.append(key)
            yield pa.record_batch([pa.array(recs, pa.int64()), pa.array(keys, pa.string())], names=["rec", "key"])

    own = df.select(df[rec].cast("long").alias("rec"), df[pmcid].cast("string"), df[ident].cast("string")).where("rec is not null")
    return own.mapInArrow(run, "rec long, key string")


@dataclass
class History:
    """What is kept of accepted records: their keys, sets and segments, the counts of shingles and their order."""

    keys: DataFrame
    sets: DataFrame
    segments: DataFrame
    counts: Counts  # of shingles, by bin
    order: Ranks  # of shingles
    seen: int  # sets counted
    ordered: int  # sets counted when the order was taken

    def save(self, path: str, mode: str = "append", reordered: bool = False) -> None:
        """Append keys, sets and segments to the tables at ``path``, or begin them ("overwrite").

        Where the order was taken anew, the segments are those of all sets, and written over.
        """
        for name in ("keys", "sets", "segments"):
            getattr(self, name).write.mode("overwrite" if reordered and name == "segments" else mode).parquet(f"{path}/{name}")
        row = (*self.counts, *self.order, self.seen, self.ordered)
        self.keys.sparkSession.createDataFrame([row], ORDER).write.mode("overwrite").parquet(f"{path}/order")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> History:
        bits, blocks, order_bits, data, seen, ordered = spark.read.parquet(f"{path}/order").first()
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("keys", "sets", "segments")), Counts(bits, [bytes(b) for b in blocks]), Ranks(order_bits, bytes(data)), seen, ordered)


@dataclass
class Checked:
    cases: DataFrame  # (a, b): b repeats the accepted a
    accepted: DataFrame  # (rec)
    added: History  # to append
    reordered: bool  # whether the order was taken anew

    def save(self, path: str, mode: str = "append") -> None:
        self.added.save(path, mode, self.reordered)


def decided(several: DataFrame, rejected: DataFrame) -> DataFrame:
    """(a, b): greedy acceptance in order of rec, in one task; b matches accepted records, a is the smallest.

    several: (rec, key), all rows of a key match each other; rejected: (rec) that are not accepted anyway.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named: dict[int, list[str]] = {}
        closed = set()
        for batch in batches:
            for rec, key, out in zip(*(c.to_pylist() for c in batch.columns)):
                named.setdefault(rec, []).append(key)
                if out:
                    closed.add(rec)
        taken: dict[str, int] = {}
        found = []
        for rec in sorted(named):
            holders = [taken[k] for k in named[rec] if k in taken]
            if holders:
                found.append((min(holders), rec))
            elif rec not in closed:
                taken.update(dict.fromkeys(named[rec], rec))
        yield pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    marked = several.join(rejected.distinct().withColumn("out", F.lit(True)), "rec", "left")
    return marked.select("rec", "key", F.coalesce("out", F.lit(False)).alias("out")).repartition(1).mapInArrow(run, "a long, b long")


def resolve(incidence: DataFrame, rejected: DataFrame) -> DataFrame:
    """As ``decided``, for any number of rows: rounds over all tasks until one task can decide the rest."""
    if is_small(incidence, DECIDED):
        return decided(incidence, rejected)
    shared = incidence.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("key")
    several = written(incidence.join(shared, "key", "left_semi"), "keys")
    if is_small(several, DECIDED):
        return decided(several, rejected)
    open_, accepted = several.join(rejected, "rec", "left_anti"), []
    while not is_small(open_, DECIDED):
        heads = open_.groupBy("key").agg(F.min("rec").alias("head"))
        first = written(open_.join(heads, "key").groupBy("rec").agg(F.min(F.col("rec") == F.col("head")).alias("first")).where("first").select("rec"), "accepted")
        accepted.append(first)
        taken = open_.join(first, "rec", "left_semi").select("key").distinct()
        gone = open_.join(taken, "key", "left_semi").select("rec").distinct()
        open_ = written(open_.join(gone, "rec", "left_anti"), "open")
    lost = decided(open_, rejected.limit(0)).select(F.col("b").alias("rec"))
    holders = open_.select("rec").distinct().join(lost, "rec", "left_anti")
    for part in accepted:
        holders = holders.unionByName(part)
    holders = several.join(holders, "rec").select("key", F.col("rec").alias("a"))
    return several.join(holders, "key").where("a < rec").groupBy("rec").agg(F.min("a").alias("a")).select("a", F.col("rec").alias("b"))


def check_batch(batch: DataFrame, history: History | None = None, *, rec: str = "rec_no", pmcid: str = "pmcid", ident: str = "id", abstract: str = "abstract", num: int = 3, den: int = 5, width: int = 3, least_words: int = 30) -> Checked:
    """Check a batch against the accepted history; without one, the batch begins it.

    The batch may hold several batches: acceptance follows ``rec``, so that one call over all of
    them and one call for each of them in turn give the same cases. History comes before the batch.
    """
    spark = batch.sparkSession
    sets = written(shingle_sets(batch, rec, abstract, width=width, least_words=least_words), "sets")
    members = written(classes(sets), "members")
    own, grams, parts = sized(sets)
    reps = only(sets, members.where("rec <> rep").select("rec"), "left_anti", own <= MOST_SENT)
    seen = own + (history.seen if history else 0)
    anew = history is None or seen >= 2 * history.ordered
    if history is None:
        counts = mine = counted(sets, bits_for(grams))
    else:
        bits = max(history.counts.bits, bits_for(grams)) if anew else history.counts.bits
        mine = counted(sets, bits)
        counts = mine.plus(history.counts if bits == history.counts.bits else counted(history.sets, bits))
    order = ranks_of(counts) if anew else history.order
    sent = spark.sparkContext.broadcast((order, order if anew else ranks_of(counts)))
    rows = prefix_rows(reps, sent, parts, num, den)
    if history is not None:
        stored = prefix_rows(history.sets, spark.sparkContext.broadcast((order, None)), parts, num, den, 0, False) if anew else history.segments
        rows = rows.unionByName(touched(stored, spark.sparkContext.broadcast((order, named_by(mine))), parts, 0))
    pairs = written(candidate_pairs(rows, parts, num, den), "pairs")
    both = sets if history is None else only(history.sets, pairs.where("old").select(F.col("a").alias("rec")).distinct()).unionByName(sets)
    links = verified(written(near_enough(pairs, both, num, den), "near"), both, num, den)
    links = links if history is None else written(links, "links")

    ids = written(identifier_keys(batch, rec, pmcid, ident), "ids")
    same = members.where("copies > 1").select("rec", F.concat(F.lit("S"), "rep").alias("key"))
    edge = links.where("not old").select(F.explode(F.array("a", "b")).alias("rep"), F.concat_ws(":", F.lit("E"), "a", "b").alias("key"))
    linked = members.select("rec", "rep").join(edge, "rep").select("rec", "key")
    incidence = ids.unionByName(same).unionByName(linked)

    if history is None:
        cases = resolve(incidence, spark.createDataFrame([], "rec long"))
    else:
        keys = ids.withColumnRenamed("rec", "b")
        by_key = history.keys.select("key", F.col("rec").alias("a")).join(sendable(keys), "key").select("a", "b")
        by_text = links.where("old").select("a", F.col("b").alias("rep")).join(members.select("rec", "rep"), "rep").select("a", F.col("rec").alias("b"))
        hits = by_key.unionByName(by_text).groupBy("b").agg(F.min("a").alias("a"))
        cases = resolve(incidence, hits.select(F.col("b").alias("rec"))).unionByName(hits.select("a", "b")).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    cases = written(cases, "cases")

    repeats = sendable(cases.select(F.col("b").alias("rec")))
    everyone = batch.select(batch[rec].cast("long").alias("rec")).where("rec is not null").distinct()
    kept = sets.join(repeats, "rec", "left_anti")
    stored = spark.sparkContext.broadcast((order, None))
    before = history.sets.unionByName(kept) if history is not None and anew else kept
    added = History(ids.join(repeats, "rec", "left_anti").select("key", "rec"), kept, prefix_rows(before, stored, parts, num, den, 0, False), counts, order, seen, seen if anew else history.ordered)
    return Checked(cases, everyone.join(repeats, "rec", "left_anti"), added, anew)


def turns(batches: DataFrame, rec: str, batch: str) -> list[int | None]:
    """The last rec of each turn over a backlog of batches; None for the last turn, which takes the rest.

    A turn takes batches until it holds ``GROWTH`` times the records before it and ``LEAST_TURN`` at least, so that reading the history once a turn costs a constant share of all work. Batches whose
    recs overlap go together; rows without a batch go where their rec falls.
    """
    spans = bounded_rows(batches.where(F.col(batch).isNotNull()).groupBy(batch).agg(F.min(rec).alias("low"), F.max(rec).alias("high"), F.count(rec).alias("rows")), 100_000, "the table of batches")
    spans = sorted((r["low"], r["high"], r["rows"]) for r in spans if r["low"] is not None)
    ends: list[int | None] = []
    before = own = 0
    high = None
    for k, (low, top, rows) in enumerate(spans):
        high = top if high is None else max(high, top)
        own += rows
        if k + 1 < len(spans) and high < spans[k + 1][0] and own >= max(LEAST_TURN, GROWTH * before):
            ends.append(high)
            before, own = before + own, 0
    return [*ends, None]


def check_backlog(batches: DataFrame, *, rec: str = "rec_no", batch: str = "batch_no", **how: object) -> DataFrame:
    """(a, b): the cases of all batches, each turn of batches checked against what the turns before accepted."""
    history, found, last = None, None, None
    for end in turns(batches, rec, batch):
        release(batches.sparkSession)
        own = batches.where(F.lit(True) if last is None else F.col(rec) > last).where(F.lit(True) if end is None else F.col(rec) <= end)
        checked = check_batch(own, history, rec=rec, **how)
        found = checked.cases if found is None else found.unionByName(checked.cases)
        more, last = checked.added, end
        if history is not None:
            more.keys, more.sets = history.keys.unionByName(more.keys), history.sets.unionByName(more.sets)
            more.segments = more.segments if checked.reordered else history.segments.unionByName(more.segments)
        history = more
    return found
