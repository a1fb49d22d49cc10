"""Texts to chunks: word windows, paragraph grouping, paragraph grouping with an overlap bridge.

All three are native expressions over arrays; a text is one row from scan to chunk list, so nothing
is shuffled. Null, empty and blank texts give no chunk. Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.columns import SPACE, col, collapse, strip, words

STATE = "struct<done:array<string>,open:array<string>,held:int>"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it and from within which functions."""
    return F.transform(F.array(value), use)[0]


def word_windows(text: Column | str, target: int, overlap: int) -> Column:
    """Windows of ``target`` words, each beginning ``overlap`` words before the end of the last; the last ends with the text."""
    if not 0 <= overlap < target:
        raise ValueError("overlap must be less than target, and neither negative")
    step = target - overlap

    def windows(w: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(w) - target) / F.lit(step)).cast("int"))
        cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(target)), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(cut)

    return once(words(text), windows)


def blocks(w: Column, target: int) -> Column:
    """An array of words in blocks of ``target``."""
    cut = lambda own: F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / F.lit(target)).cast("int")), lambda i: F.array_join(F.slice(own, i * target + 1, F.lit(target)), " "))
    return once(w, cut)


def paragraphs(text: Column | str, variant: str = "full") -> Column:
    """Parts between blank lines, without blank ones. pilot: inner white space kept; full: line ends unified and white space collapsed."""
    t = F.coalesce(col(text), F.lit(""))
    if variant == "full":
        t = strip(F.regexp_replace(t, "\r\n?", "\n"))
    tidy = collapse if variant == "full" else strip
    return F.filter(F.transform(F.split(t, f"\n{SPACE}*\n+"), tidy), lambda p: p != "")


def _fold(parts: Column, huge: int, step) -> Column:
    """Fold over paragraphs: those over ``huge`` words close the group and are cut in blocks; ``step`` adds any other."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), empty.alias("open"), F.lit(0).alias("held")).cast(STATE)
    closed = lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(F.array_join(s["open"], "\n\n")))).otherwise(s["done"])

    def add(s: Column, part: Column) -> Column:
        p, n = part["p"], part["n"]
        cut = F.struct(F.concat(closed(s), step.cut(words(p))).alias("done"), empty.alias("open"), F.lit(0).alias("held"))
        return F.when(n > huge, cut).otherwise(step(s, p, n, closed)).cast(STATE)

    counted = F.transform(parts, lambda p: F.struct(p.alias("p"), F.size(words(p)).alias("n")))
    return F.aggregate(counted, start, add, closed)


class _Plain:
    def __init__(self, target: int):
        self.target = target

    def cut(self, w: Column) -> Column:
        return blocks(w, self.target)

    def bridge(self, s: Column) -> Column | None:
        return None

    def __call__(self, s: Column, p: Column, n: Column, closed) -> Column:
        fits = (F.size(s["open"]) == 0) | (s["held"] + n <= self.target)
        grown = F.struct(s["done"].alias("done"), F.concat(s["open"], F.array(p)).alias("open"), (s["held"] + n).alias("held"))
        lead = self.bridge(s)
        head = F.array(p) if lead is None else F.array(lead, p)
        held = n if lead is None else F.size(words(lead)) + n
        fresh = F.struct(closed(s).alias("done"), head.alias("open"), held.alias("held"))
        return F.when(fits, grown).otherwise(fresh)


class _Bridged(_Plain):
    def __init__(self, target: int, overlap: int):
        super().__init__(target)
        self.overlap = overlap

    def bridge(self, s: Column) -> Column:
        last = F.element_at(s["open"], -1)

        def lead(w: Column) -> Column:
            # an overlap of 0 takes the whole paragraph behind the mark
            tail = F.slice(w, -self.overlap, self.overlap) if self.overlap else w
            return F.when(F.size(w) > self.overlap, F.concat(F.lit("[...] "), F.array_join(tail, " "))).otherwise(last)

        return once(words(last), lead)


def grouped_paragraphs(text: Column | str, target: int) -> Column:
    """pilot: paragraphs added while the sum stays within ``target``; over 1.5 targets, cut in windows."""
    return _fold(paragraphs(text, "pilot"), int(target * 1.5), _Plain(target))


def bridged_paragraphs(text: Column | str, target: int, overlap: int) -> Column:
    """full: paragraphs over ``target`` are cut; otherwise, on overflow, the next group begins with the last
    paragraph, or with '[...] ' and its last ``overlap`` words. The bridge counts; a bridged group may exceed the target."""
    return _fold(paragraphs(text, "full"), target, _Bridged(target, overlap))


def exploded(df: DataFrame, chunks: Column, keep: list, infix: str = "", year: str = "year", pmcid: str = "pmcid") -> DataFrame:
    """A row a chunk: ``keep``, chunk_id '<year>_<pmcid>_[<infix>_]0001', chunk_index from 1, text."""
    mark = f"_{infix}_" if infix else "_"
    rows = df.select(*keep, F.col(year).alias("__y"), F.col(pmcid).alias("__p"), F.posexplode(chunks).alias("__i", "text"))
    number = F.lpad((F.col("__i") + 1).cast("string"), 4, "0")
    number = F.when(F.col("__i") >= 9999, (F.col("__i") + 1).cast("string")).otherwise(number)
    ident = F.concat(F.coalesce(F.col("__y").cast("string"), F.lit("UNKNOWN_YEAR")), F.lit("_"), F.coalesce(F.col("__p"), F.lit("")), F.lit(mark), number)
    return rows.withColumns({"chunk_id": ident, "chunk_index": F.col("__i") + 1}).drop("__y", "__p", "__i")


def fulltext_chunks(docs: DataFrame, meta: DataFrame, *, target: int = 650, overlap: int = 120) -> DataFrame:
    """Chunks of (pmcid, year, text) with title and journal of ``meta`` (unique pmcid, title, journal), in the lean form."""
    both = docs.select("pmcid", "year", "text").join(meta.select("pmcid", "title", "journal"), "pmcid", "left")
    rows = exploded(both, bridged_paragraphs("text", target, overlap), ["pmcid", "year", "title", "journal"])
    return rows.withColumn("source_type", F.lit("fulltext"))


def metadata_chunks(meta: DataFrame, payload: Column, *, target: int = 650, overlap: int = 120) -> DataFrame:
    rows = exploded(meta.withColumn("__payload", payload), bridged_paragraphs("__payload", target, overlap), ["pmcid", "year", "title", "journal"], infix="META")
    return rows.withColumn("source_type", F.lit("metadata_only"))


def pilot_chunks(docs: DataFrame, text: str, source_type: str, *, target: int = 650, overlap: int = 150, mode: str = "paragraph") -> DataFrame:
    """Chunks of gated articles (pmcid, year, journal, title, journal_tier, keyword_relevant, text), ten columns."""
    chunks = grouped_paragraphs(text, target) if mode == "paragraph" else word_windows(text, target, overlap)
    keep = ["pmcid", "year", "journal", "title", "journal_tier", "keyword_relevant"]
    return exploded(docs.where(strip(F.coalesce(F.col(text), F.lit(""))) != ""), chunks, keep).withColumn("source_type", F.lit(source_type))

