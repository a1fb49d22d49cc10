"""Token budget per source and language (problem 3).

Both automata are tries over a vocabulary's bytes with failure links, and read a text once, byte by
byte, without going back:

* ``LongestMatch`` counts the tokens of greedy longest-match tokenization. A failure link leads from
  a node to the node of what is left after the longest tokens of its string are taken; the number of
  tokens so emitted is precomputed with the link.
* ``PairMerge`` counts the tokens of byte-pair encoding exactly. Its failure links lead to the longest
  proper suffix in the trie, and each node has the precomputed list of tokens that end there. The
  encoding of a prefix ends in the one of these tokens that is compatible with the last token of
  the encoding before it; two tokens are compatible if merging their joined bytes gives them back.
  Compatible pairs are remembered, so a text is counted in linear time.

The public vocabularies at hand are byte-pair ones, for which longest match is no exact count; so
``PairMerge`` gives the totals, and ``LongestMatch`` an estimate beside it.
"""

from __future__ import annotations

import ast
import base64
import os
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the driver finds the vocabulary files; a parameter of ``vocabulary``.
VOCABULARIES = "/opt/tokenizers"
#: The tokenizer named in the tables has no public file here; this one, of the same kind and for many languages, stands in for it.
STAND_INS = {"cl100k_base": "byte_bpe_multi_50k.tiktoken"}
CACHED = 1 << 19
#: A vocabulary is sent to every executor.
MOST_BYTES = 1 << 26


class _Trie:
    def __init__(self, tokens: list[bytes]):
        self.next: list[dict[int, int]] = [{}]
        self.depth = [0]
        self.token_at: list[int] = [-1]
        for number, token in enumerate(tokens):
            node = 0
            for byte in token:
                to = self.next[node].get(byte)
                if to is None:
                    to = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.token_at.append(-1)
                node = to
            self.token_at[node] = number

    def by_depth(self) -> Iterator[tuple[int, int, int]]:
        """(parent, byte, node), shallow nodes first."""
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for byte, to in self.next[node].items():
                yield node, byte, to
                queue.append(to)


class LongestMatch:
    """Greedy longest match. Bytes that no token begins with count as one unknown token each."""

    def __init__(self, tokens: list[bytes]):
        trie = _Trie(tokens)
        self.next = trie.next
        self.fail = [-1] * len(trie.next)
        self.pops = [0] * len(trie.next)
        for parent, byte, node in trie.by_depth():
            if trie.token_at[node] >= 0:
                self.fail[node], self.pops[node] = 0, 1
                continue
            at, popped = self.fail[parent], self.pops[parent]
            while at >= 0 and byte not in self.next[at]:
                at, popped = self.fail[at], popped + self.pops[at]
            if at >= 0:
                self.fail[node], self.pops[node] = self.next[at][byte], popped
            # else: what precedes is no sequence of tokens, which cannot be if all single bytes are tokens

    def count(self, text: bytes) -> int:
        node, total, step, fail, pops = 0, 0, self.next, self.fail, self.pops
        for byte in text:
            while byte not in step[node]:
                if node == 0:
                    total += 1
                    break
                if fail[node] < 0:
                    raise ValueError("the vocabulary must hold every single byte that its tokens hold")
                total += pops[node]
                node = fail[node]
            else:
                node = step[node][byte]
        while node:
            total += pops[node]
            node = fail[node]
        return total


class PairMerge:
    """Exact byte-pair encoding counts for a vocabulary whose order gives the merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        trie = _Trie(self.tokens)
        self.next, token_at = trie.next, trie.token_at
        self.fail = [0] * len(self.next)
        #: For each node, the tokens that end there, longest first: its own, and the list of its failure link.
        self.own = token_at
        self.link = [0] * len(self.next)
        for parent, byte, node in trie.by_depth():
            at = self.fail[parent]
            while parent and at and byte not in self.next[at]:
                at = self.fail[at]
            self.fail[node] = self.next[at].get(byte, 0) if parent else 0
            self.link[node] = self.fail[node] if token_at[self.fail[node]] >= 0 else self.link[self.fail[node]]
        self.size = [len(t) for t in self.tokens]
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[bytes, int] = {}

    def merge(self, text: bytes) -> list[bytes]:
        """The encoding by definition: merge the neighbours of lowest rank, leftmost first."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            found = [(self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(found)
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        fits = self.fits.get((a, b))
        if fits is None:
            if len(self.fits) >= CACHED:
                self.fits.clear()
            fits = self.fits[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [self.tokens[a], self.tokens[b]]
        return fits

    def count(self, piece: bytes) -> int:
        """Tokens of one piece of the pre-split text."""
        if piece in self.ranks:
            return 1
        node, step, fail = 0, self.next, self.fail
        last, counts = [-1], [0]
        for end, byte in enumerate(piece, 1):
            while node and byte not in step[node]:
                node = fail[node]
            node = step[node].get(byte, 0)
            at = node if self.own[node] >= 0 else self.link[node]
            while at:
                token = self.own[at]
                start = end - self.size[token]
                if start == 0 or (last[start] >= 0 and self.compatible(last[start], token)):
                    if start or self.merge(self.tokens[token]) == [self.tokens[token]]:
                        last.append(token)
                        counts.append(counts[start] + 1)
                        break
                at = self.link[at]
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return counts[-1]

    def __call__(self, piece: str) -> int:
        number = self.known.get(piece)
        if number is None:
            if len(self.known) >= CACHED:
                self.known.clear()
            number = self.known[piece] = self.count(piece.encode("utf-8", "surrogatepass"))
        return number


class Vocabulary(NamedTuple):
    """A byte-pair vocabulary: its file's bytes and the pattern that splits a text before the merges."""

    name: str
    data: bytes
    pattern: str

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in self.data.splitlines() if line.strip())}


def vocabulary(name: str, folder: str = VOCABULARIES) -> Vocabulary:
    """Read on the driver; executors get it by broadcast. Its size is checked, and the pattern is read as a literal."""
    if (size := os.path.getsize(path := os.path.join(folder, name))) > MOST_BYTES:
        raise ValueError(f"the vocabulary {name} has {size} bytes, more than {MOST_BYTES}")
    with open(path, "rb") as f:
        data = f.read()
    with open(os.path.join(folder, "__init__.py"), encoding="utf-8") as f:
        named = [n.value for n in ast.parse(f.read()).body if isinstance(n, ast.Assign) and getattr(n.targets[0], "id", "") == "PATTERN"]
    return Vocabulary(name, data, ast.literal_eval(named[0]))


@lru_cache(4)
def counter(of: Vocabulary, how: str) -> Callable[[str], int]:
    """The count of tokens of a text, under ``how`` (see ``token_counts``)."""
    table = of.ranks()
    if how == "longest_match":
        longest = LongestMatch(sorted(table, key=table.__getitem__))
        return lambda text: longest.count(text.encode("utf-8", "surrogatepass"))
    counts, pieces = PairMerge(table), regex.compile(of.pattern)
    return lambda text: sum(map(counts, pieces.findall(text)))


def token_counts(df: DataFrame, keep: list[str], text: str, *, of: Vocabulary, how: str = "pair_merge") -> DataFrame:
    """``keep`` and ``tokens``: the number of tokens of each whole text; 0 for a null or empty one.

    ``how``: "pair_merge" for the exact count of a byte-pair vocabulary, "longest_match" for greedy
    longest match over the same tokens.
    """
    own = df.select(*[df[c] for c in keep], df[text].cast("string").alias("__text"))
    sent = df.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(sent.value, how)
        for batch in batches:
            counts = np.zeros(len(batch), np.int64)
            for i, value in enumerate(batch.column(len(keep))):
                if value.is_valid and (t := value.as_py()):
                    counts[i] = count(t)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts)], names=[*keep, "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(run, f"{schema}, tokens long")


def one_source(c: Column) -> Column:
    """Case, outer and doubled spaces brought together; null and blank become 'unknown'."""
    flat = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.when(F.coalesce(flat, F.lit("")) == "", "unknown").otherwise(flat)


def one_language(c: Column) -> Column:
    """The language without case, spaces and region; null, blank and 'und' become 'unknown'."""
    flat = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]+)", 1)
    return F.when(F.coalesce(flat, F.lit("")).isin("", "und"), "unknown").otherwise(flat)


def one_source_type(c: Column) -> Column:
    flat = F.regexp_replace(F.lower(F.trim(c)), "[^a-z]", "")
    return F.when(flat.isin("fulltext", "full"), "fulltext").when(flat.isin("metadataonly", "metadata", "meta"), "metadata_only").otherwise("unknown")


def budget(counted: DataFrame) -> DataFrame:
    """Totals of (source, lang, domain, source_type, tokens) rows, variants brought together.

    A group of any size is pre-aggregated where its rows are; only partial sums are shuffled.
    """
    named = counted.select(one_source(F.col("source")).alias("source"), one_language(F.col("lang")).alias("lang"), one_source(F.col("domain")).alias("domain"), one_source_type(F.col("source_type")).alias("source_type"), "tokens")
    return named.groupBy("source", "lang", "domain", "source_type").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("tokens") > 0).alias("texts_with_tokens"), F.sum("tokens").alias("tokens"))
