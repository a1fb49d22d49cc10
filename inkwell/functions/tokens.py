"""Token counts under an injected tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.columns import word_count

WORDS = "whitespace-words"


def with_token_count(df: DataFrame, text: str, name: str = WORDS, make: Callable[[], Callable[[str], int]] | None = None) -> DataFrame:
    """Adds ``tokens`` and ``tokenizer``. Without ``make`` the tokens are words between white space,
    counted in the JVM; with it, ``make()`` is called once a worker and gives the count of a text."""
    if make is None:
        return df.withColumns({"tokens": word_count(text).cast("long"), "tokenizer": F.lit(WORDS)})

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = make()
        for s in batches:
            yield s.map(lambda x: count(x) if x else 0).astype("int64")

    tokens: Column = run(F.col(text))
    return df.withColumns({"tokens": tokens, "tokenizer": F.lit(name)})


def byte_pair_counter(path: str, pattern: str) -> Callable[[], Callable[[str], int]]:
    """``make`` for a byte-pair vocabulary file of lines "base64 rank", which the driver reads: the exact count of its tokens."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}

    def make() -> Callable[[str], int]:
        import tiktoken

        of = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(of.encode_ordinary(text))

    return make
