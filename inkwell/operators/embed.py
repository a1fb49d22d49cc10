"""Vectors for chunks through an injected provider."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from inkwell.runtime import written

Provider = Callable[[list[str]], list[list[float]]]


def hashed_provider(dim: int = 16) -> Provider:
    """Deterministic vectors from a hash of the text, for tests and dry runs."""

    def embed(texts: list[str]) -> list[list[float]]:
        return [(np.frombuffer(hashlib.shake_256(t.encode()).digest(2 * dim), np.uint16).astype(np.float32) / 65535 - 0.5).tolist() for t in texts]

    return embed


def retried(provider: Provider, attempts: int = 6, most_wait: float = 60.0) -> Provider:
    """Tries again after a random, growing wait; the last failure ends the task, and with it the run."""

    def embed(texts: list[str]) -> list[list[float]]:
        for attempt in range(1, attempts + 1):
            try:
                return provider(texts)
            except Exception:
                if attempt == attempts:
                    raise
                time.sleep(random.uniform(0, min(most_wait, 2.0**attempt)))
        raise AssertionError

    return embed


def numbered(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Adds ``batch``: rows in order of ``key``, which is unique, in batches of ``size`` from 0.

    Rows are sorted by range over all tasks; only the number of rows in each range is collected, so no task numbers all rows.
    """
    ranged = written(rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = sorted((r[0], r[1]) for r in ranged.groupBy("__part").agg(F.count(F.lit(1))).collect())
    before, total = [], 0
    for part, number in counts:
        before.append((part, total))
        total += number
    starts = rows.sparkSession.createDataFrame(before, "__part int, __before long")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    own = ranged.withColumn("__at", place).join(F.broadcast(starts), "__part")
    return own.withColumn("batch", F.floor((F.col("__at") + F.col("__before")) / size)).drop("__part", "__at", "__before")


def embed_chunks(chunks: DataFrame, make: Callable[[], Provider], model: str, *, text: str = "text", batch: int = 50) -> DataFrame:
    """All columns, with embedding and embedding_model. The provider sees line breaks as spaces; the stored
    text is unchanged. Null texts are sent as ''. ``make`` is called once a task; calls hold up to ``batch`` texts."""
    schema = StructType([*chunks.schema.fields, StructField("embedding", ArrayType(FloatType())), StructField("embedding_model", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = retried(make())
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch].copy()
                sent = ["" if t is None else t.replace("\n", " ") for t in part[text].astype(object).where(part[text].notna(), None)]
                part["embedding"] = [list(map(float, v)) for v in provider(sent)]
                part["embedding_model"] = model
                yield part

    return chunks.mapInPandas(run, schema)
