"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from vocara.session import materialize, scratch_path, store

__all__ = ["materialize", "scratch_path", "store", "read_table", "packed", "per_row", "mix64", "PARTS_PER_GB"]

PARTS_PER_GB = 100
#: Narrow rows, of a few numbers each, that one task works on and writes.
ROWS_PER_TASK = 250_000
GOLDEN = 0x9E3779B97F4A7C15


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, made from at most ``rows`` narrow rows, in as many pieces as these need and at least
    one per core: a small table is not written by hundreds of tasks. Nothing is shuffled."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / ROWS_PER_TASK)))


def per_row(fn: Callable[..., list[tuple]], columns: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``fn(*row)`` gives output rows; they leave in frames of bounded length, so a batch of long
    texts never multiplies in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch[c] for c in batch.columns), strict=True):
                out.extend(fn(*row))
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over the whole range (multiply and shift, three rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(GOLDEN)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
