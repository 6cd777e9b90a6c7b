"""Connected components of a link table, on Spark alone.

Alternates two star steps: every vertex hangs its larger neighbours under its smallest one,
then its smaller ones. Each step is a partial minimum per vertex and one join; no list of
neighbours is ever gathered, so a hub may own a third of all links. Every round is written
to the shared folder, which cuts the lineage and survives lost executors, in as many pieces as
the links left in it need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocara.llm.common import materialize, packed


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(materialize(packed(least, 2 * n), "star"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(materialize(packed(least, n), "star"), "u")
    return hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(hung.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``(u, v)`` links of long ids -> ``(id, component)``, the smallest id reachable; vertices
    without a link are absent. Nulls, loops and repeated links change nothing; an empty table
    gives an empty result. ``rows``, if known, is how many links there are at most."""
    edges = edges.where("u is not null and v is not null and u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges if rows is None else packed(edges, rows), "links")
    before = _digest(edges)
    while n := before[0]:
        # a large star makes no more links than it gets, a small star at most twice as many
        edges = materialize(packed(_large_star(edges, n).distinct(), n), "links")
        edges = materialize(packed(_small_star(edges, n).distinct(), 2 * n), "links")
        after = _digest(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
