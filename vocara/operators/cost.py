"""Token cost of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# USD per million input and output tokens.
PRICES = (
    ("claude-haiku-4-5", 1.0, 5.0),
    ("claude-opus-4-8", 5.0, 25.0),
    ("gpt-5-mini", 0.25, 2.0),
    ("gpt-5", 1.25, 10.0),
    ("text-embedding-3-small", 0.02, 0.0),
    ("text-embedding-3-large", 0.13, 0.0),
)


def price_table(spark: SparkSession, prices=PRICES) -> DataFrame:
    return spark.createDataFrame(list(prices), "model string, in_price double, out_price double")


def call_cost(calls: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Adds ``cost_usd``; a model without a price costs nothing.

    The built-in price table has six rows and is shipped; a caller's own table is joined
    as its size demands.
    """
    table = F.broadcast(price_table(calls.sparkSession)) if prices is None else prices
    price = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    cost = (
        F.col("input_tokens") / F.lit(1_000_000) * price("in_price")
        + F.col("output_tokens") / F.lit(1_000_000) * price("out_price")
    )
    return calls.join(table, "model", "left").withColumn("cost_usd", cost).drop("in_price", "out_price")


def embedding_calls(texts: DataFrame, tokens: Column, model: str = "text-embedding-3-small") -> DataFrame:
    """The call rows of embedding each text: input tokens only."""
    return texts.select(
        F.lit(model).alias("model"),
        tokens.cast("bigint").alias("input_tokens"),
        F.lit(0).cast("bigint").alias("output_tokens"),
    )


def cost_summary(costed: DataFrame, *by: str) -> DataFrame:
    """Calls, tokens and cost, in total or by columns such as run, model or tier."""
    return costed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"),
    )
