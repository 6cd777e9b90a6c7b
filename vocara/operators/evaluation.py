"""Field-level accuracy against a labelled set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocara.schemas import CRITICAL_FIELDS

WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def stripped(value: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def comparable(value: Column) -> Column:
    """Trimmed and lower-cased text; a missing value compares as ``none``."""
    return F.lower(stripped(F.coalesce(value.cast("string"), F.lit("None"))))


def compare_fields(gold: DataFrame, predictions: DataFrame, key: str = "case_id") -> DataFrame:
    """One row per case and critical field: ``gold``, ``pred``, ``correct``, ``extracted``.

    A case without a prediction counts as wrong in every field and is flagged by
    ``extracted``. A gold case that lacks a field is an error.
    """
    present = predictions.select(
        key, *[F.col(f).alias(f"pred_{f}") for f in CRITICAL_FIELDS], F.lit(True).alias("extracted")
    )
    gold_value = lambda f: F.coalesce(
        comparable_or_null(F.col(f)),
        F.raise_error(F.concat(F.lit(f"gold field {f} is missing in case "), F.col(key).cast("string"))),
    )
    fields = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                gold_value(f).alias("gold"),
                F.when(F.col("extracted"), comparable(F.col(f"pred_{f}"))).alias("pred"),
            )
            for f in CRITICAL_FIELDS
        ]
    )
    joined = gold.select(key, *CRITICAL_FIELDS).join(present, key, "left")
    long = joined.select(key, F.coalesce("extracted", F.lit(False)).alias("extracted"), F.inline(fields))
    return long.withColumn("correct", F.coalesce(F.col("gold") == F.col("pred"), F.lit(False)))


def comparable_or_null(value: Column) -> Column:
    return F.lower(stripped(value.cast("string")))


def field_accuracy(compared: DataFrame) -> DataFrame:
    """Accuracy of each critical field; 0 for an empty labelled set."""
    spark = compared.sparkSession
    names = spark.createDataFrame([(f,) for f in CRITICAL_FIELDS], "field string")
    measured = compared.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("correct").cast("bigint")).alias("n_correct"),
    )
    n = F.coalesce("n", F.lit(0))
    hits = F.coalesce("n_correct", F.lit(0))
    return names.join(measured, "field", "left").select(
        "field",
        n.alias("n"),
        hits.alias("n_correct"),
        F.when(n > 0, hits / n).otherwise(F.lit(0.0)).alias("accuracy"),
    )


def overall_accuracy(accuracy: DataFrame) -> DataFrame:
    """The unweighted mean over the fields."""
    return accuracy.agg(F.avg("accuracy").alias("overall"))


def eval_mistakes(compared: DataFrame, key: str = "case_id") -> DataFrame:
    return compared.filter(~F.col("correct")).select(key, "field", "gold", "pred")
