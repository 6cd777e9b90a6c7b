"""Accuracy of an extraction over a labelled set, end to end."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocara.functions.keys import text_hash
from vocara.functions.rules import refine_visa
from vocara.operators.evaluation import compare_fields, eval_mistakes, field_accuracy, overall_accuracy
from vocara.operators.extraction import Provider, extract_cascade, first_valid_attempt
from vocara.operators.picking import first_texts
from vocara.sources.readers import clean_pages
from vocara.session import materialize


class Evaluation(NamedTuple):
    compared: DataFrame
    accuracy: DataFrame
    overall: DataFrame
    mistakes: DataFrame
    calls: DataFrame


def evaluate(gold: DataFrame, provider: Provider, fast_retries: int = 1) -> Evaluation:
    """Cleans, extracts without a cache, and compares. ``gold`` has ``case_id``, ``html``
    and the critical fields. Cases of equal text share one extraction."""
    texts = clean_pages(gold.select("case_id", "html")).withColumn("text_hash", text_hash(F.col("text")))
    texts = materialize(texts, "gold-texts")
    calls = extract_cascade(first_texts(texts.withColumnRenamed("case_id", "seq")), provider, fast_retries)
    solved = first_valid_attempt(calls).filter(F.col("error").isNull()).select("text_hash", "record.*")
    predictions = texts.select("case_id", "text_hash").join(solved, "text_hash").withColumn(
        "visa_sponsorship",
        refine_visa(F.col("visa_signals"), F.col("description_summary"), F.col("visa_sponsorship")),
    )
    compared = materialize(compare_fields(gold, predictions), "compared")
    accuracy = field_accuracy(compared)
    return Evaluation(compared, accuracy, overall_accuracy(accuracy), eval_mistakes(compared), calls)
