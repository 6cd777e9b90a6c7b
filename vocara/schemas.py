"""Declared schemas. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

SOURCE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("seed_urls", T.ArrayType(T.StringType())),
        T.StructField("anti_bot", T.BooleanType()),
    ]
)

SALARY = T.StructType(
    [
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("period", T.StringType()),
    ]
)

EXTRACTED = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("remote", T.StringType()),
        T.StructField("seniority", T.StringType()),
        T.StructField("stack", T.ArrayType(T.StringType())),
        T.StructField("salary", SALARY),
        T.StructField("visa_sponsorship", T.StringType()),
        T.StructField("visa_signals", T.ArrayType(T.StringType())),
        T.StructField("description_summary", T.StringType()),
        T.StructField("posted_at", T.TimestampType()),
    ]
)

JOB = T.StructType(
    EXTRACTED.fields
    + [
        T.StructField("source", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("external_id", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("content_hash", T.StringType()),
    ]
)

GOLD_CASE = T.StructType(
    [
        T.StructField("html", T.StringType()),
        T.StructField(
            "gold",
            T.StructType(
                [
                    T.StructField(name, T.StringType())
                    for name in ("title", "company", "seniority", "visa_sponsorship", "remote")
                ]
            ),
        ),
    ]
)

PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

# The enumerations of a record, and the longest summary it may carry.
REMOTE_VALUES = ("remote", "hybrid", "onsite", "unknown")
SENIORITY_VALUES = ("junior", "mid", "senior", "staff", "lead", "unknown")
VISA_VALUES = ("yes", "no", "unknown")
MAX_SUMMARY_CHARS = 600
MAX_TEXT_CHARS = 12_000
CRITICAL_FIELDS = ("title", "company", "seniority", "visa_sponsorship", "remote")
