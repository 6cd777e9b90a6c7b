"""Readers. Every schema is declared; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocara import schemas as S
from vocara.functions.keys import text_hash
from vocara.functions.text import html_to_text
from vocara.session import materialize


def _required(value: Column, message: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(message)))


def load_sources(spark: SparkSession, path: str, json_array: bool = True) -> DataFrame:
    """Sources with their defaults: ``id, seed_urls, anti_bot``.

    ``json_array`` reads one small JSON array; large source lists come as JSON lines,
    which Spark can split.
    """
    raw = (
        spark.read.schema(S.SOURCE).option("multiLine", json_array).option("mode", "FAILFAST").json(path)
    )
    return raw.select(
        _required(F.col("id"), "a source has no id").alias("id"),
        F.coalesce("seed_urls", F.array().cast("array<string>")).alias("seed_urls"),
        F.coalesce("anti_bot", F.lit(False)).alias("anti_bot"),
    )


def seed_urls(sources: DataFrame, position: str) -> DataFrame:
    """One work item per source and url, in the order of the sources.

    ``position`` names a BIGINT column below 2^32 that orders the sources (a larger one fails).
    An array has fewer than 2^31 elements, so ``seq`` orders the items and is unique.
    """
    items = sources.select(
        F.col(position).alias("source_pos"), F.col("id").alias("source"), "anti_bot",
        F.posexplode("seed_urls").alias("url_pos", "url"),
    )
    fits = F.col("source_pos").between(0, (1 << 32) - 1)
    wrong = F.raise_error(F.concat(F.lit("no position for a source: "), F.col("source_pos").cast("string")))
    seq = F.when(fits, F.col("source_pos")).otherwise(wrong) * (1 << 31) + F.col("url_pos")
    return items.select(seq.alias("seq"), "source", "url", "anti_bot")


def clean_pages(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Pages with ``text`` instead of ``html``, cleaned where they are read."""
    kept = [c for c in pages.columns if c != "html"]
    return pages.select(*kept, html_to_text(F.col("html"), max_chars).alias("text"))


def scan_pages(items: DataFrame, pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Work items with the cleaned text of their captured page; no page is a fetch error.

    Pages are cleaned before the join, so markup never crosses the network.
    """
    texts = clean_pages(pages.select("url", "html"), max_chars)
    return items.join(texts, "url", "left").select(
        *items.columns,
        "text",
        text_hash(F.col("text")).alias("text_hash"),
        F.when(F.col("text").isNull(), F.concat(F.lit("fetch failed: no page for "), F.col("url"))).alias("error"),
    )


def _job_checks() -> dict[str, tuple[Column, str]]:
    """Per field, in order: the predicate a valid job meets, and what is wrong otherwise."""
    enums = {"remote": S.REMOTE_VALUES, "seniority": S.SENIORITY_VALUES, "visa_sponsorship": S.VISA_VALUES}
    checks = {name: (F.col(name).isNotNull(), "missing") for name in ("title", "company", "source", "content_hash")}
    checks |= {name: (F.col(name).isNull() | F.col(name).isin(*values), "outside its values") for name, values in enums.items()}
    checks["url"] = (F.coalesce(F.col("url").rlike("(?i)^https?://[^/?#]+"), F.lit(False)), "not a web address")
    return checks


def checked_jobs(jobs: DataFrame) -> DataFrame:
    """The rows, with an error on the first that lacks a required field, has a value outside an
    enumeration or a url that is none."""
    bad = lambda name: F.raise_error(F.lit(f"a job has no valid {name}")).cast(S.JOB[name].dataType)
    return jobs.withColumns({name: F.when(fine, F.col(name)).otherwise(bad(name)) for name, (fine, _) in _job_checks().items()})


def load_jobs_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Jobs from JSON lines, leniently: ``(valid, quarantine)``. Valid rows have the job schema;
    the quarantine holds every other line as ``line`` (the raw text of an unreadable one, else
    the record as JSON) with ``reasons``, one ``field: what`` per broken rule in field order, or
    ``line: not a job object``. Both come from one read; nothing is dropped."""
    schema = T.StructType(S.JOB.fields + [T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    found = F.filter(F.array(*[F.when(~fine, F.lit(f"{name}: {why}")) for name, (fine, why) in _job_checks().items()]), lambda x: x.isNotNull())
    unreadable = F.col("_corrupt_record").isNotNull()
    marked = materialize(raw.withColumn("reasons", F.when(unreadable, F.array(F.lit("line: not a job object"))).otherwise(found)), "jobs-read")
    valid = marked.where(F.size("reasons") == 0).select(*S.JOB.fieldNames())
    line = F.coalesce("_corrupt_record", F.to_json(F.struct(*S.JOB.fieldNames())))
    return valid, marked.where(F.size("reasons") > 0).select(line.alias("line"), "reasons")


def load_jobs(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Jobs from JSON lines. Strict: the first bad line fails the job. Otherwise bad lines
    are kept apart in ``_corrupt_record``."""
    if strict:
        return checked_jobs(spark.read.schema(S.JOB).option("mode", "FAILFAST").json(path))
    schema = T.StructType(S.JOB.fields + [T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def load_gold(spark: SparkSession, path: str, file_per_case: bool = True) -> DataFrame:
    """Labelled cases: ``case_id, html`` and the critical fields.

    One JSON file each, the case id being the file name without suffix; or, for large
    sets, JSON lines that carry a ``case_id`` of their own.
    """
    if file_per_case:
        raw = spark.read.schema(S.GOLD_CASE).option("multiLine", True).option("mode", "FAILFAST").json(path)
        case_id = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    else:
        schema = T.StructType([T.StructField("case_id", T.StringType()), *S.GOLD_CASE.fields])
        raw = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        case_id = _required(F.col("case_id"), "a gold case has no id")
    fields = [
        _required(F.col(f"gold.{f}"), f"a gold case lacks the field {f}").alias(f) for f in S.CRITICAL_FIELDS
    ]
    return raw.select(case_id.alias("case_id"), "html", *fields)


def load_cv(spark: SparkSession, path: str) -> DataFrame:
    """Profiles, one whole text file each: ``cv_name, cv_text``."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("cv_name"), F.col("value").alias("cv_text"))
