"""The job index as a table: one row per content hash with vector and job columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocara.functions.vectors import checked_vector
from vocara.operators.picking import keep_last


def allowed(values: Mapping[str, Sequence[str] | str | None]) -> Column:
    """One predicate from column -> values it may have; a column without values is free."""
    lists = {name: [v] if isinstance(v, str) else list(v) for name, v in values.items() if v}
    return reduce(and_, (F.col(name).isin(choices) for name, choices in lists.items()), F.lit(True))


def country_filter(jobs: DataFrame, countries: Sequence[str] | None) -> DataFrame:
    """Jobs in the listed countries; no list, or an empty one, means no filter."""
    return jobs.filter(allowed({"country": countries}))


def visa_filter(jobs: DataFrame, required: bool = True) -> DataFrame:
    return jobs.filter(allowed({"visa_sponsorship": "yes" if required else None}))


def list_jobs(
    index: DataFrame,
    countries: Sequence[str] | None = None,
    seniority: str | None = None,
    visa: str | None = None,
    remote: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The index in order of content hash where all filters hold; ``limit`` takes the first rows."""
    wanted = {"country": countries, "seniority": seniority, "visa_sponsorship": visa, "remote": remote}
    page = index.filter(allowed(wanted)).orderBy("content_hash")
    return page if limit is None else page.limit(limit)


def get_job(index: DataFrame, content_hash: str) -> DataFrame:
    return index.filter(F.col("content_hash") == content_hash)


def job_count(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("jobs"))


def attach_vectors(jobs: DataFrame, vectors: DataFrame, key: str, dim: int | None = None) -> DataFrame:
    """Jobs with their vectors. A job without one is an error, as is a wrong width."""
    vector = F.col("vector")
    missing = F.raise_error(F.concat(F.lit("no vector for job "), F.col(key).cast("string")))
    checked = F.coalesce(vector if dim is None else F.when(vector.isNotNull(), checked_vector(vector, dim)), missing)
    return jobs.join(vectors.select(key, "vector"), key, "left").withColumn("vector", checked)


def latest_per_hash(rows: DataFrame, order: str | Column = "seq") -> DataFrame:
    """The last row of each content hash."""
    return keep_last(rows, "content_hash", order)


def index_upsert(index: DataFrame | None, rows: DataFrame, order: str = "seq") -> DataFrame:
    """The index after ``rows`` were inserted or overwrote their content hash.

    One row per hash, also where the given index holds several: the latest by ``order``.
    """
    fresh = latest_per_hash(rows, order)
    if index is None:
        return fresh
    kept = index.join(fresh.select("content_hash"), "content_hash", "left_anti")
    return latest_per_hash(kept, order).unionByName(fresh)
