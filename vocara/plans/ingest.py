"""From work items and captured pages to indexed jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocara import schemas as S
from vocara.functions.rules import refine_visa
from vocara.functions.text import job_text_of, word_set
from vocara.functions.vectors import hashed_vector
from vocara.operators.dedup import THRESHOLD, Finder, WordSets, dedup_near
from vocara.operators.extraction import (
    Provider,
    cache_lookup,
    cache_store,
    extract_cascade,
    first_valid_attempt,
    token_estimate,
)
from vocara.operators.index import index_upsert
from vocara.operators.outcomes import ingest_outcomes, route_outcome
from vocara.operators.picking import first_texts
from vocara.operators.validation import add_provenance
from vocara.session import materialize, release, stored_once
from vocara.sources.readers import scan_pages

JOB_COLUMNS = S.JOB.fieldNames()
# An embedder turns (seq, text) into (seq, words) or (seq, vector); it may add ``error``, and what
# it gives no vector is an error of that item.
Embedder = Callable[[DataFrame], DataFrame]


class Ingested(NamedTuple):
    """``entries`` and ``fresh`` are what this run adds to ``index`` and ``cache``.

    ``entries`` are all kept jobs with their vectors. The index shows the last of each
    content hash, but later runs must be held against every kept row. ``embedded`` are the
    texts that were embedded, one per text, with the tokens they are billed for.
    """

    outcomes: DataFrame
    jobs: DataFrame
    calls: DataFrame
    embedded: DataFrame
    entries: DataFrame
    index: DataFrame
    fresh: DataFrame
    cache: DataFrame


def embed_words(texts: DataFrame) -> DataFrame:
    """The keyless embedder: which words occur, over an open vocabulary."""
    return texts.select("seq", word_set(F.col("text")).alias("words"))


def embed_hashed(texts: DataFrame) -> DataFrame:
    """The keyless dense embedder: words hashed to the places of a unit vector."""
    return texts.select("seq", hashed_vector(F.col("text")).alias("vector"))


def batch_embedder(embed: Callable[[list[str]], list[list[float]]], dim: int) -> Embedder:
    """An embedder from a function over lists of texts (one client per worker).

    A batch that raises is embedded again text by text; a text that still raises, and a vector
    of another width than ``dim``, is an error of that text alone.
    """

    def one(text: str) -> tuple[list[float] | None, str | None]:
        try:
            return embed([text])[0], None
        except Exception as error:
            return None, str(error)

    def pairs(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            found = embed(texts)
            if len(found) == len(texts):
                return [(vector, None) for vector in found]
        except Exception:
            pass
        return [one(text) for text in texts]

    def checked(vector: list[float] | None, error: str | None) -> tuple[list[float] | None, str | None]:
        if vector is not None and len(vector) != dim:
            return None, f"expected a vector of width {dim}, got {len(vector)}"
        return vector, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [checked(*pair) for pair in pairs(batch["text"].tolist())]
            yield pd.DataFrame(
                {"seq": batch["seq"].to_numpy(), "vector": [v for v, _ in found], "error": [e for _, e in found]}
            )

    return lambda texts: texts.select("seq", "text").mapInPandas(run, "seq bigint, vector array<double>, error string")


def extract_jobs(
    scanned: DataFrame,
    provider: Provider,
    cache: DataFrame | None = None,
    fast_retries: int = 1,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scanned pages to ``(fresh, failed, calls)``.

    ``fresh`` holds one refined job per text the cache does not know, with the source,
    url and time of the first page that carried the text; ``failed`` the error per text.
    """
    scanned = stored_once(scanned, "scanned")  # its pages are cleaned once, though it is read twice
    _, misses = cache_lookup(scanned, cache)
    first = materialize(first_texts(misses), "requests")
    calls = extract_cascade(first, provider, fast_retries)
    solved = materialize(first_valid_attempt(calls), "solved")
    good, failed = route_outcome(solved)
    origin = materialize(first.select("text_hash", "source", "url", F.current_timestamp().alias("fetched_at")), "origin")
    release(first)  # nothing below reads a text
    fresh = add_provenance(good.select("text_hash", "record").join(origin, "text_hash")).withColumn(
        "visa_sponsorship",
        refine_visa(F.col("visa_signals"), F.col("description_summary"), F.col("visa_sponsorship")),
    )
    # An address no record may carry fails the record, like any other field.
    valid = fresh.filter(F.col("url").isNotNull()).select("text_hash", *JOB_COLUMNS)
    unusable = fresh.filter(F.col("url").isNull()).select(
        "text_hash", F.lit("invalid url").alias("error")
    )
    return valid, failed.select("text_hash", "error").unionByName(unusable), calls


def ingest(items: DataFrame, pages: DataFrame, provider: Provider, **options) -> Ingested:
    """Fetch, clean, extract, refine, embed, de-duplicate and index all work items.

    ``items`` has ``seq, source, url``; ``pages`` has ``url, html``, one row per url. The
    options are those of :func:`ingest_scanned`.
    """
    return ingest_scanned(scan_pages(items.select("seq", "source", "url"), pages), provider, **options)


def ingest_scanned(
    scanned: DataFrame,
    provider: Provider,
    embedder: Embedder = embed_words,
    finder: Finder | None = None,
    cache: DataFrame | None = None,
    index: DataFrame | None = None,
    fast_retries: int = 1,
    postings: DataFrame | None = None,
) -> Ingested:
    """All stages after the page was fetched: ``seq, source, url, text, text_hash, error``.

    A failed item carries a message that starts with ``fetch failed``, ``extract failed`` or,
    for any later failure, ``index failed``, and skips the rest: every item has one outcome.
    A text is embedded once, however often it is posted: the rendering of its record and,
    where the answer holds no summary, the whole text. Stage outputs that several later stages read are written to the
    shared folder once.
    """
    finder = finder or WordSets(THRESHOLD)
    pages = materialize(scanned, "scanned")
    scanned = materialize(pages.drop("text"), "scanned-rows")  # the texts go as soon as they are rendered
    fetched, fetch_errors = route_outcome(scanned)
    found = route_outcome(pages)[0].drop("error")
    found.scratch = pages.scratch
    fresh, failed, calls = extract_jobs(found, provider, cache, fast_retries)
    fresh = materialize(fresh, "fresh")
    known = cache_store(cache, fresh)

    work = fetched.select("seq", F.col("source").alias("item_source"), F.col("url").alias("item_url"), "text_hash")
    extracted = materialize(work.join(known, "text_hash"), "extracted")
    extract_errors = work.join(failed, "text_hash").select(
        "seq",
        F.col("item_source").alias("source"),
        F.col("item_url").alias("url"),
        F.concat(F.lit("extract failed: "), F.col("error")).alias("error"),
    )

    texts = first_texts(found.select("seq", "text_hash", "text")).join(known, "text_hash")
    body = F.when(F.col("description_summary").isNull(), F.col("text"))
    rendered = materialize(texts.select("seq", "text_hash", job_text_of(body=body).alias("text")), "rendered")
    release(pages)
    answered = embedder(rendered.select("seq", "text"))
    (kind,) = {"words", "vector"} & set(answered.columns)
    why = F.col("error") if "error" in answered.columns else F.lit(None).cast("string")
    by_text = materialize(
        rendered.select("seq", "text_hash").join(answered.select("seq", kind, why.alias("why")), "seq", "left")
        .select("text_hash", kind, F.when(F.col(kind).isNull(), F.coalesce("why", F.lit("no vector"))).alias("why")),
        "embedded",
    )
    billed = materialize(rendered.select("text_hash", token_estimate(F.col("text")).alias("input_tokens")), "billed")
    release(rendered)
    embedded = extracted.select("seq", "text_hash", "item_source", "item_url").join(by_text, "text_hash")
    vectors = materialize(embedded.filter(F.col("why").isNull()).select("seq", kind), "vectors")
    index_errors = materialize(embedded.filter(F.col("why").isNotNull()).select(
        "seq",
        F.col("item_source").alias("source"),
        F.col("item_url").alias("url"),
        F.concat(F.lit("index failed: "), F.col("why")).alias("error"),
    ), "index-errors")
    release(by_text)
    verdict = materialize(dedup_near(vectors, finder, index, postings=postings), "verdict")
    judged = extracted.join(verdict, "seq")
    as_item = lambda df: df.select(
        "seq", F.col("item_source").alias("source"), F.col("item_url").alias("url")
    )
    kept = judged.filter(~F.col("is_duplicate"))
    outcomes = ingest_outcomes(
        as_item(kept), as_item(judged.filter("is_duplicate")), fetch_errors, extract_errors, index_errors
    )
    jobs = kept.select("seq", *JOB_COLUMNS)
    entries = jobs.join(vectors, "seq")
    return Ingested(outcomes, jobs, calls, billed, entries, index_upsert(index, entries), fresh, known)
