import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_validation import GOOD
from vocara.functions.keys import text_hash
from vocara.operators import cost, extraction
from vocara.operators.extraction import batch_provider, build_requests, cache_lookup, cache_store, extract_cascade, first_valid_attempt
from vocara.plans.ingest import extract_jobs

BAD = "nothing to report"


def scripted(outputs):
    """A Python provider that answers attempt by attempt from a script per text."""

    def complete(batch: pd.DataFrame) -> pd.DataFrame:
        answers = [outputs[t][a - 1] for t, a in zip(batch["text"], batch["attempt"])]
        return batch.assign(model="fake-" + batch["tier"], output=answers, input_tokens=1000, output_tokens=200)

    return batch_provider(complete)


def texts(spark, names):
    rows = spark.createDataFrame([(i, n, "s", f"https://x/{i}") for i, n in enumerate(names)], "seq bigint, text string, source string, url string")
    return rows.withColumn("text_hash", text_hash(F.col("text")))


SCRIPT = {
    "first": [json.dumps(GOOD)],
    "second": [BAD, json.dumps(GOOD)],
    "third": [BAD, BAD, json.dumps(GOOD)],
    "never": [BAD, BAD, BAD],
}


def test_cascade_retries_then_escalates_then_fails(spark):
    asked = texts(spark, SCRIPT)
    calls = extract_cascade(asked.select("text_hash", "text"), scripted(SCRIPT))
    tiers = {
        r.text: r.tiers
        for r in calls.join(asked, "text_hash").groupBy("text").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("attempt", "tier"))), lambda x: x["tier"]).alias("tiers")
        ).collect()
    }
    assert tiers == {
        "first": ["fast"], "second": ["fast", "fast"],
        "third": ["fast", "fast", "strong"], "never": ["fast", "fast", "strong"],
    }
    solved = {r.text: r for r in first_valid_attempt(calls).join(asked, "text_hash").collect()}
    assert [solved[t].attempt for t in SCRIPT] == [1, 2, 3, None]
    assert solved["never"].error == "extraction failed: json" and solved["first"].error is None
    # Failed attempts are billed.
    total = cost.cost_summary(cost.call_cost(calls)).first()
    assert (total.calls, total.input_tokens, total.output_tokens, total.cost_usd) == (9, 9000, 1800, 0.0)


def test_equal_texts_are_asked_once_and_keep_the_first_origin(spark):
    scanned = texts(spark, ["first", "first", "first"])
    fresh, failed, calls = extract_jobs(scanned, scripted(SCRIPT))
    assert calls.count() == 1 and failed.count() == 0
    job = fresh.first()
    assert job.url == "https://x/0" and job.visa_sponsorship == "yes" and job.title == GOOD["title"]


def test_cache_answers_without_a_call(spark):
    scanned = texts(spark, ["first", "second"])
    fresh, _, calls = extract_jobs(scanned, scripted(SCRIPT))
    cache = cache_store(None, fresh)
    again, _, more = extract_jobs(scanned, scripted(SCRIPT), cache)
    assert calls.count() == 3 and more.count() == 0 and again.count() == 0
    hits, misses = cache_lookup(scanned, cache)
    assert hits.count() == 2 and misses.count() == 0
    assert cache_lookup(scanned, None)[1].count() == 2
    assert cache_store(cache, fresh).count() == 2


def test_requests_are_distinct_and_skip_the_cache(spark):
    scanned = texts(spark, ["first", "first", "second"])
    requests = build_requests(scanned, scanned.filter("text = 'second'").select("text_hash"))
    (row,) = requests.collect()
    assert row.prompt.endswith("Posting:\nfirst") and row.max_tokens == 1500
    schema = json.loads(row.prompt.split("Record shape:\n")[1].split("\n\nPosting")[0])
    assert schema["properties"]["seniority"]["enum"][-1] == "unknown" and schema["required"] == ["title", "company"]


def test_rule_provider_passes_validation(spark):
    scanned = texts(spark, ["Lead Cartographer\nTerra Maps\nCork, Ireland\nwork permit provided"])
    fresh, failed, _ = extract_jobs(scanned, extraction.rule_provider())
    job = fresh.first()
    assert failed.count() == 0 and (job.country, job.seniority, job.visa_sponsorship) == ("IE", "lead", "yes")


@pytest.mark.parametrize(("retries", "tiers"), [(0, ["fast", "strong"]), (2, ["fast", "fast", "fast", "strong"])])
def test_tiers(retries, tiers):
    assert extraction.attempt_tiers(retries) == tiers


def test_prices(spark):
    calls = spark.createDataFrame([("gpt-5", 1_000_000, 100_000), ("mystery", 5, 5)], "model string, input_tokens bigint, output_tokens bigint")
    got = {r.model: r.cost_usd for r in cost.call_cost(calls).collect()}
    assert got == {"gpt-5": 2.25, "mystery": 0.0}
    assert cost.cost_summary(cost.call_cost(calls.limit(0))).first().cost_usd == 0.0
    texts_df = spark.createDataFrame([("x" * 4_000_000,), ("y",)], "text string")
    embedded = cost.embedding_calls(texts_df, extraction.token_estimate(F.col("text")))
    assert tuple(cost.cost_summary(cost.call_cost(embedded)).first()) == (2, 1_000_001, 0, 0.02)


def test_silent_and_raising_calls_lose_no_text(spark):
    def complete(batch: pd.DataFrame) -> pd.DataFrame:
        if batch["text"].str.contains("boom").any():
            raise RuntimeError("quota spent")
        # "late" is only answered by the strong tier, "mute" never.
        heard = batch[(batch["text"] != "mute") & ((batch["text"] != "late") | (batch["tier"] == "strong"))]
        return heard.assign(model="m", output=json.dumps(GOOD), input_tokens=1, output_tokens=1)

    asked = texts(spark, ["fine", "boom", "late", "mute"]).coalesce(1)
    calls = extract_cascade(asked.select("text_hash", "text"), batch_provider(complete))
    solved = {r.text: (r.attempt, r.attempts, r.error) for r in first_valid_attempt(calls).join(asked, "text_hash").collect()}
    assert solved == {
        "fine": (1, 1, None), "boom": (None, 1, "quota spent"), "late": (3, 3, None),
        "mute": (None, 3, "extraction failed: unanswered"),
    }


def test_cache_store_rewrites_only_the_prefixes_it_touches(spark, tmp_path):
    import os

    from vocara.operators.extraction import cache_store_at

    path = str(tmp_path / "cache")
    first = spark.createDataFrame([("aa01", 1, "x"), ("aa02", 2, "x"), ("bb01", 3, "x")], "text_hash string, doc_id long, note string")
    cache_store_at(path, first)
    untouched = sorted(os.listdir(f"{path}/prefix=bb"))
    stamps = {n: os.stat(f"{path}/prefix=bb/{n}").st_mtime_ns for n in untouched}
    fresh = spark.createDataFrame([("aa02", 20), ("aa03", 30)], "text_hash string, doc_id long")
    got = {(r.text_hash, r.doc_id, r.note) for r in cache_store_at(path, fresh).collect()}
    assert got == {("aa01", 1, "x"), ("aa02", 20, None), ("aa03", 30, None), ("bb01", 3, "x")}
    assert sorted(os.listdir(f"{path}/prefix=bb")) == untouched
    assert all(os.stat(f"{path}/prefix=bb/{n}").st_mtime_ns == t for n, t in stamps.items())
