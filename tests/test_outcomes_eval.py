import pytest
from pyspark.sql import functions as F

from vocara.operators import outcomes
from vocara.operators.evaluation import compare_fields, eval_mistakes, field_accuracy, overall_accuracy
from vocara.operators.extraction import rule_provider
from vocara.plans.evaluate import evaluate
from vocara.schemas import CRITICAL_FIELDS

GOLD = "case_id string, html string, title string, company string, seniority string, visa_sponsorship string, remote string"
CASES = [
    ("1", "<h1>Lead Cartographer</h1><p>Terra Maps - Lyon, France (hybrid)</p><p>We can sponsor a visa.</p>",
     "Lead Cartographer", "Terra Maps", "lead", "yes", "hybrid"),
    ("2", "<h1>Beekeeper</h1><p>Honig AG - Kiel, Germany</p><p>Junior-level and on-site, without sponsorship.</p>",
     " beekeeper", "Honig AG", "junior", "no", "onsite"),
    ("3", "<h1>Diver</h1><p>Reef Watch - Anywhere</p><p>remote</p>", "Diver", "Reef Watch", "staff", "unknown", "remote"),
]


def test_evaluation_end_to_end(spark):
    done = evaluate(spark.createDataFrame(CASES, GOLD), rule_provider())
    accuracy = {r.field: (r.n, round(r.accuracy, 6)) for r in done.accuracy.collect()}
    assert accuracy == {f: (3, 1.0) for f in CRITICAL_FIELDS} | {"seniority": (3, 0.666667)}
    assert round(done.overall.first().overall, 6) == round((4 + 2 / 3) / 5, 6)
    assert [tuple(r) for r in done.mistakes.collect()] == [("3", "seniority", "staff", "unknown")]
    assert done.calls.count() == 3


def test_a_case_without_a_record_counts_as_five_mistakes(spark):
    gold = spark.createDataFrame(CASES, GOLD)
    predictions = gold.filter("case_id = '1'").withColumn("remote", F.lit(None).cast("string"))
    compared = compare_fields(gold, predictions)
    assert compared.filter("NOT extracted").count() == 10
    assert eval_mistakes(compared).filter("case_id = '1'").collect()[0][1:] == ("remote", "hybrid", "none")
    empty = field_accuracy(compare_fields(gold.limit(0), predictions.limit(0)))
    assert {r.accuracy for r in empty.collect()} == {0.0} and overall_accuracy(empty).first().overall == 0.0


def test_missing_gold_field_is_an_error(spark):
    gold = spark.createDataFrame(CASES, GOLD).withColumn("company", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="gold field company is missing"):
        compare_fields(gold, gold).collect()


def test_fetch_attempts(spark):
    rows = [("a", 1, "x", None), ("a", 2, "y", None), ("b", 1, None, "e1"), ("b", 2, "z", None),
            ("c", 1, None, "e1"), ("c", 2, None, "e2"), ("c", 3, "late", None)]
    attempts = spark.createDataFrame(rows, "url string, attempt int, html string, error string")
    got = {r.url: (r.html, r.error) for r in outcomes.fetch_outcome(attempts).collect()}
    assert got == {"a": ("x", None), "b": ("z", None), "c": (None, "fetch failed: e2")}
    assert outcomes.fetch_outcome(attempts, 3).filter("url = 'c'").first().html == "late"
    good, bad = outcomes.route_outcome(outcomes.fetch_outcome(attempts))
    assert good.count() == 2 and bad.count() == 1


def test_run_log(spark):
    log = spark.createDataFrame(
        [("r1", 1, 1, "running", None, None), ("r1", 2, 2, "done", "ok", None), ("r2", 1, 3, "running", None, None),
         ("r2", 1, 4, "error", None, "boom")],
        "run_id string, ts bigint, entry_id bigint, state string, result string, error string",
    )
    got = {r.run_id: (r.state, r.result, r.error) for r in outcomes.run_status(log).collect()}
    assert got == {"r1": ("done", "ok", None), "r2": ("error", None, "boom")}
    assert outcomes.get_run(log, "r2").first().state == "error" and outcomes.get_run(log, "r9").count() == 0


def test_comparison_ignores_all_white_space_at_the_ends(spark):
    from vocara.operators.evaluation import comparable

    row = spark.createDataFrame([("\u00a0A b\n",)], "x string").select(comparable(F.col("x")).alias("x")).first()
    assert row.x == "a b"
