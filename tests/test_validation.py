import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from vocara.operators.validation import add_provenance, canonical_url, json_from_output, validate_records

GOOD = {
    "title": "Lighthouse Keeper", "company": "Coast Trust", "location": "Brest", "country": "FR", "remote": "onsite",
    "seniority": "mid", "stack": ["Rust", "Redis"], "visa_sponsorship": "no", "visa_signals": ["LMIA offered"],
    "salary": {"min": 31000, "max": 35500.5, "currency": "CHF", "period": "month"}, "description_summary": "A lamp.",
}


def outcomes(spark, outputs):
    rows = spark.createDataFrame([(i, o) for i, o in enumerate(outputs)], "i int, output string")
    return validate_records(json_from_output(rows)).orderBy("i").select("errors", "record").collect()


def test_good_record(spark):
    (row,) = outcomes(spark, [json.dumps(GOOD)])
    assert row.errors == []
    assert row.record.stack == ["Rust", "Redis"] and row.record.salary.max == 35500.5 and row.record.posted_at is None


SPAN_CASES = [
    ("```json\n{\"a\": 1}\n```", True),
    ("Sure: {\"a\": {\"b\": 2}} done", True),
    ("{\"a\": 1} {\"b\": 2}", False),
    ("{\"a\": 1}, {\"b\": 2}", False),
    ("{\"a\": 1}], [{\"b\": 2}", False),
    ("{\"a\": 1}}, {\"b\": {\"c\": 2}", False),
    ("no object here", False),
    ("{'a': 1}", False),
    ("{broken", False),
    ("} {", False),
]


def test_json_span(spark):
    rows = spark.createDataFrame([(i, o) for i, (o, _) in enumerate(SPAN_CASES)], "i int, output string")
    got = json_from_output(rows).orderBy("i").select(F.col("parsed").isNotNull()).collect()
    assert [r[0] for r in got] == [readable for _, readable in SPAN_CASES]


CHANGES = [
    ({"remote": None}, ["remote"]),
    ({"seniority": "Senior"}, ["seniority"]),
    ({"stack": None}, ["stack"]),
    ({"stack": ["Go", 1]}, ["stack"]),
    ({"stack": ["Go", None]}, ["stack"]),
    ({"stack": "Go"}, ["stack"]),
    ({"stack": []}, []),
    ({"visa_signals": None}, ["visa_signals"]),
    ({"salary": {"min": "90000", "max": True}}, []),
    ({"salary": {"min": "90k"}}, ["salary"]),
    ({"salary": {"currency": 5}}, ["salary"]),
    ({"salary": [1]}, ["salary"]),
    ({"salary": None}, []),
    ({"description_summary": "x" * 600}, []),
    ({"description_summary": "x" * 601}, ["description_summary"]),
    ({"description_summary": 5}, ["description_summary"]),
    ({"title": 5, "company": None}, ["title", "company"]),
    ({"location": None, "country": None}, []),
    ({"location": 7}, ["location"]),
    ({"rating": 5}, []),
    ({"posted_at": "next week"}, ["posted_at"]),
    ({"posted_at": "2024-13-01"}, ["posted_at"]),
    ({"posted_at": False}, ["posted_at"]),
]


def test_each_rule(spark):
    got = outcomes(spark, [json.dumps(GOOD | change) for change, _ in CHANGES])
    assert [row.errors for row in got] == [expected for _, expected in CHANGES]
    assert all((row.record is None) == bool(row.errors) for row in got)


def test_missing_fields_take_their_defaults(spark):
    (row,) = outcomes(spark, ['{"title": "T", "company": "C"}'])
    r = row.record
    assert (r.remote, r.seniority, r.visa_sponsorship, r.stack, r.visa_signals, r.salary) == ("unknown", "unknown", "unknown", [], [], None)
    assert outcomes(spark, ["nothing"])[0].errors == ["json"]


def test_points_in_time(spark):
    moments = {
        "2024-05-01": (2024, 5, 1, 0, 0), "2024-05-01T10:00:00": (2024, 5, 1, 10, 0),
        "2024-05-01T10:00:00+02:00": (2024, 5, 1, 8, 0), "2024-05-01 10:00Z": (2024, 5, 1, 10, 0),
        1714557600: (2024, 5, 1, 10, 0), 1714557600000: (2024, 5, 1, 10, 0), "1714557600": (2024, 5, 1, 10, 0),
    }
    rows = spark.createDataFrame([(i, json.dumps(GOOD | {"posted_at": m})) for i, m in enumerate(moments)], "i int, output string")
    got = validate_records(json_from_output(rows)).orderBy("i").select(F.unix_seconds("record.posted_at")).collect()
    assert [r[0] for r in got] == [int(datetime(*m, tzinfo=timezone.utc).timestamp()) for m in moments.values()]


URL_CASES = [
    ("HTTPS://Example.COM", "https://example.com/"),
    ("http://a.b/Path?q=1#f", "http://a.b/Path?q=1#f"),
    ("https://a.b?q=1", "https://a.b/?q=1"),
    ("https://a.b/é", "https://a.b/%C3%A9"),
    ("ftp://a.b/x", None),
    ("a.b/x", None),
]


def test_urls(spark):
    rows = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(URL_CASES)], "i int, u string").orderBy("i")
    assert [r[0] for r in rows.select(canonical_url(F.col("u"))).collect()] == [e for _, e in URL_CASES]


def test_provenance_hashes_the_extracted_location(spark):
    rows = spark.createDataFrame([(json.dumps(GOOD), "board", "https://x/1")], "output string, source string, url string")
    checked = validate_records(json_from_output(rows)).select("record", "source", "url", F.current_timestamp().alias("fetched_at"))
    job = add_provenance(checked).first()
    other = add_provenance(checked.withColumn("record", F.col("record").withField("location", F.lit("IE")))).first()
    assert job.source == "board" and len(job.content_hash) == 16 and job.content_hash != other.content_hash
