import json

import pytest
from pyspark.sql import functions as F

from tests.test_index_rank import CV
from vocara import schemas as S
from vocara.sources import readers, sinks


def test_sources_file(spark, tmp_path):
    path = tmp_path / "sources.json"
    path.write_text(json.dumps([{"id": "a", "seed_urls": ["u1", "u2"], "anti_bot": True, "note": 1}, {"id": "b"}]))
    loaded = readers.load_sources(spark, str(path))
    assert [tuple(r) for r in loaded.collect()] == [("a", ["u1", "u2"], True), ("b", [], False)]
    numbered = loaded.withColumn("pos", F.when(F.col("id") == "a", 0).otherwise(1).cast("bigint"))
    items = readers.seed_urls(numbered, "pos").orderBy("seq").collect()
    assert [(r.source, r.url) for r in items] == [("a", "u1"), ("a", "u2")]
    path.write_text(json.dumps([{"seed_urls": []}]))
    with pytest.raises(Exception, match="a source has no id"):
        readers.load_sources(spark, str(path)).collect()


def test_jobs_round_trip_and_bad_lines(spark, sample_jobs, tmp_path):
    jobs = sample_jobs.withColumns(
        {
            "visa_signals": F.array(F.lit("Blue Card, \"EU\"")), "posted_at": F.lit(None).cast("timestamp"),
            "salary": F.struct(F.lit(1.5).alias("min"), F.lit(None).cast("double").alias("max"), F.lit("EUR").alias("currency"), F.lit(None).cast("string").alias("period")),
            "external_id": F.lit(None).cast("string"), "fetched_at": F.timestamp_seconds(F.lit(1_700_000_000)),
        }
    ).select(*S.JOB.fieldNames())
    sinks.save_jobs(jobs, str(tmp_path / "jobs"))
    back = readers.load_jobs(spark, str(tmp_path / "jobs"))
    assert sorted(map(str, back.collect())) == sorted(map(str, jobs.collect()))
    (tmp_path / "bad.jsonl").write_text('{"title": "T"}\n\n{"title": \n')
    with pytest.raises(Exception):
        readers.load_jobs(spark, str(tmp_path / "bad.jsonl")).collect()
    rows = readers.load_jobs(spark, str(tmp_path / "bad.jsonl"), strict=False).select("title", "_corrupt_record").collect()
    assert [(r.title, r._corrupt_record is None) for r in rows] == [("T", True), (None, False)]


def test_gold_cases(spark, tmp_path):
    gold = dict(title="T", company="C", seniority="mid", visa_sponsorship="no", remote="onsite")
    (tmp_path / "02_b.json").write_text(json.dumps({"html": "<p>x</p>", "gold": gold}))
    (tmp_path / "01_a.json").write_text(json.dumps({"html": "<p>y</p>", "gold": gold}, indent=1))
    rows = readers.load_gold(spark, str(tmp_path)).orderBy("case_id").collect()
    assert [(r.case_id, r.html, r.seniority) for r in rows] == [("01_a", "<p>y</p>", "mid"), ("02_b", "<p>x</p>", "mid")]
    del gold["remote"]
    (tmp_path / "03_c.json").write_text(json.dumps({"html": "", "gold": gold}))
    with pytest.raises(Exception, match="lacks the field remote"):
        readers.load_gold(spark, str(tmp_path)).collect()


def test_profiles_are_whole_files(spark, tmp_path):
    (tmp_path / "a.md").write_text(CV + "\n\nSecond paragraph")
    (tmp_path / "b.md").write_text("Other")
    rows = {r.cv_name: r.cv_text for r in readers.load_cv(spark, str(tmp_path)).collect()}
    assert rows == {"a.md": CV + "\n\nSecond paragraph", "b.md": "Other"}


def test_export_bytes(spark, tmp_path):
    rows = spark.createDataFrame(
        [
            (1, 1, 'Acme "Cloud", Ltd', "Go\tEngineer", None, "remote", "senior", "yes", 0.9125, "https://x/1", "s", "2024-05-01 10:00:00"),
            (1, 2, "  Beta ", "T", "DE", "onsite", "mid", "no", 0.5, "https://x/2", "s", None),
            (1, 3, "C", "T", "DE", "onsite", "mid", "no", 0.5, "https://x/3", "s", "2024-05-01 10:00:00.123456"),
        ],
        "cv_id bigint, position bigint, company string, title string, country string, remote string, seniority string, "
        "visa_sponsorship string, match_score double, url string, source string, posted string",
    ).withColumn("posted_at", F.col("posted").cast("timestamp"))
    assert sinks.export_csv(rows, str(tmp_path / "out")) == 3
    content = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*.csv")))
    header = ",".join(sinks.EXPORT_COLUMNS).encode() + b"\r\n"
    assert content.replace(header, b"") == (
        b'"Acme ""Cloud"", Ltd",Go\tEngineer,,remote,senior,yes,0.912,https://x/1,s,2024-05-01T10:00:00+00:00,to_apply\r\n'
        b"  Beta ,T,DE,onsite,mid,no,0.500,https://x/2,s,,to_apply\r\n"
        b"C,T,DE,onsite,mid,no,0.500,https://x/3,s,2024-05-01T10:00:00.123456+00:00,to_apply\r\n"
    )
    assert content.startswith(header)


def test_pages_join_late_and_missing_pages_are_errors(spark):
    items = spark.createDataFrame([(1, "a", "u1"), (2, "b", "lost"), (3, "b", "u1")], "seq bigint, source string, url string")
    pages = spark.createDataFrame([("u1", "<p>hi</p>")], "url string, html string")
    rows = readers.scan_pages(items, pages).orderBy("seq").collect()
    assert [(r.text, r.error) for r in rows] == [("hi", None), (None, "fetch failed: no page for lost"), ("hi", None)]


@pytest.mark.parametrize("wrong", ["{}", '{"title":"T","company":"C","source":"s","content_hash":"h","url":"https://x/1","remote":"moon"}', '{"title":"T","company":"C","source":"s","content_hash":"h","url":"x"}'])
def test_load_jobs_refuses_invalid_records(spark, tmp_path, wrong):
    (tmp_path / "wrong.jsonl").write_text(wrong)
    with pytest.raises(Exception, match="no valid"):
        readers.load_jobs(spark, str(tmp_path / "wrong.jsonl")).collect()


def test_scan_hands_on_whole_texts(spark):
    items = spark.createDataFrame([(1, "a", "u1")], "seq bigint, source string, url string")
    pages = spark.createDataFrame([("u1", "<p>" + "word " * 4000 + "visa sponsorship</p>")], "url string, html string")
    assert readers.scan_pages(items, pages).first().text.endswith("visa sponsorship")


def test_lenient_jobs_say_what_is_wrong(spark, tmp_path):
    good = {"title": "T", "company": "C", "source": "s", "content_hash": "h", "url": "https://x/1", "remote": "onsite"}
    lines = [
        json.dumps(good),
        "{}",
        json.dumps(good | {"remote": "moon", "url": "x"}),
        json.dumps(good | {"seniority": "boss", "company": None}),
        '{"title": ',
    ]
    (tmp_path / "mixed.jsonl").write_text("\n".join(lines) + "\n")
    valid, quarantine = readers.load_jobs_checked(spark, str(tmp_path / "mixed.jsonl"))
    assert [r.title for r in valid.collect()] == ["T"] and valid.columns == S.JOB.fieldNames()
    got = sorted(("; ".join(r.reasons), r.line == '{"title": ') for r in quarantine.collect())
    assert got == sorted([
        ("title: missing; company: missing; source: missing; content_hash: missing; url: not a web address", False),
        ("remote: outside its values; url: not a web address", False),
        ("company: missing; seniority: outside its values", False),
        ("line: not a job object", True),
    ])
