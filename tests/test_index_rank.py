import hashlib
import math

import pytest
from pyspark.sql import functions as F

from vocara.functions.text import job_text_of
from vocara.functions.vectors import checked_vector, cosine, hashed_vector, presence_vector
from vocara.functions import scoring
from vocara.operators import index, ranking, search
from vocara.operators.picking import keep_last
from vocara.plans.rank import dashboard_matches

WORDS = ("scala", "spark", "redis", "terraform", "scheduler", "archive", "lead", "remote")
CV = "I plan ferries: lead scheduler, ten years of Scala and Spark, lately a little Redis."


@pytest.fixture(scope="module")
def indexed(sample_jobs):
    return sample_jobs.withColumn("vector", presence_vector(job_text_of(), WORDS)).drop("seq").cache()


@pytest.fixture(scope="module")
def cv(spark):
    return spark.createDataFrame([(7, CV)], "cv_id bigint, t string").select("cv_id", presence_vector(F.col("t"), WORDS).alias("cv_vector"))


def companies(df):
    return [r.company for r in df.orderBy("position").collect()]


def test_embedded_words(spark):
    row = spark.createDataFrame([("Redis on SPARK", "")], "a string, b string").select(
        presence_vector(F.col("a"), WORDS).alias("a"), presence_vector(F.col("b"), WORDS).alias("b"),
        hashed_vector(F.col("a"), 16).alias("h"), hashed_vector(F.col("b"), 16).alias("z"),
    ).first()
    assert row.a == pytest.approx([math.sqrt(0.5) if w in ("spark", "redis") else 0.0 for w in WORDS]) and row.b == [0.0] * 8
    places = {int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16 for w in ("redis", "on", "spark")}
    assert row.h == pytest.approx([1 / math.sqrt(len(places)) if p in places else 0.0 for p in range(16)]) and row.z == [0.0] * 16


def test_cosine_with_zero_vector_is_zero(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0], [2.0, 0.0])], "z array<double>, a array<double>, b array<float>")
    assert row.select(cosine(F.col("z"), F.col("a")), cosine(F.col("a"), F.col("b"))).first()[:] == (0.0, 1.0)


def test_best_match_first_and_sponsored_only(indexed, cv):
    assert companies(ranking.rank_batch(indexed, cv, 10)) == ["Nordhavn", "Kruste"]


def test_without_visa_filter_all_are_ranked(indexed, cv):
    ranked = ranking.rank_batch(indexed, cv, 10, countries=None, require_visa=False)
    assert set(companies(ranked)) == {"Nordhavn", "Kruste", "Stadsdepot", "Slate Ridge"}
    assert companies(ranked)[0] == "Nordhavn"


def test_scores_are_bounded_and_explained(indexed, cv):
    ferry = ranking.rank_batch(indexed, cv, 10, ["IE", "DE"]).filter("company = 'Nordhavn'").first()
    assert 0 <= ferry.match_score <= 1 and ferry.visa_eligible
    assert ferry.match_reasons[1:] == ["offers visa sponsorship", "in target country IE", "lead-level role"]
    assert ferry.match_reasons[0].startswith("semantic match 0.")
    line = ranking.rank_lines(ranking.rank_batch(indexed, cv, 1)).first().line
    assert "  Fleet Scheduler @ Nordhavn (IE)  [semantic match" in line


def flat(spark, rows):
    return spark.createDataFrame(rows, "content_hash string, vector array<double>, visa_sponsorship string, country string, seniority string, company string")


def test_top_k_is_taken_before_the_boosts(spark):
    jobs = flat(spark, [("a", [1.0, 0.0], "no", "FR", "mid", "A"), ("b", [0.9, 0.43589], "yes", "IE", "lead", "B")])
    profile = spark.createDataFrame([(1, [1.0, 0.0])], "cv_id bigint, cv_vector array<double>")
    assert companies(ranking.rank_batch(jobs, profile, 1, None, require_visa=False)) == ["A"]
    assert companies(ranking.rank_batch(jobs, profile, 2, None, require_visa=False)) == ["B", "A"]


def test_negative_similarity_ties_and_missing_country(spark):
    jobs = flat(
        spark,
        [("b", [-1.0, 0.0], "yes", None, "mid", "B"), ("a", [-1.0, 0.0], "yes", "IE", "mid", "A"), ("z", [0.0, 0.0], "yes", "IE", "mid", "Z")],
    )
    profile = spark.createDataFrame([(1, [1.0, 0.0])], "cv_id bigint, cv_vector array<double>")
    rows = ranking.rank_batch(jobs, profile, 3, []).orderBy("position").collect()
    assert [r.company for r in rows] == ["Z", "A", "B"]
    assert [r.match_score for r in rows] == [0.15] * 3 and rows[1].similarity == -1.0
    assert rows[1].match_reasons == ["semantic match 0.00", "offers visa sponsorship"]
    assert companies(ranking.rank_batch(jobs, profile, 3, ["IE"])) == ["Z", "A"]


def test_blocks_and_partitions_give_the_same_hits(spark):
    jobs = spark.range(700).select(
        F.format_string("%05d", "id").alias("content_hash"),
        F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(i * (F.col("id") % 300) + i)).alias("vector"),
    )
    profiles = spark.range(40).select(
        F.col("id").alias("cv_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.cos(i * F.col("id"))).alias("cv_vector")
    )
    rows = lambda df: sorted(map(tuple, df.collect()))
    shipped = rows(search.knn_topk(jobs, profiles, 5))
    assert len(shipped) == 200
    assert rows(search.knn_topk(jobs.repartition(13), profiles, 5)) == shipped
    assert rows(search.knn_topk(jobs, profiles, 5, block_bytes=8 * 8 * 8)) == shipped
    assert search.knn_topk(jobs.limit(0), profiles, 5).count() == 0
    assert search.knn_topk(jobs, profiles.limit(0), 5).count() == 0


def test_numbers_are_rounded_as_python_does(spark):
    values = [0.0, 0.005, 0.015, 0.025, 0.045, 0.125, 0.375, 0.625, 0.285, 0.995, 0.9949999, 1.0, 1e-12, 0.0005, 0.0015, 0.0625, 0.1875]
    values += [i / 1000 + 0.005 for i in range(0, 995, 7)] + [i * 0.0005 for i in range(1, 2000, 13)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (2, 3):
        found = [r.s for r in frame.select(scoring.fixed(F.col("x"), digits).alias("s")).collect()]
        assert found == [f"{v:.{digits}f}" for v in values]


def test_the_index_is_computed_once(spark):
    profile = spark.createDataFrame([(1, [1.0, 0.0])], "cv_id bigint, cv_vector array<double>")
    counted = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(value):
        counted.add(1)
        return value

    rows = flat(spark, [(str(i), [1.0, float(i)], "yes", "IE", "mid", f"C{i}") for i in range(20)])
    traced = keep_last(rows.withColumn("company", seen("company")), "content_hash", "seniority")
    assert ranking.rank_batch(traced, profile, 3, []).count() == 3
    assert counted.value == 20


def test_listing_and_lookup(indexed):
    assert index.job_count(indexed).first().jobs == 4
    names = lambda df: {r.company for r in df.collect()}
    assert names(index.list_jobs(indexed, visa="yes")) == {"Nordhavn", "Kruste"}
    assert names(index.list_jobs(indexed, ["IE"])) == {"Nordhavn"}
    assert names(index.list_jobs(indexed, [], seniority="junior", remote="onsite")) == {"Stadsdepot"}
    assert index.list_jobs(indexed, limit=3).count() == 3
    assert index.list_jobs(indexed).count() == indexed.count()
    assert index.get_job(indexed, f"{2:016x}").first().company == "Kruste"
    assert index.get_job(indexed, "0" * 16).count() == 0
    assert len(names(dashboard_matches(indexed, indexed.limit(1).select(F.lit(1).cast("bigint").alias("cv_id"), F.col("vector").alias("cv_vector"))))) == 2


def test_upsert_overwrites_by_hash(spark):
    make = lambda *rows: spark.createDataFrame(rows, "seq bigint, content_hash string, title string")
    old = index.index_upsert(None, make((1, "a", "x"), (2, "b", "y"), (3, "a", "z")))
    new = index.index_upsert(old, make((4, "b", "w"), (5, "c", "v")))
    assert {(r.content_hash, r.title) for r in new.collect()} == {("a", "z"), ("b", "w"), ("c", "v")}


def test_vectors_must_be_there_and_fit(spark):
    jobs = spark.createDataFrame([(1,), (2,)], "seq bigint")
    vectors = spark.createDataFrame([(1, [1.0, 2.0])], "seq bigint, vector array<double>")
    with pytest.raises(Exception, match="no vector for job 2"):
        index.attach_vectors(jobs, vectors, "seq").collect()
    with pytest.raises(Exception, match="expected a vector of width 3"):
        vectors.select(checked_vector(F.col("vector"), 3)).collect()


def test_upsert_keeps_one_row_per_hash_of_any_index(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "seq bigint, content_hash string, title string")
    several = make((1, "h1", "old"), (2, "h1", "new"), (3, "h2", "x"))
    stored = index.index_upsert(several, make((4, "h3", "y"))).collect()
    assert sorted((r.content_hash, r.title) for r in stored) == [("h1", "new"), ("h2", "x"), ("h3", "y")]


def test_versioned_index_publishes_whole_versions(spark, tmp_path):
    import re

    import pytest

    from vocara.sources import index_store

    root = str(tmp_path / "index")
    rows = lambda pairs: spark.createDataFrame(
        [(h, s, [float(s), 1.0]) for h, s in pairs], "content_hash string, seq bigint, vector array<double>"
    )
    first = index_store.upsert_at(root, rows([("aa1", 1), ("bb1", 2)]))
    assert first.count() == 2 and index_store.manifest(spark, root) == {"version": 1, "width": 2, "rows": 2}
    old = index_store.read_index(spark, root)
    index_store.upsert_at(root, rows([("aa1", 3), ("cc1", 4)]))
    assert sorted((r.content_hash, r.seq) for r in old.collect()) == [("aa1", 1), ("bb1", 2)]
    now = index_store.read_index(spark, root)
    assert sorted((r.content_hash, r.seq) for r in now.collect()) == [("aa1", 3), ("bb1", 2), ("cc1", 4)]
    assert index_store.manifest(spark, root)["version"] == 2
    job = index_store.get_job_at(spark, root, "aa1")
    assert [r.seq for r in job.collect()] == [3]
    plan = job._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*prefix#\d+, aa\)", plan) or "prefix#" in plan and "= aa)" in plan
    with pytest.raises(ValueError, match="width 3 meet an index of width 2"):
        index_store.upsert_at(root, spark.createDataFrame([("dd1", 5, [1.0, 2.0, 3.0])], "content_hash string, seq bigint, vector array<double>"))
    assert index_store.manifest(spark, root)["version"] == 2
