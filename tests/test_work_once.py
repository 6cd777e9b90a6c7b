"""Steps that cost much run once, and only over what can still matter."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vocara.functions import rules, text
from vocara.operators import dedup, search
from vocara.operators.dedup import WordSets, dedup_near
from vocara.plans import queries


def word_rows(spark, sets):
    return spark.createDataFrame([(s, sorted(w)) for s, w in sets.items()], "seq bigint, words array<string>")


def chain(length, width=100, step=2):
    """Sets of which each resembles only its neighbours."""
    return {i: {f"w{j}" for j in range(step * i, step * i + width)} for i in range(length)}


def test_rows_that_meet_carry_their_signatures(spark):
    sets = chain(4) | {100: {f"alone{j}" for j in range(50)}}
    finder = WordSets(0.97)
    met = finder.ready(finder.meeting(word_rows(spark, sets)))
    assert {r.seq for r in met.collect()} == {0, 1, 2, 3}
    carried = finder.signatures(met)
    assert "InArrow" not in carried._jdf.queryExecution().executedPlan().toString()
    every = {tuple(r) for r in finder.signatures(word_rows(spark, sets)).collect()}
    assert {tuple(r) for r in carried.collect()} <= every
    meet = lambda keys: {(a.seq, b.seq) for a in keys for b in keys if a.word == b.word and a.seq < b.seq}
    assert meet(carried.collect()) == meet(finder.signatures(word_rows(spark, sets)).collect())


@pytest.mark.parametrize("few", [0, 2_000])
def test_few_rows_are_decided_without_rounds(spark, monkeypatch, few):
    labels, real = [], dedup.store
    monkeypatch.setattr(dedup, "store", lambda df, label: labels.append(label) or real(df, label))
    finder = WordSets(0.97)
    finder.FEW_ROWS = few
    verdict = {r.seq: r.is_duplicate for r in dedup_near(word_rows(spark, chain(6)), finder).collect()}
    assert verdict == {i: i % 2 == 1 for i in range(6)}
    assert labels.count("kept") == (1 if few else 3)


def test_each_row_is_probed_against_one_row_per_signature(spark):
    base = {f"w{j}" for j in range(200)}
    sets = {i: base | {f"own{i}"} for i in range(40)}
    finder = WordSets(0.97)
    found = finder.first_pairs(finder.ready(finder.meeting(word_rows(spark, sets)))).select("a", "b").collect()
    assert {r.b for r in found} == set(range(1, 40)) and len(found) < 3 * 40, "40 * 39 / 2 pairs are similar"


def test_the_stream_makes_its_pages_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def html(seq):
        made.add(1)
        return f"<p>{seq}</p>"

    html = html.asNondeterministic()
    pages = spark.range(9).select(F.col("id").alias("seq"), F.lit("board").alias("source"), F.col("id").cast("string").alias("url"), html("id").alias("html"))
    monkeypatch.setattr(queries, "posting_pages", lambda spark, sf: pages)
    seen = []
    watch = lambda stream, *_: seen.append(stream) or SimpleNamespace(awaitTermination=lambda: None)
    monkeypatch.setattr(queries.streaming, "start_ingest", watch)
    queries._streamed(spark, "unused")
    assert len(seen) == 3 and made.value == 9


def test_known_bounds_leave_only_hits_that_can_win():
    rng = np.random.default_rng(8)
    profiles, jobs = search.unit_rows(rng.normal(size=(40, 8))), search.unit_rows(rng.normal(size=(500, 8)).round(1))
    hashes = np.array([f"{i % 7:08d}{i:08d}" for i in range(500)], dtype=object)
    batch = pd.DataFrame({"content_hash": hashes, "vector": list(jobs)})
    scores = np.round(profiles @ jobs.T, 9)
    bounds = np.sort(scores, axis=1)[:, -3]
    found = pd.concat(search._best_hits(iter([batch]), np.arange(40), profiles, 20, bounds))
    assert (found.groupby("cv_id").size() >= 3).all() and len(found) < 40 * 20
    for cv_id, hits in found.groupby("cv_id"):
        best = sorted(zip(-scores[cv_id], hashes))[:3]
        assert list(hits["content_hash"])[:3] == [h for _, h in best]


def test_equal_scores_go_by_the_whole_hash(spark):
    rows = [(f"samehead{c}", [1.0, 0.0]) for c in "dacb"] + [("zz", [0.0, 1.0])]
    jobs = spark.createDataFrame(rows, "content_hash string, vector array<double>")
    profiles = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0])], "cv_id bigint, cv_vector array<double>")
    hits = sorted(search.knn_topk(jobs, profiles, 2).collect(), key=lambda r: (r.cv_id, r.sim_rank))
    assert [(r.cv_id, r.content_hash, r.similarity) for r in hits] == [
        (1, "sameheada", 1.0), (1, "sameheadb", 1.0), (2, "sameheada", 0.0), (2, "sameheadb", 0.0),
    ]


def test_visa_patterns_see_only_lines_with_a_hint(spark):
    bodies = ["a\nWe can sponsor\nb", "no\nsponsorship", "x\nhsm\ny", "must have the right\nto work", "", None, "Without sponsorship"]
    rows = spark.createDataFrame([(b, []) for b in bodies], "body string, signals array<string>")
    of = lambda f: f(F.col("signals"), F.lit(None).cast("string"), F.col("body"))
    plain = lambda s, m, b: rules.classify_visa(rules.visa_text(s, m, b), F.lit("unknown"))
    found = rows.select(of(lambda s, m, b: rules.refine_visa(s, m, F.lit("unknown"), b)).alias("new"), of(plain).alias("old")).collect()
    assert [r.new for r in found] == [r.old for r in found] == ["yes", "unknown", "yes", "unknown", "unknown", "unknown", "no"]
    lines = rows.select(rules.hinted_lines(F.lower("body")).alias("x")).collect()
    assert [r.x for r in lines][:3] == ["we can sponsor", "sponsorship", "hsm"]


def test_years_words_and_spaces_as_before(spark):
    texts = ["123 years", "5+ years, 7 years", "x 12+ years", "years", "a\tb  c \t d", "  Ünï_x, Straße-STRASSE ſ ok  ", "", "..."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(
        F.regexp_extract("t", rules.YEARS_BEFORE, 1).alias("a"), F.regexp_extract("t", rules.YEARS_PATTERN, 1).alias("b"),
        text.word_set(F.col("t")).alias("c"), text.normalize(F.col("t")).alias("d"), text.html_to_text(F.col("t")).alias("e"),
    ).collect()
    assert [r.a for r in got] == [r.b for r in got]
    assert [r.c for r in got] == [sorted(set(r.d.split())) for r in got]
    assert got[4].e == "a b c d" and got[1].e == texts[1]
