"""What operators store, ship and hold stays bounded where tables grow."""

import os

import numpy as np
import pandas as pd

from vocara.operators import search
from vocara.operators.dedup import DenseVectors, WordSets
from vocara.operators.extraction import rule_provider
from vocara.plans.ingest import ingest
from vocara.session import scratch_root


def word_rows(spark, sets):
    return spark.createDataFrame([(s, sorted(w)) for s, w in sets.items()], "seq bigint, words array<string>")


def test_sets_that_share_only_some_words_never_meet(spark):
    sets = {i: {f"hub{j}" for j in range(5)} | {f"w{i}x{j}" for j in range(35)} for i in range(60)}
    sets[100] = {f"near{j}" for j in range(100)}
    sets[101] = (sets[100] - {"near7"}) | {"other"}
    sets[102] = set()
    assert {r.seq for r in WordSets(0.97).meeting(word_rows(spark, sets)).collect()} == {100, 101}


def test_similar_sets_share_a_signature(spark):
    rng = np.random.default_rng(3)
    sets = {}
    for i in range(150):
        base = {f"b{i}w{j}" for j in range(int(rng.integers(1, 90)))}
        sets[2 * i] = base
        sets[2 * i + 1] = set(list(base)[int(rng.integers(0, 8)) :]) | {f"n{i}w{j}" for j in range(int(rng.integers(0, 5)))}
    keys: dict[int, set] = {}
    finder = WordSets(0.9)
    for r in finder.signatures(word_rows(spark, sets)).collect():
        keys.setdefault(r.seq, set()).add(r.word)
    similar = [i for i in range(0, 300, 2) if sets[i + 1] and len(sets[i] & sets[i + 1]) >= 0.9 * (len(sets[i]) * len(sets[i + 1])) ** 0.5]
    assert len(similar) > 40 and all(keys[i] & keys[i + 1] for i in similar)


def test_stored_signatures_are_one_file_a_bucket(spark, tmp_path):
    rows = word_rows(spark, {i: {f"w{i}x{j}" for j in range(40)} for i in range(200)}).repartition(8)
    WordSets(0.97).stored_signatures(rows).write.partitionBy("bucket").parquet(str(tmp_path / "keys"))
    files = [f for _, _, names in os.walk(tmp_path / "keys") for f in names if f.endswith(".parquet")]
    assert 8 < len(files) <= WordSets.SIGNATURE_BUCKETS


def test_ingest_keeps_no_texts_in_the_shared_folder(spark):
    html = "<html><body><h1>{0}</h1><p>{0} Works</p><p>Cork, Ireland</p><p>a senior-level role at {0}</p></body></html>"
    names = ["Baker", "Miller", "Baker"]
    items = spark.createDataFrame([(i, "board", f"https://jobs.test/{i}") for i in range(4)], "seq bigint, source string, url string")
    pages = spark.createDataFrame([(f"https://jobs.test/{i}", html.format(n)) for i, n in enumerate(names)], "url string, html string")
    root = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    done = ingest(items, pages, rule_provider())
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(root)) - before}
    assert not left & {"scanned", "requests", "rendered", "embedded", "near-input", "near-keys"}
    assert {r.seq: r.outcome for r in done.outcomes.collect()} == {0: "indexed", 1: "indexed", 2: "duplicate", 3: "error"}
    assert done.index.count() == 2 and done.cache.count() == 2 and done.embedded.count() == 2 and done.calls.count() == 2


def test_vectors_without_clusters_are_not_copied_to_every_cell(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 32)))], "seq bigint, vector array<double>")
    finder = DenseVectors(0.9, rows_per_pivot=10, tile_rows=64)
    assert finder._assign(finder.prepare(rows), with_borders=True).count() < 4 * 600


def test_search_sorts_one_stripe_of_profiles_and_only_what_can_win(monkeypatch):
    rng = np.random.default_rng(5)
    profiles, jobs = rng.normal(size=(1300, 6)).round(1), rng.normal(size=(900, 6)).round(1)
    profiles, jobs = search.unit_rows(profiles), search.unit_rows(jobs)
    hashes = np.array([f"{i:04d}" for i in range(900)], dtype=object)
    sizes, cut = [], search._cut
    monkeypatch.setattr(search, "_cut", lambda hits, k: sizes.append(len(hits)) or cut(hits, k))
    batches = [pd.DataFrame({"content_hash": hashes[i : i + 150], "vector": list(jobs[i : i + 150])}) for i in range(0, 900, 150)]
    found = pd.concat(search._best_hits(iter(batches), np.arange(1300), profiles, 5))
    assert max(sizes) < 3 * 5 * search.PROFILE_STRIPE
    scores = np.round(profiles @ jobs.T, 9)
    for cv_id, hits in found.groupby("cv_id"):
        best = sorted(zip(-scores[cv_id], hashes))[:5]
        assert list(hits["content_hash"]) == [h for _, h in best] and np.allclose(hits["similarity"], [-s for s, _ in best])
