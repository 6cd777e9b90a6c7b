import numpy as np
import pytest

from vocara.operators.dedup import DenseVectors, WordSets, dedup_exact, dedup_near, near_dup_pairs


def greedy(vectors: dict[int, np.ndarray], threshold: float) -> tuple[set[int], dict[int, tuple[int, float]]]:
    """The sequential loop: duplicates, and the best match of each."""
    kept: list[int] = []
    matches: dict[int, tuple[int, float]] = {}
    for seq in sorted(vectors):
        v = vectors[seq]
        sims = []
        for k in kept:
            norms = np.linalg.norm(v) * np.linalg.norm(vectors[k])
            sims.append((round(float(v @ vectors[k] / norms), 9) if norms else 0.0, -k))
        best = max(sims, default=(0.0, 0))
        if sims and best[0] >= threshold:
            matches[seq] = (-best[1], best[0])
        else:
            kept.append(seq)
    return set(matches), matches


def dense(spark, vectors):
    return spark.createDataFrame([(s, [float(x) for x in v]) for s, v in vectors.items()], "seq bigint, vector array<double>")


def word_rows(spark, sets):
    return spark.createDataFrame([(s, sorted(w)) for s, w in sets.items()], "seq bigint, words array<string>")


def as_vectors(sets):
    vocabulary = sorted(set().union(*sets.values()))
    return {s: np.array([float(w in words) for w in vocabulary]) for s, words in sets.items()}


def duplicates(df):
    rows = df.collect()
    assert len({r.seq for r in rows}) == len(rows)
    return {r.seq for r in rows if r.is_duplicate}


def random_vectors(seed, n=120):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5))
    points = centres[rng.integers(0, 6, n)] + rng.normal(scale=rng.choice([0.0, 0.15, 0.6], n)[:, None], size=(n, 5))
    points[rng.integers(0, n, 3)] = 0.0
    return dict(zip((int(s) for s in rng.permutation(n * 3)[:n]), points.round(6)))


def random_sets(seed, n=120):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    bases = [set(rng.choice(words, 40, replace=False)) for _ in range(4)]
    sets = {}
    for s in rng.permutation(n * 3)[:n]:
        base = set(bases[int(rng.integers(0, 4))])
        for w in rng.choice(words, int(rng.integers(0, 4)), replace=False):
            base ^= {str(w)}
        sets[int(s)] = {str(w) for w in base}
    sets[max(sets) + 1] = set()
    sets[max(sets) + 1] = set()
    return sets


SMALL = dict(pair_budget=200)


@pytest.mark.parametrize(("seed", "options"), [(0, {}), (1, SMALL)])
def test_dense_equals_the_sequential_loop(spark, seed, options):
    vectors = random_vectors(seed)
    expected, matches = greedy(vectors, 0.97)
    finder = DenseVectors(0.97, rows_per_pivot=20, tile_rows=16)
    rows = dense(spark, vectors)
    assert expected and duplicates(dedup_near(rows, finder, **options)) == expected
    found = {r.seq: (r.match_seq, round(r.similarity, 6)) for r in near_dup_pairs(rows, finder, **options).collect()}
    assert found == {s: (m, round(v, 6)) for s, (m, v) in matches.items()}


@pytest.mark.parametrize(("seed", "options"), [(2, {}), (3, SMALL)])
def test_word_sets_equal_the_sequential_loop(spark, seed, options):
    sets = random_sets(seed)
    expected, matches = greedy(as_vectors(sets), 0.95)
    rows = word_rows(spark, sets)
    assert expected and duplicates(dedup_near(rows, WordSets(0.95), **options)) == expected
    found = {r.seq: (r.match_seq, round(r.similarity, 6)) for r in near_dup_pairs(rows, WordSets(0.95), **options).collect()}
    assert found == {s: (m, round(v, 6)) for s, (m, v) in matches.items()}


def test_one_word_in_every_row(spark):
    sets = {i: {"the", f"a{i % 40}", *(f"w{i}x{j}" for j in range(i % 5))} for i in range(200)}
    expected, _ = greedy(as_vectors(sets), 0.97)
    for few in (1, 4_096):
        finder = WordSets(0.97)
        finder.FREQUENT_WORDS = few
        prepared = {r.seq: r.words for r in finder.prepare(word_rows(spark, sets)).collect()}
        assert all(words[-1] == "the" and set(words) == sets[s] for s, words in prepared.items())
        assert expected and duplicates(dedup_near(word_rows(spark, sets), finder, pair_budget=50)) == expected


def test_preparing_words_moves_counts_only(spark):
    plan = WordSets(0.97).prepare(word_rows(spark, {1: {"a", "b"}, 2: {"b"}}))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_similarity_is_not_transitive(spark):
    angle = lambda degrees: np.array([np.cos(np.radians(degrees)), np.sin(np.radians(degrees))])
    chain = {1: angle(0), 2: angle(12), 3: angle(24), 4: angle(36)}
    assert duplicates(dedup_near(dense(spark, chain), DenseVectors(0.97))) == {2, 4}


def test_a_hot_cluster_never_lists_its_pairs(spark):
    # One group of near copies, far more pairs than the budget, next to a few other rows.
    rng = np.random.default_rng(5)
    points = np.array([1.0, 0.0, 0.0]) + rng.normal(scale=0.01, size=(600, 3))
    vectors = dict(enumerate(points.round(6))) | {600: np.array([0.0, 1.0, 0.0]), 601: np.array([0.0, 0.0, 1.0])}
    seen = []

    class Watched(DenseVectors):
        def pairs(self, left, right, ordered=True):
            found = super().pairs(left, right, ordered)
            seen.append(found.count())
            return found

    assert duplicates(dedup_near(dense(spark, vectors), Watched(0.97), pair_budget=2_000)) == set(range(1, 600))
    assert max(seen) < 2_000 and sum(seen) < 10_000


def test_all_identical_and_none(spark):
    same = {i: np.array([1.0, 2.0]) for i in range(5)}
    assert duplicates(dedup_near(dense(spark, same), DenseVectors(0.97))) == {1, 2, 3, 4}
    apart = {0: np.array([1.0, 0.0]), 1: np.array([0.0, 1.0])}
    assert duplicates(dedup_near(dense(spark, apart), DenseVectors(0.97))) == set()
    assert near_dup_pairs(dense(spark, apart), DenseVectors(0.97)).count() == 0


def test_stored_rows_come_first(spark):
    stored = word_rows(spark, {1: {"a", "b", "c"}, 2: {"x"}})
    fresh = word_rows(spark, {10: {"a", "b", "c"}, 11: {"a", "b"}, 12: {"a", "b"}, 13: {"x", "y"}, 14: set()})
    assert duplicates(dedup_near(fresh, WordSets(0.97), stored)) == {10, 12}
    far = dense(spark, {1: np.array([1.0, 0.0])})
    near = dense(spark, {5: np.array([1.0, 0.1]), 6: np.array([0.0, 1.0])})
    assert duplicates(dedup_near(near, DenseVectors(0.97), far)) == {5}
    again = dense(spark, {1: np.array([1.0, 0.1]), 2: np.array([0.0, 1.0])})
    assert duplicates(dedup_near(again, DenseVectors(0.97), far)) == {1}, "a stored row may have the same number"


def test_exact_keeps_the_first(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "seq bigint, content_hash string")
    assert {r.seq for r in dedup_exact(rows).collect()} == {1, 2}
    plan = dedup_exact(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2, "one row per key and task before the exchange"


def test_zero_rows_pass(spark):
    assert duplicates(dedup_near(word_rows(spark, {1: set(), 2: set()}), WordSets(0.97))) == set()


def test_rounds_follow_the_depth_of_decisions(spark, monkeypatch):
    from vocara.operators import dedup

    labels = []
    real = dedup.store
    monkeypatch.setattr(dedup, "store", lambda df, label: labels.append(label) or real(df, label))
    angle = lambda degrees: np.array([np.cos(np.radians(degrees)), np.sin(np.radians(degrees))])
    chain = {i: angle(12 * i) for i in range(10)}
    assert duplicates(dedup_near(dense(spark, chain), DenseVectors(0.97))) == {1, 3, 5, 7, 9}
    assert labels.count("kept") == 5
    labels.clear()
    rng = np.random.default_rng(9)
    cluster = dict(enumerate((np.array([1.0, 0.0, 0.0]) + rng.normal(scale=0.01, size=(300, 3))).round(6)))
    cluster |= {300: np.array([0.0, 1.0, 0.0]), 301: np.array([0.0, 0.0, 1.0])}
    assert duplicates(dedup_near(dense(spark, cluster), DenseVectors(0.97))) == set(range(1, 300))
    assert labels.count("kept") == 1


def test_hot_prefix_words_meet_in_tiles(spark):
    # in the words' own order "hub" comes first in every row, so it is in every prefix
    sets = {i: {"hub", *(f"w{(i * 7 + j) % 50}" for j in range(20))} for i in range(240)}
    finder = WordSets(0.8)
    finder.TILE_ROWS = 16
    rows = word_rows(spark, sets)
    a, b = finder._tiled(finder._prefix(rows, "a"), finder._prefix(rows, "b"))
    sizes = [r["count"] for r in a.where("word = 'hub'").groupBy("ta", "tb").count().collect()]
    assert len(sizes) > 100 and max(sizes) <= 2 * 16
    expected, matches = greedy(as_vectors(sets), 0.8)
    assert duplicates(dedup_near(word_rows(spark, sets), finder)) == expected
    found = {r.seq: (r.match_seq, round(r.similarity, 6)) for r in near_dup_pairs(word_rows(spark, sets), finder).collect()}
    assert found == {s: (m, round(v, 6)) for s, (m, v) in matches.items()}


def test_probe_reads_only_the_buckets_of_its_prefix_words(spark, tmp_path):
    stored = word_rows(spark, {1: {"a", "b", "c"}, 2: {"x", "y"}, 3: {"p", "q", "r", "s"}})
    fresh = word_rows(spark, {10: {"a", "b", "c"}, 11: {"p", "q", "r", "s", "t"}, 12: {"k"}})
    finder = WordSets(0.8)
    WordSets.postings(stored).write.partitionBy("bucket").parquet(str(tmp_path / "postings"))
    postings = spark.read.parquet(str(tmp_path / "postings"))
    found = finder.probe(stored, fresh, postings)
    plain = finder.probe(stored, fresh)
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in plain.collect())
    assert {(r.a, r.b) for r in found.collect()} == {(1, 10), (3, 11)}
    import re

    plan = found._jdf.queryExecution().executedPlan().toString()
    pruned = re.findall(r"PartitionFilters: \[bucket#\d+ IN \(([0-9,]+)\)\]", plan)
    assert pruned and len(pruned[0].split(",")) < WordSets.BUCKETS
