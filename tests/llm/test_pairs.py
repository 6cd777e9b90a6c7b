"""Joins on pairs against brute force, with hot groups, copies and odd rows."""

import numpy as np
import pytest

from vocara.llm import cap_filters, ngram_jaccard, tiles
from vocara.llm.components import components

DIR = "/root/testdata/sf0.001"


def union(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def texts(rng, n=40):
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choice(words, rng.integers(6, 90))) for _ in range(n)]
    out = list(base)
    for i in range(0, n, 3):
        for _ in range(4):
            near = base[i].split()
            for _ in range(rng.integers(0, 3)):
                near[rng.integers(0, len(near))] = "edit" + str(rng.integers(0, 9))
            out.append(" ".join(near))
    common = list(rng.choice(words, 70))  # one large group
    for _ in range(120):
        near = list(common)
        near[rng.integers(0, 70)] = "e" + str(rng.integers(0, 40))
        out.append(" ".join(near))
    return [*out, None, "", "  ", "one", "One", "two words", "a b c d e", "a b c d e", "A  b\nc d e", "x " * 3000]


def brute_jaccard(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    ids = list(sets)
    pairs = [
        (a, b) for x, a in enumerate(ids) for b in ids[:x] if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 10 * threshold * len(sets[a] | sets[b])
    ]
    links = dict.fromkeys(ids, 0)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    return links, union(ids, pairs)


@pytest.mark.parametrize("chunk", [None, 16])
def test_ngram_join_equals_brute_force(spark, monkeypatch, chunk):
    rows = list(enumerate(texts(np.random.default_rng(1))))
    if chunk:
        monkeypatch.setattr(ngram_jaccard, "CHUNK", chunk)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_links string, class_id int").repartition(5)
    links, groups = brute_jaccard(rows)
    got = {r["doc_id"]: r for r in ngram_jaccard.ngram_jaccard_join(frame).collect()}
    assert len(got) == len(rows)
    assert {i: r["n_links"] for i, r in got.items()} == links
    assert {i: r["component_id"] for i, r in got.items()} == groups


def test_ngram_join_on_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    links, groups = brute_jaccard(rows)
    got = ngram_jaccard.ngram_jaccard_join(spark.read.parquet(f"{DIR}/documents.parquet")).collect()
    assert {r["doc_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (links[i], groups[i]) for i in links}


def test_ngram_join_odd_tables(spark):
    schema = "doc_id long, text string"
    assert ngram_jaccard.ngram_jaccard_join(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (1, None), (2, "a b c d e f"), (2, "a b c d e f"), (3, "z")]
    got = sorted((r["doc_id"], r["n_links"], r["component_id"]) for r in ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 0, 1), (2, 1, 2), (2, 1, 2), (3, 0, 3)]


def test_bands_reach_the_recall():
    bands, rows = ngram_jaccard.choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999
    rng = np.random.default_rng(5)
    met = 0
    for _ in range(400):
        a = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
        b = np.concatenate((a[:800], rng.integers(0, 1 << 63, 100, dtype=np.uint64)))  # 0.8 of the union
        met += bool((ngram_jaccard.signature(a, bands, rows) == ngram_jaccard.signature(b, bands, rows)).any())
    assert met >= 396


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(200, 400)] + [(5000, 5000)] + [tuple(map(int, rng.integers(6000, 6100, 2))) for _ in range(70)]
    pairs += [(None, 3), (7, None)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    whole = [(a, b) for a, b in pairs if a is not None and b is not None and a != b]
    expected = union({x for p in whole for x in p}, whole)
    assert got == expected


def test_roots_are_smallest_members():
    linked = np.zeros((5, 5), dtype=bool)
    linked[0, 3] = linked[3, 0] = linked[3, 4] = linked[4, 3] = True
    assert tiles.roots(linked, np.array([9, 2, 8, 5, 7])).tolist() == [5, 2, 8, 5, 5]


def vectors(rng):
    base = rng.standard_normal((150, 24))
    out = [list(map(float, v)) for v in base]
    for i in range(0, 60, 2):
        out.append([float(x) for x in base[i] + rng.standard_normal(24) * rng.uniform(0.02, 0.4)])
    out += [list(map(float, base[1]))] * 30
    hot = rng.standard_normal(24)
    out += [[float(x) for x in hot + rng.standard_normal(24) * 0.15] for _ in range(200)]
    out += [[float(2 * x) for x in base[3]], None, [0.0] * 24, [float("nan")] * 24, [1.0, None], [1.0, 2.0], [2.0, 4.0], [], [float("inf")] * 24]
    return list(enumerate(out))


def brute_cosine(rows, threshold=0.95):
    unit = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit[i] = np.array(v) / np.linalg.norm(v)
    ids = list(unit)
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    links = {i: 0 for i, _ in rows}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    return links, union(list(links), pairs)


@pytest.mark.parametrize("chunk", [None, 32])
def test_cap_filters_equal_brute_force(spark, monkeypatch, chunk):
    rows = vectors(np.random.default_rng(3))
    if chunk:
        monkeypatch.setattr(cap_filters, "CHUNK", chunk)
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, filters string").repartition(4)
    links, groups = brute_cosine(rows)
    got = {r["vec_id"]: r for r in cap_filters.cap_filter_join(frame).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == groups
    assert {i: r["n_links"] for i, r in got.items()} == links
    assert all(r["kept"] == (i == groups[i]) for i, r in got.items())


def test_cap_filters_find_pairs_near_the_threshold():
    rng = np.random.default_rng(8)
    a = rng.standard_normal((300, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * side
    words = 24
    bound = cap_filters.fit_bound(a, words)
    lists = []
    for x in (a, b):
        first, second = cap_filters.halves(x, words)
        lists.append([set(cap_filters.decode(p, q, bound, cap_filters.LEAST).tolist()) for p, q in zip(first, second, strict=True)])
    met = sum(bool(x & y) for x, y in zip(*lists, strict=True))
    assert met >= 294


@pytest.mark.parametrize("size", [80_000, 5_000_000, 120_000_000])
def test_cap_filters_keep_their_recall_at_every_code_size(size):
    rng = np.random.default_rng(21)
    fitted, fresh = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.standard_normal((2, 512, 64)))
    words = cap_filters.code_words(size)
    bound, least = cap_filters.choose_filters(fitted, words)
    assert cap_filters.missed(fresh, 0.95, words, bound, least, 4096, 4096) <= 8
    if size > 80_000:  # fixed numbers of filters lose pairs in a large code
        assert cap_filters.missed(fresh, 0.95, words, cap_filters.fit_bound(fitted, words), cap_filters.LEAST, 4096, 4096) > 8


def test_decode_lists_exactly_the_filters_over_the_bound():
    rng = np.random.default_rng(4)
    first, second = rng.standard_normal(49), rng.standard_normal(49)
    whole = (first[:, None] + second[None, :]).ravel()
    assert set(cap_filters.decode(first, second, 1.5, 1).tolist()) == set(np.flatnonzero(whole > 1.5).tolist())
    assert len(cap_filters.decode(first, second, 99.0, 12)) >= 12


def test_cap_filters_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert cap_filters.cap_filter_join(spark.createDataFrame([], schema)).count() == 0
    got = cap_filters.cap_filter_join(spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.0]), (7, None)], schema)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(5, 1, 5), (5, 1, 5), (7, 0, 7)]


def test_small_rounds_are_not_written_by_every_shuffle_partition(spark):
    from pathlib import Path

    from vocara.llm import common

    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesced = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    most, written = spark.sparkContext.defaultParallelism, []
    held = common.materialize(spark.createDataFrame([(i, i + 1) for i in range(400)], "u long, v long"), "test")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = common.materialize(common.packed(held.groupBy("u").agg({"v": "min"}), 400), "test")
        written = list(Path(got.scratch.removeprefix("file:")).glob("part-*"))
        found = components(held, 400).groupBy("component").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    assert len(written) <= most < 37 and got.count() == 400
    assert [tuple(r) for r in found] == [(0, 401)]
