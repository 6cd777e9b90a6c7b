"""Top-k, mixing and packing against brute force and round trips."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vocara.llm import ball_tree, mixing, packing

DIR = "/root/testdata/sf0.001"


def brute_top(rows, every, k=5):
    fine = [(i, np.floor(256 * np.array(v))) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, x in fine:
        if q % every == 0:
            best = sorted((-int(x @ y), i) for i, y in fine if i != q and len(y) == len(x))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("shard", [8192, 64])
def test_top_k_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(ball_tree, "SHARD", shard)
    monkeypatch.setattr(ball_tree, "BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.standard_normal(6), 2)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(150)] + [(900, None), (901, [float("nan")] * 6), (950, [1.0, None]), (1000, [1.0, 2.0]), (1001, [1.0, 3.0]), (1050, [])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    got = {tuple(r) for r in ball_tree.ball_tree_top_k(frame, F.col("vec_id") % 50 == 0).collect()}
    assert got == brute_top(rows, 50)


@pytest.mark.parametrize("shard", [8192, 64])
def test_top_k_holds_large_components(spark, monkeypatch, shard):
    monkeypatch.setattr(ball_tree, "SHARD", shard)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in np.round(rng.standard_normal(6), 2)]) for i in range(300)]
    rows += [(300, [5000.0, 1.0, -2.0, 0.5, 3.0, 1.0]), (350, [-4.0e6, 2.0, 1.0, 7.0e6, 0.25, 1.0]), (351, [3.0e6 + 0.125, 1.0, 2.0, 6.0e6, 1.0, 1.0])]
    rows += [(352 + i, [3.0e6 + 0.125, 1.0, 2.0, 6.0e6, 1.0, 1.0 + i / 256]) for i in range(4)]
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = set()
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], x, strict=True)), i) for i, x in whole.items() if i != q)[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert {tuple(r) for r in ball_tree.ball_tree_top_k(frame, F.col("vec_id") % 50 == 0).collect()} == want


def test_top_k_of_nothing(spark):
    assert ball_tree.ball_tree_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_tree_visits_few_nodes_when_vectors_cluster():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 8)) * 100
    x = np.floor(np.repeat(centres, 500, axis=0) + rng.standard_normal((20_000, 8)))
    tree = ball_tree.BallTree(x, np.arange(len(x)))
    best = ball_tree.search(tree, x[:3], np.arange(3), np.full(3, -np.inf), 5)
    for q in range(3):
        score = x @ x[q]
        score[q] = -np.inf
        assert best.id[q].tolist() == sorted(range(len(x)), key=lambda i: (-score[i], i))[:5]


def fill(weights, capacity, budget):
    """Water filling by rounds, in whole numbers as late as possible."""
    given, live = {}, dict(weights)
    while live:
        parts = sum(live.values())
        short = [c for c in live if capacity[c] * parts <= live[c] * budget]
        if not short:
            return given | {c: live[c] * budget // parts for c in live}
        least = min(short, key=lambda c: (capacity[c] / live[c], c))
        given[least] = capacity[least]
        budget -= capacity[least]
        del live[least]
    return given


def test_budgets_flow_down_the_tree(spark):
    rows = [("hub", "en", "src0", 900), ("hub", "de", "src0", 50), ("web", "en", "a", 10), ("web", "en", "b", 4000), ("web", "fr", "a", 700), ("web", "xx", "c", 30)]
    mix = mixing.Mix(share=700, epochs=1)
    got = {tuple(r)[:3]: r["target"] for r in mixing.budgets(spark.createDataFrame(rows, "domain string, lang string, source string, tokens long"), mix).collect()}

    def level(budget, names, weights):
        capacity = {n: sum(t for *key, t in rows if tuple(key)[: len(n)] == n) for n in names}
        return fill({n: weights.get(n[-1], mix.other) for n in names}, capacity, budget)

    expected = {}
    for d, b in level(sum(r[3] for r in rows) * 700 // 1000, sorted({r[:1] for r in rows}), mix.domains).items():
        for m, c in level(b, sorted({r[:2] for r in rows if r[:1] == d}), mix.languages).items():
            names = sorted({r[:3] for r in rows if r[:2] == m})
            expected |= fill(dict.fromkeys(names, 1), {n: next(r[3] for r in rows if r[:3] == n) for n in names}, c)
    assert got == expected
    assert got[("web", "en", "a")] == 10 and got[("web", "xx", "c")] == 30


def test_mix_takes_prefixes_of_seeded_epochs(spark):
    import hashlib

    mix = mixing.Mix(share=1300, epochs=3, domains={"hub": 90, "web": 10})
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(1, 40)), ["en", "de", None][i % 3], ["src0", "src1", None][i % 5 % 3]) for i in range(300)]
    rows += [(300, None, "en", "src0"), (301, "", "en", "src0"), (None, "w w", "en", "src0"), (302, "w w w", "en", "src0"), (302, "w w w", "en", "src0")]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, lang string, source string, tokens int")
    got = mixing.mix_sources(frame, mix).collect()
    docs = {(i, lang or "", source or ""): len(t.split()) for i, t, lang, source in rows if i is not None and t}
    leaves = defaultdict(dict)
    for (i, lang, source), n in docs.items():
        leaves[("hub" if source == "src0" else "web", lang, source)][i] = n
    plan = spark.createDataFrame([(*k, sum(v.values())) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    target = {tuple(r)[:3]: r["target"] for r in mixing.budgets(plan, mix).collect()}
    expected = set()
    for leaf, held in leaves.items():
        at = 0
        for epoch in range(3):
            for i in sorted(held, key=lambda i: hashlib.md5(f"7:{epoch}:{i}".encode()).hexdigest()):
                if at + held[i] <= target[leaf]:
                    expected.add((i, *leaf, epoch, held[i], at))
                at += held[i]
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert any(r["epoch"] > 0 for r in got)


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def check_packing(rows, got, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc.pop(i), key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        at = 0
        for n, r in enumerate(pieces):
            assert r["start"] == at and 0 < r["length"] <= capacity and (n == 0 or r["length"] == capacity)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids) and (len(pieces) == 1 or len(ids) > capacity)
    assert not by_doc
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_of_documents_is_whole_and_tight(spark):
    frame = spark.read.parquet(f"{DIR}/documents.parquet")
    got = packing.pack(frame).collect()
    bins = check_packing([(r["doc_id"], r["text"]) for r in frame.collect()], got, 1024)
    assert bins <= 1.02 * sum(r["length"] for r in got) / 1024


def test_packing_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a <|endoftext|> b<|endoftext|>"), (4, "x" * 5000), (5, "é " * 40), (6, "\n\n  tab\t" * 3), (7, "<|endoftext|>"), (8, "日本 🙂 don't we'll  it's " * 5)]
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows] + [(None, "lost", 0)], "doc_id long, text string, length int")
    check_packing(rows, packing.pack(frame, capacity=32).collect(), 32)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_minimum_bin_slack_fills_bins():
    rng = np.random.default_rng(6)
    for _ in range(30):
        capacity = int(rng.integers(10, 200))
        histogram = {int(x): int(rng.integers(1, 500)) for x in rng.integers(1, capacity + 1, rng.integers(1, 40))}
        plan = packing.minimum_bin_slack(histogram, capacity)
        used = defaultdict(int)
        for times, chosen in plan:
            assert sum(length * n for length, n in chosen.items()) <= capacity
            for length, n in chosen.items():
                used[length] += times * n
        assert dict(used) == histogram


def test_fullest_is_the_best_sum():
    rng = np.random.default_rng(7)
    for _ in range(50):
        counts = {int(x): int(rng.integers(1, 4)) for x in rng.integers(1, 60, 6)}
        chosen = packing.fullest(counts, 60)
        assert all(n <= counts[x] for x, n in chosen.items()) and max(counts) in chosen
        sums = {max(counts)}
        for x, n in counts.items():
            for _ in range(n - (x == max(counts))):
                sums |= {s + x for s in sums if s + x <= 60}
        assert sum(x * n for x, n in chosen.items()) == max(sums)


def test_cut_keeps_full_pieces_last():
    assert packing.cut(1024) == [(0, 1024)] and packing.cut(2500) == [(0, 452), (452, 1024), (1476, 1024)] and packing.cut(2048) == [(0, 1024), (1024, 1024)]


def test_top_k_leaves_out_only_the_query_row(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.standard_normal(4), 2)]) for i in range(120)]
    rows += [(50, [float(x) for x in np.round(rng.standard_normal(4), 2)]), (100, rows[100][1]), (7, rows[0][1])]
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want = []
    for j, (q, x) in enumerate(whole):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for k, (i, y) in enumerate(whole) if k != j)[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = sorted(tuple(r) for r in ball_tree.ball_tree_top_k(frame, F.col("vec_id") % 50 == 0).collect())
    assert got == sorted(want)
    assert sum(1 for r in got if r[0] == 100 and r[2] == 100) == 2  # each copy answers the other
