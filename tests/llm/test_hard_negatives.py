"""Hard-negative mining against a brute force of the contract, on awkward rows and small shards."""

import math
import random

import pytest

from vocara.llm import hard_negatives
from vocara.llm.hard_negatives import mine_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, extra string"


def brute(rows):
    valid = []
    for k, (vid, emb, label, _) in enumerate(rows):
        if label is None or emb is None or any(x is None or not math.isfinite(x) for x in emb):
            continue
        if vid is not None and vid % 7 == 0:
            label = (label + 1) % 10
        valid.append((k, vid, label, [math.floor(256 * float(x)) for x in emb]))

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    def key(score, vid):
        return (-score, vid is None, vid or 0)

    out = []
    for k, vid, label, e in valid:
        if vid is None or vid % 100:
            continue
        scored = [(dot(e, o[3]), o) for o in valid]
        pos = sorted(((s, o) for s, o in scored if o[2] == label and o[0] != k), key=lambda t: key(t[0], t[1][1]))[:5]
        for ps, p in pos:
            neg = sorted(((s, o) for s, o in scored if o[2] != label and 80 * ps <= 100 * s <= 100 * ps), key=lambda t: key(t[0], t[1][1]))[:5]
            out += [(vid, p[1], r + 1, o[1], ps, s) for r, (s, o) in enumerate(neg)]
    return sorted(out, key=repr)


def _rows(seed, n=700, dim=8):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = [rng.gauss(0, 0.3) for _ in range(dim)]
        rows.append((i, base, rng.randrange(4), "x"))
    rows += [(100, rows[5][1], rows[5][2], "copy"), (200, rows[200][1], rows[200][2], "same row"), (200, rows[200][1], rows[200][2], "same row")]
    rows += [(None, rows[7][1], 1, None), (300, None, 1, None), (400, [0.1, float("nan")] + [0.0] * 6, 1, None), (500, rows[9][1], None, None)]
    rows += [(600, [0.0] * dim, 2, None), (701, [0.5, 0.5], 1, None), (800, [], 3, None), (900, [float("inf")] + [0.0] * 7, 0, None)]
    rows += [(1000, [1000.0] * dim, 1, None), (1100, [x + 1e-3 for x in rows[11][1]], rows[11][2], None)]
    return rows


@pytest.mark.parametrize("cells", [1 << 23, 64])
def test_against_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(hard_negatives, "SHARD_CELLS", cells)
    monkeypatch.setattr(hard_negatives, "MEMBERS", 2)
    rows = _rows(3)
    got = mine_hard_negatives(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_empty_and_all_invalid(spark):
    assert mine_hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mine_hard_negatives(spark.createDataFrame([(100, None, 1, None), (200, [1.0], None, None)], SCHEMA)).count() == 0
