"""Hard-negative mining with anchor-clustered shared lists.

Anchors are grouped by direction: centroids are the unit directions of a bounded sample of
anchors (``CENTROIDS``, the smallest by hash), each anchor joins its closest centroid, and a
cluster is cut by hash into parts of about ``MEMBERS`` anchors, each with the widest angle
``theta`` of a member to the centroid. For a candidate x at angle ``phi`` to the centroid, any
member a has ``a.x <= |a| |x| cos(max(0, phi - theta))`` (triangle inequality on the sphere).

Candidates are dealt to shards by hash, anchors to blocks of parts; one task meets one shard
and one block. Per part, the shard's candidates are sorted *once* by that bound; every member
walks the shared list in blocks, scoring exactly in integers, and stops as soon as ``|a|`` times
the next bound (with a margin for rounding) is below what it still needs:

* wave 1, positives: the 5th best same-label score so far (nothing until five are seen);
* wave 2, negatives for the *global* positives of wave 1: per positive with score ``ps``, the
  5th best qualifying score so far, else the lowest score that could qualify
  (``80 ps <= 100 ns <= 100 ps``); the smallest of these over its positives.

A shard's own first five always contain the global first five that lie in it, so merging the
shards' lists with a window gives the exact result. Scores are integer inner products of
``floor(256 x)``; they stay in int64 where ``d * max^2 < 2^62`` and are Python integers otherwise.

Cases: rows with a null label or vector or a null or non-finite component take no part; an
empty vector is a zero vector; vectors of other lengths are padded with zeros; a null vec_id is
never an anchor and never divisible by 7, and sorts after every id; repeated rows are rows of
their own (an anchor's copy may be its positive); other columns are ignored; empty input gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocara.llm.common import materialize

# Fixed values of the contract.
SCALE = 256
ANCHOR_EVERY = 100
SHIFT_EVERY = 7
CLASSES = 10
K_POSITIVES = 5
K_NEGATIVES = 5
LOW, HIGH = 80, 100

#: Centroids of anchor clusters, fitted on this many sampled anchors at most.
CENTROIDS = 256
#: Anchors of one cluster part.
MEMBERS = 64
#: Anchors of one task (whole parts).
ANCHORS_PER_TASK = 512
#: Vector cells of one candidate shard (8 MB of int64).
SHARD_CELLS = 1 << 20
#: Candidates of the shared list scored at once by all members of a part.
STEP = 512

WAVE_COLUMNS = (
    ["anchor_rk", "anchor_vid", "anchor_vnull", "positive_rk", "positive_vid", "positive_vnull", "positive_score"],
    ["anchor_rk", "anchor_vid", "anchor_vnull", "positive_rk", "positive_vid", "positive_vnull", "positive_score",
     "negative_vid", "negative_vnull", "negative_score"],
)


def _schema(wave: int) -> str:
    return ", ".join(f"{c} {'boolean' if c.endswith('null') else 'long'}" for c in WAVE_COLUMNS[wave - 1])


def _id(prefix: str) -> F.Column:
    return F.when(~F.col(f"{prefix}_vnull"), F.col(f"{prefix}_vid")).alias(f"{prefix}_id")


def _valid(embeddings: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    label = F.when(F.col("vec_id") % SHIFT_EVERY == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label"))
    return rows.select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), F.col("embedding"))


def quantize(vectors: list, width: int) -> np.ndarray:
    """``floor(256 x)`` of each vector, padded to ``width``: int64, or Python ints if large."""
    out = np.zeros((len(vectors), width), dtype=np.float64)
    for i, v in enumerate(vectors):
        if v is not None and len(v):
            out[i, : len(v)] = np.floor(SCALE * np.asarray(v, dtype=np.float64))
    top = float(np.abs(out).max()) if out.size else 0.0
    if top * top * max(width, 1) < 2.0**62:
        return out.astype(np.int64)
    return np.array([[int(x) for x in row] for row in out], dtype=object).reshape(out.shape)


def _bounds(x: np.ndarray, centroid: np.ndarray, theta: float) -> np.ndarray:
    """Upper bound of ``a.x / |a|`` for every member a of a part."""
    xf = x.astype(np.float64)
    norms = np.sqrt((xf * xf).sum(axis=1))
    cos = np.divide(xf @ centroid, norms, out=np.ones(len(x)), where=norms > 0)
    phi = np.arccos(np.clip(cos, -1.0, 1.0))
    return norms * np.cos(np.clip(phi - theta, 0.0, math.pi))


def _order(scores: list, ids: np.ndarray, missing: np.ndarray) -> list[int]:
    """Positions by score descending, then vec_id ascending with missing ids last."""
    return sorted(range(len(scores)), key=lambda k: (-scores[k], bool(missing[k]), int(ids[k])))


def _product(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact integer scores ``x @ a.T``: by float64 BLAS where every partial sum is an integer
    below 2^53, else in Python integers."""
    if x.dtype != object and a.dtype != object:
        top = float(np.abs(x).max(initial=0)) * float(np.abs(a).max(initial=0)) * max(x.shape[1], 1)
        if top < 2.0**53:
            return x.astype(np.float64) @ a.astype(np.float64).T
    return x.astype(object) @ a.astype(object).T


def _best(top: np.ndarray, block: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest values per column of ``top`` and ``block`` together, descending."""
    both = np.concatenate((top, block), axis=0)
    return -np.sort(-both, axis=0)[:k] if both.dtype != object else np.array([sorted(c, reverse=True)[:k] for c in both.T], dtype=object).T


class _Shard:
    def __init__(self, frame: pd.DataFrame, width: int):
        self.rk = frame["rk"].to_numpy(np.int64)
        self.ids = frame["vid"].to_numpy(np.int64)
        self.missing = frame["vnull"].to_numpy(bool)
        self.label = frame["label"].to_numpy(np.int64)
        self.x = quantize(frame["embedding"].tolist(), width)


def _walk(shard: _Shard, a: np.ndarray, lists: np.ndarray, bound: np.ndarray, update, need) -> tuple[np.ndarray, np.ndarray]:
    """All members of a part walk the shared list together, one matrix product per step. A
    member is done once ``|a|`` times the next bound (plus a margin for rounding) is below
    ``need()``; as bounds only fall and needs only rise, it stays done. Returns the walked
    positions of the list and, per member, how far it walked."""
    norms = np.sqrt((a.astype(np.float64) ** 2).sum(axis=1))
    reach = np.zeros(len(a), dtype=np.int64)
    done = np.zeros(len(a), dtype=bool)
    scores = []
    for start in range(0, len(lists), STEP):
        top = norms * bound[lists[start]]
        done |= top + np.abs(top) * 1e-9 + 1.0 < need()
        if done.all():
            break
        idx = lists[start : start + STEP]
        block = _product(shard.x[idx], a)
        update(idx, block)
        scores.append(block)
        reach[~done] = start + len(idx)
    walked = int(reach.max(initial=0))
    return (np.concatenate(scores, axis=0) if scores else np.zeros((0, len(a)))), reach[:, None] > np.arange(walked)[None, :]


def _tasks(width: int, wave: int):
    def run(anchors: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if anchors.empty or cands.empty:
            return _frame(out, wave)
        shard = _Shard(cands, width)
        for _, part in anchors.groupby("part", sort=False):
            centroid = np.asarray(part["centroid"].iloc[0], dtype=np.float64)
            bound = _bounds(shard.x, centroid, float(part["theta"].iloc[0]))
            lists = np.argsort(-bound, kind="stable")
            out.extend((_positives if wave == 1 else _negatives)(shard, part, quantize(part["embedding"].tolist(), width), lists, bound))
        return _frame(out, wave)

    return run


def _frame(out: list[tuple], wave: int) -> pd.DataFrame:
    columns = WAVE_COLUMNS[wave - 1]
    frame = pd.DataFrame(out, columns=columns)
    for c in columns:
        frame[c] = frame[c].astype(bool) if c.endswith("null") else frame[c].astype(np.int64)
    return frame


def _positives(shard: _Shard, part: pd.DataFrame, a: np.ndarray, lists: np.ndarray, bound: np.ndarray) -> list[tuple]:
    label, rk = part["label"].to_numpy(np.int64), part["rk"].to_numpy(np.int64)
    top = np.full((K_POSITIVES, len(part)), -np.inf)

    def same(idx: np.ndarray) -> np.ndarray:
        return (shard.label[idx][:, None] == label[None, :]) & (shard.rk[idx][:, None] != rk[None, :])

    def update(idx: np.ndarray, block: np.ndarray) -> None:
        nonlocal top
        top = _best(top, np.where(same(idx), block, -np.inf), K_POSITIVES)

    scores, walked = _walk(shard, a, lists, bound, update, lambda: top[-1].astype(np.float64))
    idx = lists[: len(scores)]
    hit = same(idx) & walked.T & (scores >= top[-1][None, :])
    out = []
    for m, row in enumerate(part.itertuples(index=False)):
        at = np.flatnonzero(hit[:, m])
        found = [int(v) for v in scores[at, m]]
        rows = idx[at]
        for k in _order(found, shard.ids[rows], shard.missing[rows])[:K_POSITIVES]:
            r = rows[k]
            out.append((row.rk, row.vid, row.vnull, int(shard.rk[r]), int(shard.ids[r]), bool(shard.missing[r]), found[k]))
    return out


def _negatives(shard: _Shard, part: pd.DataFrame, a: np.ndarray, lists: np.ndarray, bound: np.ndarray) -> list[tuple]:
    label = part["label"].to_numpy(np.int64)
    given = [list(p) for p in part["positives"]]
    slots = max((len(p) for p in given), default=0)
    ps = np.full((slots, len(part)), np.nan)
    for m, p in enumerate(given):
        for k, q in enumerate(p):
            ps[k, m] = float(q["score"])
    exact_ps = [[int(q["score"]) for q in p] for p in given]
    floors = np.where(ps >= 0, np.ceil(LOW * np.where(np.isnan(ps), 0, ps) / HIGH), np.inf)
    tops = [np.full((K_NEGATIVES, len(part)), -np.inf) for _ in range(slots)]

    def qualifies(idx: np.ndarray, block: np.ndarray, k: int) -> np.ndarray:
        other = shard.label[idx][:, None] != label[None, :]
        with np.errstate(invalid="ignore"):
            return other & (LOW * ps[k][None, :] <= HIGH * block) & (block <= ps[k][None, :])

    def update(idx: np.ndarray, block: np.ndarray) -> None:
        for k in range(slots):
            tops[k] = _best(tops[k], np.where(qualifies(idx, block, k), block, -np.inf), K_NEGATIVES)

    def need() -> np.ndarray:
        t = np.full(len(part), np.inf)
        for k in range(slots):
            t = np.minimum(t, np.where(np.isfinite(tops[k][-1].astype(np.float64)), tops[k][-1].astype(np.float64), floors[k]))
        return t

    if not slots:
        return []
    scores, walked = _walk(shard, a, lists, bound, update, need)
    idx = lists[: len(scores)]
    out = []
    for k in range(slots):
        least = np.where(np.isfinite(tops[k][-1].astype(np.float64)), tops[k][-1].astype(np.float64), floors[k])
        hit = qualifies(idx, scores, k) & walked.T & (scores >= least[None, :])
        for m, row in enumerate(part.itertuples(index=False)):
            if k >= len(given[m]):
                continue
            p = given[m][k]
            if exact_ps[m][k] != ps[k, m]:  # beyond float precision: check the exact bounds again
                hit[:, m] &= np.array([LOW * exact_ps[m][k] <= HIGH * int(v) <= HIGH * exact_ps[m][k] for v in scores[:, m]], dtype=bool)
            at = np.flatnonzero(hit[:, m])
            found = [int(v) for v in scores[at, m]]
            rows = idx[at]
            for j in _order(found, shard.ids[rows], shard.missing[rows])[:K_NEGATIVES]:
                r = rows[j]
                out.append((row.rk, row.vid, row.vnull, p["rk"], p["vid"], p["vnull"], exact_ps[m][k], int(shard.ids[r]), bool(shard.missing[r]), found[j]))
    return out


def _centroids(anchors: DataFrame, width: int) -> np.ndarray:
    sample = anchors.orderBy(F.xxhash64("rk")).limit(CENTROIDS).select("embedding").collect()
    x = quantize([r["embedding"] for r in sample], width).astype(np.float64)
    norms = np.sqrt((x * x).sum(axis=1))
    x = x[norms > 0] / norms[norms > 0][:, None]
    if not len(x):
        x = np.eye(1, max(width, 1))
    return x


def _assign(centroids: np.ndarray, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = quantize(batch["embedding"].tolist(), width).astype(np.float64)
            norms = np.sqrt((x * x).sum(axis=1))
            cos = np.divide(x @ centroids.T, norms[:, None], out=np.ones((len(x), len(centroids))), where=norms[:, None] > 0)
            best = cos.argmax(axis=1)
            theta = np.where(norms > 0, np.arccos(np.clip(cos[np.arange(len(x)), best], -1.0, 1.0)), 0.0)
            yield pd.DataFrame({"rk": batch["rk"], "cluster": best.astype(np.int64), "theta": theta})

    return run


def mine_hard_negatives(embeddings: DataFrame) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    spark = embeddings.sparkSession
    rows = materialize(
        _valid(embeddings).withColumn("rk", F.monotonically_increasing_id())
        .withColumn("vid", F.coalesce("vec_id", F.lit(0))).withColumn("vnull", F.col("vec_id").isNull()),
        "negatives-rows",
    )
    stats = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("w")).first()
    n, width = stats["n"], int(stats["w"] or 0)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], empty)
    anchors = rows.where(F.col("vec_id") % ANCHOR_EVERY == 0)
    centroids = _centroids(anchors, width)
    placed = anchors.select("rk", "embedding").mapInPandas(_assign(centroids, width), "rk long, cluster long, theta double")
    sizes = placed.groupBy("cluster").count()
    placed = placed.join(F.broadcast(sizes), "cluster")  # one row per centroid: at most CENTROIDS
    placed = placed.withColumn("part", F.col("cluster") * 1_000_000 + F.pmod(F.xxhash64("rk"), F.ceil(F.col("count") / MEMBERS)))
    widest = placed.groupBy("part").agg(F.max("theta").alias("theta"))
    placed = materialize(placed.select("rk", "cluster", "part").join(widest, "part"), "negatives-parts")
    n_anchors = placed.count()
    shards = max(1, -(-n // max(1, SHARD_CELLS // max(width, 1))))
    blocks = max(1, -(-n_anchors // ANCHORS_PER_TASK))
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cluster long, centroid array<double>")
    members = anchors.join(placed, "rk").join(F.broadcast(table), "cluster")  # centroids: at most CENTROIDS rows
    members = members.withColumn("block", F.pmod(F.xxhash64("part"), F.lit(blocks)))
    cands = rows.select(*[F.col(c).alias(c) for c in ("rk", "vid", "vnull", "label", "embedding")]).withColumn("shard", F.pmod(F.xxhash64("rk"), F.lit(shards)))
    cands = cands.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    keys = ["shard", "block"]

    def spread(frame: DataFrame) -> DataFrame:
        return frame.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))

    one = spread(members.select("rk", "vid", "vnull", "label", "embedding", "part", "theta", "centroid", "block"))
    local = one.groupBy(*keys).cogroup(cands.groupBy(*keys)).applyInPandas(_tasks(width, 1), _schema(1))
    order = [F.col("positive_score").desc(), F.col("positive_vnull").asc(), F.col("positive_vid").asc()]
    best = local.withColumn("r", F.row_number().over(Window.partitionBy("anchor_rk").orderBy(*order))).where(F.col("r") <= K_POSITIVES)
    best = materialize(best, "negatives-positives")
    lists = best.groupBy("anchor_rk").agg(
        F.collect_list(F.struct(
            F.col("positive_rk").alias("rk"), F.col("positive_vid").alias("vid"), F.col("positive_vnull").alias("vnull"), F.col("positive_score").alias("score")
        )).alias("positives")
    )
    two = spread(members.join(lists.withColumnRenamed("anchor_rk", "rk"), "rk").select(
        "rk", "vid", "vnull", "label", "embedding", "part", "theta", "centroid", "block", "positives"))
    found = two.groupBy(*keys).cogroup(cands.groupBy(*keys)).applyInPandas(_tasks(width, 2), _schema(2))
    order = [F.col("negative_score").desc(), F.col("negative_vnull").asc(), F.col("negative_vid").asc()]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_rk", "positive_rk").orderBy(*order)))
    return ranked.where(F.col("rank") <= K_NEGATIVES).select(
        _id("anchor"), _id("positive"), F.col("rank").cast("int"), _id("negative"), "positive_score", "negative_score"
    )


def oracle() -> str:
    q = f"list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT))"
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS rk, vec_id,
         CASE WHEN vec_id % {SHIFT_EVERY} = 0 THEN (label + 1) % {CLASSES} ELSE label END AS label, {q} AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
),
a AS (SELECT * FROM v WHERE vec_id % {ANCHOR_EVERY} = 0),
s AS (
  SELECT a.rk AS ark, a.vec_id AS anchor_id, a.label AS alabel, c.rk, c.vec_id, c.label,
         list_sum(list_transform(range(1, least(len(a.e), len(c.e)) + 1), lambda i: a.e[i] * c.e[i])) AS score
  FROM a, v AS c
),
p AS (
  SELECT * FROM (
    SELECT ark, anchor_id, rk AS prk, vec_id AS positive_id, coalesce(score, 0) AS positive_score,
           row_number() OVER (PARTITION BY ark ORDER BY coalesce(score, 0) DESC, vec_id ASC NULLS LAST) AS r
    FROM s WHERE label = alabel AND rk <> ark
  ) WHERE r <= {K_POSITIVES}
),
n AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, coalesce(s.score, 0) AS negative_score,
         row_number() OVER (PARTITION BY p.ark, p.prk ORDER BY coalesce(s.score, 0) DESC, s.vec_id ASC NULLS LAST) AS rank
  FROM p JOIN s ON s.ark = p.ark AND s.label <> s.alabel
  WHERE {LOW} * p.positive_score <= {HIGH} * coalesce(s.score, 0) AND {HIGH} * coalesce(s.score, 0) <= {HIGH} * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id,
       CAST(positive_score AS BIGINT) AS positive_score, CAST(negative_score AS BIGINT) AS negative_score
FROM n WHERE rank <= {K_NEGATIVES}
"""
