"""Exact top-k by inner product: ball trees per shard, branch and bound.

Candidates are hashed into shards of bounded size, queries into blocks of bounded size; a task
holds one shard and one block. Its tree splits vectors at the median of the widest spread; a
node knows its centre and radius, so q.c + |q| r bounds every score below it. Nodes are visited
in order of that bound, for all queries of the block at once, and a query leaves a subtree when
the bound is under its current k-th score. A first wave answers every block on one shard; the
k-th scores it finds start all other shards, so they prune from the first node on.

Scores are integer inner products of floor(scale * x); the arithmetic is exact, as doubles hold
integers up to 2^53. Vectors with a component over 2^20, or of more than ``WIDEST`` components,
are scored beside the tree in Python integers. Only what 64 bits cannot hold, a component or a
score, is an error, as it is in the SQL. Cases: vectors that are null, empty
or hold null or non-finite components take no part, nor do rows without an id; vectors of
another width than the query's are no candidates; repeated ids and repeated rows are rows of
their own: only the query's own row is left out of its candidates (rows are keyed when first
written), and every query row is answered; ties go to the smaller id; fewer candidates than k give
fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocara.llm.common import materialize

SHARD = 8192
BLOCK = 1024
LEAF = 128
MOST = 1 << 20
#: Components of a vector whose products, each up to MOST squared, still add up exactly.
WIDEST = 1 << 13


class BallTree:
    """Nodes in arrays; the rows of a node are ``order[low:high]``."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, keys: np.ndarray | None = None):
        self.order = np.arange(len(ids))
        self.vectors, self.ids = vectors, ids
        #: the rows' own keys, by which a query leaves out its own row (ids by default)
        self.keys = ids if keys is None else keys
        self.nodes: list[tuple[int, int, int, int]] = []
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self._grow(0, len(ids))
        self.centre, self.radius = np.array(self.centres), np.array(self.radii)

    def _grow(self, low: int, high: int) -> int:
        rows = self.vectors[self.order[low:high]]
        centre = rows.mean(axis=0)
        at = len(self.nodes)
        self.nodes.append((low, high, -1, -1))
        self.centres.append(centre)
        self.radii.append(float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max())) * (1 + 1e-9) + 1e-9)
        spread = rows.max(axis=0) - rows.min(axis=0)
        if high - low > LEAF and spread.max() > 0:
            middle = (high - low) // 2
            self.order[low:high] = self.order[low:high][np.argpartition(rows[:, spread.argmax()], middle)]
            self.nodes[at] = (low, high, self._grow(low, low + middle), self._grow(low + middle, high))
        return at


class Best:
    """The k best (score, id) of each query so far, best first."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = floor

    def bound(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        score = np.concatenate((self.score[rows], score), axis=1)
        ids = np.concatenate((self.id[rows], np.broadcast_to(ids, (len(rows), len(ids)))), axis=1)
        best = np.lexsort((ids, -score), axis=1)[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, best, 1), np.take_along_axis(ids, best, 1)


def search(tree: BallTree, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> Best:
    """Branch and bound for a block of queries. The queue orders nodes by the largest bound any
    waiting query has on them."""
    best = Best(len(queries), k, floor)
    length = np.sqrt((queries**2).sum(axis=1))
    slack = 1e-6 * (1 + length)

    def bounds(node: int, rows: np.ndarray) -> np.ndarray:
        return queries[rows] @ tree.centre[node] + length[rows] * tree.radius[node] + slack[rows]

    rows = np.arange(len(queries))
    top = bounds(0, rows)
    queue = [(-float(top.max(initial=-np.inf)), 0, 0, rows, top)]
    count = 1
    while queue:
        _, _, node, rows, top = heapq.heappop(queue)
        rows = rows[top >= best.bound(rows)]
        if not len(rows):
            continue
        low, high, left, right = tree.nodes[node]
        if left < 0:
            for at in range(low, high, 4 * LEAF):
                members = tree.order[at : min(high, at + 4 * LEAF)]
                score = queries[rows] @ tree.vectors[members].T
                score[own[rows][:, None] == tree.keys[members][None, :]] = -np.inf
                hit = (score >= best.bound(rows)[:, None]).any(axis=1)
                if hit.any():
                    best.add(rows[hit], score[hit], tree.ids[members])
            continue
        for child in (left, right):
            top = bounds(child, rows)
            keep = top >= best.bound(rows)
            if keep.any():
                heapq.heappush(queue, (-float(top[keep].max()), count, child, rows[keep], top[keep]))
                count += 1
    return best


def exact(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, keys: np.ndarray | None = None) -> tuple[list[int], list[int], list[int]]:
    """(row of the query, id, score) of the k best of each query, in integers of any size; a
    candidate whose key (its id by default) is the query's ``own`` is left out."""
    keys = ids if keys is None else keys
    rows: list[int] = []
    found: list[int] = []
    scores: list[int] = []
    turned = x.astype(object).T
    for row in range(len(q)):
        score = q[row].astype(object) @ turned
        for negative, vec_id in heapq.nsmallest(k, ((-s, i) for s, i, key in zip(score, ids.tolist(), keys.tolist(), strict=True) if key != own[row])):
            rows.append(row)
            found.append(vec_id)
            scores.append(-negative)
    return rows, found, scores


def _large(x: np.ndarray) -> np.ndarray:
    """Rows that doubles cannot score exactly."""
    if (x == np.iinfo(np.int64).max).any() or (x == np.iinfo(np.int64).min).any():
        raise ValueError("a scaled component does not fit 64 bits")
    return (np.abs(x).max(axis=1) > MOST) | (x.shape[1] > WIDEST)


def _wave(k: int):
    def one(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        for width, block in queries.groupby(queries["q"].map(len)):
            mine = candidates[candidates["x"].map(len) == width]
            if not len(mine):
                continue
            x, q = np.stack(mine["x"].to_numpy()).astype(np.int64), np.stack(block["q"].to_numpy()).astype(np.int64)
            ids, keys = mine["vec_id"].to_numpy(np.int64), mine["rk"].to_numpy(np.int64)
            asker, line = block["query_id"].to_numpy(np.int64), block["line"].to_numpy(np.int64)
            own = line  # a query row's line is its key
            large, asks_large = _large(x), _large(q)
            small, rest = np.flatnonzero(~large), np.flatnonzero(~asks_large)
            if len(small) and len(rest):
                tree = BallTree(x[small].astype(np.float64), ids[small], keys[small])
                best = search(tree, q[rest].astype(np.float64), own[rest], block["floor"].to_numpy(np.float64)[rest], k)
                row, place = np.nonzero(best.score > -np.inf)
                found.append(
                    pd.DataFrame({"query_id": asker[rest][row], "line": line[rest][row], "vec_id": best.id[row, place], "score": best.score[row, place].astype(np.int64)})
                )
            for asked, against in ((rest, np.flatnonzero(large)), (np.flatnonzero(asks_large), np.arange(len(x)))):
                if len(asked) and len(against):
                    row, vec_id, score = exact(x[against], ids[against], q[asked], own[asked], k, keys[against])
                    found.append(
                        pd.DataFrame({"query_id": asker[asked][row], "line": line[asked][row], "vec_id": np.array(vec_id, dtype=np.int64), "score": np.array(score, dtype=np.int64)})
                    )
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "line": [], "vec_id": [], "score": []}, dtype=np.int64)

    return one


def ball_tree_top_k(embeddings: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row of ``embeddings`` where ``is_query`` holds."""
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = embeddings.where("vec_id is not null").where(F.coalesce(fine & (F.size("embedding") > 0), F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.cast("array<long>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = materialize(rows.withColumn("rk", F.monotonically_increasing_id()), "vectors")
    n, asking = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-asking // BLOCK))
    dealt = rows.withColumn("line", F.col("rk")).withColumn("shard", F.pmod(F.xxhash64("rk"), F.lit(shards)).cast("int"))
    questions = dealt.where("asks").select(
        F.col("vec_id").alias("query_id"), F.col("x").alias("q"), "line", F.pmod(F.xxhash64("line", F.lit(2)), F.lit(blocks)).cast("int").alias("block")
    )
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    def wave(candidates: DataFrame, asked: DataFrame, name: str) -> DataFrame:
        left = candidates.select("vec_id", "rk", "x", "shard", all_blocks.alias("block")).groupBy("shard", "block")
        right = asked.groupBy("shard", "block")
        return materialize(left.cogroup(right).applyInPandas(_wave(k), "query_id long, line long, vec_id long, score long"), name)

    first = wave(dealt.where("shard = 0"), questions.select("query_id", "q", "line", "block", F.lit(0).alias("shard"), F.lit(float("-inf")).alias("floor")), "wave")
    floor = first.groupBy("query_id", "line").agg(F.min("score").alias("low"), F.count("*").alias("n")).select("query_id", "line", F.when(F.col("n") >= k, F.col("low")).cast("double").alias("low"))
    found = first
    if shards > 1:
        shared = questions.join(floor, ["query_id", "line"], "left").select("query_id", "q", "line", "block", F.coalesce("low", F.lit(float("-inf"))).alias("floor"))
        rest = wave(dealt.where("shard > 0"), shared.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards - 1)))), "wave")
        found = first.union(rest)
    order = Window.partitionBy("query_id", "line").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(every: int = 50, k: int = 5, scale: int = 256) -> str:
    """The same rows in SQL, by all scores of each query."""
    return f"""with v as (select row_number() over () as rk, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * x::double) as bigint)) as x
 from embeddings where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.rk as qk, q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) as bigint) as score
 from v q join v c on c.rk <> q.rk and len(c.x) = len(q.x) where q.vec_id % {every} = 0)
select query_id, cast(row_number() over (partition by qk order by score desc, vec_id) as int) as rank, vec_id, score from s
qualify row_number() over (partition by qk order by score desc, vec_id) <= {k}"""
