"""Exact cosine top-k of many profiles against many jobs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocara.functions.vectors import SIM_DECIMALS
from vocara.session import materialize

# Vectors of profiles that are shipped to the tasks at a time, in bytes.
BLOCK_BYTES = 32 * 1024 * 1024
# Jobs and profiles scored at a time, to bound the score matrix.
JOB_STRIPE = 10_000
PROFILE_STRIPE = 512
# Jobs that bound the k-th best similarity of each profile before all jobs are scored.
SAMPLE_JOBS = 4_096
# More than rounding to SIM_DECIMALS can move a score.
EDGE_SLACK = 2 * 10.0**-SIM_DECIMALS

HITS = "cv_id bigint, content_hash string, similarity double"


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Stacked vectors scaled to length one; all-zero vectors stay zero."""
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _prefixes(hashes: np.ndarray) -> np.ndarray:
    """The first eight bytes of each string as a number of the same order."""
    heads = np.array([h[:8].encode()[:8] for h in hashes], dtype="S8")
    return np.frombuffer(heads.tobytes(), dtype=">u8").astype(np.uint64)


def _cut(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k hits of each profile (by ``row``): similarity down, then content hash up."""
    rows, scores, heads = (hits[c].to_numpy() for c in ("row", "similarity", "head"))
    order = np.lexsort((heads, -scores, rows))
    rows, scores, heads = rows[order], scores[order], heads[order]
    same = (rows[1:] == rows[:-1]) & (scores[1:] == scores[:-1]) & (heads[1:] == heads[:-1])
    if same.any():  # the numbers leave ties, which the whole strings decide
        order = hits.reset_index(drop=True).sort_values(["row", "similarity", "content_hash"], ascending=[True, False, True]).index.to_numpy()
        rows = hits["row"].to_numpy()[order]
    firsts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(rows)) - np.repeat(firsts, np.diff(np.r_[firsts, len(rows)]))
    return hits.iloc[order[place < k]]


class _Stripe:
    """The best k hits of one stripe of profiles. Scores are screened in single precision, and only
    those that can still win are computed in double precision and kept until the next cut."""

    def __init__(self, cv_ids: np.ndarray, profiles: np.ndarray, k: int, bounds: np.ndarray) -> None:
        self.cv_ids, self.profiles, self.k = cv_ids, profiles, k
        self.coarse, self.edge = profiles.astype(np.float32), bounds.copy()
        # More than single precision can move a score of unit vectors.
        self.slack = EDGE_SLACK + (profiles.shape[1] + 8) * 2.0**-22
        self.held: list[pd.DataFrame] = []
        self.size = 0

    def add(self, hashes: np.ndarray, heads: np.ndarray, jobs: np.ndarray, coarse: np.ndarray) -> None:
        scores = self.coarse @ coarse.T
        if len(hashes) > self.k and np.isneginf(self.edge).any():
            open_rows = np.flatnonzero(np.isneginf(self.edge))
            at = len(hashes) - self.k
            self.edge[open_rows] = np.partition(scores[open_rows], at, axis=1)[:, at] - self.slack
        least = np.nextafter((self.edge - self.slack).astype(np.float32), np.float32(-np.inf))
        found = np.flatnonzero(scores >= least[:, None])
        step = max(self.k * PROFILE_STRIPE, 1)  # as many as a cut may leave
        for start in range(0, len(found), step):
            rows, cols = np.divmod(found[start : start + step], len(hashes))
            similarity = np.round(np.einsum("ij,ij->i", self.profiles[rows], jobs[cols]), SIM_DECIMALS)
            near = similarity >= self.edge[rows] - EDGE_SLACK
            rows, cols, similarity = rows[near], cols[near], similarity[near]
            self.held.append(pd.DataFrame({"row": rows, "content_hash": hashes[cols], "similarity": similarity, "head": heads[cols]}))
            self.size += len(rows)
            if self.size >= step:
                self.cut()

    def cut(self) -> pd.DataFrame:
        best = _cut(pd.concat(self.held, ignore_index=True), self.k) if self.held else None
        if best is None:
            return pd.DataFrame({"row": [], "content_hash": [], "similarity": []})
        self.held, self.size = [best], 0
        counts, rows = np.bincount(best["row"], minlength=len(self.cv_ids)), best["row"].to_numpy()
        last = np.full(len(self.cv_ids), np.inf)
        np.minimum.at(last, rows, best["similarity"].to_numpy())
        self.edge = np.where(counts >= self.k, np.maximum(self.edge, last), self.edge)
        return best

    def best(self) -> pd.DataFrame:
        best = self.cut()
        return pd.DataFrame({"cv_id": self.cv_ids[best["row"].to_numpy(dtype=np.int64)], "content_hash": best["content_hash"].to_numpy(), "similarity": best["similarity"].to_numpy()})


def _units(column: pd.Series | pa.Array) -> np.ndarray:
    """:func:`unit_rows` of a column of vectors; of an Arrow column without a Python object per row."""
    if not isinstance(column, pa.Array):
        return unit_rows(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = len(values) // max(1, len(column))
    if column.null_count or set(np.unique(column.value_lengths().to_numpy(zero_copy_only=False))) - {width}:
        raise ValueError("all vectors must have the same width")
    matrix = values.reshape(len(column), width)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _best_hits(
    batches: Iterator[pd.DataFrame | pa.RecordBatch], cv_ids: np.ndarray, profiles: np.ndarray, k: int, bounds: np.ndarray | None = None
) -> list[pd.DataFrame]:
    """Best k of all batches of jobs for each profile, by stripes of profiles; holds at most two
    cuts of k rows per profile, and sorts those of one stripe of profiles at a time. ``bounds`` are
    similarities that k jobs of each profile are known to reach."""
    bounds = np.full(len(cv_ids), -np.inf) if bounds is None else bounds
    cuts = [slice(first, first + PROFILE_STRIPE) for first in range(0, len(cv_ids), PROFILE_STRIPE)]
    stripes = [_Stripe(cv_ids[c], profiles[c], k, bounds[c]) for c in cuts]
    for batch in batches:
        every = np.asarray(batch["content_hash"].to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch["content_hash"].to_numpy(), dtype=object)
        for start in range(0, len(every), JOB_STRIPE):
            hashes = every[start : start + JOB_STRIPE]
            jobs = _units(batch["vector"][start : start + JOB_STRIPE])
            heads, coarse = _prefixes(hashes), jobs.astype(np.float32)
            for stripe in stripes:
                stripe.add(hashes, heads, jobs, coarse)
    return [stripe.best() for stripe in stripes]


def _bounded(profiles: DataFrame, sample: DataFrame, k: int) -> DataFrame:
    """Profiles with ``bound``: a similarity that at least k of the sampled jobs reach, so that no job
    below it is among the best k. Null where the sample is too small."""
    local = sample.toPandas()
    if len(local) < max(k, 1):
        return profiles.withColumn("bound", F.lit(None).cast("double"))
    units = unit_rows(local["vector"])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PROFILE_STRIPE):
                part = batch.slice(start, PROFILE_STRIPE)
                scores = _units(part["cv_vector"]) @ units.T
                at = scores.shape[1] - k
                least = np.round(np.partition(scores, at, axis=1)[:, at], SIM_DECIMALS)
                yield pa.RecordBatch.from_arrays([part["cv_id"], part["cv_vector"], pa.array(least)], ["cv_id", "cv_vector", "bound"])

    types = dict(profiles.dtypes)
    return profiles.select("cv_id", "cv_vector").mapInArrow(bound, f"cv_id {types['cv_id']}, cv_vector {types['cv_vector']}, bound double")


def _block_hits(jobs: DataFrame, profiles: DataFrame, sample: DataFrame, k: int) -> DataFrame | None:
    """The best k jobs of each profile of one block, stored; jobs are scored where they are read."""
    local = _bounded(profiles, sample, k).toPandas()
    if local.empty:
        return None
    context = jobs.sparkSession.sparkContext
    bounds = np.nan_to_num(local["bound"].to_numpy(dtype=np.float64), nan=-np.inf)
    shipped = context.broadcast((local["cv_id"].to_numpy(), unit_rows(local["cv_vector"]), bounds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cv_ids, units, least = shipped.value
        for hits in _best_hits(batches, cv_ids, units, k, least):
            if hits.empty:  # no job of this task can be among the best
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hits["cv_id"].to_numpy(), type=pa.int64(), from_pandas=True),
                    pa.array(hits["content_hash"].to_numpy(), type=pa.string(), from_pandas=True),
                    pa.array(hits["similarity"].to_numpy(dtype=np.float64)),
                ],
                ["cv_id", "content_hash", "similarity"],
            )

    order = Window.partitionBy("cv_id").orderBy(F.desc("similarity"), "content_hash")
    ranked = jobs.mapInArrow(score, HITS).withColumn("sim_rank", F.row_number().over(order))
    hits = materialize(ranked.filter(F.col("sim_rank") <= k), "hits")
    shipped.destroy()
    return hits


def knn_topk(jobs: DataFrame, profiles: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k most similar jobs of every profile: ``cv_id, content_hash, similarity, sim_rank``.

    ``jobs`` holds one row per content hash, already filtered. Profiles go in blocks of bounded
    size to the tasks that read the jobs, so no vector is shuffled and no pair leaves its task:
    each hands on at most k rows per profile. Ties are broken by content hash. Jobs are read once
    per block; hand over a stored table, not a costly plan.
    """
    slim = jobs.select("content_hash", "vector")
    queries = profiles.select("cv_id", "cv_vector")
    width = F.coalesce(F.sum(F.size("cv_vector").cast("bigint")), F.lit(0))
    blocks = max(1, -(-queries.agg(width).first()[0] * 8 // block_bytes))
    block = lambda i: queries.filter(F.pmod(F.xxhash64("cv_id"), F.lit(blocks)) == i)
    # The k-th best of some jobs is a bound for the k-th best of all; any jobs give a right one.
    sample = materialize(slim.orderBy(F.xxhash64("content_hash"), "content_hash").limit(SAMPLE_JOBS), "sample-jobs")
    found = [hits for i in range(blocks) if (hits := _block_hits(slim, block(i), sample, k)) is not None]
    if not found:
        return jobs.sparkSession.createDataFrame([], f"{HITS}, sim_rank int")
    return reduce(DataFrame.unionByName, found)
