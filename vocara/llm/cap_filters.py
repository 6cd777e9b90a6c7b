"""Embedding near-duplicates: vectors with a cosine of 0.95 or more, found by spherical caps.

Method: random directions, each the concatenation of one codeword per block of coordinates (a
structured product code under a random rotation), are filters. A vector is list-decoded to all
filters whose inner product exceeds a bound: scores of two half-codes are sorted and only sums
that can exceed it are formed, so the directions are never enumerated. Vectors that share a
filter meet and every meeting is verified by the cosine in double precision.

* Equal vectors collapse first into one class with a weight, before anything is shuffled by
  filter. A filter that holds many classes is cut into chunks that meet in tiles.
* A pair can share many filters; it is counted at the smallest one. A tile leaves a count and a
  root per member, no pairs; components follow from the roots.
* The number of directions grows with the number of vectors, so the number of tiles per vector
  is the same at every size. Caps of a larger code are narrower and a pair shares fewer of them,
  so filters per vector follow from the wanted recall: ``choose_filters`` plants partners at the
  threshold beside a sample of at most ``SAMPLE`` rows and takes the least number with which the
  code in use brings ``RECALL`` of them together. A vector that exceeds fewer than half of that
  number gets its best ones up to half, so no vector goes without a chance.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing and stand alone; vectors of different widths are never compared; repeated rows of one
vec_id are vectors of their own (their component is that of the id); rows without a vec_id are
left out; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from vocara.llm.common import materialize
from vocara.llm.components import components
from vocara.llm.tiles import CHUNK, roots, symmetric

THRESHOLD = 0.95
BLOCKS = 4
#: Share of pairs at the threshold that meet in a filter; pairs above it meet more often.
RECALL = 0.999
#: Filters per vector on average, and at least: the first numbers tried.
FILTERS = 24
LEAST = 12
#: Unrelated members of a filter on average with ``FILTERS`` per vector.
OCCUPANCY = 32
SAMPLE = 512
#: Planted pairs, and the chance that a code of less recall passes on them.
PLANTED = 8192
DOUBT = 0.05
SEED = 71


@lru_cache(maxsize=8)
def product_code(width: int, words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rotation, codewords of each block); a block has unit codewords scaled to a unit direction."""
    rng = np.random.default_rng(SEED + width)
    padded = -(-width // BLOCKS) * BLOCKS
    rotation = np.linalg.qr(rng.standard_normal((padded, padded)))[0][:width]
    code = rng.standard_normal((BLOCKS, words, padded // BLOCKS))
    code /= np.linalg.norm(code, axis=2, keepdims=True) * math.sqrt(BLOCKS)
    return rotation, list(code)


def halves(vectors: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all pairs of codewords in the first and in the second two blocks."""
    rotation, code = product_code(vectors.shape[1], words)
    parts = np.split(vectors @ rotation, BLOCKS, axis=1)
    score = [part @ words_of.T for part, words_of in zip(parts, code, strict=True)]
    pair = lambda a, b: (a[:, :, None] + b[:, None, :]).reshape(len(a), -1)
    return pair(score[0], score[1]), pair(score[2], score[3])


def decode(first: np.ndarray, second: np.ndarray, bound: float, least: int) -> np.ndarray:
    """Filters of one vector: all with a score over ``bound``, or the best ``least``."""
    order = np.argsort(second)
    ordered = second[order]
    while True:
        heads = np.flatnonzero(first + ordered[-1] > bound)
        count = len(ordered) - np.searchsorted(ordered, bound - first[heads], side="right")
        if count.sum() >= min(least, first.size * second.size):
            break
        bound -= 0.02
    total = int(count.sum())
    head = np.repeat(heads, count)
    rank = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    tail = order[len(ordered) - 1 - rank]
    return head.astype(np.int64) * second.size + tail


def code_words(n: int) -> int:
    """Codewords a block for ``n`` vectors."""
    return max(4, math.ceil((FILTERS * n / OCCUPANCY) ** (1 / BLOCKS)))


def fit_bound(sample: np.ndarray, words: int, filters: int = FILTERS) -> float:
    """The bound at which sample vectors exceed ``filters`` filters on average."""
    first, second = halves(sample, words)
    second = np.sort(second, axis=1)
    low, high = -1.0, 1.0
    for _ in range(24):
        middle = (low + high) / 2
        count = 0
        for a, b in zip(first, second, strict=True):
            heads = a[a + b[-1] > middle]
            count += len(b) * len(heads) - np.searchsorted(b, middle - heads, side="right").sum()
            if count > filters * len(first):
                break
        low, high = (middle, high) if count > filters * len(first) else (low, middle)
    return high


def planted(sample: np.ndarray, cosine: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of the sample, partner at that cosine in a random direction) of ``count`` pairs."""
    rng = np.random.default_rng(SEED)
    row = np.arange(count) % len(sample)
    x = sample[row]
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    length = np.linalg.norm(side, axis=1, keepdims=True)
    side = np.divide(side, length, out=np.zeros_like(side), where=length > 0)
    partner = cosine * x + math.sqrt(1 - cosine * cosine) * side
    return row, partner / np.linalg.norm(partner, axis=1, keepdims=True)


def missed(sample: np.ndarray, cosine: float, words: int, bound: float, least: int, count: int, most: int) -> int:
    """How many of ``count`` planted pairs share no filter; counting ends beyond ``most``."""
    row, partner = planted(sample, cosine, count)
    lists = lambda x: [decode(a, b, bound, least) for a, b in zip(*halves(x, words), strict=True)]
    own = [x for at in range(0, len(sample), 256) for x in lists(sample[at : at + 256])]
    lost = 0
    for at in range(0, count, 256):
        lost += sum(not np.isin(own[row[at + i]], x).any() for i, x in enumerate(lists(partner[at : at + 256])))
        if lost > most:
            break
    return lost


def choose_filters(sample: np.ndarray, words: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[float, int]:
    """(bound, least filters of a vector) with which pairs at the threshold meet with probability
    ``recall``: the first number of filters at which so few planted pairs are lost that a smaller
    recall would lose as few with a chance of ``DOUBT`` at most."""
    expected = PLANTED * (1 - recall)
    term = chance = math.exp(-expected)
    most = 0
    while chance + term * expected / (most + 1) <= DOUBT:
        most += 1
        term *= expected / most
        chance += term
    filters, every = FILTERS, words**BLOCKS
    while filters < every:
        bound = fit_bound(sample, words, filters)
        if missed(sample, threshold, words, bound, filters * LEAST // FILTERS, PLANTED, most) <= most:
            return bound, filters * LEAST // FILTERS
        filters = math.ceil(filters * 1.25)
    return -math.inf, every  # every filter


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decoder(codes: dict[int, tuple[int, float, int, int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                rows = batch.iloc[at : at + 500]
                for width, frame in rows.groupby(rows["embedding"].map(len)):
                    words, bound, least, start = codes[width]
                    first, second = halves(_unit(frame["embedding"]), words)
                    lists = [decode(a, b, bound, least) + start for a, b in zip(first, second, strict=True)]
                    yield pd.DataFrame({"rep": frame["rep"], "copies": frame["copies"], "embedding": frame["embedding"], "filters": [np.sort(x) for x in lists]})

    return run


def verify_tile(ids, weights, unit, filters, here: int, side, crossed: bool, threshold: float):
    """(vectors linked to each member whose smallest common filter is this one, root of each)."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    a, b = (left, right) if crossed else (left, left)
    linked = unit[a] @ unit[b].T >= threshold
    links, root = np.zeros(len(ids), dtype=np.int64), ids.copy()
    if not crossed:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return links, root
    met = np.zeros(len(ids), dtype=bool)
    met[a], met[b] = met[a] | linked.any(axis=1), met[b] | linked.any(axis=0)
    lower = [f[f < here] if m else f[:0] for f, m in zip(filters, met, strict=True)]
    owner = np.repeat(np.arange(len(lower)), [len(x) for x in lower])
    _, column = np.unique(np.concatenate(lower), return_inverse=True) if len(owner) else (None, np.zeros(0, dtype=np.int64))
    where = np.zeros(len(ids), dtype=np.int64)
    where[left], where[right] = np.arange(len(left)), np.arange(len(right))
    earlier = np.zeros(linked.shape, dtype=np.float32)
    if len(column):
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for first in range(0, int(column[-1]) + 1, 4096):
            lo, hi = np.searchsorted(column, (first, first + 4096))
            block = [np.zeros((len(x), 4096), dtype=np.float32) for x in ((a, b) if crossed else (a,))]
            for s, matrix in enumerate(block):
                mine = side[owner[lo:hi]] == s
                matrix[where[owner[lo:hi][mine]], column[lo:hi][mine] - first] = 1
            earlier += block[0] @ block[-1].T
    counted = linked & (earlier == 0)
    if crossed:
        linked, counted, members = symmetric(linked), symmetric(counted), np.concatenate((left, right))
    else:
        members = left
    links[members] = counted @ weights[members]
    root[members] = roots(linked, ids[members])
    return links, root


def _tile(threshold: float):
    def one(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["rep"].to_numpy(np.int64)
        links, root = verify_tile(
            ids,
            frame["copies"].to_numpy(np.int64),
            _unit(frame["embedding"]),
            list(frame["filters"]),
            int(frame["filter"].iloc[0]),
            frame["side"].to_numpy(np.int64),
            bool(frame["crossed"].iloc[0]),
            threshold,
        )
        keep = (links > 0) | (root != ids)
        return pd.DataFrame({"rep": ids[keep], "links": links[keep], "root": root[keep]})

    return one


def usable(vector) -> object:
    """True for vectors that can take part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def cap_filter_join(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``."""
    # floats travel as they are, half as wide as doubles
    kind = "array<float>" if embeddings.schema["embedding"].dataType == ArrayType(FloatType()) else "array<double>"
    vectors = embeddings.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    vectors = vectors.withColumn("key", F.when(F.coalesce(usable(F.col("embedding")), F.lit(False)), F.sha2(F.to_json("embedding"), 256)))
    keyed = materialize(vectors, "vectors")
    classes = materialize(
        keyed.where("key is not null")
        .groupBy("key")
        .agg(F.min(F.struct("vec_id", "embedding")).alias("first"), F.count("*").alias("copies"))
        .select("key", "copies", F.col("first.vec_id").alias("rep"), "first.embedding"),
        "classes",
    )
    codes, total = _fit(classes, threshold)
    number = "int" if total < 1 << 31 else "long"
    decoded = materialize(
        classes.select("rep", "copies", "embedding").mapInPandas(_decoder(codes), f"rep long, copies long, embedding {kind}, filters array<{number}>"), "decoded"
    )
    met = decoded.select(F.explode("filters").alias("filter")).groupBy("filter").agg(F.count("*").alias("members")).where("members > 1")
    met = materialize(met.withColumn("chunks", F.ceil(F.col("members") / CHUNK).cast("int")), "filters")
    placed = decoded.select("rep", "copies", "embedding", "filters", F.posexplode("filters").alias("at", "filter"))
    # a tile asks for smaller filters alone
    placed = placed.withColumn("filters", F.slice("filters", F.lit(1), F.col("at"))).join(met, "filter")
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("rep"), "chunks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.select(
        "rep",
        "copies",
        "embedding",
        "filters",
        "filter",
        F.least("mine", "other").alias("a"),
        F.greatest("mine", "other").alias("b"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"),
        (F.col("mine") != F.col("other")).alias("crossed"),
    )
    found = materialize(placed.groupBy("filter", "a", "b").applyInPandas(_tile(threshold), "rep long, links long, root long"), "found")
    joined = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    result = (
        classes.select("key", "rep", "copies")
        .join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
        .join(joined.withColumnRenamed("id", "rep"), "rep", "left")
        .select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    return (
        keyed.select("vec_id", "key")
        .join(materialize(result, "classes"), "key", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
            (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
        )
    )


def _fit(classes: DataFrame, threshold: float) -> tuple[dict[int, tuple[int, float, int, int]], int]:
    """Per width: codewords a block, the bound, the least filters of a vector, the number of its
    first filter; and the number of filters. Widths are few; the sample is bounded."""
    codes, total = {}, 0
    for row in classes.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).orderBy("width").collect():
        words = code_words(row["n"])
        rows = classes.where(F.size("embedding") == row["width"]).orderBy("key").limit(SAMPLE).select("embedding").toPandas()
        codes[row["width"]] = (words, *choose_filters(_unit(rows["embedding"]), words, threshold), total)
        total += words**BLOCKS
    return codes, total


def oracle(threshold: float = THRESHOLD) -> str:
    """The same rows in SQL, by the cosine of every pair and reachability."""
    return f"""with recursive v as (select vec_id, embedding::double[] as x from embeddings where vec_id is not null and len(embedding) > 0
 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) where list_cosine_similarity(a.x, b.x) >= {threshold}),
r as (select a as id, b as other from p union select r.id, p.b from r join p on p.a = r.other),
c as (select id, min(other) as least from r group by 1), n as (select a as id, count(*) as links from p group by 1)
select e.vec_id, coalesce(n.links, 0)::bigint as n_links, least(e.vec_id, c.least) as component_id, e.vec_id = least(e.vec_id, c.least) as kept
from embeddings e left join n on n.id = e.vec_id left join c on c.id = e.vec_id where e.vec_id is not null"""
