"""N-gram Jaccard join: documents whose sets of word 5-grams overlap by 0.8 or more.

Method: MinHash signatures cut into bands; documents that agree in a whole band meet, and
every pair that can meet is verified on the full n-gram sets. Rows per band and bands are
derived from the wanted recall at the threshold.

1. One pass over the texts gives each document a digest of its whole set and its band hashes.
   Documents of one digest have the same set and form a class, represented by its smallest id.
2. Classes shuffle on the band hash. A band holds each class once; only (class, smallest class
   of the band) leaves it, so a hot band costs one row per member.
3. Components of these links bound where similar pairs can be. Inside a component, members are
   split by set size (sets whose sizes differ by more than the threshold cannot be similar) and
   hashed into chunks of bounded content; chunks meet in tiles. A tile intersects full sets by
   matrix products over the n-grams they share, and reports counts, never pairs.

A word is a maximal run without white space, lower case. Cases: a null or empty text has no
words and is linked with nothing; a text of one to four words is one n-gram of all its words;
repeated rows count as documents of their own and share a class; rows without a doc_id are
left out; other columns are ignored. An empty table gives an empty result. Two n-grams count
as equal when their 64-bit hashes are.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocara.llm.common import materialize, mix64, packed, per_row
from vocara.llm.components import components
from vocara.llm.tiles import CHUNK, roots, symmetric

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
MOST_HASHES = 256
#: n-grams in a chunk, on average at most.
CHUNK_GRAMS = 400_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band, so the fewest false meetings, with which ``most``
    hash functions still bring a pair at the threshold together with probability ``recall``."""
    best = (most, 1)
    for rows in range(1, 33):
        agree = threshold**rows
        bands = 1 if agree >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - agree))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a whole text."""
    parts = (text or "").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(" ".join(parts).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(data)), out=total[1:])
    gaps = np.flatnonzero(data == 32)
    start = np.concatenate(([0], gaps + 1))
    end = np.concatenate((gaps, [len(data)]))
    word = mix64((total[end] - total[start]) * _power("down", _INVERSE, len(data) + 1)[start])
    n = min(words, len(word))
    gram = np.zeros(len(word) - n + 1, dtype=np.uint64)
    for i in range(n):
        gram = gram * np.uint64(0xD1342543DE82EF95) + word[i : len(word) - n + 1 + i]
    return np.unique(mix64(gram + np.uint64(n)))


def signature(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band."""
    rng = np.random.default_rng(20240)
    slope = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shift = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    least = np.full(bands * rows, 0xFFFFFFFF, dtype=np.uint32)
    low = (grams >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(least, ((low[at : at + 1024, None] ^ shift) * slope).min(axis=0), out=least)
    out = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        out = mix64(out + column.astype(np.uint64))
    return out


def _signed(words: int, bands: int, rows: int):
    def one(doc_id, text_hash, text):
        grams = shingles(text, words)
        if not len(grams):
            return [(doc_id, text_hash, None, 0, None)]
        key = hashlib.blake2b(grams.tobytes(), digest_size=16).hexdigest()
        return [(doc_id, text_hash, key, len(grams), signature(grams, bands, rows).view(np.int64))]

    return one


def verify_tile(ids: np.ndarray, weights: np.ndarray, sets: list[np.ndarray], side: np.ndarray, crossed: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(documents linked to each member, root of each member). A crossed tile counts left-right
    pairs alone."""
    size = np.array([len(s) for s in sets], dtype=np.int32)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    owner = np.repeat(np.arange(len(sets)), size)
    gram, place, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[place] > 1
    column = np.cumsum(seen > 1) - 1
    order = np.argsort(column[place[shared]], kind="stable")
    owner, column = owner[shared][order], column[place[shared]][order]
    a, b = (left, right) if crossed else (left, left)
    where = np.zeros(len(sets), dtype=np.int64)
    where[left] = np.arange(len(left))
    where[right] = np.arange(len(right))
    common = np.zeros((len(a), len(b)), dtype=np.float32)  # exact: a chunk holds far fewer than 2^24 n-grams
    step = 1024
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, (first, first + step))
        block = [np.zeros((len(x), step), dtype=np.float32) for x in ((a, b) if crossed else (a,))]
        for s, matrix in enumerate(block):
            mine = side[owner[lo:hi]] == s
            matrix[where[owner[lo:hi][mine]], column[lo:hi][mine] - first] = 1
        common += block[0] @ block[-1].T
    exact = common.astype(np.int32)
    del common
    limit = Fraction(str(threshold))
    union = size[a][:, None] + size[b][None, :] - exact
    linked = exact.astype(np.int64) * limit.denominator >= limit.numerator * union.astype(np.int64)
    del exact, union
    links, root = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
    if crossed:
        # each side counts the other's weights; no square matrix of both sides is cast to integers
        links[left] = linked.astype(np.int32) @ weights[right]
        links[right] = linked.T.astype(np.int32) @ weights[left]
        members = np.concatenate((left, right))
        root[members] = roots(symmetric(linked), ids[members])
    else:
        np.fill_diagonal(linked, False)
        links[left] = linked.astype(np.int32) @ weights[left]
        root[left] = roots(linked, ids[left])
    return links, root


def _tile(words: int, threshold: float):
    def one(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["rep"].to_numpy(np.int64)
        links, root = verify_tile(
            ids,
            frame["copies"].to_numpy(np.int64),
            [shingles(t, words) for t in frame["text"]],
            frame["side"].to_numpy(np.int64),
            bool(frame["crossed"].iloc[0]),
            threshold,
        )
        return pd.DataFrame({"rep": ids, "links": links, "root": root})

    return one


def ngram_jaccard_join(
    documents: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (smallest doc_id with the same n-gram set),
    ``n_links`` (other documents linked directly, copies included), ``component_id`` (smallest
    doc_id reachable by links)."""
    bands, rows = choose_bands(threshold, recall)
    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    signed = materialize(
        texts.mapInPandas(
            per_row(_signed(words, bands, rows), ["doc_id", "text_hash", "key", "n", "bands"]),
            "doc_id long, text_hash long, key string, n int, bands array<long>",
        ),
        "signed",
    )
    count = signed.count()
    classes = (
        signed.where("key is not null")
        .groupBy("key")
        .agg(F.min(F.struct("doc_id", "text_hash", "n", "bands")).alias("first"), F.count("*").alias("copies"))
        .select("key", "copies", F.col("first.doc_id").alias("rep"), "first.text_hash", "first.n", "first.bands")
    )
    classes = materialize(packed(classes, count), "classes")
    banded = classes.select("rep", F.explode("bands").alias("band"))
    met = banded.groupBy("band").agg(F.min("rep").alias("least"), F.count("*").alias("members")).where("members > 1")
    meetings = banded.join(materialize(packed(met.select("band", "least"), count * bands), "bands"), "band").where("rep <> least")
    group = materialize(packed(components(meetings.select(F.col("rep").alias("u"), F.col("least").alias("v")), count * bands), count), "groups")
    members = (
        classes.select("rep", "text_hash", "copies", "n")
        .join(group.withColumnRenamed("id", "rep"), "rep")
        .withColumn("sizes", F.floor(F.log(F.col("n")) / F.lit(math.log(1 / threshold) * 1.000001)).cast("int"))
    )
    members = materialize(packed(members, count), "members")
    tiles = _tiled(members, count)
    # the same plan at every size: a broadcast of the members would end where they outgrow it
    wanted = members.select("rep", "text_hash").hint("merge")
    held = texts.select(F.col("doc_id").alias("rep"), "text_hash", "text").join(wanted, ["rep", "text_hash"], "left_semi")
    pieces = tiles.join(held.dropDuplicates(["rep", "text_hash"]), ["rep", "text_hash"])
    found = materialize(
        pieces.select("tile", "rep", "copies", "side", "crossed", "text").groupBy("tile").applyInPandas(_tile(words, threshold), "rep long, links long, root long"),
        "found",
    )
    joined = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), found.count())
    result = (
        classes.select("key", "rep", "copies")
        .join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
        .join(joined.withColumnRenamed("id", "rep"), "rep", "left")
        .select(
            "key",
            F.col("rep").alias("class_id"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    return (
        signed.select("doc_id", "key")
        .join(materialize(packed(result, count), "classes"), "key", "left")
        .select(
            "doc_id",
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "doc_id").alias("component_id"),
        )
    )


def _tiled(members: DataFrame, count: int) -> DataFrame:
    """``(tile, side, ...)`` rows of at most ``count`` members. Chunks per (component, size class) follow from totals per
    component, of which there are as many entries as size classes, about a hundred at most."""
    totals = members.groupBy("component", "sizes").agg(F.sum("n").alias("grams"), F.count("*").alias("rows"))
    totals = totals.withColumn("chunks", F.greatest(F.ceil(F.col("grams") / CHUNK_GRAMS), F.ceil(F.col("rows") / CHUNK)).cast("int"))
    plan = totals.groupBy("component").agg(
        F.map_from_entries(F.collect_list(F.struct("sizes", "chunks"))).alias("plan"),
        F.sum("grams").alias("grams"),
        F.sum("rows").alias("rows"),
    )
    placed = members.join(materialize(packed(plan, count), "plan"), "component")
    small = (F.col("grams") <= CHUNK_GRAMS) & (F.col("rows") <= CHUNK)
    chunks = lambda shift: F.coalesce(F.try_element_at("plan", F.col("sizes") + shift), F.lit(0))
    mine = F.pmod(F.xxhash64("rep"), chunks(0)).cast("int")
    name = lambda low, a, b, high: F.concat_ws(":", F.col("component"), low, a, high, b)
    own = F.col("sizes")
    inside = F.transform(
        F.sequence(F.lit(0), chunks(0) - 1),
        lambda x: F.struct(name(own, F.least(F.col("mine"), x), F.greatest(F.col("mine"), x), own).alias("tile"), (F.col("mine") > x).cast("int").alias("side"), (F.col("mine") != x).alias("crossed")),
    )
    empty = F.array().cast("array<struct<tile:string,side:int,crossed:boolean>>")
    above = F.when(
        chunks(1) > 0,
        F.transform(F.sequence(F.lit(0), chunks(1) - 1), lambda y: F.struct(name(own, F.col("mine"), y, own + 1).alias("tile"), F.lit(0).alias("side"), F.lit(True).alias("crossed"))),
    ).otherwise(empty)
    below = F.when(
        chunks(-1) > 0,
        F.transform(F.sequence(F.lit(0), chunks(-1) - 1), lambda y: F.struct(name(own - 1, y, F.col("mine"), own).alias("tile"), F.lit(1).alias("side"), F.lit(True).alias("crossed"))),
    ).otherwise(empty)
    whole = F.array(F.struct(F.col("component").cast("string").alias("tile"), F.lit(0).alias("side"), F.lit(False).alias("crossed")))
    cut = F.concat(inside, above, below)
    return (
        placed.withColumn("mine", mine)
        .withColumn("at", F.explode(F.when(small, whole).otherwise(cut)))
        .select("rep", "text_hash", "copies", "at.tile", "at.side", "at.crossed")
    )
