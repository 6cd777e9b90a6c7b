"""Packing documents into as few token sequences as possible: minimum bin slack.

Every document becomes its ids and an end id; longer ones are cut into pieces of the full
length, the first of which may be shorter. Packing looks at lengths only: there are at most
``CAPACITY`` different ones, so however many pieces there are, their histogram is a table of
that bound. Per bin, a dynamic program over a bitset of reachable sums, starting from the
longest length left, finds the fullest feasible combination; it is then removed, at once as
often as the histogram allows. So the number of combinations depends on the lengths, not on the
number of pieces: each one exhausts at least one length, or leaves less of it than one bin used.

Pieces take their places by rank within their length: combinations own ranges of ranks. Ranks
are counted per slice of the document hash and offset by totals, so a length that a third of
all pieces share is spread over tasks.

Ids are those of the ``tokenizers`` file: its vocabulary also comes as ranks for a faster
library, which encodes the text between special strings; texts with very long words use the
file itself. Cases: a null or empty text is the end id alone; special strings in a text are
special ids; rows without a doc_id are left out; repeated rows are packed each; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocara.llm.common import materialize

CAPACITY = 1024
END = 2
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Characters a word may average before the text goes to the slower, linear encoder.
LONG_WORDS = 200
SLICES = 64


@lru_cache(maxsize=1)
def _fast(folder: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(os.path.join(folder, "byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _exact(folder: str):
    """The linear encoder, loaded only by a worker that meets a text of very long words."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(os.path.join(folder, "byte_bpe_50k.json"))


def token_ids(text: str | None, folder: str) -> np.ndarray:
    """Ids of a whole text with the end id, as unsigned 32-bit little-endian."""
    text = text or ""
    if len(text) > LONG_WORDS * (text.count(" ") + text.count("\n") + 1):
        ids = _exact(folder).encode(text, add_special_tokens=False).ids
    else:
        fast = _fast(folder)
        ids = []
        for i, part in enumerate(text.split(SPECIAL)):
            if i:
                ids.append(SPECIAL_ID)
            if part:
                ids.extend(fast.encode_ordinary(part))
    return np.array([*ids, END], dtype="<u4")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))] if n > capacity else [(0, n)]


def _pieces(folder: str, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = token_ids(text, folder)
                out.extend((doc_id, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(ids), capacity)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination that holds the longest length left: length -> how many."""
    longest = max(counts)
    room = capacity - longest
    mask = (1 << (room + 1)) - 1
    steps, reach = [], 1
    for length in sorted(counts, reverse=True):
        spare = counts[length] - (length == longest)
        if length > room or spare <= 0:
            continue
        take, left = 1, min(spare, room // length)
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen = {longest: 1}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(how often, length -> how many) of the combinations that use up the histogram."""
    counts = {length: n for length, n in histogram.items() if n > 0}
    plan = []
    while counts:
        chosen = fullest(counts, capacity)
        times = min(counts[length] // n for length, n in chosen.items())
        plan.append((times, chosen))
        for length, n in chosen.items():
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
    return plan


def _places(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Ranges of ranks per length, sorted: which combination owns them and where they stand in it."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for times, chosen in plan:
        at = 0
        for length, n in chosen.items():
            first = taken.get(length, 0)
            rows.append((length, first, n, base, at))
            taken[length] = first + n * times
            at += length * n
        base += times
    rows.sort()
    return {k: np.array(v, dtype=np.int64) for k, v in zip(("length", "first", "each", "base", "at"), zip(*rows, strict=True), strict=True)} if rows else {}


def _placed(places: dict[str, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide = np.int64(1) << 44
        keys = places["length"] * wide + places["first"]
        for batch in batches:
            rank = batch["rank"].to_numpy(np.int64)
            length = batch["length"].to_numpy(np.int64)
            i = np.searchsorted(keys, length * wide + rank, side="right") - 1
            inside = rank - places["first"][i]
            out = batch.drop(columns=["rank"])
            out["sequence_id"] = places["base"][i] + inside // places["each"][i]
            out["offset"] = places["at"][i] + inside % places["each"][i] * length
            yield out

    return run


def pack(documents: DataFrame, folder: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    ``folder`` holds the vocabulary files; by default that of the installed package."""
    if folder is None:
        import public_tokenizers

        folder = public_tokenizers.path("")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialize(texts.mapInPandas(_pieces(folder, capacity), schema), "pieces")
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SLICES)).cast("int"))
    totals = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = materialize(totals.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))), "lengths")
    histogram = {row["length"]: row["n"] for row in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(minimum_bin_slack(histogram, capacity))
    order = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = sliced.withColumn("within", F.row_number().over(order) - 1).join(F.broadcast(totals.drop("n")), ["length", "slice"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).alias("rank"))
    return ranked.mapInPandas(_placed(places), f"{schema}, sequence_id long, offset long")
