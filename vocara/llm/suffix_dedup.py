"""Suffix-array de-duplication of long repeated byte strings with a run-length index.

Every byte covered by a ``length``-byte string that also starts anywhere else is removed.
Method: a run-compressed Burrows-Wheeler transform with text positions sampled at the ends of
its runs. Neighbours in suffix order whose preceding symbols differ sit at run ends, so their
common prefixes are measured there and only there; streaming over the text, every other
position inherits its matching statistic from the last sampled one, minus the distance. Where
the statistic reaches ``length``, a long match starts.

How this is spread over Spark, exactly and without a corpus-wide suffix array:

1. Each text picks anchors: the 32-byte string with the least hash in each window of ``length``
   bytes. Equal windows have equal anchors at equal places, so the windows of one anchor place
   (a segment: those windows' bytes, less than ``2 * length``) can match only windows of the
   same anchor string. Every window belongs to one segment.
2. Anchor strings that occur once are done. Of the others, equal segments collapse into one with
   a count before any bytes move: a segment counted twice is repeated as a whole. Only anchors
   with several different segments need the index.
3. Segments are dealt by anchor to tasks of bounded size; each builds the index of its segments
   and streams their matching statistics.
4. An anchor with more than ``HOT`` different segments (a passage that a third of the rows
   share, each in another context) is split: its windows are dealt by their offset to the anchor
   in slots of 32, then 4, then 1, keyed by the bytes all windows of the slot share. Windows
   that reach out of the common passage lose their company at each step; at slots of one window
   equal keys are equal strings, so no group is left that grows with the data.
5. Marks return to the documents through the counts of step 2; each document is cut once.

Cases: a null text is empty; an empty or short text keeps all its bytes; a lone surrogate counts
as its three bytes; rows without a doc_id are left out; repeated rows of a doc_id are texts of
their own in the search (so identical long ones remove each other) and give one row each; other
columns are ignored; an empty table gives an empty result. Strings are told apart by 64-bit
hashes where they collapse and byte by byte in the index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocara.llm.common import materialize, mix64

LENGTH = 200
GRAM = 32
#: Different segments of one anchor that one task may hold.
HOT = 512
SLOTS = (32, 4, 1)
#: Segments of a task, on average.
TASK_SEGMENTS = 2048

_BASE = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 22


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at each position, by doubling."""
    h = data.astype(np.uint64)
    width, factor = 1, int(_BASE)
    while width < GRAM:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = factor * factor % (1 << 64)
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of ``width``: prefix minima of one block meet suffix minima of
    the block before."""
    n = len(key)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = key
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor position, anchor hash) of each segment."""
    width = length - GRAM + 1
    parts = []
    last = len(data) - length + 1
    for at in range(0, max(last, 0), _PIECE):
        piece = data[at : min(len(data), at + _PIECE + length - 1)]
        h = _gram_hashes(piece)
        key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        place = (_sliding_least(key, width) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        count = np.diff(np.concatenate((first, [len(place)])))
        parts.append((first + at, count, place[first] + at, h[place[first]].view(np.int64)))
    if not parts:
        return (np.zeros(0, dtype=np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


_INVERSE = pow(int(_BASE), -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        factor = np.full(max(n, 1 << 17), base, dtype=np.uint64)
        factor[0] = 1
        have = np.multiply.accumulate(factor)
        if n <= 1 << 20:
            _powers[base] = have
    return have[:n]


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each range, equal for equal ranges anywhere."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(int(_BASE), len(data)), out=total[1:])
    back = _power(_INVERSE, len(data) + 1)[start]
    return mix64(mix64((total[end] - total[start]) * back) + (end - start).astype(np.uint64)).view(np.int64)


# --- the index -------------------------------------------------------------------------------


def suffix_array(symbols: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Suffix order of a text of segments; ``end[i]`` is the end of position i's segment, where
    its suffix stops. Equal suffixes stand in text order. Ranks of seven symbols, nine bits each,
    are joined three at a time, so the sorted depth triples."""
    n = len(symbols)
    key = np.zeros(n, dtype=np.int64)
    at = np.arange(n)
    for i in range(7):
        there = at + i < end
        key <<= 9
        key[there] += symbols[at[there] + i] + 1
    order = np.argsort(key)
    depth = 7
    longest = int((end - at).max())
    parts = 3 if n < (1 << 21) - 1 else 2
    while True:
        sorted_key = key[order]
        fresh = np.concatenate(([0], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(fresh)
        if fresh.sum() == n - 1:
            return order
        if depth >= longest:
            return np.argsort(rank * n + at)
        key = rank.copy()
        for i in range(1, parts):
            key *= n + 1
            there = np.flatnonzero(at + i * depth < end)
            key[there] += rank[there + i * depth] + 1
        order = np.argsort(key)
        depth *= parts


class RunLengthIndex:
    """Run-compressed transform of a set of segments: symbol and length of each run, and the text
    positions at both of its ends. The suffix array itself is dropped."""

    def __init__(self, segments: list[bytes]):
        length = np.array([len(s) for s in segments], dtype=np.int64)
        self.start = np.cumsum(length) - length
        self.symbols = np.frombuffer(b"".join(segments), dtype=np.uint8).astype(np.int64)
        self.end = np.repeat(self.start + length, length)
        suffixes = suffix_array(self.symbols, self.end)
        before = self.symbols[suffixes - 1]
        opening = np.zeros(len(self.symbols), dtype=bool)
        opening[self.start] = True
        opening = opening[suffixes]
        new = np.ones(len(suffixes), dtype=bool)
        new[1:] = (before[1:] != before[:-1]) | opening[1:] | opening[:-1]
        head = np.flatnonzero(new)
        tail = np.concatenate((head[1:], [len(suffixes)])) - 1
        self.run_symbol = np.where(opening[head], -1, before[head])
        self.run_length = tail - head + 1
        self.head_position, self.tail_position = suffixes[head], suffixes[tail]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, within their segments."""
        limit = np.minimum(self.end[a] - a, self.end[b] - b)
        out = np.zeros(len(a), dtype=np.int64)
        live = np.flatnonzero(limit > 0)
        step = 32
        reach = np.arange(step)
        padded = np.concatenate((self.symbols, np.full(step, -1))).astype(np.int16)
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            same = padded[x[:, None] + reach] == padded[y[:, None] + reach]
            run = np.where(same.all(axis=1), step, same.argmin(axis=1))
            out[live] = np.minimum(out[live] + run, limit[live])
            live = live[(run == step) & (out[live] < limit[live])]
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest match that starts there and also starts elsewhere."""
        upper = self._stream(self.head_position[1:], self.tail_position[:-1])
        lower = self._stream(self.tail_position[:-1], self.head_position[1:])
        return np.maximum(upper, lower)

    def _stream(self, sampled: np.ndarray, neighbour: np.ndarray) -> np.ndarray:
        n = len(self.symbols)
        value = np.full(n, -1, dtype=np.int64)
        value[sampled] = self._common(sampled, neighbour)
        source = np.where(value >= 0, np.arange(n), -1)
        source = np.maximum.accumulate(source)
        stat = np.where(source >= 0, value[source] - (np.arange(n) - source), 0)
        return np.clip(stat, 0, self.end - np.arange(n))


def runs_of(flags: np.ndarray) -> list[int]:
    """[start, end, start, end, ...] of the true runs."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)), axis=1).ravel().tolist()


def mark(segments: list[bytes], length: int = LENGTH) -> list[list[int]]:
    """Runs of windows of each segment that also start elsewhere among the segments."""
    index = RunLengthIndex(segments)
    long = index.matching_statistics() >= length
    return [runs_of(long[s : s + len(x) - length + 1]) for s, x in zip(index.start, segments, strict=True)]


# --- the passes ------------------------------------------------------------------------------


_SEGMENT = ["anchor", "whole", "copies", "offset", "windows", "kinds"]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.iloc[at : at + 500]
            yield pd.DataFrame({"row": part["row"], "doc_id": part["doc_id"], "packed": [packer.compress(_bytes(t)) for t in part["text"]]})


def _scan(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held = [], 0
            for row, text in zip(batch["row"], batch["text"], strict=True):
                data = np.frombuffer(_bytes(text), dtype=np.uint8)
                if len(data) < length:
                    continue
                first, count, place, h = anchors(data, length)
                whole = range_hashes(data, first, first + count + length - 1)
                out.append({"row": np.full(len(first), row), "first": first, "windows": count, "offset": place - first, "anchor": h, "whole": whole})
                held += len(first)
                if held > 100_000:
                    yield pd.DataFrame({k: np.concatenate([x[k] for x in out]) for k in out[0]})
                    out, held = [], 0
            if out:
                yield pd.DataFrame({k: np.concatenate([x[k] for x in out]) for k in out[0]})

    return run


def _fetch(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted")
            fields = wanted.flatten()
            edges = wanted.offsets.to_numpy() - wanted.offsets[0].as_py()
            first, windows = (fields.field(fields.type.get_field_index(c)).to_numpy() for c in ("first", "windows"))
            ends = first + windows + length - 1
            for row in range(len(batch)):
                data = zstandard.ZstdDecompressor().decompress(batch.column("packed")[row].as_py())
                low, high = edges[row], edges[row + 1]
                pieces = [data[a:b] for a, b in zip(first[low:high].tolist(), ends[low:high].tolist(), strict=True)]
                part = fields.slice(low, high - low)
                columns = [part.field(part.type.get_field_index(c)) for c in ("anchor", "whole", "copies", "offset", "windows", "kinds")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pieces, pa.binary())], names=[*_SEGMENT, "bytes"])

    return run


def _split(slot: int, length: int):
    """Cuts segments by the offset of their windows; ``anchor`` becomes the hash of the shared bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for anchor, whole, copies, offset, windows, data in zip(
                batch["anchor"], batch["whole"], batch["copies"], batch["offset"], batch["windows"], batch["bytes"], strict=True
            ):
                array = np.frombuffer(data, dtype=np.uint8)
                steps = (offset - np.arange(windows)) // slot
                start = np.flatnonzero(np.concatenate(([True], steps[1:] != steps[:-1])))
                end = np.concatenate((start[1:], [windows]))
                # what every window of the slot covers, wherever this segment begins or ends
                core = range_hashes(array, offset - steps[start] * slot, offset - (steps[start] + 1) * slot + 1 + length)
                name = mix64(core.view(np.uint64) + mix64((steps[start] + 512 * slot).astype(np.uint64) ^ np.uint64(anchor & 0xFFFFFFFFFFFFFFFF))).view(np.int64)
                full = range_hashes(array, start, end + length - 1)
                for i in range(len(start)):
                    out.append((anchor, whole, int(start[i]), int(name[i]), int(full[i]), copies, int(offset - start[i]), int(end[i] - start[i]), data[start[i] : end[i] + length - 1]))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=_SPLIT_COLUMNS)
                    out = []
            yield pd.DataFrame(out, columns=_SPLIT_COLUMNS)

    return run


_SPLIT_COLUMNS = ["up_anchor", "up_whole", "shift", "anchor", "whole", "copies", "offset", "windows", "bytes"]
_SPLIT_TYPES = "up_anchor long, up_whole long, shift int, anchor long, whole long, copies long, offset int, windows int, bytes binary"


def accompanied(anchor: np.ndarray, offset: np.ndarray, segments: list[bytes], length: int) -> np.ndarray:
    """Segments whose bytes on one side of the anchor also stand at that side of it in another.
    A window has its anchor and at least half of the rest on one side, so others match nothing."""
    half = (length - GRAM) // 2
    size = np.array([len(s) for s in segments], dtype=np.int64)
    place = np.cumsum(size) - size + offset
    data = np.frombuffer(b"".join(segments), dtype=np.uint8)
    out = np.zeros(len(segments), dtype=bool)
    for there, low in ((offset >= half, place - half), (size - offset - GRAM >= half, place + GRAM)):
        rows = np.flatnonzero(there)
        key = mix64(range_hashes(data, low[rows], low[rows] + half).view(np.uint64) + mix64(anchor[rows].view(np.uint64)))
        _, name, count = np.unique(key, return_inverse=True, return_counts=True)
        out[rows] |= count[name] > 1
    return out


def _index(length: int):
    def one(frame: pd.DataFrame) -> pd.DataFrame:
        whole = frame["copies"].to_numpy() > 1
        marks = [[0, w] if c else [] for w, c in zip(frame["windows"].tolist(), whole, strict=True)]
        segments = frame["bytes"].tolist()
        kept = np.flatnonzero(accompanied(frame["anchor"].to_numpy(np.int64), frame["offset"].to_numpy(np.int64), segments, length))
        if len(kept):
            for row, found in zip(kept, mark([segments[i] for i in kept], length), strict=True):
                marks[row] = marks[row] or found
        out = pd.DataFrame({"anchor": frame["anchor"], "whole": frame["whole"], "marks": marks})
        return out[out["marks"].map(len) > 0]

    return one


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("marks")
            places = lists.flatten()
            first, runs = places.field(0).to_numpy(), places.field(1)
            each = np.diff(runs.offsets.to_numpy())
            edges = np.concatenate(([0], np.cumsum(each)))
            position = runs.flatten().to_numpy().astype(np.int64) + np.repeat(first, each)
            owned = np.concatenate(([0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy())))
            out = []
            for row, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                data = kept = zstandard.ZstdDecompressor().decompress(batch.column("packed")[row].as_py())
                pairs = position[edges[owned[row]] : edges[owned[row + 1]]]
                gone = spans = 0
                if len(pairs):
                    n = len(data)
                    edge = np.bincount(pairs[0::2], minlength=n + 1) - np.bincount(pairs[1::2] + length - 1, minlength=n + 1)
                    removed = np.cumsum(edge[:-1]) > 0
                    gone = int(removed.sum())
                    spans = int(np.count_nonzero(removed[1:] & ~removed[:-1])) + int(removed[0])
                    kept = np.frombuffer(data, dtype=np.uint8)[~removed].tobytes()
                out.append((doc_id, len(data), gone, spans, hashlib.sha256(kept).hexdigest(), kept))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def _with_kinds(segments: DataFrame) -> DataFrame:
    """Segments that can repeat: ``kinds`` counts the different ones of their anchor."""
    groups = segments.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("copies").alias("all"))
    groups = materialize(groups.where("kinds > 1 or all > 1").select("anchor", "kinds"), "groups")
    return segments.join(groups, "anchor")


def _alone(segments: DataFrame) -> DataFrame:
    """Marks of segments without another of their anchor: they are repeated as a whole."""
    return segments.where("kinds = 1").select("anchor", "whole", F.array(F.lit(0), F.col("windows")).alias("marks"))


def _marks_of(segments: DataFrame, level: int, length: int) -> DataFrame:
    """``anchor, whole, marks`` of distinct segments that share their anchor with another."""
    last = level == len(SLOTS)
    hot = segments.where(F.col("kinds") > HOT)
    cold = segments if last else segments.where(F.col("kinds") <= HOT)
    tasks = max(1, -(-segments.count() // TASK_SEGMENTS))
    dealt = cold.select(F.pmod(F.xxhash64("anchor"), F.lit(tasks)).alias("task"), "anchor", "whole", "copies", "offset", "windows", "bytes")
    marked = materialize(dealt.groupBy("task").applyInPandas(_index(length), "anchor long, whole long, marks array<int>"), "marks")
    if last or hot.isEmpty():
        return marked
    pieces = materialize(hot.select("anchor", "whole", "copies", "offset", "windows", "bytes").mapInPandas(_split(SLOTS[level], length), _SPLIT_TYPES), "pieces")
    distinct = pieces.groupBy("anchor", "whole").agg(
        F.sum("copies").alias("copies"), F.first("offset").alias("offset"), F.first("windows").alias("windows"), F.first("bytes").alias("bytes")
    )
    distinct = materialize(_with_kinds(materialize(distinct, "segments")), "segments")
    below = _marks_of(distinct.where("kinds > 1"), level + 1, length).union(_alone(distinct))
    back = pieces.drop("bytes").join(materialize(below, "marks"), ["anchor", "whole"]).select(
        F.col("up_anchor").alias("anchor"), F.col("up_whole").alias("whole"), F.transform("marks", lambda x: x + F.col("shift")).alias("marks")
    )
    up = back.groupBy("anchor", "whole").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    return marked.union(materialize(up, "marks"))


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and the bytes
    that stay, ``kept``."""
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    found = materialize(
        texts.select("row", "text").mapInPandas(_scan(length), "row long, first int, windows int, offset int, anchor long, whole long"), "anchors"
    )
    again = materialize(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "repeated")
    repeated = materialize(found.join(again, "anchor"), "places")
    kinds = repeated.groupBy("anchor", "whole").agg(F.min(F.struct("row", "first", "offset", "windows")).alias("at"), F.count("*").alias("copies"))
    kinds = kinds.select("anchor", "whole", "copies", "at.*")
    kinds = materialize(_with_kinds(materialize(kinds, "kinds")), "kinds")
    packed = lambda: texts.mapInPandas(_packed, "row long, doc_id long, packed binary")
    wanted = kinds.where("kinds > 1").groupBy("row").agg(F.collect_list(F.struct("first", *_SEGMENT)).alias("wanted"))
    # the same plan at every size: a broadcast would end where its side outgrows it
    lone = packed().select("row", "packed").join(materialize(wanted, "wanted").hint("merge"), "row").dropDuplicates(["row"])
    segments = lone.mapInArrow(_fetch(length), "anchor long, whole long, copies long, offset int, windows int, kinds long, bytes binary")
    marks = materialize(_marks_of(materialize(segments, "fetched"), 0, length).union(_alone(kinds)), "marks")
    # equal rows of one table share a key, and so their marks; each then has them once
    placed = repeated.select("row", "first", "anchor", "whole").distinct().join(marks, ["anchor", "whole"])
    per_row = placed.groupBy("row").agg(F.collect_list(F.struct("first", "marks")).alias("marks"))
    cut = packed().join(materialize(per_row, "cuts").hint("merge"), "row", "left")
    return cut.select("doc_id", "packed", "marks").mapInArrow(
        _cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
