"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

The test side is small and stated: its items are lower-cased (A-Z only), cut into words and into
windows of ``window`` consecutive words (an item of fewer words, but not none, is one window).
The distinct windows are counted on Spark first; a broadcast carries at most ``PER_PASS`` of them
(words as small integer ids, a sorted array of 64-bit polynomial hashes per window length, the
id matrix beside it and the items of each window). A larger test set is split by window hash
and the corpus is scanned once per part; hits of the parts are merged on Spark.

Each training text is scanned where it lies (``mapInArrow``: whole Arrow batches, no pandas, so
every other column passes through untouched): its words become ids (a word the test set lacks
can start no window), every window of every test length is hashed in numpy, looked up in the
sorted array and *verified* against the stored ids, so a hash collision never counts. Covered
words are merged into maximal runs, kept both as word and as code-point intervals, from which
spans are cut out or documents dropped.

Cases: a null or empty text has no words and no hits; a null test text has no windows; test
rows with a null id still count, under the item ''. Repeated rows give a row each; items that
share a window are all reported. Output columns replace input columns of the same name; other
columns, nulls included, pass through unchanged. An empty corpus gives an empty result, an empty
test set no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocara.llm.common import materialize

# Fixed values of the contract: the word pattern (after A-Z is lower-cased) and the window length.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10

#: Test windows per broadcast at most (about 60 bytes each on the executors); more go in parts.
PER_PASS = 1_000_000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD_RE = re.compile(WORD)

HIT = T.StructType([T.StructField(n, T.LongType()) for n in ("w0", "w1", "c0", "c1")])
ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hits", T.ArrayType(HIT)),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def lowered_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), 0)


def test_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct ``(key, items)``: ``key`` is a window's words joined by a blank, ``items`` its item ids."""
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), lowered_words(F.col("text")).alias("w"))
    n = F.size("w")
    windows = F.when(n >= window, F.expr(f"transform(sequence(0, size(w) - {window}), i -> slice(w, i + 1, {window}))")).when(n > 0, F.array("w"))
    cut = words.select("item", F.explode(windows).alias("win"))
    return cut.groupBy(F.array_join("win", " ").alias("key")).agg(F.array_sort(F.collect_set("item")).alias("items"))


def _hash(ids: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the rows of an ``(n, L)`` id matrix, wrapping in 64 bits."""
    h = np.zeros(len(ids), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ids.shape[1]):
            h = h * _MULT + (ids[:, j].astype(np.uint64) + np.uint64(1))
    return h


class WindowSet:
    """The broadcast part of the test set: ids, and per length sorted hashes, ids and items."""

    def __init__(self, rows: list[tuple[str, list[str]]]):
        self.vocab: dict[str, int] = {}
        grouped: dict[int, list[tuple[list[int], list[str]]]] = {}
        for key, items in rows:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in key.split(" ")]
            grouped.setdefault(len(ids), []).append((ids, items))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, list[list[str]]]] = {}
        for length, entries in grouped.items():
            ids = np.array([e[0] for e in entries], dtype=np.int64).reshape(len(entries), length)
            hashes = _hash(ids)
            order = np.argsort(hashes, kind="stable")
            self.by_length[length] = (hashes[order], ids[order], [entries[i][1] for i in order])

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, int, int]], list[str]]:
        """Words, merged hit runs ``(w0, w1, c0, c1)`` and the items met in one text."""
        if not text:
            return 0, [], []
        found = [(m.start(), m.end(), m.group()) for m in _WORD_RE.finditer(text.translate(_LOWER))]
        n = len(found)
        if not n or not self.by_length:
            return n, [], []
        ids = np.fromiter((self.vocab.get(w, -1) for _, _, w in found), dtype=np.int64, count=n)
        bad = np.concatenate(([0], np.cumsum(ids < 0)))
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        for length, (hashes, table, owners) in self.by_length.items():
            if n < length:
                continue
            starts = np.flatnonzero(bad[length:] == bad[: n - length + 1])
            if not len(starts):
                continue
            windows = ids[starts[:, None] + np.arange(length)]
            h = _hash(windows)
            lo = np.searchsorted(hashes, h, side="left")
            hi = np.searchsorted(hashes, h, side="right")
            for k in np.flatnonzero(hi > lo):
                for slot in range(lo[k], hi[k]):
                    if np.array_equal(table[slot], windows[k]):
                        runs.append((int(starts[k]), int(starts[k]) + length))
                        items.update(owners[slot])
        merged: list[list[int]] = []
        for a, b in sorted(runs):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        return n, [(a, b, found[a][0], found[b - 1][1]) for a, b in merged], sorted(items)


def _scanner(table, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: WindowSet = table.value
        hit_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("w0", "w1", "c0", "c1")]))
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            words, counts, hits, items = [], [], [], []
            for text in texts:
                n, runs, met = windows.scan(text)
                words.append(n)
                counts.append(sum(b - a for a, b, _, _ in runs))
                hits.append([dict(zip(("w0", "w1", "c0", "c1"), r, strict=True)) for r in runs])
                items.append(met)
            added = [pa.array(words, pa.int64()), pa.array(counts, pa.int64()), pa.array(hits, hit_type), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "n_words", "n_hit", "hits", "items"])

    return run


_MERGE = """aggregate(array_sort(hits), cast(array() as array<struct<w0:bigint,w1:bigint,c0:bigint,c1:bigint>>),
  (acc, x) -> case when size(acc) > 0 and x.w0 <= element_at(acc, -1).w1
    then concat(slice(acc, 1, size(acc) - 1), array(named_struct('w0', element_at(acc, -1).w0,
         'w1', greatest(element_at(acc, -1).w1, x.w1), 'c0', element_at(acc, -1).c0, 'c1', greatest(element_at(acc, -1).c1, x.c1))))
    else concat(acc, array(x)) end)"""


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, per_pass: int = PER_PASS) -> DataFrame:
    """Every document row with ``n_words``, ``n_hit`` (covered words), ``hits`` (maximal covered
    runs as word and code-point intervals, end exclusive) and ``items`` (test ids met, sorted)."""
    spark = documents.sparkSession
    docs = documents.drop(*[f.name for f in ADDED])
    keys = materialize(test_windows(benchmark, window), "test-windows")
    total = keys.count()
    parts = max(1, -(-total // per_pass))
    text_at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, *ADDED])
    if parts == 1:
        table = spark.sparkContext.broadcast(WindowSet([(r["key"], r["items"]) for r in keys.toLocalIterator()]))
        return docs.mapInArrow(_scanner(table, text_at), schema)
    keyed = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "decontam-rows")
    text_at = keyed.columns.index("text")
    scans = []
    for part in range(parts):
        mine = keys.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part)
        table = spark.sparkContext.broadcast(WindowSet([(r["key"], r["items"]) for r in mine.toLocalIterator()]))
        scans.append(materialize(keyed.select("_row", "text").mapInArrow(_scanner(table, 1), "_row long, text string, " + ", ".join(
            f"{f.name} {f.dataType.simpleString()}" for f in ADDED)).drop("text"), "decontam-part"))
    every = scans[0]
    for other in scans[1:]:
        every = every.unionByName(other)
    merged = every.groupBy("_row").agg(
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    ).withColumn("hits", F.expr(_MERGE))
    merged = merged.withColumn("n_hit", F.expr("aggregate(hits, 0L, (a, x) -> a + x.w1 - x.w0)"))
    return keyed.join(merged, "_row").select(*docs.columns, *[f.name for f in ADDED])


def _cut(text_at: int, hits_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hits = batch.column(text_at).to_pylist(), batch.column(hits_at).to_pylist()
            kept = []
            for text, runs in zip(texts, hits, strict=True):
                if text is None or not runs:
                    kept.append(text)
                    continue
                pieces, at = [], 0
                for r in runs:
                    pieces.append(text[at : r["c0"]])
                    at = r["c1"]
                kept.append("".join(pieces) + text[at:])
            columns = list(batch.columns)
            columns[text_at] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def decontaminate(documents: DataFrame, benchmark: DataFrame, mode: str = "spans", window: int = WINDOW) -> DataFrame:
    """The documents without contamination: ``mode='spans'`` cuts every covered run (from its
    first word's start to its last word's end) out of the text, ``mode='documents'`` drops every
    document with a hit. The input's columns come back, nothing else."""
    found = find_contamination(documents, benchmark, window)
    if mode == "documents":
        return found.where("n_hit = 0").select(*documents.columns)
    if mode != "spans":
        raise ValueError(f"mode is 'spans' or 'documents', not {mode!r}")
    cut = found.select(*documents.drop(*[f.name for f in ADDED]).columns, "hits")
    out = cut.mapInArrow(_cut(cut.columns.index("text"), cut.columns.index("hits")), cut.schema).drop("hits")
    return out.select(*[c for c in documents.columns if c in out.columns])


def contamination_digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query's digest: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    found = find_contamination(documents.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def oracle() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({low}, '{WORD}') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({low}, '{WORD}') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, {WINDOW} AS l, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM b WHERE len(w) >= {WINDOW})
  UNION
  SELECT DISTINCT item, len(w) AS l, array_to_string(w, ' ') AS k FROM b WHERE len(w) BETWEEN 1 AND {WINDOW - 1}
),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (
  SELECT rid, l, i, array_to_string(w[i:i + l - 1], ' ') AS k
  FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l)
),
hits AS (SELECT dw.rid, dw.i, dw.l, bw.item FROM dw JOIN bw ON dw.l = bw.l AND dw.k = bw.k),
covered AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS pos FROM hits) GROUP BY rid),
met AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(covered.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(met.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(met.items, '')) AS items_sha256,
       coalesce(covered.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN met USING (rid)
"""
