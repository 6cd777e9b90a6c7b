"""Source divergence audit with length-bucketed term packing.

Counting. Each task takes its Arrow batches as one byte buffer (no Python string per word): a
term is a maximal run of bytes that are ASCII letters or >= 0x80 (in UTF-8 this is exactly the
code-point pattern below, as every byte of a multi-byte character is >= 0x80), A-Z is lower-cased
in place. Terms of up to 8 bytes become one big-endian uint64 word, those of 9 to 16 bytes two;
zero padding keeps numeric order equal to byte order, as no term holds a zero byte. Each bucket
is radix-sorted (least significant 16-bit digit first, numpy's stable sort of 16-bit keys is a
radix sort) by group and words, stable on the row, and run-counted: occurrences per run, and
documents as the changes of row inside it. Longer terms go to buckets by power-of-two length,
each sorted as fixed-width byte strings. Tasks emit partial ``(lang, source, term, n, d)`` rows,
which Spark sums with a map-side combine; no key holds more than one term, so a hot source
spreads over its vocabulary.

Scoring, all in exact integers (``decimal(38,0)`` products, ``div``). Per lang, the kept terms
are those in at least ``min_docs`` of its documents (V of them). A group (lang, source) gives
each kept term ``p = 1 + floor(1e9 * (count + 5) / (N + 5V))``; a term it lacks has the group's
base ``p``. Part ``term``: kept terms the group holds with ``p > q`` (q the lang's own p), value
``p - q``, the first 50 by value, found first per (group, term hash slice) and then per group,
so a hot group never sorts its whole vocabulary in one task. Part ``pair``: the L1 distance of
the group's p vector to each other source's of the lang. Terms are dealt to blocks by hash,
their number chosen so that a block's dense sources x terms matrix has about ``CELLS`` cells;
one task per (lang, block) fills the matrix with bases and present counts and emits one partial
sum per ordered source pair, which Spark adds up. No per-term source pairs are ever emitted.

Cases: null text, lang or source read as ''; texts without terms still make their group; a lang
whose V is 0 gives every pair the value 0 and no term rows; repeated rows count again (documents
are rows); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocara.llm.common import materialize

# Fixed values of the contract: the term pattern, the document floor, the scale, the smoothing and the report depth.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 30
SCALE = 1_000_000_000
SMOOTH = 5
TOP_TERMS = 50

#: Cells of one dense block of p values (sources x terms), 512 kB of int64; a lang's present
#: cells are spread over its blocks, so a hot lang takes as many tasks as it needs.
CELLS = 1 << 16
#: Bytes of text a task turns into arrays at once (about 40 bytes of arrays each at the peak).
CHUNK_BYTES = 1 << 21
#: Slices of a group's terms ranked apart before the final top 50.
SLICES = 64


def _radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """Stable order by ``keys`` (most significant first; unsigned 64-bit), LSD over 16-bit digits."""
    order = np.arange(len(keys[0]), dtype=np.int64)
    for key in reversed(keys):
        key = key.astype(np.uint64, copy=False)
        top = int(key.max()) if len(key) else 0
        shift = 0
        while shift < 64 and (top >> shift):
            digit = ((key[order] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            order = order[np.argsort(digit, kind="stable")]
            shift += 16
    return order


def _runs(order: np.ndarray, keys: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First positions (in ``order``) of equal-key runs, their lengths and their distinct rows."""
    n = len(order)
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for key in keys:
        k = key[order]
        change[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(change)
    lengths = np.diff(np.append(starts, n))
    r = rows[order]
    new_row = change.copy()
    new_row[1:] |= r[1:] != r[:-1]
    docs = np.add.reduceat(new_row.astype(np.int64), starts)
    return starts, lengths, docs


def _pack(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, word: int) -> np.ndarray:
    """Bytes ``8 * word`` to ``8 * word + 7`` of each term, big-endian, zero-padded."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for j in range(8):
        at = 8 * word + j
        sel = lengths > at
        out[sel] |= data[starts[sel] + at].astype(np.uint64) << np.uint64(56 - 8 * j)
    return out


def _unpack(words: list[np.ndarray]) -> list[bytes]:
    parts = [w.astype(">u8").view("S8") for w in words]
    if len(parts) == 1:
        return parts[0].tolist()
    return [a + b for a, b in zip(parts[0].tolist(), parts[1].tolist(), strict=True)]


def count_terms_in(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> list[tuple[int, bytes, int, int]]:
    """``(group, term, occurrences, documents)`` of texts ``data[offsets[i]:offsets[i+1]]``."""
    size = len(data)
    if not size:
        return []
    b = data.astype(np.uint8, copy=False)
    upper = (b >= 0x41) & (b <= 0x5A)
    low = np.where(upper, b | 0x20, b).astype(np.uint8)
    mark = (b >= 0x80) | (((b | 0x20) >= 0x61) & ((b | 0x20) <= 0x7A))
    lengths_of_rows = np.diff(offsets)
    first = np.zeros(size + 1, dtype=bool)
    first[offsets[:-1][lengths_of_rows > 0] - offsets[0]] = True
    first[size] = True
    before = np.concatenate(([False], mark[:-1])) & ~first[:size]
    after = np.concatenate((mark[1:], [False])) & ~first[1:]
    starts = np.flatnonzero(mark & ~before)
    ends = np.flatnonzero(mark & ~after) + 1
    if not len(starts):
        return []
    lengths = ends - starts
    rows = np.searchsorted(offsets - offsets[0], starts, side="right") - 1
    group = groups[rows].astype(np.uint64)
    out: list[tuple[int, bytes, int, int]] = []
    for n_words, sel in ((1, lengths <= 8), (2, (lengths > 8) & (lengths <= 16))):
        if not sel.any():
            continue
        words = [_pack(low, starts[sel], lengths[sel], w) for w in range(n_words)]
        keys = [group[sel], *words]
        order = _radix_order(keys)
        at, occurrences, docs = _runs(order, keys, rows[sel])
        firsts = order[at]
        terms = _unpack([w[firsts] for w in words])
        out.extend(zip(keys[0][firsts].tolist(), terms, occurrences.tolist(), docs.tolist(), strict=True))
    long_sel = np.flatnonzero(lengths > 16)
    if len(long_sel):
        bucket = np.ceil(np.log2(lengths[long_sel])).astype(np.int64)
        for k in np.unique(bucket):
            these = long_sel[bucket == k]
            width = int(lengths[these].max())
            fixed = np.zeros((len(these), width), dtype=np.uint8)
            for i, t in enumerate(these):
                fixed[i, : lengths[t]] = low[starts[t] : ends[t]]
            strings = fixed.view(f"S{width}").ravel()
            order = np.lexsort((rows[these], strings, group[these]))
            s, g, r = strings[order], group[these][order], rows[these][order]
            change = np.ones(len(order), dtype=bool)
            change[1:] = (s[1:] != s[:-1]) | (g[1:] != g[:-1])
            new_row = change.copy()
            new_row[1:] |= r[1:] != r[:-1]
            at = np.flatnonzero(change)
            occurrences = np.diff(np.append(at, len(order)))
            docs = np.add.reduceat(new_row.astype(np.int64), at)
            out.extend(zip(g[at].tolist(), s[at].tolist(), occurrences.tolist(), docs.tolist(), strict=True))
    return out


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = pc.fill_null(batch.column(0), "").to_pylist()
        sources = pc.fill_null(batch.column(1), "").to_pylist()
        texts = pc.fill_null(batch.column(2), "")
        index: dict[tuple[str, str], int] = {}
        groups = np.fromiter((index.setdefault(k, len(index)) for k in zip(langs, sources, strict=True)), dtype=np.int64, count=len(langs))
        names = list(index)
        wide = texts.type in (pa.large_string(), pa.large_utf8())
        offsets_all = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data_all = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        start = 0
        while start < len(texts):
            stop = start + 1
            while stop < len(texts) and offsets_all[stop + 1] - offsets_all[start] <= CHUNK_BYTES:
                stop += 1
            offsets = offsets_all[start : stop + 1]
            data = data_all[offsets[0] : offsets[-1]]
            found = count_terms_in(data, offsets, groups[start:stop])
            if found:
                g, terms, n, d = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[i][0] for i in g], pa.string()),
                        pa.array([names[i][1] for i in g], pa.string()),
                        pa.array(terms, pa.binary()).cast(pa.string()),
                        pa.array(n, pa.int64()),
                        pa.array(d, pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "d"],
                )
            start = stop


def term_counts(documents: DataFrame) -> DataFrame:
    """``lang, source, term, n, d``: occurrences and documents of every term per group."""
    rows = documents.select(F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    partial = rows.mapInArrow(_counter, "lang string, source string, term string, n long, d long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _p(count: str, total: str, v: str) -> F.Column:
    return F.expr(f"1 + (cast({SCALE} as decimal(38,0)) * ({count} + {SMOOTH})) div ({total} + {SMOOTH} * {v})")


def _pair_sums(frame: pd.DataFrame) -> pd.DataFrame:
    """One (lang, block): partial L1 sums of every ordered pair of the lang's sources."""
    lang = frame["lang"].iloc[0]
    heads = frame[frame["term"].isna()]
    sources = heads["source"].tolist()
    where = {s: i for i, s in enumerate(sources)}
    cells = frame[frame["term"].notna()]
    terms = {t: j for j, t in enumerate(pd.unique(cells["term"]))}
    p = np.repeat(heads["base"].to_numpy(np.int64)[:, None], len(terms), axis=1)
    if len(cells):
        p[cells["source"].map(where).to_numpy(), cells["term"].map(terms).to_numpy()] = cells["p"].to_numpy(np.int64)
    left, right, value = [], [], []
    for i, s in enumerate(sources):
        dist = np.abs(p - p[i]).sum(axis=1) if len(terms) else np.zeros(len(sources), np.int64)
        for j, r in enumerate(sources):
            if i != j:
                left.append(s)
                right.append(r)
                value.append(int(dist[j]))
    return pd.DataFrame({
        "lang": pd.Series([lang] * len(left), dtype=object),
        "source": pd.Series(left, dtype=object),
        "item": pd.Series(right, dtype=object),
        "value": pd.Series(value, dtype="int64"),
    })


def divergence(documents: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` per group: ``pair`` rows for every other source
    of the lang, ``term`` rows for the group's ``top`` most over-represented kept terms."""
    docs = documents.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.col("text"),
    )
    counts = materialize(term_counts(docs), "divergence-counts")
    by_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    kept = materialize(by_lang.where(F.col("d") >= min_docs).select("lang", "term", "n"), "divergence-kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("nl"))
    groups = docs.select("lang", "source").distinct()
    present = counts.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n")
    totals = present.groupBy("lang", "source").agg(F.sum("n").alias("nn"))
    heads = (
        groups.join(sizes, "lang", "left")
        .join(totals, ["lang", "source"], "left")
        .select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("nn", F.lit(0)).alias("nn"), F.coalesce("nl", F.lit(0)).alias("nl"))
        .withColumn("blocks", F.greatest(F.lit(1), F.expr(f"cast(ceil(v * count(*) over (partition by lang) / {CELLS}) as int)")))
        .withColumn("base", F.when(F.col("v") > 0, _p("0", "nn", "v")).otherwise(F.lit(1)))
    )
    heads = materialize(heads, "divergence-heads")
    # a hot group's terms meet its head in SLICES tasks: heads are copied per slice
    salted = heads.select("lang", "source", "v", "nn", "nl", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    scored = materialize(
        present.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(SLICES)).cast("int"))
        .join(salted, ["lang", "source", "slice"])
        .join(kept.select("lang", "term", F.col("n").alias("n_lang")), ["lang", "term"])
        .select("lang", "source", "term", "n", "blocks", _p("n", "nn", "v").alias("p"), _p("n_lang", "nl", "v").alias("q")),
        "divergence-scored",
    )

    over = scored.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = [F.col("value").desc(), F.col("item").asc()]
    sliced = over.withColumn("slice", F.pmod(F.xxhash64("item"), F.lit(SLICES)))
    sliced = sliced.withColumn("r", F.row_number().over(Window.partitionBy("lang", "source", "slice").orderBy(*order))).where(F.col("r") <= top)
    terms = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top)
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    blocks = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    cells = scored.select("lang", "source", "term", "p", F.lit(None).cast("long").alias("base"), blocks.alias("block"))
    tops = heads.select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"), "base",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )
    sums = cells.unionByName(tops).groupBy("lang", "block").applyInPandas(_pair_sums, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms).select("lang", "source", "part", "item", F.col("value").cast("long"), F.col("rank").cast("int"))


def oracle() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    p = lambda c, t: f"1 + (CAST({SCALE} AS HUGEINT) * ({c} + {SMOOTH})) // ({t} + {SMOOTH} * v.v)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({low}, '{TERM}') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
gt AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS nl FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
gk AS (SELECT g.lang, g.source, k.term, coalesce(gt.n, 0) AS n, k.n AS n_lang
       FROM groups g JOIN kept k USING (lang) LEFT JOIN gt USING (lang, source, term)),
gn AS (SELECT lang, source, sum(n) AS nn FROM gk GROUP BY ALL),
gp AS (SELECT gk.lang, gk.source, gk.term, gk.n, {p('gk.n', 'gn.nn')} AS p, {p('gk.n_lang', 'v.nl')} AS q
       FROM gk JOIN gn USING (lang, source) JOIN v USING (lang)),
dist AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
         FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(dist.value, 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN dist ON dist.lang = a.lang AND dist.source = a.source AND dist.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM gp WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
