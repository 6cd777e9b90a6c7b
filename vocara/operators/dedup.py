"""Exact-key and near-duplicate removal.

Near-duplicate removal is greedy in the order of ``seq``: a row is kept unless an earlier
*kept* row is similar enough. That is the lexicographically first maximal independent set
of the similarity graph, and it is computed here without ever listing that whole graph:

1. Equal vectors collapse to their first row. Its copies are always duplicates, whatever
   happens to the first row, so a group of copies of any size costs one aggregation.
2. All distinct rows are undecided, then decided in rounds over all of them at once. A row
   is kept as soon as no undecided earlier row resembles it, and every row resembling a kept
   row is dropped. A round asks each undecided row only whether such an earlier neighbour
   exists: first against the earliest row of each of its keys (prefix words, pivot cells),
   which settles the members of a dense cluster with one pair each; the full search runs
   only for the rows that probe left open. The rounds follow the longest chain of decisions,
   not the number of rows or pairs; no range of ``seq`` is taken apart.

How similar pairs are found is up to a *finder*: :class:`WordSets` for presence vectors
over an open vocabulary, :class:`DenseVectors` for vectors of fixed width. Both are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocara.functions.vectors import SIM_DECIMALS
from vocara.operators.picking import keep_first
from vocara.operators.search import unit_rows
from vocara.session import materialize, release, store, stored_once

# Fixed value: the similarity from which a posting counts as a duplicate.
THRESHOLD = 0.97
# Pairs of one range that may be looked at at once, per core of the cluster.
PAIRS_PER_CORE = 5_000_000
SLACK = 1e-9


def dedup_exact(rows: DataFrame, key: str = "content_hash", order: str = "seq") -> DataFrame:
    """The first row of every key; ``order`` is unique over the table."""
    return keep_first(rows, key, order)


def _pairs_per_key(rows: DataFrame, others: DataFrame | None, key: str) -> int:
    """How many pairs agree in the key: of rows with the others, or of rows among themselves."""
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias(name))
    n, m = F.col("n"), F.col("m")
    counts = count(rows, "n")
    pairs = n * (n - 1) / 2 if others is None else n * m
    counts = counts if others is None else counts.join(count(others, "m"), key)
    return int(counts.agg(F.coalesce(F.sum(pairs), F.lit(0.0))).first()[0])


class WordSets:
    """Similar pairs among sets of words (presence vectors over an open vocabulary).

    Exact signatures: sets of cosine t or more differ in at most ``h`` words, ``h`` following
    from their sizes. The words are dealt by hash to ``h + 1`` parts, so at least one part is
    the same in both. At t = 0.97 a part has about 16 words, so that hardly any sets share one
    but near copies, however common their words are. Rows have ``seq`` and ``words``.

    Word postings (see :meth:`postings`) are probed by exact prefix filtering: two such sets
    share a word among the first ``n - ceil(t*t*n) + 1`` words of each in any global order.
    """

    # Words told apart by frequency; beyond them all count as rare.
    FREQUENT_WORDS = 4_096
    # Rows of one side of a word that meet in one task, and the longest list of words split so.
    TILE_ROWS = 2_048
    MOST_HOT = 100_000
    # Buckets of stored word postings; a probe reads those of its prefix words alone.
    BUCKETS = 1_024
    # Buckets of stored signatures, one file each and batch.
    SIGNATURE_BUCKETS = 64
    # Rows whose signatures are computed at a time.
    SIGNATURE_ROWS = 500
    # What rows carry once their signatures were computed.
    CARRIED = ("n", "keys")
    # So many undecided rows, or fewer, list their similar pairs, and the driver decides them.
    FEW_ROWS = 2_000

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def ready(self, rows: DataFrame) -> DataFrame:
        """Rows as :meth:`pairs` takes them: signatures need no order of the words."""
        return rows.select("seq", "words", *[c for c in self.CARRIED if c in rows.columns])

    def signatures(self, rows: DataFrame) -> DataFrame:
        """``seq, n, word``: the keys of every non-empty set, ``word`` being a hash of the words of
        one part. Similar sets share at least one; others that do are told apart later. Rows that
        carry ``n`` and their ``keys`` (see :meth:`meeting`) hand out those.

        Sizes fall into classes such that similar sets are of one class or of neighbouring
        ones. The class of the smaller set fixes the number of parts, so a row has the keys
        of its own class and of the class below.
        """
        if set(self.CARRIED) <= set(rows.columns):
            return rows.select("seq", "n", F.explode("keys").alias("word"))
        least = max(self.threshold - SLACK, 1e-3)
        ratio = 1 / least**2
        spread, step = max(2 - 2 * least, ratio - 1), self.SIGNATURE_ROWS

        def classes(largest: int) -> tuple[np.ndarray, np.ndarray]:
            starts = [1]
            while starts[-1] <= largest:
                starts.append(max(starts[-1] + 1, int(starts[-1] * ratio) + 1))
            parts = [int((end - 1) * spread + 1e-6) + 1 for end in starts[1:]]
            return np.array(starts), np.array(parts, dtype=np.int64)

        def mixed(keys: np.ndarray) -> np.ndarray:
            keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return keys ^ (keys >> np.uint64(31))

        def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    piece = batch.slice(at, step)
                    seq, n = piece.column("seq"), piece.column("n").to_numpy(zero_copy_only=False)
                    hashes = piece.column("hashes")
                    words = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                    row = np.repeat(np.arange(len(n)), hashes.value_lengths().to_numpy(zero_copy_only=False))
                    starts, parts = classes(int(n.max()))
                    home = np.searchsorted(starts, n, side="right") - 1
                    for level in (home, home - 1):
                        many = np.where(level >= 0, parts[np.maximum(level, 0)], 0)
                        first = np.cumsum(many) - many
                        used = many[row] > 0
                        place = first[row[used]] + (words[used] % many[row[used]].astype(np.uint64)).astype(np.int64)
                        sums = np.zeros(int(many.sum()), dtype=np.uint64)
                        np.add.at(sums, place, mixed(words[used]))
                        owner = np.repeat(np.arange(len(n)), many)
                        part = np.arange(len(sums)) - first[owner]
                        label = (level[owner].astype(np.uint64) << np.uint64(32)) + part.astype(np.uint64)
                        keys = mixed(sums + mixed(label + np.uint64(1))).view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [seq.take(pa.array(owner)), pa.array(n[owner].astype(np.int32)), pa.array(keys)], ["seq", "n", "word"]
                        )

        hashed = rows.filter(~self.is_zero()).select(
            "seq", F.size("words").alias("n"), F.array_distinct(F.transform("words", lambda w: F.xxhash64(w))).alias("hashes")
        )
        return hashed.mapInArrow(keys_of, "seq bigint, n int, word bigint")

    def stored_signatures(self, rows: DataFrame) -> DataFrame:
        """Signatures with their ``bucket``, to be stored partitioned by it; one writer a bucket."""
        keys = self.signatures(rows).withColumn("bucket", self._bucket("word"))
        return keys.repartition(self.SIGNATURE_BUCKETS, "bucket")

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.col(key), F.lit(self.SIGNATURE_BUCKETS)).cast("int")

    def _held(self, stored: DataFrame, keys: DataFrame, postings: DataFrame | None) -> DataFrame:
        """The signatures of the stored rows: of those kept, only the buckets of the keys."""
        if postings is None or dict(postings.dtypes)["word"] != "bigint":
            return self.signatures(stored)
        buckets = sorted(r["bucket"] for r in keys.select(self._bucket("word").alias("bucket")).distinct().collect())
        return postings.where(F.col("bucket").isin(buckets))

    def meeting(self, rows: DataFrame, stored: DataFrame | None = None, postings: DataFrame | None = None) -> DataFrame:
        """The non-empty rows that share a signature with another row or a stored one, stored; all
        others resemble none. Only keys are dealt out, not the words of rows that meet nothing.
        The rows carry ``n`` words and those ``keys`` that are shared, so that no later step
        computes a signature again."""
        live = rows.filter(~self.is_zero())
        keys = materialize(self.signatures(live), "near-keys")
        shared = keys.groupBy("word").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("word")
        if stored is not None:
            shared = shared.unionByName(self._held(stored, keys, postings).select("word"))
        met = keys.join(shared, "word", "left_semi").groupBy("seq").agg(F.collect_set("word").alias("keys"))
        met = materialize(met, "near-seqs")
        release(keys)
        found = materialize(live.withColumn("n", F.size("words")).join(met, "seq"), "near-meeting")
        release(met)
        return found

    @staticmethod
    def identity(rows: DataFrame) -> DataFrame:
        return rows.withColumn("identity", F.sha2(F.array_join("words", "\n"), 256))

    @staticmethod
    def is_zero() -> Column:
        return F.size("words") == 0

    def prepare(self, rows: DataFrame) -> DataFrame:
        """``seq``, and ``words`` in one global order: the words of most rows last, in classes that
        double in frequency, the others first. Inside a class the hash of the word decides.

        Any order gives exact results; frequent words are only kept out of the prefixes. So only
        a bounded list of them is gathered, and rows are reordered where they are.
        """
        spread = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        classes: dict[int, list[str]] = {}
        for word, df in spread.orderBy(F.desc("df"), "word").limit(self.FREQUENT_WORDS).collect():
            classes.setdefault(df.bit_length(), []).append(word)
        place = lambda w: reduce(
            lambda found, level: F.when(w.isin(classes[level]), level).otherwise(found), sorted(classes), F.lit(0)
        )
        keyed = F.array_sort(F.transform("words", lambda w: F.struct(place(w).alias("p"), F.xxhash64(w).alias("h"), w.alias("w"))))
        return rows.select("seq", F.transform(keyed, lambda x: x["w"]).alias("words"))

    def _prefix(self, rows: DataFrame, side: str) -> DataFrame:
        n = F.size("words")
        floor = F.ceil(n * (self.threshold - SLACK) ** 2 - SLACK)
        prefix = F.slice("words", 1, (n - floor + 1).cast("int"))
        return rows.select(
            F.col("seq").alias(side), n.alias(f"n_{side}"), F.posexplode(prefix).alias(f"p_{side}", "word")
        )

    def work(self, rows: DataFrame, others: DataFrame | None = None) -> int:
        """Pairs of rows (with the others, if given) that share a prefix word, an upper bound of
        the pairs to look at."""
        return _pairs_per_key(self._prefix(rows, "a"), None if others is None else self._prefix(others, "a"), "word")

    def _tiled(self, a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both prefix sides with tile numbers ``ta, tb``: a word held by more than ``TILE_ROWS``
        rows on a side meets in ``ceil(m_a / TILE_ROWS) x ceil(m_b / TILE_ROWS)`` tiles, each
        row of one side copied to every tile of the other. The plan comes from counts per word;
        only such words travel to the tasks, the ``MOST_HOT`` with the most rows."""
        counts = a.groupBy("word").agg(F.count(F.lit(1)).alias("m_a")).join(b.groupBy("word").agg(F.count(F.lit(1)).alias("m_b")), "word")
        most = counts.where((F.col("m_a") > self.TILE_ROWS) | (F.col("m_b") > self.TILE_ROWS))
        hot = most.orderBy(F.desc(F.col("m_a") + F.col("m_b")), "word").limit(self.MOST_HOT).select(
            "word",
            F.ceil(F.col("m_a") / self.TILE_ROWS).cast("int").alias("n_ta"),
            F.ceil(F.col("m_b") / self.TILE_ROWS).cast("int").alias("n_tb"),
        )
        hot = materialize(hot, "hot-words")
        if hot.isEmpty():
            return tuple(side.withColumn("ta", F.lit(0)).withColumn("tb", F.lit(0)) for side in (a, b))
        hot = F.broadcast(hot)  # MOST_HOT rows at most
        tiles = lambda n: F.coalesce(F.col(n), F.lit(1))
        a = a.join(hot, "word", "left").select(
            "*", F.pmod(F.xxhash64("a"), tiles("n_ta")).cast("int").alias("ta"), F.explode(F.sequence(F.lit(0), tiles("n_tb") - 1)).alias("tb")
        ).drop("n_ta", "n_tb")
        b = b.join(hot, "word", "left").select(
            "*", F.explode(F.sequence(F.lit(0), tiles("n_ta") - 1)).alias("ta"), F.pmod(F.xxhash64("b"), tiles("n_tb")).cast("int").alias("tb")
        ).drop("n_ta", "n_tb")
        return a, b

    def firsts(self, rows: DataFrame) -> DataFrame:
        """The rows that come first among those sharing one of their signatures."""
        least = self.signatures(rows).groupBy("word").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("m"))
        return rows.join(least.where("m > 1").select("seq").distinct(), "seq", "left_semi")

    def first_pairs(self, rows: DataFrame) -> DataFrame:
        """Similar pairs ``a, b, similarity`` of a row with the first row of one of its signatures:
        a candidate per key at most, however many rows share it."""
        keys = self._keyed(self.signatures(rows), "b")
        least = keys.groupBy("word").agg(F.min(F.struct(F.col("b").alias("a"), F.col("n_b").alias("n_a"))).alias("least"))
        met = keys.join(least, "word").select("b", "n_b", "least.a", "least.n_a")
        candidates = met.filter((F.col("a") < F.col("b")) & self._sizes_fit()).select("a", "b").distinct()
        return self._verified(candidates, rows, rows)

    def pairs(self, left: DataFrame, right: DataFrame, ordered: bool = True) -> DataFrame:
        """Similar pairs ``a, b, similarity``, ``a`` from ``left`` and ``b`` from ``right``; with
        ``ordered`` only those with ``a`` before ``b``, else all (the sides share no row)."""
        a_side, b_side = self._tiled(self._keyed(self.signatures(left), "a"), self._keyed(self.signatures(right), "b"))
        order = F.col("a") < F.col("b") if ordered else F.lit(True)
        candidates = a_side.join(b_side, ["word", "ta", "tb"]).filter(order & self._sizes_fit()).select("a", "b").distinct()
        return self._verified(candidates, left, right)

    @staticmethod
    def _keyed(keys: DataFrame, side: str) -> DataFrame:
        return keys.select("word", F.col("seq").alias(side), F.col("n").alias(f"n_{side}"))

    def _sizes_fit(self) -> Column:
        """The smaller set may lie wholly in the larger one and still be similar enough."""
        return F.least("n_a", "n_b") >= F.sqrt(F.col("n_a").cast("double") * F.col("n_b")) * (self.threshold - SLACK) - SLACK

    def _verified(self, candidates: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
        """The candidates ``a, b`` that are similar, with their similarity."""
        a_words = left.select(F.col("seq").alias("a"), F.col("words").alias("a_words"))
        b_words = right.select(F.col("seq").alias("b"), F.col("words").alias("b_words"))
        shared = F.size(F.array_intersect("a_words", "b_words"))
        size = F.sqrt(F.size("a_words").cast("double") * F.size("b_words"))
        return (
            candidates.join(a_words, "a")
            .join(b_words, "b")
            .select("a", "b", F.round(shared / size, SIM_DECIMALS).alias("similarity"))
            .filter(F.col("similarity") >= self.threshold)
        )

    @classmethod
    def postings(cls, rows: DataFrame) -> DataFrame:
        """``seq, word, bucket`` of rows with ``seq, words``: one row per distinct word, to be
        stored partitioned by ``bucket`` (a hash of the word)."""
        words = rows.select("seq", F.explode(F.array_distinct("words")).alias("word"))
        return words.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(cls.BUCKETS)).cast("int"))

    def probe(self, stored: DataFrame, rows: DataFrame, postings: DataFrame | None = None) -> DataFrame:
        """Similar pairs of a large stored table and a few prepared rows.

        Stored rows may share a ``seq`` with each other and with the rows. ``postings`` of the
        stored rows, partitioned by ``bucket``, are their signatures (:meth:`stored_signatures`)
        or their words (:meth:`postings`, where only the rows need their prefix: any stored set
        that is similar enough holds one of those words, wherever it stands). Only the buckets
        that the rows need are read: the filter on the partition column prunes the scan.
        Without, the signatures of all stored rows are computed.
        """
        if postings is None or dict(postings.dtypes)["word"] == "bigint":
            keys = self.signatures(rows)
            a_side = self._keyed(self._held(stored, keys, postings), "a")
            candidates = a_side.join(self._keyed(keys, "b"), "word").filter(self._sizes_fit()).select("a", "b").distinct()
            # A small table of candidates is shipped, so the stored words need not be dealt out.
            return self._verified(materialize(candidates, "near-candidates"), stored, rows)
        prefix = self._prefix(rows, "b").select("b", "word")
        wanted = prefix.select(F.pmod(F.xxhash64("word"), F.lit(self.BUCKETS)).cast("int").alias("bucket")).distinct()
        buckets = sorted(r["bucket"] for r in wanted.collect())  # BUCKETS values at most
        held = postings.where(F.col("bucket").isin(buckets)).select(F.col("seq").alias("a"), "word")
        return self._verified(held.join(prefix, "word").select("a", "b").distinct(), stored, rows)


class DenseVectors:
    """Similar pairs among vectors of one width.

    Unit vectors of cosine t or more lie within ``sqrt(2 - 2t)`` of each other. Rows are
    assigned to the nearest of a few pivots, and copied to every other pivot whose border
    is within that distance; a pair always meets in the cell of its later row. Cells are
    cut into tiles of bounded size, and each tile is one matrix product.
    Rows have ``seq`` and ``vector``.
    """

    ROWS_PER_PIVOT = 20_000
    # The pivots are known to every task, with all their distances: 32 MB at most.
    MAX_PIVOTS = 2_048
    TILE_ROWS = 4_096
    # A side is cut into few tiles, so that rows are copied to few; a tile holds so many bytes
    # of vectors at most. Copies of rows and scores that a task holds at once.
    FEW_TILES = 8
    TILE_BYTES = 8 * 1024 * 1024
    PIECE_ROWS = 4_096
    STRIPE_SCORES = 4 * 1024 * 1024
    FEW_ROWS = 0  # rows are decided in rounds to the end
    # Rows on which numbers of pivots are compared, and the price of a shipped copy in pairs.
    SAMPLE_ROWS = 512
    COPY_PAIRS = 2_000
    ASSIGNED = "seq bigint, vector array<double>, cell int"
    PAIR = "a bigint, b bigint, similarity double"

    def __init__(self, threshold: float, rows_per_pivot: int = ROWS_PER_PIVOT, tile_rows: int = TILE_ROWS) -> None:
        self.threshold = threshold
        self.radius = sqrt(max(0.0, 2 - 2 * (threshold - SLACK)))
        self.rows_per_pivot = rows_per_pivot
        self.tile_rows = tile_rows
        self.pivots: np.ndarray | None = None
        self.tile = tile_rows

    @staticmethod
    def identity(rows: DataFrame) -> DataFrame:
        return rows.withColumn("identity", F.sha2(F.array_join(F.col("vector").cast("array<string>"), ","), 256))

    @staticmethod
    def is_zero() -> Column:
        return F.forall("vector", lambda x: x == 0)

    def meeting(self, rows: DataFrame, stored: DataFrame | None = None, postings: DataFrame | None = None) -> DataFrame:
        """All rows that are not zero: no key tells beforehand which of them resemble none."""
        return rows.filter(~self.is_zero())

    def ready(self, rows: DataFrame) -> DataFrame:
        return self.prepare(rows)

    def prepare(self, rows: DataFrame) -> DataFrame:
        """Casts the vectors and picks the pivots: a bounded pseudo-random sample of rows.

        Where vectors have no clusters, borders are within reach of nearly all rows, and each
        would be copied to most cells. So the number of pivots is the cheapest of ``wanted``
        and its fourth parts, by the copies of some further rows; results are the same with any.
        """
        rows = rows.select("seq", F.col("vector").cast("array<double>").alias("vector"))
        n = rows.count()
        wanted = min(self.MAX_PIVOTS, max(1, ceil(n / self.rows_per_pivot)))
        picked = rows.orderBy(F.xxhash64("seq"), "seq").limit(wanted + self.SAMPLE_ROWS).toPandas()
        if picked.empty:
            self.pivots = None
            return rows
        units = unit_rows(picked["vector"])
        tile = self.tile = self._rows_per_tile(n, units.shape[1])

        def price(k: int) -> float:
            copies = self._borders(units[wanted:], units[:k]).sum() / max(1, len(units) - wanted)
            copies = max(1.0, copies)
            return self.COPY_PAIRS * n * (copies * ceil(n / k / tile) + ceil(n * copies / k / tile)) + n * n * copies / k

        counts = [wanted]
        while counts[-1] > 1:
            counts.append(max(1, counts[-1] // 4))
        self.pivots = units[: min(counts, key=price)]
        return rows

    def _rows_per_tile(self, n: int, width: int) -> int:
        """At least ``tile_rows``; more for large tables, up to ``TILE_BYTES``."""
        return max(self.tile_rows, min(ceil(n / self.FEW_TILES), self.TILE_BYTES // (8 * max(1, width))))

    def _borders(self, units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """Which cells each unit vector belongs to: its own, and those whose border is within reach."""
        gaps = np.maximum(2 - 2 * pivots @ pivots.T, 0)
        squared = np.maximum(2 - 2 * units @ pivots.T, 0)
        home, at = squared.argmin(axis=1), np.arange(len(units))
        near = squared - squared[at, home][:, None] <= 2 * self.radius * np.sqrt(gaps[home]) + SLACK
        near[at, home] = True
        return near

    def _assign(self, rows: DataFrame, with_borders: bool) -> DataFrame:
        rows = rows.select("seq", "vector")
        if self.pivots is None:  # no row was prepared, so there is nothing to meet
            return rows.limit(0).withColumn("cell", F.lit(0))
        pivots, borders, step = self.pivots, self._borders, self.PIECE_ROWS

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for start in range(0, len(batch), step // 4):
                    part = batch.iloc[start : start + step // 4]
                    units = unit_rows(part["vector"])
                    if with_borders:
                        rows_at, cells = np.nonzero(borders(units, pivots))
                    else:
                        rows_at, cells = np.arange(len(part)), np.maximum(2 - 2 * units @ pivots.T, 0).argmin(axis=1)
                    for at in range(0, len(rows_at), step):  # a row may have a copy per pivot
                        placed = part.iloc[rows_at[at : at + step]].reset_index(drop=True)
                        placed["cell"] = cells[at : at + step].astype("int32")
                        yield placed

        return rows.mapInPandas(place, self.ASSIGNED)

    def work(self, rows: DataFrame, others: DataFrame | None = None) -> int:
        borders = None if others is None else self._assign(others, with_borders=True)
        return _pairs_per_key(self._assign(rows, with_borders=False), borders, "cell")

    def firsts(self, rows: DataFrame) -> DataFrame:
        """The first row of every pivot cell."""
        least = self._assign(rows, with_borders=False).groupBy("cell").agg(F.min("seq").alias("seq")).select("seq")
        return rows.join(least, "seq", "left_semi")

    def first_pairs(self, rows: DataFrame) -> DataFrame:
        """Similar pairs of a row with the first row of a cell it is in reach of."""
        return self.pairs(self.firsts(rows), rows)

    def pairs(self, left: DataFrame, right: DataFrame, ordered: bool = True) -> DataFrame:
        a, b = self._assign(left, with_borders=True), self._assign(right, with_borders=False)
        n_tiles = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / self.tile)).cast("int")
        count = lambda df, name: df.groupBy("cell").agg(F.count(F.lit(1)).alias(name))
        # At most one row per pivot.
        cells = F.broadcast(
            count(a, "n_a")
            .join(count(b, "n_b"), "cell")
            .select("cell", n_tiles("n_a").alias("tiles_a"), n_tiles("n_b").alias("tiles_b"))
        )
        slot = lambda tiles: F.pmod(F.xxhash64("seq"), F.col(tiles)).cast("int")
        every = lambda tiles: F.explode(F.sequence(F.lit(0), F.col(tiles) - 1))
        a = a.join(cells, "cell").select("seq", "vector", "cell", slot("tiles_a").alias("ta"), every("tiles_b").alias("tb"))
        b = b.join(cells, "cell").select("seq", "vector", "cell", every("tiles_a").alias("ta"), slot("tiles_b").alias("tb"))
        # Both sides may come from one table; new names keep them apart.
        b = b.select(*[F.col(c).alias(f"{c}_b") for c in ("seq", "vector", "cell", "ta", "tb")])
        threshold, at_once = self.threshold, self.STRIPE_SCORES

        def compare(a_rows: pd.DataFrame, b_rows: pd.DataFrame) -> pd.DataFrame:
            if a_rows.empty or b_rows.empty:
                return pd.DataFrame({"a": [], "b": [], "similarity": []})
            a_seq, b_seq = a_rows["seq"].to_numpy(), b_rows["seq_b"].to_numpy()
            a_units, b_units = unit_rows(a_rows["vector"]), unit_rows(b_rows["vector_b"]).T
            parts, step = [], max(1, at_once // len(b_seq))
            for start in range(0, len(a_seq), step):
                scores = a_units[start : start + step] @ b_units
                rows_at, cols = np.nonzero(scores >= threshold - SLACK)
                found = pd.DataFrame({"a": a_seq[start + rows_at], "b": b_seq[cols], "similarity": np.round(scores[rows_at, cols], SIM_DECIMALS)})
                similar = found["similarity"] >= threshold
                parts.append(found[similar & (found["a"] < found["b"]) if ordered else similar])
            return pd.concat(parts, ignore_index=True)

        tiles = a.groupBy("cell", "ta", "tb").cogroup(b.groupBy("cell_b", "ta_b", "tb_b"))
        return tiles.applyInPandas(compare, self.PAIR)

    def probe(self, stored: DataFrame, rows: DataFrame, postings: DataFrame | None = None) -> DataFrame:
        return self.pairs(stored, rows, ordered=False)


Finder = WordSets | DenseVectors


def resolve(pairs: DataFrame) -> DataFrame:
    """The ``seq`` of rows that greedy selection drops, given all similar pairs ``a < b``.

    Round by round: a row without an undecided earlier neighbour is kept, and everything
    similar to a kept row is dropped. The rounds follow the longest chain of decisions, not
    the number of pairs.
    """
    edges = pairs.select("a", "b")
    dropped: list[DataFrame] = []
    while not edges.isEmpty():
        blocked = edges.select(F.col("b").alias("seq")).distinct()
        roots = edges.select("a").distinct().join(blocked, F.col("a") == F.col("seq"), "left_anti")
        gone = materialize(edges.join(roots, "a", "left_semi").select(F.col("b").alias("seq")).distinct(), "dropped")
        dropped.append(gone)
        edges = materialize(
            edges.join(gone.withColumnRenamed("seq", "b"), "b", "left_anti")
            .join(gone.withColumnRenamed("seq", "a"), "a", "left_anti")
            .select("a", "b"),
            "undecided",
        )
    return reduce(DataFrame.unionByName, dropped, edges.select(F.col("b").alias("seq")))


def _collapse(rows: DataFrame, finder: Finder) -> tuple[DataFrame, DataFrame]:
    """Distinct non-zero rows, and every row with the first row of its copies.

    The aggregation sees only the fingerprint and ``seq``, combined map-side.
    """
    keyed = finder.identity(rows.filter(~finder.is_zero()))
    first = keyed.groupBy("identity").agg(F.min("seq").alias("first_seq"))
    members = keyed.select("seq", "identity").join(first, "identity").select("seq", "first_seq")
    distinct = rows.join(first.select(F.col("first_seq").alias("seq")), "seq", "left_semi")
    return distinct, members


def _greedily_dropped(pairs: DataFrame) -> pd.DataFrame:
    """The ``seq`` of rows that greedy selection drops, of few rows, by all their similar pairs."""
    dropped: set[int] = set()
    # By the later row: all that can drop the earlier one was seen before.
    for a, b in pairs.select("a", "b").toPandas().sort_values("b").itertuples(index=False):
        if a not in dropped:
            dropped.add(b)
    return pd.DataFrame({"seq": np.array(sorted(dropped), dtype=np.int64)})


def greedy_kept(distinct: DataFrame, finder: Finder, pair_budget: int | None = None) -> DataFrame:
    """The prepared, pairwise different rows that greedy selection keeps.

    Round by round over all undecided rows: probe each against the first row of each of its
    keys, search fully only for the rows the probe left open, keep those without an undecided
    earlier neighbour and drop what resembles them; rows whose probe found a kept one are not
    searched again. The last few rows list their similar pairs (``FEW_ROWS`` of the finder), and
    the driver goes through them. ``pair_budget`` is no longer needed (no
    range is ever split) and is accepted for callers of the former interface.
    """
    spark = distinct.sparkSession
    kept: list[str] = []
    undecided = distinct
    while True:
        some = undecided.select("seq").limit(finder.FEW_ROWS + 1).count()
        if not some:
            break
        if some <= finder.FEW_ROWS:
            gone = _greedily_dropped(finder.pairs(undecided, undecided))
            dropped = spark.createDataFrame(gone, "seq bigint")
            kept.append(store(undecided.join(F.broadcast(dropped), "seq", "left_anti").select(*distinct.columns), "kept"))
            break
        earlier = lambda left, right: finder.pairs(left, right).select(F.col("b").alias("seq")).distinct()
        probed = finder.first_pairs(undecided).groupBy(F.col("b").alias("seq")).agg(F.min("a").alias("first"))
        probed = materialize(probed, "probed")
        open_rows = materialize(undecided.join(probed, "seq", "left_anti"), "open")
        blocked = earlier(undecided, open_rows)
        roots = open_rows.join(blocked, "seq", "left_anti").select(*distinct.columns)
        kept.append(store(roots, "kept"))
        roots = spark.read.schema(distinct.schema).parquet(kept[-1])
        settled = probed.join(roots.select(F.col("seq").alias("first")), "first", "left_semi").select("seq")
        left = materialize(
            undecided.join(roots.select("seq").unionByName(settled), "seq", "left_anti"), "left"
        )
        undecided = materialize(left.join(earlier(roots, left), "seq", "left_anti"), "undecided")
    if not kept:
        return distinct.limit(0)
    return spark.read.schema(distinct.schema).parquet(*kept)


def dedup_near(
    rows: DataFrame,
    finder: Finder,
    stored: DataFrame | None = None,
    pair_budget: int | None = None,
    postings: DataFrame | None = None,
) -> DataFrame:
    """``seq, is_duplicate`` for every row, greedy in the order of ``seq`` (a unique BIGINT).

    Rows of ``stored`` (same columns, other ``seq``) count as earlier and kept; ``postings``
    of them, where stored, narrow what is read (see :meth:`WordSets.probe`).
    """
    rows = stored_once(rows, "near-input")
    meeting = finder.meeting(rows, stored, postings)
    distinct, _ = _collapse(meeting, finder)
    prepared = materialize(finder.ready(distinct), "near-distinct")
    if stored is not None:
        similar = finder.probe(stored, prepared, postings).select(F.col("b").alias("seq")).distinct()
        prepared = materialize(prepared.join(similar, "seq", "left_anti"), "near-new")
    kept = greedy_kept(prepared, finder, pair_budget).select("seq", F.lit(True).alias("kept"))
    marked = rows.select("seq", finder.is_zero().alias("zero"))
    passed = marked.filter(F.coalesce("zero", F.lit(True))).select("seq", (~F.col("zero")).alias("is_duplicate"))
    met = meeting.select("seq")
    alone = marked.filter(~F.col("zero")).join(met.distinct(), "seq", "left_anti").select("seq", F.lit(False).alias("is_duplicate"))
    judged = met.join(kept, "seq", "left").select("seq", F.col("kept").isNull().alias("is_duplicate"))
    return passed.unionByName(alone).unionByName(judged)


def near_dup_pairs(
    rows: DataFrame,
    finder: Finder,
    pair_budget: int | None = None,
) -> DataFrame:
    """For every duplicate the kept row it matched best: ``seq, match_seq, similarity``.

    Among the earlier kept rows at or above the threshold, the most similar one (the
    earliest on a tie). One row per duplicate, however dense its cluster.
    """
    meeting = finder.meeting(stored_once(rows, "near-input"))
    distinct, members = _collapse(meeting, finder)
    prepared = materialize(finder.ready(distinct), "near-distinct")
    kept = greedy_kept(prepared, finder, pair_budget)
    # Kept rows resemble no other kept row, so only dropped rows need a partner.
    near = finder.pairs(kept, prepared.join(kept.select("seq"), "seq", "left_anti"), ordered=False)
    itself = kept.select(F.col("seq").alias("a"), F.col("seq").alias("b"), F.lit(1.0).alias("similarity"))
    near = materialize(near.unionByName(itself), "near-kept")
    best = F.max_by(F.struct("a", "similarity"), F.struct("similarity", -F.col("a"))).alias("best")
    return (
        members.join(near, F.col("first_seq") == F.col("b"))
        .filter(F.col("a") < F.col("seq"))
        .groupBy("seq")
        .agg(best)
        .select("seq", F.col("best.a").alias("match_seq"), F.col("best.similarity").alias("similarity"))
    )

