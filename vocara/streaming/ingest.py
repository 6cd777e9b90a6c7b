"""Incremental ingest: every micro-batch runs the batch plan against what is stored.

The store is parquet tables under one root (``outcomes``, ``index`` with their words, ``cache``,
``runs``, and ``postings``: the signatures of the index's word sets by batch and bucket, so that
a batch reads only the buckets of its own signatures), one folder per micro-batch. A batch overwrites its own folder and looks only at
earlier ones, so a replayed batch changes nothing. Rows are ordered by batch, then by page id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vocara import schemas as S
from vocara.functions.keys import text_hash
from vocara.functions.text import html_to_text
from vocara.operators.dedup import THRESHOLD, DenseVectors, Finder, WordSets
from vocara.operators.extraction import Provider
from vocara.operators.index import latest_per_hash
from vocara.operators.outcomes import ingest_summary
from vocara.plans.ingest import JOB_COLUMNS, Embedder, embed_words, ingest_scanned

# A row holds the kind of vector its embedder gives; the other one is null.
STORED_JOB = T.StructType(
    [T.StructField("seq", T.LongType())]
    + S.JOB.fields
    + [
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("vector", T.ArrayType(T.DoubleType())),
        T.StructField("batch_id", T.LongType()),
    ]
)
STORED_CACHE = T.StructType(
    [T.StructField("text_hash", T.StringType())] + S.JOB.fields + [T.StructField("batch_id", T.LongType())]
)


POSTINGS = "seq bigint, n int, word bigint, batch_id bigint, bucket int"


def _stored(spark: SparkSession, path: str, schema: T.StructType | str, before: int) -> DataFrame | None:
    """What earlier batches stored; the folder name prunes the scan."""
    if before == 0:
        return None
    return spark.read.schema(schema).parquet(path).filter(F.col("batch_id") < before)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def ingest_batch(
    root: str, provider: Provider, embedder: Embedder = embed_words, finder: Finder | None = None
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over rows ``page_id, source, url, html``.

    With an embedder of dense vectors the finder is :class:`DenseVectors`. Page ids of different
    batches may be equal: they order the rows of one batch only.
    """
    other = "words" if isinstance(finder, DenseVectors) else "vector"
    by_words = not isinstance(finder, DenseVectors)
    keyed = finder or WordSets(THRESHOLD)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        index = _stored(spark, f"{root}/index", STORED_JOB, batch_id)
        cache = _stored(spark, f"{root}/cache", STORED_CACHE, batch_id)
        # signatures of earlier batches, by batch and bucket: a probe reads its buckets alone
        postings = _stored(spark, f"{root}/postings", POSTINGS, batch_id) if by_words and _exists(spark, f"{root}/postings") else None
        text = html_to_text(F.col("html"))
        scanned = batch.select(
            F.col("page_id").alias("seq"),
            "source",
            "url",
            text.alias("text"),
            text_hash(text).alias("text_hash"),
            F.when(F.col("html").isNull(), F.concat(F.lit("fetch failed: no page for "), F.col("url"))).alias("error"),
        )
        done = ingest_scanned(
            scanned,
            provider,
            embedder,
            finder,
            cache=None if cache is None else cache.drop("batch_id"),
            index=None if index is None else index.drop("batch_id", other),
            postings=postings,
        )
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")
        write(done.entries, "index")
        write(done.fresh, "cache")
        write(done.outcomes, "outcomes")
        write(ingest_summary(done.outcomes), "runs")
        if by_words:
            entries = spark.read.schema(STORED_JOB).parquet(f"{root}/index/batch_id={batch_id}").select("seq", "words")
            keyed.stored_signatures(entries).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings/batch_id={batch_id}")

    return run


def start_ingest(
    pages: DataFrame,
    root: str,
    checkpoint: str,
    provider: Provider,
    embedder: Embedder = embed_words,
    finder: Finder | None = None,
) -> StreamingQuery:
    """Runs everything that has arrived, then stops; start again to continue."""
    return (
        pages.writeStream.foreachBatch(ingest_batch(root, provider, embedder, finder))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_outcomes(spark: SparkSession, root: str) -> DataFrame:
    schema = "seq bigint, source string, url string, outcome string, error string, batch_id bigint"
    return spark.read.schema(schema).parquet(f"{root}/outcomes")


def stream_runs(spark: SparkSession, root: str) -> DataFrame:
    schema = "indexed bigint, duplicates bigint, errors bigint, batch_id bigint"
    return spark.read.schema(schema).parquet(f"{root}/runs")


def stream_index(spark: SparkSession, root: str) -> DataFrame:
    """The index: across batches, the latest job of each content hash."""
    rows = spark.read.schema(STORED_JOB).parquet(f"{root}/index")
    latest = latest_per_hash(rows, F.struct("batch_id", "seq"))
    return latest.select("seq", *JOB_COLUMNS, "words", "vector", "batch_id")
