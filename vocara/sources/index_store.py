"""The job index as a versioned folder.

``root/versions/<n>/prefix=<xy>/`` holds version n of the index, partitioned by the first two
characters of the content hash; ``root/manifests/<n>.json`` names it, with its vector width and
row count. An upsert writes a whole new version beside the current one and only then publishes
its manifest, by renaming a finished file to a name no one has used: a reader takes the highest
manifest, so it sees one whole version, the old or the new, never a mix. A failed upsert leaves
an unpublished folder that the next attempt overwrites. A job is looked up in one partition.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocara.operators.index import index_upsert

PREFIX = 2


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The published manifest of the highest version, or None for an empty root."""
    fs, where = _fs(spark, f"{root}/manifests")
    if not fs.exists(where):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    versions = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit()]
    if not versions:
        return None
    return spark.read.json(f"{root}/manifests/{max(versions)}.json").first().asDict()


def read_index(spark: SparkSession, root: str) -> DataFrame | None:
    """The current version, or None; ``prefix`` is a partition column."""
    current = manifest(spark, root)
    return None if current is None else spark.read.parquet(f"{root}/versions/{current['version']}")


def get_job_at(spark: SparkSession, root: str, content_hash: str) -> DataFrame:
    """The job of one content hash; the scan reads its prefix partition alone."""
    index = read_index(spark, root)
    if index is None:
        raise ValueError(f"no index at {root}")
    return index.where((F.col("prefix") == content_hash[:PREFIX]) & (F.col("content_hash") == content_hash))


def _width(rows: DataFrame) -> int | None:
    low, high = rows.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if low is not None and low != high:
        raise ValueError(f"vectors of widths {low} to {high} in one upsert")
    return None if low is None or low < 0 else int(low)


def upsert_at(root: str, rows: DataFrame, order: str = "seq") -> DataFrame:
    """Publishes the index after ``rows`` (with ``content_hash``, ``vector`` and ``order``) were
    inserted or overwrote their hash, as a new version; returns it. Vectors of another width
    than the index's are an error, before anything is written."""
    spark = rows.sparkSession
    current = manifest(spark, root)
    width = _width(rows)
    if current is not None and width is not None and current.get("width") is not None and width != current["width"]:
        raise ValueError(f"vectors of width {width} meet an index of width {current['width']}")
    old = None if current is None else read_index(spark, root).drop("prefix")
    merged = index_upsert(old, rows.drop("prefix") if "prefix" in rows.columns else rows, order)
    version = 1 if current is None else current["version"] + 1
    folder = f"{root}/versions/{version}"
    staged = merged.withColumn("prefix", F.substring("content_hash", 1, PREFIX)).repartition("prefix")
    staged.write.mode("overwrite").partitionBy("prefix").parquet(folder)
    count = spark.read.parquet(folder).count()
    body = {"version": version, "width": width if width is not None else (current or {}).get("width"), "rows": count}
    fs, tmp = _fs(spark, f"{root}/manifests/.{version}-{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, False)
    out.write(bytearray(json.dumps(body).encode()))
    out.close()
    _, final = _fs(spark, f"{root}/manifests/{version}.json")
    if not fs.rename(tmp, final):
        fs.delete(tmp, False)
        raise RuntimeError(f"version {version} of {root} was published by another writer")
    return spark.read.parquet(folder)
