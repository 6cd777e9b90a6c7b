"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vocara.functions.scoring import fixed

# The columns of the export, in order, and the status of a new row.
EXPORT_COLUMNS = (
    "company", "title", "country", "remote", "seniority", "visa",
    "match_score", "url", "source", "posted_at", "status",
)
NEW_STATUS = "to_apply"


def save_jobs(jobs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Jobs as JSON lines, nulls written out."""
    jobs.write.mode(mode).option("ignoreNullFields", "false").json(path)


def save_requests(requests: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Model requests as JSON lines, ready for a batch interface."""
    requests.write.mode(mode).json(path)


def export_rows(ranked: DataFrame, status: str = NEW_STATUS) -> DataFrame:
    """The rows of the export as text, nulls as empty, score with three decimals."""
    text = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    whole = F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format("posted_at", ".SSSSSS")
    stamp = F.concat(whole, F.when(micros == ".000000", "").otherwise(micros), F.date_format("posted_at", "xxx"))
    return ranked.select(
        "company",
        "title",
        text("country"),
        "remote",
        "seniority",
        F.col("visa_sponsorship").alias("visa"),
        fixed(F.col("match_score"), 3).alias("match_score"),
        "url",
        "source",
        F.coalesce(stamp, F.lit("")).alias("posted_at"),
        F.lit(status).alias("status"),
    )


def export_csv(ranked: DataFrame, path: str, status: str = NEW_STATUS, mode: str = "errorifexists") -> int:
    """Writes the export sorted by profile and position; returns the rows written.

    The rows are range-partitioned, so the files are in order without one task sorting
    everything. The count is observed during the write, not in a second pass.
    """
    ordered = ranked.repartitionByRange("cv_id", "position").sortWithinPartitions("cv_id", "position")
    written = Observation("export")
    rows = export_rows(ordered, status).observe(written, F.count(F.lit(1)).alias("rows"))
    rows.write.mode(mode).csv(
        path, header=True, lineSep="\r\n", escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return written.get["rows"]


def export_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("rows"))
