from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from vocara.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(8)
    session.sparkContext.setLogLevel("ERROR")
    return session


JOB_FIELDS = (
    "seq bigint, title string, company string, location string, country string, remote string, "
    "seniority string, stack array<string>, visa_sponsorship string, description_summary string, "
    "source string, url string, content_hash string"
)


@pytest.fixture(scope="session")
def sample_jobs(spark):
    """Postings of a ferry line, a bakery, a museum and a quarry."""
    rows = [
        (1, "Fleet Scheduler", "Nordhavn", "Cork", "IE", "onsite", "lead", ["Scala", "Spark"], "yes"),
        (2, "Oven Telemetry Analyst", "Kruste", "Ulm", "DE", "remote", "senior", ["Scala", "Redis"], "yes"),
        (3, "Archive Curator", "Stadsdepot", "Delft", "NL", "onsite", "junior", ["Terraform"], "no"),
        (4, "Drill Planner", "Slate Ridge", None, "CA", "unknown", "mid", ["Scala"], "unknown"),
    ]
    more = lambda seq, title: (f"{title} wanted.", "paper", f"https://jobs.test/{seq}", f"{seq:016x}")
    return spark.createDataFrame([(*row, *more(row[0], row[1])) for row in rows], JOB_FIELDS)
