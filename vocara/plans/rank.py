"""Ranking end to end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from vocara.operators.ranking import DEFAULT_COUNTRIES, rank_batch
from vocara.sources.sinks import export_csv

DASHBOARD_MATCHES = 10


def rank_export(
    index: DataFrame,
    profiles: DataFrame,
    path: str,
    top_k: int = 20,
    countries: Sequence[str] | None = DEFAULT_COUNTRIES,
    require_visa: bool = True,
) -> int:
    """Ranks and writes the export; returns the rows written."""
    return export_csv(rank_batch(index, profiles, top_k, countries, require_visa), path)


def dashboard_matches(index: DataFrame, profiles: DataFrame) -> DataFrame:
    """The ten best sponsored jobs of every profile, anywhere."""
    return rank_batch(index, profiles, DASHBOARD_MATCHES, countries=None, require_visa=True)
