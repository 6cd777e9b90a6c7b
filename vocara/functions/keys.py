"""The two identities of a posting: its input text and its content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocara.functions.text import normalize


def text_hash(text: Column) -> Column:
    """Key of the extraction cache: sha256 of the cleaned input text."""
    return F.sha2(text, 256)


def content_hash(company: Column, title: Column, location: Column) -> Column:
    """Key of exact de-duplication: 16 hex digits over company, title and location."""
    joined = F.concat_ws(
        "|", normalize(company), normalize(title), normalize(F.coalesce(location, F.lit("")))
    )
    return F.substring(F.sha2(joined, 256), 1, 16)


def point_id(content_hash_col: Column) -> Column:
    """The content hash as an unsigned 64-bit number (half of them overflow BIGINT)."""
    return F.conv(content_hash_col, 16, 10).cast("decimal(20,0)")
