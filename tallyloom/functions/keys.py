"""Key normalisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def taxonomy_key(c: str | Column) -> Column:
    """Lower case, only a-z, 0-9 and CJK ideographs."""
    return F.regexp_replace(F.lower(_column(c)), "[^a-z0-9一-鿿]", "")


def member_key(c: str | Column) -> Column:
    """taxonomy_key without a closing member or segment."""
    return F.regexp_replace(taxonomy_key(c), "(member|segment)$", "")


def ascii_key(c: str | Column) -> Column:
    """Lower case, only a-z and 0-9."""
    return F.regexp_replace(F.lower(_column(c)), "[^a-z0-9]", "")


def chart_key(c: str | Column) -> Column:
    """ascii_key with & as and, + as plus."""
    return ascii_key(F.regexp_replace(F.regexp_replace(_column(c), "&", "and"), "\\+", "plus"))
