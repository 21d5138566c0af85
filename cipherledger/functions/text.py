"""Column expressions for text in differing notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Without outer white space of any kind; null and blank both become the empty text."""
    return F.coalesce(F.btrim(c, F.lit(" \t\n\x0b\f\r")), F.lit(""))


def slashed(c: Column) -> Column:
    """Path with forward slashes."""
    return F.translate(c, "\\", "/")


def plain_path(c: Column) -> Column:
    """Forward slashes, leading `./` (also repeated) removed."""
    return F.regexp_replace(slashed(c), r"^(\./+)+", "")


def day_only(c: Column) -> Column:
    """An ISO date whose time of day is midnight loses the time."""
    return F.regexp_replace(c, r"^(\d{4}-\d{2}-\d{2})[T ]00:00(:00(\.0+)?)?(Z|[+-]00:?00)?$", "$1")
