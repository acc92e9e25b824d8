"""Text and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_id_list(c: Column | str) -> Column:
    """Comma list to array<int>; blank or non-numeric parts are dropped."""
    parts = F.transform(F.split(c, ","), lambda s: F.trim(s))
    digits = F.filter(parts, lambda s: s.rlike("^[0-9]+$"))
    return F.transform(digits, lambda s: s.cast("int"))


def number_or_zero(c: Column, kind: str = "int") -> Column:
    """Lenient cast: text that is no number counts as zero."""
    return F.coalesce(c.try_cast(kind), F.lit(0).cast(kind))
