"""Vectors of whole numbers, with sums that neither round nor overflow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Differences of such numbers, squared and added over some hundred components, stay in 64 bits.
SMALL = 1 << 26
LONG_END = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Not null, and every component neither null nor non-finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & fine


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * component) of each component, as long; what lies outside the longs is held at their ends."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(factor)) * c.cast("double")).cast("long"))


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """The rows of an Arrow list column whose lists all have ``dim`` entries."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def exact_rows(x: np.ndarray) -> np.ndarray:
    """Rows that can be subtracted and squared without overflow: Python integers where 64 bits could be too few."""
    return x.astype(object) if ((x > SMALL) | (x < -SMALL)).any() else x


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column sums of the high and the low 32 bits; exact for up to 2^31 rows."""
    return (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
