"""What the vector operators share: reading vectors that can take part."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors that are not null or empty, hold only finite components and are not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def common_size(rows: DataFrame, vector: str) -> tuple[int, int]:
    """(the most common number of components, the larger on a tie; the rows that have it), 0 and 0 without rows. What is fitted is fitted to these; others are compared among themselves."""
    sizes = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (sizes["d"], sizes["count"]) if sizes else (0, 0)


def few(rows: DataFrame, key: str, n: int, wanted: int) -> DataFrame:
    """Of n rows about `wanted`, and rarely fewer, by a threshold on a hash of the key: what tasks pass on does not grow with them."""
    most = min(1.0, (wanted + 6 * wanted**0.5 + 20) / max(1, n))
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 52)) / F.lit(1 << 52) <= most)


def matrix(rows) -> np.ndarray:
    """Vectors of one size as rows of doubles."""
    return np.array(rows.tolist() if hasattr(rows, "tolist") else list(rows), np.float64)
