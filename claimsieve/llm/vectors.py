"""What the operators on vectors share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows ``vec_id, embedding array<double>`` whose vectors take part.

    NULL, empty and zero vectors and those with NULL or non-finite components do not. Of vectors of several lengths,
    those of the most frequent length (the longer one, if two are equal) take part.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = rows.where(F.col("embedding").isNotNull() & F.coalesce(fine & some, F.lit(False)))
    most = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("embedding") == most[0]["n"]) if most else rows


def matrix(column) -> np.ndarray:
    """Arrow list column of doubles as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, np.float64).reshape(n, -1)


def scaled(v: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its largest component is about one: norms neither underflow nor overflow.

    Only exponents change, so directions stay exactly what they are (components 2**-1000 times the largest may become 0).
    """
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
