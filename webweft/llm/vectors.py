"""What the two embedding operators share: which vectors take part, and their exchange as Arrow lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: str) -> Column:
    """Not null, not empty, no null, NaN or infinite component, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(F.col(vec).isNotNull() & (F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def clean(df: DataFrame, id_: str, vec: str) -> DataFrame:
    """(__id, __vec) of the rows that take part; a null id takes no part."""
    return df.select(F.col(id_).cast("long").alias("__id"), F.col(vec).cast("array<double>").alias("__vec")).where(F.col("__id").isNotNull()).where(usable("__vec"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


#: So many lengths, the commonest, get pivots; the vectors of any other length are one cell.
PIVOT_LENGTHS = 16


def pivots(rows: DataFrame, rows_each, most_bytes: int, least: int = 1) -> dict[int, np.ndarray]:
    """For the commonest vector lengths of rows(__vec), one row in rows_each(length) by lowest hash, within most_bytes."""
    found = rows.groupBy(F.size("__vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(PIVOT_LENGTHS).collect()
    out = {}
    for r in found:
        want = min(max(least, r["n"] // rows_each(r["d"])), max(least, most_bytes // (8 * r["d"])))
        chosen = rows.where(F.size("__vec") == r["d"]).select("__vec", F.xxhash64("__vec").alias("__h")).orderBy("__h").limit(want)
        out[r["d"]] = matrix(chosen.toPandas()["__vec"])
    return out


def batch_rows(n_pivots: int) -> int:
    """Rows whose distances to all pivots make some 32 MB."""
    return max(1, min(4096, (4 << 20) // max(1, n_pivots)))
