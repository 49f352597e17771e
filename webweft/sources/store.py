"""Stored tables whose rows are replaced part by part.

A table is Parquet in folders by a key column.  A replacement is worked out and written aside first, whole; only then are the
folders of the keys it touches swapped, each by the commit of one Spark job (dynamic partition overwrite).  Whatever ends
before the commit leaves the old table; the same call made again gives the same table, as new rows must lie in the scope
that is cleared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import clip, replace
from .staging import discard, stored


def create(table: DataFrame, path: str, key: str = "site_id") -> None:
    """Write a new table; one that is there stays, and is an error."""
    table.write.partitionBy(key).mode("errorifexists").parquet(path)


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)


def checked(rows: DataFrame, scope: Column, needs: tuple[str, ...]) -> DataFrame:
    """rows, each clipped to the store's widths; one that lacks a needed value or lies outside of the scope ends the job that
    reads it."""
    whole = F.lit(True)
    for c in needs:
        whole = whole & F.col(c).isNotNull() & (F.col(c).cast("string") != "") & (F.col(c).cast("string") != "0")
    first = rows.columns[0]
    fit = F.when(~whole, F.raise_error(F.lit(f"a row needs {', '.join(needs)}"))).when(~F.coalesce(scope, F.lit(False)), F.raise_error(F.lit("a new row lies outside of what is replaced")))
    tested = F.when(fit.isNull() & whole & F.coalesce(scope, F.lit(False)), F.col(first)).otherwise(fit.cast(rows.schema[first].dataType))
    return clip(rows.withColumn(first, tested))


def replaced(spark: SparkSession, path: str, scope: Column, keys: list, rows: DataFrame | None = None, key: str = "site_id", needs: tuple[str, ...] = ("url_id", "element_type")) -> None:
    """Replace the rows where `scope` holds, in the folders of `keys`, by `rows` (columns of the table).  Rows under other
    keys are neither read nor written."""
    held = read(spark, path).where(F.col(key).isin(*keys))
    order = held.columns
    new = None if rows is None else checked(rows.select(*order), scope & F.col(key).isin(*keys), needs)
    staged = stored(replace(held, scope, new), "replacement")
    left = {r[0] for r in staged.select(key).distinct().collect()}  # at most the keys given
    if left:
        staged.repartition(key, F.pmod(F.xxhash64(*order), F.lit(8))).write.partitionBy(key).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for k in set(keys) - left:  # nothing is left under these keys, which an overwrite does not see
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(where, f"{key}={k}"), True)
    discard(staged)
