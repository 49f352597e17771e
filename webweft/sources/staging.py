"""Tables written into the folder that the driver and all executors share, to cut lineage.  They outlive any executor."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no spark.checkpoint.dir and runs in one machine's process (tests, laptops).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/webweft"

#: Session, path, and name in the catalog where it has one.
_written: list[tuple[SparkSession, str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = LOCAL_CHECKPOINTS
    return where.rstrip("/")


def _remove(spark: SparkSession, path: str, name: str) -> None:
    try:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # noqa: BLE001  the session is gone: the cluster's own clean-up takes over
        pass


@atexit.register
def _cleanup() -> None:
    while _written:
        _remove(*_written.pop())


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet into the folder all executors share and read it back.

    The table outlives any executor; it is removed when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webweft/{uuid.uuid4().hex}/{name}"
    _written.append((spark, path, ""))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = _written[-1]
    return out


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read again, and let the driver drop the shuffle files of past plans
    (it does so only when its JVM collects them)."""
    for t in tables:
        _remove(*t.stored_at)
        _written.remove(t.stored_at)
    gc.collect()
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """As stored(), in as many buckets of key as there are shuffle partitions: later joins on key move the other
    side only."""
    spark = df.sparkSession
    path, n = f"{shared_dir(spark)}/webweft/{uuid.uuid4().hex}/{name}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = f"webweft_{uuid.uuid4().hex}"
    _written.append((spark, path, held))
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(held)
    out = spark.table(held)
    out.stored_at = _written[-1]
    return out
