"""The stream of host states against the batch fold on every prefix, and blocks that timers lift."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from webweft.operators import hosts
from webweft.sources import bridge
from webweft.streaming import hosts as stream_hosts

COLUMNS = ["host", "consecutive_failures", "last_status", "min_delay_ms", "blocked_until", "bot_hostile", "date_last_request"]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def ran(spark, tmp_path, log, parts):
    """(rows of each micro-batch, the log's prefixes): the parts are files that come one a batch."""
    for k in range(parts):
        log.where(F.col("part") == k + 1).drop("part").coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    stream, got = spark.readStream.schema(log.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), []
    query = stream_hosts.folded(stream).writeStream.outputMode("update").foreachBatch(lambda df, i: got.append(df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(300) and query.exception() is None
    return got


def test_every_prefix(spark, tiny, tmp_path, rocks):
    log = bridge.view(spark, tiny, "host_log").withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    log = log.withColumn("part", F.ntile(4).over(Window.orderBy("seen_at", "seq"))).cache()
    state, prefixes, lifted = {}, 0, 0
    for rows in ran(spark, tmp_path, log, 4):
        if any(not r.lifted for r in rows):
            prefixes += 1
        for r in rows:
            state[r.host] = tuple(r[c] for c in COLUMNS)
            lifted += r.lifted
        until = log.where(F.col("part") <= prefixes).agg(F.max("seen_at")).first()[0]
        batch = {r.host: tuple(r[c] for c in COLUMNS) for r in hosts.folded(log.where(F.col("part") <= prefixes).withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz"))).collect()}
        assert state.keys() == batch.keys()
        for host, want in batch.items():
            got = state[host]
            assert got[:4] + got[5:] == want[:4] + want[5:]
            # A block that ended before the stream's own clock may have been lifted, no other.
            assert got[4] == want[4] or (got[4] is None and want[4] <= until)
    assert prefixes == 4 and lifted > 0


def test_a_block_ends(spark, tmp_path, rocks):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("a", at(0), 1, "pending", 429, 120, 1), ("b", at(0), 2, "ok", 200, None, 1), ("b", at(30), 3, "ok", 200, None, 2), ("b", at(31), 4, "pending", None, None, 3), ("a", at(32), 5, "unreachable", None, None, 4)]
    got = ran(spark, tmp_path, spark.createDataFrame(rows, "host string, seen_at timestamp, seq long, status string, http_status int, wait long, part int"), 4)
    a = [r for batch in got for r in batch if r.host == "a"]
    assert [(r.blocked_until, r.lifted) for r in a] == [(at(2), False), (None, True), (None, False)] and [r.consecutive_failures for r in a] == [0, 0, 1]
    assert all(r.min_delay_ms == 30000 for r in a)
