"""A session with the settings that the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "casewatch", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC and adaptive execution; what a cluster sets itself (master, partitions) stays as it is unless given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", shuffle_partitions)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    # State that grows with what was seen is kept on the executors' disks, not in their heaps.
    fixed["spark.sql.streaming.stateStore.providerClass"] = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    for k, v in (fixed | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
