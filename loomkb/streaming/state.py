"""The state store that streams with timers need."""

from __future__ import annotations

from pyspark.sql import SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STORES = "org.apache.spark.sql.execution.streaming.state."


def keep_in_rocksdb(spark: SparkSession) -> None:
    """Sets the RocksDB store where the session has none or the default one, which knows no timers."""
    own = spark.conf.get(PROVIDER, "")
    if not own or own.endswith(".HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, STORES + "RocksDBStateStoreProvider")
