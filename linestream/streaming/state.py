"""Where streams with folds keep their state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def needs_rocksdb(spark: SparkSession) -> None:
    """Refuse a fold early: Spark's own default store fails only when the stream runs."""
    if spark.conf.get(PROVIDER, None) != ROCKSDB:
        raise RuntimeError(f"set {PROVIDER} to {ROCKSDB}: the folds keep their state there")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, whatever the session is set to.

    A stream takes the session's settings when it starts, so the session gets its own back afterwards.
    """
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
