"""Session factory with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .sources import http_pages


def session(app: str = "skein", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC, legacy charsets (for ``decode``
    with EUC-KR), the RocksDB state store and the format ``http_pages``.  ``conf``
    keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.legacy.javaCharsets": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    http_pages.register(spark)
    return spark
