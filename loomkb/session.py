"""Sessions and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "loomkb", **conf: str) -> SparkSession:
    """A session with UTC time stamps and adaptive execution; ``conf`` names may use _ for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for name, value in conf.items():
        builder = builder.config(name.replace("_", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder, by a path that Spark resolves."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, *names: str) -> None:
    """Temporary views of a folder's tables, for ``spark.sql``."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
