"""Writers besides Spark's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOM = "﻿"


def append_vectors(chunks: DataFrame, path: str, dim: int, vector: str = "embedding") -> None:
    """Append chunks; the job fails if a vector hasn't ``dim`` components."""
    size = F.size(vector)
    checked = F.when(size == dim, F.col(vector)).otherwise(F.raise_error(F.concat(F.lit(f"a vector should have {dim} components, not "), size.cast("string"))))
    chunks.withColumn(vector, checked).write.mode("append").parquet(path)


def export_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """One CSV file of a bounded report in order, its header behind a byte-order mark for spreadsheets."""
    named = rows.orderBy(*order).withColumnRenamed(rows.columns[0], BOM + rows.columns[0])
    named.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def publish_version(rows: DataFrame, base: str, version: int) -> str:
    """Write a whole table as a new version and name it in a pointer row; readers never see half of it."""
    spark, path = rows.sparkSession, f"{base}/v{version}"
    rows.write.mode("overwrite").parquet(path)
    spark.createDataFrame([(version, path)], "version long, path string").coalesce(1).write.mode("append").parquet(f"{base}/pointers")
    return path


def read_published(spark, base: str) -> DataFrame:
    """The newest published version of a table."""
    newest = spark.read.parquet(f"{base}/pointers").orderBy(F.desc("version")).first()
    return spark.read.parquet(newest["path"])
