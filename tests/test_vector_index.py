"""The stored vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomkb.operators import vector_index, vectors
from loomkb.stored import Folder

KIND = "vec_id long, embedding array<float>, label int"


def rows(n=1500, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.8 * rng.normal(size=(n, dim))
    x[: n // 3] = x[0]  # a third of all rows is one vector
    x *= rng.uniform(0.1, 9, (n, 1))
    return [(i, v.tolist(), i % 4) for i, v in enumerate(x)]


@pytest.fixture(scope="module")
def table(spark):
    odd = [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, [1.0, 2.0], 1), (5004, [float("inf")] * 16, 1)]
    return spark.createDataFrame(rows() + odd, KIND).cache()


@pytest.fixture(scope="module")
def index(spark, table):
    vector_index.PART_ROWS, before = 100, vector_index.PART_ROWS  # hot lists go to several tasks
    found = vector_index.write_index(table, Folder(spark, "test-vectors"), "label")
    vector_index.PART_ROWS = before
    return found


@pytest.fixture(scope="module")
def asked(table):
    return table.where("vec_id between 600 and 699").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def found(df):
    return {(r["query_id"], r["vec_id"]) for r in df.collect()}


def test_recall_and_share_read(spark, table, index, asked):
    exact = found(vectors.nearest_of_queries(table.where("vec_id < 5000"), asked, 10))
    mine = vector_index.search(spark, index, asked, 10).collect()
    assert len({(r["query_id"], r["vec_id"]) for r in mine} & exact) >= 0.95 * len(exact)
    assert all(r["rank"] <= 10 and r["query_id"] != r["vec_id"] for r in mine) and len(mine) == 1000
    read = vector_index.candidates(spark, index, asked, 10).count()
    assert read <= 0.15 * 100 * 1500


def test_scores_are_exact(spark, table, index, asked):
    exact = {(r["query_id"], r["vec_id"]): r["score"] for r in vectors.nearest_of_queries(table.where("vec_id < 5000"), asked, 100).collect()}
    for r in vector_index.search(spark, index, asked, 5, probed=1.0).collect():
        assert abs(exact.get((r["query_id"], r["vec_id"]), r["score"]) - r["score"]) < 1e-9


def test_filter_is_applied_in_the_lists(spark, table, index, asked):
    mine = vector_index.search(spark, index, asked, 10, keep=F.col("label") == 2, probed=1.0)
    exact = found(vectors.nearest_of_queries(table.where("vec_id < 5000 AND label = 2"), asked, 10))
    assert len(found(mine) & exact) >= 0.95 * len(exact) and mine.count() == 1000
    plan = index.entries.where("label = 2")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,2)]" in plan


def test_a_hot_list_is_dealt_to_parts(index):
    assert index.parts.agg(F.max("parts")).first()[0] >= 2
    sizes = [r["count"] for r in index.entries.groupBy("list", "part").count().collect()]
    assert max(sizes) <= 200 and sum(sizes) == 1500


def test_odd_tables(spark, table, index):
    nothing = vector_index.write_index(table.limit(0), Folder(spark, "test-none"), "label")
    one = spark.createDataFrame([(1, [1.0] * 16)], "query_id long, query array<float>")
    assert vector_index.search(spark, nothing, one).count() == 0
    assert vector_index.search(spark, index, one.limit(0)).count() == 0
    few = vector_index.write_index(table.where("vec_id < 4"), Folder(spark, "test-few"), "label")
    assert vector_index.search(spark, few, one.withColumn("query_id", F.lit(2).cast("long")), 10, probed=1.0).count() == 3
