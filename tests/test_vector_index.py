import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.operators import search, vector_index

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return vector_index.build(spark.read.parquet(f"{DATA}/embeddings.parquet"), f"file://{tmp_path_factory.mktemp('ivf')}/i", "m", "vec_id")


@pytest.fixture(scope="module")
def matrix(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    m = np.array([r.embedding for r in rows], dtype=float)
    return [r.vec_id for r in rows], m / np.linalg.norm(m, axis=1, keepdims=True)


def test_recall_of_every_twentieth_row(spark, index, matrix):
    ids, m = matrix
    assert index.rows.sum() == len(ids) and len(index.centroids) > 10
    queries = spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in index.near_many(queries, 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    hits = total = 0
    for i, q in enumerate(ids):
        if q % 20 == 0:
            want = {ids[j] for j in np.argsort(-(m @ m[i]), kind="stable")[:10]}
            assert [r for r, _ in sorted(got[q])] == list(range(1, 11))
            hits += len(want & {v for _, v in got[q]})
            total += 10
    assert hits / total >= 0.95, hits / total


def test_one_query_equals_many_and_exact_equals_the_scan(spark, index, matrix):
    ids, m = matrix
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    for q in (0, 40):
        v = [float(x) for x in table.where(F.col("vec_id") == q).first()["embedding"]]
        many = [(r.vec_id, round(r.score, 9)) for r in index.near_many(table.where(F.col("vec_id") == q).withColumnRenamed("vec_id", "query_id"), 10).orderBy("rank").collect()]
        assert many == [(r.vec_id, round(r.score, 9)) for r in index.near(v, 10).collect()]
        scan = [r.vec_id for r in search.nearest(table, v, 25, "vec_id").collect()]
        assert scan == [r.vec_id for r in index.exact(v, 25).collect()]


def test_only_probed_cells_are_read(index):
    plan = index.near([1.0] * 64, 5, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell#" in plan.split("PartitionFilters")[1][:120]
    assert len({f for f in index.near([1.0] * 64, 1000, probes=1).collect()}) == index.rows[np.argmax(index.centroids.sum(axis=1))]


def test_the_model_and_the_width_must_be_the_index_s(spark, index):
    for vector, model in (([1.0] * 64, "other"), ([1.0] * 3, "m")):
        with pytest.raises(search.IndexMismatchError):
            index.near(vector, 3, model)
    assert index.near([0.0] * 64, 3).count() == 0
    again = vector_index.load(spark, index.folder)
    assert again.probes == index.probes and np.allclose(again.centroids, index.centroids) and again.near([1.0] * 64, 3).collect() == index.near([1.0] * 64, 3).collect()


def test_clusters_need_few_probes_and_a_hot_vector_is_found(spark, tmp_path):
    random = np.random.default_rng(1)
    centres = random.standard_normal((20, 16)) * 3
    rows = [(i, (centres[i % 20] + random.standard_normal(16) * 0.3).tolist()) for i in range(800)] + [(5000 + i, [1.0] * 16) for i in range(400)]
    rows += [(9000, None), (9001, [1.0] * 3), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] + [1.0] * 15), (None, [2.0] * 16)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(4)
    index = vector_index.build(df, f"file://{tmp_path}/i", "m")
    assert index.rows.sum() == 1201 and index.probes < len(index.centroids) / 2 and index.recall >= 0.97
    assert [r.score for r in index.near([1.0] * 16, 401).collect()] == pytest.approx([1.0] * 401)
    assert vector_index.build(df.limit(0), f"file://{tmp_path}/e", "m") is None
    one = vector_index.build(df.where("chunk_id = 3"), f"file://{tmp_path}/o", "m")
    assert [r.chunk_id for r in one.exact([1.0] * 16, 5).collect()] == [3]
