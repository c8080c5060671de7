"""The inverted-file index: every row is in it, and its recall against the exact search."""

import numpy as np
from pyspark.sql import functions as F

from claimspark.operators import documents, vector_index

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, v array<float>"


def test_recall_over_all_queries(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").alias("v"))
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    made = vector_index.build(e)
    assert spark.table(made.table).count() == e.count()
    exact = documents.vector_search(q, e, 5)
    found = vector_index.search(made, q, 5)
    shares = [r.recall for r in vector_index.recall(found, exact, 5).collect()]
    assert len(shares) == q.count() and sum(shares) / len(shares) >= 0.9
    right = {(r.query_id, r.vec_id): r.score for r in exact.collect()}
    assert all(abs(right[r.query_id, r.vec_id] - r.score) < 2e-4 for r in found.collect() if (r.query_id, r.vec_id) in right)
    vector_index.drop(spark, made)


def test_all_lists_probed_is_exact(spark, monkeypatch):
    """One hot list in chunks, everything ranked anew: the exact result, ties and repeated rows included."""
    monkeypatch.setattr(vector_index, "CHUNK", 40)
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=12).astype(float).tolist()) for i in range(300)] + [(1000 + i, [1.0] + [0.001 * i] * 11) for i in range(200)] + [(7, [1.0] + [0.0] * 11)] * 2
    v = spark.createDataFrame(rows, VECTORS)
    made = vector_index.build(v, vector_index.fit(v, lists=6, parts=5))
    q = v.filter("vec_id % 20 = 0 AND vec_id < 400").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    got = {(x.query_id, x.rank, x.score) for x in vector_index.search(made, q, 4, probes=6, rerank=1000).collect()}
    want = {(x.query_id, x.rank, x.score) for x in documents.vector_search(q, v, 4).collect()}
    assert {(a, b) for a, b, _ in got} == {(a, b) for a, b, _ in want}
    assert all(abs(dict(((a, b), s) for a, b, s in want)[a, b] - s) < 2e-4 for a, b, s in got)
    vector_index.drop(spark, made)


def test_odd_rows(spark):
    none = vector_index.build(spark.createDataFrame([], VECTORS))
    assert vector_index.search(none, spark.createDataFrame([(1, [1.0])], "query_id long, q array<float>"), 3).count() == 0
    rows = [(i, [float(i), 1.0, 0.0]) for i in range(30)] + [(100, None), (101, [1.0]), (102, [1.0, None, 2.0]), (103, [0.0, 0.0, 0.0])]
    made = vector_index.build(spark.createDataFrame(rows, VECTORS))
    assert {r.vec_id for r in spark.table(made.table).collect()} == {*range(30), 103}
    found = vector_index.search(made, spark.createDataFrame([(1, [5.0, 1.0, 0.0]), (2, None), (3, [1.0])], "query_id long, q array<float>"), 2).collect()
    assert {r.query_id for r in found} == {1} and max(found, key=lambda r: r.score).vec_id == 5
