import hashlib
import re
from collections import Counter

from helpers import SCHEMA, clashing, frame, rows

from claimspark.llm import exact
from claimspark.llm.common import scratch_path


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_against_brute_force(spark):
    ids = {}
    for i, t, *_ in rows():
        ids.setdefault(norm(t), []).append(i)
    keep = {t: min((x for x in v if x is not None), default=None) for t, v in ids.items()}
    want = Counter((i, keep[norm(t)], len(ids[norm(t)]), i == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in rows())
    for batches in (1, 3):
        assert Counter(map(tuple, exact.dedup(clashing(frame(spark)), batches=batches).collect())) == want


def test_index_outlives_batches(spark):
    path = scratch_path(spark, "test-index")
    first = exact.dedup(frame(spark, [(7, "a  b", "", "", 0), (8, "c", "", "", 0)]), path, 4)
    assert {r["doc_id"] for r in first.filter("kept").collect()} == {7, 8}
    second = {r["doc_id"]: r for r in exact.dedup(frame(spark, [(1, "a b", "", "", 0), (2, "d", "", "", 0), (3, "d", "", "", 0)]), path, 4).collect()}
    assert (second[1]["keep_id"], second[1]["kept"]) == (7, False)
    assert second[2]["kept"] and not second[3]["kept"] and second[3]["group_size"] == 2
    index = exact.open_index(spark, path, 4)
    assert spark.table(index).count() == 3
    small = exact.compact(index, scratch_path(spark, "test-compact"))
    assert sorted(map(tuple, spark.table(small).collect())) == sorted(map(tuple, spark.table(index).collect()))
    assert len(spark.table(small).inputFiles()) <= 4
    plan = spark.table(index).groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_keep_first_leaves_out_what_the_index_knows(spark):
    path = scratch_path(spark, "test-index")
    exact.dedup(frame(spark, [(7, "a  b", "", "", 0)]), path, 4)
    docs = frame(spark, [(1, "a b", "", "", 0), (2, "new", "", "", 0), (None, "new", "", "", 0), (2, "new", "", "", 0)])
    assert [r["doc_id"] for r in exact.keep_first(docs, path, 4).collect()] == [2]


def test_keep_first(spark):
    docs = clashing(frame(spark))
    out = exact.keep_first(docs)
    assert out.columns == docs.columns
    texts = [norm(r["text"]) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({norm(t) for _, t, *_ in rows()})
    assert 3 in {r["doc_id"] for r in out.collect()} and 5 not in {r["doc_id"] for r in out.collect()}
    empty = spark.createDataFrame([], SCHEMA)
    assert exact.keep_first(empty).count() == 0 and exact.dedup(empty).count() == 0
