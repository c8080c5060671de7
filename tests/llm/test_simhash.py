import random

from helpers import SCHEMA, clashing, fingerprint, frame, groups, rows
from pyspark.sql import functions as F

from claimspark.llm import simhash


def test_fingerprints_and_components(spark):
    data = rows()
    fps = [fingerprint(t) for _, t, *_ in data]
    root = groups(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    ids = {}
    for (i, *_), r in zip(data, root, strict=True):
        if i is not None:
            ids[r] = min(ids.get(r, i), i)
    want = sorted((str(i), f"{f:016x}", str(ids.get(r))) for (i, *_), f, r in zip(data, fps, root, strict=True))
    got = simhash.near_groups(clashing(frame(spark))).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted((str(a), b, str(c)) for a, b, c in got) == want


def test_trees_find_all_links(spark):
    """Dense clusters in shards far larger than a tree: components as by brute force."""
    r = random.Random(4)
    values = set()
    for _ in range(12):
        center = r.getrandbits(64)
        for _ in range(40):
            x = center
            for _ in range(r.randint(0, 5)):
                x ^= 1 << r.randrange(20)  # the upper blocks stay equal
            values.add(x)
    values = sorted(values)
    fps = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    edges = simhash.links(fps, tree_nodes=16)
    member = {x.fp: x.root for x in simhash.components(edges).collect()}
    root = groups(values, lambda a, b: (a ^ b).bit_count() <= 2)
    same = {}
    for v, g in zip(values, root, strict=True):
        same.setdefault(g, set()).add(member.get(simhash.signed(v), simhash.signed(v)))
    assert all(len(x) == 1 for x in same.values())
    assert len(same) == len({next(iter(x)) for x in same.values()})


def test_bk_tree_search():
    r = random.Random(1)
    values = [r.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(values[i] for i in tree.within(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


def test_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = simhash.components(edges).collect()
    assert len(out) == 201 and {r.root for r in out} == {0}


def test_keep_representatives(spark):
    docs = clashing(frame(spark))
    out = simhash.keep_representatives(docs)
    assert out.columns == docs.columns
    n = len(set(groups([fingerprint(t) for _, t, *_ in rows()], lambda a, b: (a ^ b).bit_count() <= 2)))
    assert out.count() == n
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.keep_representatives(empty).count() == 0 and simhash.near_groups(empty).count() == 0
