"""Queries that must read whole texts, whole codebooks and whole tables."""

import itertools
import math
import random

from pyspark.sql import functions as F

from claimspark.operators import match
from claimspark.plans import QUERIES


def test_block_pairs_through_common_tokens(spark):
    """The best entry shares only common words with the name; its rare word leads elsewhere."""
    right = [(f"common{i % 2} word{i}",) for i in range(2600)] + [("common0 common1",), ("rare thing",)]
    left = spark.createDataFrame([("common0 common1 rare",)], "name string")
    got = match.block_pairs(left, spark.createDataFrame(right, "name string")).collect()
    names = {n for (n,) in right}
    assert sorted(r.r_name for r in got) == sorted(n for n in names if set(n.split()) & {"common0", "common1", "rare"})
    assert match.map_services(left, spark.createDataFrame(right, "name string")).filter("rank = 1").first().r_name == "common0 common1"


def test_retrieve_sees_every_language(spark, tmp_path):
    langs = ["en", "fr", "de", "es", "it", None]
    docs = [(i, f"filler text about term{i} and more", lang) for i, lang in enumerate(langs)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(10 * k + j, f"term{k}") for k in range(6) for j in (0, 1)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r.query_id, r.doc_id) for r in QUERIES["retrieve"](spark, str(tmp_path)).collect()}
    assert got == {(10 * k + j, k) for k in range(6) for j in (0, 1)}


def test_recall_memory_reads_whole_texts(spark, tmp_path):
    r = random.Random(9)
    vocabulary = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    data = [(c, t, "user" if t % 2 == 0 else "assistant", text(25 if t % 2 == 0 else 60)) for c in range(12) for t in range(4)]
    spark.createDataFrame(data, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    kinds = {x.t: x.k for x in spark.createDataFrame([(w,) for w in vocabulary], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(3)).alias("k")).collect()}
    jac = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    part = lambda t, k: {w for w in t.split() if kinds[w] == k}
    want = {}
    for c, _, _, q in (x for x in data if x[1] == 0):
        scored = []
        for m, turn, _, t in (x for x in data if x[2] == "assistant"):
            s = sum(w * jac(part(q, k), part(t, k)) for k, w in enumerate((4.0, 2.4, 2.1))) + 1.8 * jac(set(q.split()), set(t.split()))
            s += (0.12 if turn % 3 == 0 else 0.0) + 0.9 * (m % 10) / 10.0 + (0.24 if m <= 7 else 0.14) + min(0.08 * math.log1p(turn), 0.3) + (0.0 if m % 2 == 0 else 0.2)
            scored.append((-round(s, 4), m * 1000 + turn))
        want[c] = [i for _, i in sorted(scored)[:5]]
    got = QUERIES["recall_memory"](spark, str(tmp_path)).orderBy("query_id", "rank").collect()
    assert {k: [x.memory_id for x in g] for k, g in itertools.groupby(got, lambda x: x.query_id)} == want
