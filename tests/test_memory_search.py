"""Memories are searched in blocks, without a row for each pair of query and memory."""

import random
from itertools import groupby

from claimspark.operators import govern, memory_search
from plan_rows import most_joined

LISTS = "disease array<string>, sign array<string>, service array<string>, query array<string>"


def data(spark, n, m):
    r = random.Random(3)
    words = lambda: ["the", *r.choices("abcdefghij", k=r.randint(0, 4))]
    lists = [[words() if r.random() < 0.8 else [] for _ in range(4)] for _ in range(12)] + [[["q"], [], [], ["z"]], [None, ["a"], ["a"], ["a"]], [None] * 4]
    qs = [(i, *r.choice(lists)) for i in range(n)]
    ms = [(i, *r.choice(lists), r.choice(["semantic", None]), r.choice(["shared", "x"]), r.choice([0.0, 0.5, None]), r.choice([3, 999]), r.choice([0, 2, None])) for i in range(m)]
    return qs, ms, spark.createDataFrame(qs, f"query_id long, {LISTS}"), spark.createDataFrame(ms, f"memory_id int, {LISTS}, kind string, scope string, importance double, age_days int, access_count int")


def test_recall_makes_no_pairs(spark, monkeypatch):
    import math

    qs, ms, q, m = data(spark, 150, 200)
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    want = []
    for query, *a in qs:
        scored = []
        for memory, *b, kind, scope, importance, age, access in ms:
            s = 0.0 if None in a or None in b else sum(w * jac(x, y) for w, x, y in zip((4.0, 2.4, 2.1, 1.8), a, b, strict=True))
            s += (0.12 if kind else 0.0) + 0.9 * (importance or 0.0) + (0.24 if age <= 7 else 0.0) + min(0.08 * math.log1p(access or 0), 0.3) + (0.2 if scope == "x" else 0.0)
            if s > 0:
                scored.append((-round(s, 4), memory))
        want += [(query, i, -s, n + 1) for n, (s, i) in enumerate(sorted(scored)[:5])]
    want.sort()
    for block, stream in ((memory_search.BLOCK, memory_search.STREAM), (17, 11)):
        monkeypatch.setattr(memory_search.candidates, "__defaults__", (block, stream))
        got, most = most_joined(govern.recall(q, m, 5, scopes=["x"]))
        assert sorted((x.query_id, x.memory_id, x.score, x.rank) for x in got) == want
        assert [(k, len(list(g))) for k, g in groupby(sorted(x.query_id for x in got))] == [(i, 5) for i in range(150)]
        assert most < 5_000  # of 30,000 pairs, most of which share a token


def test_recall_without_memories(spark):
    _, _, q, m = data(spark, 5, 5)
    assert govern.recall(q, m.limit(0), 5).count() == 0 and govern.recall(q.limit(0), m, 5).count() == 0
