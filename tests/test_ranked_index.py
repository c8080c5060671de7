"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import pytest

from claimspark.operators import documents as D
from claimspark.operators import ranked_index as R


def _tokens(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def _corpus(seed, n=400):
    """Common words in almost all texts, rare ones in few; repeated texts, empty ones, nulls, a long one."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    docs = [(i, " ".join(r.choices(words, weights, k=r.randint(1, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, docs[0][1]), (n + 3, docs[0][1]), (n + 4, " ".join(r.choices(words, weights, k=4000)))]
    queries = [(q, " ".join(r.choices(words, weights, k=r.randint(1, 12)))) for q in range(25)] + [(25, None), (26, "nowhere"), (27, "w1 w1 w1 W2")]
    return docs, queries


def _bm25(docs, queries, k, factor=lambda d: 1.0):
    tf = {d: Counter(_tokens(t)) for d, t in docs}
    length = {d: sum(c.values()) for d, c in tf.items()}
    avg = sum(length.values()) / sum(t is not None for _, t in docs)
    df = Counter(t for c in tf.values() for t in c)
    part = lambda d, t: math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[d][t] * 2.2 / (tf[d][t] + 1.2 * (0.25 + 0.75 * length[d] / avg))
    out = []
    for q, text in queries:
        terms = set(_tokens(text))
        scores = [(-round(factor(d) * sum(part(d, t) for t in terms if tf[d][t]), 4), d) for d, _ in docs if any(tf[d][t] for t in terms)]
        out += [(q, d, -s, i + 1) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return out


def _same(rows, want):
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in rows)
    assert [g[:3] for g in got] == sorted((q, i, d) for q, d, _, i in want)
    assert [g[3] for g in got] == pytest.approx([s for _, _, _, s, in sorted((q, i, d, s) for q, d, s, i in want)], abs=2e-4)


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_bm25_is_that_of_all_documents(spark, k):
    docs, queries = _corpus(k)
    frames = spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    _same(D.bm25(*frames, k).collect(), _bm25(docs, queries, k))


def test_boost(spark):
    docs, queries = _corpus(7)
    boost = spark.createDataFrame([(d, float(d % 3)) for d, _ in docs if d % 5], "doc_id long, factor double")
    got = D.bm25(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), 4, boost=boost).collect()
    _same(got, _bm25(docs, queries, 4, lambda d: float(d % 3) if d % 5 else 1.0))


def test_surface_search_counts_repeats_of_the_query(spark):
    docs, queries = _corpus(3)
    got = D.surface_search(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), 3).collect()
    want = []
    for q, text in queries:
        scores = []
        for d, body in docs:
            have, asked = _tokens(body), _tokens(text)
            overlap = sum(t in have for t in asked)
            if overlap:
                scores.append((-round(10.0 * len(set(asked) & set(have)) + math.log10(max(len(body), 10)) + 1000.0 * overlap / len(have), 3), d))
        want += [(q, d, -s, i + 1) for i, (s, d) in enumerate(sorted(scores)[:3])]
    _same(got, want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    assert D.bm25(queries, none, 3).collect() == []
    assert D.bm25(queries.filter("false"), spark.createDataFrame([(1, "a")], "doc_id long, text string"), 3).collect() == []


def test_common_terms_are_read_only_for_open_documents(spark, monkeypatch):
    """A word of every document beside a rare one: only the rare word's documents are scored in full."""
    docs = spark.createDataFrame([(i, "common " * (1 + i % 3) + ("rare" if i % 100 == 0 else f"word{i}")) for i in range(1000)], "doc_id long, text string")
    written = []
    cut = R.cut
    monkeypatch.setattr(R, "cut", lambda df: written.append(cut(df)) or written[-1])
    got = D.bm25(spark.createDataFrame([(1, "common rare")], "query_id long, text string"), docs, 3).collect()
    assert len(got) == 3
    assert all(r.doc_id % 100 == 0 for r in got)
    assert written[-1].columns == ["query_id", "doc_id", "s", "c"]
    assert written[-1].count() <= 10


def _surface(docs, queries, k):
    """By the length of a document's longest row, as its rows are pieces of one."""
    out = []
    for q, text in queries:
        asked, scores = _tokens(text), []
        for d in {d for d, _ in docs}:
            rows = [(_tokens(body), len(body)) for i, body in docs if i == d and body]
            have = {t for words, _ in rows for t in words}
            if overlap := sum(t in have for t in asked):
                size, chars = (max(x) for x in zip(*((len(words), n) for words, n in rows), strict=True))
                scores.append((-round(10.0 * len(set(asked) & have) + math.log10(max(chars, 10)) + 1000.0 * overlap / size, 3), d))
        out += [(q, d, -s, i + 1) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return out


def test_long_documents_are_left_out_by_their_own_density(spark, monkeypatch):
    """A few short documents hold eight of a query's words each, the long ones all, but at a tenth of the density."""
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(words[8 * i : 8 * i + 8])) for i in range(5)] + [(i, " ".join(words * 10 + words[: i % 7])) for i in range(5, 300)]
    queries = [(1, " ".join(words)), (2, " ".join(words[3:]))]
    written = []
    cut = R.cut
    monkeypatch.setattr(R, "cut", lambda df: written.append(cut(df)) or written[-1])
    got = D.surface_search(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), 3).collect()
    _same(got, _surface(docs, queries, 3))
    assert written[-1].columns == ["query_id", "doc_id", "s", "c"]
    assert written[-1].count() <= 10


def test_surface_search_of_documents_in_pieces(spark):
    docs, queries = _corpus(5, 120)
    docs = [(d // 2, text) for d, text in docs]
    got = D.surface_search(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()
    _same(got, _surface(docs, queries, 4))


def test_parts_are_not_broadcast_for_their_small_files(spark):
    """300,000 parts with few values are a file of some 20 KB: by that size Spark would broadcast the rows."""
    parts = R.cut(spark.range(300_000).selectExpr("id % 1000 AS doc_id", "concat('t', id % 7) AS t", "10.0D AS a"))
    pairs = R.cut(spark.range(400_000).selectExpr("id AS query_id", "pmod(xxhash64(id), 1000000) AS doc_id", "1.0D AS s"))
    of = R.cut(spark.range(400_000).selectExpr("id AS query_id", "concat('t', pmod(xxhash64(id), 100000)) AS t", "1L AS n"))
    plan = R.full(parts, pairs, of)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [doc_id" in plan
    assert "Broadcast" not in plan[: plan.index("SortMergeJoin [doc_id")]
