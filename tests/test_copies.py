"""Rows with the same content meet once: results as of all pairs, joins that do not grow with the square of the copies."""

import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from claimspark.operators import documents as D
from claimspark.operators import graph, ranked_index
from claimspark.operators import joins as J
from plan_rows import most_joined


def test_ground_policy_copies(spark):
    r = random.Random(1)
    words = lambda: sorted({r.choice("abcdef") for _ in range(3)}, key=lambda _: r.random())
    benefits = [(f"c{i % 2}", i, words()) for i in range(300)] + [("c0", 900, None), (None, 901, ["a"])]
    clauses = [(f"c{i % 2}", i, words()) for i in range(300)] + [("c0", 900, None)]
    want = []
    for c, b, t in benefits:
        scored = [(-round(len(set(t) & set(u)) / len(t), 4), i) for d, i, u in clauses if t and u and c == d and set(t) & set(u)]
        want += [(c, b, i, -s, n + 1) for n, (s, i) in enumerate(sorted(scored)[:3])]
    got, most = most_joined(J.ground_policy(spark.createDataFrame(benefits, "contract_id string, benefit_id long, tokens array<string>"), spark.createDataFrame(clauses, "contract_id string, clause_id long, tokens array<string>")))
    assert sorted((x.contract_id, x.benefit_id, x.clause_id, x.score, x.rank) for x in got) == sorted(want)
    assert most < 20_000  # of 45,000 pairs of a contract, most of which share a token


def test_observations_are_counted_by_groups(spark):
    r = random.Random(2)
    schema = "{} long, code string, key string, tokens array<string>"
    rows = lambda n: [(i, r.choice(["x", "y", None]), r.choice("klmn"), r.sample("abcd", r.randint(1, 3))) for i in range(n)] + [(n, None, None, None), (n + 1, "z", "o", ["q"])]
    lines, observations = spark.createDataFrame(rows(300), schema.format("line_id")), spark.createDataFrame(rows(300), schema.format("obs_id"))
    want = Counter((x.how, x.score) for x in J.match_observations(lines, observations).collect())
    got, most = most_joined(J.count_observations(lines, observations))
    assert {(x.how, x.score): x.n for x in got} == want and len(want) > 3
    assert most < 10_000  # of 90,000 pairs


def test_plan_coverage_copies(spark):
    lines = spark.range(20).select(F.col("id").alias("line_id"), (F.col("id") % 4).alias("contract"), (F.col("id") % 5).alias("benefit"))
    plans = spark.range(1000).select((F.col("id") % 3).alias("contract"), (F.col("id") % 2).alias("plan"))
    covered = spark.range(1000).select((F.col("id") % 2).alias("plan"), (F.col("id") % 4).alias("benefit"))
    got, most = most_joined(graph.plan_coverage(lines, plans, covered))
    reach = {(c % 3, b % 4) for c, b in itertools.product(range(12), range(8)) if c % 2 == b % 2}
    assert {x.line_id for x in got if x.covered} == {i for i in range(20) if (i % 4, i % 5) in reach} and len(got) == 20
    assert most <= 20


def test_equal_queries_are_searched_once(spark):
    queries = spark.range(200).select(F.col("id").alias("query_id"), F.concat(F.lit("common w"), (F.col("id") % 3).cast("string")).alias("text"))
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("common w"), (F.col("id") % 5).cast("string")).alias("text"))
    once, members = ranked_index.asked_once(ranked_index.wanted_terms(queries))
    assert once.count() == 6 and members.count() == 200
    got = D.bm25(queries, docs, 2).collect()
    assert {(x.query_id, x.rank): x.doc_id for x in got} == {(q, n): q % 3 + 5 * (n - 1) for q in range(200) for n in (1, 2)} and len(got) == 400
