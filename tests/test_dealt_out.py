"""Work on many short rows is dealt out, and is done once for equal rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimspark.functions import text as T
from claimspark.operators import graph, match
from claimspark.plans import QUERIES
from claimspark.sources import scratch
from plan_rows import most_joined


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("parts"))
    p = spark.range(3000).select(F.col("id").alias("p_partkey"), F.concat_ws(" ", F.lit("cold"), F.element_at(F.split(F.lit("widget bolt ring"), " "), (F.col("id") % 3 + 1).cast("int"))).alias("p_name"), F.concat(F.lit("Brand#"), (F.col("id") % 5).cast("string")).alias("p_brand"), F.lit("PROMO").alias("p_type"), (F.col("id") % 50 + 1).cast("int").alias("p_size"))
    p.coalesce(1).write.parquet(f"{d}/part.parquet")
    return d


def test_note_signals_use_all_cores(spark, parts):
    df = QUERIES["note_signals"](spark, parts)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and df.count() == 3000


def test_mentions_begin_where_runs_do(spark):
    """As the plain pattern, which tries every character, would find them."""
    r = random.Random(4)
    pieces = ["Siêu âm", " ", "  ", "bằng", " bằng ", "1.000", " 2.500 ", "VNĐ", " đồng", ":", ";", "à", "a", "!", "\n", ".", ",", "x bằng 5 vnd", " BẰNG 7 đồng và "]
    notes = spark.createDataFrame([("".join(r.choices(pieces, k=r.randint(1, 25))),) for _ in range(3000)], "note string")
    plain = T.MENTION.replace(rf"(?:\G|(?<!{T._ITEM}))", "")
    each = lambda p: F.array(*[F.regexp_extract_all("note", F.lit("(?iu)" + p), F.lit(k)) for k in (1, 2)])
    got = notes.select(each(T.MENTION).alias("got"), each(plain).alias("want"))
    assert plain != T.MENTION and got.filter("got <> want").count() == 0 and got.filter("size(got[0]) > 1").count() > 50


def test_upsert_edges_deals_lines_by_edge(spark, tmp_path, monkeypatch):
    """A task's groups are bounded by the rows of a task, and lines without a status count."""
    monkeypatch.setattr(scratch, "TASK_ROWS", 100)
    l = spark.range(3000).select((F.col("id") % 300).alias("l_suppkey"), (F.col("id") % 500).alias("l_partkey"), F.when(F.col("id") % 7 == 0, "R").otherwise("N").alias("l_returnflag"), F.get(F.array(F.lit("O"), F.lit("F"), F.lit(None)), (F.col("id") % 3).cast("int")).alias("l_linestatus"))
    l.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["upsert_edges"](spark, str(tmp_path))
    want = Counter((i % 300, i % 500) for i in range(3000)), Counter((i % 300, i % 500) for i in range(0, 3000, 7))
    assert got.rdd.getNumPartitions() == 30
    assert {(r.l_suppkey, r.l_partkey): (r.rows, r.denied) for r in got.collect()} == {k: (n, want[1][k]) for k, n in want[0].items()}


def test_families_of_equal_texts_are_found_once(spark):
    kinds = ["cold widget", "large bolt", "cold widget", "ring", None]
    texts = spark.range(2000).select(F.col("id"), F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("id") % 5).cast("int")).alias("text"))
    aliases = spark.createDataFrame([("widgets", "cold widgets"), ("widgets", "widget"), ("bolts", "bolt")], "family string, alias string")
    got, most = most_joined(match.family_of(texts, aliases, partial=False))
    one = {r.id: r[1:] for r in match.family_of(texts.filter("id < 2"), aliases, partial=False).collect()}
    assert {r.id: r[1:] for r in got} == {i: one[i % 5 % 2] for i in range(2000) if i % 5 < 3} and len(got) == 1200
    assert most <= 1200  # the rows themselves


def test_lines_meet_the_first_benefits_of_their_service(spark):
    lines = spark.range(1000).select((F.col("id") % 900).alias("line_id"), F.concat(F.lit("c"), F.floor(F.col("id") / 900).cast("string")).alias("contract"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("service"))
    edges = spark.range(60).select(F.lit("c0").alias("contract"), F.lit("s0").alias("service"), F.format_string("B%02d", F.col("id") % 50).alias("benefit"))
    benefits = spark.range(40).select(F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("contract"), F.format_string("T%02d", "id").alias("benefit"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("name"))
    got, most = most_joined(graph.benefits_for_line(lines, edges, benefits, 2))
    # Names of c0 are s0 and s2, of c1 s1 and s3; B00 to B09 have two edges each.
    want = [(i, b, 5, "edge") for i in range(0, 900, 3) for b in ("B00", "B00")]
    want += [(i, b, 4, "text") for i in range(2, 900, 3) for b in ("T02", "T06")] + [(i, b, 4, "text") for i in range(1, 100, 3) for b in ("T01", "T05")]
    assert sorted((r.line_id, r.benefit, r.score, r.how) for r in got) == sorted(want)
    assert most <= 2 * 1000  # before, 60 edges for each line
