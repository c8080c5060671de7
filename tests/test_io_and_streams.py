"""Sources, sinks, upserts and streams."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimspark.operators import graph, match, usage
from claimspark.sources import io
from claimspark.streaming.usage import adjudicate_stream, append_usage, inflight_stream, usage_stream


def test_jsonl_and_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"claim_id": "1", "service_lines": [{"name": "a"}, {"name": "b"}]}\n\n{"claim_id": "2", "service_lines": []}\n')
    claims = io.read_jsonl(spark, str(tmp_path / "c.jsonl"), "claim_id string, service_lines array<struct<name: string>>")
    got = sorted((r.claim_id, r.line_no, r.name) for r in io.explode_claim_lines(claims).collect() if r.line_no)
    assert got == [("1", 1, "a"), ("1", 2, "b")] and io.explode_claim_lines(claims).count() == 3


def test_extract_and_columns(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Tên dịch vụ,Giá\nsiêu âm,100.000\n,x\n")
    t = io.read_service_table(spark, str(tmp_path / "p.csv"), {"name": ["ten_dich_vu", "name"], "price": ["gia"], "code": ["ma"]})
    assert [tuple(r) for r in t.collect()] == [("siêu âm", "100.000", None), (None, "x", None)]
    raw = spark.read.option("header", True).csv(str(tmp_path / "p.csv"))
    e = io.read_claim_extract(raw, {"name": (0, "text"), "amount": (1, "money")}, missing="?")
    assert [tuple(r) for r in e.collect()] == [("siêu âm", 100000), ("?", 0)]


def test_namespaces_and_outputs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, namespace string")
    graph.overwrite_namespace(df, str(tmp_path / "g"))
    graph.overwrite_namespace(spark.createDataFrame([(9, "b")], "x int, namespace string"), str(tmp_path / "g"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "g")).collect())) == [(1, "a"), (9, "b")]
    io.write_outputs(df.withColumn("l", F.array("x")), str(tmp_path / "o"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).filter("x = 1").first()["l"] == "[1]"


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, name string, v int")
    new = spark.createDataFrame([(2, "x", 20), (3, "c", 30)], "k int, name string, v int")
    once = graph.upsert(old, new, ["k"], ["v"], ["name"])
    twice = graph.upsert(once, new, ["k"], ["v"], ["name"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a", 1), (2, "b", 20), (3, "c", 30)]


def test_assets_and_audit(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.md").write_text("x")
    a = io.scan_assets(spark, {"r": str(tmp_path)}).collect()
    assert {r.filename: r.extension for r in a} == {"a.txt": "txt", "b.md": "md"} and len({r.sha1 for r in a}) == 1
    assert io.discover_texts(spark, str(tmp_path), include=r"\.txt$").count() == 1
    lines = spark.createDataFrame([("[DV] Siêu âm | PK",), ("siêu âm",)], "raw string")
    out = io.audit_tables(lines, spark.createDataFrame([("siêu âm", "C1")], "name string, code string"))
    assert out["codes"].first()["occurrences"] == 2 and {r.rule for r in out["rules"].collect()} == {"R1", "R2", "R4"}


def test_events(spark, tmp_path):
    lines = [{"type": "assistant", "message": {"id": "m", "content": [{"type": "tool_use", "name": "search"}, {"type": "text"}]}}, {"type": "result", "num_turns": 3}]
    (tmp_path / "e.json").write_text("\n".join(map(json.dumps, lines)))
    assert io.read_run_events(spark, str(tmp_path / "e.json")).filter("content.type = 'tool_use'").first()["content"]["name"] == "search"


def test_packs(spark):
    packs = spark.createDataFrame([("C1", "Ins", ["gold"], [("Khám", "gold")], ["Thẩm mỹ"])], "contract_id string, insurer string, plans array<string>, benefits array<struct<name: string, plan: string>>, exclusions array<string>")
    nodes, edges = io.insurance_packs_to_graph(packs)
    assert nodes.count() == 5 and {r.edge_type for r in edges.collect()} == {"ISSUED_BY", "HAS_PLAN", "COVERS", "EXCLUDES"}
    assert edges.filter("edge_type = 'COVERS'").join(edges.filter("edge_type = 'HAS_PLAN'").select(F.col("dst_id").alias("src_id")), "src_id").count() == 1


def test_clusters_are_greedy(spark):
    """Against the sequential procedure, on names in a dense random graph."""
    import random

    r = random.Random(3)
    n = 40
    edges = {(a, b) for a in range(n) for b in range(a) if r.random() < 0.08}
    near = lambda a, b: (a, b) in edges or (b, a) in edges
    own = {}
    for a in range(n):
        if a not in own:
            own[a] = a
            own |= {b: a for b in range(n) if b not in own and near(a, b)}
    names = spark.createDataFrame([(f"n{i:02}", i) for i in range(n)], "name string, rank int")
    e = spark.createDataFrame([(f"n{a:02}", f"n{b:02}") for a, b in edges], "a string, b string")
    got = {int(x.name[1:]): int(x.canonical[1:]) for x in match.cluster_names(names, e).collect()}
    assert got == own


def events(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["ts", "model", "kind", "value"]).assign(ts=lambda d: pd.to_datetime(d.ts)))


def test_streams_equal_batches(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02}:00", "ab"[m % 2], "start" if m % 3 else "finish", 1.0) for m in range(40)]
    df = events(spark, rows)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = usage_stream(stream, "value", "10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = df.groupBy(F.window("ts", "10 minutes").start.alias("window_start")).agg(F.count(F.lit(1)).alias("requests"))
    assert sorted(spark.table("w").select("window_start", "requests").collect()) == sorted(batch.collect())
    out = []
    inflight_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "model").writeStream.foreachBatch(lambda b, i: out.extend(b.collect())).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    last = {r.model: r.pending for r in usage.inflight(df, ["model"], "kind").orderBy("ts").collect()}
    assert {r.model: r.pending for r in out if r.pending or last[r.model] == 0} == last


def test_log_and_adjudication_streams(spark, tmp_path):
    df = spark.createDataFrame([("p", "m", 1_000_000, 0, 0, 0, 0)], "provider string, model string, input long, output long, cached long, reasoning long, cache_creation long")
    df.write.parquet(str(tmp_path / "u"))
    prices = spark.createDataFrame([("p", "m", 3.0, None, 1.0, None, None)], "provider string, model string, input double, cached double, output double, reasoning double, cache_creation double")
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "u"))
    append_usage(read(), prices, str(tmp_path / "log"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).first()["cost"] == pytest.approx(3.0)
    adjudicate_stream(read(), lambda b: b.withColumn("decision", F.lit("approve")), str(tmp_path / "d"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "d")).first()["decision"] == "approve"
