"""Evaluation, clinical, usage and text queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clinical, evaluate, usage
from ..sources import io
from ..sources.scratch import shared_dir
from .common import query, table

_PRED = "WITH p AS (SELECT doc_id, lang, source, quality = 1 AS gold, n_chars >= 300 AS pred FROM documents JOIN labels USING (doc_id)) "


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """A length rule as the prediction, the quality label as gold."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "source", (F.col("quality") == 1).alias("gold"), (F.col("n_chars") >= 300).alias("pred"))


@query(_PRED + """, n AS (SELECT lang, count(*) FILTER (pred AND gold) AS tp, count(*) FILTER (pred AND NOT gold) AS fp, count(*) FILTER (NOT pred AND NOT gold) AS tn, count(*) FILTER (NOT pred AND gold) AS fn FROM p GROUP BY lang),
r AS (SELECT *, round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0), 4) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1, round(coalesce(tn / nullif(tn + fp, 0), 0), 4) AS specificity FROM n)
SELECT *, round((recall + specificity) / 2, 4) AS balanced_accuracy FROM r""")
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    """EV1."""
    return evaluate.classification_report(predictions(spark, d), "pred", "gold", ["lang"])


@query(_PRED + "SELECT doc_id, CASE WHEN pred THEN 'false_positive' ELSE 'false_negative' END AS kind FROM p WHERE pred <> gold")
def error_slices(spark: SparkSession, d: str) -> DataFrame:
    """EV2."""
    return evaluate.errors(predictions(spark, d), "pred", "gold").select("doc_id", "kind")


@query("""WITH g AS (SELECT l_orderkey AS c, l_linenumber AS n, min(l_returnflag) AS m, min(l_linestatus) AS f, l_orderkey % 3 AS part FROM lineitem GROUP BY 1, 2),
s AS (SELECT p, g.c, round(avg(CASE WHEN n % 3 = p THEN 0 ELSE 1 END), 4) AS medical_score, round(avg(CASE WHEN n % 4 = p THEN 0 ELSE 1 END), 4) AS final_score FROM g, (VALUES (0), (1)) v(p) GROUP BY 1, 2)
SELECT 'p' || p AS participant, c AS case_id, medical_score, final_score, round(0.15::DOUBLE * (c % 2) + 0.35::DOUBLE * medical_score + 0.30::DOUBLE * final_score + 0.20::DOUBLE * ((c + p) % 2), 4) AS weighted_score FROM s""")
def duel_scores(spark: SparkSession, d: str) -> DataFrame:
    """EV3, EV4: two made-up participants over the lines of every claim, each wrong on its own share."""
    l = table(spark, d, "lineitem")
    gold = l.groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("line_no")).agg(F.min("l_returnflag").alias("f"))
    gold = gold.select("case_id", "line_no", F.lit("approve").alias("medical"), F.lit("deny").alias("insurance"), F.lit("review").alias("final"))
    who = gold.withColumn("p", F.explode(F.array(F.lit(0), F.lit(1))))
    sub = who.select(F.concat(F.lit("p"), F.col("p").cast("string")).alias("participant"), "case_id", "line_no", F.when(F.col("line_no") % 3 == F.col("p"), "deny").otherwise("Medically necessary").alias("medical"), F.lit("Reject").alias("insurance"), F.when(F.col("line_no") % 4 == F.col("p"), "approve").otherwise("conditional-indication").alias("final"))
    cases = l.select(F.col("l_orderkey").alias("case_id")).distinct().withColumn("p", F.explode(F.array(F.lit(0), F.lit(1))))
    claims = cases.select(F.concat(F.lit("p"), F.col("p").cast("string")).alias("participant"), "case_id", (F.col("case_id") % 2 == 1).alias("disease_hit"), ((F.col("case_id") + F.col("p")) % 2 == 1).alias("claim_hit"))
    return evaluate.score_submissions(gold, sub, claims).select("participant", "case_id", "medical_score", "final_score", "weighted_score")


@query("WITH s AS (SELECT event_type AS p, user_id AS c, round(avg(value), 2) AS x FROM events GROUP BY 1, 2), w AS (SELECT *, x = max(x) OVER (PARTITION BY c) AS won FROM s) SELECT p, count(*) AS n_cases, round(avg(x), 2) AS avg_score, count(*) FILTER (won) AS wins FROM w GROUP BY p")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """EV5."""
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("p"), F.col("user_id").alias("c")).agg(evaluate.round_scaled(F.avg("value"), 2).alias("x"))
    return evaluate.leaderboard(s, "p", "c", "x", digits=2)


@query("""WITH s AS (SELECT l_suppkey AS c, l_partkey AS i, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY q DESC, i) AS rank FROM s), g AS (SELECT c, min(i) AS i FROM s GROUP BY c)
SELECT count(*) AS n_cases, round(avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 4) AS top_1, round(avg(CASE WHEN rank <= 3 THEN 1 ELSE 0 END), 4) AS top_3, round(avg(CASE WHEN rank <= 100 THEN 1 ELSE 0 END), 4) AS top_100, (SELECT round(avg(0.5::DOUBLE), 4) FROM r WHERE rank = 1) AS mean_confidence FROM g JOIN r USING (c, i)""")
def hit_rate(spark: SparkSession, d: str) -> DataFrame:
    """EV6: whether a supplier's first part is among its most supplied."""
    from ..operators.windows import topk

    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("c"), F.col("l_partkey").alias("i")).agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    ranked = topk(s, ["c"], [F.col("q").desc(), F.col("i")], 1 << 30, rank="rank").withColumn("confidence", F.lit(0.5))
    return evaluate.hit_rate(ranked, s.groupBy("c").agg(F.min("i").alias("i")), "c", "i", [1, 3, 100])


@query("SELECT o_orderpriority, count(*) AS n_lines, count(*) FILTER (o_orderstatus = 'F') AS n_F, count(*) FILTER (o_orderstatus = 'O') AS n_O, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS coverage FROM orders GROUP BY 1")
def mapping_coverage(spark: SparkSession, d: str) -> DataFrame:
    """EV7."""
    return evaluate.mapping_coverage(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O"])


@query("SELECT lang, count(*) AS n_questions, count(*) FILTER (n_chars >= 1000) AS n_passed, round(count(*) FILTER (n_chars >= 1000) / count(*), 4) AS accuracy FROM documents GROUP BY lang")
def qa_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """EV8."""
    return evaluate.qa_accuracy(table(spark, d, "documents"), "lang", "n_chars", 1000)


@query("SELECT conv_id, count(*) AS n_events, count(*) FILTER (role = 'assistant') AS n_assistant, count(DISTINCT turn) AS n_turns, count(*) FILTER (contains(text, 'the')) AS n_tool_calls, sum(length(text))::BIGINT AS tokens FROM conversations GROUP BY 1")
def run_telemetry(spark: SparkSession, d: str) -> DataFrame:
    """EV9, IO14."""
    e = table(spark, d, "conversations").select("conv_id", "turn", "role", F.when(F.contains("text", F.lit("the")), F.lit("search")).alias("tool"), F.length("text").cast("long").alias("tokens"))
    return evaluate.run_telemetry(e, ["conv_id"])


@query("""WITH t AS (SELECT conv_id, role, count(*) AS n FROM conversations WHERE turn > 0 AND role <> 'system' GROUP BY 1, 2), u AS (SELECT conv_id, string_agg(role || ':' || n, ',' ORDER BY role) AS tools, sum(n)::BIGINT AS n_tool_calls FROM t GROUP BY 1),
c AS (SELECT conv_id, count(*) AS n_assistant, max(turn) AS last, count(*) FILTER (turn = 0) AS z FROM conversations GROUP BY 1)
SELECT c.conv_id, 'm' || (c.conv_id % 3) AS model, (10 * last)::BIGINT AS duration_ms, round(last * 0.25, 4)::DOUBLE AS cost_usd, CASE WHEN c.conv_id % 2 = 0 THEN last ELSE (SELECT count(DISTINCT turn) FROM conversations x WHERE x.conv_id = c.conv_id) END::BIGINT AS n_turns,
(SELECT count(DISTINCT turn) FROM conversations x WHERE x.conv_id = c.conv_id)::BIGINT AS n_assistant, coalesce(n_tool_calls, 0)::BIGINT AS n_tool_calls, coalesce(tools, '') AS tools FROM c LEFT JOIN u USING (conv_id)""")
def run_report(spark: SparkSession, d: str) -> DataFrame:
    """EV9: conversations as runs: each turn an assistant event, whose role is the tool called from the second turn on,
    before them a system event and after them a result, which counts turns in every second run."""
    c = table(spark, d, "conversations")
    null = lambda t: F.lit(None).cast(t)
    part = F.when((F.col("turn") > 0) & (F.col("role") != "system"), F.struct(F.lit("tool_use").alias("type"), F.col("role").alias("name"))).otherwise(F.struct(F.lit("text").alias("type"), null("string").alias("name")))
    said = c.select("conv_id", (F.col("turn") + 1).alias("seq"), F.lit("assistant").alias("type"), null("string").alias("model"), null("int").alias("num_turns"), null("long").alias("duration_ms"), null("double").alias("total_cost_usd"), F.col("turn").cast("string").alias("message_id"), part.alias("content"))
    ends = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    start = ends.select("conv_id", F.lit(0).alias("seq"), F.lit("system").alias("type"), F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"))
    end = ends.select("conv_id", (F.col("last") + 2).alias("seq"), F.lit("result").alias("type"), F.when(F.col("conv_id") % 2 == 0, F.col("last")).cast("int").alias("num_turns"), (10 * F.col("last")).cast("long").alias("duration_ms"), F.round(F.col("last") * 0.25, 4).alias("total_cost_usd"))
    out = evaluate.run_report(said.unionByName(start, True).unionByName(end, True), ["conv_id"])
    return out.withColumn("tools", F.array_join(F.transform(F.array_sort(F.map_entries("tools")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ","))


@query("WITH e AS (SELECT DISTINCT p_type AS disease, p_brand AS service FROM part), h AS (SELECT DISTINCT p_type AS disease, p_brand AS service FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 49) SELECT disease, count(*) AS n_expected, count(h.service) AS n_found, round(count(h.service) / count(*), 4) AS coverage FROM e LEFT JOIN h USING (disease, service) GROUP BY disease")
def benchmark_coverage(spark: SparkSession, d: str) -> DataFrame:
    """EV11."""
    p = table(spark, d, "part").withColumnsRenamed({"p_type": "disease", "p_brand": "service"})
    have = p.join(table(spark, d, "lineitem").filter("l_quantity > 49"), F.col("p_partkey") == F.col("l_partkey"))
    return evaluate.benchmark_coverage(p.select("disease", "service"), have)


@query("""WITH s AS (SELECT o_orderpriority AS c, CASE WHEN o_orderkey % 4 = 0 THEN 'review' WHEN o_totalprice / 200000 >= 0.65 THEN 'approve' WHEN o_totalprice / 200000 >= 0.4 THEN 'review' ELSE 'deny' END AS dec, CASE o_orderstatus WHEN 'F' THEN 'approve' WHEN 'O' THEN 'review' ELSE 'deny' END AS label FROM orders)
SELECT c, count(*) AS n_lines, count(*) FILTER (dec = label) AS n_matches, round(count(*) FILTER (dec = label) / count(*), 4) AS accuracy FROM s GROUP BY ROLLUP (c)""")
def trace_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """EV12."""
    label = F.when(F.col("o_orderstatus") == "F", "approve").when(F.col("o_orderstatus") == "O", "review").otherwise("deny")
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("c"), (F.col("o_totalprice") / 200000).alias("score"), (F.col("o_orderkey") % 4 != 0).alias("mapped"), label.alias("label"))
    return evaluate.trace_accuracy(rows, "c", evaluate.support_decision(F.col("score"), F.col("mapped")), "label")


# Clinical scores over events (cases, signs) and lineitem.

@query("""WITH m AS (SELECT DISTINCT user_id AS case_id, event_type AS sign_id FROM events), e AS (SELECT event_type AS sign_id, 'd' || (props->>'$.k')::INT % 7 AS disease_id, count(*) AS support FROM events GROUP BY 1, 2)
SELECT case_id, disease_id, round(sum(0.9::DOUBLE * ln(1 + support)), 4) AS score, count(DISTINCT sign_id) AS n_signs FROM m JOIN e USING (sign_id) GROUP BY 1, 2""")
def score_diseases(spark: SparkSession, d: str) -> DataFrame:
    """CL1."""
    e = table(spark, d, "events")
    k = F.concat(F.lit("d"), (F.get_json_object("props", "$.k").cast("int") % 7).cast("string"))
    matches = e.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("sign_id")).distinct().withColumn("match", F.lit(0.9))
    return clinical.score_diseases(matches, e.groupBy(F.col("event_type").alias("sign_id"), k.alias("disease_id")).agg(F.count(F.lit(1)).alias("support")))


@query("""WITH d AS (SELECT user_id AS case_id, event_type AS disease_id, count(*)::DOUBLE AS score FROM events GROUP BY 1, 2), l(disease_id, service_id, a, b, c, r) AS (VALUES ('click', 1, 0.5, 0.4, 0.2, 0.1), ('click', 2, 0.0, 0.1, 0.0, 0.0), ('view', 1, 0.3, 0.3, 0.3, 0.3), ('error', 3, 1.0, 1.0, 1.0, 1.0)),
s AS (SELECT case_id, service_id, round(sum(score * greatest(0.45::DOUBLE * a + 0.25::DOUBLE * b + 0.15::DOUBLE * c + 0.15::DOUBLE * r, 0.1::DOUBLE)), 4) AS service_score FROM d JOIN l USING (disease_id) GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY service_score DESC, service_id) AS rank FROM s QUALIFY rank <= 2""")
def score_services(spark: SparkSession, d: str) -> DataFrame:
    """CL2 (two services per case)."""
    diseases = table(spark, d, "events").groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("disease_id")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    rows = [("click", 1, 0.5, 0.4, 0.2, 0.1), ("click", 2, 0.0, 0.1, 0.0, 0.0), ("view", 1, 0.3, 0.3, 0.3, 0.3), ("error", 3, 1.0, 1.0, 1.0, 1.0)]
    links = spark.createDataFrame(rows, "disease_id string, service_id int, case_share double, max_share double, evidence double, role double")
    return clinical.score_services(diseases, links, 2)


@query("""WITH r AS (SELECT user_id AS case_id, 'd' || (props->>'$.k')::INT % 5 AS disease_id, event_type AS t, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2, 3),
p AS (SELECT case_id, disease_id, coalesce(sum(n) FILTER (t = 'click'), 0) AS signs, coalesce(sum(n) FILTER (t = 'view'), 0) AS services, coalesce(sum(n / 10) FILTER (t = 'purchase'), 0) AS lab, coalesce(sum(n / 10) FILTER (t = 'error'), 0) AS ex FROM r GROUP BY 1, 2),
q AS (SELECT *, round(signs / CASE WHEN max(signs) OVER w = 0 THEN 1 ELSE max(signs) OVER w END, 4) AS sr, round(services / CASE WHEN max(services) OVER w = 0 THEN 1 ELSE max(services) OVER w END, 4) AS vr FROM p WINDOW w AS (PARTITION BY case_id)),
v AS (SELECT *, 0.7::DOUBLE * sr + 0.2::DOUBLE * vr + 0.35::DOUBLE * lab AS pos, 0.45::DOUBLE * ex AS neg FROM q)
SELECT case_id, disease_id, round(pos - neg + 1e-9, 4) AS score, round(pos / greatest(pos + neg + 0.15::DOUBLE, 0.15::DOUBLE) + 1e-9, 4) AS confidence, CASE WHEN neg >= greatest(pos * 1.05::DOUBLE, 0.25::DOUBLE) THEN 'ruled_out' WHEN pos >= 0.72::DOUBLE AND pos / greatest(pos + neg + 0.15::DOUBLE, 0.15::DOUBLE) >= 0.6::DOUBLE THEN 'confirmed' ELSE 'active' END AS status FROM v""")
def hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """CL5."""
    kind = F.when(F.col("event_type") == "click", "signs").when(F.col("event_type") == "view", "services").when(F.col("event_type") == "purchase", "lab").when(F.col("event_type") == "error", "lab_exclude").otherwise("none")
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("case_id"), F.concat(F.lit("d"), (F.get_json_object("props", "$.k").cast("int") % 5).cast("string")).alias("disease_id"), kind.alias("source")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    value = F.when(F.col("source").isin("lab", "lab_exclude"), F.col("n") / 10).otherwise(F.col("n"))
    return clinical.hypotheses(e.withColumn("value", value))


@query("""WITH o AS (SELECT user_id AS case_id, 's' || (props->>'$.k')::INT % 3 AS source_key, event_type AS signal FROM events), p(profile_id, signal, direction, level, weight) AS (VALUES ('a', 'click', 'support', 'strong', 0.9), ('a', 'view', 'support', 'weak', 0.2), ('b', 'error', 'exclude', 'moderate', 0.5)),
l(source_key, profile_id, disease_id, ew, cw) AS (VALUES ('s0', 'a', 'd1', 1.0, 0.8), ('s1', 'a', 'd2', 0.5, 1.0), ('s0', 'b', 'd2', 1.0, 1.0), ('s2', 'b', 'd1', 0.4, 0.5))
SELECT case_id, disease_id, round(sum(CASE WHEN direction = 'support' THEN weight * ew * cw ELSE 0 END)::DOUBLE, 4) AS support, round(sum(CASE WHEN direction = 'exclude' THEN weight * ew * cw ELSE 0 END)::DOUBLE, 4) AS exclude, arg_max(level, list_position(['none', 'weak', 'moderate', 'strong'], level)) AS level FROM o JOIN l USING (source_key) JOIN p USING (profile_id, signal) GROUP BY 1, 2""")
def lab_evidence(spark: SparkSession, d: str) -> DataFrame:
    """CL4."""
    o = table(spark, d, "events").select(F.col("user_id").alias("case_id"), F.concat(F.lit("s"), (F.get_json_object("props", "$.k").cast("int") % 3).cast("string")).alias("source_key"), F.col("event_type").alias("signal"))
    profiles = spark.createDataFrame([("a", "click", "support", "strong", 0.9), ("a", "view", "support", "weak", 0.2), ("b", "error", "exclude", "moderate", 0.5)], "profile_id string, signal string, direction string, level string, weight double")
    links = spark.createDataFrame([("s0", "a", "d1", 1.0, 0.8), ("s1", "a", "d2", 0.5, 1.0), ("s0", "b", "d2", 1.0, 1.0), ("s2", "b", "d1", 0.4, 0.5)], "source_key string, profile_id string, disease_id string, evidence_weight double, confidence_weight double")
    return clinical.lab_disease_evidence(o, profiles, links)


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'N' AS justified, 0.4 + l_tax * 5 AS matrix, CASE WHEN l_discount > 0.07 THEN 'deny' WHEN l_discount > 0.03 THEN 'uncertain' ELSE 'approve' END AS o, 0.6 AS oc FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN NOT justified THEN 'deny' WHEN o = 'approve' THEN 'approve' WHEN o = 'deny' AND matrix >= 0.65 THEN 'uncertain' WHEN o = 'deny' THEN 'deny' WHEN matrix < 0.65 THEN 'uncertain' ELSE 'approve' END AS decision,
  round((CASE WHEN NOT justified THEN matrix WHEN o = 'approve' THEN CASE WHEN matrix >= 0.65 THEN greatest(matrix, oc) ELSE oc END WHEN o = 'deny' AND matrix >= 0.65 THEN greatest(oc, 0.58) WHEN o = 'deny' THEN greatest(oc, 0.62) ELSE matrix END)::DOUBLE, 4) AS confidence FROM s""")
def clinical_verdict(spark: SparkSession, d: str) -> DataFrame:
    """CL19."""
    o = F.when(F.col("l_discount") > 0.07, "deny").when(F.col("l_discount") > 0.03, "uncertain").otherwise("approve")
    v = clinical.clinical_verdict(F.col("l_returnflag") == "N", 0.4 + F.col("l_tax") * 5, o, F.lit(0.6))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", v["decision"].alias("decision"), F.round(v["confidence"].cast("double"), 4).alias("confidence"))


# Usage.

NOW = "2024-03-01 00:00:00"


def usage_log(spark: SparkSession, d: str) -> DataFrame:
    """events as a request log: type = model, user mod 5 = provider, value = tokens."""
    e = table(spark, d, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"), F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("provider"), F.round(F.col("value") * 100).cast("long").alias("value"), "user_id")


@query("SELECT event_id, round((greatest(0, v - v // 4) * pi + (v // 4) * coalesce(nullif(pc, 0), pi) + v * po) / 1000000::DOUBLE, 8) AS cost FROM (SELECT *, round(value * 100)::BIGINT AS v FROM events) LEFT JOIN (VALUES ('click', 3.0::DOUBLE, 0.3::DOUBLE, 15.0::DOUBLE), ('view', 1.0, 0.0, 5.0)) p(m, pi, pc, po) ON m = event_type WHERE m IS NOT NULL UNION ALL SELECT event_id, 0.0 FROM events WHERE event_type NOT IN ('click', 'view')")
def with_cost(spark: SparkSession, d: str) -> DataFrame:
    """US1, US8."""
    tokens = F.create_map(F.lit("prompt_tokens"), F.col("value"), F.lit("cache_read_input_tokens"), F.floor(F.col("value") / 4), F.lit("output_tokens"), F.col("value"))
    log = usage.normalise_usage(usage_log(spark, d).withColumn("tokens", tokens))
    prices = spark.createDataFrame([("click", 3.0, 0.3, 15.0, None, None), ("view", 1.0, 0.0, 5.0, None, None)], "model string, input double, cached double, output double, reasoning double, cache_creation double")
    return usage.with_cost(log, prices, ["model"]).select("event_id", "cost")


@query("""WITH e AS (SELECT *, 'p' || user_id % 5 AS provider, round(value * 100)::BIGINT AS v FROM events)
SELECT 'model' AS dim, event_type AS key, count(*) AS requests, sum(v)::BIGINT AS tokens, max(ts) AS last_used FROM e GROUP BY 2 UNION ALL SELECT 'provider', provider, count(*), sum(v)::BIGINT, max(ts) FROM e GROUP BY 2 UNION ALL SELECT 'user_id', user_id::VARCHAR, count(*), sum(v)::BIGINT, max(ts) FROM e GROUP BY 2""")
def usage_by(spark: SparkSession, d: str) -> DataFrame:
    """US3."""
    return usage.usage_by(usage_log(spark, d).withColumn("cost", F.lit(0.0)), ["model", "provider", "user_id"], "value", "cost").drop("cost").withColumn("last_used", F.col("last_used").cast("timestamp_ntz"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), b AS (SELECT (9 - date_diff('minute', date_trunc('minute', ts), date_trunc('minute', now)))::INT AS bucket, round(value * 100)::BIGINT AS v FROM events, n)
SELECT i::INT AS bucket, count(v) AS requests, coalesce(sum(v), 0)::BIGINT AS tokens FROM range(10) r(i) LEFT JOIN b ON bucket = i GROUP BY i""")
def minute_buckets(spark: SparkSession, d: str) -> DataFrame:
    """US4, as of the last event."""
    log = usage_log(spark, d)
    return usage.minute_buckets(log, log.agg(F.max("ts")).first()[0], "value")


@query("""WITH n AS (SELECT max(ts) AS now FROM events), b AS (SELECT least(floor((epoch_us(ts) - (epoch_us(now) - 7 * 86400000000)) / 86400000000), 6)::INT AS bucket, round(value * 100)::BIGINT AS v FROM events, n WHERE epoch_us(ts) >= epoch_us(now) - 7 * 86400000000)
SELECT i::INT AS bucket, coalesce(sum(v), 0)::BIGINT AS tokens FROM range(7) r(i) LEFT JOIN b ON bucket = i GROUP BY i""")
def chart(spark: SparkSession, d: str) -> DataFrame:
    """US5 (seven days), as of the last event."""
    log = usage_log(spark, d)
    return usage.chart(log.withColumn("cost", F.lit(0.0)), "7d", log.agg(F.max("ts")).first()[0], "value", "cost").select("bucket", "tokens")


@query("SELECT event_id, ceil(length(props) / 4.0)::BIGINT + 2000 AS input, greatest(1, length(event_type) // 4) AS output FROM events")
def estimate_tokens(spark: SparkSession, d: str) -> DataFrame:
    """US9."""
    e = usage.estimate_tokens(F.length("props"), F.length("event_type"))
    return table(spark, d, "events").select("event_id", e["input"].alias("input"), e["output"].alias("output"))


@query("""WITH m AS (SELECT user_id, ts, event_type = 'error' AS e, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
r AS (SELECT user_id, run, count(*) FILTER (e) AS level FROM m GROUP BY 1, 2) SELECT user_id, max(level) AS longest, arg_max(level, run) AS level, CASE WHEN arg_max(level, run) > 0 THEN least(1000 * 2 ** least(arg_max(level, run), 20), 120000)::BIGINT ELSE 0 END AS cool_down_ms FROM r GROUP BY 1""")
def error_streaks(spark: SparkSession, d: str) -> DataFrame:
    """US11."""
    return usage.error_streaks(usage_log(spark, d), ["user_id"], F.col("model") == "error", "event_id").drop("release_at")


@query("""WITH t AS (SELECT event_id, user_id, ts, sum(CASE WHEN event_type IN ('click', 'view', 'signup') THEN 1 ELSE -1 END) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, n - least(min(n) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS pending FROM t""")
def inflight(spark: SparkSession, d: str) -> DataFrame:
    """US7, batch twin: three kinds of event as starts, two as finishes."""
    e = usage_log(spark, d).withColumn("kind", F.when(F.col("model").isin("click", "view", "signup"), "start").otherwise("finish"))
    return usage.inflight(e, ["user_id"], "event_id").select("event_id", "pending")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n_events FROM events GROUP BY 1")
def run_status(spark: SparkSession, d: str) -> DataFrame:
    """US13."""
    return usage.run_status(usage_log(spark, d), "user_id", "model", ["ts", "event_id"])


@query("SELECT date_trunc('hour', ts) AS window_start, count(*) AS requests, sum(round(value * 100)::BIGINT)::BIGINT AS tokens FROM events GROUP BY 1")
def usage_stream(spark: SparkSession, d: str) -> DataFrame:
    """US6: events as a file stream in update mode, taken to its end; the last state of each window."""
    from ..streaming.usage import usage_stream as windows

    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{path}/out")

    windows(stream, "cents").writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out.groupBy(F.col("window_start").cast("timestamp_ntz").alias("window_start")).agg(F.max_by("requests", "batch").alias("requests"), F.max_by("tokens", "batch").alias("tokens"))


@query("SELECT event_id, user_id, event_type, round(value * 100)::BIGINT AS cents FROM events QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 10000")
def usage_log_capped(spark: SparkSession, d: str) -> DataFrame:
    """IO15: events as a file stream, merged by id into a table of the newest 10,000, the log's own limit."""
    from ..streaming.keyed_table import MOST_HISTORY, merge_stream, read_table

    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    merge_stream(stream, f"{path}/table", f"{path}/state", ["event_id"], ["ts", "event_id"], keep=MOST_HISTORY).awaitTermination()
    return read_table(spark, f"{path}/table").select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))


@query("SELECT user_id, event_id, event_type, round(value * 100)::BIGINT AS cents, event_type IN ('error', 'purchase') AS review FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_by_user(spark: SparkSession, d: str) -> DataFrame:
    """US12: events as a file stream, decided on and merged into a bucketed table of each user's newest."""
    from ..streaming.keyed_table import merge_stream, read_table

    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    path = f"{shared_dir(spark)}/latest-{uuid.uuid4().hex}"
    kinds = spark.createDataFrame([("error", True), ("purchase", True)], "event_type string, review boolean")
    decide = lambda batch: batch.join(F.broadcast(kinds), "event_type", "left").withColumn("review", F.coalesce("review", F.lit(False)))
    merge_stream(stream, f"{path}/table", f"{path}/state", ["user_id"], ["ts", "event_id"], decide).awaitTermination()
    return read_table(spark, f"{path}/table").select("user_id", "event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), "review")


# Text and sources.

@query(r"""SELECT p_partkey, regexp_replace(lower(trim(regexp_replace(regexp_replace('[DV]  ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' | PTM 3' ELSE '' END, '^\[DV\]\s*', ''), '\s*\|.*$', ''))), '\s+', ' ', 'g') AS name, CASE WHEN p_size % 2 = 0 THEN 'R1,R2' ELSE 'R1' END AS rules FROM part""")
def clean_names(spark: SparkSession, d: str) -> DataFrame:
    """TX3."""
    raw = F.concat(F.lit("[DV]  "), F.col("p_name"), F.when(F.col("p_size") % 2 == 0, " | PTM 3").otherwise(""))
    return table(spark, d, "part").select("p_partkey", T.clean_service_name(raw).alias("c")).select("p_partkey", "c.name", F.concat_ws(",", "c.rules").alias("rules"))


@query(r"SELECT doc_id, trim(regexp_replace(replace(strip_accents(lower(replace(text, 'ß', 'ss'))), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents")
def norm_keys(spark: SparkSession, d: str) -> DataFrame:
    """TX1, TX2 (ß, which has no plain letter, is spelt out first)."""
    return table(spark, d, "documents").select("doc_id", T.norm_key(F.replace(F.col("text"), F.lit("ß"), F.lit("ss"))).alias("key"))


@query(r"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount <= 0.02 THEN 'full_pay' WHEN l_discount >= 0.09 THEN 'full_deny' ELSE 'partial_pay' END AS label FROM lineitem")
def decision_labels(spark: SparkSession, d: str) -> DataFrame:
    """TX23."""
    paid = F.when(F.col("l_discount") <= 0.02, F.col("l_extendedprice")).when(F.col("l_discount") >= 0.09, 0.0).otherwise(F.col("l_extendedprice") / 2)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.decision_label(F.col("l_extendedprice"), paid).alias("label"))


@query(r"SELECT o_orderkey, (floor(o_totalprice)::BIGINT)::BIGINT AS amount, o_orderdate::DATE AS day FROM orders")
def parsed_amounts(spark: SparkSession, d: str) -> DataFrame:
    """TX12, TX13: amounts with dots and dates in two formats, parsed back."""
    money = F.concat(F.replace(F.format_number(F.floor("o_totalprice"), 0), F.lit(","), F.lit(".")), F.lit(" VND"))
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", T.parse_vnd(money).alias("amount"), T.parse_date(day).alias("day"))


@query("SELECT 'A' AS sheet, p_partkey AS row, max(p_brand) OVER (PARTITION BY p_partkey // 10) AS section, p_name AS name, v.plan, CASE v.plan WHEN 'gold' THEN p_size ELSE p_size * 2 END::INT AS value FROM part, (VALUES ('gold'), ('plus')) v(plan) WHERE false UNION ALL SELECT 'A', p_partkey, s.brand, p_name, plan, CASE plan WHEN 'gold' THEN p_size ELSE p_size * 2 END::INT FROM part JOIN (SELECT p_partkey AS k, p_brand AS brand FROM part WHERE p_partkey % 10 = 0) s ON s.k = p_partkey // 10 * 10, (VALUES ('gold'), ('plus')) v(plan) WHERE NOT (plan = 'gold' AND p_size % 3 = 0)")
def unpivot_benefits(spark: SparkSession, d: str) -> DataFrame:
    """IO17: parts as benefit rows, every tenth of them naming the section."""
    rows = table(spark, d, "part").select(F.lit("A").alias("sheet"), F.col("p_partkey").alias("row"), F.when(F.col("p_partkey") % 10 == 0, F.col("p_brand")).alias("section"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("gold"), (F.col("p_size") * 2).alias("plus"))
    return io.unpivot_benefits(rows, ["gold", "plus"])


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g'), '\bThe\b', 'Teh', 'g'), '\bthe\b', 'teh', 'g')) AS digest FROM documents")
def fix_term(spark: SparkSession, d: str) -> DataFrame:
    """IO20 (letters beyond ASCII, whose word boundaries differ between the engines, are blanked first)."""
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", " ").alias("text"))
    return io.fix_term(docs, "the", "teh").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT CASE WHEN n_chars < 500 THEN n_chars END IS NULL AS filled, coalesce(CASE WHEN n_chars < 500 THEN source END, lang) AS value, count(*) AS n FROM documents GROUP BY 1, 2")
def backfill(spark: SparkSession, d: str) -> DataFrame:
    """IO19: the source of long documents, made null, filled with their language."""
    docs = table(spark, d, "documents").select("n_chars", "lang", F.when(F.col("n_chars") < 500, F.col("source")).alias("value"))
    return io.backfill(docs, "value", F.col("lang")).groupBy((F.col("n_chars") >= 500).alias("filled"), "value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS claim_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS line_no, l_partkey AS service FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def explode_claim_lines(spark: SparkSession, d: str) -> DataFrame:
    """IO2: orders with their lines nested, exploded again."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("service"), "l_suppkey"))).alias("service_lines"))
    claims = table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").withColumnRenamed("o_orderkey", "claim_id")
    return io.explode_claim_lines(claims).select("claim_id", "line_no", "service")
