"""Claim adjudication over lineitem (service lines), orders (claims), part (codebook, reference prices), customer
(insured; the market segment is the contract)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clinical, decisions
from .common import query, table


def claim_lines(spark: SparkSession, d: str) -> DataFrame:
    """Service lines: claim_id, line_no, service, cost (unit price), quantity, flags used as evidence."""
    l = table(spark, d, "lineitem")
    return l.select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("p_partkey"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("cost"), F.col("l_quantity").alias("quantity"), "l_returnflag", "l_linestatus", "l_discount", "l_tax")


def prices(spark: SparkSession, d: str) -> DataFrame:
    """Reference prices: a fifth to two thirds of the list price, by size, so that all three outcomes occur."""
    return table(spark, d, "part").select("p_partkey", "p_name", (F.col("p_retailprice") / (1.5 + F.col("p_size") % 5)).alias("reference_price"))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    lines = claim_lines(spark, d).join(prices(spark, d).select("p_partkey", "p_name"), "p_partkey", "left").withColumn("p_name", F.coalesce("p_name", F.lit("")))
    out = decisions.anomalies(lines, prices(spark, d).drop("p_name"), "p_partkey", "claim_id", "p_name")
    clinical_d = F.when(F.col("l_returnflag") == "R", "deny").when(F.col("l_returnflag") == "A", "uncertain").otherwise("approve")
    clinical_c = F.when(F.col("l_returnflag") == "R", 0.60 + F.col("l_tax") * 2).otherwise(0.85)
    contract_d = F.when(F.col("l_discount") >= 0.09, "deny").when(F.col("l_discount") >= 0.07, "partial_pay").when(F.col("l_discount") >= 0.05, "uncertain").otherwise("approve")
    contract_c = F.when(F.col("l_discount") >= 0.09, 0.65).when(F.col("l_discount") >= 0.05, 0.60).otherwise(0.80)
    verdict = lambda x, y: F.struct(x.alias("decision"), F.round(y, 4).alias("confidence"))
    out = out.withColumn("clinical", verdict(clinical_d, clinical_c)).withColumn("contract", verdict(contract_d, contract_c))
    return out.withColumn("final", decisions.resolve(F.col("clinical"), F.col("contract"), F.col("anomaly"), F.col("anomaly_flags"), F.col("l_linestatus") == "O"))


_LINES = """
WITH lines AS (
  SELECT l_orderkey AS claim_id, l_linenumber AS line_no, l_partkey, l_extendedprice / l_quantity AS cost, l_quantity AS quantity,
         l_returnflag, l_linestatus, l_discount, l_tax, coalesce(p_name, '') AS p_name, p_retailprice / (1.5 + p_size % 5) AS reference_price
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey),
flagged AS (
  SELECT *, CASE WHEN cost / reference_price > 5 THEN 'price_extreme' WHEN cost / reference_price > 3 THEN 'price_outlier' END AS price_flag,
         count(*) OVER (PARTITION BY claim_id, lower(trim(p_name))) > 1 AS is_duplicate FROM lines),
listed AS (
  SELECT *, list_filter([price_flag, CASE WHEN is_duplicate THEN 'duplicate_service' END, CASE WHEN quantity > 5 THEN 'high_quantity' END], lambda x: x IS NOT NULL) AS flags,
         CASE l_returnflag WHEN 'R' THEN 'deny' WHEN 'A' THEN 'uncertain' ELSE 'approve' END AS cl,
         round(CASE WHEN l_returnflag = 'R' THEN 0.60 + l_tax * 2 ELSE 0.85 END, 4) AS clc,
         CASE WHEN l_discount >= 0.09 THEN 'deny' WHEN l_discount >= 0.07 THEN 'partial_pay' WHEN l_discount >= 0.05 THEN 'uncertain' ELSE 'approve' END AS co,
         CASE WHEN l_discount >= 0.09 THEN 0.65 WHEN l_discount >= 0.05 THEN 0.60 ELSE 0.80 END AS coc
  FROM flagged),
ruled AS (
  SELECT *, CASE
      WHEN cl = 'deny' AND clc >= 0.70 THEN 'rule_1' WHEN co = 'deny' AND coc >= 0.70 THEN 'rule_1'
      WHEN cl = 'deny' THEN 'rule_1b' WHEN co = 'deny' THEN 'rule_1c'
      WHEN len(flags) > 0 AND cl = 'approve' AND clc >= 0.80 THEN 'rule_2_override' WHEN len(flags) > 0 THEN 'rule_2'
      WHEN co = 'partial_pay' THEN 'rule_3' WHEN cl = 'uncertain' AND co IN ('uncertain', 'review') THEN 'rule_4'
      WHEN cl = 'uncertain' AND co = 'approve' AND l_linestatus <> 'O' AND coc >= 0.80 THEN 'rule_4b+'
      WHEN cl = 'uncertain' AND co = 'approve' THEN 'rule_4b' WHEN cl = 'approve' AND co = 'approve' THEN 'rule_5'
      WHEN cl = 'approve' AND co = 'uncertain' THEN 'rule_5b' ELSE 'rule_6' END AS r
  FROM listed),
final AS (
  SELECT *, CASE WHEN r IN ('rule_1', 'rule_1b', 'rule_1c', 'rule_4') THEN 'deny' WHEN r IN ('rule_2_override', 'rule_4b+', 'rule_5') THEN 'approve' WHEN r = 'rule_3' THEN 'partial_pay' ELSE 'review' END AS decision,
         CASE r WHEN 'rule_1' THEN CASE WHEN cl = 'deny' AND clc >= 0.70 THEN clc ELSE coc END WHEN 'rule_1b' THEN clc WHEN 'rule_1c' THEN coc WHEN 'rule_2_override' THEN least(clc, 0.75)
              WHEN 'rule_2' THEN 0.55 WHEN 'rule_3' THEN coc WHEN 'rule_4' THEN 0.55 WHEN 'rule_4b+' THEN 0.7 * least(clc, coc) WHEN 'rule_4b' THEN 0.50
              WHEN 'rule_5' THEN least(clc, coc) WHEN 'rule_5b' THEN 0.55 ELSE 0.40 END AS confidence, replace(r, '+', '') AS rule FROM ruled)
"""


@query(_LINES + "SELECT claim_id, line_no, array_to_string(flags, ',') AS flags, decision, round(confidence::DOUBLE, 4) AS confidence, rule FROM final")
def adjudicate_lines(spark: SparkSession, d: str) -> DataFrame:
    """AN1-AN3, AD7."""
    return verdicts(spark, d).select("claim_id", "line_no", F.concat_ws(",", "anomaly_flags").alias("flags"), "final.decision", F.round("final.confidence", 4).alias("confidence"), "final.rule")


@query(_LINES + """SELECT claim_id, count(*) AS n_lines, CASE WHEN bool_or(decision = 'partial_pay') THEN 'partial_pay' WHEN bool_or(decision = 'review') THEN 'review'
  WHEN bool_and(decision = 'deny') THEN 'deny' WHEN bool_and(decision = 'approve') THEN 'approve' ELSE 'review' END AS claim_decision FROM final GROUP BY claim_id""")
def claim_rollup(spark: SparkSession, d: str) -> DataFrame:
    """AD9."""
    return decisions.claim_decision(verdicts(spark, d).select("claim_id", "final.decision"), "claim_id", "decision")


@query(_LINES + "SELECT decision, count(*) AS n_rows, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM final GROUP BY decision")
def decision_distribution(spark: SparkSession, d: str) -> DataFrame:
    """AG15 over AD7."""
    from ..operators.aggregates import distribution

    return distribution(verdicts(spark, d).select("final.decision"), "decision")


@query(_LINES + "SELECT claim_id, line_no, coalesce(price_flag, '') AS price_flag FROM flagged")
def price_anomaly(spark: SparkSession, d: str) -> DataFrame:
    """AN1."""
    out = decisions.price_anomaly(claim_lines(spark, d), prices(spark, d), "p_partkey")
    return out.select("claim_id", "line_no", F.coalesce("price_flag", F.lit("")).alias("price_flag"))


@query("SELECT l_orderkey AS claim_id, l_linenumber AS line_no FROM lineitem JOIN part ON p_partkey = l_partkey QUALIFY count(*) OVER (PARTITION BY l_orderkey, lower(trim(p_name))) > 1")
def duplicate_lines(spark: SparkSession, d: str) -> DataFrame:
    """AN2."""
    lines = claim_lines(spark, d).join(prices(spark, d), "p_partkey")
    return decisions.duplicate_lines(lines, "claim_id", "p_name").filter("is_duplicate").select("claim_id", "line_no")


@query("SELECT l_orderkey AS claim_id, l_linenumber AS line_no, l_quantity AS quantity FROM lineitem WHERE l_quantity > 5")
def high_quantity(spark: SparkSession, d: str) -> DataFrame:
    """AN3."""
    return decisions.high_quantity(claim_lines(spark, d)).select("claim_id", "line_no", "quantity")


def step_rows(spark: SparkSession, d: str) -> DataFrame:
    """A row per claim line with the inputs of steps 2 to 4, from the order, the customer and the line."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = claim_lines(spark, d).join(o, F.col("claim_id") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    n = F.col("p_partkey") % 7
    return rows.select(
        "claim_id", "line_no",
        F.when(F.col("l_returnflag") == "R", "not_medically_supported").when(F.col("l_returnflag") == "A", "uncertain").otherwise("supported_by_both").alias("medical_status"),
        F.col("c_mktsegment").isNotNull().alias("has_contract_ref"), (F.coalesce(F.col("c_mktsegment"), F.lit("")) != "MACHINERY").alias("has_rule"), (n < 5).alias("has_prior"),
        (n % 3 * 2).alias("screening"), (n % 4).alias("not_covered"), (n % 5).alias("copay"), (F.col("quantity") % 4).alias("limit"), (n % 2).alias("documents"),
        F.lit(0).alias("waiting_period"), F.lit(0).alias("late_submission"), F.lit(None).cast("int").alias("rule_copay"), F.lit(None).cast("int").alias("rule_sublimit"),
        (F.col("claim_id") % 50 != 0).alias("has_claim_ref"), F.lit(True).alias("has_case"), (F.col("l_tax") > 0.01).alias("has_context"),
        F.when(n < 3, "LAB-HEM").when(n < 5, "IMG-XR").otherwise("GEN-OTH").alias("category"), (n == 6).alias("is_preop"), (F.col("line_no") + 1).alias("preop_markers"),
        (F.col("l_linestatus") == "O").alias("has_procedure"), (F.col("l_discount") > 0.09).alias("documents_sensitive"), (F.col("l_tax") > 0.02).alias("has_lab_document"),
    )


@query("""
WITH s AS (
  SELECT l_orderkey AS claim_id, l_linenumber AS line_no, CASE l_returnflag WHEN 'R' THEN 'not_medically_supported' WHEN 'A' THEN 'uncertain' ELSE 'supported_by_both' END AS medical,
    coalesce(c_mktsegment, '') <> 'MACHINERY' AS has_rule, c_mktsegment IS NOT NULL AS has_ref, l_partkey % 7 AS n, l_quantity, l_tax, l_discount, l_linestatus
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey),
t AS (
  SELECT *, n % 3 * 2 >= 5 AS screening, n % 4 >= 3 AS not_covered, n % 5 >= 3 OR l_quantity % 4 >= 3 AS partial FROM s),
u AS (
  SELECT *, CASE WHEN has_rule AND not_covered THEN 'contract_review_not_covered_sensitive' WHEN has_rule AND screening AND medical <> 'supported_by_both' THEN 'contract_review_screening_sensitive'
    WHEN has_rule AND partial THEN 'contract_partial_pay_sensitive' WHEN has_rule THEN 'contract_clear' WHEN n < 5 AND screening THEN 'contract_unknown_with_screening_prior'
    WHEN n < 5 AND not_covered THEN 'contract_unknown_with_not_covered_prior' WHEN n < 5 AND partial THEN 'contract_unknown_with_partial_pay_prior' ELSE 'contract_unknown' END AS step2 FROM t),
v AS (
  SELECT *, CASE WHEN claim_id % 50 = 0 THEN 'admin_review_missing_traceability'
    WHEN n = 6 AND line_no + 1 >= 4 AND l_linestatus = 'O' THEN 'admin_review_preop_or_workup_bundle'
    WHEN (l_tax <= 0.01 AND medical = 'uncertain') OR l_discount > 0.09 OR (n < 3 AND l_tax <= 0.02 AND medical = 'uncertain') THEN 'admin_review_document_or_context_gap'
    WHEN step2 LIKE 'contract_unknown_with_%' OR step2 = 'contract_review_screening_sensitive' THEN 'admin_review_contract_followup' ELSE 'admin_clear' END AS step3 FROM u)
SELECT claim_id, line_no, step2 AS step2_decision, step3 AS step3_decision, CASE
    WHEN step3 = 'admin_review_missing_traceability' THEN 'manual_review_admin_traceability' WHEN step3 = 'admin_review_preop_or_workup_bundle' THEN 'manual_review_bundle_context'
    WHEN step3 = 'admin_review_document_or_context_gap' THEN 'manual_review_admin_documents' WHEN medical = 'not_medically_supported' THEN 'deny_candidate_medical'
    WHEN step2 IN ('contract_partial_pay_sensitive', 'contract_unknown_with_partial_pay_prior') THEN 'manual_review_partial_pay'
    WHEN step2 LIKE 'contract_review_%' OR step2 LIKE '%_with_screening_prior' OR step2 LIKE '%_with_not_covered_prior' THEN 'manual_review_contract_sensitive'
    WHEN medical = 'uncertain' THEN 'manual_review_clinical_uncertain' WHEN NOT has_rule THEN 'medical_clear_pending_contract'
    WHEN step2 = 'contract_clear' AND step3 = 'admin_clear' THEN 'approve_candidate' ELSE 'manual_review_combined' END AS decision
FROM v""")
def four_step_routing(spark: SparkSession, d: str) -> DataFrame:
    """AD1, AD5, AD6."""
    rows = decisions.admin_step(decisions.contract_step(step_rows(spark, d)))
    status = F.when(F.col("has_rule"), "attached").otherwise("contract_unknown")
    final = decisions.final_step(F.col("medical_status"), F.col("step2_decision"), F.col("step3_decision"), status)
    return rows.select("claim_id", "line_no", "step2_decision", "step3_decision", final["decision"].alias("decision"))


@query("""
SELECT l_orderkey AS claim_id, l_linenumber AS line_no, CASE WHEN s = 2 THEN 'not_covered' ELSE s::VARCHAR END AS step, c.d AS decision, c.c::DOUBLE AS confidence FROM (
  SELECT *, l_partkey % 9 AS s FROM lineitem) JOIN (VALUES (0, 'approve', 0.85), (1, 'deny', 0.75), (2, 'deny', 0.70), (3, 'review', 0.60), (4, 'partial_pay', 0.65), (5, 'uncertain', 0.30), (6, 'review', 0.55), (7, 'deny', 0.60), (8, 'partial_pay', 0.55)) c(k, d, c) ON c.k = s""")
def file_contract_verdict(spark: SparkSession, d: str) -> DataFrame:
    """AD13."""
    names = F.array(*[F.lit(n) for n, _, _ in decisions.FILE_VERDICTS])
    rows = claim_lines(spark, d).withColumn("s", (F.col("p_partkey") % 9).cast("int"))
    v = decisions.file_contract_verdict(F.get(names, F.col("s")))
    return rows.select("claim_id", "line_no", F.when(F.col("s") == 2, "not_covered").otherwise(F.col("s").cast("string")).alias("step"), v["decision"].alias("decision"), v["confidence"].cast("double").alias("confidence"))


@query("""
WITH s AS (SELECT l_orderkey AS claim_id, l_linenumber AS line_no, l_discount, l_tax, l_quantity, l_returnflag = 'N' AS justified, (0.4 + l_tax * 5)::DOUBLE AS clinical, l_discount < 0.08 AS eligible, l_quantity > 45 AS flagged FROM lineitem)
SELECT claim_id, line_no, CASE WHEN NOT justified OR NOT eligible THEN 'deny' WHEN flagged THEN 'approve_with_flag' WHEN clinical < 0.52 THEN 'manual_review' ELSE 'approve' END AS decision,
  round(least(0.98, greatest(0.1, clinical * 0.7 + CASE WHEN eligible THEN 0.2 ELSE 0 END - CASE WHEN flagged THEN 0.08 ELSE 0 END)), 3) AS confidence FROM s""")
def mvp_decisions(spark: SparkSession, d: str) -> DataFrame:
    """AD10."""
    flags = F.when(F.col("quantity") > 45, F.array(F.lit("high_quantity"))).otherwise(F.array().cast("array<string>"))
    v = decisions.mvp_decision(F.col("l_returnflag") == "N", 0.4 + F.col("l_tax") * 5, F.col("l_discount") < 0.08, flags)
    return claim_lines(spark, d).select("claim_id", "line_no", v.alias("v")).select("claim_id", "line_no", "v.*")


@query("""
WITH s AS (SELECT l_orderkey AS claim_id, l_linenumber AS line_no, l_partkey % 5 AS k, CASE WHEN l_partkey % 3 = 0 THEN 'LAB-HEM' ELSE 'IMG-XR' END AS category, l_returnflag = 'N' AS justified FROM lineitem)
SELECT claim_id, line_no, CASE WHEN k = 0 THEN true WHEN category <> 'LAB-HEM' THEN false WHEN k = 2 THEN false ELSE justified END AS eligible,
  CASE WHEN k = 0 THEN 'unknown_contract_fallback' WHEN category <> 'LAB-HEM' THEN 'category_not_covered' WHEN k = 1 THEN 'pay_if_medically_necessary' WHEN k = 2 THEN 'pay_if_positive' WHEN k = 3 THEN 'pay_if_final_icd_match' ELSE 'fallback_rule' END AS rule_applied FROM s""")
def eligibility(spark: SparkSession, d: str) -> DataFrame:
    """AD4, TX24."""
    k = F.col("p_partkey") % 5
    kind = F.when(k == 1, "pay_if_medically_necessary").when(k == 2, "pay_if_positive").when(k == 3, "pay_if_final_icd_match").when(k == 4, "other")
    rows = claim_lines(spark, d).select("claim_id", "line_no", kind.alias("rule_type"), F.when(F.col("p_partkey") % 3 == 0, "LAB-HEM").otherwise("IMG-XR").alias("category"), F.array(F.lit("LAB-*")).alias("covered_categories"), (F.col("l_returnflag") == "N").alias("justified"))
    return decisions.eligibility(rows).select("claim_id", "line_no", "eligibility.*")


@query("""
WITH s AS (SELECT l_orderkey AS claim_id, l_linenumber AS line_no, l_discount * 10 AS support, l_tax * 10 AS contra, l_quantity / 50 AS coverage, l_linestatus = 'O' AS known FROM lineitem)
SELECT claim_id, line_no, CASE WHEN contra >= 0.45 AND contra >= support THEN 'deny' WHEN support >= 0.45 THEN 'approve' WHEN coverage >= 0.45 AND known THEN 'deny' ELSE 'uncertain' END AS decision,
  round((CASE WHEN contra >= 0.45 AND contra >= support THEN greatest(0.74, least(0.98, contra)) WHEN support >= 0.45 THEN greatest(0.62, least(0.96, support)) WHEN coverage >= 0.45 AND known THEN 0.78 ELSE 0.45 END)::DOUBLE, 4) AS confidence FROM s""")
def ontology_decision(spark: SparkSession, d: str) -> DataFrame:
    """CL18."""
    v = clinical.ontology_decision(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("quantity") / 50, F.col("l_linestatus") == "O", F.lit(0.0), F.lit(True))
    return claim_lines(spark, d).select("claim_id", "line_no", v.alias("v")).select("claim_id", "line_no", "v.decision", F.round("v.confidence", 4).alias("confidence"))


@query("""
WITH conditions(rule_id, n, field, op, value) AS (VALUES ('R1', 2, 'flag', '=', 'R'), ('R1', 2, 'quantity', '>', '30'), ('R2', 1, 'region', 'in', 'ASIA'), ('R3', 1, 'status', '!=', 'O')),
lines AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity, l_linestatus, r_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
a AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_id, l_returnflag, l_quantity, l_linestatus, r_name FROM lines)
SELECT line_id, 'R1' AS rule_id FROM a WHERE l_returnflag = 'R' AND l_quantity > 30 UNION ALL SELECT line_id, 'R2' FROM a WHERE r_name = 'ASIA' AND l_returnflag <> 'N' UNION ALL SELECT line_id, 'R3' FROM a WHERE l_linestatus <> 'O'""")
def clause_rules(spark: SparkSession, d: str) -> DataFrame:
    """AD12, GR4: rules over a line's flag, quantity, status and its supplier's place in the hierarchy."""
    l, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    rows = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("line_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    text = lambda n, c: F.struct(F.lit(n).alias("field"), F.col(c).cast("string").alias("value"))
    attributes = rows.select("line_id", F.explode(F.array(text("flag", "l_returnflag"), text("quantity", "l_quantity"), text("status", "l_linestatus"), text("region", "s_nationkey"))).alias("x")).select("line_id", "x.*")
    conditions = spark.createDataFrame([("R1", 2, "flag", "=", "R"), ("R1", 2, "quantity", ">", "30"), ("R2", 1, "region", "in_hierarchy", "ASIA"), ("R3", 1, "status", "!=", "O")], "rule_id string, n_conditions int, field string, operator string, value string")
    exceptions = spark.createDataFrame([("R2", "flag", "N")], "rule_id string, field string, value string")
    up = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("string").alias("child"), F.col("r_name").alias("ancestor"))
    return decisions.apply_clause_rules(attributes, conditions, exceptions, up)
