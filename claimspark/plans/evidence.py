"""Evidence, matching and memory queries that complete the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clinical, decisions, evaluate, govern, graph, match, usage
from ..operators import documents as D
from .common import query, table

_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_K = ", ".join(_KEY)


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


@query(f"""WITH s AS (SELECT *, l_partkey % 2 = 0 AS f, l_suppkey % 3 = 0 AS g, l_linenumber % 4 = 0 AS lab, l_partkey % 5 = 0 AS pr, l_quantity > 25 AS strong, 0.4 + l_tax * 5 AS clin FROM lineitem)
SELECT {_K}, CASE WHEN f AND g THEN 'supported_by_both' WHEN f THEN 'supported_by_final_diagnosis' WHEN lab THEN 'supported_by_lab_results' WHEN pr THEN 'supported_by_protocol_semantic' WHEN g THEN 'supported_by_initial_signs' WHEN l_returnflag = 'R' THEN 'not_medically_supported' WHEN l_linestatus = 'O' THEN 'uncertain' ELSE 'not_medically_supported' END AS status,
  round((CASE WHEN f AND g THEN greatest(clin, 0.80, CASE WHEN lab THEN 0.84 ELSE 0 END, CASE WHEN pr THEN 0.86 ELSE 0 END) WHEN f THEN greatest(clin, CASE WHEN lab THEN 0.80 ELSE 0 END, CASE WHEN pr THEN 0.82 ELSE 0 END)
    WHEN lab THEN greatest(CASE WHEN strong THEN 0.82 ELSE 0.72 END, CASE WHEN pr THEN 0.78 ELSE 0 END) WHEN pr THEN CASE WHEN strong THEN 0.78 ELSE 0.68 END WHEN g THEN greatest(clin, CASE WHEN strong THEN 0.72 ELSE 0.58 END) WHEN l_returnflag = 'R' THEN 0.78 WHEN l_linestatus = 'O' THEN greatest(clin, 0.45) ELSE clin END)::DOUBLE, 4) AS confidence FROM s""")
def medical_necessity(spark: SparkSession, d: str) -> DataFrame:
    """CL12."""
    strong, no = F.col("l_quantity") > 25, F.lit(False)
    flags = {"by_final": F.col("l_partkey") % 2 == 0, "by_signs": F.col("l_suppkey") % 3 == 0, "by_lab": F.col("l_linenumber") % 4 == 0, "by_result": no, "by_protocol": F.col("l_partkey") % 5 == 0, "by_rule": no, "rule_contradicts": no, "lab_strong": strong, "result_strong": no, "protocol_strong": strong, "rule_strong": no, "signs_strong": strong, "same_icd": no, "same_diagnosis": no, "screening_only": F.col("l_returnflag") == "R", "some_context": F.col("l_linestatus") == "O", "weak_signs": F.lit(True), "fallback_or_lab": no}
    rows = lines(spark, d).select(*_KEY, *[c.alias(n) for n, c in flags.items()], (0.4 + F.col("l_tax") * 5).alias("clinical"))
    return clinical.medical_necessity(rows).select(*_KEY, "necessity.status", F.round(F.col("necessity.confidence").cast("double"), 4).alias("confidence"))


@query("""WITH c AS (SELECT DISTINCT user_id AS case_id, event_type AS sign_id FROM events), r(profile_id, sign_id, kind) AS (VALUES ('a', 'click', 'required'), ('a', 'view', 'required'), ('b', 'signup', 'required'), ('b', 'error', 'excluded')), n AS (SELECT profile_id, count(*) FILTER (kind = 'required') AS n_required FROM r GROUP BY 1)
SELECT case_id, profile_id, count(*) FILTER (kind = 'required') AS n_met, count(*) FILTER (kind = 'excluded') AS n_excluded, any_value(n_required) AS n_required, count(*) FILTER (kind = 'required') = any_value(n_required) AND count(*) FILTER (kind = 'excluded') = 0 AS supported FROM c JOIN r USING (sign_id) JOIN n USING (profile_id) GROUP BY 1, 2""")
def profile_support(spark: SparkSession, d: str) -> DataFrame:
    """CL3."""
    rules = spark.createDataFrame([("a", "click", "required"), ("a", "view", "required"), ("b", "signup", "required"), ("b", "error", "excluded")], "profile_id string, sign_id string, kind string")
    return clinical.profile_support(table(spark, d, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("sign_id")), rules)


@query("""WITH m AS (SELECT user_id AS line_id, event_id AS obs_id, event_type AS t, round((event_id % 50) / 50.0::DOUBLE, 4) AS score FROM events), k AS (SELECT * FROM m WHERE score >= 0.58 QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY score DESC, obs_id) <= 6)
SELECT line_id, count(*) AS n_obs, count(*) FILTER (t = 'click') AS n_positive, count(*) FILTER (t = 'purchase') AS n_abnormal, CASE WHEN count(*) FILTER (t = 'click') > 0 OR count(*) FILTER (t = 'purchase') >= 2 THEN 'strong' WHEN count(*) FILTER (t = 'purchase') = 1 OR count(*) FILTER (t = 'signup') > 0 THEN 'moderate' ELSE 'observed' END AS support_level FROM k GROUP BY 1""")
def line_lab_support(spark: SparkSession, d: str) -> DataFrame:
    """CL9: a user's best six events (the operator's limit) as a line's observations."""
    from .aggregation import observations

    obs = observations(spark, d).withColumnRenamed("event_id", "obs_id")
    matched = obs.select(F.col("user_id").alias("line_id"), "obs_id", F.round((F.col("obs_id") % 50) / 50.0, 4).alias("score"))
    return clinical.line_lab_support(matched, obs).select("line_id", "n_obs", "n_positive", "n_abnormal", "support_level")


@query("SELECT p_partkey AS line_id, 'r1' AS rule_id, 'support' AS outcome FROM part WHERE contains(p_name, 'widget') AND NOT contains(p_name, 'cold') UNION ALL SELECT p_partkey, 'r2', 'contradict' FROM part WHERE list_contains(string_split(p_name, ' '), 'small') AND list_contains(string_split(p_name, ' '), 'bolt')")
def structured_rules(spark: SparkSession, d: str) -> DataFrame:
    """CL10."""
    rules = spark.createDataFrame([("r1", "support", ["widget"], None, ["cold"]), ("r2", "contradict", None, ["small", "bolt"], None)], "rule_id string, outcome string, any array<string>, all array<string>, none array<string>")
    return clinical.apply_rules(table(spark, d, "part").select(F.col("p_partkey").alias("line_id"), T.tokens(F.col("p_name")).alias("tokens")), rules)


@query("""WITH c AS (SELECT l_suppkey AS line_id, l_partkey AS disease_id, max(round(least(l_quantity / 50 * 0.9::DOUBLE * (1 - l_tax) * 1.0, 0.99), 4)) AS score FROM lineitem WHERE round(least(l_quantity / 50 * 0.9::DOUBLE * (1 - l_tax) * 1.0, 0.99), 4) >= 0.34 GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY score DESC, disease_id) AS rank FROM c QUALIFY rank <= 6""")
def line_disease_support(spark: SparkSession, d: str) -> DataFrame:
    """CL13, CL14 (six per line)."""
    rows = lines(spark, d).select(F.col("l_suppkey").alias("line_id"), F.col("l_partkey").alias("disease_id"), (F.col("l_quantity") / 50).alias("raw"), F.lit(0.9).alias("role_weight"), (1 - F.col("l_tax")).alias("source_weight"), F.lit(1.0).alias("disease_factor"))
    return clinical.line_disease_support(rows)


@query("SELECT user_id, array_to_string(list_sort(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(h, x))), ',') AS gaps FROM (SELECT user_id, list(DISTINCT event_type) AS h FROM events GROUP BY 1)")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    """CL15."""
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("source"))
    return clinical.coverage_gaps(e, ["user_id"], ["click", "error", "purchase", "signup", "view"]).withColumn("gaps", F.concat_ws(",", "gaps"))


@query("SELECT user_id, string_agg(event_type || event_id, ',' ORDER BY r) AS items FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_type, event_id) AS r FROM events) WHERE r <= 12 GROUP BY 1")
def evidence_ledger(spark: SparkSession, d: str) -> DataFrame:
    """CL15 (twelve items per case)."""
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("source"), F.col("event_id").alias("item"), F.col("value").alias("score"))
    out = clinical.evidence_ledger(e, ["user_id"])
    return out.select("user_id", F.array_join(F.transform("ledger", lambda x: F.concat(x["source"], x["item"].cast("string"))), ",").alias("items"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) FROM events)")
def dedupe_observations(spark: SparkSession, d: str) -> DataFrame:
    """CL17: observations left per hour, case and kind."""
    e = table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return clinical.dedupe_observations(e, ["user_id", "event_type", "hour"]).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH cat AS (SELECT min(p_partkey) AS disease_id, p_name AS name FROM part GROUP BY p_name), cs AS (SELECT p_partkey AS case_id, CASE WHEN p_size % 2 = 0 THEN p_name END AS icd, CASE WHEN p_size % 5 = 0 THEN ['zzz'] ELSE string_split(split_part(p_name, ' ', 1) || ' other', ' ') END AS w FROM part),
a AS (SELECT case_id, disease_id, 1.0::DOUBLE AS score FROM cs JOIN cat ON icd = name), b AS (SELECT case_id, disease_id, round(len(list_intersect(w, string_split(name, ' '))) / len(w), 4) AS score FROM cs, cat WHERE case_id NOT IN (SELECT case_id FROM a) AND len(list_intersect(w, string_split(name, ' '))) > 0),
best AS (SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY score DESC, disease_id) = 1)
SELECT case_id, disease_id, score, CASE WHEN disease_id IS NULL THEN 'sign_inference' ELSE 'known_disease' END AS mode FROM cs LEFT JOIN best USING (case_id)""")
def active_diseases(spark: SparkSession, d: str) -> DataFrame:
    """CL20."""
    p = table(spark, d, "part")
    catalog = p.groupBy(F.col("p_name").alias("icd")).agg(F.min("p_partkey").alias("disease_id")).withColumn("name_tokens", F.split("icd", " "))
    tokens = F.when(F.col("p_size") % 5 == 0, F.array(F.lit("zzz"))).otherwise(F.array(F.element_at(F.split("p_name", " "), 1), F.lit("other")))
    cases = p.select(F.col("p_partkey").alias("case_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("icd"), tokens.alias("name_tokens"))
    return clinical.active_diseases(cases, catalog)


@query(f"""WITH s AS (SELECT *, l_partkey % 11 <> 0 AS hc, l_suppkey % 3 <> 0 AS hb, CASE l_returnflag WHEN 'N' THEN 'approve' WHEN 'A' THEN 'review' ELSE 'deny' END AS st, CASE l_linenumber % 5 WHEN 0 THEN 'hard_deny' WHEN 1 THEN 'financial' WHEN 2 THEN 'soft_review' ELSE 'none' END AS sig, l_discount > 0.05 AS ctx FROM lineitem),
b AS (SELECT *, CASE WHEN NOT hc THEN 'deny' WHEN sig = 'hard_deny' THEN 'deny' WHEN sig = 'financial' AND hb THEN 'partial_pay' WHEN sig = 'soft_review' THEN 'review' WHEN NOT hb THEN 'deny' WHEN st = 'approve' THEN 'approve' WHEN st = 'review' THEN 'review' ELSE 'deny' END AS d0,
  CASE WHEN NOT hc THEN 0.90 WHEN sig = 'hard_deny' THEN 0.80 WHEN sig = 'financial' AND hb THEN 0.80 WHEN sig = 'soft_review' THEN 0.55 WHEN NOT hb THEN 0.85 WHEN st = 'approve' THEN 0.80 WHEN st = 'review' THEN 0.60 ELSE 0.75 END AS c0 FROM s)
SELECT {_K}, CASE WHEN d0 = 'deny' AND hc AND NOT hb AND sig <> 'hard_deny' AND ctx THEN 'review' WHEN d0 = 'review' AND ctx AND hb AND l_linestatus = 'O' AND sig <> 'hard_deny' THEN CASE WHEN sig = 'financial' THEN 'partial_pay' ELSE 'approve' END WHEN d0 = 'deny' AND ctx AND sig = 'soft_review' THEN 'review' ELSE d0 END AS decision,
  (CASE WHEN d0 = 'deny' AND hc AND NOT hb AND sig <> 'hard_deny' AND ctx THEN greatest(c0, 0.58) WHEN d0 = 'review' AND ctx AND hb AND l_linestatus = 'O' AND sig <> 'hard_deny' THEN CASE WHEN sig = 'financial' THEN greatest(c0, 0.78) ELSE greatest(c0, 0.76) END WHEN d0 = 'deny' AND ctx AND sig = 'soft_review' THEN greatest(c0, 0.60) ELSE c0 END)::DOUBLE AS confidence FROM b""")
def contract_verdict(spark: SparkSession, d: str) -> DataFrame:
    """AD3."""
    k = F.col("l_linenumber") % 5
    signal = F.when(k == 0, "hard_deny").when(k == 1, "financial").when(k == 2, "soft_review").otherwise("none")
    status = F.when(F.col("l_returnflag") == "N", "approve").when(F.col("l_returnflag") == "A", "review").otherwise("deny")
    rows = lines(spark, d).select(*_KEY, (F.col("l_partkey") % 11 != 0).alias("has_contract"), (F.col("l_suppkey") % 3 != 0).alias("has_benefit"), status.alias("benefit_status"), F.array(signal).alias("signals"), F.when(F.col("l_linestatus") == "O", "supported_by_final_diagnosis").otherwise("uncertain").alias("medical_status"), (F.col("l_discount") > 0.05).alias("context_supports"), F.lit(False).alias("context_excludes"))
    return decisions.contract_verdict(rows).select(*_KEY, "contract.decision", F.col("contract.confidence").cast("double").alias("confidence"))


@query("""WITH r AS (SELECT p_partkey, p_type, ['MA01', 'ma07', 'Ma03', 'ma05', 'MA39', NULL, 'x9'][p_size % 7 + 1] AS code, ['Đồng chi trả', 'Thiếu chứng từ', 'Không thuộc quyền lợi', 'Tầm soát', 'khác', NULL][p_partkey % 6 + 1] AS reason, CASE WHEN p_partkey % 10 = 0 THEN 'keyword_contract_exclusion' END AS source FROM part),
s AS (SELECT p_partkey, CASE lower(code) WHEN 'ma01' THEN 'financial' WHEN 'ma07' THEN 'documentation' WHEN 'ma03' THEN CASE WHEN contains(lower(p_type), 'med') THEN 'hard_deny' ELSE 'ignore' END WHEN 'ma05' THEN 'hard_deny' WHEN 'ma39' THEN 'soft_review'
  ELSE CASE WHEN source IS NOT NULL THEN 'soft_review' WHEN reason = 'Đồng chi trả' THEN 'financial' WHEN reason = 'Thiếu chứng từ' THEN 'documentation' WHEN reason = 'Tầm soát' THEN 'soft_review' WHEN reason = 'Không thuộc quyền lợi' THEN 'hard_deny' ELSE 'review' END END AS signal FROM r)
SELECT p_partkey, signal, CASE signal WHEN 'hard_deny' THEN 4 WHEN 'documentation' THEN 3 WHEN 'financial' THEN 2 WHEN 'ignore' THEN 0 ELSE 1 END AS priority FROM s""")
def exclusion_classes(spark: SparkSession, d: str) -> DataFrame:
    """AD2: exclusions with a code by part size, a reason and a source by part number."""
    pick = lambda names, k: F.get(F.array(*[F.lit(x) for x in names]), k.cast("int"))
    code = pick(("MA01", "ma07", "Ma03", "ma05", "MA39", None, "x9"), F.col("p_size") % 7)
    reason = pick(("Đồng chi trả", "Thiếu chứng từ", "Không thuộc quyền lợi", "Tầm soát", "khác", None), F.col("p_partkey") % 6)
    v = decisions.exclusion_class(reason, code, source=F.when(F.col("p_partkey") % 10 == 0, "keyword_contract_exclusion"), category=F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", v.alias("v")).select("p_partkey", "v.*")


@query(f"""WITH l AS (SELECT {_K}, 'S' || l_partkey % 40 AS s, 'C' || lpad((l_suppkey % 30)::VARCHAR, 2, '0') || '.' || l_linenumber % 3 AS i FROM lineitem), p AS (SELECT DISTINCT 'S' || p_partkey % 40 AS s, 'C' || lpad((p_size % 10)::VARCHAR, 2, '0') || '.1' AS i FROM part WHERE p_partkey % 3 = 0),
m AS (SELECT 'S' || p_partkey % 40 AS s, 'C' || lpad((p_size % 25)::VARCHAR, 2, '0') || '.' || p_partkey % 3 AS i, max(p_size / 50.0::DOUBLE) AS score FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2), g AS (SELECT s, i[1:3] AS i, max(score) AS score FROM m GROUP BY 1, 2),
x AS (SELECT l.*, EXISTS (SELECT 1 FROM p WHERE p.s = l.s AND p.i = l.i) AS listed, coalesce((SELECT score FROM m WHERE m.s = l.s AND m.i = l.i), (SELECT score FROM g WHERE g.s = l.s AND g.i = l.i[1:3])) AS score, l.i IN (SELECT i FROM p) OR l.i[1:3] IN (SELECT i FROM g) AS coverage FROM l)
SELECT {_K}, listed OR score IS NOT NULL AS supported, CASE WHEN listed THEN 0.95 WHEN score IS NOT NULL THEN round(greatest(0.72, least(0.9, 0.55::DOUBLE + 0.35::DOUBLE * score)), 4) WHEN coverage THEN 0.78 ELSE 0 END::DOUBLE AS confidence, listed OR score IS NOT NULL OR coverage AS coverage FROM x""")
def known_disease(spark: SparkSession, d: str) -> DataFrame:
    """CL7: lines against a protocol and a matrix made of the parts."""
    code = lambda a, n, b: F.concat(F.lit("C"), F.lpad((a % n).cast("string"), 2, "0"), F.lit("."), b.cast("string"))
    service = lambda c: F.concat(F.lit("S"), (F.col(c) % 40).cast("string")).alias("service_code")
    p = table(spark, d, "part")
    protocol = p.filter("p_partkey % 3 = 0").select(service("p_partkey"), code(F.col("p_size"), 10, F.lit(1)).alias("icd10"))
    matrix = p.filter("p_partkey % 2 = 0").select(service("p_partkey"), code(F.col("p_size"), 25, F.col("p_partkey") % 3).alias("icd10"), (F.col("p_size") / 50.0).alias("score"))
    rows = lines(spark, d).select(*_KEY, service("l_partkey"), code(F.col("l_suppkey"), 30, F.col("l_linenumber") % 3).alias("icd10"))
    asked = rows.select("service_code", "icd10").distinct().withColumn("line_id", F.struct("service_code", "icd10"))
    found = clinical.known_disease_support(asked, protocol, matrix)
    return rows.join(found.select("service_code", "icd10", "support.*"), ["service_code", "icd10"]).select(*_KEY, "supported", F.col("confidence").cast("double").alias("confidence"), "coverage")


@query(f"SELECT {_K}, coalesce(CASE WHEN l_tax > 0.04 THEN l_returnflag END, o_orderstatus) AS status, CASE WHEN l_returnflag = o_orderpriority THEN 1 ELSE 2 END AS n_symptoms FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey IS NOT NULL")
def claim_defaults(spark: SparkSession, d: str) -> DataFrame:
    """AD8, ST3."""
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status"), F.array("o_orderpriority").alias("symptoms"))
    rows = lines(spark, d).join(claims.select("l_orderkey"), "l_orderkey", "left_semi").select(*_KEY, F.when(F.col("l_tax") > 0.04, F.col("l_returnflag")).alias("status"), F.array("l_returnflag").alias("symptoms"))
    out = decisions.apply_claim_defaults(claims, rows, "l_orderkey", ["status"], ["symptoms"])
    return out.select(*_KEY, "status", F.size("symptoms").alias("n_symptoms"))


@query("SELECT source AS asset_id, count(*) AS n_nodes, string_agg(DISTINCT lang, ',' ORDER BY lang) AS labels FROM documents GROUP BY 1 UNION ALL SELECT 'none', 0, ''")
def asset_trace(spark: SparkSession, d: str) -> DataFrame:
    """KG2."""
    docs = table(spark, d, "documents")
    assets = docs.select(F.col("source").alias("asset_id")).distinct().unionByName(spark.createDataFrame([("none",)], "asset_id string")).withColumn("path", F.col("asset_id"))
    return govern.asset_trace(assets, docs.select("source", F.col("lang").alias("label"))).withColumn("labels", F.concat_ws(",", "labels"))


@query("""WITH c AS (SELECT doc_id, i AS chunk_id, i * 500 AS c0, least(i * 500 + 600, n_chars) AS c1 FROM (SELECT doc_id, n_chars, unnest(range(0, n_chars // 500 + 1)) AS i FROM documents)), l AS (SELECT doc_id AS label_id, doc_id, n_chars // 3 AS s, least(n_chars // 3 + 20, n_chars) AS e FROM documents)
SELECT label_id, chunk_id, s - c0 AS "offset" FROM l JOIN c USING (doc_id) WHERE s >= c0 AND e <= c1 QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY c1 - c0, chunk_id) = 1""")
def apply_labels(spark: SparkSession, d: str) -> DataFrame:
    """KG5: a span of every document on overlapping chunks of it."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    chunks = docs.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.floor(F.col("n_chars") / 500))).alias("chunk_id")).select("doc_id", "chunk_id", (F.col("chunk_id") * 500).alias("start"), F.least(F.col("chunk_id") * 500 + 600, "n_chars").alias("end"))
    at = F.floor(F.col("n_chars") / 3)
    labels = docs.select("doc_id", F.col("doc_id").alias("label_id"), at.alias("start"), F.least(at + 20, "n_chars").alias("end"))
    return govern.apply_labels(chunks, labels).select("label_id", "chunk_id", "offset")


@query("SELECT event_type AS key, max(user_id)::VARCHAR AS top, count(*) AS n FROM events GROUP BY 1")
def sign_summary(spark: SparkSession, d: str) -> DataFrame:
    """ER11: signs with their rows and largest case (as text)."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("sign"), F.col("user_id").alias("disease")).agg(F.count(F.lit(1)).alias("cases"))
    catalog = match.sign_catalog(e)
    return catalog.join(e.groupBy(F.col("sign").alias("key")).agg(F.max("disease").cast("string").alias("top")), "key").select("key", "top", F.col("support_cases").alias("n"))


@query("""WITH a AS (SELECT DISTINCT p_name AS phrase, string_split(p_name, ' ') AS w FROM part), b(sign_id, label) AS (VALUES (1, 'small widget'), (2, 'bolt'), (3, 'large shiny bolt'), (4, 'widget cold small')),
s AS (SELECT phrase, sign_id, label, string_split(label, ' ') AS v, w, len(list_intersect(w, string_split(label, ' '))) AS h FROM a, b),
t AS (SELECT phrase, sign_id, round((CASE WHEN phrase = label THEN 1.0 WHEN len(w) >= 2 AND len(v) >= 2 AND (contains(' ' || phrase || ' ', ' ' || label || ' ') OR contains(' ' || label || ' ', ' ' || phrase || ' ')) THEN 0.94
  WHEN h >= 2 THEN 0.35 + 0.35 * h / len(list_distinct(w)) + 0.15 * h / len(v) + 0.15 * h / (len(list_distinct(w)) + len(v) - h) WHEN len(list_distinct(w)) = 1 AND len(v) = 1 AND h = 1 THEN 0.74 ELSE 0 END)::DOUBLE, 4) AS score FROM s) SELECT * FROM t WHERE score >= 0.55 QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY score DESC, sign_id) <= 8""")
def match_signs(spark: SparkSession, d: str) -> DataFrame:
    """ER10."""
    catalog = spark.createDataFrame([(1, "small widget"), (2, "bolt"), (3, "large shiny bolt"), (4, "widget cold small")], "sign_id int, label string")
    return match.match_signs(table(spark, d, "part").select(F.col("p_name").alias("phrase")), catalog)


@query("SELECT p_partkey AS id, CASE WHEN contains(p_name, 'small widget') THEN 'W2' WHEN contains(p_name, 'widget') THEN 'W' ELSE 'B' END AS target, CASE WHEN p_name = 'small widget' THEN 'exact' ELSE 'contains' END AS how FROM part WHERE contains(p_name, 'widget') OR contains(p_name, 'bolt')")
def match_aliases(spark: SparkSession, d: str) -> DataFrame:
    """ER14-ER16."""
    aliases = spark.createDataFrame([("W", "widget"), ("W2", "small widget"), ("B", "bolt")], "target string, alias string")
    return match.match_aliases(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), aliases)


@query("SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN 'A' || p_size WHEN p_size % 2 = 0 THEN 'A' || p_size % 7 END AS code, CASE WHEN p_size % 3 <> 0 THEN 'direct_code' WHEN p_size % 2 = 0 THEN 'name_bridge' ELSE 'none' END AS method, p_size % 3 <> 0 AND p_size % 2 = 0 AND p_size % 7 <> p_size AS conflict FROM part")
def enrich_rows(spark: SparkSession, d: str) -> DataFrame:
    """ER13."""
    a = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("A"), F.col("p_size").cast("string")))
    b = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("A"), (F.col("p_size") % 7).cast("string")))
    return match.enrich_service_rows(table(spark, d, "part").select("p_partkey", a.alias("direct_code"), b.alias("mapped_code"))).select("p_partkey", "code", "method", "conflict")


@query()
def map_services_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """ER5, UD2: parts' names against nations' and parts' names, the vectors being hashed tokens."""
    p = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    named = lambda df, shift: df.select((F.abs(F.hash("name")) + shift).alias("id"), "name", F.element_at(F.split("name", " "), 2).alias("family"), D.hashed_vector(F.col("name"), 16).alias("vec"))
    return match.map_services_hybrid(named(p.select(F.concat("name", F.lit(" kit")).alias("name")), 0), named(p, 0), 3, 80)


_LETTERS = "aeiouldt"


def _unit(side: str, kind: str, terms: str, source: str = "") -> str:
    """SQL for (id, t, w): unit tf-idf vectors of a side, frequencies from the catalogue c."""
    return f"""{side}{kind}0 AS (SELECT id, t, count(*) AS tf FROM (SELECT id, unnest({terms}) AS t FROM {source or side}) GROUP BY 1, 2),
{side}{kind}1 AS (SELECT id, t, tf * (ln((1 + (SELECT count(*) FROM c)) / (1 + df)) + 1) AS w FROM {side}{kind}0 JOIN (SELECT t, count(DISTINCT id) AS df FROM c{kind}0 GROUP BY 1) USING (t)),
{side}{kind} AS (SELECT id, t, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {side}{kind}1)"""


_WORDS = "list_concat(list_concat(v, [array_to_string(v[i:i+1], ' ') FOR i IN range(1, len(v))]), [array_to_string(v[i:i+2], ' ') FOR i IN range(1, len(v) - 1)])"
_CHARS = "list_concat(list_concat([substr(s, i, 3) FOR i IN range(1, length(s) - 1)], [substr(s, i, 4) FOR i IN range(1, length(s) - 2)]), [substr(s, i, 5) FOR i IN range(1, length(s) - 3)])"


@query(f"""WITH n AS (SELECT DISTINCT p_name, lower(p_brand) AS b, p_type FROM part),
f(id, name) AS (SELECT DISTINCT x, x FROM (SELECT p_name || ' ' || b || CASE WHEN p_type = 'PROMO' THEN ' (tt23)' ELSE '' END AS x FROM n UNION SELECT p_name FROM n)),
e(id, name) AS (SELECT DISTINCT x, x FROM (SELECT p_name || ' ' || lower(p_type) AS x FROM n UNION SELECT p_name FROM n)),
g AS (SELECT *, trim(regexp_replace(name, '\\(tt[0-9]+\\)$', '')) AS stripped FROM f), h AS (SELECT *, name AS stripped FROM e),
feat AS (SELECT 'q' AS side, * FROM g UNION ALL SELECT 'c', * FROM h), d AS (SELECT *, regexp_extract_all(name, '\\b\\w\\w+\\b') AS v, ' ' || regexp_replace(stripped, '[^a-z0-9]+', '', 'g') || ' ' AS s, string_split(name, ' ')[2] AS family,
[{", ".join(f"length(name) - length(replace(name, '{x}', ''))" for x in _LETTERS)}]::DOUBLE[] AS vec FROM feat), q AS (SELECT * FROM d WHERE side = 'q'), c AS (SELECT * FROM d WHERE side = 'c'),
{_unit("c", "w", _WORDS)}, {_unit("q", "w", _WORDS)}, {_unit("c", "g", _CHARS)}, {_unit("q", "g", _CHARS)},
l AS (SELECT q, c, sum(x) AS lex FROM (SELECT a.id AS q, b.id AS c, 0.45::DOUBLE * a.w * b.w AS x FROM qw a JOIN cw b USING (t) UNION ALL SELECT a.id, b.id, 0.55::DOUBLE * a.w * b.w FROM qg a JOIN cg b USING (t)) GROUP BY 1, 2),
s AS (SELECT q.id AS query_id, c.id AS catalog_id, q.name = c.name AS same, q.stripped = c.stripped AS near, 0.72::DOUBLE * CASE WHEN q.name = c.name THEN 1 WHEN q.stripped = c.stripped THEN greatest(lex, 0.96) ELSE lex END
  + 0.28::DOUBLE * coalesce(list_cosine_similarity(q.vec, c.vec), 0) + CASE WHEN q.family = c.family THEN 0.06::DOUBLE ELSE -0.08::DOUBLE END AS score FROM l JOIN q ON q.id = l.q JOIN c ON c.id = l.c),
r AS (SELECT query_id, catalog_id, same OR near AS equal, round(CASE WHEN same THEN greatest(score, 0.995) WHEN near THEN greatest(score, 0.96) ELSE score END, 4) AS score FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, catalog_id) AS rank FROM r QUALIFY rank <= 3), p AS (SELECT *, score - coalesce(lead(score) OVER (PARTITION BY query_id ORDER BY rank), 0) AS gap FROM k)
SELECT query_id, catalog_id, score, rank, CASE WHEN equal OR (score >= 0.9 AND gap >= 0.05 - 1e-9) THEN 'HIGH' WHEN score >= 0.84 AND gap >= 0.03 - 1e-9 THEN 'MEDIUM' WHEN score >= 0.76 THEN 'LOW' ELSE 'REVIEW' END AS confidence FROM p""")
def map_services_lexical(spark: SparkSession, d: str) -> DataFrame:
    """ER5: parts' names with their brands against names with types, the vectors being counts of letters."""
    p = table(spark, d, "part").select("p_name", F.lower("p_brand").alias("b"), "p_type").distinct()
    noisy = F.concat("p_name", F.lit(" "), "b", F.when(F.col("p_type") == "PROMO", " (tt23)").otherwise(""))
    vec = F.array(*[(F.length("name") - F.length(F.replace(F.col("name"), F.lit(x), F.lit("")))).cast("double") for x in _LETTERS])
    named = lambda x: p.select(x.alias("name")).union(p.select("p_name")).distinct().select(F.col("name").alias("id"), "name", F.element_at(F.split("name", " "), 2).alias("family"), vec.alias("vec"))
    return match.map_services_hybrid(named(noisy), named(F.concat("p_name", F.lit(" "), F.lower("p_type"))), 3)


_FAMILIES = (("widgets", "cold widgets"), ("widgets", "smaller widget"), ("widgets", "widget tools"), ("bolts", "large bolt"), ("bolts", "bolts and nuts"), ("other", "economy"))
_PAIRS = "(SELECT id, ' ' || unnest(string_split(f, ' ')) || ' ' AS s FROM {})"


@query(f"""WITH q AS (SELECT p_partkey AS id, p_name || ' ' || lower(p_type) AS f, string_split(p_name || ' ' || lower(p_type), ' ') AS v FROM part), c AS (SELECT family || '|' || f AS id, family, f, string_split(f, ' ') AS v FROM (VALUES {", ".join(map(str, _FAMILIES))}) x(family, f)),
{_unit("c", "w", _WORDS)}, {_unit("q", "w", _WORDS)}, {_unit("c", "g", _CHARS, _PAIRS.format("c"))}, {_unit("q", "g", _CHARS, _PAIRS.format("q"))},
l AS (SELECT q, c, sum(x) AS lex FROM (SELECT a.id AS q, b.id AS c, 0.45::DOUBLE * a.w * b.w AS x FROM qw a JOIN cw b USING (t) UNION ALL SELECT a.id, b.id, 0.55::DOUBLE * a.w * b.w FROM qg a JOIN cg b USING (t)) GROUP BY 1, 2),
s AS (SELECT q.id, c.family, round(least(1, greatest(lex, 0.95::DOUBLE * (0.5::DOUBLE * len(list_intersect(q.v, c.v)) / len(c.v) + 0.5::DOUBLE * len(list_intersect(q.v, c.v)) / len(list_distinct(q.v))), CASE WHEN q.f = c.f THEN 1 ELSE 0 END)), 4) AS j FROM l JOIN q ON q.id = l.q JOIN c ON c.id = l.c),
g AS (SELECT id, family, list(j ORDER BY j DESC)[1:3] AS top, count(*) FILTER (j >= 0.65) AS hits FROM s GROUP BY 1, 2),
r AS (SELECT id, family, round(least(1, 0.7::DOUBLE * top[1] + 0.25::DOUBLE * (list_sum(top) / len(top)) + 0.05::DOUBLE * least(hits, 3) / 3.0::DOUBLE), 4) AS score, top[1] AS t1 FROM g)
SELECT id, family, score, t1 AS top_alias_score FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, t1 DESC, family) = 1""")
def family_lexical(spark: SparkSession, d: str) -> DataFrame:
    """ER6 with the lexical score of aliases that share no token, without the partial ratio."""
    texts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("text"))
    aliases = spark.createDataFrame(_FAMILIES, "family string, alias string")
    return match.family_of(texts, aliases, partial=False).select("id", "family", "score", "top_alias_score")


@query("""WITH h AS (SELECT l_suppkey AS query_id, l_partkey AS doc_id, sum(l_quantity)::BIGINT AS score FROM lineitem GROUP BY 1, 2),
n AS (SELECT h.*, CASE WHEN s_suppkey % 4 > 0 THEN 'Brand#' || s_suppkey % 40 END AS q, CASE WHEN p_size % 3 = 0 THEN 'hospital' WHEN p_size % 7 = 1 THEN 'BYT' ELSE 'book' END AS kind, p_brand FROM h JOIN supplier ON s_suppkey = query_id JOIN part ON p_partkey = doc_id),
t AS (SELECT *, CASE WHEN kind = 'hospital' AND q = p_brand THEN 1 WHEN kind = 'BYT' THEN 2 ELSE 3 END AS tier FROM n), b AS (SELECT * FROM t QUALIFY tier = min(tier) OVER (PARTITION BY query_id))
SELECT query_id, doc_id, score, CASE tier WHEN 1 THEN 'hospital' WHEN 2 THEN 'BYT' ELSE CASE WHEN q IS NULL THEN 'all' ELSE 'other' END END AS source_priority, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= 8""")
def search_by_source(spark: SparkSession, d: str) -> DataFrame:
    """RT13: suppliers' parts by quantity, brands being hospitals."""
    hits = lines(spark, d).groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("doc_id")).agg(F.sum("l_quantity").cast("long").alias("score"))
    size, key = F.col("p_size"), F.col("s_suppkey")
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.when(size % 3 == 0, "hospital").when(size % 7 == 1, "BYT").otherwise("book").alias("source_type"), F.col("p_brand").alias("hospital"))
    queries = table(spark, d, "supplier").select(key.alias("query_id"), F.when(key % 4 > 0, F.concat(F.lit("Brand#"), (key % 40).cast("string"))).alias("hospital"))
    return D.source_priority(hits, queries, docs, 8)


@query("SELECT count(*) AS total_memories, round(avg(round(value * 100)::BIGINT), 3) AS avg_confidence, round(count(*) FILTER (event_type = 'purchase') / count(*), 3)::DOUBLE AS sufficient_rate FROM (SELECT * FROM events QUALIFY row_number() OVER (ORDER BY ts DESC, event_id) <= 5000)")
def lesson_stats(spark: SparkSession, d: str) -> DataFrame:
    """MM5: events as lessons, the newest 5,000 kept (the store's limit)."""
    e = table(spark, d, "events").select(F.col("event_id").alias("lesson_id"), "ts", F.round(F.col("value") * 100).cast("long").alias("confidence"), (F.col("event_type") == "purchase").alias("was_sufficient"))
    return govern.lesson_stats(govern.evict_lessons(e, 5000))


@query("""WITH d AS (SELECT r_name AS name, r_regionkey AS id FROM region), q AS (SELECT c_custkey AS query_id, lower(r_name) || ' desk' AS t, r_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT query_id, r_regionkey AS disease_id FROM q""")
def route_disease(spark: SparkSession, d: str) -> DataFrame:
    """ER12: a text that names a region, routed to it."""
    r, n, c = table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "customer")
    q = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("c_custkey").alias("query_id"), F.concat(F.lower("r_name"), F.lit(" desk")).alias("text"))
    return match.route_disease(q, r.select(F.col("r_regionkey").alias("disease_id"), F.col("r_name").alias("name"))).select("query_id", "disease_id")


@query("""WITH e AS (SELECT l_suppkey AS query_id, l_returnflag AS kind, l_partkey AS item, round(sum(l_quantity), 2) AS score FROM lineitem GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, item) AS r FROM e)
SELECT query_id, kind, string_agg(item, ',' ORDER BY r) AS items FROM k WHERE r <= 10 GROUP BY 1, 2""")
def search_claims(spark: SparkSession, d: str) -> DataFrame:
    """RT16 (ten items of each kind)."""
    edges = lines(spark, d).groupBy(F.col("l_suppkey").alias("disease"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("item")).agg(F.round(F.sum("l_quantity"), 2).alias("score"))
    queries = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.col("s_suppkey").alias("disease"))
    return D.search_claims(queries, edges).select("query_id", "kind", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query(r"""WITH q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS t FROM benchmark),
w AS (SELECT doc_id, CASE WHEN lang IN ('en', 'fr', 'de', 'es') THEN lang ELSE 'other' END AS layer, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
st AS (SELECT layer, count(*) AS n, avg(len(w)) AS a FROM w GROUP BY layer), dt AS (SELECT layer, doc_id, t, count(*) AS tf, any_value(n) AS len FROM (SELECT layer, doc_id, len(w) AS n, unnest(w) AS t FROM w) GROUP BY layer, doc_id, t),
i AS (SELECT layer, t, ln(1 + (any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM dt JOIN st USING (layer) GROUP BY layer, t),
s AS (SELECT query_id, layer, doc_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a))), 4) AS score FROM dt JOIN q USING (t) JOIN i USING (layer, t) JOIN st USING (layer) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, layer ORDER BY score DESC, doc_id) AS k FROM s QUALIFY k <= 5)
SELECT query_id, layer, doc_id, round(1.0::DOUBLE / (60 + k), 6) AS rrf_score, count(*) OVER (PARTITION BY query_id, layer) AS layer_hits, row_number() OVER (PARTITION BY query_id ORDER BY round(1.0::DOUBLE / (60 + k), 6) DESC, layer, doc_id) AS rank FROM r QUALIFY rank <= 5""")
def retrieve(spark: SparkSession, d: str) -> DataFrame:
    """RT12, RT13: benchmark passages against documents by language layers. Each document is in one layer (those of other
    languages or none in "other"), and both intents see all layers."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.when(F.col("item_id") % 2 == 0, "a").otherwise("b").alias("intent"))
    languages = ["en", "fr", "de", "es"]
    layers = {x: docs.filter(F.col("lang") == x) for x in languages} | {"other": docs.filter(F.col("lang").isNull() | ~F.col("lang").isin(languages))}
    return D.retrieve(q, {x: (rows, ["a", "b"]) for x, rows in layers.items()}, 5)


@query(r"""WITH q AS (SELECT DISTINCT doc_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(source || ' ' || lang), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS t FROM documents WHERE doc_id % 20 = 0),
w AS (SELECT page_id AS doc_id, list_filter(regexp_split_to_array(lower(concat_ws(' ', url, url, url, html)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM pages), st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w),
dt AS (SELECT doc_id, t, count(*) AS tf, any_value(n) AS len FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM w) GROUP BY doc_id, t), i AS (SELECT t, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM dt, st GROUP BY t, n),
s AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a))), 4) AS score FROM dt JOIN q USING (t) JOIN i USING (t), st GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 2) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 3""")
def search_fields(spark: SparkSession, d: str) -> DataFrame:
    """RT6: every twentieth document's source and language (a stated set) against all pages, addresses counting as titles."""
    q = table(spark, d, "documents").filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.concat_ws(" ", "source", "lang").alias("text"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("title"), F.col("html").alias("text"))
    return D.search_fields(q, pages, 3).select("query_id", "doc_id", F.round("score", 2).alias("score"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS run_id, round(list_cosine_similarity(a.v, b.v), 4) AS score, b.label FROM e a, e b WHERE a.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, run_id) AS rank FROM s QUALIFY rank <= 3) SELECT query_id, run_id, score, arg_max('p' || label, (label, -run_id)) OVER (PARTITION BY query_id) AS best_prompt FROM k""")
def find_similar_runs(spark: SparkSession, d: str) -> DataFrame:
    """MM7: every twentieth vector as a query (a stated set)."""
    e = table(spark, d, "embeddings")
    runs = e.select(F.col("vec_id").alias("run_id"), F.col("embedding").alias("vec"), F.concat(F.lit("p"), F.col("label").cast("string")).alias("prompt"), F.col("label").alias("result_score"))
    return govern.find_similar(e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), runs, 3).select("query_id", "run_id", "score", "best_prompt")


@query("SELECT event_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-09' AND event_type = 'error'")
def usage_history(spark: SparkSession, d: str) -> DataFrame:
    """US2."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return usage.usage_history(e, "2024-01-02 00:00:00", "2024-01-09 00:00:00", event_type="error").select("event_id", "event_type")


@query("SELECT event_type AS source, count(*) AS n_items FROM events GROUP BY 1")
def evidence_sources(spark: SparkSession, d: str) -> DataFrame:
    """EV10: users' events as nested evidence."""
    nested = table(spark, d, "events").groupBy("user_id", F.floor(F.col("event_id") / 100).alias("batch")).agg(F.collect_list(F.struct(F.col("event_type").alias("source"))).alias("evidence"))
    return evaluate.evidence_sources(nested)


@query("SELECT s_suppkey AS service, 'medical' AS path, l_returnflag AS via, count(*) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 3 UNION ALL SELECT s_suppkey, 'contract', s_nationkey::VARCHAR, 1 FROM supplier")
def trace_service(spark: SparkSession, d: str) -> DataFrame:
    """GR3."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("service"), F.col("s_nationkey").cast("string").alias("via"), F.lit("n").alias("source"))
    medical = lines(spark, d).select(F.col("l_suppkey").alias("service"), F.col("l_returnflag").alias("via"), F.lit("l").alias("source"))
    return graph.trace_service(s, medical, s).groupBy("service", "path", "via").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(lower(p_type) || ' ' || split_part(p_name, ' ', 1), ' ')) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 4) AS score FROM p""")
def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """TX6, TX7."""
    other = F.concat_ws(" ", F.lower("p_type"), F.element_at(F.split("p_name", " "), 1))
    return table(spark, d, "part").select("p_partkey", F.round(T.jaccard(T.tokens(F.col("p_name")), T.tokens(other)), 4).alias("score"))


@query("""WITH g AS (SELECT p_partkey, list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3))) AS a, list_distinct(list_transform(range(1, length(lower(p_type)) - 1), lambda i: substr(lower(p_type), i, 3))) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 4) AS score FROM g""")
def ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """TX8."""
    return table(spark, d, "part").select("p_partkey", F.round(T.ngram_jaccard(F.col("p_name"), F.lower("p_type")), 4).alias("score"))
