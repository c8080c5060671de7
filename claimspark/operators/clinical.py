"""Clinical evidence scoring (CL)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import icd_norm
from .decisions import cases
from .documents import EPSILON
from .windows import norm_by_max, top1, topk

# Weights of the hypothesis fusion.
SIGN_W, SERVICE_W, LAB_W, EXCLUDE_W, MEMORY_CAP, GRAPH_W, GRAPH_STEP = 0.7, 0.2, 0.35, 0.45, 0.1, 0.16, 0.08


def score_diseases(matches: DataFrame, edges: DataFrame) -> DataFrame:
    """CL1: per case and disease the sum of match * log1p(support). matches(case_id, sign_id, match), edges(sign_id,
    disease_id, support)."""
    both = matches.join(edges, "sign_id")
    return both.groupBy("case_id", "disease_id").agg(F.round(F.sum(F.col("match") * F.log1p(F.col("support").cast("double"))), 4).alias("score"), F.count_distinct("sign_id").alias("n_signs"))


def link_strength(case: Column, top: Column, evidence: Column, role: Column) -> Column:
    """The strength of a disease-service link from four parts in [0, 1], 0.1 at least."""
    return F.greatest(0.45 * case + 0.25 * top + 0.15 * evidence + 0.15 * role, F.lit(0.1))


def score_services(diseases: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """CL2: per case the k services with the highest sum of disease score * link strength. links(disease_id, service_id,
    case_share, max_share, evidence, role)."""
    strength = link_strength(*[F.col(c) for c in ("case_share", "max_share", "evidence", "role")])
    sums = diseases.join(links, "disease_id").groupBy("case_id", "service_id").agg(F.round(F.sum(F.col("score") * strength), 4).alias("service_score"))
    return topk(sums, ["case_id"], [F.col("service_score").desc(), F.col("service_id")], k, rank="rank")


def profile_support(cases_: DataFrame, rules: DataFrame) -> DataFrame:
    """CL3: per case and profile: required signs met, required signs in all, excluded signs present, and supported (all
    required, none excluded). cases_(case_id, sign_id), rules(profile_id, sign_id, kind: required or excluded)."""
    need = rules.groupBy("profile_id").agg(F.count_if(F.col("kind") == "required").alias("n_required"))
    met = cases_.distinct().join(rules, "sign_id").groupBy("case_id", "profile_id").agg(F.count_if(F.col("kind") == "required").alias("n_met"), F.count_if(F.col("kind") == "excluded").alias("n_excluded"))
    out = met.join(need, "profile_id")
    return out.withColumn("supported", (F.col("n_met") == F.col("n_required")) & (F.col("n_excluded") == 0))


LEVELS = ("none", "weak", "moderate", "strong")


def lab_disease_evidence(observations: DataFrame, profiles: DataFrame, links: DataFrame) -> DataFrame:
    """CL4: per case and disease the supporting and excluding weight of lab signals and the strongest level.
    observations(case_id, source_key, signal), profiles(profile_id, signal, direction, level, weight),
    links(source_key, profile_id, disease_id, evidence_weight, confidence_weight)."""
    hit = observations.join(links, "source_key").join(profiles, ["profile_id", "signal"])
    w = F.col("weight") * F.col("evidence_weight") * F.col("confidence_weight")
    order = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    side = lambda d: F.round(F.sum(F.when(F.col("direction") == d, w).otherwise(0.0)), 4)
    out = hit.groupBy("case_id", "disease_id").agg(side("support").alias("support"), side("exclude").alias("exclude"), F.max(order).alias("level"))
    return out.withColumn("level", F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("level").cast("int")))


def hypothesis_key(icd: Column, disease_id: Column, name: Column) -> Column:
    """CL6: ICD, else id, else name."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(F.concat(F.lit("icd:"), full(F.upper(icd))), F.concat(F.lit("id:"), full(disease_id)), F.concat(F.lit("name:"), full(F.lower(name))))


def hypotheses(evidence: DataFrame) -> DataFrame:
    """CL5: fused hypotheses. evidence(case_id, disease_id, source, value): source is signs, services, lab, lab_exclude,
    memory or graph; value a raw score (for graph the number of matches). Signs and services are taken relative to the
    case's best."""
    parts = evidence.groupBy("case_id", "disease_id").agg(*[F.coalesce(F.sum(F.when(F.col("source") == s, F.col("value"))), F.lit(0.0)).alias(s) for s in ("signs", "services", "lab", "lab_exclude", "memory", "graph")])
    rel = norm_by_max(norm_by_max(parts, ["case_id"], "signs", "signs_rel"), ["case_id"], "services", "services_rel")
    graph = F.when(F.col("graph") > 0, GRAPH_W + F.least((F.col("graph") - 1) * GRAPH_STEP / 2, F.lit(GRAPH_STEP))).otherwise(0.0)
    positive = SIGN_W * F.col("signs_rel") + SERVICE_W * F.col("services_rel") + LAB_W * F.col("lab") + F.least(F.col("memory"), F.lit(MEMORY_CAP)) + graph
    return rel.withColumn("verdict", hypothesis_status(positive, EXCLUDE_W * F.col("lab_exclude"))).select("case_id", "disease_id", "verdict.*")


def hypothesis_status(positive: Column, exclusion: Column) -> Column:
    """struct<score, confidence, status> from the positive and the excluding weight."""
    confidence = positive / F.greatest(positive + exclusion + 0.15, F.lit(0.15))
    status = F.when(exclusion >= F.greatest(positive * 1.05, F.lit(0.25)), "ruled_out").when((positive >= 0.72) & (confidence >= 0.6), "confirmed").otherwise("active")
    return F.struct(F.round(positive - exclusion + EPSILON, 4).alias("score"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)) + EPSILON, 4).alias("confidence"), status.alias("status"))


def line_lab_support(matched: DataFrame, signals: DataFrame, line: str = "line_id", cut: float = 0.58, k: int = 6) -> DataFrame:
    """CL9: support level of each line from its k best observations with at least the cut. matched(line_id, obs_id,
    score), signals(obs_id, flags)."""
    from .aggregates import lab_support

    best = topk(matched.filter(F.col("score") >= cut), [line], [F.col("score").desc(), F.col("obs_id")], k)
    return lab_support(best.join(signals, "obs_id"), [line])


def apply_rules(lines: DataFrame, rules: DataFrame, key: str = "line_id") -> DataFrame:
    """CL10: (key, rule_id, outcome) of the structured rules that hold. lines(key, tokens), rules(rule_id, outcome, any,
    all, none: arrays of terms). A line meets a rule on a term of any or all; rules without such terms meet no line."""
    empty = F.array().cast("array<string>")
    r = rules.select("rule_id", "outcome", *[F.coalesce(F.col(c), empty).alias(f"r_{c}") for c in ("any", "all", "none")])
    r = r.withColumn("t", F.explode(F.array_union("r_any", "r_all")))
    hit = lines.select(key, "tokens", F.explode("tokens").alias("t")).join(r, "t")
    holds = ((F.size("r_any") == 0) | F.arrays_overlap("r_any", "tokens")) & (F.size(F.array_except("r_all", "tokens")) == 0) & ~F.arrays_overlap("r_none", "tokens")
    return hit.filter(holds).select(key, "rule_id", "outcome").distinct()


def screening_flag(name: Column, diagnosis: Column, signs: Column) -> Column:
    """CL11: a screening service without diagnosis and signs."""
    from ..functions.text import ascii_fold

    bare = F.coalesce(F.trim(diagnosis) == "", F.lit(True)) & F.coalesce(F.size(signs) == 0, F.lit(True))
    return F.coalesce(ascii_fold(name).rlike("tam soat|tong quat|dinh ky|screening|check.?up"), F.lit(False)) & bare


def medical_necessity(rows: DataFrame) -> DataFrame:
    """CL12: struct necessity<status, decision, confidence>. rows: by_final, by_signs, by_lab, by_result, by_protocol,
    by_rule, rule_contradicts, lab_strong, result_strong, protocol_strong, rule_strong, signs_strong, same_icd,
    same_diagnosis, screening_only, some_context, weak_signs, fallback_or_lab (all boolean), clinical (its confidence)."""
    c = F.col
    clin, J, U, N = c("clinical"), "JUSTIFIED", "UNCERTAIN", "UNJUSTIFIED"
    lab, protocol = c("by_lab"), c("by_protocol")
    floor = lambda *p: _floors(F.lit(0.0), p)
    go = lambda s, d, x: {"status": s, "decision": d, "confidence": x if isinstance(x, Column) else F.lit(float(x))}
    either = lambda strong, yes=J, no=U: F.when(strong, yes).otherwise(no)
    rules = [
        (c("by_final") & c("by_signs"), go("supported_by_both", J, F.greatest(clin, F.lit(0.80), floor((lab, 0.84), (protocol, 0.86))))),
        (c("by_final"), go("supported_by_final_diagnosis", either((clin >= 0.75) | lab), F.greatest(clin, floor((lab, 0.80), (protocol, 0.82))))),
        (lab, go("supported_by_lab_results", either(c("lab_strong")), F.greatest(F.when(c("lab_strong"), 0.82).otherwise(0.72), floor((protocol, 0.78))))),
        (c("by_result"), go("supported_by_result_disease", either(c("result_strong")), F.greatest(F.when(c("result_strong"), 0.80).otherwise(0.70), floor((c("same_icd"), 0.82), (c("same_diagnosis"), 0.75))))),
        (protocol, go("supported_by_protocol_semantic", either(c("protocol_strong")), F.when(c("protocol_strong"), 0.78).otherwise(0.68))),
        (c("by_rule"), go("supported_by_tmh_structured", either(c("rule_strong")), F.when(c("rule_strong"), 0.80).otherwise(0.72))),
        (c("by_signs"), go("supported_by_initial_signs", either(c("signs_strong")), F.greatest(clin, F.when(c("signs_strong"), 0.72).otherwise(0.58)))),
        (c("rule_contradicts"), go("not_medically_supported", N, F.when(c("rule_strong"), 0.82).otherwise(0.72))),
        (c("screening_only"), go("not_medically_supported", N, 0.78)),
        (c("some_context") & (c("weak_signs") | c("fallback_or_lab")), go("uncertain", U, F.greatest(clin, F.lit(0.45)))),
    ]
    return rows.withColumn("necessity", cases(rules, go("not_medically_supported", N, clin)))


def _floors(base: Column, pairs: Sequence[tuple[Column, float]]) -> Column:
    return F.greatest(base, *[F.when(k, v).otherwise(0.0) for k, v in pairs])


def line_disease_support(candidates: DataFrame, k: int = 6) -> DataFrame:
    """CL13, CL14: the k best diseases of each line by raw * role weight * source weight * disease factor, cut at 0.34,
    capped at 0.99. candidates(line_id, disease_id, raw, role_weight, source_weight, disease_factor)."""
    score = F.least(F.col("raw") * F.col("role_weight") * F.col("source_weight") * F.col("disease_factor"), F.lit(0.99))
    best = candidates.withColumn("score", F.round(score, 4)).filter("score >= 0.34").groupBy("line_id", "disease_id").agg(F.max("score").alias("score"))
    return topk(best, ["line_id"], [F.col("score").desc(), F.col("disease_id")], k, rank="rank")


def evidence_ledger(evidence: DataFrame, keys: Sequence[str], n: int = 12) -> DataFrame:
    """CL15: the n strongest evidence items of each key as a list. evidence(source, item, score)."""
    some = topk(evidence, keys, [F.col("score").desc(), F.col("source"), F.col("item")], n, rank="__rank")
    items = F.array_sort(F.collect_list(F.struct("__rank", "source", "item", "score")))
    return some.groupBy(*keys).agg(F.transform(items, lambda x: F.struct(x["source"], x["item"], x["score"])).alias("ledger"))


def coverage_gaps(evidence: DataFrame, keys: Sequence[str], sources: Sequence[str]) -> DataFrame:
    """CL15: which of the sources each key has no evidence from."""
    have = evidence.groupBy(*keys).agg(F.collect_set("source").alias("have"))
    return have.select(*keys, F.array_sort(F.array_except(F.array(*[F.lit(s) for s in sources]), "have")).alias("gaps"))


def extract_case_signs(cases_: DataFrame, columns: Sequence[str], min_len: int = 3, k: int = 24) -> DataFrame:
    """CL16: (case_id, sign): the phrases of the texts, each once, the longest first, k at most (the operator's limit)."""
    from ..functions.text import norm_key

    parts = F.filter(F.transform(F.split(F.concat_ws("; ", *columns), r"[,;.\n]+"), norm_key), lambda p: F.length(p) >= min_len)
    signs = cases_.select("case_id", F.explode(F.array_distinct(parts)).alias("sign"))
    return topk(signs, ["case_id"], [F.length("sign").desc(), F.col("sign")], k)


def dedupe_observations(observations: DataFrame, signature: Sequence[str]) -> DataFrame:
    """CL17: one observation per signature."""
    return observations.dropDuplicates(list(signature))


def ontology_decision(support: Column, contra: Column, coverage: Column, known: Column, disease_confidence: Column, active: Column) -> Column:
    """CL18: struct<decision, confidence> from the line's best support and contraindication scores."""
    clip = lambda x, a, b: F.greatest(F.lit(a), F.least(F.lit(b), x))
    return cases(
        [
            ((contra >= 0.45) & (contra >= support), {"decision": "deny", "confidence": clip(contra, 0.74, 0.98)}),
            (support >= 0.45, {"decision": "approve", "confidence": clip(support, 0.62, 0.96)}),
            (active & (coverage >= 0.45) & (known | (disease_confidence >= 0.62)), {"decision": "deny", "confidence": F.when(known, 0.78).otherwise(0.67)}),
        ],
        {"decision": "uncertain", "confidence": 0.45},
    )


def clinical_verdict(justified: Column, matrix: Column, ontology: Column, ontology_confidence: Column, threshold: float = 0.65) -> Column:
    """CL19: struct<decision, confidence, fallback> of matrix (its confidence) and ontology decisions."""
    direct = matrix >= threshold
    no, yes = F.lit(False), F.lit(True)
    return cases(
        [
            (~justified, {"decision": "deny", "confidence": matrix, "fallback": no}),
            (ontology == "approve", {"decision": "approve", "confidence": F.when(direct, F.greatest(matrix, ontology_confidence)).otherwise(ontology_confidence), "fallback": no}),
            ((ontology == "deny") & direct, {"decision": "uncertain", "confidence": F.greatest(ontology_confidence, F.lit(0.58)), "fallback": no}),
            (ontology == "deny", {"decision": "deny", "confidence": F.greatest(ontology_confidence, F.lit(0.62)), "fallback": no}),
            (~direct, {"decision": "uncertain", "confidence": matrix, "fallback": yes}),
            (direct, {"decision": "approve", "confidence": matrix, "fallback": no}),
        ],
        {"decision": "uncertain", "confidence": matrix, "fallback": no},
    )


def active_diseases(cases_: DataFrame, catalog: DataFrame) -> DataFrame:
    """CL20: the catalogue disease of each case's hint: by ICD, else by the largest share of shared name tokens.
    cases_(case_id, icd, name_tokens), catalog(disease_id, icd, name_tokens). Cases with a hint are in known-disease
    mode; the others are left to sign inference."""
    by_icd = cases_.join(catalog.select("disease_id", "icd"), "icd").select("case_id", "disease_id", F.lit(1.0).alias("score"))
    rest = cases_.join(by_icd.select("case_id"), "case_id", "left_anti")
    a = rest.select("case_id", F.size("name_tokens").alias("n"), F.explode("name_tokens").alias("t"))
    b = catalog.select("disease_id", F.explode("name_tokens").alias("t"))
    by_name = a.join(b, "t").groupBy("case_id", "disease_id").agg(F.round(F.count(F.lit(1)) / F.max("n"), 4).alias("score"))
    best = top1(by_icd.unionByName(by_name), ["case_id"], [F.col("score").desc(), F.col("disease_id")])
    return cases_.select("case_id").join(best, "case_id", "left").withColumn("mode", F.when(F.col("disease_id").isNull(), "sign_inference").otherwise("known_disease"))


def relative(col: str, keys: Sequence[str]) -> Column:
    return F.col(col) / F.max(col).over(Window.partitionBy(*keys))


def known_disease_support(lines: DataFrame, protocol: DataFrame, matrix: DataFrame) -> DataFrame:
    """CL7: whether a line's service is supported for its known diagnosis. lines(line_id, service_code, icd10),
    protocol(service_code, icd10), matrix(service_code, icd10, score). Adds support<supported, confidence, flag,
    coverage>: by the protocol 0.95; by the matrix, for the code or else its group, 0.55 + 0.35 * score between 0.72 and
    0.9; not supported at 0.78 where code or group are in a catalogue, else at 0."""
    norm = lambda df: df.withColumn("service_code", F.upper(F.trim("service_code"))).withColumn("icd10", icd_norm(F.col("icd10"))).withColumn("icd_group", F.substring("icd10", 1, 3))
    p, m, l = norm(protocol).filter("icd10 <> ''"), norm(matrix).filter("icd10 <> ''"), norm(lines)
    listed = p.select("service_code", "icd10", F.lit(True).alias("by_protocol")).distinct()
    exact = m.groupBy("service_code", "icd10").agg(F.max("score").alias("own"))
    group = m.groupBy("service_code", "icd_group").agg(F.max("score").alias("of_group"))
    codes = p.select("icd10").unionByName(m.select("icd10")).distinct().withColumn("has_code", F.lit(True))
    groups = m.select("icd_group").distinct().withColumn("has_group", F.lit(True))
    out = l.join(listed, ["service_code", "icd10"], "left").join(exact, ["service_code", "icd10"], "left").join(group, ["service_code", "icd_group"], "left").join(codes, "icd10", "left").join(groups, "icd_group", "left")
    coverage = F.coalesce(F.col("has_code"), F.col("has_group"), F.lit(False))
    by_matrix = F.coalesce("own", "of_group")
    missing = F.coalesce(F.col("service_code"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("icd10"), F.lit("")).eqNullSafe("")
    support = cases(
        [
            (missing, {"supported": False, "confidence": 0.0, "flag": None, "coverage": False}),
            (F.coalesce("by_protocol", F.lit(False)), {"supported": True, "confidence": 0.95, "flag": "protocol_icd_support", "coverage": True}),
            (by_matrix.isNotNull(), {"supported": True, "confidence": F.round(F.greatest(F.lit(0.72), F.least(F.lit(0.9), 0.55 + 0.35 * by_matrix)), 4), "flag": "matrix_icd_support", "coverage": True}),
            (coverage, {"supported": False, "confidence": 0.78, "flag": "known_disease_catalog_miss", "coverage": True}),
        ],
        {"supported": False, "confidence": 0.0, "flag": None, "coverage": False},
    )
    return lines.join(out.select("line_id", support.alias("support")), "line_id")
