"""Contract, administrative, anomaly and final decisions (AD, AN): each rule cascade is one ordered chain of cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut, maybe_broadcast
from ..functions.text import ascii_fold, category_covered

# Thresholds of the anomaly rules.
PRICE_OUTLIER, PRICE_EXTREME, HIGH_QUANTITY = 3.0, 5.0, 5
PREAUTH_VND = 500_000


def cases(rules: Sequence[tuple[Column, dict[str, Column | str | float]]], default: dict[str, Column | str | float]) -> Column:
    """A struct whose fields come from the first rule that holds."""
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    fields = []
    for name, last in default.items():
        out = lift(last)
        for condition, values in reversed(list(rules)):
            out = F.when(condition, lift(values[name])).otherwise(out)
        fields.append(out.alias(name))
    return F.struct(*fields)


# Anomalies.

def price_flag(cost: Column, reference: Column) -> Column:
    """AN1: price_extreme above 5 times the reference, price_outlier above 3 times, else null."""
    ratio = F.try_divide(cost, F.when(reference > 0, reference))
    return F.when(ratio > PRICE_EXTREME, "price_extreme").when(ratio > PRICE_OUTLIER, "price_outlier")


def price_anomaly(lines: DataFrame, prices: DataFrame, key: str) -> DataFrame:
    """AN1: lines(cost, quantity...) with the price flag against prices(key, reference_price)."""
    return lines.join(prices, key, "left").withColumn("price_flag", price_flag(F.col("cost"), F.col("reference_price")))


def duplicate_lines(lines: DataFrame, claim: str, name: str) -> DataFrame:
    """AN2: is_duplicate where the folded name occurs more than once in the claim."""
    n = F.count(F.lit(1)).over(Window.partitionBy(claim, ascii_fold(F.trim(F.col(name)))))
    return lines.withColumn("is_duplicate", n > 1)


def high_quantity(lines: DataFrame, quantity: str = "quantity") -> DataFrame:
    """AN3: lines with a quantity above 5."""
    return lines.filter(F.col(quantity) > HIGH_QUANTITY)


def anomaly_verdict(flags: Column) -> Column:
    """The verdict from an array of flags: review 0.70 with flags, approve 0.90 without."""
    return cases([(F.size(flags) > 0, {"decision": "review", "confidence": 0.70})], {"decision": "approve", "confidence": 0.90})


def anomalies(lines: DataFrame, prices: DataFrame, key: str, claim: str, name: str) -> DataFrame:
    """AN1-AN3 together: lines with anomaly_flags and the anomaly verdict."""
    out = duplicate_lines(price_anomaly(lines, prices, key), claim, name)
    found = F.array(F.col("price_flag"), F.when(F.col("is_duplicate"), F.lit("duplicate_service")), F.when(F.col("quantity") > HIGH_QUANTITY, F.lit("high_quantity")))
    out = out.withColumn("anomaly_flags", F.filter(found, lambda f: f.isNotNull()))
    return out.withColumn("anomaly", anomaly_verdict(F.col("anomaly_flags")))


# Contract.

def contract_step(rows: DataFrame) -> DataFrame:
    """AD1: the step-2 decision. rows: has_rule, has_prior, medical_status and counts of the risks screening,
    not_covered, copay, limit, documents, waiting_period, late_submission; rule_copay, rule_sublimit (nullable)."""
    at_least = lambda k, n: F.coalesce(F.col(k), F.lit(0)) >= n
    screening, not_covered = at_least("screening", 5), at_least("not_covered", 3)
    partial = at_least("copay", 3) | at_least("limit", 3) | F.coalesce(F.col("rule_copay") > 0, F.lit(False)) | F.coalesce(F.col("rule_sublimit") > 0, F.lit(False))
    clause = at_least("documents", 2) | at_least("waiting_period", 2) | at_least("late_submission", 2)
    weak = F.col("medical_status").isin("uncertain", "not_medically_supported")
    rule, prior = F.col("has_rule"), F.col("has_prior")
    d = (
        F.when(rule & not_covered, "contract_review_not_covered_sensitive")
        .when(rule & screening & weak, "contract_review_screening_sensitive")
        .when(rule & clause, "contract_review_admin_or_clause_sensitive")
        .when(rule & partial, "contract_partial_pay_sensitive")
        .when(rule, "contract_clear")
        .when(prior & screening, "contract_unknown_with_screening_prior")
        .when(prior & not_covered, "contract_unknown_with_not_covered_prior")
        .when(prior & partial, "contract_unknown_with_partial_pay_prior")
        .otherwise("contract_unknown")
    )
    return rows.withColumn("step2_decision", d)


# Exclusion codes by class, the drug rules' codes, and words of the classes' texts.
EXCLUSION_CODES = {
    "financial": ("ma01", "ma04", "ma11", "ma12", "ld0001", "ma003"),
    "documentation": ("ma07", "ma08", "ma09", "ma10", "ma19", "nan"),
    "drug": ("ma03", "ma16", "ma17", "ma18", "ma20", "m32", "m33", "ma31"),
    "hard_deny": ("ma05", "ma15", "ma21", "ma26", "ma27", "ma28", "ma30", "ma004"),
    "soft_review": ("ma06", "ma39"),
}
EXCLUSION_TEXTS = {
    "financial": ("đồng chi trả", "hạn mức", "vượt quá quyền lợi", "giảm trừ"),
    "documentation": ("chứng từ", "hóa đơn", "bồi thường"),
    "soft_review": ("tầm soát", "kiểm tra", "không có hướng điều trị"),
    "hard_deny": ("không thuộc quyền lợi", "loại trừ", "thời gian chờ", "blacklist"),
}
DRUGS = ("thuốc", "drug", "pharmacy", "rx", "med")
EXCLUSION_PRIORITY = {"hard_deny": 4, "documentation": 3, "financial": 2, "soft_review": 1, "review": 1, "ignore": 0}


def exclusion_class(reason: Column, code: Column | None = None, group: Column | None = None, source: Column | None = None, category: Column | None = None, service: Column | None = None) -> Column:
    """AD2: struct<signal, priority> of an exclusion: by its code, drug rules denying drugs only, then by its source and
    the words of its group and reason, else review."""
    low = lambda c: F.lower(F.coalesce(c, F.lit(""))) if c is not None else F.lit("")
    text, key = F.concat_ws(" ", low(group), low(reason)), low(code)
    holds = lambda c, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))
    drug = holds(F.concat_ws(" ", low(category), low(service)), DRUGS)
    signal = F.when(key.isin(*EXCLUSION_CODES["financial"]), "financial").when(key.isin(*EXCLUSION_CODES["documentation"]), "documentation")
    signal = signal.when(key.isin(*EXCLUSION_CODES["drug"]), F.when(drug, "hard_deny").otherwise("ignore"))
    signal = signal.when(key.isin(*EXCLUSION_CODES["hard_deny"]), "hard_deny").when(key.isin(*EXCLUSION_CODES["soft_review"]), "soft_review").when(low(source) == "keyword_contract_exclusion", "soft_review")
    for name, words in EXCLUSION_TEXTS.items():
        signal = signal.when(holds(text, words), name)
    signal = signal.otherwise("review")
    return F.struct(signal.alias("signal"), F.element_at(F.create_map(*[F.lit(x) for kv in EXCLUSION_PRIORITY.items() for x in kv]), signal).alias("priority"))


def contract_verdict(rows: DataFrame) -> DataFrame:
    """AD3: the graph-backed verdict. rows: has_contract, has_benefit, benefit_status, signals (array of exclusion
    classes), medical_status, context_supports, context_excludes. Adds contract<decision, confidence>."""
    has = lambda s: F.array_contains("signals", s)
    benefit, medical = F.col("has_benefit"), F.col("benefit_status")
    base = cases(
        [
            (~F.col("has_contract"), {"decision": "deny", "confidence": 0.90}),
            (has("hard_deny"), {"decision": "deny", "confidence": 0.80}),
            (has("documentation"), {"decision": "review", "confidence": 0.65}),
            (has("financial") & benefit, {"decision": "partial_pay", "confidence": 0.80}),
            (has("soft_review") | has("review"), {"decision": "review", "confidence": 0.55}),
            (~benefit, {"decision": "deny", "confidence": 0.85}),
            (medical == "approve", {"decision": "approve", "confidence": 0.80}),
            (medical.isin("review", "uncertain"), {"decision": "review", "confidence": 0.60}),
            (medical == "deny", {"decision": "deny", "confidence": 0.75}),
        ],
        {"decision": "review", "confidence": 0.50},
    )
    out = rows.withColumn("__base", base)
    d, c = F.col("__base.decision"), F.col("__base.confidence")
    soft = (has("soft_review") | has("documentation")) & ~has("hard_deny") & ~has("review")
    context, final = F.col("context_supports"), F.col("medical_status") == "supported_by_final_diagnosis"
    clear = (d == "review") & context & benefit & final & ~has("hard_deny")
    verdict = cases(
        [
            ((d == "deny") & F.col("has_contract") & ~benefit & ~has("hard_deny") & context, {"decision": "review", "confidence": F.greatest(c, F.lit(0.58))}),
            (clear & has("financial"), {"decision": "partial_pay", "confidence": F.greatest(c, F.lit(0.78))}),
            (clear, {"decision": "approve", "confidence": F.greatest(c, F.lit(0.76))}),
            ((d == "deny") & context & soft, {"decision": "review", "confidence": F.greatest(c, F.lit(0.60))}),
            ((d == "deny") & F.col("context_excludes") & has("hard_deny"), {"decision": "deny", "confidence": F.greatest(c, F.lit(0.88))}),
        ],
        {"decision": d, "confidence": c},
    )
    return out.withColumn("contract", verdict).drop("__base")


def eligibility(rows: DataFrame) -> DataFrame:
    """AD4: eligible and rule_applied from the contract's rule type. rows: rule_type (null: unknown contract), category,
    covered_categories (array), justified."""
    covered = F.coalesce(F.size("covered_categories") == 0, F.lit(True)) | category_covered(F.col("category"), F.col("covered_categories"))
    t = F.col("rule_type")
    verdict = cases(
        [
            (t.isNull(), {"eligible": F.lit(True), "rule_applied": "unknown_contract_fallback"}),
            (~covered, {"eligible": F.lit(False), "rule_applied": "category_not_covered"}),
            (t.isin("pay_if_positive", "pay_if_preauthorized"), {"eligible": F.lit(False), "rule_applied": t}),
            (t.isin("pay_if_medically_necessary", "pay_if_final_icd_match"), {"eligible": F.col("justified"), "rule_applied": t}),
        ],
        {"eligible": F.col("justified"), "rule_applied": "fallback_rule"},
    )
    return rows.withColumn("eligibility", verdict)


#: Step-2 outcome -> contract verdict and confidence (AD13).
FILE_VERDICTS = (
    ("contract_clear", "approve", 0.85),
    ("contract_review_not_covered_sensitive", "deny", 0.75),
    ("contract_review_screening_sensitive", "deny", 0.70),
    ("contract_review_admin_or_clause_sensitive", "review", 0.60),
    ("contract_partial_pay_sensitive", "partial_pay", 0.65),
    ("contract_unknown", "uncertain", 0.30),
    ("contract_unknown_with_screening_prior", "review", 0.55),
    ("contract_unknown_with_not_covered_prior", "deny", 0.60),
    ("contract_unknown_with_partial_pay_prior", "partial_pay", 0.55),
)


def file_contract_verdict(step2: Column) -> Column:
    """AD13: the verdict of a step-2 decision."""
    return cases([(step2 == s, {"decision": d, "confidence": c}) for s, d, c in FILE_VERDICTS], {"decision": "uncertain", "confidence": 0.30})


def apply_clause_rules(attributes: DataFrame, conditions: DataFrame, exceptions: DataFrame, ancestors: DataFrame) -> DataFrame:
    """AD12: (line_id, rule_id) for every rule whose conditions all hold for the line and that no exception lifts.

    attributes(line_id, field, value): a line's attributes, one row each. conditions(rule_id, n_conditions, field,
    operator, value): =, !=, >, <, in_hierarchy. exceptions(rule_id, field, value). ancestors(child, ancestor), each
    code being its own ancestor. Conditions that ask for a value, or for one below it in the hierarchy, are joined on field
    and value; the others on the field, after a count of them has shown whether they can be broadcast.
    """
    key = ["rule_id", "n_conditions", "field", "operator", "value"]
    equal = conditions.filter("operator = '='").select(*key, F.col("value").alias("asked"))
    below = conditions.filter("operator = 'in_hierarchy'").join(ancestors, F.col("value") == F.col("ancestor")).select(*key, F.col("child").alias("asked"))
    by_value = maybe_broadcast(cut(equal.unionByName(below)))
    met = attributes.alias("a").join(by_value.alias("c"), (F.col("a.field") == F.col("c.field")) & (F.col("a.value") == F.col("c.asked"))).select("a.line_id", *[f"c.{c}" for c in key])
    others = maybe_broadcast(cut(conditions.filter("operator NOT IN ('=', 'in_hierarchy')")))
    n, m = F.col("a.value").try_cast("double"), F.col("c.value").try_cast("double")
    holds = F.when(F.col("operator") == "!=", F.col("a.value") != F.col("c.value")).when(F.col("operator") == ">", n > m).when(F.col("operator") == "<", n < m)
    met = met.unionByName(attributes.alias("a").join(others.alias("c"), F.col("a.field") == F.col("c.field")).filter(holds).select("a.line_id", *[f"c.{c}" for c in key]))
    full = met.groupBy("line_id", "rule_id").agg(F.count_distinct("field", "operator", "value").alias("n"), F.max("n_conditions").alias("need")).filter("n = need").select("line_id", "rule_id")
    lifted = attributes.join(exceptions, ["field", "value"]).select("line_id", "rule_id")
    return full.join(lifted, ["line_id", "rule_id"], "left_anti")


# Administrative step and routing.

def admin_step(rows: DataFrame) -> DataFrame:
    """AD5: step-3 flags and decision. rows: has_claim_ref, has_contract_ref, has_case, has_context, medical_status,
    step2_decision, category, is_preop, preop_markers, has_procedure, documents_sensitive, has_lab_document."""
    weak = F.col("medical_status") == "uncertain"
    lab = F.startswith(F.col("category"), F.lit("LAB"))
    flags = lambda **k: F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in k.items()]), lambda x: x.isNotNull())
    out = rows.withColumn("traceability_flags", flags(missing_claim_reference=~F.col("has_claim_ref"), missing_contract_reference=~F.col("has_contract_ref"), missing_case_bundle=~F.col("has_case")))
    out = out.withColumn("document_flags", flags(missing_clinical_context=~F.col("has_context") & weak, documents_sensitive_from_contract_history=F.col("documents_sensitive"), no_lab_document_evidence=lab & ~F.col("has_lab_document") & weak))
    bundle = F.col("is_preop") & (F.col("preop_markers") >= 4) & (F.col("has_procedure") | F.col("category").rlike("^(LAB|IMG|FUN)"))
    clause = F.col("step2_decision").isin("contract_review_admin_or_clause_sensitive", "contract_review_screening_sensitive")
    out = out.withColumn("routing_flags", flags(preop_bundle_or_workup_case=bundle, needs_contract_side_review=F.startswith(F.col("step2_decision"), F.lit("contract_unknown_with_")), clause_sensitive_review=clause))
    d = (
        F.when(F.arrays_overlap("traceability_flags", F.array(F.lit("missing_case_bundle"), F.lit("missing_claim_reference"))), "admin_review_missing_traceability")
        .when(F.array_contains("routing_flags", "preop_bundle_or_workup_case"), "admin_review_preop_or_workup_bundle")
        .when(F.size("document_flags") > 0, "admin_review_document_or_context_gap")
        .when(F.size("routing_flags") > 0, "admin_review_contract_followup")
        .otherwise("admin_clear")
    )
    return out.withColumn("step3_decision", d)


SUPPORTED = (
    "supported_by_both", "supported_by_final_diagnosis", "supported_by_lab_results", "supported_by_result_disease",
    "supported_by_protocol_semantic", "supported_by_tmh_structured", "supported_by_initial_signs",
)


def final_step(medical: Column, step2: Column, step3: Column, contract_status: Column) -> Column:
    """AD6: struct<decision, route_group, priority> of step 4."""
    go = lambda d, g, p: {"decision": d, "route_group": g, "priority": p}
    return cases(
        [
            (step3 == "admin_review_missing_traceability", go("manual_review_admin_traceability", "admin", "high")),
            (step3 == "admin_review_preop_or_workup_bundle", go("manual_review_bundle_context", "admin", "high")),
            (step3 == "admin_review_document_or_context_gap", go("manual_review_admin_documents", "admin", "medium")),
            (medical == "not_medically_supported", go("deny_candidate_medical", "medical", "high")),
            (step2.isin("contract_partial_pay_sensitive", "contract_unknown_with_partial_pay_prior"), go("manual_review_partial_pay", "contract", "medium")),
            (step2.rlike("^contract_review_|_with_(screening|not_covered)_prior$"), go("manual_review_contract_sensitive", "contract", "high")),
            (medical == "uncertain", go("manual_review_clinical_uncertain", "medical", "medium")),
            (contract_status == "contract_unknown", go("medical_clear_pending_contract", "contract", "medium")),
            ((step2 == "contract_clear") & medical.isin(*SUPPORTED) & (step3 == "admin_clear"), go("approve_candidate", "approve", "normal")),
        ],
        go("manual_review_combined", "mixed", "medium"),
    )


def resolve(clinical: Column, contract: Column, anomaly: Column, flags: Column, fallback: Column) -> Column:
    """AD7: struct<decision, confidence, rule> from three verdicts (structs with decision and confidence), the anomaly
    flags (array) and whether the clinical verdict is a fallback."""
    is_ = lambda v, *d: v["decision"].isin(*d)
    sure = lambda v: v["confidence"].cast("double")
    go = lambda d, c, r: {"decision": d, "confidence": c if isinstance(c, Column) else F.lit(float(c)), "rule": r}
    review = is_(anomaly, "review") & (F.size(flags) > 0)
    least = F.least(sure(clinical), sure(contract))
    weak = is_(contract, "uncertain", "review")
    hard = [(is_(v, "deny") & (sure(v) >= 0.70), go("deny", sure(v), "rule_1")) for v in (clinical, contract, anomaly)]
    return cases(
        [
            *hard,
            (is_(clinical, "deny"), go("deny", sure(clinical), "rule_1b")),
            (is_(contract, "deny"), go("deny", sure(contract), "rule_1c")),
            (review & is_(clinical, "approve") & (sure(clinical) >= 0.80), go("approve", F.least(sure(clinical), F.lit(0.75)), "rule_2_override")),
            (review, go("review", 0.55, "rule_2")),
            (is_(contract, "partial_pay"), go("partial_pay", sure(contract), "rule_3")),
            (is_(clinical, "uncertain") & weak, go("deny", 0.55, "rule_4")),
            (is_(clinical, "uncertain") & is_(contract, "approve") & ~fallback & (sure(contract) >= 0.80), go("approve", 0.7 * least, "rule_4b")),
            (is_(clinical, "uncertain") & is_(contract, "approve"), go("review", 0.50, "rule_4b")),
            (is_(clinical, "approve") & is_(contract, "approve"), go("approve", least, "rule_5")),
            (is_(clinical, "approve") & is_(contract, "uncertain"), go("review", 0.55, "rule_5b")),
        ],
        go("review", 0.40, "rule_6"),
    )


def apply_claim_defaults(claims: DataFrame, lines: DataFrame, key: str, fields: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """AD8: a line's missing fields from its claim; lists of both are joined, each entry once."""
    up = claims.select(key, *[F.col(f).alias(f"__{f}") for f in (*fields, *lists)])
    empty = F.array().cast("array<string>")
    out = lines.join(up, key, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col(f), F.col(f"__{f}")))
    for f in lists:
        out = out.withColumn(f, F.array_union(F.coalesce(F.col(f), empty), F.coalesce(F.col(f"__{f}"), empty)))
    return out.drop(*[f"__{f}" for f in (*fields, *lists)])


def claim_decision(lines: DataFrame, claim: str, decision: str) -> DataFrame:
    """AD9: the claim's decision from those of its lines."""
    any_, every = (lambda d: F.bool_or(F.col(decision) == d)), (lambda d: F.bool_and(F.col(decision) == d))
    d = F.when(any_("partial_pay"), "partial_pay").when(any_("review"), "review").when(every("deny"), "deny").when(every("approve"), "approve").otherwise("review")
    return lines.groupBy(claim).agg(F.count(F.lit(1)).alias("n_lines"), d.alias("claim_decision"))


def mvp_decision(justified: Column, clinical: Column, eligible: Column, flags: Column) -> Column:
    """AD10: struct<decision, confidence> of the combined rule. clinical: its confidence."""
    flagged = F.size(flags) > 0
    d = F.when(~justified, "deny").when(~eligible, "deny").when(flagged, "approve_with_flag").when(clinical < 0.52, "manual_review").otherwise("approve")
    c = clinical * 0.7 + F.when(eligible, 0.2).otherwise(0.0) - F.when(flagged, 0.08).otherwise(0.0)
    return F.struct(d.alias("decision"), F.round(F.least(F.lit(0.98), F.greatest(F.lit(0.1), c)), 3).alias("confidence"))


def merge_verdicts(evidence: Sequence[Column], reasoning: Sequence[Column], n: int = 10) -> Column:
    """AD11: the n weightiest evidence items of all verdicts and their reasoning as one text. Items are structs with
    weight, source, key, value."""
    items = F.flatten(F.array(*evidence))
    keyed = F.transform(items, lambda e: F.struct((-e["weight"]).alias("w"), e["source"].alias("source"), e["key"].alias("key"), e["value"].alias("value")))
    top = F.slice(F.array_sort(keyed), 1, n)
    return F.struct(F.transform(top, lambda e: F.struct(e["source"].alias("source"), e["key"].alias("key"), e["value"].alias("value"), (-e["w"]).alias("weight"))).alias("evidence"), F.concat_ws(" ", *reasoning).alias("reasoning"))
