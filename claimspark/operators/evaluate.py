"""Evaluation (EV)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_fold, norm_key

# Names of a decision that count as the same, and names that an ICD code stands for.
EQUIVALENT = {
    "partial_pay": ("partial_pay", "partial_review", "partial"),
    "approve": ("approve", "payment", "accept", "medically_necessary", "medically_reasonable", "medically_indicated", "indicated", "pay", "pay_full", "covered"),
    "deny": ("deny", "reject", "not_indicated", "not_medically_indicated", "not_medically_necessary", "contraindicated", "not_covered"),
    "review": ("review", "conditional_indication", "conditionally_indicated"),
    "uncertain": ("uncertain",),
}
ICD_ALIASES = {
    "H81.0": ("meniere", "benh meniere", "meniere disease"),
    "H81.1": ("bppv", "chong mat do vi tri", "benign paroxysmal positional vertigo"),
    "H81.2": ("viem than kinh doi", "vestibular neuritis"),
    "H83.0": ("viem maze", "labyrinthitis"),
    "J18": ("viem phoi", "pneumonia", "viem phoi cong dong", "community acquired pneumonia"),
    "J18.9": ("viem phoi", "pneumonia", "viem phoi cong dong", "community acquired pneumonia", "cap"),
    "J20": ("viem phe quan", "bronchitis", "viem phe quan cap"),
    "J20.9": ("viem phe quan", "bronchitis", "viem phe quan cap"),
    "K35": ("viem ruot thua", "appendicitis"),
    "E11": ("dai thao duong type 2", "diabetes mellitus type 2"),
    "A15": ("lao phoi", "tuberculosis", "tb"),
}


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 4)


def classification_report(pairs: DataFrame, pred: str, gold: str, keys: Sequence[str] = ()) -> DataFrame:
    """EV1: confusion matrix and rates of a boolean prediction against a boolean label."""
    p, g = F.col(pred), F.col(gold)
    n = {"tp": p & g, "fp": p & ~g, "tn": ~p & ~g, "fn": ~p & g}
    out = pairs.groupBy(*keys).agg(*[F.count_if(c).alias(k) for k, c in n.items()])
    tp, fp, tn, fn = (F.col(k) for k in n)
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return out.select(
        *keys, *n, ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), recall.alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), specificity.alias("specificity"), F.round((recall + specificity) / 2, 4).alias("balanced_accuracy"),
    )


def errors(pairs: DataFrame, pred: str, gold: str) -> DataFrame:
    """EV2: the wrong rows, with kind false_positive or false_negative."""
    return pairs.filter(F.col(pred) != F.col(gold)).withColumn("kind", F.when(F.col(pred), "false_positive").otherwise("false_negative"))


def decision_group(c: Column) -> Column:
    """EV4: the group of a decision's name, else the folded name."""
    plain = F.length(c) == F.octet_length(c)
    folded = F.trim(F.when(plain, F.lower(c)).otherwise(ascii_fold(c)))
    name = F.replace(F.replace(folded, F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
    groups = F.create_map(*[F.lit(x) for group, names in EQUIVALENT.items() for n in names for x in (n, group)])
    # Names as they stand in the lists need no folding, and ASCII no table of accents.
    return F.coalesce(F.try_element_at(groups, c), F.try_element_at(groups, name), name)


def decision_match(observed: Column, expected: Column) -> Column:
    """EV4: exact, equivalent (of one group) or mismatch."""
    return F.when(ascii_fold(observed) == ascii_fold(expected), "exact").when(decision_group(observed) == decision_group(expected), "equivalent").otherwise("mismatch")


def soft_match(expected: Column, submitted: Column, icd: Column | None = None) -> Column:
    """EV4: exact, substring, icd (the submitted code stands for the expected name), token_overlap (60 % of the expected
    tokens) or none, for two names."""
    e, s = norm_key(expected), norm_key(submitted)
    et, st = F.array_distinct(F.split(e, " ")), F.array_distinct(F.split(s, " "))
    overlap = F.size(F.array_intersect(et, st))
    out = F.when((e == "") | (s == ""), "none").when(e == s, "exact").when(F.contains(s, e) | F.contains(e, s), "substring")
    if icd is not None:
        known = F.create_map(*[x for k, names in ICD_ALIASES.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in names]))])
        names = F.coalesce(F.try_element_at(known, F.upper(F.trim(icd))), F.array().cast("array<string>"))
        out = out.when(F.exists(names, lambda n: F.contains(e, n) | F.contains(n, e)), "icd")
    return out.when(overlap >= F.greatest(F.lit(1.0), 0.6 * F.size(et)), "token_overlap").otherwise("none")


def score_submissions(gold: DataFrame, submitted: DataFrame, claims: DataFrame) -> DataFrame:
    """EV3: per participant and case the shares of right lines and the weighted score .15 disease + .35 medical + .30
    final + .20 claim. gold(case_id, line_no, medical, insurance, final), submitted(participant, case_id, line_no,
    medical, insurance, final), claims(participant, case_id, disease_hit, claim_hit). A line that a participant left out
    is wrong."""
    # Groups of decisions are found where the decisions stand, before lines are repeated for participants and joined.
    kinds = ("medical", "insurance", "final")
    g = gold.select("case_id", "line_no", *[decision_group(F.col(c)).alias(c) for c in kinds])
    s = submitted.select("participant", "case_id", "line_no", *[decision_group(F.col(c)).alias(f"s_{c}") for c in kinds])
    asked = claims.select("participant", "case_id").join(g, "case_id")
    same = lambda c: F.avg(F.coalesce((F.col(c) == F.col(f"s_{c}")).cast("double"), F.lit(0.0)))
    # Cases come first among the keys: rows are sorted by their first key before any other is looked at.
    lines = asked.join(s, ["case_id", "line_no", "participant"], "left").groupBy("participant", "case_id").agg(*[F.round(same(c), 4).alias(f"{c}_score") for c in kinds])
    out = claims.join(lines, ["case_id", "participant"], "left").select(*claims.columns, *[f"{c}_score" for c in kinds]).na.fill(0.0)
    weighted = 0.15 * F.col("disease_hit").cast("double") + 0.35 * F.col("medical_score") + 0.30 * F.col("final_score") + 0.20 * F.col("claim_hit").cast("double")
    return out.withColumn("weighted_score", F.round(weighted, 4))


def round_scaled(c: Column, digits: int) -> Column:
    """A double rounded as SQL engines round it, times a power of ten: 1.005, which is a little less as a double, is 1.0.
    F.round goes by the shortest decimal form and makes it 1.01."""
    return F.round(c * 10.0**digits) / 10.0**digits


def leaderboard(scores: DataFrame, participant: str, case: str, score: str, digits: int = 4) -> DataFrame:
    """EV5: cases, average score (to so many digits) and wins (cases in which nobody scored higher; ties count for all)."""
    best = F.max(score).over(Window.partitionBy(case))
    return scores.withColumn("won", F.col(score) == best).groupBy(participant).agg(F.count(F.lit(1)).alias("n_cases"), round_scaled(F.avg(score), digits).alias("avg_score"), F.count_if("won").alias("wins"))


def hit_rate(ranked: DataFrame, gold: DataFrame, case: str, item: str, ks: Sequence[int]) -> DataFrame:
    """EV6: the share of gold cases whose item is among the first k, and the mean confidence of first places.
    ranked(case, item, rank, confidence), gold(case, item)."""
    place = gold.join(ranked.select(case, item, "rank"), [case, item], "left")
    shares = place.agg(F.count(F.lit(1)).alias("n_cases"), *[F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 4).alias(f"top_{k}") for k in ks])
    first = ranked.filter("rank = 1").agg(F.round(F.avg("confidence"), 4).alias("mean_confidence"))
    return shares.join(F.broadcast(first), F.lit(True))


def mapping_coverage(lines: DataFrame, case: str, status: str, statuses: Sequence[str]) -> DataFrame:
    """EV7: lines of each status per case and the share mapped (the first status)."""
    out = lines.groupBy(case).agg(F.count(F.lit(1)).alias("n_lines"), *[F.count_if(F.col(status) == s).alias(f"n_{s}") for s in statuses])
    return out.withColumn("coverage", ratio(F.col(f"n_{statuses[0]}"), F.col("n_lines")))


def qa_accuracy(judged: DataFrame, category: str, score: str, threshold: float) -> DataFrame:
    """EV8: questions, passes and accuracy by category."""
    out = judged.groupBy(category).agg(F.count(F.lit(1)).alias("n_questions"), F.count_if(F.col(score) >= threshold).alias("n_passed"))
    return out.withColumn("accuracy", ratio(F.col("n_passed"), F.col("n_questions")))


def run_telemetry(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """EV9: events, assistant messages, turns, tool calls and tokens per run. events(role, tool: nullable, tokens)."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.count_distinct("turn").alias("n_turns"), F.count("tool").alias("n_tool_calls"), F.sum("tokens").alias("tokens"))


def run_report(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """EV9: per run its model, duration, cost, turns, assistant messages, tool calls and their counts by name (a map).
    events: of sources.io.read_run_events() with the keys and seq, the event's number in its run. Model from the first
    system event, else from the last result; duration and cost from the last result, turns too, else the number of
    distinct assistant messages; a tool without a name is "unknown"."""
    kind = F.col("type")
    call = (kind == "assistant") & (F.col("content.type") == "tool_use")
    tool = F.when(call, F.coalesce("content.name", F.lit("unknown")))
    last = lambda c: F.max_by(c, F.when(kind == "result", F.col("seq")))
    facts = {
        "sys_model": F.min_by("model", F.when(kind == "system", F.col("seq"))), "end_model": last("model"), "duration_ms": last("duration_ms"), "cost_usd": last("total_cost_usd"), "end_turns": last("num_turns"),
        "ids": F.count_distinct(F.when((kind == "assistant") & (F.col("message_id") != ""), F.col("message_id"))), "n_assistant": F.count_distinct(F.when(kind == "assistant", F.col("seq"))),
    }
    runs = events.groupBy(*keys).agg(*[c.alias(n) for n, c in facts.items()])
    # Calls are counted by name first, so that a run's map is built from one row for each tool.
    named = events.filter(call).groupBy(*keys, tool.alias("tool")).agg(F.count(F.lit(1)).alias("n"))
    tools = named.groupBy(*keys).agg(F.sum("n").alias("n_tool_calls"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("tool", "n")))).alias("tools"))
    out = runs.join(tools, list(keys), "left")
    none = F.map_from_entries(F.array().cast("array<struct<tool:string,n:bigint>>"))
    return out.select(
        *keys, F.coalesce("sys_model", "end_model").alias("model"), "duration_ms", "cost_usd", F.coalesce(F.col("end_turns").cast("long"), "ids").alias("n_turns"), "n_assistant", F.coalesce("n_tool_calls", F.lit(0)).alias("n_tool_calls"), F.coalesce("tools", none).alias("tools")
    )


def tool_counts(events: DataFrame) -> DataFrame:
    """EV9: calls by tool name; events(content: array<struct<type, name>>)."""
    calls = events.select(F.explode("content").alias("c")).filter("c.type = 'tool_use'")
    return calls.groupBy(F.col("c.name").alias("tool")).agg(F.count(F.lit(1)).alias("n_calls"))


def evidence_sources(results: DataFrame) -> DataFrame:
    """EV10: evidence items by source; results(evidence: array<struct<source, ...>>)."""
    return results.select(F.explode("evidence").alias("e")).groupBy(F.col("e.source").alias("source")).agg(F.count(F.lit(1)).alias("n_items"))


def benchmark_coverage(expected: DataFrame, edges: DataFrame) -> DataFrame:
    """EV11: per disease expected services, those in the graph, and their share. Both: disease, service."""
    have = edges.select("disease", "service").distinct().withColumn("have", F.lit(1))
    out = expected.distinct().join(have, ["disease", "service"], "left").groupBy("disease").agg(F.count(F.lit(1)).alias("n_expected"), F.count("have").alias("n_found"))
    return out.withColumn("coverage", ratio(F.col("n_found"), F.col("n_expected")))


def trace_accuracy(lines: DataFrame, case: str, decision: Column, label: str) -> DataFrame:
    """EV12: per case and over all: lines, matches and accuracy of a decision against its label; the row with a null
    case is the total."""
    out = lines.withColumn("__ok", F.coalesce(decision == F.col(label), F.lit(False))).rollup(case).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("__ok").alias("n_matches"))
    return out.withColumn("accuracy", ratio(F.col("n_matches"), F.col("n_lines")))


def support_decision(score: Column, mapped: Column) -> Column:
    """The line decision of a trace: by its support score, review where the service is not mapped."""
    return F.when(~mapped, "review").when(score >= 0.65, "approve").when(score >= 0.4, "review").otherwise("deny")
