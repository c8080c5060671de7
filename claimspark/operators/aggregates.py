"""Aggregations (AG)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import topk

Keys = Sequence[str]


def contract_stats(claims: DataFrame, keys: Keys) -> DataFrame:
    """AG1: rows, requested, paid, paid ratio in percent, and whether any row was reduced. claims(requested, paid)."""
    out = claims.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("requested").alias("requested_sum"), F.sum("paid").alias("paid_sum"), F.bool_or(F.col("paid") < F.col("requested")).alias("any_reduced"))
    return out.withColumn("paid_ratio_pct", F.round(F.try_divide(100 * F.col("paid_sum"), F.col("requested_sum")), 2))


def top_counts(df: DataFrame, keys: Keys, value: str, n: int) -> DataFrame:
    """The n most frequent values of each group in rows: keys, value, n_rows, rank."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_rows"))
    return topk(counts, keys, [F.col("n_rows").desc(), F.col(value)], n, rank="rank")


def top_values(df: DataFrame, keys: Keys, value: str, n: int, out: str = "top") -> DataFrame:
    """AG2: the same as an array of structs per group."""
    ranked = top_counts(df, keys, value, n)
    lists = F.array_sort(F.collect_list(F.struct("rank", F.col(value).alias("value"), F.col("n_rows").alias("count"))))
    return ranked.groupBy(*keys).agg(F.transform(lists, lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))).alias(out))


def conditional_sums(df: DataFrame, keys: Keys, kind: str, kinds: Sequence[str], amount: str | None = None) -> DataFrame:
    """AG3, AG8, AG9: a column of counts (or sums of amount) for each kind."""
    value = F.col(amount) if amount else F.lit(1)
    return df.groupBy(*keys).agg(*[F.sum(F.when(F.col(kind) == k, value).otherwise(0)).alias(k) for k in kinds])


def service_risk(rows: DataFrame, keys: Keys, thresholds: dict[str, int]) -> DataFrame:
    """AG8: counts of risk kinds and a flag for each that reaches its threshold. rows(risk_kind)."""
    out = conditional_sums(rows, keys, "risk_kind", list(thresholds))
    return out.select("*", *[(F.col(k) >= t).alias(f"{k}_sensitive") for k, t in thresholds.items()])


def clause_index(records: DataFrame, keys: Keys, samples: int = 3) -> DataFrame:
    """AG4: per clause: rows, money gap, the longest label and the first sample notes. records(label, note, gap).
    Samples are the first in order, cut before they are collected."""
    base = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("gap").alias("gap_sum"), F.max_by("label", F.struct(F.length("label"), "label")).alias("longest_label"))
    notes = topk(records.select(*keys, "note").distinct(), keys, [F.col("note")], samples).groupBy(*keys).agg(F.array_sort(F.collect_list("note")).alias("sample_notes"))
    return base.join(notes, list(keys), "left")


def share_of(df: DataFrame, keys: Keys, flags: Sequence[str]) -> DataFrame:
    """AG5: rows and the percentage of rows with each flag."""
    pct = [F.round(100 * F.avg(F.when(F.col(f), 1.0).otherwise(0.0)), 2).alias(f"{f}_pct") for f in flags]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *pct)


def exclusion_summary(records: DataFrame, keys: Keys, signals: Sequence[str]) -> DataFrame:
    """AG6: rows, gap and how many rows have each signal."""
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("gap").alias("gap_sum"), *[F.count_if(F.col(s)).alias(f"n_{s}") for s in signals])


def benefit_profiles(details: DataFrame, keys: Keys, claim: str, amount: str, status: str, approx: bool = False) -> DataFrame:
    """AG7: rows, distinct claims, amount and the number of different statuses per benefit."""
    distinct = F.approx_count_distinct(claim) if approx else F.count_distinct(claim)
    return details.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), distinct.alias("n_claims"), F.sum(amount).alias("amount"), F.count_distinct(status).alias("n_statuses"))


def codebook_stats(lines: DataFrame, keys: Keys, amount: str, name: str) -> DataFrame:
    """AG10: occurrences, variants and average, least and largest positive amount."""
    paid = F.when(F.col(amount) > 0, F.col(amount))
    return lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct(name).alias("variants"), F.round(F.avg(paid), 2).alias("avg_cost"), F.min(paid).alias("min_cost"), F.max(paid).alias("max_cost"))


SIGNALS = ("is_positive", "is_negative", "is_normal", "is_abnormal", "is_narrative")


def lab_features(observations: DataFrame, keys: Keys) -> DataFrame:
    """AG11: counts by signal and a numeric summary. observations(signal flags, numeric_value)."""
    counts = [F.count_if(F.col(s)).alias("n_" + s.removeprefix("is_")) for s in SIGNALS]
    v = F.col("numeric_value")
    return observations.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs"), *counts, F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.round(F.avg(v), 4).alias("avg_value"))


def feature_dictionary(observations: DataFrame, case: str, concept: str, min_cases: int) -> DataFrame:
    """AG12: concepts with their number of cases, and whether they are core (at least min_cases)."""
    out = observations.groupBy(concept).agg(F.count_distinct(case).alias("n_cases"))
    return out.withColumn("is_core", F.col("n_cases") >= min_cases)


def core_matrix(features: DataFrame, case: str, concept: str, concepts: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """AG13: one row per case, a column for each concept and measure. features has one row per case and concept."""
    one = lambda c, m: F.max(F.when(F.col(concept) == c, F.col(m))).alias(f"{c}_{m}")
    return features.groupBy(case).agg(*[one(c, m) for c in concepts for m in measures])


def lab_support(observations: DataFrame, keys: Keys) -> DataFrame:
    """AG14: signal counts, support level and conflict."""
    out = lab_features(observations, keys)
    p, a, n = F.col("n_positive"), F.col("n_abnormal"), F.col("n_narrative")
    level = F.when((p > 0) | (a >= 2), "strong").when((a == 1) | (n > 0), "moderate").otherwise("observed")
    return out.select(*keys, "n_obs", "n_positive", "n_negative", "n_abnormal", "n_narrative", level.alias("support_level"), ((p > 0) & (F.col("n_negative") > 0)).alias("conflicting"))


def distribution(df: DataFrame, col: str, keys: Keys = ()) -> DataFrame:
    """AG15: counts of a column's values with their percentage of the group (or of all)."""
    out = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n_rows"))
    return out.withColumn("pct", F.round(100 * F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(*keys)), 2))


def cross_counts(df: DataFrame, pairs: dict[str, Column]) -> DataFrame:
    """AG16: how many rows meet each condition, as one row."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in pairs.items()])


def duplicate_keys(nodes: DataFrame, keys: Keys, n: int = 20) -> DataFrame:
    """AG17: the n keys that occur most often, of those that occur more than once."""
    many = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
    return many.orderBy(F.col("n_rows").desc(), *keys).limit(n)


def graph_health(nodes: DataFrame, edges: DataFrame, minimum: int = 1) -> DataFrame:
    """AG18: number of nodes per label and edges per type, with ready where the number reaches the minimum."""
    a = nodes.groupBy(F.lit("node").alias("part"), F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    b = edges.groupBy(F.lit("edge").alias("part"), F.col("edge_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b).withColumn("ready", F.col("n") >= minimum)


def hotspots(edges: DataFrame, by: Keys, n: int) -> DataFrame:
    """AG19: the n nodes with most edges."""
    return edges.groupBy(*by).agg(F.count(F.lit(1)).alias("n_edges")).orderBy(F.col("n_edges").desc(), *by).limit(n)


#: Factor of the coverage score -> (count that fills it, weight).
COVERAGE = {"chunks": (50, 0.30), "assertions": (10, 0.25), "signs": (5, 0.15), "services": (5, 0.15), "summaries": (1, 0.10), "section_types": (5, 0.05)}


def coverage(inventory: DataFrame) -> DataFrame:
    """AG20: inventory (a column for each factor of COVERAGE) with coverage_score."""
    score = sum((F.least(F.col(k) / F.lit(float(full)), F.lit(1.0)) * w for k, (full, w) in COVERAGE.items()), F.lit(0.0))
    return inventory.withColumn("coverage_score", F.round(score, 4))


def corpus_stats(nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AG21: distinct values of each column and the largest of them, one row."""
    out = nodes.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])
    return out.withColumn("n_entities", F.greatest(*[F.col(f"n_{c}") for c in columns]))


def root_summary(assets: DataFrame, roots: DataFrame) -> DataFrame:
    """AG22: files, bytes and duplicates of each root; empty roots stay. assets(root_key, sha1, size_bytes)."""
    copies = assets.withColumn("__copies", F.count(F.lit(1)).over(Window.partitionBy("sha1")))
    sums = copies.groupBy("root_key").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), F.count_if(F.col("__copies") > 1).alias("duplicates"))
    return roots.join(sums, "root_key", "left").na.fill(0, ["files", "bytes", "duplicates"])


def contract_summary(edges: DataFrame, contract: str, columns: Sequence[str]) -> DataFrame:
    """AG23: distinct plans, benefits, exclusions, ... of each contract."""
    return edges.groupBy(contract).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def gap_rollup(records: DataFrame, keys: Keys) -> DataFrame:
    """AG25: money gap by keys with subtotals and the total; level tells which keys are rolled up."""
    return records.rollup(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("requested") - F.col("paid")).alias("gap"), F.grouping_id().cast("int").alias("level"))


def benefit_alignment(entries: DataFrame, profiles: DataFrame) -> DataFrame:
    """AG27: contract entries and allocation profiles under one canonical benefit, the raw key where there is none.
    entries(canonical, raw_key, contract), profiles(canonical, raw_key, amount)."""
    key = F.coalesce("canonical", "raw_key").alias("benefit")
    e = entries.groupBy(key).agg(F.count(F.lit(1)).alias("n_entries"), F.array_sort(F.collect_set("contract")).alias("contracts"))
    p = profiles.groupBy(key).agg(F.count(F.lit(1)).alias("n_profiles"), F.sum("amount").alias("amount"))
    return e.join(p, "benefit", "full_outer").na.fill(0, ["n_entries", "n_profiles"])
