"""Knowledge governance and memory (KG, MM)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, norm_key, stable_id
from .memory_search import candidates
from .windows import keep_latest, topk


def version_assets(current: DataFrame, scan: DataFrame, key: str = "path", digest: str = "sha1") -> DataFrame:
    """KG1: the next state of assets(key, digest, version): a changed digest raises the version, new ones start at 1,
    missing ones become inactive."""
    old = current.select(key, F.col(digest).alias("__old"), F.col("version").alias("__v"))
    both = old.join(scan.select(key, F.col(digest).alias("__new")), key, "full_outer")
    version = F.when(F.col("__old").isNull(), 1).when(F.col("__new").isNull() | (F.col("__old") == F.col("__new")), F.col("__v")).otherwise(F.col("__v") + 1)
    status = F.when(F.col("__new").isNull(), "inactive").otherwise("active")
    return both.select(key, F.coalesce("__new", "__old").alias(digest), version.cast("int").alias("version"), status.alias("status"))


def asset_trace(assets: DataFrame, nodes: DataFrame) -> DataFrame:
    """KG2: nodes by label that came from each asset. nodes(source, label)."""
    return assets.join(nodes, assets["path"] == nodes["source"], "left").groupBy("asset_id").agg(F.count("label").alias("n_nodes"), F.array_sort(F.collect_set("label")).alias("labels"))


def impact(touched: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """KG3: distinct things that an asset reaches, severity and whether it needs review. touched: one row per path."""
    out = touched.groupBy(*keys).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])
    total = sum((F.col(f"n_{c}") for c in columns), F.lit(0))
    return out.withColumn("severity", F.when(total >= 20, "high").when(total >= 5, "medium").otherwise("low")).withColumn("needs_review", total >= 5)


def classify_assets(assets: DataFrame, rules: Sequence[tuple[str, str]], default: str = "other") -> DataFrame:
    """KG4: kind of each asset by the first (kind, pattern) that its path matches."""
    from ..functions.text import first_match

    return assets.withColumn("kind", first_match(F.lower("path"), rules, default))


def apply_labels(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """KG5: a mention for each label span on the chunk that covers it. chunks(doc_id, chunk_id, start, end),
    labels(doc_id, label_id, start, end)."""
    c = chunks.select("doc_id", "chunk_id", F.col("start").alias("c0"), F.col("end").alias("c1"))
    fit = labels.join(c, "doc_id").filter((F.col("start") >= F.col("c0")) & (F.col("end") <= F.col("c1")))
    best = topk(fit, ["label_id"], [F.col("c1") - F.col("c0"), F.col("chunk_id")], 1)
    return best.select(stable_id("mention:", F.col("label_id"), F.col("chunk_id")).alias("mention_id"), "label_id", "chunk_id", (F.col("start") - F.col("c0")).alias("offset"))


def surface_inventory(files: DataFrame, spec: DataFrame) -> DataFrame:
    """KG7: files of each surface against the spec(surface, min_files), with a warning where there are too few."""
    n = files.groupBy("surface").agg(F.count(F.lit(1)).alias("n_files"))
    out = spec.join(n, "surface", "left").na.fill(0, ["n_files"])
    return out.withColumn("warning", F.when(F.col("n_files") == 0, "missing").when(F.col("n_files") < F.col("min_files"), "too_few"))


def recency_bonus(age_days: Column) -> Column:
    """0.24 up to 7 days, 0.14 up to 30, 0.06 up to 90, else 0."""
    return F.when(age_days <= 7, 0.24).when(age_days <= 30, 0.14).when(age_days <= 90, 0.06).otherwise(0.0)


# Weights of the recall's overlaps and bonuses of memory kinds.
OVERLAPS = {"disease": 4.0, "sign": 2.4, "service": 2.1, "query": 1.8}
KIND_BONUS = {"procedural": 0.18, "semantic": 0.12, "episodic": 0.0}


def recall(
    queries: DataFrame, memory: DataFrame, k: int, scopes: Sequence[str] = (), kinds: Sequence[str] = (), categories: Sequence[str] = (), specialty: str | None = None, min_importance: float = 0.0
) -> DataFrame:
    """MM1: the k best memories of each query: weighted overlaps of the four token lists and bonuses for kind,
    importance, recency, access, a scope that was asked for (+0.2), the asked specialty (+1.2) and the category
    successful_pattern (+0.12). Both sides have disease, sign, service, query (arrays of tokens); memory also memory_id,
    kind, scope, importance, age_days, access_count, and where it has them category, specialty. Scopes (shared memories
    always count), kinds, categories and the least importance filter memories; a null scope is shared, a null kind
    episodic, a null importance 0. A memory that shares no token with a query counts by its bonuses alone. Every query
    meets every memory, in blocks of bounded size."""
    null = F.lit(None).cast("string")
    memory = memory.withColumns({"scope": F.coalesce("scope", F.lit("shared")), "kind": F.coalesce("kind", F.lit("episodic")), "importance": F.coalesce("importance", F.lit(0.0))})
    memory = memory.withColumns({c: null for c in ("category", "specialty") if c not in memory.columns}).filter(F.col("importance") >= min_importance)
    if categories:
        memory = memory.filter(F.col("category").isin(*categories))
    m = memory
    if scopes:
        m = m.filter(F.col("scope").isin(*scopes, "shared"))
    if kinds:
        m = m.filter(F.col("kind").isin(*kinds))
    bonus = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KIND_BONUS.items() for x in kv]), F.col("kind")), F.lit(0.0)) + 0.9 * F.col("importance") + recency_bonus(F.col("age_days"))
    bonus = bonus + F.least(0.08 * F.log1p(F.greatest("access_count", F.lit(0)).cast("double")), F.lit(0.3))
    bonus = bonus + (F.when(F.col("scope").isin(*scopes), 0.2).otherwise(0.0) if scopes else 0.0)
    bonus = bonus + F.when(F.col("category") == "successful_pattern", 0.12).otherwise(0.0)
    if specialty:
        bonus = bonus + F.when(norm_key(F.col("specialty")) == norm_key(F.lit(specialty)), 1.2).otherwise(0.0)
    m = m.withColumn("bonus", bonus)
    found = candidates(queries, m, OVERLAPS, k).withColumn("score", F.round("s", 4))
    found = found.filter(F.when(F.col("met"), F.col("score") > 0).otherwise(F.col("s") > 0)).select("query_id", "memory_id", "score")
    return topk(found, ["query_id"], [F.col("score").desc(), F.col("memory_id")], k, rank="rank")


def promote(memory: DataFrame, kinds: Sequence[str] = ("procedural", "semantic")) -> DataFrame:
    """MM2: promoted copies of episodic memories, for kinds that a source does not have yet. memory(memory_id, source_id,
    kind, importance)."""
    made = memory.filter("kind = 'episodic'").withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    made = made.withColumn("memory_id", stable_id("mem:", F.col("source_id"), F.col("kind"))).withColumn("importance", F.round(F.least(F.col("importance") + 0.05, F.lit(0.98)), 4))
    return made.join(memory.select("source_id", "kind"), ["source_id", "kind"], "left_anti").select(*memory.columns)


def mine_experiences(cases: DataFrame) -> DataFrame:
    """MM3: (case_id, category, severity) for each lesson a batch's case teaches. cases(case_id, top1_hit, top3_hit,
    n_unmapped, n_lines)."""
    lesson = lambda c, category, severity: F.when(c, F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity")))
    found = F.array(
        lesson(F.col("top1_hit"), "successful_pattern", "low"),
        lesson(~F.col("top1_hit") & F.col("top3_hit"), "ranking_gap", "medium"),
        lesson(~F.col("top3_hit"), "missed_disease", "high"),
        lesson(F.col("n_unmapped") * 2 > F.col("n_lines"), "mapping_gap", "medium"),
    )
    return cases.select("case_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("case_id", "x.*")


def layer_effectiveness(lessons: DataFrame, keys: Sequence[str], order: Sequence[Column], last: int = 50) -> DataFrame:
    """MM4: over each key's last lessons how often each layer was tried and how often it helped. lessons(effective,
    empty: arrays of layers)."""
    recent = keep_latest(lessons, order, last, keys)
    good = recent.select(*keys, F.explode("effective").alias("layer"), F.lit(1.0).alias("v"))
    none = recent.select(*keys, F.explode("empty").alias("layer"), F.lit(0.0).alias("v"))
    return good.unionByName(none).groupBy(*keys, "layer").agg(F.count(F.lit(1)).alias("n_tried"), F.round(F.avg("v"), 4).alias("effectiveness"))


def recall_lessons(queries: DataFrame, lessons: DataFrame, k: int) -> DataFrame:
    """MM5: lessons for each query: with the same hash, else by vector, else by shared tokens; only the first of these
    ways that finds any counts. Both: hash, tokens (array), vec (array); queries query_id, lessons lesson_id."""
    from .documents import vector_search
    from .graph import tiered

    exact = queries.select("query_id", "hash").join(lessons.select("lesson_id", "hash"), "hash").select("query_id", "lesson_id", F.lit(1.0).alias("score"))
    near = vector_search(queries.select("query_id", F.col("vec").alias("q")), lessons.select(F.col("lesson_id").alias("vec_id"), F.col("vec").alias("v")), k).filter("score >= 0.8").select("query_id", F.col("vec_id").alias("lesson_id"), "score")
    a, b = queries.select("query_id", "tokens", F.explode("tokens").alias("t")), lessons.select("lesson_id", F.col("tokens").alias("other"), F.explode("tokens").alias("t"))
    text = a.join(b, "t").drop("t").distinct().select("query_id", "lesson_id", jaccard(F.col("tokens"), F.col("other")).alias("score"))
    return topk(tiered(exact, near, text, key="query_id", order=[]), ["query_id"], [F.col("score").desc(), F.col("lesson_id")], k, rank="rank")


def touch_lessons(lessons: DataFrame, used: DataFrame) -> DataFrame:
    """MM5: lessons with the access counter raised by their uses(lesson_id)."""
    n = used.groupBy("lesson_id").agg(F.count(F.lit(1)).alias("__n"))
    return lessons.join(n, "lesson_id", "left").withColumn("access_count", F.col("access_count") + F.coalesce("__n", F.lit(0))).drop("__n")


def evict_lessons(lessons: DataFrame, most: int, tie: str = "lesson_id") -> DataFrame:
    """MM5: the newest ``most`` lessons, the store's limit; of equal times those with the least ``tie``. lessons(ts).
    Where a stream writes them, keyed_table.merge_stream with ``keep`` holds to the limit as it merges."""
    return lessons.orderBy(F.col("ts").desc_nulls_last(), tie).limit(most)


def lesson_stats(lessons: DataFrame) -> DataFrame:
    """MM5: one row: total_memories, avg_confidence, sufficient_rate (zeros for an empty store). lessons(confidence,
    was_sufficient)."""
    n = F.count(F.lit(1))
    sure = F.count_if("was_sufficient") / F.greatest(n, F.lit(1))
    return lessons.agg(n.alias("total_memories"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("avg_confidence"), F.round(sure, 3).alias("sufficient_rate"))


def memory_stats(memory: DataFrame, columns: Sequence[str]) -> DataFrame:
    """MM6: counts by each column at once: dimension, value, n."""
    rows = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    return memory.select(F.explode(rows).alias("x")).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


def find_similar(queries: DataFrame, runs: DataFrame, k: int) -> DataFrame:
    """MM7: each query's k nearest runs and, on every row, the best-scored prompt among them. runs(run_id, vec, prompt,
    result_score)."""
    from .documents import vector_search

    near = vector_search(queries.select("query_id", F.col("vec").alias("q")), runs.select(F.col("run_id").alias("vec_id"), F.col("vec").alias("v")), k)
    full = near.join(runs.select(F.col("run_id").alias("vec_id"), "prompt", "result_score"), "vec_id")
    best = full.groupBy("query_id").agg(F.max_by("prompt", F.struct("result_score", -F.col("vec_id"))).alias("best_prompt"))
    return full.join(best, "query_id").select("query_id", F.col("vec_id").alias("run_id"), "score", "rank", "best_prompt")
