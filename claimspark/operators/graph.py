"""Node and edge tables (GR) and keyed upserts (IO8-IO10, IO13). No graph engine: a path is a join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import graded_match, norm_key, stable_id
from ..sources.scratch import cut, deal, maybe_broadcast
from .term_scan import term_hits
from .windows import top1, topk

Keys = Sequence[str]


def upsert(existing: DataFrame, incoming: DataFrame, keys: Keys, on_match: Sequence[str], on_create: Sequence[str] = ()) -> DataFrame:
    """IO8: existing rows with incoming ones merged in by key. on_match: columns the incoming row sets when it has a
    value; on_create: columns it sets on new rows only. The last columns of existing stay as they are."""
    new = incoming.dropDuplicates(list(keys)).select(*keys, *[F.col(c).alias(f"__{c}") for c in (*on_match, *on_create)], F.lit(True).alias("__in"))
    both = existing.withColumn("__old", F.lit(True)).join(new, list(keys), "full_outer")
    value = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in on_match} | {c: F.when(F.col("__old").isNull(), F.col(f"__{c}")).otherwise(F.col(c)) for c in on_create}
    return both.select(*[value.get(c, F.col(c)).alias(c) for c in existing.columns])


def upsert_edges_additive(existing: DataFrame, incoming: DataFrame, keys: Keys, add: Sequence[str]) -> DataFrame:
    """IO9: edges by key, the additive columns summed."""
    both = existing.select(*keys, *add).unionByName(incoming.select(*keys, *add))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in add])


def overwrite_namespace(df: DataFrame, path: str, column: str = "namespace") -> None:
    """IO10: replaces the namespaces that df holds and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def apply_edits(table: DataFrame, edits: DataFrame, keys: Keys, references: DataFrame | None = None, reference_key: str | None = None) -> DataFrame:
    """IO13: table after edits(op: upsert or delete, the table's columns). Upserts whose reference_key is not in
    references are left out."""
    good = edits if references is None else edits.join(references.select(reference_key), reference_key, "left_semi").unionByName(edits.filter(F.col("op") == "delete").join(references.select(reference_key), reference_key, "left_anti"))
    rest = table.join(good.select(*keys), list(keys), "left_anti")
    return rest.unionByName(good.filter(F.col("op") == "upsert").select(*table.columns).dropDuplicates(list(keys)))


def diseases_for_signs(signs: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """GR1: per query the k diseases with most distinct matched signs. signs(query_id, sign), edges(sign, disease)."""
    hits = signs.distinct().join(edges.distinct(), "sign").groupBy("query_id", "disease").agg(F.count(F.lit(1)).alias("n_signs"), F.array_sort(F.collect_set("sign")).alias("signs"))
    return topk(hits, ["query_id"], [F.col("n_signs").desc(), F.col("disease")], k, rank="rank")


def trace_service(services: DataFrame, medical: DataFrame, policy: DataFrame) -> DataFrame:
    """GR3: every path that ends at a service: medical(service, via, source) and policy(service, via, source)."""
    one = lambda e, kind: services.select("service").join(e, "service").select("service", F.lit(kind).alias("path"), "via", "source")
    return one(medical, "medical").unionByName(one(policy, "contract"))


def ancestors(edges: DataFrame, max_depth: int = 5) -> DataFrame:
    """GR4: (child, ancestor, depth) over edges(child, parent) up to a depth, the shortest way each."""
    step = edges.select("child", F.col("parent").alias("ancestor")).distinct()
    out = now = step.withColumn("depth", F.lit(1))
    up = edges.select(F.col("child").alias("ancestor"), F.col("parent").alias("__next")).distinct()
    for depth in range(2, max_depth + 1):
        now = now.join(up, "ancestor").select("child", F.col("__next").alias("ancestor"), F.lit(depth).alias("depth")).distinct()
        out = out.unionByName(now)
    return out.groupBy("child", "ancestor").agg(F.min("depth").alias("depth"))


def tiered(*tiers: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """GR7, RT13: candidates of several tiers; each key keeps those of its lowest tier, ordered. Adds tier (from 1)."""
    out = None
    for n, t in enumerate(tiers, 1):
        t = t.withColumn("tier", F.lit(n))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    lowest = out.groupBy(key).agg(F.min("tier").alias("tier"))
    return out.join(lowest, [key, "tier"])


def benefits_for_line(lines: DataFrame, edges: DataFrame, benefits: DataFrame, k: int = 1) -> DataFrame:
    """GR5: a line's benefit by a direct edge (score 5), and for lines without one by text within its contract:
    4 equal, 3 prefix, 2 contained, 1 shared token. lines(line_id, contract, service), edges(contract, service,
    benefit), benefits(contract, benefit, name)."""
    # A service's k first benefits are all that its lines can have, so lines meet these instead of every edge.
    first = maybe_broadcast(cut(topk(edges.select("contract", "service", "benefit"), ["contract", "service"], [F.col("benefit")], k)))
    lines = deal(lines.select("line_id", "contract", "service"), "line_id")
    direct = lines.join(first, ["contract", "service"]).select("line_id", "benefit", F.lit(5).alias("score"), F.lit("edge").alias("how"))
    rest = lines.join(direct.select("line_id"), "line_id", "left_anti")
    # Each service of a contract is matched once. Texts meet on a shared word or, as one may stand within the other's
    # words, on the first letters of the service anywhere in the name.
    wanted = rest.select("contract", "service").distinct().withColumn("q", norm_key(F.col("service")))
    offered = benefits.withColumn("n", norm_key(F.col("name")))
    words = lambda c: F.transform(F.split(c, " "), lambda w: F.concat(F.lit("w"), w))
    grams = lambda c, k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (k - 1), F.lit(1))), lambda i: F.concat(F.lit("g"), F.substring(c, i, k)))
    asks = F.array_distinct(F.concat(words(F.col("q")), F.array(F.concat(F.lit("g"), F.substring("q", 1, 3)))))
    gives = F.array_distinct(F.concat(words(F.col("n")), *[grams(F.col("n"), k) for k in (1, 2, 3)]))
    met = wanted.select("contract", "service", F.explode(asks).alias("key")).join(offered.select("contract", "benefit", "name", F.explode(gives).alias("key")), ["contract", "key"])
    pairs = met.select("contract", "service", "benefit", "name").distinct()
    grade = graded_match(F.col("service"), F.col("name"))
    shared = F.arrays_overlap(F.split(norm_key(F.col("service")), " "), F.split(norm_key(F.col("name")), " "))
    score = F.when(grade == 1.0, 4).when(grade == 0.96, 3).when(grade == 0.90, 2).when(shared, 1).otherwise(0)
    best = topk(pairs.withColumn("score", score).filter("score > 0"), ["contract", "service"], [F.col("score").desc(), F.col("benefit")], k)
    best = maybe_broadcast(cut(best.select("contract", "service", "benefit", "score")))
    text = rest.join(best, ["contract", "service"]).select("line_id", "benefit", "score", F.lit("text").alias("how"))
    return topk(direct.unionByName(text), ["line_id"], [F.col("score").desc(), F.col("benefit")], k)


def plan_coverage(lines: DataFrame, plans: DataFrame, covered: DataFrame) -> DataFrame:
    """GR6: lines(line_id, contract, benefit) with covered: whether a plan of the contract has the benefit."""
    reach = plans.select("contract", "plan").distinct().join(covered.select("plan", "benefit").distinct(), "plan").select("contract", "benefit").distinct().withColumn("covered", F.lit(True))
    return lines.join(reach, ["contract", "benefit"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def exclusions_for_line(lines: DataFrame, direct: DataFrame, history: DataFrame, keywords: DataFrame) -> DataFrame:
    """GR7: exclusions by contract edge, else by the service's history, else by a keyword of the service's name.
    direct(contract, service, exclusion), history(service, exclusion, rows), keywords(word, exclusion)."""
    a = lines.join(direct, ["contract", "service"]).select("line_id", "exclusion")
    b = lines.join(history.filter("rows >= 2"), "service").select("line_id", "exclusion")
    words = lines.select("line_id", F.explode(F.array_distinct(F.split(norm_key(F.col("service")), " "))).alias("word"))
    c = words.join(keywords, "word").select("line_id", "exclusion").distinct()
    return tiered(a, b, c, key="line_id", order=[F.col("exclusion")])


def historical_exclusions(profiles: DataFrame, min_rows: int = 2) -> DataFrame:
    """GR8: edges service -> exclusion pattern with at least min_rows rows. profiles(service, patterns: array)."""
    rows = profiles.select("service", F.explode("patterns").alias("pattern"))
    return rows.groupBy("service", "pattern").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= min_rows)


def benefit_support_edges(details: DataFrame, mapping: DataFrame) -> DataFrame:
    """GR9: edges category -> benefit with rows and amount. details(service, benefit, amount), mapping(service,
    category)."""
    return details.join(mapping, "service").groupBy("category", "benefit").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("amount"))


def plan_limits(benefits: DataFrame) -> DataFrame:
    """GR10: per contract and plan the largest limit per visit, day and year. benefits(contract, plan, limits: map of
    kind -> amount)."""
    rows = benefits.select("contract", "plan", F.explode("limits").alias("kind", "amount"))
    return rows.groupBy("contract", "plan").agg(*[F.max(F.when(F.col("kind") == k, F.col("amount"))).alias(f"per_{k}") for k in ("visit", "day", "year")])


def federated_search(queries: DataFrame, domains: dict[str, DataFrame], k: int) -> DataFrame:
    """GR12: per query and over all domains the k best rows by graded match. queries(query_id, query), each
    domain(id, name). Names meet queries on a shared word, so no query is tried with all names."""
    q = queries.select("query_id", "query", F.explode(F.array_distinct(F.split(norm_key(F.col("query")), " "))).alias("__w"))
    out = None
    for domain, df in domains.items():
        d = df.select(F.lit(domain).alias("domain"), F.col("id").cast("string").alias("id"), "name", F.explode(F.array_distinct(F.split(norm_key(F.col("name")), " "))).alias("__w"))
        out = d if out is None else out.unionByName(d)
    hits = q.join(out, "__w").drop("__w").distinct().withColumn("score", graded_match(F.col("query"), F.col("name"))).filter("score > 0")
    return topk(hits, ["query_id"], [F.col("score").desc(), F.col("domain"), F.col("id")], k, rank="rank")


def build_graph(chunks: DataFrame, mentions: DataFrame, assertions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GR13: nodes(label, node_id, name) and edges(edge_type, src_id, dst_id) of documents, sections, chunks, mentions
    and assertions. chunks(doc_id, section, chunk_id, body_text), mentions(chunk_id, mention_id, text),
    assertions(chunk_id, assertion_id, text)."""
    doc, sec = F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), F.concat_ws("|", F.concat(F.lit("sec:"), F.col("doc_id").cast("string")), F.col("section"))
    node = lambda df, label, i, name: df.select(F.lit(label).alias("label"), i.alias("node_id"), name.alias("name")).distinct()
    edge = lambda df, kind, a, b: df.select(F.lit(kind).alias("edge_type"), a.alias("src_id"), b.alias("dst_id")).distinct()
    nodes = [node(chunks, "document", doc, F.col("doc_id").cast("string")), node(chunks, "section", sec, F.col("section")), node(chunks, "chunk", F.col("chunk_id"), F.substring("body_text", 1, 80)), node(mentions, "mention", F.col("mention_id"), F.col("text")), node(assertions, "assertion", F.col("assertion_id"), F.col("text"))]
    edges = [edge(chunks, "HAS_SECTION", doc, sec), edge(chunks, "HAS_CHUNK", sec, F.col("chunk_id")), edge(mentions, "MENTIONS", F.col("chunk_id"), F.col("mention_id")), edge(assertions, "ASSERTS", F.col("chunk_id"), F.col("assertion_id"))]
    union = lambda xs: xs[0] if len(xs) == 1 else xs[0].unionByName(union(xs[1:]))
    return union(nodes), union(edges)


def bundle_to_graph(bundles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """IO7: nested bundles (disease_id, name, signs: array<struct<name, support>>, services: array<struct<code, name,
    role, score>>) as nodes and edges."""
    sign_id = stable_id("sign:", norm_key(F.col("x.name")))
    signs, services = bundles.select("disease_id", F.explode("signs").alias("x")), bundles.select("disease_id", F.explode("services").alias("x"))
    nodes = bundles.select(F.lit("disease").alias("label"), F.col("disease_id").alias("node_id"), "name")
    nodes = nodes.unionByName(signs.select(F.lit("sign").alias("label"), sign_id.alias("node_id"), F.col("x.name").alias("name"))).unionByName(services.select(F.lit("service").alias("label"), F.col("x.code").alias("node_id"), F.col("x.name").alias("name")))
    edges = signs.select(F.lit("HAS_SIGN").alias("edge_type"), F.col("disease_id").alias("src_id"), sign_id.alias("dst_id"), F.col("x.support").cast("double").alias("score"))
    edges = edges.unionByName(services.select(F.concat(F.lit("SERVICE_"), F.upper("x.role")).alias("edge_type"), F.col("disease_id").alias("src_id"), F.col("x.code").alias("dst_id"), F.col("x.score").cast("double").alias("score")))
    return nodes.dropDuplicates(["label", "node_id"]), edges.groupBy("edge_type", "src_id", "dst_id").agg(F.max("score").alias("score"))


def merge_graphs(a: DataFrame, b: DataFrame, keys: Keys) -> DataFrame:
    """GR14: two edge (or node) tables as one by key: rows added, the best score, the sources that hold it."""
    both = a.withColumn("__s", F.lit("a")).unionByName(b.withColumn("__s", F.lit("b")), allowMissingColumns=True)
    return both.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.max("score").alias("score"), F.array_sort(F.collect_set("__s")).alias("sources"))


def seed_ontology(dim: DataFrame, prefix: str, name: str) -> DataFrame:
    """GR15: hashed ids for a dimension's names: (node_id, name, key), one per normalised name."""
    keyed = dim.select(F.col(name).alias("name"), norm_key(F.col(name)).alias("key")).groupBy("key").agg(F.min("name").alias("name"))
    return keyed.select(stable_id(prefix, F.col("key")).alias("node_id"), "name", "key")


def map_entities(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """GR16: an entity's ontology class: by its type, else by the longest dictionary name that its normalised name
    contains. entities(entity_id, type, name), rules(kind: type or name, value, class)."""
    by_type = entities.join(rules.filter("kind = 'type'").select(F.col("value").alias("type"), "class"), "type").select("entity_id", "class", F.lit("type").alias("how"), F.lit(10_000).alias("size"))
    named = rules.filter("kind = 'name'").select(norm_key(F.col("value")).alias("term"), "class")
    found = term_hits(entities.select("entity_id", norm_key(F.col("name")).alias("name")), "name", named.select("term"), keep=["entity_id"], once=True).select("row.entity_id", "term")
    by_name = found.join(named, "term").select("entity_id", "class", F.lit("name").alias("how"), F.length("term").alias("size"))
    return top1(by_type.unionByName(by_name), ["entity_id"], [F.col("size").desc(), F.col("class")]).drop("size")
