"""Graph, matching, document, retrieval and governance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from ..operators import govern, graph, match
from ..sources.scratch import cut, deal, spread
from .common import query, table


@query("SELECT l_partkey % 50 AS query_id, s_name AS disease, count(DISTINCT p_type || p_brand) AS n_signs FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_partkey % 50 ORDER BY count(DISTINCT p_type || p_brand) DESC, s_name) <= 5")
def reverse_lookup(spark: SparkSession, d: str) -> DataFrame:
    """GR1: suppliers that share most kinds of part with a group of parts."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    rows = rows.select((F.col("l_partkey") % 50).alias("query_id"), F.concat("p_type", "p_brand").alias("kind"), F.col("s_name").alias("disease"))
    signs = rows.select("query_id", F.concat_ws("|", F.col("query_id").cast("string"), "kind").alias("sign"))
    edges = rows.select(F.concat_ws("|", F.col("query_id").cast("string"), "kind").alias("sign"), "disease")
    return graph.diseases_for_signs(signs, edges, 5).select("query_id", "disease", "n_signs")


@query("""WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region),
a AS (SELECT child, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT a.child, e.parent, depth + 1 FROM a JOIN e ON e.child = a.ancestor WHERE depth < 5) SELECT child, ancestor, min(depth) AS depth FROM a GROUP BY 1, 2""")
def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """GR4: suppliers, nations, regions, the world."""
    e = lambda t, c, p: t.select(c.alias("child"), p.alias("parent"))
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = e(table(spark, d, "nation"), s("n", "n_nationkey"), s("r", "n_regionkey")).unionByName(e(table(spark, d, "supplier"), s("s", "s_suppkey"), s("n", "s_nationkey"))).unionByName(e(table(spark, d, "region"), s("r", "r_regionkey"), F.lit("world")))
    return graph.ancestors(edges)


@query("""WITH l AS (SELECT p_partkey AS line_id, p_brand AS contract, p_name AS service FROM part), e AS (SELECT DISTINCT p_brand AS contract, p_name AS service, 'B' || p_type AS benefit FROM part WHERE p_size > 40), b AS (SELECT DISTINCT p_brand AS contract, 'T' || p_type AS benefit, split_part(p_name, ' ', 2) AS name FROM part),
dr AS (SELECT line_id, benefit, 5 AS score, 'edge' AS how FROM l JOIN e USING (contract, service)),
tx AS (SELECT line_id, benefit, CASE WHEN name = service THEN 4 WHEN starts_with(name, service) THEN 3 WHEN contains(name, service) THEN 2 WHEN list_contains(string_split(service, ' '), name) THEN 1 ELSE 0 END AS score, 'text' AS how FROM l JOIN b USING (contract) WHERE line_id NOT IN (SELECT line_id FROM dr))
SELECT * FROM (SELECT * FROM dr UNION ALL SELECT * FROM tx WHERE score > 0) QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY score DESC, benefit) = 1""")
def tiered_match(spark: SparkSession, d: str) -> DataFrame:
    """GR5: a part's benefit by edge, else by text."""
    p = table(spark, d, "part")
    lines = p.select(F.col("p_partkey").alias("line_id"), F.col("p_brand").alias("contract"), F.col("p_name").alias("service"))
    edges = p.filter("p_size > 40").select(F.col("p_brand").alias("contract"), F.col("p_name").alias("service"), F.concat(F.lit("B"), "p_type").alias("benefit")).distinct()
    benefits = p.select(F.col("p_brand").alias("contract"), F.concat(F.lit("T"), "p_type").alias("benefit"), F.element_at(F.split("p_name", " "), 2).alias("name")).distinct()
    return graph.benefits_for_line(lines, edges, benefits)


@query("""WITH a AS (SELECT p_partkey, 1 AS tier, 'D' || p_type AS x FROM part WHERE p_size < 10), b AS (SELECT p_partkey, 2, 'H' || p_brand FROM part WHERE p_size BETWEEN 5 AND 30 AND p_name IN (SELECT p_name FROM part WHERE p_size BETWEEN 5 AND 30 GROUP BY p_name HAVING count(*) >= 2)), c AS (SELECT p_partkey, 3, 'K' || split_part(p_name, ' ', 1) FROM part WHERE split_part(p_name, ' ', 1) IN ('small', 'large')),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) SELECT DISTINCT p_partkey AS line_id, x AS exclusion, tier FROM u QUALIFY tier = min(tier) OVER (PARTITION BY p_partkey)""")
def exclusion_tiers(spark: SparkSession, d: str) -> DataFrame:
    """GR7."""
    p = table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    lines = p.select(F.col("p_partkey").alias("line_id"), F.lit("c").alias("contract"), key.alias("service"))
    direct = p.filter("p_size < 10").select(F.lit("c").alias("contract"), key.alias("service"), F.concat(F.lit("D"), "p_type").alias("exclusion"))
    mid = p.filter("p_size BETWEEN 5 AND 30")
    n = mid.groupBy("p_name").agg(F.count(F.lit(1)).alias("rows"))
    history = mid.join(n, "p_name").select(key.alias("service"), F.concat(F.lit("H"), "p_brand").alias("exclusion"), "rows")
    head = F.element_at(F.split("p_name", " "), 1)
    keywords = p.filter(head.isin("small", "large")).select(key.alias("word"), F.concat(F.lit("K"), head).alias("exclusion"))
    return graph.exclusions_for_line(lines, direct, history, keywords).select("line_id", "exclusion", "tier").distinct()


@query("""WITH r AS (SELECT DISTINCT c_mktsegment AS contract, o_orderpriority AS plan FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 100000), v AS (SELECT DISTINCT o_orderpriority AS plan, o_orderstatus AS benefit FROM orders WHERE o_totalprice < 50000),
c AS (SELECT DISTINCT contract, benefit FROM r JOIN v USING (plan)) SELECT o_orderkey AS line_id, c_mktsegment AS contract, o_orderstatus AS benefit, c.contract IS NOT NULL AS covered FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN c ON c.contract = c_mktsegment AND c.benefit = o_orderstatus""")
def plan_coverage(spark: SparkSession, d: str) -> DataFrame:
    """GR6."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    lines = o.select(F.col("o_orderkey").alias("line_id"), F.col("c_mktsegment").alias("contract"), F.col("o_orderstatus").alias("benefit"))
    plans = o.filter("o_totalprice > 100000").select(F.col("c_mktsegment").alias("contract"), F.col("o_orderpriority").alias("plan"))
    covered = o.filter("o_totalprice < 50000").select(F.col("o_orderpriority").alias("plan"), F.col("o_orderstatus").alias("benefit"))
    return graph.plan_coverage(lines, plans, covered)


@query("SELECT l_partkey AS service, l_returnflag || l_linestatus AS pattern, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2")
def historical_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """GR8."""
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("service"), F.array(F.concat("l_returnflag", "l_linestatus")).alias("patterns"))
    return graph.historical_exclusions(rows)


@query("SELECT p_type AS category, l_returnflag AS benefit, count(*) AS rows, round(sum(l_quantity), 2) AS amount FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def benefit_support(spark: SparkSession, d: str) -> DataFrame:
    """GR9."""
    details = table(spark, d, "lineitem").select(F.col("l_partkey").alias("service"), F.col("l_returnflag").alias("benefit"), F.col("l_quantity").alias("amount"))
    return graph.benefit_support_edges(details, table(spark, d, "part").select(F.col("p_partkey").alias("service"), F.col("p_type").alias("category"))).withColumn("amount", F.round("amount", 2))


@query("SELECT p_brand AS contract, p_type AS plan, max(p_retailprice) AS per_visit, max(p_size)::DOUBLE AS per_day, NULL::DOUBLE AS per_year FROM part GROUP BY 1, 2")
def plan_limits(spark: SparkSession, d: str) -> DataFrame:
    """GR10."""
    rows = table(spark, d, "part").select(F.col("p_brand").alias("contract"), F.col("p_type").alias("plan"), F.create_map(F.lit("visit"), F.col("p_retailprice"), F.lit("day"), F.col("p_size").cast("double")).alias("limits"))
    return graph.plan_limits(rows)


@query("""WITH q(query_id, query) AS (VALUES (1, 'widget'), (2, 'small bolt'), (3, 'asia')), n AS (SELECT 'part' AS domain, p_partkey::VARCHAR AS id, p_name AS name FROM part UNION ALL SELECT 'region', r_regionkey::VARCHAR, r_name FROM region),
s AS (SELECT query_id, domain, id, (CASE WHEN lower(name) = query THEN 1.0 WHEN starts_with(lower(name), query) THEN 0.96 WHEN contains(lower(name), query) THEN 0.90 ELSE 0 END)::DOUBLE AS score FROM q, n)
SELECT query_id, domain, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, domain, id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 10""")
def federated_search(spark: SparkSession, d: str) -> DataFrame:
    """GR12 (the ten best of each query)."""
    q = spark.createDataFrame([(1, "widget"), (2, "small bolt"), (3, "asia")], "query_id int, query string")
    domains = {"part": table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "region": table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))}
    return graph.federated_search(q, domains, 10).select("query_id", "domain", "id", "score", "rank")


@query("""SELECT label, count(*) AS n FROM (SELECT 'document' AS label, doc_id::VARCHAR AS i FROM documents UNION SELECT 'section', doc_id || '|' || lang FROM documents UNION SELECT 'chunk', 'c' || doc_id FROM documents UNION SELECT 'mention', 'm' || source FROM documents) GROUP BY label
UNION ALL SELECT e, count(*) FROM (SELECT DISTINCT 'HAS_SECTION' AS e, doc_id AS a, lang AS b FROM documents UNION ALL SELECT DISTINCT 'HAS_CHUNK', doc_id, lang FROM documents UNION ALL SELECT DISTINCT 'MENTIONS', doc_id, source FROM documents) GROUP BY e""")
def document_graph(spark: SparkSession, d: str) -> DataFrame:
    """GR13, IO18: sizes of the graph built from documents (language as section, source as mention)."""
    docs = table(spark, d, "documents")
    chunk = F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id")
    chunks = docs.select("doc_id", F.col("lang").alias("section"), chunk, F.col("text").alias("body_text"))
    mentions = docs.select(chunk, F.concat(F.lit("m"), "source").alias("mention_id"), F.col("source").alias("text"))
    nodes, edges = graph.build_graph(chunks, mentions, mentions.filter("false").withColumnRenamed("mention_id", "assertion_id"))
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).unionByName(edges.groupBy(F.col("edge_type").alias("label")).agg(F.count(F.lit(1)).alias("n")))


@query("""WITH a AS (SELECT p_brand AS k, count(*) AS rows, max(p_size) AS score FROM part WHERE p_size <= 45 GROUP BY 1), b AS (SELECT p_brand AS k, count(*) AS rows, max(p_size) AS score FROM part WHERE p_size > 40 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.rows, 0) + coalesce(b.rows, 0) AS rows, greatest(a.score, b.score) AS score, concat_ws('+', CASE WHEN a.k IS NOT NULL THEN 'a' END, CASE WHEN b.k IS NOT NULL THEN 'b' END) AS sources FROM a FULL JOIN b ON a.k = b.k""")
def merge_graphs(spark: SparkSession, d: str) -> DataFrame:
    """GR14: two overlapping edge tables made from part."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("k"), F.lit(1).alias("rows"), F.col("p_size").alias("score"), "p_partkey", "p_size")
    out = graph.merge_graphs(p.filter("p_size <= 45").select("k", "rows", "score"), p.filter("p_size > 40").select("k", "rows", "score"), ["k"])
    return out.withColumn("sources", F.concat_ws("+", "sources"))


@query("SELECT 'node:' || sha256(p_name)[1:16] AS node_id, p_name AS name, p_name AS key FROM (SELECT DISTINCT p_name FROM part)")
def seed_ontology(spark: SparkSession, d: str) -> DataFrame:
    """GR15, TX27."""
    return graph.seed_ontology(table(spark, d, "part"), "node:", "p_name")


@query("SELECT p_partkey AS entity_id, CASE WHEN p_type = 'PROMO' THEN 'Promotion' WHEN contains(p_name, 'widget') THEN 'Widget' ELSE 'Bolt' END AS class, CASE WHEN p_type = 'PROMO' THEN 'type' ELSE 'name' END AS how FROM part WHERE p_type = 'PROMO' OR contains(p_name, 'widget') OR contains(p_name, 'bolt')")
def map_entities(spark: SparkSession, d: str) -> DataFrame:
    """GR16."""
    rules = spark.createDataFrame([("type", "PROMO", "Promotion"), ("name", "widget", "Widget"), ("name", "bolt", "Bolt")], "kind string, value string, class string")
    return graph.map_entities(table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("type"), F.col("p_name").alias("name")), rules)


@query("""WITH o AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal < 6000), n AS (SELECT c_custkey, c_name || '!' AS c_name, c_acctbal + 1 AS c_acctbal, 'NEW' AS c_mktsegment FROM customer WHERE c_acctbal >= 2000)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN n.c_name ELSE o.c_name END AS c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal, CASE WHEN o.c_custkey IS NULL THEN n.c_mktsegment ELSE o.c_mktsegment END AS c_mktsegment FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def upsert_nodes(spark: SparkSession, d: str) -> DataFrame:
    """IO8: customers by balance, in two batches that overlap."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    new = c.filter("c_acctbal >= 2000").select("c_custkey", F.concat("c_name", F.lit("!")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))
    return graph.upsert(c.filter("c_acctbal < 6000"), new, ["c_custkey"], ["c_acctbal"], ["c_name", "c_mktsegment"])


@query("SELECT l_suppkey, l_partkey, count(*) AS rows, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS denied FROM lineitem GROUP BY 1, 2")
def upsert_edges(spark: SparkSession, d: str) -> DataFrame:
    """IO9: edges of one half of the lines added to those of the other. Lines are dealt by edge, so that a task's groups
    are bounded: there are almost as many edges as lines."""
    l = deal(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")
    edges = lambda df: df.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("denied"))
    return graph.upsert_edges_additive(edges(l.filter("l_linestatus = 'O'")), edges(l.filter("NOT l_linestatus <=> 'O'")), ["l_suppkey", "l_partkey"], ["rows", "denied"])


@query("""WITH e AS (SELECT p_partkey, p_name || '*' AS p_name, p_brand, CASE WHEN p_type = 'PROMO' THEN 'delete' ELSE 'upsert' END AS op FROM part WHERE p_type = 'PROMO' OR p_brand <> 'Brand#13')
SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM e) UNION ALL SELECT p_partkey, p_name, p_brand FROM e WHERE op = 'upsert'""")
def apply_edits(spark: SparkSession, d: str) -> DataFrame:
    """IO13: an edit for every part; upserts of a brand that is not known are left out."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    edits = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit("*")).alias("p_name"), "p_brand", F.when(F.col("p_type") == "PROMO", "delete").otherwise("upsert").alias("op"))
    return graph.apply_edits(p, edits, ["p_partkey"], p.filter("p_brand <> 'Brand#13'").select("p_brand").distinct(), "p_brand")


# Matching.

@query("""WITH n AS (SELECT DISTINCT p_name FROM part), c AS (SELECT DISTINCT p_name || ' kit' AS c_name FROM part), s AS (SELECT p_name, c_name, round(1 - levenshtein(p_name, c_name) / greatest(length(p_name), length(c_name)), 4) AS score FROM n, c) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY score DESC, c_name) <= 3""")
def map_names(spark: SparkSession, d: str) -> DataFrame:
    """ER1 with edit distance as the declared score: names of parts against names with noise, those that share a token
    or a trigram; the SQL tries all pairs."""
    from ..operators.windows import topk

    p = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    pairs = match.block_pairs(p, p.select(F.concat("name", F.lit(" kit")).alias("name")))
    score = F.round(1 - F.levenshtein("l_name", "r_name") / F.greatest(F.length("l_name"), F.length("r_name")), 4)
    out = pairs.select(F.col("l_name").alias("p_name"), F.col("r_name").alias("c_name"), score.alias("score"))
    return topk(out, ["p_name"], [F.col("score").desc(), F.col("c_name")], 3)


@query()
def map_services(spark: SparkSession, d: str) -> DataFrame:
    """ER1-ER4: distinct part names with noise mapped to part names by the seven-part score, with gap and policy."""
    p = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("occurrences"), F.lit("GEN").alias("category"))
    noisy = p.select(F.concat(F.lit("[DV] "), F.initcap("name"), F.lit(" | room 3")).alias("name"))
    one = lambda *words: {w: (w,) for w in words}
    mapped = match.map_services(noisy, p, signals={"analytes": one("widget", "bolt"), "modalities": one("small", "large")}, terms=["shiny", "cold"])
    return match.resolve_names(mapped).select("l_name", "r_name", "score", "gap", "confidence", "policy.*")


@query("""WITH s AS (SELECT p_partkey, 70 + p_size % 31 AS score, p_partkey % 6 AS gap, p_size % 5 = 0 AS exact, CASE p_partkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS conf FROM part),
r AS (SELECT *, CASE WHEN exact AND score >= 95 THEN 'exact' WHEN conf = 'HIGH' AND score >= 93 AND gap >= 4 THEN 'exact' WHEN conf IN ('HIGH', 'MEDIUM') AND score >= 87 AND gap >= 2.5 THEN 'probable' WHEN score >= 80 THEN 'ambiguous' ELSE 'unknown' END AS resolution FROM s)
SELECT p_partkey, resolution, CASE WHEN resolution IN ('exact', 'probable') THEN 'mapped' WHEN resolution = 'ambiguous' THEN 'review' ELSE 'unmapped' END AS status FROM r""")
def mapping_policy(spark: SparkSession, d: str) -> DataFrame:
    """ER4."""
    conf = F.when(F.col("p_partkey") % 3 == 0, "HIGH").when(F.col("p_partkey") % 3 == 1, "MEDIUM").otherwise("LOW")
    policy = match.mapping_policy(70 + F.col("p_size") % 31, F.col("p_partkey") % 6, conf, F.col("p_size") % 5 == 0)
    return table(spark, d, "part").select("p_partkey", policy.alias("p")).select("p_partkey", "p.*")


@query("""WITH t AS (SELECT p_partkey AS id, p_name AS f, list_distinct(string_split(p_name, ' ')) AS w FROM part), a(family, f) AS (VALUES ('widgets', 'cold widget'), ('widgets', 'small widget'), ('bolts', 'large bolt'), ('bolts', 'bolt')),
p AS (SELECT id, family, t.f AS tf, a.f AS af, t.w, string_split(a.f, ' ') AS v FROM t, a), q AS (SELECT *, len(list_intersect(w, v)) AS n FROM p),
s AS (SELECT id, family, round(least(1, greatest(0.95::DOUBLE * (0.5::DOUBLE * n / len(v) + 0.5::DOUBLE * n / len(w)), CASE WHEN tf = af THEN 1 ELSE 0 END)), 4) AS j FROM q WHERE n > 0),
g AS (SELECT id, family, list(j ORDER BY j DESC)[1:3] AS top, count(*) FILTER (j >= 0.65) AS hits FROM s GROUP BY 1, 2),
r AS (SELECT id, family, round(least(1, 0.7::DOUBLE * top[1] + 0.25::DOUBLE * (list_sum(top) / len(top)) + 0.05::DOUBLE * least(hits, 3) / 3.0::DOUBLE), 4) AS score, top[1] AS t1 FROM g),
k AS (SELECT *, row_number() OVER o AS rank, round(score - lead(score) OVER o, 4) AS gap FROM r WINDOW o AS (PARTITION BY id ORDER BY score DESC, t1 DESC, family))
SELECT id, family, score, CASE WHEN score >= 0.98 THEN 'exact' WHEN score >= 0.82 AND (gap IS NULL OR gap >= 0.08) THEN 'probable' WHEN score >= 0.68 THEN 'ambiguous' ELSE 'unknown' END AS status FROM k WHERE rank = 1""")
def family_of(spark: SparkSession, d: str) -> DataFrame:
    """ER6 by tokens alone: without the partial ratio, which SQL lacks (tests cover it), and the lexical score (see
    family_lexical)."""
    texts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    aliases = spark.createDataFrame([("widgets", "cold widget"), ("widgets", "small widget"), ("bolts", "large bolt"), ("bolts", "bolt")], "family string, alias string")
    return match.family_of(texts, aliases, partial=False, lexical=False).select("id", "family", "score", "status")


@query()
def cluster_names(spark: SparkSession, d: str) -> DataFrame:
    """ER7: part names with their brand, most frequent first, clustered at a token Jaccard of one half or more."""
    p = table(spark, d, "part").select(F.concat_ws(" ", "p_name", F.lower("p_brand")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    # The rank is the sort key itself, so that no task has to number all names.
    names = p.withColumn("rank", F.struct((-F.col("n")).alias("less"), "name"))
    words = names.select("name", T.tokens(F.col("name")).alias("w"))
    each = words.select("name", "w", F.explode("w").alias("t"))
    # Two names with a Jaccard of one half or more share one of their rarest words, half of all and one more.
    df = each.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    rare = each.join(df, "t").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("x"), F.any_value("w").alias("w"))
    rare = rare.select("name", "w", F.explode(F.slice("x", F.lit(1), F.floor(F.size("w") / 2).cast("int") + 1)).alias("x")).select("name", "w", "x.t")
    pairs = rare.join(rare.select(F.col("name").alias("b"), F.col("w").alias("wb"), "t"), "t").filter("name < b").drop("t").distinct()
    edges = pairs.filter(T.jaccard(F.col("w"), F.col("wb")) >= 0.5).select(F.col("name").alias("a"), "b")
    return match.cluster_names(names, edges).select("name", (-F.col("rank.less")).alias("n"), "canonical")


@query("""WITH v AS (SELECT p_partkey, p_name AS a, CASE WHEN p_size % 4 = 0 THEN upper(p_name) WHEN p_size % 4 = 1 THEN replace(p_name, 'widget', 'bolt') WHEN p_size % 4 = 2 THEN p_name || ' 2' ELSE p_name || ' x' END AS b, p_size % 4 AS k FROM part)
SELECT p_partkey, CASE WHEN k = 0 OR (k = 1 AND a = b) THEN 'same_skeleton' WHEN k = 1 THEN 'other_term' WHEN k = 2 THEN 'other_number' ELSE 'similar' END AS reason FROM v""")
def review_variants(spark: SparkSession, d: str) -> DataFrame:
    """ER8, TX4, TX10."""
    k = F.col("p_size") % 4
    b = F.when(k == 0, F.upper("p_name")).when(k == 1, F.replace(F.col("p_name"), F.lit("widget"), F.lit("bolt"))).when(k == 2, F.concat("p_name", F.lit(" 2"))).otherwise(F.concat("p_name", F.lit(" x")))
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), b.alias("canonical"))
    return match.review_variants(rows, ["widget", "bolt"]).select("p_partkey", "review.reason")


@query("""WITH m AS (SELECT p_partkey AS mention_id, p_name || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' extra' END AS text FROM part), c AS (SELECT min(p_partkey) AS concept_id, p_name AS name FROM part GROUP BY p_name),
s AS (SELECT mention_id, concept_id, CASE WHEN text = name THEN 2.0 ELSE round(len(list_intersect(string_split(text, ' '), string_split(name, ' '))) / len(list_distinct(string_split(text, ' '))), 4) END AS v FROM m, c),
b AS (SELECT * FROM s WHERE v >= 0.5 QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY v DESC, concept_id) = 1)
SELECT mention_id, concept_id, least(v, 1.0)::DOUBLE AS coverage, CASE WHEN v = 2 THEN 'exact' WHEN v >= 0.7 THEN 'probable' WHEN v >= 0.5 THEN 'ambiguous' ELSE 'unknown' END AS status FROM m LEFT JOIN b USING (mention_id)""")
def canonicalise(spark: SparkSession, d: str) -> DataFrame:
    """ER9."""
    p = table(spark, d, "part")
    mentions = p.select(F.col("p_partkey").alias("mention_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" extra"))).alias("text"))
    return match.canonicalise(mentions, p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("concept_id")))


# The terms in the order in which annotate takes them: each one's places are those that no earlier one overlaps.
TERMS = ("and the", "of the", "de la", "the", "und", "el", "la")
_PLACES = "p AS (SELECT id, term, r, (sum(length(part)) OVER (PARTITION BY id, r ORDER BY i) + (i - 1) * length(term))::INT AS s, i = n AS last FROM (SELECT id, term, r, unnest(x) AS part, generate_subscripts(x, 1) AS i, len(x) AS n FROM (SELECT id, term, r, string_split(f, term) AS x FROM f, v)))"
_TAKEN = ", ".join(f"t{i} AS ({f'SELECT * FROM t{i - 1} UNION ALL ' if i else ''}SELECT id, s, s + length(term) AS e, term FROM p WHERE NOT last AND r = {i}" + (f" AND NOT EXISTS (SELECT 1 FROM t{i - 1} t WHERE t.id = p.id AND t.s < p.s + length(p.term) AND t.e > p.s)" if i else "") + ")" for i in range(len(TERMS)))


@query(f"""WITH v(r, term) AS (VALUES {', '.join(f"({i}, '{t}')" for i, t in enumerate(TERMS))}), f AS (SELECT doc_id AS id, replace(strip_accents(lower(text)), 'đ', 'd') AS f FROM documents),
{_PLACES}, {_TAKEN} SELECT id, s::INT AS start, e::INT AS "end", term FROM t{len(TERMS) - 1}""")
def annotate(spark: SparkSession, d: str) -> DataFrame:
    """ER17: short words and phrases where they stand in documents, also inside words."""
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    return match.annotate(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), terms)


# Documents and retrieval.

@query("""SELECT doc_id, i::INT AS chunk, (i * 900)::INT AS start, md5(substr(text, i * 900 + 1, 1000)) AS digest FROM (SELECT doc_id, text, unnest(generate_series(0, (greatest(length(text) - 101, 0) // 900))) AS i FROM documents WHERE length(text) > 0)""")
def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    """RT2."""
    return D.chunk_overlap(table(spark, d, "documents"), 1000, 100).select("doc_id", "chunk", "start", F.md5(F.col("body_text").cast("binary")).alias("digest"))


_LINES = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_LEVEL = " ".join(f"WHEN regexp_matches(t, '{p}') THEN {D.LEVELS.index(n) + 1}" for n, p in D.LEVEL_RULES)


@query(f"""WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s0, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
l AS (SELECT doc_id, line, CASE line % 11 WHEN 0 THEN 'I. A' || s0 WHEN 3 THEN '1.1. ' || s0 WHEN 5 THEN 'a) ' || s0 WHEN 7 THEN '--- Page ' || line || ' ---' ELSE s0 END AS s FROM r),
t AS (SELECT *, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS t FROM l), m AS (SELECT *, nullif(regexp_extract(t, '{D.PAGE}', 1), '')::INT AS marker FROM t),
g AS (SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER w, 1) AS page FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line {_LINES})),
h AS (SELECT *, CASE {_LEVEL} END AS h FROM g WHERE marker IS NULL), n AS (SELECT *, count(h) OVER w AS section FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line {_LINES})),
d AS (SELECT *, CASE WHEN h IS NOT NULL THEN least(section, section + min(h - section) OVER w) END AS depth FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY line {_LINES})),
p AS (SELECT *, {", ".join(f"last_value(CASE WHEN depth = {i + 1} THEN t END IGNORE NULLS) OVER w AS t{i}" for i in range(3))} FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY line {_LINES})),
b AS (SELECT doc_id, section, coalesce(max(CASE WHEN h IS NOT NULL THEN t END), 'Untitled') AS title, coalesce(max(h), 1) AS h, coalesce(max(CASE WHEN h IS NOT NULL THEN array_to_string([t0, t1, t2][1:depth], ' > ') END), '') AS section_path, arg_min(page, line) AS page_number, regexp_replace(string_agg(s, chr(10) ORDER BY line), '^\\s+|\\s+$', '', 'g') AS body FROM p GROUP BY doc_id, section)
SELECT doc_id, section, title, ['section', 'subsection', 'paragraph'][h] AS level, section_path, page_number, md5(body) AS digest FROM b WHERE body <> ''""")
def section_tree(spark: SparkSession, d: str) -> DataFrame:
    """RT1: sections of documents whose lines are made headings of three levels and marks of pages."""
    made = lambda s, i: F.when(i % 11 == 0, F.concat(F.lit("I. A"), s)).when(i % 11 == 3, F.concat(F.lit("1.1. "), s)).when(i % 11 == 5, F.concat(F.lit("a) "), s)).when(i % 11 == 7, F.concat(F.lit("--- Page "), i.cast("string"), F.lit(" ---"))).otherwise(s)
    docs = table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), made), "\n").alias("text"))
    return D.section_tree(docs).select("doc_id", "section", "title", "level", "section_path", "page_number", F.md5(F.col("body").cast("binary")).alias("digest"))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """RT1."""
    return D.chunk_documents(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "section", "chunk", F.length("body_text").alias("chars"))


@query()
def chunk_lateral(spark: SparkSession, d: str) -> DataFrame:
    """UD3: the rows of chunk_documents by a table function in SQL."""
    D.register_chunk_text(spark)
    spread(table(spark, d, "documents").select("doc_id", "text")).createOrReplaceTempView("texts_to_chunk")
    return spark.sql("SELECT doc_id, section, chunk, length(body_text) AS chars FROM texts_to_chunk, LATERAL chunk_text(text)")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, len(string_split(text, chr(10))) AS n FROM documents),
h AS (SELECT * FROM l WHERE regexp_matches(s, '^(The|La|Der) ')) SELECT doc_id, row_number() OVER w - 1 AS part, line::INT AS start, coalesce(lead(line) OVER w, n)::INT AS "end" FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line)""")
def split_by_toc(spark: SparkSession, d: str) -> DataFrame:
    """RT3: documents cut at lines that begin with an article."""
    return D.split_by_toc(table(spark, d, "documents"), r"^(The|La|Der) ").select("doc_id", "part", "start", "end")


@query("""WITH l AS (SELECT doc_id AS rulebook, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
m AS (SELECT *, regexp_matches(s, '^(The|La|Der) ') AS is_chapter, regexp_matches(s, '^(A|And|Le|Und|De) ') AS is_clause, trim(s) AS t FROM l),
c AS (SELECT *, last_value(CASE WHEN is_chapter THEN t END IGNORE NULLS) OVER w AS chapter, last_value(CASE WHEN is_clause THEN t END IGNORE NULLS) OVER w AS clause FROM m WINDOW w AS (PARTITION BY rulebook ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT rulebook, chapter, clause, length(string_agg(t, ' ' ORDER BY line))::INT AS chars FROM c WHERE NOT is_chapter AND NOT is_clause AND t <> '' AND clause IS NOT NULL GROUP BY 1, 2, 3""")
def parse_rulebook(spark: SparkSession, d: str) -> DataFrame:
    """RT4: documents as rulebooks, lines of one kind of beginning as chapters, of another as clauses."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("rulebook"), F.posexplode(F.split("text", "\n", -1)).alias("line", "s"))
    return D.parse_rulebook(lines, r"^(The|La|Der) ", r"^(A|And|Le|Und|De) ").select("rulebook", "chapter", "clause", F.length("body").alias("chars"))


@query("""SELECT doc_id, length(text) AS chars, len(string_split(text, chr(10))) AS n_lines, coalesce(round(len(regexp_extract_all(text, '[0-9]')) / nullif(length(text), 0), 4), 0) AS digit_share, coalesce(round(len(regexp_extract_all(text, '[A-Z]')) / nullif(length(text), 0), 4), 0) AS upper_share FROM documents""")
def doc_profile(spark: SparkSession, d: str) -> DataFrame:
    """RT5."""
    return D.doc_profile(table(spark, d, "documents")).select("doc_id", "chars", "n_lines", "digit_share", "upper_share")


_TERMS = r"""WITH qr AS (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS t FROM benchmark), qt AS (SELECT query_id, t, count(*) AS m FROM qr GROUP BY 1, 2),
w AS (SELECT doc_id, length(text) AS chars, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
dt AS (SELECT doc_id, t, count(*) AS tf, any_value(n) AS len, any_value(chars) AS chars FROM (SELECT doc_id, len(w) AS n, chars, unnest(w) AS t FROM w) GROUP BY doc_id, t) """


@query(_TERMS + """, st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w), i AS (SELECT t, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM dt, st GROUP BY t, n),
s AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a))), 4) AS score FROM dt JOIN qt USING (t) JOIN i USING (t), st GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 2) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 1""")
def bm25(spark: SparkSession, d: str) -> DataFrame:
    """RT7: the best document of every benchmark passage."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return D.bm25(q, table(spark, d, "documents").select("doc_id", "text"), 1).select("query_id", "doc_id", F.round("score", 2).alias("score"))


@query(_TERMS + """, s AS (SELECT query_id, doc_id, round(count(*) * 10.0::DOUBLE + log10(greatest(any_value(chars), 10)) + 1000.0::DOUBLE * sum(m) / any_value(len), 3) AS score FROM dt JOIN qt USING (t) GROUP BY 1, 2)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 3""")
def surface_search(spark: SparkSession, d: str) -> DataFrame:
    """RT15."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return D.surface_search(q, table(spark, d, "documents").select("doc_id", "text"), 3)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q, v), 4) AS score FROM q, v) SELECT query_id, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""")
def vector_search(spark: SparkSession, d: str) -> DataFrame:
    """RT8: every twentieth vector as a query, against all."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return D.vector_search(q, e.select("vec_id", F.col("embedding").alias("v")), 5).select("query_id", "vec_id", "score")


@query()
def vector_index(spark: SparkSession, d: str) -> DataFrame:
    """RT8: the same queries through an inverted-file index of all vectors, with each query's recall against the exact search."""
    from ..operators import vector_index as V

    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    made = V.build(e)
    try:
        found = cut(V.search(made, q, 5))
    finally:
        V.drop(spark, made)
    return found.join(V.recall(found, D.vector_search(q, e, 5), 5), "query_id")


@query(_SCORE := """WITH s AS (SELECT l_suppkey AS q, l_partkey AS id, round(sum(l_quantity), 2) AS a, count(*) AS b FROM lineitem GROUP BY 1, 2), r AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY a DESC, id) AS ra, row_number() OVER (PARTITION BY q ORDER BY b DESC, id) AS rb FROM s)
SELECT q, id, round(sum(x), 6) AS rrf_score, count(*) AS n_lists FROM (SELECT q, id, 1.0::DOUBLE / (60 + ra) AS x FROM r WHERE ra <= 10 UNION ALL SELECT q, id, 1.0::DOUBLE / (60 + rb) FROM r WHERE rb <= 10) GROUP BY 1, 2""")
def rrf(spark: SparkSession, d: str) -> DataFrame:
    """RT9."""
    from ..operators.windows import topk

    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("id")).agg(F.round(F.sum("l_quantity"), 2).alias("a"), F.count(F.lit(1)).alias("b"))
    lists = [topk(s, ["q"], [F.col(c).desc(), F.col("id")], 10, rank="rank") for c in ("a", "b")]
    return D.rrf(*lists, key=["q", "id"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((1.0::DOUBLE / (60 + l_linenumber)) + CASE WHEN l_returnflag = 'R' THEN 0.04 ELSE 0 END::DOUBLE + CASE WHEN l_linestatus = 'O' THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN l_quantity > 25 THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN l_discount > 0.05 THEN 0.06 ELSE 0 END::DOUBLE + 0.05::DOUBLE * l_tax, 6) AS composite FROM lineitem""")
def protocol_support(spark: SparkSession, d: str) -> DataFrame:
    """RT10."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (1.0 / (60 + F.col("l_linenumber"))).alias("rrf_score"), (F.col("l_returnflag") == "R").alias("in_section"), (F.col("l_linestatus") == "O").alias("icd_match"), (F.col("l_quantity") > 25).alias("disease_match"), (F.col("l_discount") > 0.05).alias("exact_mention"), F.col("l_tax").alias("overlap"))
    return D.protocol_support(rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "composite")


@query("""WITH h AS (SELECT l_suppkey AS query_id, CASE l_returnflag WHEN 'R' THEN 'summary' WHEN 'A' THEN 'assertion' ELSE 'chunk' END AS layer, l_partkey AS disease_id, round(sum(l_quantity), 2) AS score FROM lineitem GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, layer ORDER BY score DESC, disease_id) AS rank, round(score / max(score) OVER (PARTITION BY query_id, layer), 4) AS rel FROM h)
SELECT query_id, disease_id, round(sum((CASE layer WHEN 'summary' THEN 1.0 WHEN 'assertion' THEN 0.78 ELSE 0.46 END)::DOUBLE * (0.7::DOUBLE * rel + 0.3::DOUBLE / rank)) + CASE WHEN disease_id % 9 = 0 THEN 0.18 ELSE 0 END::DOUBLE + 1e-9, 4) AS score, count(*) AS hits FROM r GROUP BY 1, 2""")
def candidates(spark: SparkSession, d: str) -> DataFrame:
    """RT11."""
    layer = F.when(F.col("l_returnflag") == "R", "summary").when(F.col("l_returnflag") == "A", "assertion").otherwise("chunk")
    hits = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), layer.alias("layer"), F.col("l_partkey").alias("disease_id")).agg(F.round(F.sum("l_quantity"), 2).alias("score"))
    return D.aggregate_candidates(hits, hits.filter("disease_id % 9 = 0").select("query_id", "disease_id"))


@query("""SELECT user_id AS query_id, k % 3 AS intent, count(*) AS hits, count(*) >= 5 AND count(DISTINCT event_type) FILTER (event_type IN ('click', 'view', 'error')) = 3 AS sufficient FROM (SELECT *, user_id % 3 AS k FROM events) GROUP BY 1, 2""")
def sufficiency(spark: SparkSession, d: str) -> DataFrame:
    """RT14: events as hits, their types as layers."""
    results = table(spark, d, "events").select(F.col("user_id").alias("query_id"), (F.col("user_id") % 3).alias("intent"), F.col("event_type").alias("layer"))
    needs = spark.createDataFrame([(i, 5, ["click", "view", "error"]) for i in range(3)], "intent long, min_hits int, layers array<string>")
    return D.sufficiency(results, needs).select("query_id", "intent", "hits", "sufficient")


# Governance and memory.

@query("""WITH o AS (SELECT doc_id AS path, md5(text) AS h, 1 + doc_id % 3 AS v FROM documents WHERE n_chars < 3000), n AS (SELECT doc_id AS path, md5(CASE WHEN lang = 'fr' THEN text || '!' ELSE text END) AS h FROM documents WHERE n_chars >= 300)
SELECT coalesce(o.path, n.path) AS path, coalesce(n.h, o.h) AS sha1, (CASE WHEN o.h IS NULL THEN 1 WHEN n.h IS NULL OR n.h = o.h THEN v ELSE v + 1 END)::INT AS version, CASE WHEN n.h IS NULL THEN 'inactive' ELSE 'active' END AS status FROM o FULL JOIN n ON o.path = n.path""")
def asset_versions(spark: SparkSession, d: str) -> DataFrame:
    """KG1: the two states of documents of asset_diff."""
    from .aggregation import document_states

    old, new = (s.withColumnRenamed("doc_id", "path") for s in document_states(spark, d))
    return govern.version_assets(old, new)


@query("""SELECT s_nationkey, count(DISTINCT l_partkey) AS n_l_partkey, count(DISTINCT l_orderkey) AS n_l_orderkey, CASE WHEN count(DISTINCT l_partkey) + count(DISTINCT l_orderkey) >= 20 THEN 'high' WHEN count(DISTINCT l_partkey) + count(DISTINCT l_orderkey) >= 5 THEN 'medium' ELSE 'low' END AS severity,
  count(DISTINCT l_partkey) + count(DISTINCT l_orderkey) >= 5 AS needs_review FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def impact(spark: SparkSession, d: str) -> DataFrame:
    """KG3."""
    paths = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return govern.impact(paths, ["s_nationkey"], ["l_partkey", "l_orderkey"])


@query("""SELECT page_id, CASE WHEN regexp_matches(lower(url), '/en/') THEN 'english' WHEN regexp_matches(lower(url), '/(fr|es)/') THEN 'romance' ELSE 'other' END AS kind FROM pages""")
def classify_assets(spark: SparkSession, d: str) -> DataFrame:
    """KG4, TX9: pages by the language in their address."""
    pages = table(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    return govern.classify_assets(pages, [("english", "/en/"), ("romance", "/(fr|es)/")]).select("page_id", "kind")


@query("""WITH s(surface, min_files) AS (VALUES ('src0', 5), ('src1', 1000000), ('none', 1)), n AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT surface, min_files, coalesce(n, 0) AS n_files, CASE WHEN n IS NULL THEN 'missing' WHEN n < min_files THEN 'too_few' END AS warning FROM s LEFT JOIN n ON source = surface""")
def surface_inventory(spark: SparkSession, d: str) -> DataFrame:
    """KG7."""
    spec = spark.createDataFrame([("src0", 5), ("src1", 1000000), ("none", 1)], "surface string, min_files int")
    return govern.surface_inventory(table(spark, d, "documents").select(F.col("source").alias("surface")), spec)


@query()
def recall_memory(spark: SparkSession, d: str) -> DataFrame:
    """MM1: first user turns as queries against assistant turns as memories, by all words of both. A token's hash says
    which of the lists disease, sign and service it is in; query has all."""
    c = table(spark, d, "conversations")
    words = T.tokens(F.col("text"), min_len=3)
    of_class = lambda i: F.filter(words, lambda t: F.pmod(F.xxhash64(t), F.lit(3)) == i)
    lists = {"disease": of_class(0), "sign": of_class(1), "service": of_class(2), "query": words}
    q = c.filter("turn = 0").select(F.col("conv_id").alias("query_id"), *[v.alias(k) for k, v in lists.items()])
    m = c.filter("role = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("memory_id"), *[v.alias(k) for k, v in lists.items()], F.when(F.col("turn") % 3 == 0, "semantic").otherwise("episodic").alias("kind"),
        F.when(F.col("conv_id") % 2 == 0, "shared").otherwise("reasoning").alias("scope"), ((F.col("conv_id") % 10) / 10.0).alias("importance"), (F.col("conv_id") % 120).alias("age_days"), F.col("turn").alias("access_count"),
    )
    return govern.recall(q, m, 5, scopes=["reasoning"])


@query("""WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) AS r FROM conversations), k AS (SELECT * FROM c WHERE r <= 50)
SELECT role, layer, count(*) AS n_tried, round(avg(v), 4) AS effectiveness FROM (SELECT role, 'l' || turn % 3 AS layer, 1.0 AS v FROM k UNION ALL SELECT role, 'l' || (turn + 1) % 3, 0.0 FROM k) GROUP BY 1, 2""")
def layer_effectiveness(spark: SparkSession, d: str) -> DataFrame:
    """MM4 (the last 50 lessons of each role)."""
    layer = lambda k: F.array(F.concat(F.lit("l"), ((F.col("turn") + k) % 3).cast("string")))
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", layer(0).alias("effective"), layer(1).alias("empty"))
    return govern.layer_effectiveness(c, ["role"], [F.col("conv_id").desc(), F.col("turn").desc()])


@query("SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def memory_stats(spark: SparkSession, d: str) -> DataFrame:
    """MM6."""
    return govern.memory_stats(table(spark, d, "documents"), ["lang", "source"])


@query("""WITH c AS (SELECT user_id AS case_id, bool_or(event_type = 'click') AS t1, bool_or(event_type IN ('click', 'view')) AS t3, count(*) FILTER (event_type = 'error') AS u, count(*) AS n FROM events GROUP BY 1)
SELECT case_id, 'successful_pattern' AS category, 'low' AS severity FROM c WHERE t1 UNION ALL SELECT case_id, 'ranking_gap', 'medium' FROM c WHERE NOT t1 AND t3 UNION ALL SELECT case_id, 'missed_disease', 'high' FROM c WHERE NOT t3 UNION ALL SELECT case_id, 'mapping_gap', 'medium' FROM c WHERE u * 2 > n""")
def mine_experiences(spark: SparkSession, d: str) -> DataFrame:
    """MM3."""
    t = F.col("event_type")
    c = table(spark, d, "events").groupBy(F.col("user_id").alias("case_id")).agg(F.bool_or(t == "click").alias("top1_hit"), F.bool_or(t.isin("click", "view")).alias("top3_hit"), F.count_if(t == "error").alias("n_unmapped"), F.count(F.lit(1)).alias("n_lines"))
    return govern.mine_experiences(c)


@query("""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'procedural' ELSE 'episodic' END AS kind, doc_id // 2 AS source_id FROM documents)
SELECT m.source_id, k.kind, count(*) AS n FROM m, (VALUES ('procedural'), ('semantic')) k(kind) WHERE m.kind = 'episodic' AND NOT EXISTS (SELECT 1 FROM m x WHERE x.source_id = m.source_id AND x.kind = k.kind) GROUP BY 1, 2""")
def promote(spark: SparkSession, d: str) -> DataFrame:
    """MM2."""
    m = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("memory_id"), F.floor(F.col("doc_id") / 2).alias("source_id"), F.when(F.col("doc_id") % 4 == 0, "procedural").otherwise("episodic").alias("kind"), F.lit(0.5).alias("importance"))
    return govern.promote(m).groupBy("source_id", "kind").agg(F.count(F.lit(1)).alias("n"))
