"""Ranked search over an inverted index (RT6, RT7, RT12, RT15): the k best documents of each query, exactly.

Documents are tokenised once into a written table of postings. A document's score is a sum of parts, one for each of the
query's terms it holds. Every term has an upper bound of its parts, and a lower bound of each query's k-th best score comes
from the documents that are best for single terms. The terms with the least bounds whose sum stays below that score are
optional: a document that holds no other term cannot be among the k best, so their postings, the long ones, are read only
for documents that the other terms leave open.

Parts repeat few values, so their files are small for their number of rows: a join by file size alone would send them whole
through the driver. Joins therefore name the side that is small, by a count, and hold parts to a merge join otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import BROADCAST_ROWS, cut, maybe_broadcast, spread
from .windows import topk

#: Documents per term that give the first bounds, and those of them that are scored in full for each query.
CHAMPIONS = 8
#: Scores are rounded before they are ranked, so documents a little below the bound may still tie.
SLACK = 1e-3


def terms(text: Column) -> Column:
    """The words of a text, repeats included."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def postings(docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., doc_id, t, tf, len, chars), written: a row per term of a document. docs(by..., doc_id, text); rows without
    text have no postings."""
    docs = docs.select(*by, "doc_id", "text")
    rows = spread(docs).select(*by, "doc_id", F.length("text").alias("chars"), F.sort_array(terms(F.col("text"))).alias("w"))
    rows = rows.withColumn("len", F.size("w")).filter("len > 0")
    if docs.groupBy(*by, "doc_id").count().filter("count > 1").limit(1).count():
        # Rows of one document in several pieces: their terms are counted together.
        each = rows.select(*by, "doc_id", "chars", "len", F.explode("w").alias("t"))
        return cut(each.groupBy(*by, "doc_id", "t").agg(F.count(F.lit(1)).alias("tf"), F.max("len").alias("len"), F.max("chars").alias("chars")))
    # In a sorted list equal terms are neighbours, so each row's terms are counted where it stands.
    first = F.filter(F.sequence(F.lit(0), F.col("len") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    rows = rows.withColumn("first", first).withColumn("next", F.concat(F.slice("first", 2, F.size("first")), F.array("len")))
    counted = F.zip_with("first", "next", lambda i, j: F.struct(F.get("w", i).alias("t"), (j - i).cast("long").alias("tf")))
    return cut(rows.select(*by, "doc_id", F.explode(counted).alias("x"), "len", "chars").select(*by, "doc_id", "x.t", "x.tf", "len", "chars"))


def held_terms(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, t, len, chars): a row per wanted term that a document holds, however often. docs(doc_id, text)."""
    rows = spread(docs.select("doc_id", "text")).select("doc_id", F.length("text").alias("chars"), terms(F.col("text")).alias("w")).withColumn("len", F.size("w"))
    found = of_terms(rows.select("doc_id", F.explode(F.array_distinct("w")).alias("t"), "len", "chars"), wanted)
    if docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        # Rows of one document in several pieces: it has one length, that of the longest.
        sizes = rows.groupBy("doc_id").agg(F.max("len").alias("len"), F.max("chars").alias("chars"))
        found = found.select("doc_id", "t").distinct().join(sizes, "doc_id")
    return found


def wanted_terms(queries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(query_id, by..., t, n), written: the terms of the queries and how often a query holds them."""
    each = queries.select("query_id", *by, F.explode(terms(F.col("text"))).alias("t"))
    return cut(each.groupBy("query_id", *by, "t").agg(F.count(F.lit(1)).alias("n")))


def asked_once(wanted: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Queries that ask for the same terms as one: wanted with the rows of the first of each, and (query_id, by..., first).
    Both are written."""
    lists = wanted.groupBy("query_id", *by).agg(F.array_sort(F.collect_list(F.struct("t", "n"))).alias("terms"))
    firsts = lists.groupBy(*by, "terms").agg(F.min("query_id").alias("first"))
    members = cut(lists.join(firsts, [*by, "terms"]).select("query_id", *by, "first"))
    once = wanted.join(members.filter("query_id = first").select("query_id", *by), ["query_id", *by], "left_semi")
    return cut(once), members


def for_all(found: DataFrame, members: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The rows that the first of each group of queries found, for all queries of the group."""
    columns = found.columns
    return members.join(found.withColumnRenamed("query_id", "first"), ["first", *by]).select(*columns)


def of_terms(index: DataFrame, wanted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The postings of the queries' terms."""
    return index.join(maybe_broadcast(wanted.select(*by, "t").distinct()), [*by, "t"], "left_semi")


def bm25_parts(index: DataFrame, docs: DataFrame, wanted: DataFrame, by: Sequence[str] = (), k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(by..., doc_id, t, a): each posting's share of a BM25 score. Every group of ``by`` is a collection of its own."""
    one = [*by] or [F.lit(1).alias("__one")]
    keys = [*by] or ["__one"]
    sizes = docs.groupBy(*one).agg(F.count(F.lit(1)).alias("docs"), F.count("text").alias("texts"))
    sizes = sizes.join(index.groupBy(*one).agg(F.sum("tf").alias("words")), keys).select(*keys, "docs", (F.col("words") / F.col("texts")).alias("avg_len"))
    some = of_terms(index, wanted, by).select("*", *([] if by else one))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    weights = some.groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("df")).join(maybe_broadcast(sizes), keys).select(*keys, "t", idf, "avg_len")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return some.join(maybe_broadcast(weights), [*keys, "t"]).select(*by, "doc_id", "t", part.alias("a"))


def best(parts: DataFrame, wanted: DataFrame, k: int, by: Sequence[str] = (), digits: int = 4, even: bool = False) -> DataFrame:
    """(query_id, by..., doc_id, score, rank): the k best documents of each query, ties by doc_id. parts(by..., doc_id, t,
    a, and where it is not 0: b, c): a query that holds a term n times scores a + n * b for it, and each document that
    shares a term with it c besides, which is one value for a document, as b is too if ``even``. None is negative."""
    parts, group = cut(_whole(parts)), ["query_id", *by]
    share = F.col("a") + F.col("n") * F.col("b")
    # A k-th best score that is reached: the best documents of single terms, scored in full.
    # Any documents give such a score. These are each term's best of so many shares of the documents, found without a sort.
    share_of = F.pmod(F.xxhash64("doc_id"), F.lit(2 * max(k, CHAMPIONS))).alias("__of")
    champions = parts.groupBy(*by, "t", share_of).agg(*[F.max_by(c, F.col("a") + F.col("b")).alias(c) for c in ("doc_id", "a", "b")])
    seeds = champions.join(wanted, [*by, "t"]).groupBy(*group, "doc_id").agg(F.sum(share).alias("s"))
    seeds = cut(topk(seeds, group, [F.col("s").desc(), F.col("doc_id")], k + CHAMPIONS).select(*group, "doc_id"))
    whole = full(_of_few(parts, seeds, by), seeds, wanted, by).withColumn("s", F.col("s") + F.col("c"))
    reached = topk(whole, group, [F.col("s").desc()], k, rank="rank").filter(F.col("rank") == k)
    scores = above(parts, wanted, reached.select(*group, (F.col("s") - SLACK).alias("reached")), by, even).withColumn("score", F.round("score", digits))
    return topk(scores, group, [F.col("score").desc(), F.col("doc_id")], k, rank="rank")


def _whole(parts: DataFrame) -> DataFrame:
    for name in ("b", "c"):
        if name not in parts.columns:
            parts = parts.withColumn(name, F.lit(0.0))
    return parts


def _of_few(parts: DataFrame, pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """The parts of the documents of ``pairs`` (a written table) where they are few, else all."""
    docs = pairs.select(*by, "doc_id").distinct()
    few = docs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return parts.join(F.broadcast(docs), [*by, "doc_id"], "left_semi") if few else parts


def full(parts: DataFrame, pairs: DataFrame, of: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(query_id, by..., doc_id, s, c): sums over the terms of ``of`` for pairs of query and document that share one."""
    share = F.col("a") + F.col("n") * F.col("b")
    return pairs.join(of, ["query_id", *by]).join(_whole(parts).hint("merge"), [*by, "doc_id", "t"]).groupBy("query_id", *by, "doc_id").agg(F.sum(share).alias("s"), F.max("c").alias("c"))


def above(parts: DataFrame, wanted: DataFrame, reached: DataFrame, by: Sequence[str] = (), even: bool = False) -> DataFrame:
    """(query_id, by..., doc_id, score): all documents of each query with a score of ``reached``(query_id, by..., reached)
    or more, and perhaps some below; without such a row all that share a term. parts (a written table) and even as in
    best()."""
    parts, group = _whole(parts), ["query_id", *by]
    share = F.col("a") + F.col("n") * F.col("b")
    peak = parts.groupBy(*by, "t").agg(F.max("a").alias("top_a"), F.max("b").alias("top_b"), F.max("c").alias("top_c"))
    # What a term gives a document at most: low + step * the document's b.
    most = F.col("top_a") + F.col("n") * F.col("top_b")
    low, step = (F.col("top_a"), F.col("n")) if even else (most, F.lit(0))
    bounds = cut(wanted.join(peak, [*by, "t"]).select(*group, "t", "n", most.alias("most"), low.alias("low"), step.cast("long").alias("step"), "top_c"))
    # Optional terms: the least bounds whose sum, with the greatest constant, stays below it.
    w = Window.partitionBy(*group)
    order = w.orderBy("most", "t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = bounds.join(reached, group, "left").withColumn("reached", F.coalesce("reached", F.lit(-1.0)))
    split = split.withColumn("optional", F.sum("most").over(order) < F.col("reached") - F.max("top_c").over(w))
    of_optional = [F.sum(F.when(F.col("optional"), F.col(c)).otherwise(0)).over(w).alias(f"rest_{c}") for c in ("low", "step")]
    split = cut(split.select("*", *[F.sum(c).over(w).alias(f"all_{c}") for c in ("low", "step")], *of_optional))
    bound = lambda x: F.col(f"{x}_low") + F.col(f"{x}_step") * F.col("b") + F.col("c")
    strong = split.filter(~F.col("optional")).select(*group, "t", "n", "reached", "all_low", "all_step", "rest_low", "rest_step")
    some = parts.hint("merge").join(maybe_broadcast(strong), [*by, "t"]).filter(bound("all") >= F.col("reached")).groupBy(*group, "doc_id")
    some = some.agg(F.sum(share).alias("s"), *[F.max(c).alias(c) for c in ("b", "c")], *[F.first(c).alias(c) for c in ("reached", "rest_low", "rest_step")])
    open_ = cut(some.filter(F.col("s") + bound("rest") >= F.col("reached")).select(*group, "doc_id", "s", "c"))
    weak = split.filter("optional").select(*group, "t", "n")
    more = full(_of_few(parts, open_, by), open_.select(*group, "doc_id"), weak, by).select(*group, "doc_id", F.col("s").alias("more"))
    total = F.col("s") + F.coalesce("more", F.lit(0.0)) + F.col("c")
    return open_.join(more, [*group, "doc_id"], "left").select(*group, "doc_id", total.alias("score"))
