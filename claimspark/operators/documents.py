"""Chunking and retrieval (RT)."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip, tokens
from . import ranked_index
from .windows import norm_by_max, topk

HEADING = r"^\s*(#{1,6}\s|[0-9]+(\.[0-9]+)*[.)]?\s+\S|[IVX]+\.\s|(CHƯƠNG|PHẦN|CHAPTER|PART)\b)"

#: Depths of headings.
LEVELS = ("section", "subsection", "paragraph")

# Beginnings of lines that are headings, the first that fits giving the level.
LEVEL_RULES = (
    ("section", r"^[IVX]+\.\s*[A-ZĐÀÁẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬÈÉẺẼẸÊẾỀỂỄỆÌÍỈĨỊÒÓỎÕỌÔỐỒỔỖỘƠỚỜỞỠỢÙÚỦŨỤƯỨỪỬỮỰỲÝỶỸỴa-z]"),
    ("section", r"^[0-9]+\.\s+[A-ZĐÀÁa-zàáảãạ]"),
    ("subsection", r"^[0-9]+\.[0-9]+\.?\s+"),
    ("paragraph", r"^[a-z]\)\s+"),
    ("paragraph", r"^[-•+]\s+"),
    ("section", r"^((?i)Bảng\s+[0-9]|Phụ lục|Lưu đồ\s+[0-9])"),
)
PAGE = r"^---\s*Page\s+([0-9]+)\s*---$"


def section_tree(docs: DataFrame, skip_first_page: bool = False) -> DataFrame:
    """RT1: (doc_id, section, title, level, section_path, parent_context, page_number, body): the text cut at its
    headings. A body begins with its heading; section 0, "Untitled", is what stands before the first. A heading's path are
    the last headings of each depth above it; depth grows by one at most. Lines that mark pages ("--- Page 3 ---") are left
    out; with skip_first_page all before the first page beyond 1 is. Blank bodies, null and empty texts give no rows.

    All is running maxima, minima and last values over a document's lines."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "s")).withColumn("t", strip(F.col("s")))
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    page = F.regexp_extract("t", PAGE, 1).try_cast("int")
    lines = lines.withColumn("marker", page).withColumn("page", F.coalesce(F.last("marker", ignorenulls=True).over(w), F.lit(1)))
    kept = F.col("marker").isNull()
    if skip_first_page:
        kept = kept & (F.coalesce(F.max("marker").over(w), F.lit(1)) > 1)
    level = F.lit(None).cast("int")
    for name, pattern in reversed(LEVEL_RULES):
        level = F.when(F.col("t").rlike(pattern), F.lit(LEVELS.index(name) + 1)).otherwise(level)
    marked = lines.withColumn("kept", kept).filter("kept").withColumn("h", level).withColumn("section", F.count("h").over(w))
    # Depth is the least of level + headings since, over the headings so far, and at most the number of headings.
    marked = marked.withColumn("depth", F.when(F.col("h").isNotNull(), F.least("section", F.col("section") + F.min(F.col("h") - F.col("section")).over(w))))
    at = [F.last(F.when(F.col("depth") == i + 1, F.col("t")), ignorenulls=True).over(w).alias(f"t{i}") for i in range(len(LEVELS))]
    heads = marked.select("doc_id", "line", "s", "t", "h", "section", "depth", "page", *at)
    body = strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "s"))), lambda x: x["s"]), "\n"))
    head = F.max(F.when(F.col("h").isNotNull(), F.struct("t", "h", F.slice(F.array("t0", "t1", "t2"), F.lit(1), F.col("depth").cast("int")).alias("path"))))
    rows = heads.groupBy("doc_id", "section").agg(body.alias("body"), head.alias("x"), F.min_by("page", "line").alias("page_number")).filter("body <> ''")
    path = F.coalesce("x.path", F.array().cast("array<string>"))
    level = F.get(F.array(*[F.lit(x) for x in LEVELS]), F.coalesce(F.col("x.h") - 1, F.lit(0)))
    parents = F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))
    return rows.select("doc_id", "section", F.coalesce("x.t", F.lit("Untitled")).alias("title"), level.alias("level"), F.array_join(path, " > ").alias("section_path"), F.array_join(parents, " > ").alias("parent_context"), "page_number", "body")


def pieces(body: str, most: int) -> list[str]:
    """A body in pieces of at most so many characters, each cut at its last sentence end, else at its last space, if that
    is in the last two thirds."""
    out = []
    while len(body) > most:
        window = body[:most]
        places = max(window.rfind(end) for end in (". ", ".\n", "? ", "! ")) + 1, window.rfind(" ")
        at = next((p for p in places if p > most // 3 + (p == places[0])), most)
        out.append(body[:at].strip())
        body = body[at:].strip()
    return [*out, body] if body or not out else out


def chunk_documents(docs: DataFrame, most: int = 3000, least: int = 100, skip_first_page: bool = False) -> DataFrame:
    """RT1: chunks by headings: doc_id, chunk (from 0), section, title, level, section_path, parent_context, page_number,
    body_text. Longer bodies are cut ("(cont.)" after the title); pieces below the least size are added to the chunk before
    them, whatever its section."""
    split = F.pandas_udf(lambda s: s.map(lambda b: pieces(b, most), na_action="ignore"), "array<string>")
    rows = section_tree(docs, skip_first_page)
    parts = F.coalesce(split(F.when(F.length("body") > most, F.col("body"))), F.array("body"))
    each = rows.withColumn("parts", parts).select("*", F.posexplode("parts").alias("piece", "content")).drop("parts", "body")
    w = Window.partitionBy("doc_id").orderBy("section", "piece")
    starts = (F.length("content") >= least) | (F.row_number().over(w) == 1)
    each = each.withColumn("starts", starts).withColumn("chunk", (F.sum(F.col("starts").cast("int")).over(w) - 1).cast("int"))
    title = F.when(F.col("piece") > 0, F.concat("title", F.lit(" (cont.)"))).otherwise(F.col("title"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "piece", "content"))), lambda x: x["content"]), "\n")
    first = F.min(F.struct("section", "piece", title.alias("title"), "level", "section_path", "parent_context", "page_number"))
    out = each.groupBy("doc_id", "chunk").agg(first.alias("x"), body.alias("body_text"))
    return out.select("doc_id", "chunk", *[F.col(f"x.{c}") for c in ("section", "title", "level", "section_path", "parent_context", "page_number")], "body_text")


def chunk_text(text: str, most: int = 3000, least: int = 100) -> Iterator[tuple]:
    """RT1, UD3: the chunks of one text as rows: chunk, section, title, level, section_path, page_number, body_text."""
    path, page, number, lines, found = [], 1, 0, [], []
    head = {"section": 0, "title": "Untitled", "level": LEVELS[0], "section_path": "", "page_number": None}
    rules = [(LEVELS.index(name), re.compile(pattern.replace("((?i)", "(?i:"))) for name, pattern in LEVEL_RULES]
    for line in [*(text or "").split("\n"), None]:
        t = (line or "").strip()
        if line is not None and (mark := re.match(PAGE, t)):
            page = int(mark[1])
            continue
        depth = next((d for d, rule in rules if rule.match(t)), None)
        if line is None or depth is not None:
            body = "\n".join(lines).strip()
            found += [(head | {"title": head["title"] + " (cont.)" * (i > 0)}, p) for i, p in enumerate(pieces(body, most) if body else [])]
            if depth is not None:
                number, path, lines = number + 1, [*path[:depth], t], []
                head = {"section": number, "title": t, "level": LEVELS[depth], "section_path": " > ".join(path), "page_number": page}
        if line is not None:
            lines.append(line)
            head["page_number"] = head["page_number"] or page
    chunks = []
    for head, body in found:
        if chunks and len(body) < least:
            chunks[-1][1].append(body)
        else:
            chunks.append((head, [body]))
    for i, (head, bodies) in enumerate(chunks):
        yield (i, *head.values(), "\n".join(bodies))


def register_chunk_text(spark: SparkSession, name: str = "chunk_text") -> None:
    """UD3: chunk_text as a table function for SQL: SELECT ... FROM documents, LATERAL chunk_text(text)."""

    class ChunkText:
        def eval(self, text: str):
            yield from chunk_text(text)

    made = F.udtf(ChunkText, returnType="chunk int, section long, title string, level string, section_path string, page_number int, body_text string")
    spark.udtf.register(name, made)


def chunk_overlap(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """RT2: windows of size characters that overlap: doc_id, chunk, start, body_text."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - overlap - 1, F.lit(0)), F.lit(step))
    rows = docs.filter(F.length("text") > 0).select("doc_id", "text", F.posexplode(starts).alias("chunk", "start"))
    return rows.select("doc_id", "chunk", "start", F.substring("text", F.col("start") + 1, F.lit(size)).alias("body_text"))


def split_by_toc(docs: DataFrame, entry: str) -> DataFrame:
    """RT3: parts of a text between the lines that match a table-of-contents entry: doc_id, part, title, start, end (line
    numbers, the end exclusive)."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "s"), F.size(F.split("text", "\n", -1)).alias("n"))
    w = Window.partitionBy("doc_id").orderBy("line")
    heads = lines.filter(F.col("s").rlike(entry))
    return heads.select("doc_id", (F.row_number().over(w) - 1).alias("part"), F.trim("s").alias("title"), F.col("line").alias("start"), F.coalesce(F.lead("line").over(w), F.col("n")).alias("end"))


def parse_rulebook(lines: DataFrame, chapter: str, clause: str) -> DataFrame:
    """RT4: (rulebook, chapter, clause, body): headers carried down to the lines under them. lines(rulebook, line, s)."""
    w = Window.partitionBy("rulebook").orderBy("line")
    carried = lines.withColumn("chapter", F.last(F.when(F.col("s").rlike(chapter), F.trim("s")), ignorenulls=True).over(w)).withColumn("clause", F.last(F.when(F.col("s").rlike(clause), F.trim("s")), ignorenulls=True).over(w))
    body = carried.filter(~F.col("s").rlike(chapter) & ~F.col("s").rlike(clause) & (F.trim("s") != "") & F.col("clause").isNotNull())
    parts = F.array_sort(F.collect_list(F.struct("line", F.trim("s").alias("s"))))
    return body.groupBy("rulebook", "chapter", "clause").agg(F.array_join(F.transform(parts, lambda x: x["s"]), " ").alias("body"))


def doc_profile(docs: DataFrame) -> DataFrame:
    """RT5: lines, headings, digits and upper-case shares, and a quality mark from them."""
    n = F.length("text")
    out = docs.select(
        "doc_id", n.alias("chars"), F.size(F.split("text", "\n", -1)).alias("n_lines"), F.regexp_count("text", F.lit("(?m)" + HEADING)).alias("n_headings"),
        F.round(F.coalesce(F.try_divide(F.regexp_count("text", F.lit("[0-9]")), n), F.lit(0.0)), 4).alias("digit_share"),
        F.round(F.coalesce(F.try_divide(F.regexp_count("text", F.lit("[A-Z]")), n), F.lit(0.0)), 4).alias("upper_share"),
    )
    return out.withColumn("quality", F.when((F.col("chars") < 100) | (F.col("digit_share") > 0.3), "poor").when(F.col("n_headings") > 0, "structured").otherwise("plain"))


def bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, boost: DataFrame | None = None) -> DataFrame:
    """RT6, RT7: the k best documents of each query: query_id, doc_id, score, rank. queries(query_id, text), docs(doc_id,
    text). boost(doc_id, factor of 0 or more): a document's score is multiplied by it."""
    wanted, members = ranked_index.asked_once(ranked_index.wanted_terms(queries).withColumn("n", F.lit(1)))
    parts = ranked_index.bm25_parts(ranked_index.postings(docs), docs, wanted, (), k1, b)
    if boost is not None:
        parts = parts.join(boost, "doc_id", "left").withColumn("a", F.col("a") * F.coalesce("factor", F.lit(1.0))).drop("factor")
    return ranked_index.for_all(ranked_index.best(parts, wanted, k), members)


def search_fields(queries: DataFrame, docs: DataFrame, k: int, title_weight: int = 3) -> DataFrame:
    """RT6: full text search with a field boost: a word of the title counts title_weight times. docs(doc_id, title, text)."""
    boosted = F.concat_ws(" ", *[F.col("title")] * title_weight, "text")
    return bm25(queries, docs.select("doc_id", boosted.alias("text")), k)


def surface_search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """RT15: 10 * distinct shared tokens + log10(length, 10 at least) + 1000 * the query's tokens that the text holds,
    repeats counted, / tokens of the text."""
    wanted, members = ranked_index.asked_once(ranked_index.wanted_terms(queries))
    parts = ranked_index.held_terms(docs, wanted).select("doc_id", "t", F.lit(10.0).alias("a"), (1000.0 / F.col("len")).alias("b"), F.log10(F.greatest("chars", F.lit(10)).cast("double")).alias("c"))
    return ranked_index.for_all(ranked_index.best(parts, wanted, k, digits=3, even=True), members)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def unit(c: Column) -> Column:
    """A vector of length 1 (a null vector stays)."""
    n = F.sqrt(dot(c, c))
    return F.when(n > 0, F.transform(c, lambda x: x.cast("double") / n)).otherwise(F.transform(c, lambda x: x.cast("double")))


def _blocks(df: DataFrame, key: str, vector: str, size: int, to: str) -> DataFrame:
    """Rows gathered into blocks of about so many: (to_ids, to_flat), the vectors of a block one after the other."""
    n = max(1, -(-df.count() // size))
    rows = F.collect_list(F.struct(F.col(key).alias("i"), F.col(vector).cast("array<double>").alias("v")))
    gathered = df.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("b")).agg(rows.alias("rows"))
    return gathered.select(F.transform("rows", lambda x: x["i"]).alias(f"{to}_ids"), F.flatten(F.transform("rows", lambda x: x["v"])).alias(f"{to}_flat"))


def vector_search(queries: DataFrame, vectors: DataFrame, k: int, block: int = 512) -> DataFrame:
    """RT8: the k nearest vectors of each query by exact cosine: query_id, vec_id, score, rank. queries(query_id, q: a
    stated set), vectors(vec_id, v), all of one length; filter vectors before.

    Queries and vectors are gathered in blocks of bounded size; each block of queries meets each block of vectors as one
    matrix product, and only the k best of each query and block go on."""
    import numpy as np

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        norm = lambda flat, n: (m := np.asarray(flat, dtype=np.float64).reshape(n, -1)) / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)
        for f in frames:
            for x in f.itertuples(index=False):
                vec_ids = np.asarray(x.v_ids)
                scores = np.round(norm(x.q_flat, len(x.q_ids)) @ norm(x.v_flat, len(vec_ids)).T, 4)
                best = np.lexsort((np.broadcast_to(vec_ids, scores.shape), -scores), axis=1)[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(x.q_ids, best.shape[1]), "vec_id": vec_ids[best].ravel(), "score": np.take_along_axis(scores, best, 1).ravel()})

    # A stated query set against all rows, in blocks.
    pairs = _blocks(vectors, "vec_id", "v", block, "v").join(_blocks(queries, "query_id", "q", block, "q"), F.lit(True))
    some = pairs.mapInPandas(work, "query_id long, vec_id long, score double")
    return topk(some, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k, rank="rank")


def rrf(*ranked: DataFrame, key: Sequence[str], k: int = 60, base: int = 1) -> DataFrame:
    """RT9: fused score sum 1 / (k + rank). ranked(key..., rank from 1); base: the number of the first rank."""
    rows = None
    for r in ranked:
        r = r.select(*key, (1.0 / (F.lit(float(k)) + F.col("rank") - 1 + base)).alias("s"))
        rows = r if rows is None else rows.unionByName(r)
    return rows.groupBy(*key).agg(F.round(F.sum("s"), 6).alias("rrf_score"), F.count(F.lit(1)).alias("n_lists"))


def protocol_support(fused: DataFrame) -> DataFrame:
    """RT10: parent score: RRF + .04 section + .05 ICD + .05 disease + .06 exact + .05 * overlap. fused(rrf_score,
    in_section, icd_match, disease_match, exact_mention: boolean, overlap)."""
    bonus = lambda c, x: F.when(F.col(c), x).otherwise(0.0)
    score = F.col("rrf_score") + bonus("in_section", 0.04) + bonus("icd_match", 0.05) + bonus("disease_match", 0.05) + bonus("exact_mention", 0.06) + 0.05 * F.col("overlap")
    return fused.withColumn("composite", F.round(score, 6))


#: Added before scores are rounded, so that those that lie half way go up whatever the order of a sum.
EPSILON = 1e-9

#: Layer -> weight of its hits for candidate diseases.
LAYERS = {"summary": 1.0, "assertion": 0.78, "chunk": 0.46}


def aggregate_candidates(hits: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """RT11: per query and disease the sum over hits of weight * (.7 score / layer's best + .3 / rank), and .18 more for
    hinted diseases. hits(query_id, layer, disease_id, score), hints(query_id, disease_id)."""
    w = Window.partitionBy("query_id", "layer").orderBy(F.col("score").desc(), "disease_id")
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in LAYERS.items() for x in kv]), F.col("layer"))
    ranked = norm_by_max(hits.withColumn("rank", F.row_number().over(w)), ["query_id", "layer"], "score", "rel")
    sums = ranked.groupBy("query_id", "disease_id").agg(F.sum(weight * (0.7 * F.col("rel") + 0.3 / F.col("rank"))).alias("score"), F.count(F.lit(1)).alias("hits"))
    if hints is not None:
        sums = sums.join(hints.distinct().withColumn("hinted", F.lit(0.18)), ["query_id", "disease_id"], "left").withColumn("score", F.col("score") + F.coalesce("hinted", F.lit(0.0))).drop("hinted")
    return sums.withColumn("score", F.round(F.col("score") + EPSILON, 4))


def retrieve(queries: DataFrame, layers: dict[str, tuple[DataFrame, Sequence[str]]], k: int = 8) -> DataFrame:
    """RT12: hits of the layers that serve a query's intent, fused by RRF: query_id, layer, doc_id, rrf_score, layer_hits
    (hits of the layer, at most k), rank. queries(query_id, text, intent), layers: name -> (docs(doc_id, text), intents).

    The layers are one index, each a collection of its own."""
    docs = functools.reduce(DataFrame.unionByName, [d.select(F.lit(name).alias("layer"), "doc_id", "text") for name, (d, _) in layers.items()])
    serves = F.array_compact(F.array(*[F.when(F.col("intent").isin(list(intents)), F.lit(name)) for name, (_, intents) in layers.items()]))
    wanted = ranked_index.wanted_terms(queries.select("query_id", "text", F.explode(serves).alias("layer")), ["layer"])
    wanted, members = ranked_index.asked_once(wanted.withColumn("n", F.lit(1)), ["layer"])
    parts = ranked_index.bm25_parts(ranked_index.postings(docs, ["layer"]), docs, wanted, ["layer"])
    found = ranked_index.for_all(ranked_index.best(parts, wanted, k, ["layer"]), members, ["layer"])
    hits = F.count(F.lit(1)).over(Window.partitionBy("query_id", "layer"))
    fused = found.select("query_id", "layer", "doc_id", F.round(1.0 / (60 + F.col("rank")), 6).alias("rrf_score"), hits.alias("layer_hits"))
    return topk(fused, ["query_id"], [F.col("rrf_score").desc(), F.col("layer"), F.col("doc_id")], k, rank="rank")


def sufficiency(results: DataFrame, needs: DataFrame) -> DataFrame:
    """RT14: per query whether its hits reach the intent's threshold and which layers are missing. results(query_id,
    intent, layer), needs(intent, min_hits, layers: array)."""
    have = results.groupBy("query_id", "intent").agg(F.count(F.lit(1)).alias("hits"), F.collect_set("layer").alias("have")).join(needs, "intent")
    missing = F.array_sort(F.array_except("layers", "have"))
    return have.select("query_id", "intent", "hits", missing.alias("missing_layers"), ((F.col("hits") >= F.col("min_hits")) & (F.size(missing) == 0)).alias("sufficient"))


def search_claims(queries: DataFrame, edges: DataFrame, cap: int = 10) -> DataFrame:
    """RT16: for each query's disease its services and signs, cap of each. queries(query_id, disease), edges(disease,
    kind, item, score)."""
    hit = queries.join(edges, "disease")
    some = topk(hit, ["query_id", "kind"], [F.col("score").desc(), F.col("item")], cap, rank="rank")
    lists = F.array_sort(F.collect_list(F.struct("rank", "item")))
    return some.groupBy("query_id", "kind").agg(F.transform(lists, lambda x: x["item"]).alias("items"))


def hashed_vector(text: Column, size: int = 64) -> Column:
    """UD2: a deterministic stand-in for an embedder: signed counts of hashed tokens."""
    t = tokens(text, min_len=1)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(t, F.lit(0.0), lambda s, w: s + F.when(F.pmod(F.xxhash64(w), F.lit(size)) == i, 1.0).otherwise(0.0)))


def source_priority(hits: DataFrame, queries: DataFrame, docs: DataFrame, k: int, first: str = "BYT") -> DataFrame:
    """RT13: the k best hits of each query from the best source that has any: its hospital, then ``first`` (the
    ministry), then all others; a query without a hospital begins with ``first``. Returns query_id, doc_id, score,
    source_priority (hospital, BYT, other; all instead of other without a hospital), rank. hits(query_id, doc_id, score),
    queries(query_id, hospital), docs(doc_id, source_type, hospital). Tiers that a query does not use go before any
    ranking; ties by doc_id."""
    named = hits.join(docs.select("doc_id", "source_type", F.col("hospital").alias("__of")), "doc_id").join(queries.select("query_id", "hospital"), "query_id")
    own = (F.col("source_type") == "hospital") & (F.col("hospital") == F.col("__of"))
    tier = F.when(own, 1).when(F.col("source_type") == first, 2).otherwise(3)
    ranked = named.withColumn("tier", tier)
    best = ranked.groupBy("query_id").agg(F.min("tier").alias("tier"))
    kept = topk(ranked.join(best, ["query_id", "tier"]), ["query_id"], [F.col("score").desc(), F.col("doc_id")], k, rank="rank")
    name = F.when(F.col("tier") == 1, "hospital").when(F.col("tier") == 2, first).when(F.col("hospital").isNotNull(), "other").otherwise("all")
    return kept.select("query_id", "doc_id", "score", name.alias("source_priority"), "rank")
