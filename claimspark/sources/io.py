"""Sources and sinks (IO)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import norm_key, parse_date, parse_vnd, stable_id


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """IO1: JSON lines under a schema; blank lines give no rows."""
    return spark.read.schema(schema).json(path)


def explode_claim_lines(claims: DataFrame, lines: str = "service_lines", keep: Sequence[str] = ("claim_id",)) -> DataFrame:
    """IO2: one row per billed service with the claim's context, numbered from 1; claims without lines keep one row."""
    rows = claims.select(*keep, F.posexplode_outer(lines).alias("__i", "__line"))
    return rows.select(*keep, (F.col("__i") + 1).alias("line_no"), "__line.*")


def read_claim_extract(df: DataFrame, mapping: dict[str, tuple[int, str]], missing: str = "") -> DataFrame:
    """IO3: columns by position with typed coercion. mapping: name -> (position, kind): text (null: missing), money (bad:
    0), number (bad: 0) or date (bad: null). df comes from read.csv or read.parquet."""
    kinds = {
        "text": lambda c: F.coalesce(F.trim(c.cast("string")), F.lit(missing)), "money": lambda c: F.coalesce(parse_vnd(c.cast("string")), F.lit(0)),
        "number": lambda c: F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0)), "date": lambda c: parse_date(c.cast("string")),
    }
    return df.select(*[kinds[kind](F.col(f"`{df.columns[i]}`")).alias(name) for name, (i, kind) in mapping.items()])


def select_first_present(df: DataFrame, candidates: dict[str, Sequence[str]]) -> DataFrame:
    """IO4: for each name the first candidate column that df has (compared without case, accents and punctuation), else
    null."""
    import re
    import unicodedata

    plain = lambda s: re.sub("[^a-z0-9]+", "", "".join(c for c in unicodedata.normalize("NFD", s.lower().replace("đ", "d")) if not unicodedata.combining(c)))
    have = {plain(c): c for c in reversed(df.columns)}
    pick = lambda names: next((F.col(f"`{have[plain(n)]}`") for n in names if plain(n) in have), F.lit(None).cast("string"))
    return df.select(*[pick(names).alias(to) for to, names in candidates.items()])


def read_service_table(spark: SparkSession, path: str, candidates: dict[str, Sequence[str]]) -> DataFrame:
    """IO4: a price list from CSV with a header."""
    return select_first_present(spark.read.option("header", True).csv(path), candidates)


def scan_assets(spark: SparkSession, roots: dict[str, str], glob: str = "*") -> DataFrame:
    """IO5: (asset_id, root_key, path, filename, extension, sha1, size_bytes) of the files under the roots."""
    out = None
    for key, root in roots.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
        rows = files.select(stable_id("asset:", F.lit(key), F.col("path")).alias("asset_id"), F.lit(key).alias("root_key"), "path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), F.sha1("content").alias("sha1"), F.col("length").alias("size_bytes"))
        out = rows if out is None else out.unionByName(rows)
    return out


def discover_texts(spark: SparkSession, root: str, include: str = "", exclude: str = r"(^|/)[._]|README|index", limit: int | None = None) -> DataFrame:
    """IO6: (path, text) of whole text files whose path matches include and not exclude; limit: so many by path (a limit
    the caller asks for)."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    rows = rows.filter(F.col("path").rlike(include) & ~F.element_at(F.split("path", "/"), -1).rlike(exclude))
    return rows if limit is None else rows.orderBy("path").limit(limit)


def write_outputs(df: DataFrame, path: str, fmt: str = "json", **options) -> None:
    """IO11: df as json, csv (nested columns as JSON text) or parquet."""
    if fmt == "csv":
        nested = (T.ArrayType, T.MapType, T.StructType)
        df = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema])
        options = {"header": True} | options
    df.write.mode("overwrite").options(**options).format(fmt).save(path)


def audit_tables(lines: DataFrame, codebook: DataFrame, ocr_fixes: Sequence[tuple[str, str, str]] = ()) -> dict[str, DataFrame]:
    """IO12: trace (each raw row with its cleaned name, rules and code), codes (each code with its variants) and rules (how
    often each rule was applied). lines(raw), codebook(name, code)."""
    from ..functions.text import clean_service_name

    trace = lines.withColumn("__c", clean_service_name(F.col("raw"), ocr_fixes)).select(*lines.columns, F.col("__c.name").alias("name"), F.col("__c.rules").alias("rules")).join(codebook, "name", "left")
    codes = trace.filter("code IS NOT NULL").groupBy("code").agg(F.count(F.lit(1)).alias("occurrences"), F.concat_ws(" | ", F.array_sort(F.collect_set("name"))).alias("variants"))
    rules = trace.select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n_rows"))
    return {"trace": trace, "codes": codes, "rules": rules}


EVENT_SCHEMA = "type STRING, model STRING, num_turns INT, duration_ms BIGINT, total_cost_usd DOUBLE, message STRUCT<id: STRING, content: ARRAY<STRUCT<type: STRING, name: STRING>>>, usage MAP<STRING, BIGINT>"


def read_run_events(spark: SparkSession, path: str) -> DataFrame:
    """IO14: run events with the number of the content part, one row per part; events without parts keep one row."""
    events = spark.read.schema(EVENT_SCHEMA).json(path)
    return events.select("type", "model", "num_turns", "duration_ms", "total_cost_usd", "usage", F.col("message.id").alias("message_id"), F.posexplode_outer("message.content").alias("part", "content"))


def unpivot_benefits(rows: DataFrame, plans: Sequence[str], order: str = "row", keys: Sequence[str] = ("sheet",)) -> DataFrame:
    """IO17: wide benefit rows as long ones: plan columns to rows, section headers carried down, header-only rows
    dropped. rows(sheet, row, section, name, plan columns)."""
    w = Window.partitionBy(*keys).orderBy(order)
    filled = rows.withColumn("section", F.last(F.nullif(F.trim("section"), F.lit("")), ignorenulls=True).over(w))
    long = filled.unpivot([*keys, order, "section", "name"], list(plans), "plan", "value")
    return long.filter(F.coalesce(F.trim(F.col("value").cast("string")) != "", F.lit(False)) & (F.coalesce(F.trim("name"), F.lit("")) != ""))


def insurance_packs_to_graph(packs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """IO16: contract packs (contract_id, insurer, plans: array<string>, benefits: array<struct<name, plan>>, exclusions:
    array<string>) as nodes(label, node_id, name) and edges(edge_type, src_id, dst_id)."""
    i = lambda p, *c: stable_id(p, *[norm_key(x) for x in c])
    c = F.concat(F.lit("contract:"), F.col("contract_id"))
    plan, benefit = packs.select("contract_id", c.alias("c"), F.explode("plans").alias("x")), packs.select("contract_id", c.alias("c"), F.explode("benefits").alias("x"))
    exclusion = packs.select(c.alias("c"), F.explode("exclusions").alias("x"))
    node = lambda df, label, key, name: df.select(F.lit(label).alias("label"), key.alias("node_id"), name.alias("name"))
    edge = lambda df, kind, a, b: df.select(F.lit(kind).alias("edge_type"), a.alias("src_id"), b.alias("dst_id"))
    plan_id = lambda n: i("plan:", F.col("contract_id"), n)
    nodes = [node(packs, "contract", c, F.col("contract_id")), node(packs, "insurer", i("insurer:", F.col("insurer")), F.col("insurer")), node(plan, "plan", plan_id(F.col("x")), F.col("x")), node(benefit, "benefit", i("benefit:", F.col("x.name")), F.col("x.name")), node(exclusion, "exclusion", i("exclusion:", F.col("x")), F.col("x"))]
    edges = [edge(packs, "ISSUED_BY", c, i("insurer:", F.col("insurer"))), edge(plan, "HAS_PLAN", F.col("c"), plan_id(F.col("x"))), edge(benefit, "COVERS", plan_id(F.col("x.plan")), i("benefit:", F.col("x.name"))), edge(exclusion, "EXCLUDES", F.col("c"), i("exclusion:", F.col("x")))]
    union = lambda xs: xs[0] if len(xs) == 1 else xs[0].unionByName(union(xs[1:]))
    return union(nodes).dropDuplicates(["label", "node_id"]), union(edges).distinct()


def asset_tables(documents: DataFrame, tables: dict[str, DataFrame], key: str = "doc_id") -> dict[str, DataFrame]:
    """IO18: of each table the rows that derive from the documents."""
    wanted = documents.select(key).distinct()
    return {name: df.join(wanted, key, "left_semi") for name, df in tables.items()}


def backfill(df: DataFrame, column: str, value) -> DataFrame:
    """IO19: a column's nulls replaced by an expression."""
    return df.withColumn(column, F.coalesce(F.col(column), value))


def fix_term(df: DataFrame, bad: str, good: str) -> DataFrame:
    """IO20: a term corrected in every text column; the first letter keeps its case."""
    import re

    up = lambda s: s[:1].upper() + s[1:]
    fixed = lambda c: F.regexp_replace(F.regexp_replace(c, rf"\b{re.escape(up(bad))}\b", up(good)), rf"\b{re.escape(bad)}\b", good)
    return df.select(*[fixed(F.col(f"`{n}`")).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes])

