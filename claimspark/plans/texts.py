"""Queries of the text rules over notes, reasons and names made from the tables' rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.match import match_signs
from ..sources.scratch import deal, spread
from .common import query, table

REASONS = ("Đồng chi trả", "Kiểm tra/tầm soát", "Vượt quá hạn mức một lần khám", "Nộp muộn, thiếu giấy ra viện", "Bệnh có sẵn", "Không thuộc phạm vi; không bảo hiểm", "khác")
_REASONS = "[" + ", ".join(f"'{r}'" for r in REASONS) + "]"


def pick(names: tuple[str, ...], k: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), k.cast("int"))


def _folded(c: str) -> str:
    return f"replace(strip_accents(lower({c})), 'đ', 'd')"


@query(f"""WITH r AS (SELECT p_partkey, {_folded(f"{_REASONS}[p_partkey % 7 + 1] || '; ' || {_REASONS}[p_size % 7 + 1]")} AS r FROM part),
k AS (SELECT p_partkey, list_filter([{", ".join(f"CASE WHEN regexp_matches(r, '{p}') THEN '{n}' END" for n, p in T.RISKS)}], lambda x: x IS NOT NULL) AS k FROM r) SELECT p_partkey, CASE WHEN len(k) = 0 THEN 'other' ELSE array_to_string(k, ',') END AS kinds FROM k""")
def risk_labels(spark: SparkSession, d: str) -> DataFrame:
    """TX22: the kinds of two reasons in one cell."""
    cell = F.concat_ws("; ", pick(REASONS, F.col("p_partkey") % 7), pick(REASONS, F.col("p_size") % 7))
    return deal(table(spark, d, "part")).select("p_partkey", F.array_join(T.risk_kinds(cell), ",").alias("kinds"))


@query(f"SELECT p_partkey, list_filter([trim(regexp_replace(x, '\\s+', ' ', 'g')) FOR x IN regexp_split_to_array({_REASONS}[p_partkey % 7 + 1] || ' ;' || p_name || chr(10) || ' ; ' || p_brand, '[;\\n|]+')], lambda x: x <> '').array_to_string('|') AS parts FROM part")
def reason_parts(spark: SparkSession, d: str) -> DataFrame:
    """TX15."""
    cell = F.concat(pick(REASONS, F.col("p_partkey") % 7), F.lit(" ;"), "p_name", F.lit("\n ; "), "p_brand")
    return deal(table(spark, d, "part")).select("p_partkey", F.array_join(T.split_reasons(cell), "|").alias("parts"))


@query("""WITH t AS (SELECT p_partkey, p_name || ' (h' || (10 + p_size) || CASE WHEN p_size % 2 = 0 THEN '.' || p_size % 10 ELSE '' END || ')' AS t FROM part)
SELECT p_partkey, regexp_extract(upper(t), '\\b([A-TV-Z][0-9]{2}(\\.[0-9]{1,2})?)\\b', 1) AS code, regexp_extract(upper(t), '\\b([A-TV-Z][0-9]{2}(\\.[0-9]{1,2})?)\\b', 1)[1:3] AS icd_group FROM t""")
def icd_codes(spark: SparkSession, d: str) -> DataFrame:
    """TX14: codes in the names of parts."""
    size = F.col("p_size")
    t = F.concat("p_name", F.lit(" (h"), (10 + size).cast("string"), F.when(size % 2 == 0, F.concat(F.lit("."), (size % 10).cast("string"))).otherwise(""), F.lit(")"))
    return deal(table(spark, d, "part")).select("p_partkey", T.icd_extract(t).alias("code"), T.icd_group(T.icd_extract(t)).alias("icd_group"))


@query(r"""SELECT doc_id, regexp_replace(substr(text, greatest(CASE WHEN strpos(lower(text), 'the') > 0 THEN strpos(lower(text), 'the') WHEN strpos(lower(text), 'la') > 0 THEN strpos(lower(text), 'la') ELSE 1 END - 133, 1), 400), '^\s+|\s+$', '', 'g') AS snippet FROM documents""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    """TX29: around the first "the" of every document, else the first "la", else its beginning."""
    return table(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), F.lit("THE la")).alias("snippet"))


@query(rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '([{T.WRAPPED},;])\n([{T.WRAPPED}])', '\1 \2', 'g'), '[^\S\n]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents""")
def ocr_texts(spark: SparkSession, d: str) -> DataFrame:
    """TX28: the digest of every document after the clean-up."""
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.md5(T.clean_ocr(F.col("text")).cast("binary")).alias("digest"))


HEADINGS = ("1. Triệu chứng", "II. CHẨN ĐOÁN", "Điêu trị", "Cận lâm", "Đại cương", "Biến chứng", "Dự phòng", "Phụ lục")


@query(f"""WITH h AS (SELECT doc_id, lower([{", ".join(f"'{h}'" for h in HEADINGS)}][doc_id % 8 + 1] || ' ' || substr(coalesce(text, ''), 1, 200)) AS h FROM documents)
SELECT doc_id, CASE {" ".join(f"WHEN regexp_matches(h, '{p}') THEN '{n}'" for n, p in T.SECTIONS)} ELSE 'other' END AS section_type FROM h""")
def section_types(spark: SparkSession, d: str) -> DataFrame:
    """TX20: headings before the texts of documents."""
    return table(spark, d, "documents").select("doc_id", T.section_type(pick(HEADINGS, F.col("doc_id") % 8), F.col("text")).alias("section_type"))


_NOTE = "'Căn cứ Khoản ' || p_size || ' Điều 3; đồng chi trả ' || p_size % 100 || '%: Siêu âm ' || p_name || ' bằng ' || p_partkey || '.000 VNĐ, tối đa ' || p_size || '00.000 đồng mỗi lần / lần khám'"


@query(f"""SELECT p_partkey, true AS copay_flag, p_size % 100 AS copay_percent, false AS screening_flag, true AS limit_per_visit_flag, p_size * 100000 AS limit_per_visit_vnd, 'Khoản ' || p_size || ' Điều 3' AS clauses, 'Siêu âm ' || p_name AS item, p_partkey * 1000 AS amount FROM (SELECT *, {_NOTE} AS note FROM part)""")
def note_signals(spark: SparkSession, d: str) -> DataFrame:
    """TX16-TX18: what notes made from the parts say."""
    size, text = F.col("p_size").cast("string"), F.lit
    note = F.concat(text("Căn cứ Khoản "), size, text(" Điều 3; đồng chi trả "), (F.col("p_size") % 100).cast("string"), text("%: Siêu âm "), "p_name", text(" bằng "), F.col("p_partkey").cast("string"), text(".000 VNĐ, tối đa "), size, text("00.000 đồng mỗi lần / lần khám"))
    s = deal(table(spark, d, "part").select("p_partkey", "p_size", "p_name")).select("p_partkey", T.note_signals(note, F.array().cast("array<string>")).alias("s"))
    first = F.get("s.service_mentions", F.lit(0))
    return s.select("p_partkey", "s.copay_flag", "s.copay_percent", "s.screening_flag", "s.limit_per_visit_flag", "s.limit_per_visit_vnd", F.array_join("s.clause_references", "|").alias("clauses"), first["item_name"].alias("item"), first["amount_vnd"].alias("amount"))


@query("""WITH t AS (SELECT DISTINCT p_name, string_split(p_name, ' ') AS w FROM part) SELECT p_name, array_to_string(list_sort(list_intersect(w, ['widget', 'bolt'])), ',') AS things, array_to_string(list_sort(list_intersect(w, ['small', 'large'])), ',') AS sizes FROM t""")
def signal_groups(spark: SparkSession, d: str) -> DataFrame:
    """TX11."""
    groups = T.signal_tokens(F.col("p_name"), {"things": ["widget", "bolt"], "sizes": ["small", "large"]})
    named = table(spark, d, "part").select("p_name").distinct().withColumn("g", groups)
    return named.select("p_name", *[F.array_join(F.array_sort(F.col("g")[k]), ",").alias(k) for k in ("things", "sizes")])


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Xét nghiệm ' ELSE 'khám ' END || page_id AS repaired FROM pages""")
def repaired_texts(spark: SparkSession, d: str) -> DataFrame:
    """TX5: every third text has been read as Latin-1."""
    good = F.concat(F.when(F.col("page_id") % 3 == 0, "Xét nghiệm ").otherwise("khám "), F.col("page_id").cast("string"))
    broken = F.when(F.col("page_id") % 3 == 0, F.decode(F.encode(good, "UTF-8"), "ISO-8859-1")).otherwise(good)
    return table(spark, d, "pages").select("page_id", T.repair_text(broken).alias("repaired"))


#: Noise before and after a name: prefix, suffix.
NOISY = (("dv_", " (tt23)"), ("xét nghiệm - ", " (bhyt) (máu)"), ("x quang - ", ", (bất kỳ)"), ("huyết học - ", " (22.0121.1369)"), ("kb (515 ", " (yc qđ284-2025))"), ("22.01.13 -- ", " 28 chỉ số m3"), ("khoa ", " vinmec"), ("", " -ptm 2-201 phòng lấy"))


def _rules_sql(c: str, rules: tuple[tuple[str, str], ...]) -> str:
    for pattern, new in rules:
        c = f"regexp_replace({c}, '{pattern}', '{new}', 'g')"
    return c


@query(f"""WITH t AS (SELECT p_partkey, [{", ".join(f"'{a}'" for a, _ in NOISY)}][p_partkey % 8 + 1] || p_name || [{", ".join(f"'{b}'" for _, b in NOISY)}][p_size % 8 + 1] AS s FROM part)
SELECT p_partkey, trim(rtrim(trim({_rules_sql("trim(s)", T.NOISE)}), ')'), ' .*-') AS stripped FROM t""")
def stripped_names(spark: SparkSession, d: str) -> DataFrame:
    """TX4: names of parts between prefixes and suffixes."""
    noisy = F.concat(pick(tuple(a for a, _ in NOISY), F.col("p_partkey") % 8), "p_name", pick(tuple(b for _, b in NOISY), F.col("p_size") % 8))
    return deal(table(spark, d, "part")).select("p_partkey", T.strip_noise(noisy).alias("stripped"))


_PIECES = """t AS (SELECT p_partkey, trim(regexp_replace(replace(' ' || regexp_replace(lower(p_name || ', ' || p_brand || ' va ' || p_type || ' nhe hon cac ' || p_name), '[^a-z0-9]+', ' ', 'g') || ' ', ' nhe ', ' '), ' +', ' ', 'g')) AS c FROM part),
f AS (SELECT p_partkey, c, unnest(string_split(c, ' va ')) AS f FROM t), w AS (SELECT *, list_filter(string_split(f, ' '), lambda x: x <> 'cac') AS w FROM f),
x AS (SELECT p_partkey, c, c AS x FROM t UNION SELECT p_partkey, c, f FROM f UNION SELECT p_partkey, c, array_to_string(w[i:i + n - 1], ' ') FROM w, unnest(range(2, 6)) n(n), unnest(range(1, 40)) i(i) WHERE i + n - 1 <= len(w)),
pieces AS (SELECT p_partkey, x, row_number() OVER (PARTITION BY p_partkey ORDER BY len(string_split(x, ' ')) DESC, length(x) DESC, x) AS r FROM x WHERE contains(x, ' ') OR x = c QUALIFY r <= 24)"""


def free_text() -> Column:
    return F.concat("p_name", F.lit(", "), "p_brand", F.lit(" va "), "p_type", F.lit(" nhe hon cac "), "p_name")


def pieces(c: Column) -> Column:
    return T.decompose_signs(c, fillers=["nhe"], splits=[r"\bva\b"], stop=["cac"])


@query(f"WITH {_PIECES} SELECT p_partkey, string_agg(x, '|' ORDER BY r) AS pieces FROM pieces GROUP BY 1")
def decomposed_signs(spark: SparkSession, d: str) -> DataFrame:
    """TX19: the pieces of texts made from the parts' columns."""
    return deal(table(spark, d, "part")).select("p_partkey", F.array_join(pieces(free_text()), "|").alias("pieces"))


INSURED = ("Bảo hiểm Hùng Vương", "PJICO miền Nam", "Liên Hiệp UIC", "Công ty bảo hiểm chưa biết tên", "Tokio Marine")
PLANS = ((r"gói mở rộng", "NT", "Mở rộng"), (r"gói a\b", "NT", "Gói A"), (r"cấp 1-2|cấp 1\b", "NV", "Cấp 1-2"))


@query(f"""WITH t AS (SELECT c_custkey, [{", ".join(f"'{i}'" for i in INSURED)}][c_custkey % 5 + 1] AS i, CASE c_custkey % 4 WHEN 0 THEN 'Gói mở rộng a' WHEN 1 THEN 'GÓI A' WHEN 2 THEN 'Nhân viên cấp 1' ELSE 'Gói ab' END AS p FROM customer)
SELECT c_custkey, CASE {" ".join(f"WHEN contains(lower(i), '{k}') THEN '{v}'" for k, v in T.INSURERS)} ELSE i[1:20] END AS insurer, CASE c_custkey % 4 WHEN 0 THEN 'Mở rộng' WHEN 1 THEN 'Gói A' WHEN 2 THEN 'Cấp 1-2' END AS plan, CASE c_custkey % 4 WHEN 0 THEN 'NT' WHEN 1 THEN 'NT' WHEN 2 THEN 'NV' END AS contract FROM t""")
def insurer_codes(spark: SparkSession, d: str) -> DataFrame:
    """TX26: insurers and plans by customer."""
    k = F.col("c_custkey")
    plan = T.norm_plan(pick(("Gói mở rộng a", "GÓI A", "Nhân viên cấp 1", "Gói ab"), k % 4), PLANS)
    c = deal(table(spark, d, "customer")).select("c_custkey", T.norm_insurer(pick(INSURED, k % 5)).alias("insurer"), plan.alias("p"))
    return c.select("c_custkey", "insurer", F.col("p.plan_name").alias("plan"), F.col("p.contract_id").alias("contract"))


_SIGNS = ((1, "small widget", "small widget", 5), (1, "small widget", "widget economy", 2), (2, "bolt", "bolt", 9), (3, "large bolt", "economy hon", 4), (4, "old economy", "economy hon", 4), (5, "brand", "cold brand widget", 1))


@query(f"""WITH {_PIECES}, a AS (SELECT DISTINCT x, list_filter(string_split(x, ' '), lambda y: NOT regexp_full_match(y, '[0-9]+') AND length(y) >= 2) AS w FROM pieces),
b(sign_id, label, alias, cases) AS (VALUES {", ".join(map(str, _SIGNS))}), s AS (SELECT sign_id, max(label) AS label, sum(cases) AS cases FROM b GROUP BY 1),
m AS (SELECT x, sign_id, w, string_split(alias, ' ') AS v, alias, len(list_intersect(w, string_split(alias, ' '))) AS h, array_to_string(w, ' ') AS t FROM a, b),
e AS (SELECT x, sign_id, len(w) AS n, max(CASE WHEN x = alias THEN 1.0::DOUBLE WHEN len(w) >= 2 AND len(v) >= 2 AND (contains(' ' || t || ' ', ' ' || alias || ' ') OR contains(' ' || alias || ' ', ' ' || t || ' ')) THEN 0.94::DOUBLE
  WHEN h >= 2 THEN 0.35::DOUBLE + 0.35::DOUBLE * h / len(list_distinct(w)) + 0.15::DOUBLE * h / len(v) + 0.15::DOUBLE * h / (len(list_distinct(w)) + len(v) - h) WHEN len(list_distinct(w)) = 1 AND len(v) = 1 AND h = 1 THEN 0.74::DOUBLE ELSE 0 END) AS score FROM m GROUP BY ALL),
k AS (SELECT e.x, sign_id, n, round(score, 4) AS score, label, cases FROM e JOIN s USING (sign_id) WHERE score >= 0.55 QUALIFY row_number() OVER (PARTITION BY e.x ORDER BY round(score, 4) DESC, cases DESC, label DESC, sign_id) <= 2),
g AS (SELECT p_partkey, sign_id, max(CASE WHEN n >= 2 AND k.x <> c THEN round(least(1, score + 0.03::DOUBLE), 4) ELSE score END) AS score, any_value(cases) AS cases, any_value(label) AS label FROM k JOIN pieces USING (x) JOIN (SELECT p_partkey, trim(regexp_replace(lower(p_name || ', ' || p_brand || ' va ' || p_type || ' nhe hon cac ' || p_name), '[^a-z0-9]+', ' ', 'g')) AS c FROM part) USING (p_partkey) GROUP BY 1, 2)
SELECT p_partkey, sign_id, score FROM g QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, cases DESC, label DESC, sign_id) <= 2""")
def match_sign_fragments(spark: SparkSession, d: str) -> DataFrame:
    """ER10: signs with aliases and cases for the pieces of free texts, two for each."""
    p = table(spark, d, "part").select("p_partkey", free_text().alias("phrase"))
    catalog = spark.createDataFrame(_SIGNS, "sign_id int, label string, alias string, support_cases int")
    return p.join(match_signs(p, catalog, 2, pieces=pieces), "phrase").select("p_partkey", "sign_id", "score")
