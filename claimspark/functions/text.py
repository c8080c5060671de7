"""Text expressions: all are Column -> Column and stay in the JVM. Rule lists are parameters; the defaults below are the
fixed values that results depend on."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Letters with an accent and their plain letters, from the Unicode tables: Latin-1, Latin Extended and Vietnamese."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        base = unicodedata.normalize("NFD", c)[0]
        if base != c and base.isascii():
            pairs[c] = base
    pairs |= {"đ": "d", "Đ": "D"}
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _accents()
ACCENTED_LOWER = "".join(c for c in ACCENTED if c == c.lower())
PLAIN_LOWER = "".join(p for c, p in zip(ACCENTED, PLAIN, strict=True) if c == c.lower())

SPACE = r"\s+"
#: White space of every script, without the line feed.
BLANKS = r"\t\u000b-\r\u001c-\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def ascii_fold(c: Column) -> Column:
    """TX1: lower case without accents; đ becomes d."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED_LOWER, PLAIN_LOWER), "[̀-ͯ]", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def norm_key(c: Column) -> Column:
    """TX2: folded, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(ascii_fold(c), "[^a-z0-9]+", " "))


def skeleton(c: Column) -> Column:
    """TX4: folded, letters and digits only, no spaces."""
    return F.regexp_replace(ascii_fold(c), "[^a-z0-9]+", "")


def apply_rules(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """A chain of (pattern, replacement)."""
    for pattern, new in rules:
        c = F.regexp_replace(c, pattern, new)
    return c


# What says nothing about a service, in the order in which it goes: other spellings, prefixes, suffixes in
# brackets, other suffixes, counts and numbers of bills, names of hospitals, codes.
NOISE = (
    (r"\bxquang\b", "x-quang"),
    (r"\bx quang\b", "x-quang"),
    (r"t[iíì]m ph[ổốối]i?", "ngực"),
    (r"^(?:dv_?\s*|xn\s+|xn_|\*|\.|\d+\.\s*)", ""),
    (r"^(?:xét nghiệm\s*[-:]*\s*)", ""),
    (r"(?i)^(?:xn\s+(?:huyết học|sinh hóa|sh)\s*[-()]*\s*)", ""),
    (r"^(?:huyết học\s*-\s*|sinh hóa máu\s*-\s*|chẩn đoán hình ảnh\s*-\s*)", ""),
    (r"^(?:x-quang\s*-\s*)", ""),
    (r"^(?:dịch vụ\s+|khoa\s+)", ""),
    (r"^(?:\(dn_tn\)\s*|\(d\)\s*)", ""),
    (r"^(?:ttktc_?\s*)", ""),
    *[
        (rf"\s*\({inside}\)\s*$", "")
        for inside in (
            r"tt\d+", r"\d+ts", r"máy\s+\w+", "bhyt", "c", "d", "dv", "nhi", "máu", "niệu", r"phụ thu[^)]*", r"\d[\d.]+\d", r"[\d.]+", r"bv\s+[^)]*",
            "mỗi chất", "mối chất", "bất kỳ",
        )
    ],
    (r"\s*,\s*\(bất kỳ\)\s*$", ""),
    *[(rf"\s*\({inside}\)\s*$", "") for inside in (r"\d+\s*thông số", r"\d+\s*thành phần[^)]*", r"yc\s+[^)]*")],
    (r"\s*-\s*tt\d+\s*$", ""),
    (r"\s*\*+\s*$", ""),
    (r"\s+m\d+\s*$", ""),
    (r"\s+\d{4}\s*$", ""),
    (r"\s+bt\s*$", ""),
    (r"\s+nnn\s*$", ""),
    (r"\s*\.\s*tm\s*$", ""),
    (r"\s+\(tm\)\s*$", ""),
    (r"\s*-ptm\s+.*$", ""),
    (r"\s*\d+\s*chỉ số\s*", " "),
    (r"\s*\(xn\s+\d+[^)]*\)\s*", ""),
    (r"\s*\([\d.]+/\w+\)\s*", ""),
    (r"\s*[\d.]+/\w+\s*$", ""),
    (r"\s*\(số bl:\s*\d+\)", ""),
    (r"\s*\(dh\d+-?\s*\d+\)", ""),
    (r"\s*dh\d+-\d+\s*$", ""),
    (r"(?i)\s+(vietlife|vinmec|medlatec|bv\s+\w+)\s*$", ""),
    (r"^kb\s*\(\d+\s+", ""),
    (r"\s*_\w+\s*$", ""),
    (r"\s*\((ngoại trú|nội trú)\)\s*$", ""),
    (r"^[\d.]+\s*--\s*", ""),
    (r"\s*\([\d.]+\)\s*$", ""),
    (r"^truyền máu\s*-\s*", ""),
    (r"\s+", " "),
)


def strip_noise(c: Column, rules: Sequence[tuple[str, str]] = NOISE) -> Column:
    """TX4: a cleaned (lower-case) service name without noise: each rule once, in order, then spaces, points, stars and
    dashes at the ends and brackets that are left open behind."""
    blank = r"^\s+|\s+$"
    out = apply_rules(F.regexp_replace(c, "(?U)" + blank, ""), [("(?U)" + p, new) for p, new in rules])
    return apply_rules(out, [("(?U)" + blank, ""), (r"\)+$", ""), (r"^[ .*-]+|[ .*-]+$", "")])


def clean_service_name(c: Column, ocr_fixes: Sequence[tuple[str, str, str]] = ()) -> Column:
    """TX3: struct<name, rules>: the cleaned name and which of R1..R6 changed it, in order. ocr_fixes: (wrong, right,
    reason)."""
    steps = [("R1", lambda x: F.regexp_replace(x, r"(?iu)^\[DV\]\s*", "")), ("R2", lambda x: F.regexp_replace(x, r"(?s)\s*\|.*$", "")), ("R3", lambda x: F.translate(x, "[]", "()")), ("R4", lambda x: nfc(F.lower(F.trim(x))))]
    steps += [(f"R5:{why}", lambda x, w=wrong, r=right: F.replace(x, F.lit(w), F.lit(r))) for wrong, right, why in ocr_fixes]  # plain Python lambdas
    steps.append(("R6", collapse))
    now, used = F.trim(c), []
    for name, step in steps:
        new = step(now)
        used.append(F.when(new != now, F.lit(name)))
        now = new
    return F.struct(now.alias("name"), F.filter(F.array(*used), lambda x: x.isNotNull()).alias("rules"))


def repair_text(c: Column) -> Column:
    """TX5: UTF-8 that was read as Latin-1; text whose Latin-1 bytes are not UTF-8 stays as it is."""
    may_be = c.rlike("[ÃÆÄá»]") & ~c.rlike("[^\u0000-ÿ]")
    read_again = F.encode(F.when(may_be, c).otherwise(""), "ISO-8859-1").cast("string")
    return F.when(may_be & F.is_valid_utf8(read_again), read_again).otherwise(c)


def tokens(c: Column, stop: Sequence[str] = (), min_len: int = 2) -> Column:
    """TX6: distinct tokens of the normalised text, without stop words and short ones."""
    kept = F.filter(F.array_distinct(F.split(norm_key(c), " ")), lambda t: F.length(t) >= min_len)
    return F.array_except(kept, F.array(*[F.lit(s) for s in stop])) if stop else kept


def jaccard(a: Column, b: Column) -> Column:
    """TX7: shared elements over all elements; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def ngrams(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams; a shorter text is its own."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, n)))).when(F.length(c) > 0, F.array(c)).otherwise(F.array().cast("array<string>"))


def word_ngrams(c: Column, low: int = 1, high: int = 3) -> Column:
    """Runs of low to high words of two letters, digits or underscores or more, repeats included."""
    words = F.regexp_extract_all(c, F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    run = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[run(n) for n in range(low, high + 1)])


def inner_ngrams(c: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams within the words, each between two spaces, repeats included."""
    words = F.transform(F.filter(F.split(c, SPACE), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    run = lambda w, n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, n))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(words, lambda w: F.concat(*[run(w, n) for n in range(low, high + 1)])))


def ngram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    """TX8: Jaccard of character n-grams."""
    return jaccard(ngrams(a, n), ngrams(b, n))


def first_match(c: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """TX9, TX20: the name of the first (name, pattern) that matches."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def discriminator(c: Column, vocabulary: Sequence[str]) -> Column:
    """TX10: the vocabulary's terms that the text holds, sorted."""
    return F.array_sort(F.filter(F.array(*[F.lit(v) for v in vocabulary]), lambda t: F.contains(c, t)))


def signal_tokens(c: Column, groups: dict[str, Sequence[str]]) -> Column:
    """TX11: map of group -> tokens of the text that are in the group."""
    have = tokens(c, min_len=1)
    return F.create_map(*[x for name, words in groups.items() for x in (F.lit(name), F.array_intersect(have, F.array(*[F.lit(w) for w in words])))])


def parse_vnd(c: Column) -> Column:
    """TX12: "1.042.300" -> 1042300; null without digits."""
    return F.regexp_replace(c, "[^0-9]", "").try_cast("bigint")


DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "dd.MM.yyyy")


def parse_date(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """TX13: the first format that fits, as a date."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats]).cast("date")


def icd_extract(c: Column) -> Column:
    """TX14: the first ICD-10 code of a text, upper case; empty if there is none."""
    return F.regexp_extract(F.upper(c), r"\b([A-TV-Z][0-9]{2}(?:\.[0-9]{1,2})?)\b", 1)


def icd_norm(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9.]", "")


def icd_group(c: Column) -> Column:
    return F.substring(icd_norm(c), 1, 3)


def split_reasons(c: Column) -> Column:
    """TX15: the atomic reasons of a cell."""
    return F.filter(F.transform(F.split(c, r"[;\n|]+"), collapse), lambda r: r != "")


# The grammar of clause references, one pattern after the other.
CLAUSE_REFS = (r"(Khoản\s+\d+[^\n.;:]*)", r"(Chương\s+[IVXLC]+[^\n.;:]*)", r"(Quy tắc bảo hiểm số\s+[^\n.;:]*)", r"(Quy tắc số\s+[^\n.;:]*)")


def clause_refs(c: Column, patterns: Sequence[str] = CLAUSE_REFS) -> Column:
    """TX16: references to clauses, up to the next stop, by pattern and then in order, each once."""
    found = F.concat(*[F.regexp_extract_all(c, F.lit("(?iu)" + p), F.lit(1)) for p in patterns])
    return F.array_distinct(F.filter(F.transform(found, collapse), lambda r: r != ""))


# The grammar of "item bằng amount VNĐ", and what such an item's name must not hold.
# A name begins where a run of its characters does or the mention before ends: if it fails there, it fails further on in
# the run, so a run is read once, not once from each of its characters.
_ITEM = r"[A-Za-zÀ-ỹ0-9#%+\-_/().,\s]"
MENTION = rf"(?:\G|(?<!{_ITEM}))({_ITEM}{{2,}}?)\s+bằng\s+([0-9][0-9.,\s]*)\s*(?:VNĐ|VND|đồng)"
MENTION_BLOCK = (
    "cong ty bao hiem", "pjico", "quy khach", "quyen loi", "chi phi y te thuc te", "hop dong", "can cu theo", "do do", "quy tac bao hiem", "dinh nghia",
    "ho so yeu cau boi thuong",
)


def service_mentions(c: Column, block: Sequence[str] = MENTION_BLOCK) -> Column:
    """TX17: array<struct<item_name, amount_vnd>> of the "item bằng amount" parts, each once."""
    names, amounts = (F.regexp_extract_all(c, F.lit("(?iu)" + MENTION), F.lit(k)) for k in (1, 2))
    bare = lambda n: apply_rules(F.trim(F.element_at(F.split(collapse(n), ":"), -1)), ((r"(?iu)^(?:,|và|va)\s+", ""), (r"(?iu)^chi phí\s+", "")))
    pairs = F.transform(F.zip_with(names, amounts, lambda n, a: F.struct(bare(n).alias("n"), parse_vnd(a).alias("a"))), lambda p: p)
    blocked = lambda n: ascii_fold(n).rlike("|".join(re.escape(b) for b in block)) if block else F.lit(False)
    fit = F.filter(pairs, lambda p: F.length(p["n"]).between(3, 120) & ~F.contains(p["n"], F.lit(". ")) & ~blocked(p["n"]))
    return F.array_distinct(F.transform(fit, lambda p: F.struct(F.regexp_replace(p["n"], r"^[*\-: ]+", "").alias("item_name"), p["a"].alias("amount_vnd"))))


# Fixed value: requested x percent % = paid.
FORMULA = r"([0-9][0-9.,\s]*)\s*(?:VNĐ|VND)?\s*x\s*(\d{1,3})\s*%\s*=\s*([0-9][0-9.,\s]*)"


def note_signals(note: Column, reasons: Column) -> Column:
    """TX18: what a claim note and its atomic reasons (array) say: co-payment, screening, documents, coverage, limits,
    the formula requested x percent = paid."""
    text, blob = ascii_fold(collapse(note)), F.concat_ws(" ; ", F.transform(reasons, ascii_fold))
    any_of = lambda c, words: F.coalesce(c.rlike("|".join(words)), F.lit(False))
    part = lambda k: parse_vnd(F.nullif(F.regexp_extract(note, "(?iu)" + FORMULA, k), F.lit("")))
    requested, percent, paid = part(1), part(2), part(3)
    phrase = F.regexp_extract(text, r"dong chi tra\s*(\d{1,3})\s*%", 1).try_cast("int")
    shares = any_of(text, ["dong chi tra"])
    copay = F.coalesce(phrase, F.when(shares & percent.between(0, 100), 100 - percent)).cast("int")
    # The three ways in which a limit for a unit is told, the first that matches.
    ways = (r"toi da[^0-9]{0,80}([0-9][0-9.,\s]*)\s*(?:vnd|dong)[^.\n]{0,80}/\s*", r"bang[^0-9]{0,40}([0-9][0-9.,\s]*)\s*(?:vnd|dong)[^.\n]{0,80}/\s*", r"([0-9][0-9.,\s]*)\s*(?:vnd|dong)\s*/\s*")
    limit = lambda unit: parse_vnd(F.coalesce(*[F.nullif(F.regexp_extract(text, w + unit, 1), F.lit("")) for w in ways]))
    visit = any_of(text, ["lan kham"]) | any_of(blob, ["mot lan kham"])
    day = any_of(text, ["ngay nam vien"]) | any_of(blob, ["mot ngay nam vien"])
    year = any_of(text, ["/ nam", "trong nam hop dong"]) | any_of(blob, ["trong nam hop dong"])
    fields = {
        "copay_flag": copay.isNotNull() | shares | any_of(blob, ["dong chi tra"]),
        "copay_percent": copay,
        "screening_flag": any_of(text, ["tam soat"]) | any_of(blob, ["tam soat"]),
        "missing_documents_flag": any_of(text, ["chung tu"]) | any_of(blob, ["chung tu", "ho so khong day du"]),
        "not_covered_flag": any_of(text, ["khong thuoc pham vi bao hiem", "khong thuoc quyen loi", "diem loai tru"]) | any_of(blob, ["khong thuoc quyen loi", "diem loai tru"]),
        "exclusion_scope_flag": any_of(text, ["loai tru"]),
        "limit_per_visit_flag": visit, "limit_per_day_flag": day, "limit_per_year_flag": year,
        "generic_limit_flag": any_of(blob, ["han muc"]),
        "limit_per_visit_vnd": F.when(visit, limit("lan kham")), "limit_per_day_vnd": F.when(day, limit("ngay")), "limit_per_year_vnd": F.when(year, limit("nam")),
        "clause_references": clause_refs(collapse(note)), "service_mentions": service_mentions(collapse(note)),
        "formula": F.when(requested.isNotNull() & percent.isNotNull() & paid.isNotNull(), F.struct(requested.alias("formula_requested_vnd"), percent.alias("formula_pay_percent"), paid.alias("formula_paid_vnd"))),
    }
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def phrases(c: Column, fillers: Sequence[str] = (), low: int = 2, high: int = 5) -> Column:
    """TX19: distinct word n-grams of each part of the text (parts at punctuation), the longest first, with the parts'
    own words if they are single."""
    parts = F.filter(F.transform(F.split(c, r"[,;.\n]+"), norm_key), lambda p: p != "")
    drop = F.array(*[F.lit(f) for f in fillers]).cast("array<string>")
    words = lambda p: F.filter(F.split(p, " "), lambda w: ~F.array_contains(drop, w))
    grams = lambda w, n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))
    each = lambda p: F.concat(*[grams(words(p), n) for n in range(high, low - 1, -1)], F.when(F.size(words(p)) == 1, words(p)).otherwise(F.array().cast("array<string>")))
    out = F.array_distinct(F.flatten(F.transform(parts, each)))
    return F.flatten(F.array(*[F.filter(out, _of_size(k)) for k in range(high, 0, -1)]))


def _split_at(pattern: str):
    return lambda x: F.transform(F.split(x, pattern), lambda y: F.trim(y))


def decompose_signs(
    c: Column, drop: Sequence[str] = (), fillers: Sequence[str] = (), splits: Sequence[str] = (), stop: Sequence[str] = (), low: int = 2, high: int = 5, most: int = 24
) -> Column:
    """TX19: the pieces of a free text that may name a sign: the folded text, its parts (at the patterns ``splits``) and
    their n-grams of ``low`` to ``high`` words without stop words, each once; most words first, then the longest, then
    by text, ``most`` at most (the operator's limit). ``drop`` are patterns over the text as it is, ``fillers`` phrases of
    the folded text; both go first. Pieces of fewer than ``low`` words don't count, unless they are the whole text. A null
    or empty text has none."""
    cleaned = norm_key(apply_rules(repair_text(c), [("(?iU)" + p, " ") for p in drop]))
    for f in fillers:
        cleaned = F.regexp_replace(cleaned, rf"(?<!\w){re.escape(f)}(?!\w)", " ")
    cleaned = collapse(cleaned)
    none = F.array().cast("array<string>")
    parts = F.array(cleaned)
    for p in splits:
        parts = F.filter(F.flatten(F.transform(parts, _split_at("(?i)" + p))), lambda x: x != "")
    words = lambda x: F.filter(F.split(x, " "), lambda w: ~F.array_contains(F.array(*[F.lit(t) for t in stop]).cast("array<string>"), w))
    grams = lambda w, n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(none)
    pieces = F.flatten(F.transform(parts, lambda x: F.concat(F.array(x), *[grams(words(x), n) for n in range(low, high + 1)])))
    size = lambda x: F.size(F.split(x, " "))
    all_ = F.filter(F.array_distinct(F.concat(F.array(cleaned), pieces)), lambda x: (x != "") & ((size(x) >= low) | (x == cleaned)))
    ordered = F.array_sort(F.transform(all_, lambda x: F.struct((-size(x)).alias("w"), (-F.length(x)).alias("n"), x.alias("x"))))
    return F.coalesce(F.transform(F.slice(ordered, 1, most), lambda s: s["x"]), none)


def _of_size(k: int):
    return lambda g: F.size(F.split(g, " ")) == k


# Section types and the phrases that name them, spellings of bad scans among them.
SECTIONS = (
    ("trieu_chung", "triệu chứng|lâm sàng|biểu hiện|dấu hiệu|tri[~e]u ch[uứ]ng|l[aâ]m s[aà]ng"),
    ("chan_doan", "chẩn đoán|phân biệt|tiêu chuẩn|ch[~a]n [dđ]o[aá]n|ph[aâ]n bi[~e]t"),
    ("dieu_tri", r"điều trị|phác đồ|thuốc|phẫu thuật|kháng sinh|[dđ]i[~ề]u tr[iị\]]|thu[~ố][cb]|khang vi rut|chi [dđ]inh"),
    ("xet_nghiem", "xét nghiệm|cận lâm sàng|hình ảnh|nội soi|x[eé]t nghi[~e]m|c[~a]n l[aâ]m|sang loc|theo d[oõ]i"),
    ("dai_cuong", "đại cương|định nghĩa|nguyên nhân|dịch tễ|[dđ][~a]i c[uư][oơ]ng|d~icuong"),
    ("tien_luong", "tiên lượng|biến chứng|theo dõi|bi[~ế]n ch[uứ]ng|ti[eê]n l[uư][oơ]ng"),
    ("phong_benh", "phòng bệnh|dự phòng|phòng ngừa|ph[oò]ng b[~e]nh|phong ng[uừ]a"),
)


def section_type(title: Column, preview: Column) -> Column:
    """TX20: the type of a section from its heading and the first 200 characters of its text, else "other"; nulls count as
    empty."""
    head = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(preview, F.lit("")), 1, 200))
    return first_match(F.lower(head), SECTIONS, "other")


def lab_flags(flag: Column, polarity: Column, abnormality: Column) -> Column:
    """TX21: struct<is_positive, is_negative, is_normal, is_abnormal, is_narrative>."""
    f, p, a = (F.coalesce(F.lower(F.trim(x)), F.lit("")) for x in (flag, polarity, abnormality))
    return F.struct(
        ((f == "positive") | (p == "positive")).alias("is_positive"), ((f == "negative") | (p == "negative")).alias("is_negative"),
        ((f == "normal") | (a == "within_range")).alias("is_normal"),
        (f.isin("abnormal", "abnormal_high", "abnormal_low") | a.isin("high", "low", "out_of_range")).alias("is_abnormal"),
        (f == "narrative").alias("is_narrative"),
    )


# Phrases of each kind of risk, folded.
RISKS = (
    ("screening", "tam soat|kiem tra|screening"),
    ("not_covered", "khong thuoc quyen loi|khong bao hiem|khong thuoc pham vi"),
    ("copay", "dong chi tra|copay"),
    ("limit", "vuot qua|han muc|gioi han|mot lan kham|mot ngay"),
    ("documents", "chung tu|ho so|giay"),
    ("waiting_period", "thoi gian cho|cho 365|benh co san|benh dac biet"),
    ("late_submission", "nop muon|qua han"),
)


def risk_kinds(c: Column, risks: Sequence[tuple[str, str]] = RISKS) -> Column:
    """TX22: every kind of risk that a reason names, else [other]."""
    folded = ascii_fold(collapse(c))
    found = F.filter(F.array(*[F.when(folded.rlike(p), F.lit(n)) for n, p in risks]), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit("other"))).otherwise(found)


def decision_label(requested: Column, paid: Column) -> Column:
    """TX23: full_pay, full_deny or partial_pay from the amounts."""
    return F.when(requested - paid <= 0, "full_pay").when(paid <= 0, "full_deny").otherwise("partial_pay")


def category_covered(category: Column, patterns: Column) -> Column:
    """TX24: whether a category is among the patterns (array); LAB-* covers every LAB category."""
    return F.exists(patterns, lambda p: F.when(p.endswith("*"), F.startswith(category, F.rtrim(p, F.lit("*")))).otherwise(category == p))


def graded_match(query: Column, *columns: Column) -> Column:
    """TX25: 1.0 equal, 0.96 prefix, 0.90 contained, else 0; the best over the columns."""
    q = norm_key(query)
    grade = lambda c: F.when(norm_key(c) == q, 1.0).when(F.startswith(norm_key(c), q), 0.96).when(F.contains(norm_key(c), q), 0.90).otherwise(0.0)
    graded = [F.coalesce(grade(c), F.lit(0.0)) for c in columns]
    return F.when(q == "", F.lit(0.0)).otherwise(F.greatest(*graded) if len(graded) > 1 else graded[0])


# Parts of insurers' names and their short codes, in order.
INSURERS = (
    ("petrolimex", "PJICO"), ("pjico", "PJICO"), ("techcom", "TCGIns"), ("liên hiệp", "UIC"), ("uic", "UIC"), ("bảo hiểm hùng", "BHV"),
    ("dbv", "DBV"), ("tokio", "TM"), ("kỷ nguyên", "KN"),
)


def norm_insurer(c: Column, names: Sequence[tuple[str, str]] = INSURERS) -> Column:
    """TX26: the short code of the first part that the insurer's lower-cased name contains, else its first 20 characters."""
    out = F.substring(c, 1, 20)
    for part, code in reversed(names):
        out = F.when(F.contains(F.lower(c), F.lit(part)), F.lit(code)).otherwise(out)
    return out


def norm_plan(c: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """TX26: struct<contract_id, plan_name> by the first rule (pattern over the lower-cased name, contract, plan), else
    null. More special patterns come first."""
    out = F.lit(None).cast("struct<contract_id:string,plan_name:string>")
    for pattern, contract, plan in reversed(rules):
        out = F.when(F.lower(c).rlike("(?U)" + pattern), F.struct(F.lit(contract).alias("contract_id"), F.lit(plan).alias("plan_name"))).otherwise(out)
    return out


def canonical_contract_key(c: Column) -> Column:
    """TX26: a contract's name as a key: folded, letters and digits only."""
    return skeleton(c)


def contract_key(*parts: Column) -> Column:
    """TX26: a key of insurer, product and plan."""
    return F.concat_ws("|", *[F.coalesce(norm_key(p), F.lit("")) for p in parts])


def stable_id(prefix: str, *parts: Column, size: int = 16) -> Column:
    """TX27: prefix and the first hex digits of a SHA-256 of the parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, size))


#: A letter that may not be in its composed form.
UNCOMPOSED = r"[^\u0000-\u02FF\u1E00-\u1EFF\u2002-\u2125]"


def nfc(c: Column) -> Column:
    """Composed characters (NFC), for which Spark has no function: only texts that may need it go to Python, in Arrow
    batches."""
    compose = F.pandas_udf(lambda s: s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore"), "string")
    return F.coalesce(compose(F.when(c.rlike(UNCOMPOSED), c)), c)


# Fixed value: small letters between which a line break is one of a wrapped line.
WRAPPED = "a-zàáảãạăắằẳẵặâấầẩẫậđèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵ"


def clean_ocr(c: Column) -> Column:
    """TX28: composed characters, control characters out, wrapped lines joined, spaces and blank lines collapsed."""
    rules = ((r"[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f]", ""), (rf"([{WRAPPED},;])\n([{WRAPPED}])", "$1 $2"), (rf"[{BLANKS}]+", " "), (r"\n{3,}", "\n\n"))
    return strip(apply_rules(nfc(c), rules))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"^[\n{BLANKS}]+|[\n{BLANKS}]+\z", "")


def snippet(text: Column, query: Column, size: int = 400) -> Column:
    """TX29: so many characters of the text, a third of them before the first of the query's words that the text holds, or
    its beginning."""
    words = F.regexp_extract_all(F.lower(query), F.lit("[a-zà-ỹ0-9_]+"), F.lit(0))
    at = F.coalesce(F.get(F.filter(F.transform(words, lambda w: F.position(w, F.lower(text))), lambda i: i > 0), F.lit(0)), F.lit(1))
    return strip(F.substring(text, F.greatest(at - size // 3, F.lit(1)), F.lit(size)))
