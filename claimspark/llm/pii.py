"""Personal data: patterns for the direct identifiers, corpus co-occurrence for the terms that give them away.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers, found by pattern and checked. Protected
entities are the values found and what values have in common: the domain of an address, the /24 network of an IP address,
the issuer of a card (six digits), the prefix of a phone number (five). What a term in the same text gives away about an
entity is measured over the corpus: the pointwise mutual information of the two (from the numbers of documents with either
and with both) as a share of the entity's own information, -log2 of its probability. A share of 1 means that whoever reads
the term knows the entity. The share is discounted for thin evidence by (b / (b + 1))^2. Copies of a text are no evidence of
their own, so b is the effective number of contexts: the texts with both are counted by the words to either side of the
entity, and b is the square of the sum of these counts over the sum of their squares. That is the number of texts where all
contexts differ and near 1 in a group of near copies, however many. Three contexts that tell nearly all
reach DISCLOSURE; two, which rare words share by chance, never do. Terms at or above it after that are spans of the kind
"term" in the texts that hold the entity; where at least half of the documents with a term hold the entity too, the term
gives it away alone, and is a span in every text. Sanitised texts have base spans generalised to their kind and such terms
removed.

Bounds keep pairs few and lose none: an entity must have so many contexts, and a term so many texts, that the discount alone
leaves DISCLOSURE, and a term is in as many documents of the corpus at least as among those with entities, which bounds
what it can tell before the corpus is counted.

Only DataFrame functions are used. Offsets are code points, the end exclusive.

The patterns are written so that matching takes time in proportion to the text: their runs don't give back characters,
and a run without a match is not tried again from its middle; what they match is the same.

Defined cases: a null text is empty and has no spans; repeated rows and equal texts have the same spans and count as often
as they occur but as one text; null ids are carried along; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, text_of

DISCLOSURE = 0.5
#: Characters to either side of a span in which its context is looked for.
BESIDE = 64
TERM = r"[\p{L}\p{N}]+"

#: So many digests of 32 bytes are broadcast at most, to find their texts.
BROADCAST_DIGESTS = 200_000
#: Spans of terms of so many texts at most are broadcast.
BROADCAST_TEXTS = 5_000

_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    value = lambda i: F.substring(back, i, 1).cast("int")
    values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(i % 2 == 0, doubled(value(i))).otherwise(value(i)))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x) % 10 == 0


def _spans(text: Column, kind: str, pattern: str, valid, value) -> Column:
    """The spans of a pattern: the pieces between matches and the matches, in turn, give the places. Places are summed up
    within slices of about the square root of the matches' number, so that the arrays that grow stay short."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    size = lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["m"]), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")

    def places(part: Column, begin: Column) -> Column:
        def step(s: Column, p: Column) -> Column:
            start, end = s["at"] + F.length(p["gap"]), s["at"] + size(p)
            one = F.array(F.struct(start.alias("start"), end.alias("end"), p["m"].alias("m")))
            return F.struct(end.alias("at"), F.when(p["m"].isNull(), s["out"]).otherwise(F.concat(s["out"], one)).alias("out"))

        return F.aggregate(part, F.struct(begin.alias("at"), none.alias("out")), step, lambda s: s["out"])

    def of_all(all_pairs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(all_pairs))).cast("int")
        parts = F.transform(F.sequence(F.lit(1), F.size(all_pairs), width), lambda i: F.slice(all_pairs, i, width))
        total = lambda part: F.aggregate(part, F.lit(0), lambda n, p: n + size(p))
        begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        begins = F.aggregate(parts, begun, lambda s, part: F.struct((s["at"] + total(part)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
        return F.flatten(F.zip_with(parts, begins, places))

    # One-element arrays make the pairs a lambda's variable, computed once.
    found = F.filter(F.get(F.transform(F.array(pairs), of_all), F.lit(0)), lambda x: valid(x["m"]))
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), value(x["m"]).alias("value")))


def base_spans(text: Column) -> Column:
    """The checked spans of all kinds, in the order of KINDS and then by place."""
    between = lambda low, high: lambda m: F.length(_digits(m)).between(low, high)
    parts_fit = lambda m: F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    none = F.array().cast(_SPANS)
    of_kind = [
        (F.contains(text, F.lit("@")), _spans(text, "email", EMAIL, lambda m: F.lit(True), F.lower)),
        (text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _spans(text, "ip", IP, parts_fit, lambda m: m)),
        (text.rlike(CARD), _spans(text, "card", CARD, lambda m: between(13, 19)(m) & luhn(_digits(m)), _digits)),
        (F.contains(text, F.lit("+")), _spans(text, "phone", PHONE, between(9, 15), _digits)),
    ]
    return F.concat(*[F.when(may, spans.cast(_SPANS)).otherwise(none) for may, spans in of_kind])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def found(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, spans, digest, text): a struct of columns of docs, the base spans, the text's digest and, where it has spans, the
    text. A written table."""
    rows = docs.select(F.struct(*keep).alias("keep"), text_of().alias("whole")).withColumn("spans", base_spans(F.col("whole")))
    return cut(rows.select("keep", "spans", digest_of(F.col("whole")).alias("digest"), F.when(F.size("spans") > 0, F.col("whole")).alias("text")), "pii-found")


def entities_of(text: Column, spans: Column) -> Column:
    """The protected entities of an array of spans, the values and what values have in common, each with its context: the
    terms to either side, within BESIDE characters."""
    value = lambda s: s["value"]
    shared = lambda s: (
        F.when(s["kind"] == "email", F.concat(F.lit("domain:"), F.substring_index(value(s), "@", -1)))
        .when(s["kind"] == "ip", F.concat(F.lit("network:"), F.substring_index(value(s), ".", 3)))
        .when(s["kind"] == "card", F.concat(F.lit("issuer:"), F.substring(value(s), 1, 6)))
        .otherwise(F.concat(F.lit("prefix:"), F.substring(value(s), 1, 5)))
    )
    begin = lambda s: F.greatest(s["start"] - BESIDE, F.lit(0))
    before = lambda s: F.regexp_extract(F.substring(text, begin(s) + 1, s["start"] - begin(s)), rf"({TERM})[^\p{{L}}\p{{N}}]*$", 1)
    after = lambda s: F.regexp_extract(F.substring(text, s["end"] + 1, F.lit(BESIDE)), f"({TERM})", 1)
    context = lambda s: F.xxhash64(F.lower(F.concat_ws(" ", before(s), after(s)))).alias("context")
    both = lambda s: F.array(F.struct(F.concat_ws(":", s["kind"], s["value"]).alias("entity"), context(s)), F.struct(shared(s).alias("entity"), context(s)))
    return F.flatten(F.transform(spans, both))


def least_texts(disclosure: float) -> int:
    """The least number of contexts, and so of texts, with which the discount alone leaves the disclosure."""
    n = 1
    while (n / (n + 1)) ** 2 < disclosure:
        n += 1
    return n


def disclosing(docs: DataFrame, hits: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """(digest, term): for each text its terms that give away an entity. A written table. hits: of found()."""
    least = least_texts(disclosure)
    of_text = (F.any_value(F.struct("text", "spans")).alias("x"), F.count(F.lit(1)).alias("rows"))
    texts = hits.filter(F.col("text").isNotNull()).groupBy("digest").agg(*of_text).select("digest", "rows", "x.*")
    bare = F.col("text")
    for pattern in (EMAIL, IP, CARD, PHONE):
        bare = F.regexp_replace(bare, pattern, " ")
    # Texts go by a number of eight bytes here, their digests come back at the end.
    terms = texts.select("digest", F.xxhash64("digest").alias("key"), "rows", entities_of(F.col("text"), F.col("spans")).alias("entities"), terms_of(bare).alias("terms"), terms_of(F.col("text")).alias("whole"))
    texts = cut(terms, "pii-texts")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    # An entity's context in a text is that of its first place.
    places = texts.select("key", "rows", F.posexplode("entities").alias("at", "e")).groupBy("key", "e.entity").agg(F.any_value("rows").alias("rows"), F.min_by("e.context", "at").alias("context"))
    holds = cut(places, "pii-holds")
    entities = holds.groupBy("entity").agg(F.count_distinct("context").alias("texts"), F.sum("rows").alias("n_entity")).filter(F.col("texts") >= least)
    entities = cut(entities.join(F.broadcast(n), F.lit(True)).filter("n > n_entity"), "pii-protected")  # one row of n
    held = cut(holds.join(maybe_broadcast(entities.withColumnRenamed("texts", "e_texts")), "entity"), "pii-held")
    own = texts.join(held.select("key").distinct(), "key", "left_semi").select("key", F.explode("terms").alias("term"))
    # How many documents among those with entities have a term outside their spans.
    among = texts.select("rows", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("rows").alias("n_held"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= least)
    most = held.agg(F.max("n_entity").alias("most"), F.max("n").alias("n"))  # one row
    enough = F.log2(F.col("n") / F.greatest("n_held", F.lit(1))) >= disclosure * F.log2(F.col("n") / F.col("most"))
    among = cut(among.join(F.broadcast(most), F.lit(True)).filter(enough).select("term", "n_held", F.col("texts").alias("t_texts")), "pii-among")
    terms = cut(own.join(among, "term"), "pii-terms")
    # What a pair can reach at most: all documents of the rarer with the other, in as many different texts.
    b_most = F.least("e_texts", "t_texts")
    reach = F.log2(F.col("n") / F.greatest("n_entity", "n_held")) / F.log2(F.col("n") / F.col("n_entity")) * (b_most / (b_most + 1)) * (b_most / (b_most + 1))
    met = terms.join(held, "key").filter(reach >= disclosure).groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("k"), F.sum("rows").alias("n_both"), F.max("n_entity").alias("n_entity"), F.max("n").alias("n"))
    b_of = (F.sum("k") * F.sum("k") / F.sum(F.col("k") * F.col("k"))).alias("b")
    met = met.groupBy("entity", "term").agg(b_of, F.sum("n_both").alias("n_both"), F.max("n_entity").alias("n_entity"), F.max("n").alias("n"))
    b = F.col("b")
    share = lambda n_term: F.log2(F.col("n") * F.col("n_both") / (n_term * F.col("n_entity"))) / F.log2(F.col("n") / F.col("n_entity"))
    score = lambda n_term: share(n_term) * (b / (b + 1)) * (b / (b + 1))
    met = cut(met.join(among.select("term", "n_held"), "term").filter(score(F.col("n_held")) >= disclosure), "pii-met")
    wanted = maybe_broadcast(cut(met.select("term").distinct(), "pii-wanted"))
    # Counted before they are joined: the join's rows are terms, not their places, which grow with texts and terms alike. An
    # inner join, as Spark would put a semi-join back below the count.
    count = lambda df, name: df.groupBy("term").agg(F.sum("rows").alias(name)).join(wanted, "term")
    # Documents of the whole corpus with each term; those with entities count by what stands outside their spans.
    everywhere = cut(count(docs.select(F.explode(terms_of(text_of())).alias("term"), F.lit(1).cast("long").alias("rows")), "n_all"), "pii-everywhere")
    inside = count(texts.select("rows", F.explode("whole").alias("term")), "n_whole")
    told = met.join(everywhere, "term").join(inside, "term").withColumn("n_term", F.col("n_all") - F.col("n_whole") + F.col("n_held"))
    strong = told.filter(score(F.col("n_term")) >= disclosure).select("entity", "term", (2 * F.col("n_both") >= F.col("n_term")).alias("alone"))
    strong = cut(strong, "pii-disclosing")
    beside = held.select("key", "entity").join(maybe_broadcast(strong), "entity").select("key", "term").distinct().join(terms.select("key", "term"), ["key", "term"])
    beside = beside.join(texts.select("key", "digest"), "key").select("digest", "term")
    # At most twice as many documents as hold term and entity.
    alone = maybe_broadcast(cut(strong.filter("alone").select("term").distinct(), "pii-alone"))
    where = docs.select(digest_of(text_of()).alias("digest"), F.explode(terms_of(text_of())).alias("term")).join(alone, "term", "left_semi")
    return cut(beside.unionByName(where).distinct(), "pii-terms-of-texts")


def term_spans(docs: DataFrame, hits: DataFrame, told: DataFrame) -> DataFrame:
    """(digest, term_spans): where told(digest, term) stand in their texts, outside the base spans, by place."""
    by_text = cut(told.groupBy("digest").agg(F.collect_set("term").alias("told")), "pii-told")
    wanted = maybe_broadcast(by_text.select("digest"), BROADCAST_DIGESTS)
    spans = hits.select("digest", "spans").join(wanted, "digest", "left_semi").groupBy("digest").agg(F.any_value("spans").alias("spans"))
    texts = docs.select(digest_of(text_of()).alias("digest"), text_of().alias("text")).join(wanted, "digest", "left_semi").groupBy("digest").agg(F.any_value("text").alias("text"))
    texts = texts.join(spans, "digest").join(by_text, "digest")
    placed = _spans(F.col("text"), "term", TERM, lambda m: F.array_contains(F.col("told"), F.lower(m)), lambda m: m).cast(_SPANS)
    free = F.filter(placed, lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (s["end"] > t["start"])))
    return cut(texts.select("digest", free.alias("term_spans")).filter(F.size("term_spans") > 0), "pii-term-spans")


def scan(docs: DataFrame, keep: list[str], disclosure: float = DISCLOSURE) -> DataFrame:
    """keep (columns of docs) with spans (the base ones) and term_spans, for every row. Columns that bear these names
    are left out of keep."""
    names = [c for c in keep if c not in ("spans", "term_spans")]
    hits = found(docs, names)
    added = maybe_broadcast(term_spans(docs, hits, disclosing(docs, hits, disclosure)), BROADCAST_TEXTS)
    none = F.array().cast(_SPANS)
    return hits.select("keep", "spans", "digest").join(added, "digest", "left").select("keep.*", "spans", F.coalesce("term_spans", none).alias("term_spans"))


def sanitised(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """docs with base spans generalised to their kind ([EMAIL], [IP], ...) and disclosing terms removed. Where base
    spans of two kinds overlap, both go and the first one's kind stands for them."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    wide = scan(docs.select("text", own), ["__row"], disclosure)
    ordered = F.sort_array(F.transform(F.concat("spans", "term_spans"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = text_of(F.col("__row.text"))
    sign = lambda s: F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        out = F.concat(a["out"], gap, F.when(s["start"] >= a["at"], sign(s)).otherwise(F.lit("")))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    whole = F.aggregate("__ordered", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    new = F.when(F.size("__ordered") == 0, F.col("__row.text")).otherwise(whole)
    return wide.withColumn("__ordered", ordered).select(*[new.alias("text") if c == "text" else F.col(f"__row.`{c}`") for c in docs.columns])
