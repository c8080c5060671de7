"""Quality rules with adaptive thresholds, in DataFrame functions only.

Every document is measured; per language and source, each measure is gathered into a mergeable quantile sketch with a
bounded relative error (logarithmic bins and their counts, as in DDSketch: merging is adding the counts of equal bins,
so the result does not depend on the order of rows or tasks). The sketches give the quartiles, and the upper fence
Q3 + REACH * max(Q3 - Q1, the measure's least spread) is the group's threshold. Documents are joined with their group's
thresholds and fail where a measure lies beyond. Sketches merged over a language, and over all, give fences too: a
group's threshold is the mean of its own fence and its language's, weighted by the group's documents and by PRIOR_DOCS,
and a language's is likewise that of its own and the whole corpus's: the same formula for groups of every size.

Measures: the share of symbols per word, of repeated lines, of words in repeated three-word windows, and the mean
length of words.

Defined cases: a null text has no words and fails the base rules; null languages and sources are groups of their own;
repeated rows are measured alike and each counts; an empty table has no thresholds and no rows. Columns of the input
that bear the name of a measure are replaced by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, WORD, cut, maybe_broadcast, text_of

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: Relative error of a quantile.
ERROR = 0.01
#: Values up to this one share the lowest bin.
LEAST = 1e-4
REACH = 3.0
#: A language's fence counts as so many documents in the threshold of each of its sources, the corpus's in each language's.
PRIOR_DOCS = 40
#: Measures that have thresholds, and the least spread taken for each.
SPREAD = {"symbol_share": 0.05, "dup_line_share": 0.12, "repeat_share": 0.1, "mean_word": 1.0}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Column, window: int = 3) -> Column:
    """How many words lie in a window of so many words that the text has twice or more; words: an array column.

    The hashes of the windows are sorted with their positions; those equal to a neighbour are the repeated ones, and
    their positions in order tell how many words they cover.
    """
    starts = F.sequence(F.lit(0), F.size(words) - window)
    hashed = F.transform(starts, lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(window)]).alias("h"), i.alias("i")))

    def covered(ordered: Column) -> Column:
        is_like = lambda j, k: F.get(ordered, j)["h"].eqNullSafe(F.get(ordered, k)["h"])
        at = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda j: is_like(j, j - 1) | is_like(j, j + 1))
        places = F.sort_array(F.transform(at, lambda j: F.get(ordered, j)["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda s, i: F.struct((s["n"] + i + window - F.greatest(i, s["end"])).alias("n"), (i + window).alias("end"))
        return F.aggregate(places, start, step, lambda s: s["n"])

    # A one-element array makes the sorted windows a lambda's variable, computed once.
    once = F.transform(F.array(F.sort_array(hashed)), covered)
    return F.when(F.size(words) > window, F.get(once, F.lit(0))).otherwise(F.lit(0)).cast("long")


def measured(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs with the base counts and the measures; keep: the columns of docs to return (all by default)."""
    made = {*BASE, *SPREAD}
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    text = F.col("__text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
    out = docs.select(*names, text_of().alias("__text"))
    out = out.withColumn("__words", F.filter(F.split(text, SPACES, -1), lambda w: w != "")).withColumn("__lines", lines)
    out = out.select(
        *names,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACES, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").alias("__n_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return out.select(
        *names, *BASE,
        share("n_symbols", "n_words").alias("symbol_share"), share("n_dup_lines", "__n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("word_chars", "n_words").alias("mean_word"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def sketch(scored: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): the sketch of every measure for every language and source."""
    log_base = math.log((1 + ERROR) / (1 - ERROR))
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in SPREAD])
    rows = scored.select("lang", "source", F.explode(pairs).alias("m")).select("lang", "source", "m.measure", "m.value")
    bins = F.when(F.col("value") <= LEAST, F.lit(-(2**31))).otherwise(F.ceil(F.ln("value") / log_base)).cast("int")
    return rows.groupBy("lang", "source", "measure", bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches merged over all but the keys."""
    return sketches.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys, docs, a fence for each measure) from merged sketches."""
    group = Window.partitionBy(*keys, "measure")
    counted = sketches.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("all", F.sum("n").over(group))
    gamma = (1 + ERROR) / (1 - ERROR)
    value = F.when(F.col("bin") == -(2**31), F.lit(0.0)).otherwise(F.lit(2 / (gamma + 1)) * F.pow(F.lit(gamma), F.col("bin").cast("double")))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.struct("bin", value.alias("value"))))["value"]
    quartiles = counted.groupBy(*keys, "measure").agg(F.max("all").alias("docs"), quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.element_at(F.create_map(*[F.lit(x) for m in SPREAD.items() for x in m]), F.col("measure")))
    fence = quartiles.withColumn("fence", F.col("q3") + REACH * spread)
    return fence.groupBy(*keys).agg(F.max("docs").alias("docs"), *[F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"max_{m}") for m in SPREAD])


def thresholds(scored: DataFrame, prior_docs: int = PRIOR_DOCS) -> DataFrame:
    """(t_lang, t_source, max_<measure>...): one row per language and source that scored has, as a written table."""
    own = cut(sketch(scored), "quality-sketches")
    limits = [f"max_{m}" for m in SPREAD]
    named = lambda df, to: df.select(*[c for c in df.columns if c not in limits and c != "docs"], F.struct("docs", *limits).alias(to))
    by_source = named(fences(own, "lang", "source"), "a")
    by_lang = named(fences(merged(own, "lang"), "lang"), "b").withColumnRenamed("lang", "b_lang")
    overall = named(fences(merged(own)), "c")
    both = by_source.join(by_lang, F.col("lang").eqNullSafe(F.col("b_lang")), "left").join(F.broadcast(overall), F.lit(True), "left")  # one row
    mean = lambda x, m, above: (F.col(f"{x}.docs") * F.col(f"{x}.max_{m}") + F.lit(float(prior_docs)) * above) / (F.col(f"{x}.docs") + F.lit(float(prior_docs)))
    blended = [mean("a", m, mean("b", m, F.col(f"c.max_{m}"))).alias(f"max_{m}") for m in SPREAD]
    return cut(both.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *blended), "quality-thresholds")


def judged(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """scored with base_failed and kept."""
    within = F.lit(True)
    for m in SPREAD:
        within = within & (F.col(m) <= F.col(f"max_{m}"))
    same = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    joined = scored.join(maybe_broadcast(limits), same, "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False))).drop(*limits.columns)


def score(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The verdict for every document; measured once, into a table. keep: the columns of docs to carry along."""
    names = docs.columns if keep is None else keep
    carried = [c for c in dict.fromkeys([*names, "lang", "source"]) if c not in ("base_failed", "kept", "t_lang", "t_source")]
    scored = cut(measured(docs, carried), "quality-measures")
    return judged(scored, thresholds(scored))


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the documents that fail, with their own columns."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    wide = docs.select("text", "lang", "source", own)
    return score(wide, ["__row"]).filter("kept").select("__row.*")
