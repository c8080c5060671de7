"""Mixing sources to target weights.

Words are counted per source, each source gets a repetition rate (its target divided by its size), and every document
is emitted floor(rate) times plus once more when a number drawn from a hash of its id falls below the fraction of the
rate. The numbers of a source may be turned round the unit interval by one of DRAWS equal steps, which changes nobody's
chance; of these draws a source takes the one whose words come nearest its target (the first of equally near ones). So
small sources, in which one draw can be far off, land near their targets too, as near as their documents allow.

Defined cases: a null text has no words; a null source is a source of its own; a source without words has rate 0, so
its documents are not emitted; rows with the same id fare alike; an empty table gives an empty mix. Columns of the
input that bear the name of a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, maybe_broadcast, text_of

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source, and so no document, is taken more than this many times.
MOST_COPIES = 3
SEED = 42
#: Draws from which a source takes the best.
DRAWS = 64


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def unit_hash(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5 digest: the same wherever and whenever it is computed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def cyclic_weights(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sizes(source, source_size) with a weight: the given ones in turn over the sources by code point, null last."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    given = F.array(*[F.lit(float(w)) for w in weights])
    return sizes.withColumn("weight", F.element_at(given, (turn % len(weights) + 1).cast("int")))


def share_out(weighted: DataFrame, most_copies: float = MOST_COPIES) -> DataFrame:
    """weighted(source, source_size, weight) with the target and the rate of each source.

    The targets share the sum of all sizes by weight; a target stops at most_copies times its source's size and what
    it leaves goes to the others by weight. Sources are ordered by the level (words per weight) at which they fill up;
    the level at which the rest share what the full ones leave is then a running sum, with no rounds.
    """
    fills = F.col("source_size") * F.lit(float(most_copies))
    filled = weighted.withColumn("__fills", fills).withColumn("__at", fills / F.col("weight"))
    order = Window.orderBy("__at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("__fills").over(before), F.lit(0.0))
    levels = filled.withColumn("__level", left / F.sum("weight").over(onward))
    open_level = F.max(F.when(F.col("__level") <= F.col("__at"), F.col("__level"))).over(everything)
    target = F.least(F.col("__fills"), F.coalesce(open_level * F.col("weight"), F.col("__fills")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return levels.withColumn("target", target).withColumn("rate", rate).drop("__fills", "__at", "__level")


def best_draws(rates: DataFrame, counted: DataFrame) -> DataFrame:
    """rates with turn, the chosen draw. counted(__own, size, __u): source, words and number of every document.

    In steps of 1 / DRAWS, a number u is a step b and a rest, and the fraction of the rate is a step and a rest too, so
    whether a turned number lies below the fraction depends on the step and, for one step, on the rests: the words by
    source and step tell those of all draws."""
    fraction = F.col("rate") - F.floor("rate")
    scaled = F.col("__u") * DRAWS
    step, above = F.floor(scaled).cast("int"), F.floor(F.lit(DRAWS) * fraction).cast("int")
    small = F.when(scaled - F.floor(scaled) < F.lit(DRAWS) * fraction - F.floor(F.lit(DRAWS) * fraction), F.col("size")).otherwise(F.lit(0))
    near = counted.join(maybe_broadcast(rates.select(F.col("source").alias("__source"), "rate")), F.col("__own").eqNullSafe(F.col("__source")))
    steps = near.groupBy("__source", step.alias("step")).agg(F.sum("size").alias("n"), F.sum(small).alias("part"))
    sums = steps.groupBy("__source").agg(F.collect_list(F.struct("step", "n", "part")).alias("steps"))
    turned = lambda s, k: (s["step"] + k) % DRAWS
    words = lambda k: F.aggregate("steps", F.lit(0).cast("long"), lambda n, s: n + F.when(turned(s, k) < F.col("above"), s["n"]).when(turned(s, k) == F.col("above"), s["part"]).otherwise(0))
    off = lambda k: F.abs(F.floor("rate") * F.col("source_size") + words(k) - F.col("target"))
    best = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), lambda k: F.struct(off(k).alias("off"), k.alias("turn"))))["turn"]
    joined = rates.join(sums, F.col("source").eqNullSafe(F.col("__source")), "left").withColumn("above", above)
    return joined.withColumn("turn", F.coalesce(best, F.lit(0))).drop("steps", "above", "__source")


def _planned(counted: DataFrame, weights: tuple[float, ...], most_copies: float) -> DataFrame:
    """(__source, source_size, target, rate, turn) for every source of counted(__own, size, __u), a written table."""
    sizes = counted.groupBy(F.col("__own").alias("source")).agg(F.sum("size").alias("source_size"))
    rates = cut(share_out(cyclic_weights(sizes, weights), most_copies), "mix-rates")
    return cut(best_draws(rates, counted), "mix-draws").select(F.col("source").alias("__source"), "source_size", "target", "rate", "turn")


def _copies() -> Column:
    whole = F.floor("rate")
    turned = (F.col("__u") + F.col("turn") / F.lit(float(DRAWS))) % 1.0
    return (whole + (turned < F.col("rate") - whole).cast("int")).cast("int")


def _counted(docs: DataFrame, seed: int, *keep: str | Column) -> DataFrame:
    return docs.select(*keep, F.col("source").alias("__own"), word_count(text_of()).alias("size"), unit_hash(F.col("doc_id"), seed).alias("__u"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    return rows.join(maybe_broadcast(plan), F.col("__own").eqNullSafe(F.col("__source")), "left").withColumn("copies", _copies())


def with_copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_copies: float = MOST_COPIES, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """docs with size, source_size, target, rate and copies (how often the mix emits the row).

    keep: the columns of docs to return (all by default); they are written once with the sizes, so that the text is
    only read for its words, once.
    """
    made = ("size", "source_size", "target", "rate", "copies")
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    if keep is None:
        rows, counted = _counted(docs, seed, *[F.col(f"`{c}`") for c in names]), cut(_counted(docs, seed), "mix-sizes")
    else:
        rows = counted = cut(_counted(docs, seed, *names), "mix-sizes")
    return _with_plan(rows, _planned(counted, weights, most_copies)).select(*[F.col(f"`{c}`") for c in names], *made)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_copies: float = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of docs, each as many times as it is taken, with their own columns."""
    plan = _planned(cut(_counted(docs, seed), "mix-sizes"), weights, most_copies)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select(own, F.col("source").alias("__own"), unit_hash(F.col("doc_id"), seed).alias("__u"))
    return _with_plan(rows, plan).filter("copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")
