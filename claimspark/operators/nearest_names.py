"""Search of names in a codebook by the mapper's score: the k best codes of each name, none lost (ER1, ER2).

A pair's score is bounded before any ratio is taken: letters that two texts have in common bound every ratio of them,
shared trigrams and signals, categories, families and discriminators are known exactly. The bounds of a name with all entries
of a shard are a few numpy operations; entries are then scored from the highest bound down, until no bound left reaches the
k-th best code. That is exact whatever the names share: no key has to be equal, and a word that is in every name costs no
more than a rare one.

Names are dealt into groups of about GROUP_NAMES, entries into shards of about SHARD_ENTRIES; each group meets each shard
in one task of bounded size, and the k best of each are merged. With one shard, the usual case, every name is searched
once.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import partial_ratio, ratio, token_set_ratio, token_sort_ratio
from .match import CONFLICTS, FLOOR, OTHER, SIGNALS, WEIGHTS

GROUP_NAMES = 2_000
SHARD_ENTRIES = 20_000
#: Letters are counted in so many bins; letters that share one only loosen a bound.
BINS = 64
#: Scores are rounded to hundredths: pairs this close to the k-th best are kept for the final order.
CLOSE = 0.011


def _counts(texts: Sequence[str]) -> np.ndarray:
    """How often the letters of each bin stand in each text."""
    out = np.zeros((len(texts), BINS), np.int16)
    for i, t in enumerate(texts):
        if t:
            out[i] = np.bincount(np.fromiter(map(ord, t), np.int64, len(t)) * 7 % BINS, minlength=BINS)
    return out


def _trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)} if len(text) >= 3 else {text} if text else set()


class Shard:
    """Entries of the codebook, laid out for bounds."""

    FORMS = ("cleaned", "stripped", "skel")

    def __init__(self, entries: pd.DataFrame) -> None:
        self.entries = entries.reset_index(drop=True)
        n = self.n = len(entries)
        self.texts = {f: self.entries[f].tolist() for f in self.FORMS}
        self.bags = {f: _counts(t) for f, t in self.texts.items()}
        self.sizes = {f: np.fromiter(map(len, t), np.int64, n) for f, t in self.texts.items()}
        self.grams, self.words = defaultdict(list), defaultdict(list)
        self.n_grams = np.zeros(n, np.int64)
        for i, (skel, cleaned) in enumerate(zip(self.texts["skel"], self.texts["cleaned"], strict=True)):
            own = _trigrams(skel)
            self.n_grams[i] = len(own)
            for g in own:
                self.grams[g].append(i)
            for w in set(cleaned.split()):
                self.words[w].append(i)
        for index in (self.grams, self.words):
            for k, v in index.items():
                index[k] = np.array(v)
        self.signals, self.has = {g: defaultdict(list) for g in SIGNALS}, {}
        for g in SIGNALS:
            lists = self.entries[f"sig_{g}"].tolist()
            self.has[g] = np.array([len(x) > 0 for x in lists], bool)
            for i, terms in enumerate(lists):
                for t in terms:
                    self.signals[g][t].append(i)
        as_array = lambda c: np.array(self.entries[c].tolist(), object)
        self.category, self.family, self.disc = as_array("category"), as_array("family"), as_array("disc")
        self.has_family = np.array([x is not None for x in self.family], bool)
        self.often = np.where(self.entries["occurrences"] > 0, np.minimum(1.5 * np.log10(np.maximum(self.entries["occurrences"], 0) + 1), 2.5), 0.0)
        self.codes = self.entries["code"].tolist()

    def _shared(self, index: dict, keys: set[str]) -> np.ndarray:
        lists = [index[k] for k in keys if k in index]
        return np.bincount(np.concatenate(lists), minlength=self.n) if lists else np.zeros(self.n, np.int64)

    def known(self, q) -> tuple[np.ndarray, np.ndarray]:
        """What a name has with each entry without the ratios: weighted n-grams and signals; bonuses less penalties."""
        grams = _trigrams(q.skel)
        shared = self._shared(self.grams, grams)
        union = np.maximum(len(grams) + self.n_grams - shared, 1)
        ngram = np.where((self.n_grams == 0) & (not grams), 100.0, 100.0 * shared / union)
        total, score, clash = np.zeros(self.n), np.zeros(self.n), np.zeros(self.n)
        for g, weight in SIGNALS.items():
            terms = getattr(q, f"sig_{g}")
            mine, theirs, both = len(terms) > 0, self.has[g], np.zeros(self.n, bool)
            for t in terms:
                both[self.signals[g].get(t, [])] = True
            total += np.where(theirs | mine, weight, 0.0)
            score += np.where(both, weight, np.where(theirs != mine, weight * 0.35, 0.0))
            clash += np.where(theirs & mine & ~both, CONFLICTS[g], 0)
        signal = np.where(total == 0, 50.0, 100.0 * score / np.maximum(total, 1e-12))
        bonus = self.often - clash
        if q.disc:
            bonus = bonus + np.where(self.disc == q.disc, 6, 0)
        if q.category != OTHER:
            bonus = bonus + np.where(self.category == q.category, 3, np.where(self.category == OTHER, 0, -5))
        if q.family is not None:
            same = self.family == q.family
            bonus = bonus + np.where(same, 6, np.where(self.has_family & (q.family_status in ("exact", "probable")), -8, 0))
        return ngram * WEIGHTS["ngram"] + signal * WEIGHTS["signal"], bonus

    def bounds(self, q, plain: np.ndarray, bonus: np.ndarray) -> np.ndarray:
        """At least the score of a name with each entry."""
        most = {}
        for f in self.FORMS:
            text = getattr(q, f)
            common = np.minimum(self.bags[f], _counts([text])[0]).sum(axis=1, dtype=np.int64)
            most[f] = np.where(self.sizes[f] + len(text) > 0, 200.0 * common / np.maximum(self.sizes[f] + len(text), 1), 100.0)
            if f == "cleaned":
                short = np.minimum(self.sizes[f], len(text))
                partial = np.where(short == 0, most[f], 200.0 * common / np.maximum(short + common, 1))
        words = set(q.cleaned.split())
        token_set = np.where(self._shared(self.words, words) > 0, 100.0, most["cleaned"])
        base = plain + WEIGHTS["token_sort"] * most["cleaned"] + WEIGHTS["token_set"] * token_set + WEIGHTS["partial"] * np.minimum(partial, 100.0) + WEIGHTS["stripped"] * most["stripped"] + WEIGHTS["skeleton"] * most["skel"]
        # Equal texts count 99 at least; one core in the other 8 or 4 more, which takes letters in common.
        base = np.where(most["cleaned"] >= 100.0, np.maximum(base, 99.0), base)
        return base + bonus + np.where(most["stripped"] >= 100.0, 8, np.where(most["stripped"] > 0, 4, 0))

    def score(self, q, i: int, plain: float, bonus: float) -> float:
        cleaned, stripped, skel = (self.texts[f][i] for f in self.FORMS)
        base = plain + WEIGHTS["token_sort"] * token_sort_ratio(q.cleaned, cleaned) + WEIGHTS["token_set"] * token_set_ratio(q.cleaned, cleaned) + WEIGHTS["partial"] * partial_ratio(q.cleaned, cleaned)
        if q.stripped and stripped:
            base += WEIGHTS["stripped"] * ratio(q.stripped, stripped)
            bonus += 8 if q.stripped == stripped else 4 if q.stripped in stripped or stripped in q.stripped else 0
        if q.skel and skel:
            base += WEIGHTS["skeleton"] * ratio(q.skel, skel)
        return max(0.0, (max(base, 99.0) if q.cleaned == cleaned else base) + bonus)

    def search(self, q, k: int, barred: set[str], floor: float) -> list[int]:
        """The entries among which the k best codes of a name are, each by its best name, at floor or above."""
        plain, bonus = self.known(q)
        most = self.bounds(q, plain, bonus)
        order = np.argsort(-most, kind="stable")
        best: dict[str, float] = {}
        scored: list[tuple[float, int]] = []
        least = floor
        for i in order.tolist():
            if most[i] < least - CLOSE:
                break
            code = self.codes[i]
            if code in barred:
                continue
            s = self.score(q, i, plain[i], bonus[i])
            scored.append((s, i))
            if s > best.get(code, -1.0):
                best[code] = s
                if len(best) >= k:
                    least = max(floor, heapq.nlargest(k, best.values())[-1])
        return [i for s, i in scored if s >= least - CLOSE]


def _flat(features: DataFrame) -> DataFrame:
    """name_features() with plain columns only."""
    plain = ("name", "code", "category", "family", "family_status", "cleaned", "stripped", "skel")
    return features.select(*plain, F.col("occurrences").cast("double").alias("occurrences"), F.array_join("disc", "\x1f").alias("disc"), *[F.col(f"sig.{g}").alias(f"sig_{g}") for g in SIGNALS])


def nearest_pairs(left: DataFrame, right: DataFrame, k: int, blacklist: DataFrame | None = None, floor: float = FLOOR) -> DataFrame:
    """(l_name, r_name): for each name of left the entries of right that can be among its k best codes at floor or above.
    left, right: of name_features(), names of left once each; blacklist(cleaned, code): pairs that don't count."""
    shards = max(1, -(-right.count() // SHARD_ENTRIES))
    groups = max(1, -(-left.count() // GROUP_NAMES))
    lefts = _flat(left)
    if blacklist is None:
        lefts = lefts.withColumn("barred", F.array().cast("array<string>"))
    else:
        codes = blacklist.groupBy("cleaned").agg(F.collect_set(F.col("code").cast("string")).alias("barred"))
        lefts = lefts.join(codes, "cleaned", "left").withColumn("barred", F.coalesce("barred", F.array().cast("array<string>")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lefts = lefts.withColumn("g", F.pmod(F.xxhash64("name"), F.lit(groups)).cast("int")).withColumn("s", every(shards))
    rights = _flat(right).withColumn("code", F.col("code").cast("string")).withColumn("s", F.pmod(F.xxhash64("name", "code"), F.lit(shards)).cast("int")).withColumn("g", every(groups))

    def work(names: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[str, str]] = []
        if len(names) and len(entries):
            clean = lambda df: df.assign(family=[None if x is None or x != x else x for x in df["family"]])
            shard = Shard(clean(entries))
            known = shard.entries["name"].tolist()
            for q in clean(names).itertuples(index=False):
                out += [(q.name, known[i]) for i in shard.search(q, k, set(q.barred), floor)]
        return pd.DataFrame(out, columns=["l_name", "r_name"])

    met = lefts.groupBy("g", "s").cogroup(rights.groupBy("g", "s")).applyInPandas(work, "l_name string, r_name string")
    return met.distinct()
