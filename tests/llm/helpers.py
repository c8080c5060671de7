"""Small documents with every odd case, and brute-force versions."""

import itertools
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over the lazy dog while seven wizards quietly judge my boxing vow " * 400


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 8))) for _ in range(n))


def rows():
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    out = [
        (5, base, "en", "a", 1), (3, base.replace(" ", "  \n", 1), "en", "a", 1), (9, " ".join(near), "en", "b", 1), (3, base.replace(" ", "  \n", 1), "en", "a", 1),
        (10, None, "en", "a", 0), (11, "", None, None, 0), (None, prose(2, 80), "de", "c", 1), (12, "   \t\n ", "de", "c", None), (13, LONG, "en", "d", 1),
        (14, "word", "en", "d", 1), (15, "*** ### " * 60, "en", "a", 1), (16, prose(3, 90) + "\nsame line here\nsame line here", "fr", "b", 1), (17, "é世😀 ß" * 30, "fr", "b", 1),
    ]
    return out + [(100 + i, prose(50 + i, 60 + i % 40), "en" if i % 2 else "fr", "abcd"[i % 4], 1) for i in range(40)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def clashing(df):
    """df with extra columns that bear names used inside the operators."""
    from pyspark.sql import functions as F

    names = "size target rate copies weight fp number row id first digest keep_id group_size kept spans part words start end line n_words symbol_share mean_word docs measure value bin n url payload ids".split()
    for n in names:
        df = df.withColumn(n, F.lit("x"))
    return df


def words(t):
    return WORD.findall(t or "")


def fingerprint(t):
    w = [x.encode() for x in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingles(t, n=5):
    """The set of a text's word shingles, A-Z lower-cased."""
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def groups(items, linked):
    """Connected components: item -> smallest index."""
    up = list(range(len(items)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(items)), 2):
        if linked(items[i], items[j]):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(items))]
