from collections import Counter

from helpers import SCHEMA, WORD, clashing, frame, words

from claimspark.llm import quality


def base(text):
    text = text or ""
    w = words(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


def test_base_counts(spark):
    out = quality.score(frame(spark)).collect()
    for r in out:
        want = base(r["text"])
        assert [r[c] for c in quality.BASE] == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_symbols_fail_and_prose_stays(spark):
    kept = {r["doc_id"]: r["kept"] for r in quality.score(frame(spark)).collect()}
    assert not kept[15] and not kept[10] and not kept[13]
    assert all(kept[100 + i] for i in range(40))


def test_sketches_merge_to_the_same_quantiles(spark):
    """The quartile of a sketch is within the relative error of the exact one, whatever the partitions."""
    from pyspark.sql import functions as F

    docs = spark.range(1, 1001).select(*[F.col("id").cast("double").alias(m) for m in quality.SPREAD], F.lit("en").alias("lang"), F.lit("s").alias("source"))
    a, b = (quality.fences(quality.sketch(docs.repartition(n)), "lang", "source").first() for n in (1, 9))
    assert a == b
    spread = 750 - 250
    assert abs(a["max_mean_word"] - (750 + quality.REACH * spread)) < 0.05 * a["max_mean_word"]


def test_thresholds_are_weighted_means_of_fences(spark):
    scored = quality.measured(frame(spark))
    own = quality.sketch(scored)
    of = lambda df, *keys: {tuple(r[k] for k in keys): r for r in df.collect()}
    a, b, c = of(quality.fences(own, "lang", "source"), "lang", "source"), of(quality.fences(quality.merged(own, "lang"), "lang"), "lang"), quality.fences(quality.merged(own)).first()
    for r in quality.thresholds(scored, prior_docs=7).collect():
        x, y = a[r.t_lang, r.t_source], b[r.t_lang,]
        for m in quality.SPREAD:
            lang = (y.docs * y[f"max_{m}"] + 7 * c[f"max_{m}"]) / (y.docs + 7)
            assert abs(r[f"max_{m}"] - (x.docs * x[f"max_{m}"] + 7 * lang) / (x.docs + 7)) < 1e-9


def test_keep_good(spark):
    docs = clashing(frame(spark))
    out = quality.keep_good(docs)
    assert out.columns == docs.columns
    good = quality.score(frame(spark)).filter("kept").count()
    assert out.count() == good > 0
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.score(empty).count() == 0 and quality.keep_good(empty).count() == 0
