import random

import pytest
from helpers import SCHEMA, clashing, frame, groups, rows, words

from claimspark.llm import nearcopies


def shingle_set(t):
    w = [x.lower() for x in words(t)]
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    return len(a & b) / len(a | b) >= 0.8


def edited(base, n, r):
    w = base.split()
    for at in r.sample(range(len(w)), n):
        w[at] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def data():
    """Families of edited copies, some close and some at the edge, around bases of 100 to 300 words."""
    r = random.Random(3)
    out = rows()
    for k in range(12):
        base = " ".join(f"w{r.randrange(5000)}" for _ in range(100 + 20 * k))
        out += [(1000 + 100 * k + i, edited(base, r.randint(0, 5), r), "en", "a", 1) for i in range(12)]
    return out


@pytest.mark.parametrize("block", [1000, 4])
def test_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(nearcopies.links, "__defaults__", (nearcopies.SIMILARITY, block))
    docs = clashing(frame(spark, data()))
    out = nearcopies.keep_representatives(docs)
    assert out.columns == docs.columns
    ordered = sorted(((i, t) for i, t, *_ in data()), key=lambda x: (x[0] is None, x[0] or 0))
    roots = groups([shingle_set(t) for _, t in ordered], alike)
    assert sorted(str(x.doc_id) for x in out.collect()) == sorted(str(ordered[i][0]) for i in set(roots))


def test_stage_drops_an_edited_copy(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = frame(spark)
    out = {x.doc_id for x in dict(corpus_pipeline.STAGES)["near dedup"](spark, docs, "").collect()}
    assert 3 in out and 5 not in out and 9 not in out  # 9 has one word changed out of 120
    assert nearcopies.keep_representatives(spark.createDataFrame([], SCHEMA)).count() == 0
