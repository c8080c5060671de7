"""The pipeline's stages on small odd documents, each against what it must keep."""

import pytest
import sentencepiece
from helpers import SCHEMA, frame, groups, rows, shingles

from claimspark.llm.common import cut
from claimspark.llm.queries import tokenizer_path
from test_exact import norm

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mix sources", "encode"]
    docs = frame(spark)
    good = cut(stages["quality rules"](spark, docs, ""), "t")
    assert tuple(good.columns) == corpus_pipeline.COLUMNS
    ids = [r.doc_id for r in good.collect()]
    assert {5, 3, 9, *range(100, 140)} <= set(ids) and not {10, 11, 12, 13, 14, 15} & set(ids)
    once = cut(stages["exact dedup"](spark, good, ""), "t")
    texts = {}
    for r in good.collect():
        texts.setdefault(norm(r.text), []).append(r.doc_id)
    assert sorted(str(r.doc_id) for r in once.collect()) == sorted(str(min(v, key=lambda x: (x is None, x or 0))) for v in texts.values())
    apart = cut(stages["near dedup"](spark, once, ""), "t")
    data = sorted(((r.doc_id, r.text) for r in once.collect()), key=lambda x: (x[0] is None, x[0] or 0))
    roots = groups([shingles(t) for _, t in data], lambda a, b: len(a & b) >= 0.8 * len(a | b))
    assert sorted(str(r.doc_id) for r in apart.collect()) == sorted(str(data[i][0]) for i in set(roots))
    mixed = cut(stages["mix sources"](spark, apart, ""), "t")
    assert tuple(mixed.columns) == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in apart.collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    out = stages["encode"](spark, mixed, "").collect()
    assert sorted((str(r.doc_id), r.ids) for r in out) == sorted((str(r.doc_id), sp.encode(r.text)) for r in mixed.collect())
    assert all(r.decoded_ok for r in out)


def test_run_and_empty(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 30
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, ""), "t")
    assert docs.count() == 0 and len(rows()) > 0


def test_near_dedup_uses_fingerprints(spark):
    """Texts that share most of their three-word shingles, repeats counted, but few different five-word shingles."""
    text = lambda tail: " ".join(["alpha beta gamma"] * 30 + [f"{tail}{i}" for i in range(10)])
    other = " ".join(f"word{i}" for i in range(100))
    docs = spark.createDataFrame([(7, text("x"), "en", "s", 1), (4, text("y"), "en", "s", 1), (9, text("z"), "en", "s", 1), (2, other, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars int")
    kept = dict(corpus_pipeline.STAGES)["near dedup"](spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [2, 4]
