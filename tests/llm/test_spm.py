import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from helpers import SCHEMA, clashing, frame, rows

from claimspark.llm import spm
from claimspark.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
ALPHABET = "abcdeth éàçñ  ß\n\t世界😀▁'.,0123<>|"


def texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_ids_are_the_librarys():
    m, sp = spm.Model(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for t in [*texts(1500), *(x[1] or "" for x in rows())]:
        assert m.encode(t) == sp.encode(t), t
        assert m.decode(m.encode(t)) == t.replace("▁", " ")


def test_batches_give_the_librarys_ids():
    m, sp = spm.Model(PATH, known=200), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for k in range(20):
        some = [*texts(60, k), "", " ", "\n", "a\n b", "a  b", "\n\nword.", "one, two.\nThree", "x\ue000y", "end ", "a \n"]
        ids, counts = m.encode_all(pa.array(some))
        want = sp.encode(some)
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]
        assert m.decode_all(ids, counts).to_pylist() == [t.replace("▁", " ") for t in some]


def test_decoding_is_the_librarys():
    m, sp, r = spm.Model(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(8)
    for _ in range(300):
        ids = [r.choice([0, 1, 2, r.randrange(259, 32000)]) for _ in range(r.randint(0, 8))]
        assert m.decode(ids) == sp.decode(ids), ids
        assert m.decode_all(np.array(ids, np.int64), np.array([len(ids)])).to_pylist() == [sp.decode(ids)]


def test_streaming_window_is_bounded():
    m, sp, window = spm.Model(PATH, known=0), sentencepiece.SentencePieceProcessor(model_file=PATH), []
    text = "abcthe" * 4000
    got = list(m._ids_of(m.pieces_of(iter(m.normalised(text)), window)))
    assert got == sp.encode(text)
    assert len(window) > 100 and max(window) <= 4 * m.longest


def test_viterbi_gives_the_best_score():
    """As a unigram model: the highest sum of scores, found by trying all segmentations."""
    m = spm.Model(PATH, unigram=True)

    def best(text, memo):
        if not text:
            return 0.0
        if text not in memo:
            memo[text] = max((m.scores[text[:k]] if text[:k] in m.scores else m.unknown_score) + best(text[k:], memo) for k in range(1, min(m.longest, len(text)) + 1) if k == 1 or text[:k] in m.scores)
        return memo[text]

    for t in [x for x in texts(300, 9) if x]:
        normal = m.normalised(t)
        got = list(m.pieces_of(normal))
        assert "".join(got) == normal
        assert sum(m.scores.get(p, m.unknown_score) for p in got) == pytest.approx(best(normal, {}))


def test_tables(spark):
    docs = clashing(frame(spark))
    out = spm.encoded(docs, PATH, ["doc_id", "number", "ids"])
    assert out.columns == ["doc_id", "number", "ids", "decoded_ok"]
    got = out.collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = sorted((str(i), sp.encode(t or "")) for i, t, *_ in rows())
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want and all(r["decoded_ok"] for r in got)
    back = {(r["doc_id"], r["text"]) for r in spm.decoded(out, PATH, ["doc_id"]).collect()}
    assert back == {(i, (t or "").replace("▁", " ")) for i, t, *_ in rows()}
    assert spm.encoded(spark.createDataFrame([], SCHEMA), PATH, ["doc_id"]).count() == 0
