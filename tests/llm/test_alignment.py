import hashlib
import random
from collections import Counter

import pyarrow as pa
import sentencepiece
from helpers import SCHEMA, clashing, frame, rows
from tokenizers import Tokenizer

from claimspark.llm import alignment
from claimspark.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def libraries():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    level = {chr(x): x for x in plain} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in plain)}
    return a, b, lambda i: bytes(level[c] for c in a.id_to_token(i)), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()


def brute(texts):
    """Token pairs compared one by one."""
    a, b, a_bytes, b_bytes = libraries()
    docs = []
    for t in texts:
        want = f" {t}".encode()
        ids_a, ids_b = (a.encode(f" {t}", add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        if b"".join(map(a_bytes, ids_a)) != want or b"".join(map(b_bytes, ids_b)) != want:
            ids_a = ids_b = []
        ranges = []
        for ids, of in ((ids_a, a_bytes), (ids_b, b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(of(i)), i))
                at = out[-1][1]
            ranges.append(out)
        links = [(x[2], y[2]) for x in ranges[0] for y in ranges[1] if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in ranges[0]} & {y[1] for y in ranges[1]})
        groups, low = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(x[2]) for x in r if low < x[1] <= e) for r in ranges))
            low = e
        docs.append((len(ids_a), len(ids_b), groups, links))
    count = Counter(x for *_, links in docs for x in links)
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    out = []
    for n_a, n_b, groups, links in docs:
        spelt = ";".join(groups)
        out.append((n_a, n_b, len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), spelt))
    return out


def odd_texts():
    r = random.Random(6)
    parts = ["a", "b", "The", "é", " ", "  ", "\n", "\t", ".", ",", "'s", "1", "23", "世", "😀", " ", "▁", "<|endoftext|>", "<s>", "<0x0A>", "!", "?", "-", "\r\n", "word", "re"]
    return [None, "", " ", "\n", "x", " x", "\nx", "▁", *("".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(250)), *[t and t[:3000] for _, t, *_ in rows()]]


def test_batches(spark):
    made = alignment.Aligner(A, B).align(pa.array([t or "" for t in odd_texts()], pa.string()))
    got = list(zip(*(c.to_pylist() for c in made[:5]), strict=True))
    assert got == [(*w[:4], w[6]) for w in brute(odd_texts())]


def test_scores(spark):
    """By broadcast counts and by a join."""
    docs = [(i, t, "en", "a", 0) for i, t in enumerate(odd_texts())] + [(None, "null id", "en", "a", 0), (5, "x", "en", "a", 0)]
    want = sorted((str(d[0]), *w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for d, w in zip(docs, brute([d[1] for d in docs]), strict=True))
    table = alignment.aligned(clashing(frame(spark, docs)), A, B, ["doc_id", "number", "groups"]).drop("number")
    held = alignment.written(table)
    keep = ["doc_id", *alignment.COUNTS, "groups"]
    for bound in (alignment.BROADCAST_PAIRS, 10):
        got = alignment.scored(held, A, B, keep, bound).collect()
        assert sorted((str(r["doc_id"]), *(r[c] for c in alignment.COUNTS), r["n_best"], r["count_sum"], hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in got) == want


def test_empty(spark):
    held = alignment.written(alignment.aligned(spark.createDataFrame([], SCHEMA), A, B, ["doc_id"]))
    assert alignment.scored(held, A, B, ["doc_id"]).count() == 0
