import hashlib
import random
import re

import pytest
from helpers import SCHEMA, clashing, frame, prose

from claimspark.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=10):
    """Every window of every item sought at every place of every document."""
    out = []
    for doc_id, text, *_ in docs:
        w, hit, names = words(text), set(), set()
        for item, t in items:
            x = words(t)
            k = min(window, len(x))
            windows = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if x else set()
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    if item is not None:
                        names.add(str(item))
        out.append((doc_id, len(w), sorted(hit), sorted(names)))
    return out


def cases():
    r, items = random.Random(4), [(i, prose(i, 30)) for i in range(12)]
    items += [(20, "One two"), (21, "yes"), (22, None), (23, "  .,; "), (None, prose(99, 15)), (24, items[3][1].upper()), (25, "a b " * 15), (26, "a b a b"), (27, "É世 ß, x"), (2, prose(77, 12)), (28, items[5][1] + " tail " + items[6][1])]
    docs = [(0, None), (1, ""), (2, "... \n"), (3, items[0][1]), (3, items[0][1]), (None, "Yes, one TWO! three"), (4, "one-two " * 30), (5, "a b " * 40), (6, "a b a b a"), (7, "é世 ß\tX"), (8, prose(99, 15))]
    for n in range(40):
        bits = []
        for _ in range(r.randint(1, 5)):
            w = words(r.choice(items)[1])
            a = r.randint(0, max(0, len(w) - 1))
            bits += [prose(r.randint(200, 210), r.randint(0, 8)), " ".join(w[a : a + r.choice([3, 9, 10, 11, 25])])]
        docs.append((100 + n, r.choice([" ", ", ", "\n"]).join(bits)))
    return [(i, t, "en", "a", 0) for i, t in docs], items


def found(rows):
    return sorted(((r["doc_id"], r["n_words"], [i for s in r["spans"] for i in range(s["first_word"], s["end_word"])], r["items"]) for r in rows), key=str)


@pytest.mark.parametrize("shard_words", [250_000, 60])
def test_against_brute_force(spark, monkeypatch, shard_words):
    """With one automaton, and with many and long items in parts."""
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(decontaminate, "PART_WORDS", 20 if shard_words < 100 else 20_000)
    docs, items = cases()
    rows = decontaminate.matches(clashing(frame(spark, docs)), clashing(spark.createDataFrame(items, ITEMS)), ["doc_id", "number", "spans"]).collect()
    assert found(rows) == sorted(brute(docs, items), key=str)
    texts = dict((i, t) for i, t, *_ in docs)
    for r in rows:
        for s in r["spans"]:
            part = words((texts[r["doc_id"]] or "")[s["start"] : s["end"]])
            assert part == words(texts[r["doc_id"]])[s["first_word"] : s["end_word"]]


def test_longest_match_lengths():
    made = decontaminate.Automaton(3)
    lists = [list("abcabd"), list("bcd"), list("dabca")]
    for n, w in enumerate(lists):
        made.add(str(n), w, False)
    made.finish()
    r = random.Random(1)
    for _ in range(300):
        w = [r.choice("abcdx") for _ in range(r.randint(0, 12))]
        held = {tuple(x[i:j]) for x in lists for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        want = [max([k for k in range(1, i + 2) if tuple(w[i + 1 - k : i + 1]) in held], default=0) for i in range(len(w))]
        assert made.longest([made.vocabulary.get(x, -1) for x in w]) == want


def test_removal(spark):
    item = prose(1, 14)
    before, after = prose(2, 40), prose(3, 40)
    docs = [(1, f"{before} {item}, {after}", "en", "a", 0), (2, f"{item} few words", "en", "a", 0), (3, before, "en", "a", 0), (4, None, "en", "a", 0)]
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminated(clashing(frame(spark, docs)), spark.createDataFrame([(1, item)], ITEMS)).collect()}
    assert got == {1: f"{before} , {after}", 3: before, 4: None}
    left = decontaminate.decontaminated(frame(spark, docs), spark.createDataFrame([(1, item)], ITEMS), longest=14)
    assert {r["doc_id"]: r["text"] for r in left.collect()} == {1: docs[0][1], 3: before, 4: None}


def test_empty(spark):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEMS)
    assert decontaminate.matches(none, spark.createDataFrame([(1, "a b")], ITEMS), ["doc_id"]).count() == 0
    rows = decontaminate.matches(frame(spark), items, ["doc_id"]).collect()
    assert rows and not any(r["spans"] or r["items"] for r in rows)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
