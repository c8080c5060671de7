import random

from helpers import LONG, SCHEMA, clashing, frame, prose

from claimspark.llm import licenses as L


def lcs(a, b):
    """Length of a longest common subsequence, by the full table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_bit_rows_give_a_longest_common_subsequence():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 80))] for _ in range(2))
        pairs = L._plain(a, b)
        assert len(pairs) == lcs(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_coverage_of_edited_templates_is_that_of_all_alignments(spark):
    """Words are dropped, changed and put in; the words around are none of the template's, so the best alignment of the
    whole text has the coverage."""
    r, data, want = random.Random(7), [], {}
    for k, name in enumerate(["MIT", "ISC", "BSD-3-Clause", "Zlib", "GPL-2.0-notice", "MPL-2.0-notice"] * 3):
        words = [w for w, _, _ in L.words_of(L.TEMPLATES[name])]
        some = [w if r.random() > 0.05 else f"zz{r.randrange(99)}" for w in words if r.random() > 0.06]
        for _ in range(4):
            some.insert(r.randrange(len(some)), f"qq{r.randrange(99)}")
        text = " ".join([*(f"xx{i}" for i in range(30)), *some, *(f"yy{i}" for i in range(30))])
        covered = lcs([w for w, _, _ in L.words_of(text)], words) / len(words)
        data.append((k, text, "", "", 0))
        if covered >= L.COVERAGE:
            want[k, name] = covered
    got = {(r.doc_id, r.license): r.coverage for r in L.matches(frame(spark, data)).collect()}
    assert len(want) > 8
    for key, covered in want.items():
        assert abs(got[key] - covered) <= 0.02, (key, covered)
    assert all(key in want or key[1] not in L.TEMPLATES or got[key] >= L.COVERAGE for key in got)


def test_patience_pairs_are_a_common_subsequence():
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.choice("abcdefghij") for _ in range(r.randint(0, 14))] for _ in range(2))
        pairs = L.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= lcs(a, b)
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert len(pairs) == lcs(a, b)


def test_planted_licenses(spark):
    data, want = [], set()
    for k, (name, text) in enumerate(L.TEMPLATES.items()):
        whole = prose(k, 40) + "\n" + text + "\n" + prose(k + 50, 40)
        data.append((k, whole, "", "", 0))
        want.add((k, name))
    words = L.TEMPLATES["MIT"].split()
    changed = [w for i, w in enumerate(words) if i % 12]  # one word in twelve gone
    data.append((50, " ".join(changed), "", "", 0))
    want.add((50, "MIT"))
    data += [(60, prose(1, 3000), "", "", 0), (61, LONG, "", "", 0), (62, None, "", "", 0), (63, "", "", "", 0), (64, "this license is under the version of the general public work", "", "", 0)]
    got = L.matches(clashing(frame(spark, data))).collect()
    found = {(r.doc_id, r.license) for r in got}
    assert want <= found
    # A template that begins like another one is found with it; nothing is found in the rest.
    assert all(i <= 50 for i, _ in found)
    texts = {i: t for i, t, *_ in data}
    for r in got:
        if r.coverage == 1.0 and r.doc_id < 50 and r.license in L.TEMPLATES and L.TEMPLATES[r.license] in texts[r.doc_id]:
            assert texts[r.doc_id][r.start : r.end].strip(".") in L.TEMPLATES[r.license]


def test_several_places_and_empty(spark):
    t = L.TEMPLATES["MIT-line"]
    out = L.matches(frame(spark, [(1, f"{t} {prose(3, 30)} {t} {t}", "", "", 0)])).orderBy("start").collect()
    assert [(r.license, r.coverage) for r in out] == [("MIT-line", 1.0)] * 3
    assert L.matches(spark.createDataFrame([], SCHEMA)).count() == 0
