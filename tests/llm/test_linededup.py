import random
import re

from helpers import SCHEMA, clashing, frame, prose

from claimspark.llm import linededup

PASSAGE = prose(7, 60)
TWO = prose(8, 30) + "\n\n" + prose(9, 30)
#: Sentences of some words each, and one long sentence; they stand in the middle of lines below.
SENTENCES = ". ".join(prose(20 + i, 9) for i in range(8))
LONG_SENTENCE = prose(40, 70)


def data():
    return [
        (4, "intro one\n" + PASSAGE + "\nend", "", "", 0), (2, prose(11, 20) + "\n" + PASSAGE.upper().replace(" ", "  ", 3), "", "", 0),
        (7, TWO + "\nmine", "", "", 0), (8, "other\n" + TWO, "", "", 0), (9, "short line\nshort line\nx", "", "", 0), (10, "short line", "", "", 0),
        (None, PASSAGE, "", "", 0), (12, None, "", "", 0), (13, "", "", "", 0), (2, prose(11, 20) + "\n" + PASSAGE.upper().replace(" ", "  ", 3), "", "", 0), (20, "é😀 ß\n" + PASSAGE, "", "", 0),
        (30, f"{prose(31, 12)} {SENTENCES} {prose(32, 12)}.\n  \n", "", "", 0), (31, f"{prose(33, 5)}\n{prose(34, 30)} {SENTENCES.upper()}, {prose(35, 4)}", "", "", 0),
        (40, f"{prose(41, 40)} {LONG_SENTENCE} {prose(42, 40)}", "", "", 0), (41, f"{prose(43, 3)} {LONG_SENTENCE} {prose(44, 60)}", "", "", 0),
        (50, f"{prose(51, 20)} {' '.join(SENTENCES.split()[:40])} {prose(52, 20)}", "", "", 0),
    ]


def brute(docs, min_words):
    """Spans by going through all units in rank order; texts as lists of (word in lower case, start, end, stops)."""
    docs = sorted({(i is None, i or 0, t or "") for i, t, *_ in docs})
    first, cut, flat = {}, {}, {}
    for key in docs:
        lines, now = [], []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", key[2]):
            if not now or now[-1][3] or key[2][now[-1][2] : m.start()].count("\n") > 1:
                lines.append(now := [])
            stops = m.end() < len(key[2]) and re.search(r"""[.!?…。]["'”’)\]]*$""", m[0])
            now.append((m[0].lower(), m.start(), m.end(), bool(stops)))
        wholes, now, units, at = [], [], [], 0
        for line in lines:
            now += line
            if len(line) >= 8 or line is lines[-1]:
                wholes.append(now)
                now = []
            else:
                now[-1] = (*now[-1][:3], False)
        for whole in wholes:
            part, num = [], [(7 * ord(w[0][0]) + 31 * ord(w[0][-1]) + 3 * len(w[0])) % 97 for w in whole]
            for i, w in enumerate(whole):
                part.append(w)
                least = len(part) == 64 or len(whole) > 24 and 6 <= i < len(whole) - 6 and all(num[i] < x for x in num[i - 6 : i]) and all(num[i] <= x for x in num[i + 1 : i + 7])
                if least or i == len(whole) - 1:
                    units.append((at, part))
                    at += len(part)
                    part = []
        cut[key], flat[key] = units, [w for whole in wholes for w in whole]
        for at, unit in units:
            first.setdefault(tuple(w[0] for w in unit), (key, at))
    out = set()
    for key, units in cut.items():
        words, got = flat[key], set()
        marked = [(at, len(u), *first[tuple(w[0] for w in u)]) for at, u in units if first[tuple(w[0] for w in u)] != (key, at)]
        for at, n, _, _ in marked:
            got.update(range(at, at + n))
        whole = set(got)
        reach = {i: max(24, len(u) + 6) for at, u in units for i in range(at, at + len(u))}
        for at, n, other, k in marked:  # extend the run that holds the unit, as its unit's kept place goes on
            low, high = at, at + n
            while low - 1 in whole:
                low -= 1
            while high in whole:
                high += 1
            for x, step in ((low - 1, -1), (high, 1)):
                for j in range(reach.get(x, 0)):
                    own, theirs = x + step * j, x + k - at + step * j
                    left_sentence = j and (words[own - 1][3] if step > 0 and own < len(words) else step < 0 and own >= 0 and words[own][3])
                    if not 0 <= own < len(words) or left_sentence or not 0 <= theirs < len(flat[other]) or words[own][0] != flat[other][theirs][0]:
                        break
                    got.add(own)
        for low in sorted(i for i in got if i - 1 not in got):
            high = low
            while high in got:
                high += 1
            if high - low >= min_words:
                out.add((None if key[0] else key[1], words[low][1], words[high - 1][2], high - low))
    return out


def spans_of(df, least):
    return {(r["doc_id"], r["start"], r["end"], r["words"]) for r in linededup.spans(df, least).collect()}


def test_against_brute_force(spark):
    for least in (50, 1):
        assert spans_of(clashing(frame(spark, data())), least) == brute(data(), least)


def test_random_texts_against_brute_force(spark):
    r = random.Random(4)
    stock = [prose(i, r.randint(3, 30)) for i in range(12)]
    docs = [(i, "" if i else "one! two! three! " * 30, "", "", 0) for i in range(2)] + [(2 + i, "".join(r.choice(stock) + r.choice([". ", " ", "\n", "! ", "  \n\n ", '." ']) for _ in range(r.randint(1, 25))), "", "", 0) for i in range(60)]
    assert spans_of(frame(spark, docs), 50) == brute(docs, 50)


def test_passages_are_caught_and_short_lines_stay(spark):
    found = {r["doc_id"]: r for r in linededup.spans(frame(spark, data())).collect()}
    assert set(found) == {4, 8, None, 20, 31, 41}
    texts = {i: t for i, t, *_ in data()}
    assert texts[31][found[31]["start"] : found[31]["end"]].startswith(SENTENCES[:20].upper()) and found[31]["words"] >= 71  # the last word has a comma
    assert texts[41][found[41]["start"] : found[41]["end"]] == LONG_SENTENCE


def test_cutting_keeps_offsets(spark):
    docs = clashing(frame(spark, data()))
    out = linededup.without(docs, linededup.spans(docs))
    assert out.columns == [*docs.columns, "kept_at"]
    texts = {}
    for i, t, *_ in data():
        texts.setdefault(i, t)
    for r in out.collect():
        whole = texts[r["doc_id"]] or ""
        assert (r["text"] or "") == "".join(whole[p.start : p.end] for p in r["kept_at"])
        assert (PASSAGE in (r["text"] or "").lower().replace("  ", " ")) == (r["doc_id"] == 2)


def wrapped(text, width):
    words = text.split()
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


def test_wrapped_copies_are_found(spark):
    """Whole documents repeated word for word with other line breaks, with and without sentence ends."""
    for sentence in (None, 8, 15, 25):
        docs, n_words = [], {}
        for k in range(45):
            words = prose(1000 + k, (60, 100, 200)[k % 3]).split()
            n_words[100 + k] = len(words)
            text = " ".join(w + ("." if sentence and i % sentence == sentence - 1 else "") for i, w in enumerate(words))
            docs += [(k, wrapped(text, 10), "", "", 0), (100 + k, wrapped(text, 14), "", "", 0)]
        found = [(r["doc_id"], r["words"]) for r in linededup.spans(frame(spark, docs)).collect()]
        assert {i for i, _ in found} == set(n_words)
        assert sum(n for _, n in found) >= 0.99 * sum(n_words.values())


def test_units_are_bounded():
    for text in ("same " * 500, "one two three " * 300, prose(5, 3000)):
        sizes = [len(w) for _, _, w, _ in linededup.units_of(text)]
        assert sum(sizes) == len(text.split()) and max(sizes) <= linededup.MOST_UNIT


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert linededup.spans(empty).count() == 0
