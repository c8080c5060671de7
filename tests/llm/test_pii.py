import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from helpers import SCHEMA, clashing, frame, prose, rows

from claimspark.llm import pii
from claimspark.llm.queries import op8_pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def base(t):
    checks = (("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(p) <= 255 for p in m.split("."))), ("card", CARD, lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", PHONE, lambda m: 9 <= len(digits(m)) <= 15))
    return [(k, m.start(), m.end(), m[0]) for k, rx, ok in checks for m in rx.finditer(t or "") if ok(m[0])]


def scan(spark, data):
    return [(r["doc_id"], r["text"], r["spans"], r["term_spans"]) for r in pii.scan(frame(spark, data), ["doc_id", "text"]).collect()]


def test_base_spans_on_random_text(spark):
    r = random.Random(8)
    parts = ["a", "b.c", "@", ".", "-", "+", " ", "1", "22", "4111 1111 1111 1111", "5500-0000-0000-0004", "10.0.0.1", "256.1.1.1", "+1 (555) 123-4567", "x@y.zz", "%", "_", "é", "😀", "0", "\n", "(", ")"]
    data = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 14))), "", "", 0) for i in range(600)]
    data += [(1001, "1" * 20_000 + " a" * 1000 + "@", "", "", 0), (1002, "a" * 20_000 + "@b.c_d@e.f", "", "", 0), (1003, "1.2.3.4.5.6.7.8", "", "", 0)]
    for i, t, spans, _ in scan(spark, data):
        assert [(s.kind, s.start, s.end) for s in spans] == [b[:3] for b in base(t)], (i, t[:80])


def corpus():
    """Terms that only ever stand with one address, one that stands everywhere, and copies that must not count twice."""
    out, n = [], 0
    for k in range(5):
        out.append((n := n + 1, f"{prose(200 + k, 20)} Zorblax common wrote to ann.lee@x.org kwyjibo{k} about", "", "", 0))
    for k in range(4):
        out.append((n := n + 1, "copied text qqfoo bar common ip 10.1.2.3", "", "", 0))
    for k in range(60):
        out.append((n := n + 1, f"{prose(300 + k, 15)} common words", "", "", 0))
    out.append((n + 1, "zorblax@elsewhere.org", "", "", 0))
    return [*out, (None, None, None, None, None), (n + 2, "", "", "", 0)]


def brute_terms(data, disclosure=pii.DISCLOSURE):
    documents = [(t or "") for _, t, *_ in data]
    texts = set(documents)
    terms = lambda t: {w.lower() for w in re.findall(r"[^\W_]+", t)}

    word = re.compile(r"[^\W_]+")

    def entities_of(t):
        """entity -> its context in the text, that of its first place."""
        out = {}
        for k, start, end, m in base(t):
            v = m.lower() if k == "email" else m if k == "ip" else digits(m)
            before, after = word.findall(t[max(0, start - 64) : start]), word.findall(t[end : end + 64])
            context = (before[-1].lower() if before else "", after[0].lower() if after else "")
            for e in ((k, v), (k, {"email": v.split("@")[-1] + " ", "ip": v.rsplit(".", 1)[0], "card": v[:6], "phone": v[:5] + " "}[k])):
                out.setdefault(e, context)
        return out

    def bare(t):
        for rx in (EMAIL, IP, CARD, PHONE):
            t = rx.sub(" ", t)
        return t

    entities, df, both, together = Counter(), Counter(), Counter(), defaultdict(Counter)
    seen = set()
    for t in documents:
        own = entities_of(t)
        has = terms(bare(t)) if base(t) else terms(t)
        df.update(has)
        entities.update(list(own))
        both.update((e, w) for e in own for w in has)
        for e in own if t not in seen else ():
            for w in has:
                together[e, w][own[e]] += 1
        seen.add(t)
    n = len(documents)

    def score(e, w, k):
        b = sum(together[e, w].values()) ** 2 / sum(x * x for x in together[e, w].values())
        return math.log2(n * k / (df[w] * entities[e])) / math.log2(n / entities[e]) * (b / (b + 1)) ** 2

    strong = {(e, w) for (e, w), k in both.items() if n > entities[e] and score(e, w, k) >= disclosure}
    out = {}
    for t in texts:
        spans = base(t)
        told = {w for e, w in strong if 2 * both[e, w] >= df[w] or e in entities_of(t)}
        out[t] = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t) if m[0].lower() in told and all(m.end() <= s[1] or m.start() >= s[2] for s in spans)]
    return out


def test_disclosing_terms(spark):
    want = brute_terms(corpus())
    assert any(want.values())
    for _, t, _, terms in scan(spark, corpus()):
        assert [(s.start, s.end) for s in terms] == want[t or ""]
        assert not {s.value.lower() for s in terms} & {"common", "copied", "qqfoo", "words"}


def test_terms_are_found_without_their_entity(spark):
    """A text that holds just the term is told too; of one text alone nothing is."""
    data = [*corpus(), (700, "only Zorblax here", "", "", 0), (701, "kwyjibo1 alone", "", "", 0)]
    spans = {i: [s.value for s in terms] for i, _, base_spans, terms in scan(spark, data) if not base_spans}
    assert spans[700] == ["Zorblax"] and spans[701] == []


def test_random_corpus_against_brute_force(spark):
    r = random.Random(6)
    sites, names, vocabulary = ["x.org", "y.com", "z.net"], ["al", "bo", "cy"], [f"w{i}q" for i in range(25)]
    data = []
    for i in range(150):
        words = r.choices(vocabulary, k=r.randint(3, 12))
        if i % 3 == 0:
            site = r.choice(sites)
            words += [f"{r.choice(names)}@{site}", site[0] * 4, f"10.{r.randint(0, 1)}.3.{r.randint(1, 9)}", f"+1 555 {r.randint(1000000, 1000009)}"]
        r.shuffle(words)
        data.append((i, " ".join(words), "", "", 0))
    want = brute_terms(data)
    assert sum(map(len, want.values())) > 20
    for _, t, _, terms in scan(spark, data):
        assert [(s.start, s.end) for s in terms] == want[t]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"user{i}@h{i % 7}.org" for i in range(3000))
    ((_, _, spans, _),) = scan(spark, [(1, text, "", "", 0)])
    assert [(s.kind, s.start, s.end) for s in spans] == [b[:3] for b in base(text)]


def test_sanitised(spark):
    docs = clashing(frame(spark, corpus()))
    out = pii.sanitised(docs)
    assert out.columns == docs.columns and out.count() == len(corpus())
    for r in out.collect():
        assert not EMAIL.search(r["text"] or "") and "Zorblax" not in (r["text"] or "")
        if r["doc_id"] == 1:
            assert "[EMAIL]" in r["text"] and "common" in r["text"]


def test_odd_rows_and_digest(spark, tmp_path):
    frame(spark, [*rows(), (500, "mail a.b@c.de or +49 170 1234567", "", "", 0)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.n_email, r.n_phone, r.spans, r.base_sha256) for r in op8_pii(spark, str(tmp_path)).collect()}
    text = "email:5:13,phone:17:32"
    assert (500, 1, 1, text, hashlib.sha256(text.encode()).hexdigest()) in got
    assert (10, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    assert pii.scan(spark.createDataFrame([], SCHEMA), ["doc_id"]).count() == 0
    assert pii.sanitised(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_copies_are_no_evidence(spark):
    """A group of near copies tells nothing by itself, even if some differ right beside the entity."""
    r, body = random.Random(2), prose(70, 40).split()
    data = []
    for i in range(60):
        w = list(body)
        w[r.randrange(40)] = f"x{i}x"
        data.append((i, " ".join([*w[:20], "ann.lee@x.org", *w[20:]]), "", "", 0))
    data += [(100 + i, prose(800 + i, 30), "", "", 0) for i in range(200)]
    assert not any(terms for _, _, _, terms in scan(spark, data))


def test_wanted_terms_are_counted_before_they_are_joined(spark, monkeypatch):
    from claimspark.llm import pii
    from plan_rows import most_joined

    made, cut = {}, pii.cut

    def watched(df, name):
        if name == "pii-everywhere":
            made["rows"], made["most"] = most_joined(df)
        return cut(df, name)

    monkeypatch.setattr(pii, "cut", watched)
    texts = [f"w{i} who@corp.com v{i} zebra" for i in range(60)] + [f"zebra u{i}" for i in range(300)] + [f"plain t{i}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pii.scan(docs, ["doc_id"]).collect()
    assert len(out) == 560 and {r.term: r.n_all for r in made["rows"]}["zebra"] == 360
    assert made["most"] < 50  # terms, not the 360 places of one
