"""Terms in texts against brute force."""

import random

from claimspark.operators import graph, joins, match
from claimspark.operators.term_scan import term_hits


def places(text, term):
    return [i for i in range(len(text) - len(term) + 1) if text[i : i + len(term)] == term]


def test_every_place_with_one_automaton_and_with_shards(spark):
    rng = random.Random(3)
    word = lambda n, letters="abđ ": "".join(rng.choice(letters) for _ in range(n))
    texts = [(i, word(rng.randint(0, 60))) for i in range(200)] + [(200, None), (201, ""), (202, "ab" * 100_000), (203, "ab" * 20), (204, "ab" * 20)]
    terms = sorted({word(rng.randint(1, 5)) for _ in range(60)} | {"a" * 30})
    df, d = spark.createDataFrame(texts, "term int, start string"), spark.createDataFrame([(t,) for t in terms + terms[:5] + ["", None]], "x string")
    want = sorted((i, t, p, p + len(t)) for i, s in texts if s and i != 202 for t in terms for p in places(s, t))
    for size in (1_000_000, 40, 1):
        hits = term_hits(df, "start", d, shard_chars=size)
        assert sorted((r.row.term, r.term, r.start, r.end) for r in hits.filter("row.term <> 202").collect()) == want
        long = {r.term: r["count"] for r in hits.filter("row.term = 202").groupBy("term").count().collect()}
        assert long == {t: len(places("ab" * 100, t)) + 99_900 for t in terms if t in "ab" * 100}
        once = term_hits(df, "start", d, once=True, shard_chars=size)
        assert sorted((r.row.term, r.term, r.start) for r in once.collect()) == sorted((i, t, s.index(t)) for i, s in texts if s for t in terms if t in s)


def test_no_texts_and_no_terms(spark):
    df, none = spark.createDataFrame([(1, "abc")], "id int, text string"), spark.createDataFrame([], "term string")
    assert term_hits(df, "text", none).count() == 0
    assert term_hits(df.limit(0), "text", spark.createDataFrame([("b",)], "term string")).count() == 0
    assert match.annotate(df, none).count() == 0


def test_contains_join_keeps_both_rows(spark):
    left = spark.createDataFrame([(1, "hemoglobin"), (1, "hemoglobin"), (2, None), (3, "x")], "id int, name string")
    right = spark.createDataFrame([("globin", "a"), ("globin", "b"), ("hemo", "c"), ("", "d"), (None, "e")], "term string, code string")
    assert sorted((r.id, r.term, r.code) for r in joins.contains_join(left, right, "name", "term").collect()) == sorted([(1, "globin", "a"), (1, "globin", "b"), (1, "hemo", "c")] * 2)


def annotated(text, terms):
    out, taken = [], []
    for t in sorted(terms, key=lambda t: (-len(t), t)):
        start = text.find(t)
        while len(t) > 1 and start >= 0:
            if not any(start < e and start + len(t) > s for s, e in taken):
                taken.append((start, start + len(t)))
                out.append((start, start + len(t), t))
            start = text.find(t, start + len(t))
    return sorted(out)


def test_annotate_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    texts = [(i, word(rng.randint(0, 50))) for i in range(150)]
    terms = sorted({word(rng.randint(1, 6)).strip() for _ in range(25)} - {""})
    want = sorted((i, *x) for i, s in texts for x in annotated(s, terms))
    df, d = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(t,) for t in terms], "term string")
    for size in (1_000_000, 20):
        assert sorted(tuple(r) for r in match.annotate(df, d, size).collect()) == want


def test_annotate_folds(spark):
    df = spark.createDataFrame([(1, "Viêm Đường ruột")], "id int, text string")
    got = match.annotate(df, spark.createDataFrame([("đường",), ("DUONG RUOT",), ("v",)], "term string")).collect()
    assert [tuple(r) for r in got] == [(1, 5, 15, "duong ruot")]


def test_entities_by_a_name_inside_a_word(spark):
    entities = spark.createDataFrame([(1, "Drug", "x"), (2, None, "Methyldiazepam 5"), (3, None, None)], "entity_id int, type string, name string")
    rules = spark.createDataFrame([("type", "Drug", "D"), ("name", "diazepam", "Z"), ("name", "azepam", "Y")], "kind string, value string, class string")
    assert sorted((r.entity_id, r["class"], r.how) for r in graph.map_entities(entities, rules).collect()) == [(1, "D", "type"), (2, "Z", "name")]


def test_overlaps_are_settled_in_bounded_batches(monkeypatch):
    import pyarrow as pa

    spans = [[{"n": -3, "term": "abc", "start": 7 * k, "end": 7 * k + 3} for k in range(9)] + [{"n": -2, "term": "bc", "start": 7 * k + s, "end": 7 * k + s + 2} for k in range(9) for s in (1, 4)] for _ in range(40)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(spans, pa.list_(pa.struct([("n", pa.int32()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))], ["id", "spans"])
    monkeypatch.setattr(match, "PLACES", 50)
    got = list(match._settle(iter([rows, rows.slice(0, 0)])))
    assert max(len(b) for b in got) < 50 + 18 and sum(len(b) for b in got) == 40 * 18
    found = sorted((r["id"], r["start"], r["end"], r["term"]) for b in got for r in b.to_pylist())
    assert found == sorted((i, 7 * k + s, 7 * k + e, t) for i in range(40) for k in range(9) for s, e, t in ((0, 3, "abc"), (4, 6, "bc")))
