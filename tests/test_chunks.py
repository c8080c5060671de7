"""Sections and chunks: hand-made documents, and the DataFrame form against the table function."""

import random

import pytest

from claimspark.operators import documents as D

NESTED = "\n".join([
    "  ", "before any heading", "I. General", "text of it", "1.1. Causes", "some cause", "a) viral", "hepatitis B", "b) other", "1.2. Course", "--- Page 2 ---", "slow",
    "II. Therapy", "c) directly below", "phụ lục 3", "tables",
])


def _docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_section_tree(spark):
    got = [(r.section, r.title, r.level, r.section_path, r.parent_context, r.page_number, r.body) for r in D.section_tree(_docs(spark, NESTED, None, "", " \n ")).orderBy("section").collect()]
    assert got == [
        (0, "Untitled", "section", "", "", 1, "before any heading"),
        (1, "I. General", "section", "I. General", "", 1, "I. General\ntext of it"),
        (2, "1.1. Causes", "subsection", "I. General > 1.1. Causes", "I. General", 1, "1.1. Causes\nsome cause"),
        (3, "a) viral", "paragraph", "I. General > 1.1. Causes > a) viral", "I. General > 1.1. Causes", 1, "a) viral\nhepatitis B"),
        (4, "b) other", "paragraph", "I. General > 1.1. Causes > b) other", "I. General > 1.1. Causes", 1, "b) other"),
        (5, "1.2. Course", "subsection", "I. General > 1.2. Course", "I. General", 1, "1.2. Course\nslow"),
        (6, "II. Therapy", "section", "II. Therapy", "", 2, "II. Therapy"),
        (7, "c) directly below", "paragraph", "II. Therapy > c) directly below", "II. Therapy", 2, "c) directly below"),
        (8, "phụ lục 3", "section", "phụ lục 3", "", 2, "phụ lục 3\ntables"),
    ]


def test_skip_first_page(spark):
    rows = D.section_tree(_docs(spark, NESTED), skip_first_page=True).orderBy("section").collect()
    assert [(r.section, r.title, r.page_number) for r in rows] == [(0, "Untitled", 2), (1, "II. Therapy", 2), (2, "c) directly below", 2), (3, "phụ lục 3", 2)]


def test_pieces_lose_nothing():
    text = "One sentence. Another one? " * 20 + "x" * 150
    got = D.pieces(text, 100)
    assert all(len(p) <= 100 for p in got)
    assert "".join(got).replace(" ", "") == text.replace(" ", "")
    assert got[0].endswith(("?", "."))
    assert D.pieces("word " * 50, 22)[0] == "word word word word"


def test_small_chunks_join_the_one_before(spark):
    got = D.chunk_documents(_docs(spark, NESTED), least=20).orderBy("chunk").collect()
    assert [(r.chunk, r.section, r.body_text) for r in got[:3]] == [(0, 0, "before any heading"), (1, 1, "I. General\ntext of it"), (2, 2, "1.1. Causes\nsome cause")]
    assert got[3].body_text == "a) viral\nhepatitis B\nb) other\n1.2. Course\nslow\nII. Therapy\nc) directly below\nphụ lục 3\ntables"


@pytest.mark.parametrize("seed", [1, 2])
def test_table_function_gives_the_same_chunks(spark, seed):
    r = random.Random(seed)
    line = lambda: r.choice(["I. Head", "2. head", "1.1 Sub", "a) par", "- item", "Bảng 2", f"--- Page {r.randint(1, 9)} ---", "", "  ", "plain text. More of it? Yes " * r.randint(1, 40)])
    docs = _docs(spark, None, "", *["\n".join(line() for _ in range(r.randint(1, 40))) for _ in range(60)], "long " * 5000)
    docs.createOrReplaceTempView("docs_of_chunks")
    D.register_chunk_text(spark)
    columns = "doc_id, chunk, section, title, level, section_path, page_number, body_text"
    got = spark.sql(f"SELECT {columns} FROM docs_of_chunks, LATERAL chunk_text(text)").collect()
    want = D.chunk_documents(docs).select(*columns.split(", ")).collect()
    assert len(want) > 60
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
