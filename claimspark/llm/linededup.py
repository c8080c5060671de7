"""Substring dedup: repeated passages are removed, all but the earliest, with their places in the original text.

Units are parts of paragraphs: a paragraph (up to a blank line) is cut at sentence ends, and what then has more than
LONG_UNIT words behind words whose number is the least among AROUND words to either side. A sentence of fewer than
SHORT_UNIT words does not end a unit, and no unit has more than MOST_UNIT words. A single line break ends nothing: whether a
unit ends at a place is decided by the words beside it, and a passage has the same units wherever it begins and however
its lines are broken. Units are normalised (lower case, white space runs made one space), hashed to 128 bits and grouped
over the whole corpus. The earliest occurrence, by doc_id and then place, keeps its unit; every other one is marked.
Marked units that follow each other in a document make a run.

A passage seldom begins and ends where units do, so each run is extended word by word, as far as its words equal those
beside the kept occurrences of the run's units: up to the next place where a sentence ends a unit, or the end of the next
unit and the words beyond it that decide where it ends, or LONG_UNIT words where that is more. Beyond these equal words have
equal units again, which make a run of their own; runs that touch after that are one span. Spans with at least MIN_WORDS
words are removed: the rule measures the true repeat, however it is cut, and stock phrases of a few words stay.

Every word that is removed has an equal one at an earlier place, which is itself the earliest or has an earlier one, so
one occurrence of everything stays. Offsets are code points of the original text, the end exclusive.

Defined cases: a null text is empty and has no units; rows that have both doc_id and text in common are one document, so
they fare alike; null ids rank last; an empty table gives no spans. A passage repeated within a document keeps its first
place only.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, text_of

MIN_WORDS = 50
#: Sentences of fewer words do not end a unit.
SHORT_UNIT = 8
#: Units of more words are cut into smaller ones: two units of this length fit into MIN_WORDS.
LONG_UNIT = 24
#: Words to either side that are looked at where a long unit is cut; its parts are about twice as long.
AROUND = 6
#: Words of a unit at most; only texts that repeat a few words over and over have no place to cut before that.
MOST_UNIT = 64
#: Rows, or words of stretches, in one Arrow batch, about.
BATCH_ROWS = 50_000

_BREAK = re.compile("([.!?…。][\"'”’)\\]]*)(?=[\x20\x09-\x0d])|\n[\x20\x09\x0b-\x0d]*\n")
_WORD = re.compile(WORD)
_DOC = ("doc_id", "doc_hash")


def _number(word: str) -> int:
    """A number for a word in lower case, alike wherever it stands."""
    return (7 * ord(word[0]) + 31 * ord(word[-1]) + 3 * len(word)) % 97


def units_of(text: str) -> Iterator[tuple[int, int, list[bytes], bool]]:
    """(start, end, words, stops) of the units of a text; words are normalised, in UTF-8; stops: whether a sentence ends
    the unit, and not a blank line or the length."""
    begin, marks, unit, first, last = 0, _BREAK.finditer(text), [], 0, 0
    while begin <= len(text):
        m = next(marks, None)
        sentence = m is not None and m.group(1) is not None
        end = len(text) if m is None else m.end(1) if sentence else m.start()
        raw = text[begin:end]
        words = raw.lower().encode().split()  # bytes are split at ASCII white space only
        if words:
            left, right = 0, len(raw)
            if raw[0].isspace() or raw[-1].isspace():
                left, right = _WORD.search(raw).start(), len(raw.rstrip("\x20\x09\x0a\x0b\x0c\x0d"))
            if not unit:
                first = begin + left
            last = begin + right
            unit += words
        if unit and (m is None or len(words) >= SHORT_UNIT):
            if len(unit) <= LONG_UNIT:
                yield first, last, unit, sentence
            else:
                yield from _parts(text, first, last, sentence)
            unit = []
        begin = len(text) + 1 if m is None else m.end()


def _parts(text: str, first: int, last: int, stops: bool) -> Iterator[tuple[int, int, list[bytes], bool]]:
    """The parts of a long unit."""
    places = [m.span() for m in _WORD.finditer(text, first, last)]
    words = [text[a:b].lower() for a, b in places]
    numbers, begin, n = [_number(w) for w in words], 0, len(words)
    for i in range(AROUND, n - 1):
        x = numbers[i]
        least = i < n - AROUND and x < min(numbers[i - AROUND : i]) and x <= min(numbers[i + 1 : i + 1 + AROUND])
        if least or i - begin + 1 == MOST_UNIT:
            yield places[begin][0], places[i][1], [w.encode() for w in words[begin : i + 1]], False
            begin = i + 1
    yield places[begin][0], last, [w.encode() for w in words[begin:]], stops


def _own_rows(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("doc_hash"), text.alias("text"))


def _beside(sizes: list[int], stops: list[bool]) -> tuple[list[int], list[int], list[int]]:
    """For each unit of a text: the number of its first word, and how many words before and after it a run that it ends may be
    extended by."""
    at, starts, ends = [0], [], [0] * len(sizes)
    for i, n in enumerate(sizes):
        starts.append(at[i] if not i or stops[i - 1] else starts[-1])  # behind the stop before the unit
        at.append(at[i] + n)
    for i in range(len(sizes) - 1, -1, -1):
        ends[i] = at[i + 1] if stops[i] or i + 1 == len(sizes) else ends[i + 1]
    reach = [max(LONG_UNIT, n + AROUND) for n in sizes]
    before = [min(reach[i - 1], at[i] - starts[i - 1]) if i else 0 for i in range(len(sizes))]
    after = [min(reach[i + 1], ends[i + 1] - at[i + 1]) if i + 1 < len(sizes) else 0 for i in range(len(sizes))]
    return at[:-1], before, after


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_hash, at, start, end, words, before, after, digest): at: the number of the unit's first word; before,
    after: how many words beside it a run may be extended by."""
    schema = "doc_id long, doc_hash long, at int, start int, end int, words int, before int, after int, digest binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = xxhash.xxh3_128_digest
        columns: list[list[int]] = [[] for _ in range(6)]
        of_row: list[int] = []
        digests: list[bytes] = []

        def made(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = pa.array(of_row, pa.int64())
            out = [batch.column(0).take(rows), batch.column(1).take(rows), *[pa.array(c, pa.int32()) for c in columns], pa.array(digests, pa.binary())]
            for x in (*columns, of_row, digests):
                x.clear()
            return pa.RecordBatch.from_arrays(out, names=names)

        for batch in batches:
            texts = batch.column(2)
            for i in range(batch.num_rows):
                found = [(start, end, len(words), stops, hashed(b" ".join(words))) for start, end, words, stops in units_of(texts[i].as_py())]
                if found:
                    starts, ends, sizes, stops, own = zip(*found, strict=True)
                    at, before, after = _beside(sizes, stops)
                    for column, values in zip(columns, (at, starts, ends, sizes, before, after), strict=True):
                        column += values
                    digests += own
                    of_row += [i] * len(found)
                if len(of_row) >= BATCH_ROWS:
                    yield made(batch)
            yield made(batch)

    return _own_rows(docs).mapInArrow(work, schema)


def repeated(found: DataFrame) -> DataFrame:
    """The units, of a written table, that repeat an earlier one, with that one's document (k_doc_id, k_doc_hash) and
    shift: by how many words its place there lies further on than here."""
    rank = F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "doc_hash", "at")
    firsts = cut(found.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first"), "units-first")
    marked = found.join(firsts, "digest").filter(rank != F.col("first"))
    return marked.withColumns({"k_doc_id": F.col("first.doc_id"), "k_doc_hash": F.col("first.doc_hash"), "shift": F.col("first.at") - F.col("at")}).drop("digest", "first").distinct()


def _same_doc(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.doc_hash") == F.col(f"{b}.doc_hash"))


def _stretches(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(doc_id, doc_hash, at, right, most), each place once -> the same without most, with the words that follow, so
    many at most: from word at onwards, or from the word before it backwards. words: array of the words' hashes; places:
    array of where each ends, or begins. A written table."""
    schema = "doc_id long, doc_hash long, at int, right boolean, words array<long>, places array<int>"
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_row, at, right, ends, words, places = [], [], [], [0], [], []

        def made(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, upto = pa.array(of_row, pa.int64()), pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(upto, pa.array(words, pa.int64())), pa.ListArray.from_arrays(upto, pa.array(places, pa.int32()))]
            out = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at, pa.int32()), pa.array(right, pa.bool_()), *lists]
            for x in (of_row, at, right, words, places):
                x.clear()
            ends[1:] = []
            return pa.RecordBatch.from_arrays(out, names=names)

        hashed = xxhash.xxh3_64_intdigest
        for batch in batches:
            texts, wants = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                want = [(w["at"], w["right"], w["most"]) for w in wants[i].as_py()]
                need = max((w + n if r else w) for w, r, n in want)
                text = texts[i].as_py()
                found = [m.span() for m in itertools.islice(_WORD.finditer(text), need)]
                for place, onward, n in want:
                    some = found[place : place + n] if onward else found[max(0, place - n) : place][::-1]
                    words += [hashed(text[a:b].lower()) - (1 << 63) for a, b in some]
                    places += [b if onward else a for a, b in some]
                    of_row.append(i)
                    at.append(place)
                    right.append(onward)
                    ends.append(len(words))
                    if len(words) >= BATCH_ROWS:
                        yield made(batch)
            yield made(batch)

    by_doc = cut(wanted.groupBy(*_DOC).agg(F.collect_list(F.struct("at", "right", "most")).alias("want")), "units-wanted")
    own = _own_rows(docs).alias("d").join(by_doc.alias("n"), _same_doc("d", "n")).select("d.*", "n.want")
    one = F.any_value(F.struct("words", "places")).alias("x")
    return cut(own.mapInArrow(work, schema).groupBy(*_DOC, "at", "right").agg(one).select(*_DOC, "at", "right", "x.*"), "units-stretches")


def _alike(own: Column, kept: Column) -> Column:
    """How many elements two arrays begin with in common."""
    at = F.array_position(F.zip_with(own, kept, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    return F.when(at == 0, F.size(own)).otherwise(at - 1).cast("int")


def _chains(rows: DataFrame, low: str, high: str) -> DataFrame:
    """rows with chain: a number that those of a document have in common whose stretches of words [low, high) overlap or
    touch each other."""
    by_place = Window.partitionBy(*_DOC).orderBy(low, high)
    before = F.max(high).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("chain", F.coalesce(F.col(low) > before, F.lit(False)).cast("int"))
    return opened.withColumn("chain", F.sum("chain").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))


def _runs(marked: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, doc_hash, run, low, high, start, end, units, before, after, keep_doc_id, places): the runs of marked units
    that may become spans; places: array of the (k_doc_id, k_doc_hash, shift) of their units. A written table.

    Everything here is done by document, after one shuffle."""
    ending = marked.withColumn("end_at", F.col("at") + F.col("words"))
    whole = (
        F.min("at").alias("low"), F.max("end_at").alias("high"), F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("units"),
        F.min_by("before", "at").alias("before"), F.max_by("after", "at").alias("after"), F.min_by("k_doc_id", "at").alias("keep_doc_id"),
        F.collect_set(F.struct("k_doc_id", "k_doc_hash", "shift")).alias("places"),
    )
    runs = _chains(ending, "at", "end_at").withColumnRenamed("chain", "run").groupBy(*_DOC, "run").agg(*whole)
    chained = _chains(runs.withColumns({"least": F.col("low") - F.col("before"), "most": F.col("high") + F.col("after")}), "least", "most")
    # Chains that would not have min_words words if all that stands beside their runs were repeated too are done with.
    of_chain = Window.partitionBy(*_DOC, "chain")
    reach = F.max("most").over(of_chain) - F.min("least").over(of_chain)
    return cut(chained.withColumn("reach", reach).filter(F.col("reach") >= min_words).drop("least", "most", "chain", "reach"), "units-runs")


def _extended(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """runs with low, high, start and end moved as far as their words go on as in one of the places where their units are
    kept."""
    ends = F.array(
        F.struct(F.lit(False).alias("right"), F.col("low").alias("at"), F.col("before").alias("most")), F.struct(F.lit(True).alias("right"), F.col("high").alias("at"), F.col("after").alias("most"))
    )
    sides = runs.select(*_DOC, "run", "places", F.explode(ends).alias("e")).filter("e.most > 0").select(*_DOC, "run", "e.*", F.explode("places").alias("p"))
    sides = sides.select(*_DOC, "run", "right", "at", "most", "p.k_doc_id", "p.k_doc_hash", (F.col("at") + F.col("p.shift")).alias("k_at")).filter("k_at >= 0")
    sides = cut(sides, "units-sides")
    kept = sides.select(F.col("k_doc_id").alias("doc_id"), F.col("k_doc_hash").alias("doc_hash"), F.col("k_at").alias("at"), "right", "most")
    wanted = sides.select(*_DOC, "at", "right", "most").unionByName(kept).groupBy(*_DOC, "at", "right").agg(F.max("most").alias("most"))
    words = _stretches(docs, wanted)
    same = lambda a, prefix: F.col(f"{a}.{prefix}doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col(f"{a}.{prefix}doc_hash") == F.col("w.doc_hash")) & (F.col(f"{a}.{prefix}at") == F.col("w.at")) & (F.col(f"{a}.right") == F.col("w.right"))
    own = sides.alias("s").join(words.alias("w"), same("s", "")).select("s.*", F.slice("w.words", 1, F.col("s.most")).alias("own"), F.col("w.places").alias("own_places"))
    own = cut(own, "units-own")
    both = own.alias("s").join(words.alias("w"), same("s", "k_")).select(*[f"s.{c}" for c in (*_DOC, "run", "right", "own_places")], _alike(F.col("s.own"), F.col("w.words")).alias("n"))
    known = both.filter("n > 0").select(*_DOC, "run", "right", "n", F.get("own_places", F.col("n") - 1).alias("to"))
    left, right = (lambda c: F.when(~F.col("right"), F.col(c))), (lambda c: F.when(F.col("right"), F.col(c)))
    more = known.groupBy(*_DOC, "run").agg(F.max(left("n")).alias("left_n"), F.max(right("n")).alias("right_n"), F.min(left("to")).alias("left_to"), F.max(right("to")).alias("right_to"))
    grown = runs.alias("r").join(cut(more, "units-more").alias("x"), _same_doc("r", "x") & (F.col("r.run") == F.col("x.run")), "left")
    moved = {"low": F.col("r.low") - F.coalesce("left_n", F.lit(0)), "high": F.col("r.high") + F.coalesce("right_n", F.lit(0)), "start": F.coalesce("left_to", "r.start"), "end": F.coalesce("right_to", "r.end")}
    return grown.select(*[moved[c].alias(c) if c in moved else F.col(f"r.{c}") for c in runs.columns if c != "places"])


def spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, doc_hash, start, end, units, words, keep_doc_id): what is removed, one row per span. units: the whole ones
    in it; keep_doc_id: the document that keeps the first of them."""
    runs = _runs(repeated(cut(units(docs), "units")), min_words)
    chained = _chains(_extended(docs, runs), "low", "high")
    merged = (F.min("low").alias("low"), F.max("high").alias("high"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("units").alias("units"), F.min_by("keep_doc_id", "low").alias("keep_doc_id"))
    found = chained.groupBy(*_DOC, "chain").agg(*merged).withColumn("words", (F.col("high") - F.col("low")).cast("long")).filter(F.col("words") >= min_words)
    return found.select(*_DOC, "start", "end", "units", "words", "keep_doc_id")


def without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs with the spans cut out of the text, and kept_at: array of (start, end) in the original for each piece that
    stays, so that a place in the new text can be traced. Documents without spans are as they were."""
    holes = removed.groupBy(F.col("doc_id").alias("__id"), F.col("doc_hash").alias("__hash")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__holes"))
    own = docs.withColumn("__key", F.xxhash64(text_of()))
    joined = own.join(cut(holes, "units-holes"), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__hash")), "left")
    some = F.coalesce("__holes", F.array().cast("array<struct<start:int,end:int>>"))
    begins = F.concat(F.array(F.lit(0)), F.transform(some, lambda h: h["end"]))
    ends = F.concat(F.transform(some, lambda h: h["start"]), F.array(F.length(text_of())))
    pieces = F.filter(F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end"))), lambda p: p["start"] < p["end"])
    text = F.array_join(F.transform("kept_at", lambda p: F.substring(F.col("text"), p["start"] + 1, p["end"] - p["start"])), "")
    names = [c for c in docs.columns if c != "kept_at"]
    with_pieces = joined.withColumn("kept_at", pieces)
    return with_pieces.select(*[F.when(F.col("__holes").isNull(), F.col("text")).otherwise(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in names], "kept_at")
