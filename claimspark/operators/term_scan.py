"""Terms of a dictionary where they stand in texts (JN7, ER14, ER17, GR16), by Aho-Corasick automata: one pass over the
texts, however many and long the terms are, and terms may begin inside words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import cut

#: Characters of the terms of one automaton, which takes some 100 bytes for each.
SHARD_CHARS = 1_000_000
#: Hits that are handed on at once, so that a very long text does not gather all of its own.
HITS = 50_000


def _automaton(terms: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for t in terms:
        out.add_word(t, t)
    out.make_automaton()
    return out


def _found(rows: pa.Array, texts: pa.Array, automaton: ahocorasick.Automaton, once: bool) -> Iterator[pa.RecordBatch]:
    """Batches of (row, hits) for the texts with hits, a row again for every HITS of them."""
    at, offsets, terms, ends = [], [0], [], []

    def batch() -> pa.RecordBatch:
        end = pa.array(ends, pa.int32())
        start = pa.array([e - len(t) for e, t in zip(ends, terms, strict=True)], pa.int32())
        hits = pa.StructArray.from_arrays([pa.array(terms, pa.string()), start, end], ["term", "start", "end"])
        return pa.RecordBatch.from_arrays([rows.take(pa.array(at, pa.int64())), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), hits)], ["row", "hits"])

    def close(i: int) -> None:
        if len(terms) > offsets[-1]:
            at.append(i)
            offsets.append(len(terms))

    for i, text in enumerate(texts):
        seen: set[str] = set()
        for last, term in automaton.iter(text.as_py() or ""):
            if once:
                if term in seen:
                    continue
                seen.add(term)
            terms.append(term)
            ends.append(last + 1)
            if len(terms) >= HITS:
                close(i)
                yield batch()
                at, offsets, terms, ends = [], [0], [], []
        close(i)
    if at:
        yield batch()


def term_hits(df: DataFrame, text: str, terms: DataFrame, keep: Sequence[str] | None = None, once: bool = False, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(row, term, start, end): every place of every term in the column ``text``, in characters from 0, end exclusive;
    row is a struct of the columns ``keep`` of df, or of all. With ``once`` only the first place of each term in a row. terms: one column of
    strings, repeats and nulls allowed. Null texts, empty texts and empty terms have no hits.

    A dictionary of at most ``shard_chars`` characters, which are counted first, goes to every task, and the texts stay
    where they are. A larger one is split into shards of about that size, each with a share of the texts: a task takes the
    terms of its shard first and then the texts, batch by batch."""
    spark = df.sparkSession
    words = cut(terms.select(F.col(terms.columns[0]).alias("term")).filter("term <> ''").distinct())
    n_chars, = words.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    row = F.struct(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]).alias("row")
    rows = df.filter(F.col(text) != "").select(row, F.col(text).alias("text"))
    hit = T.StructType([T.StructField("term", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    out = T.StructType([rows.schema["row"], T.StructField("hits", T.ArrayType(hit))])
    each = lambda found: found.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    if n_chars <= shard_chars:
        known = spark.sparkContext.broadcast([r.term for r in words.collect()])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(known.value)
            for b in batches:
                if len(automaton):
                    yield from _found(b.column("row"), b.column("text"), automaton, once)

        return each(rows.mapInArrow(scan, out))

    shards = ceil(n_chars / shard_chars)
    shares = max(1, ceil(spark.sparkContext.defaultParallelism / shards))
    shard = F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int")
    first = words.select(shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"), F.col("term").alias("text"))
    # A row's share comes from its whole content, so that copies of one text with ids of their own are spread.
    share = F.pmod(F.xxhash64("row", "text"), F.lit(shares)).cast("int")
    then = rows.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), share.alias("share"), F.lit(1).alias("kind"), "text", "row")
    both = first.unionByName(then, allowMissingColumns=True).repartition(shards * shares, "shard", "share").sortWithinPartitions("shard", "share", "kind")

    def scan_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, automaton = None, [], None
        for b in batches:
            marks = list(zip(*[b.column(c).to_pylist() for c in ("shard", "share", "kind")], strict=True))
            i = 0
            while i < len(marks):
                j = i
                while j < len(marks) and marks[j] == marks[i]:
                    j += 1
                part, now = b.slice(i, j - i), marks[i][:2]
                if now != key:
                    key, held, automaton = now, [], None
                if marks[i][2] == 0:
                    held.extend(part.column("text").to_pylist())
                elif held or automaton is not None:
                    if automaton is None:
                        automaton, held = _automaton(held), []
                    yield from _found(part.column("row"), part.column("text"), automaton, once)
                i = j

    return each(both.select("shard", "share", "kind", "text", "row").mapInArrow(scan_shards, out))
