"""The best memories of each query by weighted Jaccards of token lists and a bonus (MM1), against all memories.

Almost every query shares a common word with almost every memory, so pairs are not made as rows: memories are dealt into
blocks of bounded size, a task indexes its block once, and its queries stream past it. Only what may be among a query's k
best of a block goes on."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Memories of one block, and queries that meet it in one task.
BLOCK, STREAM = 16_384, 50_000
#: Fewer memories than these are not worth a block of their own.
LEAST = 512
#: Scores are rounded to four digits afterwards, so those that lie a little below the k-th best may still tie with it.
SLACK = 1.01e-4
#: Candidates that are handed on at once.
ROWS = 50_000


def _tokens(rows: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """All tokens of the rows, list after list, and the sizes of the lists: a line per row."""
    sizes = rows.column("sizes").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), -1)
    return rows.column("t").flatten(), sizes


class _Block:
    """An index of a block's memories: for each token and list the memories that hold it, by memory_id."""

    def __init__(self, held: list[pa.RecordBatch], weights: list[float], k: int) -> None:
        rows = pa.Table.from_batches(held).sort_by("memory_id").combine_chunks().to_batches()[0]
        tokens, sizes = _tokens(rows)
        self.weights, self.k, self.ids = weights, k, rows.column("memory_id")
        self.n, self.bonus, self.sizes = len(rows), rows.column("bonus").to_numpy(zero_copy_only=False), sizes.astype(np.float64).T.copy()
        known = tokens.dictionary_encode()
        self.known = known.dictionary
        key = known.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(weights) + np.repeat(np.tile(np.arange(len(weights)), self.n), sizes.ravel())
        of = np.repeat(np.arange(self.n), sizes.sum(axis=1))
        self.rows = of[np.argsort(key, kind="stable")]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=len(self.known) * len(weights)))])

    def _scores(self, keys: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all memories, and whether they share a token with the query."""
        s = np.zeros(self.n)
        for of_list, size, weight, own in zip(keys, sizes, self.weights, self.sizes, strict=True):
            if len(of_list):
                both = np.bincount(np.concatenate([self.rows[a:b] for a, b in zip(self.ends[of_list], self.ends[of_list + 1], strict=True)]), minlength=self.n)
                s += both / (size + own - both) * weight
        return s + self.bonus, s > 0

    def _best(self, s: np.ndarray, met: np.ndarray) -> np.ndarray:
        """The memories that may be among the k best: of equal scores only the k first can."""
        least = np.partition(s, self.n - self.k)[self.n - self.k] - SLACK if self.n > self.k else 0.0
        some = np.flatnonzero((s >= least) & (s > 0))
        if len(some) <= self.k:
            return some
        order = np.lexsort((some, met[some], s[some]))
        some = some[order]
        new = np.concatenate([[True], (np.diff(s[some]) != 0) | (met[some][1:] != met[some][:-1])])
        place = np.arange(len(some)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        return some[place < self.k]

    def best(self, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokens, sizes = _tokens(queries)
        code = pc.fill_null(pc.index_in(tokens, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes.ravel())])
        at, places, scores, shared, n = [], [], [], [], 0

        def batch() -> pa.RecordBatch:
            ids = queries.column("query_id").take(pa.array(np.repeat(at, [len(p) for p in places])))
            return pa.RecordBatch.from_arrays([ids, self.ids.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(scores)), pa.array(np.concatenate(shared))], ["query_id", "memory_id", "s", "met"])

        lists = len(self.weights)
        for i in range(len(queries)):
            keys = [(c := code[ends[j] : ends[j + 1]])[c >= 0] * lists + j % lists for j in range(i * lists, (i + 1) * lists)]
            s, met = self._scores(keys, sizes[i])
            found = self._best(s, met)
            at.append(i)
            places.append(found)
            scores.append(s[found])
            shared.append(met[found])
            n += len(found)
            if n >= ROWS:
                yield batch()
                at, places, scores, shared, n = [], [], [], [], 0
        if n:
            yield batch()


def candidates(queries: DataFrame, memory: DataFrame, weights: dict[str, float], k: int, block: int = BLOCK, stream: int = STREAM) -> DataFrame:
    """(query_id, memory_id, s, met): for each query all memories that may be among the k best by s, the bonus and the sum
    of weighted Jaccards of the lists, rounded to four digits, ties by memory_id; only positive s. met: whether any
    Jaccard is positive. queries(query_id, lists...), memory(memory_id, bonus, lists...). Null tokens don't count; a row
    with a null list has no tokens."""
    some = F.coalesce(F.concat(*weights).isNotNull(), F.lit(False))
    each = lambda c: F.when(some, F.array_distinct(F.array_compact(c))).otherwise(F.array().cast("array<string>"))
    lists = lambda df, *columns: df.select(*columns, *[each(F.col(c)).alias(c) for c in weights]).select(*columns, F.array(*[F.size(c) for c in weights]).alias("sizes"), F.concat(*weights).alias("t"))
    m = lists(memory, "memory_id", "bonus").filter("bonus IS NOT NULL")
    q = lists(queries, "query_id")
    # Few memories make smaller blocks, a core each: repeating queries for blocks moves less than repeating memories.
    n, cores = memory.count(), memory.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, ceil(n / block), min(cores, ceil(n / LEAST)))
    shares = max(ceil(cores / blocks), ceil(queries.count() / stream))
    share_of = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    first = m.withColumn("block", share_of(blocks, "memory_id", "t")).withColumn("share", every(shares)).withColumn("kind", F.lit(0))
    then = q.withColumn("share", share_of(shares, "query_id", "t")).withColumn("block", every(blocks)).withColumn("kind", F.lit(1))
    both = first.unionByName(then, allowMissingColumns=True).withColumn("place", F.col("block") * shares + F.col("share"))
    both = both.repartitionById(blocks * shares, "place").sortWithinPartitions("place", "kind")
    out = T.StructType([q.schema["query_id"], m.schema["memory_id"], T.StructField("s", T.DoubleType()), T.StructField("met", T.BooleanType())])
    factors = list(weights.values())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index = None, [], None
        for b in batches:
            place, kind = (b.column(c).to_numpy(zero_copy_only=False) for c in ("place", "kind"))
            cuts = [0, *(np.flatnonzero((np.diff(place) != 0) | (np.diff(kind) != 0)) + 1), len(b)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                part, now = b.slice(i, j - i), place[i]
                if now != key:
                    key, held, index = now, [], None
                if kind[i] == 0:
                    held.append(part)
                elif held or index is not None:
                    if index is None:
                        index, held = _Block(held, factors, k), []
                    yield from index.best(part)

    return both.select("place", "kind", "query_id", "memory_id", "bonus", "sizes", "t").mapInArrow(scan, out)
