"""Alignment of the tokens of two tokenizers over the same bytes.

Tokenizer A (byte level, of the tokenizers library) encodes a space and the text, tokenizer B (SentencePiece) the text,
before which it puts a space itself. Where tokens of both end at one byte a group ends; tokens whose byte ranges overlap
are linked. Both token arrays of a whole batch are laid on one line of bytes: bit maps of their ends give groups and
links, numpy the sums.

Most groups are one token each with the same bytes. For these an array holds, for each id of A, the id of B with the same
bytes: such links are counted in a vector as long as A's vocabulary. Only links of other groups are counted as pairs, added
up in each task before they are shuffled by pair. A document keeps both kinds as distinct ids with their numbers, so that
its sums over the corpus counts need neither texts nor tokens again.

Counts of at most BROADCAST_PAIRS pairs are sent to the executors as sorted arrays; beyond that the documents' pairs are
joined with the counts, both from written tables so that a hot pair is split.

Defined cases: a null or empty text has no tokens, and neither has one whose tokens of either tokenizer do not spell a space
and the text; null ids and repeated rows are aligned like any other, and each counts; an empty table gives no rows.
Columns to keep that bear the name of a result column are replaced by it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spm, tokenfiles
from .common import cut, scratch_path, text_of

#: So many pairs and counts are broadcast at most, 17 bytes each.
BROADCAST_PAIRS = 2_000_000
#: Distinct pairs that a task counts before it hands them on.
HELD_PAIRS = 1_000_000
BATCH_BYTES = 3 << 20
#: Pieces of text that each tokenizer's table keeps, at most.
KNOWN_PIECES = 800_000
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
PAIRED = ("same_ids", "same_times", "pair_keys", "pair_times")
ADDED = T.StructType()
for _c in COUNTS:
    ADDED = ADDED.add(_c, "long")
ADDED = ADDED.add("groups", "string")
for _c in PAIRED:
    ADDED = ADDED.add(_c, T.ArrayType(T.LongType() if _c == "pair_keys" else T.IntegerType()))
#: Sorted keys take few bytes as differences.
WRITE_OPTIONS = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#same_times.list.element": "true", "parquet.enable.dictionary#pair_times.list.element": "true"}


class Aligner:
    """Both tokenizers, the lengths of their tokens and the map between tokens of the same bytes."""

    def __init__(self, a_path: str, b_path: str) -> None:
        from tokenizers import Tokenizer

        self._a, self._b = tokenfiles.Encoder(a_path, KNOWN_PIECES), spm.Model(b_path, known=KNOWN_PIECES)
        self._a._tokenizer.encode_special_tokens = True
        plain = Tokenizer.from_file(a_path)
        names = {i: t for t, i in plain.get_vocab(with_added_tokens=True).items()}
        self.size_a, b_bytes = max(names) + 1, self._b._bytes
        self.size_b = len(b_bytes)
        level = {chr(c): b for b, c in tokenfiles._ALPHABET.items()} | {chr(b): b for b in tokenfiles._PLAIN}
        spelt = lambda t: bytes(level[c] for c in t) if all(c in level for c in t) else t.encode()
        self.a_bytes = [spelt(names[i]) if i in names else b"" for i in range(self.size_a)]
        self._a_size = np.fromiter(map(len, self.a_bytes), np.int64, self.size_a)
        self._b_size = np.fromiter(map(len, b_bytes), np.int64, self.size_b)
        # Of ids of B with the same bytes the one that is a piece of its own, not a single byte's.
        ids = sorted(range(self.size_b), key=lambda i: (self._b.sp.is_byte(i), self._b.sp.is_control(i), i))
        of_bytes: dict[bytes, int] = {}
        for i in ids:
            of_bytes.setdefault(b_bytes[i], i)
        #: For each id of A the id of B with the same bytes, -1 where there is none.
        self.same = np.array([of_bytes.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)
        ends = [f"{i}{sign}" for n, signs in ((self.size_a, ",|"), (self.size_b, ",;")) for sign in signs for i in range(n)]
        self._spelt = pa.array(ends, pa.string())

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and how many for each text, ids of B and how many; none for texts that either does not spell."""
        n = len(texts)
        # The letter and the space before it are cut apart by the tokenizer itself; the letter is one token.
        a, counts_a = self._a.encode_all(pc.binary_join_element_wise(pa.scalar("x"), texts, pa.scalar(" ")))
        heads = np.zeros(len(a), bool)
        heads[np.cumsum(counts_a) - counts_a] = True
        a, counts_a = a[~heads].astype(np.int64), counts_a - 1
        b, counts_b = self._b.encode_all(texts)
        b = b.astype(np.int64)
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        of = lambda lengths, ids, counts: np.bincount(np.repeat(np.arange(n), counts), lengths[ids], n).astype(np.int64)
        right = (size > 0) & (of(self._a_size, a, counts_a) == size + 1) & (of(self._b_size, b, counts_b) == size + 1)
        right &= pc.equal(self._b.decode_all(b, counts_b), texts).to_numpy(zero_copy_only=False)
        if not right.all():
            a, b = a[np.repeat(right, counts_a)], b[np.repeat(right, counts_b)]
            counts_a, counts_b = np.where(right, counts_a, 0), np.where(right, counts_b, 0)
        return a, counts_a, b, counts_b

    def align(self, texts: pa.Array) -> list[pa.Array]:
        """The columns of ADDED."""
        n = len(texts)
        a, counts_a, b, counts_b = self.tokens(texts)
        doc_a = np.repeat(np.arange(n), counts_a)
        ends_a, ends_b = np.cumsum(self._a_size[a]), np.cumsum(self._b_size[b])
        total = int(ends_a[-1]) if len(ends_a) else 0
        in_a, in_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        in_a[ends_a], in_b[ends_b] = True, True
        last_a, last_b = in_b[ends_a], in_a[ends_b]  # tokens that end a group
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # Each stretch between neighbouring ends of either is one link.
        at = np.flatnonzero(in_a | in_b)
        is_a, is_b = in_a[at], in_b[at]
        of_a = np.cumsum(is_a) - is_a
        link_a, link_b = a[of_a], b[np.cumsum(is_b) - is_b]
        doc = doc_a[of_a]
        both = is_a & is_b
        alone = both & np.concatenate([np.ones(min(1, len(both)), bool), both[:-1]]) & (self.same[link_a] == link_b)
        columns = [counts_a, counts_b, np.bincount(doc_a[last_a], minlength=n), np.bincount(doc, minlength=n)]
        out = [pa.array(c.astype(np.int64)) for c in columns]
        out.append(self._groups(a, b, last_a, last_b, group_a, group_b, counts_a + counts_b))
        out += _distinct(doc[alone], link_a[alone], self.size_a, n, pa.int32())
        out += _distinct(doc[~alone], link_a[~alone] * self.size_b + link_b[~alone], self.size_a * self.size_b, n, pa.int64())
        return out

    def _groups(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """a1,a2|b1;a3|b2,b3 for each text."""
        n_groups = int(last_a.sum())
        per_a, per_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        upto_a, upto_b = np.cumsum(per_a), np.cumsum(per_b)
        items = np.empty(len(a) + len(b), np.int64)
        items[np.arange(len(a)) + (upto_b - per_b)[group_a]] = a + self.size_a * last_a
        items[np.arange(len(b)) + upto_a[group_b]] = 2 * self.size_a + b + self.size_b * last_b
        spelt = self._spelt.take(pa.array(items))
        edges = np.frombuffer(spelt.buffers()[1], np.int32, len(items) + 1, spelt.offset * 4) if len(items) else np.zeros(1, np.int32)
        ends = edges[np.cumsum(sizes)].astype(np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        text = spelt.buffers()[2].to_pybytes() if len(items) else b""
        return pa.array([text[x : max(x, y - 1)].decode() for x, y in zip(begins.tolist(), ends.tolist(), strict=True)], pa.string())


def _distinct(doc: np.ndarray, keys: np.ndarray, most: int, n: int, kind: pa.DataType) -> list[pa.Array]:
    """The distinct keys of each document, sorted, and how often each is there, as lists."""
    if most * max(n, 1) >= 1 << 63:
        raise ValueError("too many documents in a batch for keys of this size")
    found, times = np.unique(doc * most + keys, return_counts=True)
    owners = found // most
    edges = pa.array(np.searchsorted(owners, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(edges, pa.array(found - owners * most).cast(kind)), pa.ListArray.from_arrays(edges, pa.array(times.astype(np.int32)))]


@functools.cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker and pair of files."""
    return Aligner(a_path, b_path)


def aligned(docs: DataFrame, a_path: str, b_path: str, keep: list[str]) -> DataFrame:
    """keep (columns of docs) with n_a, n_b, n_groups, n_links, groups (ids, a1,a2|b1;a3|b2,b3), same_ids and same_times (ids of
    A in links of one token each with the same bytes), pair_keys and pair_times (other links: id of A * B's size + id of B)."""
    names = [c for c in keep if c not in ADDED.names]
    rows = docs.select(*names, text_of().alias("__text"))
    schema = T.StructType([*rows.select(*names).schema, *ADDED])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        for whole in batches:
            upto, begin = np.cumsum(pc.binary_length(whole.column(len(names))).to_numpy().astype(np.int64)), 0
            while begin < whole.num_rows:
                n = max(1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + BATCH_BYTES, "right")) - begin)
                *plain, texts = (c.slice(begin, n) for c in whole.columns)
                yield pa.RecordBatch.from_arrays([*plain, *both.align(texts)], names=schema.names)
                begin += n

    return rows.mapInArrow(work, schema)


def _lists(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, times and rows of two list columns."""
    keys, times = batch.column(first), batch.column(first + 1)
    sizes = pc.list_value_length(keys).to_numpy(zero_copy_only=False).astype(np.int64)
    return keys.flatten().to_numpy(zero_copy_only=False).astype(np.int64), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(batch.num_rows), sizes)


def pair_counts(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(key, n) of all pairs of ids that rows, of aligned(), link: a written table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        vector = np.zeros(both.size_a, np.int64)
        held, waiting, n_waiting = (np.zeros(0, np.int64),) * 2, [], 0

        def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([t for _, t in parts]), len(keys)).astype(np.int64)

        def handed(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

        for batch in batches:
            ids, times, _ = _lists(batch, 0)
            vector += np.bincount(ids, times, both.size_a).astype(np.int64)
            keys, times, _ = _lists(batch, 2)
            waiting.append((keys, times))
            n_waiting += len(keys)
            if n_waiting > HELD_PAIRS:
                held, waiting, n_waiting = summed([held, *waiting]), [], 0
                if len(held[0]) > HELD_PAIRS:
                    yield handed(*held)
                    held = (np.zeros(0, np.int64),) * 2
        yield handed(*summed([held, *waiting]))
        used = np.flatnonzero(vector)
        yield handed(used * both.size_b + both.same[used], vector[used])

    counted = rows.select(*PAIRED).mapInArrow(work, "key long, n long")
    return cut(counted.groupBy("key").agg(F.sum("n").alias("n")), "alignment-counts")


def ranked(counts: DataFrame, size_b: int) -> DataFrame:
    """counts with best: whether no pair with the same id of B has a higher count. One row for each id of B is joined."""
    top = counts.groupBy((F.col("key") % size_b).alias("b")).agg(F.max("n").alias("top"))
    joined = counts.withColumn("b", F.col("key") % size_b).join(F.broadcast(top), "b")
    return cut(joined.select("key", "n", (F.col("n") == F.col("top")).alias("best")), "alignment-ranked")


def scored(rows: DataFrame, a_path: str, b_path: str, keep: list[str], broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """keep (columns of rows, a written table of aligned() with a number for each row in the column number) with n_best
    and count_sum over the counts of all rows."""
    both = aligner(a_path, b_path)
    counts = ranked(pair_counts(rows, a_path, b_path), both.size_b)
    if counts.limit(broadcast_pairs + 1).count() <= broadcast_pairs:
        return _by_broadcast(rows, counts, a_path, b_path, keep, PAIRED)
    # The vector's pairs are as many as A's vocabulary has ids; the others meet their counts in a join.
    size_b, same = both.size_b, both.same
    ids = np.flatnonzero(same >= 0)
    spark = rows.sparkSession
    of_vector = spark.createDataFrame(zip((ids * size_b + same[ids]).tolist(), strict=True), "key long")
    few = cut(counts.join(F.broadcast(of_vector), "key", "left_semi"), "alignment-vector")
    alone = _by_broadcast(rows, few, a_path, b_path, ["number"], PAIRED[:2])
    links = rows.select("number", F.explode(F.arrays_zip("pair_keys", "pair_times")).alias("p")).select("number", F.col("p.pair_keys").alias("key"), F.col("p.pair_times").alias("times"))
    others = links.join(counts, "key").groupBy("number").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    joined = rows.select("number", *keep).join(alone, "number").join(others, "number", "left")
    plus = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).cast("long").alias(x)
    return joined.select(*keep, plus("n_best", "more_best"), plus("count_sum", "more_sum"))


def _by_broadcast(rows: DataFrame, counts: DataFrame, a_path: str, b_path: str, keep: list[str], lists: tuple[str, ...]) -> DataFrame:
    """keep with n_best and count_sum of the links in lists; counts: counted, small enough."""
    held = counts.orderBy("key").toArrow()
    shipped = rows.sparkSession.sparkContext.broadcast(tuple(held.column(c).to_numpy() for c in ("key", "n", "best")))
    schema = T.StructType([*rows.select(*keep).schema, *T.StructType().add("n_best", "long").add("count_sum", "long")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, (known, n, best) = aligner(a_path, b_path), shipped.value
        for batch in batches:
            sums = np.zeros((2, batch.num_rows), np.int64)
            for first in range(len(keep), len(keep) + len(lists), 2):
                keys, times, doc = _lists(batch, first)
                if first == len(keep):
                    keys = keys * both.size_b + both.same[keys]
                at = np.searchsorted(known, keys)
                for k, worth in enumerate((best[at].astype(np.int64), n[at])):
                    upto = np.concatenate([[0], np.cumsum(times * worth)])
                    edges = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                    sums[k] += np.diff(upto[edges])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sums[0]), pa.array(sums[1])], names=schema.names)

    return rows.select(*keep, *lists).mapInArrow(work, schema)


def written(rows: DataFrame) -> DataFrame:
    """rows as a written table with a number for each row."""
    path = scratch_path(rows.sparkSession, "alignment-rows")
    numbered = rows.withColumn("number", F.monotonically_increasing_id())
    numbered.write.options(**WRITE_OPTIONS).parquet(path)
    return rows.sparkSession.read.schema(numbered.schema).parquet(path)
