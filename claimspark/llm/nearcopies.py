"""Near copies by word shingles: banded MinHash finds candidates, the exact Jaccard similarity decides.

A text's set is the XXH64 hashes of its five-word shingles. Two texts are near copies if their sets have a Jaccard
similarity of SIMILARITY or more; the connected components of such pairs are the groups. BANDS bands of ROWS minima each
make a pair candidates where a band is equal: a pair at 0.8 shares none with a probability of 6e-5, one at 0.9 with
less than 1e-8. Every candidate is checked on the whole sets.

Texts with equal sets are one node, whatever their number. Buckets with the same members count once. Each bucket's
members are first compared with one of them, the one in most buckets, so that a large group of near copies costs as many
comparisons as it has members. Buckets whose members that leaves in several components are then compared in full, in
pairs of blocks of at most BLOCK members, but for pairs already in one component: no candidate is left out.

Defined cases: a null text is empty; texts without words are copies of each other; fewer words than a shingle make one
shingle; null ids are allowed and come last; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, maybe_broadcast, text_of
from .simhash import BROADCAST_NUMBERS, SEED, components, fingerprint, signed
from .simhash import links as fingerprint_links

WORDS = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 6
#: Members of a bucket that are held at once, twice: larger buckets become pairs of blocks.
BLOCK = 1_000

_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    seen = text.lower().split()
    parts = map(b" ".join, zip(*[seen[i:] for i in range(words)])) if len(seen) >= words else [b" ".join(seen)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in parts), dtype="<u8"))


def buckets(hashes: np.ndarray) -> list[int]:
    """One signed key for each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (_FACTORS * hashes[at : at + 512] + _TERMS).min(axis=1), out=least)
    return [signed(xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i)) for i in range(BANDS)]


def _append_keys(words: int, prints: bool):
    """Replaces the last column, the text, by its set's digest, its buckets and, with prints, its fingerprint."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, texts = batch.columns
            nodes, keys, fps = [], [], []
            for i in range(len(texts)):
                fps.append(signed(fingerprint(texts[i].as_py())) if prints else None)
                hashes = shingles(texts[i].as_py(), words)
                nodes.append(signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)))
                keys.append(buckets(hashes))
            yield pa.RecordBatch.from_arrays([*others, pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(fps, pa.int64())], names=[*batch.schema.names[:-1], "node", "buckets", "fp"])

    return work


def _sets(words: int):
    """(node, text) -> (node, hashes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), words).view("<i8") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    return work


def _open_links(rows: DataFrame, similarity: float, block: int) -> DataFrame:
    """rows(bucket, node, component, n, hashes), n the members of the bucket -> (a, b): of the pairs in a bucket that are
    similar, enough to join all that they join."""
    k = F.ceil(F.col("n") / F.lit(block)).cast("int")
    placed = rows.withColumn("k", k).withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("k")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda t: F.struct(F.least(t, F.col("own")).alias("lo"), F.greatest(t, F.col("own")).alias("hi")))
    dealt = placed.select("bucket", "node", "component", "hashes", "own", F.explode(pairs).alias("p")).select("bucket", "p.lo", "p.hi", "own", "node", "component", "hashes")

    def forest(members: list[tuple], same: bool, lo: int) -> list[tuple[int, int]]:
        roots: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := roots.setdefault(x, x)) != x:
                roots[x] = x = roots[up]
            return x

        out = []
        left = members if same else [m for m in members if m[0] == lo]
        right = members if same else [m for m in members if m[0] != lo]
        for i, (_, a, ca, sa) in enumerate(right):
            for _, b, cb, sb in left[:i] if same else left:
                small, large = sorted((len(sa), len(sb)))
                if small < similarity * large or root(ca) == root(cb):
                    continue
                both = len(sa & sb)
                if both / (small + large - both) >= similarity:
                    roots[root(ca)] = root(cb)
                    out.append((a, b))
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members = None, []
        out: list[tuple[int, int]] = []
        for batch in batches:
            columns = [batch.column(c) for c in range(6)]
            hashes = batch.column(6)
            for i, (*key, own, node, component) in enumerate(zip(*[c.to_pylist() for c in columns], strict=True)):
                if key != group:
                    if group:
                        out += forest(members, group[1] == group[2], group[1])
                    group, members = key, []
                members.append((own, node, component, frozenset(hashes[i].values.to_numpy().tolist())))
        if group:
            out += forest(members, group[1] == group[2], group[1])
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    by = ["bucket", "lo", "hi"]
    return dealt.repartition(*by).sortWithinPartitions(*by, "node").mapInArrow(work, "a long, b long")


def links(members: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """members(bucket, node), sets(node, hashes) -> (fp, root), as components(): the nodes that have similar ones among
    the members of their buckets, with the smallest node of their component."""
    degree = members.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    centre = members.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("c"))
    pairs = members.join(cut(centre.select("bucket", F.col("c.node").alias("centre")), "near-centres"), "bucket").filter("node <> centre")
    pairs = cut(pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "near-pairs")
    sided = lambda x: sets.select(F.col("node").alias(x), F.col("hashes").alias(f"{x}_hashes"))
    both = F.size(F.array_intersect("a_hashes", "b_hashes"))
    similar = both / (F.size("a_hashes") + F.size("b_hashes") - both) >= similarity
    found = cut(pairs.join(sided("a"), "a").join(sided("b"), "b").filter(similar).select("a", "b"), "near-links")
    known = cut(components(found), "near-components")
    state = members.join(known.select(F.col("fp").alias("node"), "root"), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("component"))
    state = cut(state, "near-state")
    several = state.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("n > 2 AND lo <> hi")
    several = cut(several.select("bucket", "n"), "near-open")
    if not several.limit(1).count():
        return known
    rest = cut(_open_links(state.join(several, "bucket").join(sets, "node"), similarity, block), "near-rest")
    if not rest.limit(1).count():
        return known
    return components(found.unionByName(rest))


def candidates(keyed: DataFrame) -> DataFrame:
    """keyed(node, buckets) -> (bucket, node), each once: the buckets of several nodes; of buckets with the same nodes,
    one."""
    each = keyed.select("node", F.explode("buckets").alias("bucket"))
    shared = each.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi")
    members = cut(each.join(cut(shared.select("bucket"), "near-shared"), "bucket").select("bucket", "node").distinct(), "near-members")
    marks = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    once = cut(marks.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"), "near-buckets")
    return cut(members.join(once, "bucket"), "near-candidates")


def with_fingerprints(linked: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """linked(fp, root) as of links(), joined with the links of SimHash: prints(node, fp), nodes whose fingerprints are linked
    within the radius being in one component too."""
    alike = cut(components(fingerprint_links(prints.select("fp").distinct(), radius)), "near-alike")
    groups = cut(prints.join(alike, "fp", "left").select("node", F.coalesce("root", "fp").alias("group")).distinct(), "near-print-groups")
    first = cut(groups.groupBy("group").agg(F.min("node").alias("b")), "near-print-firsts")
    more = groups.join(first, "group").filter("node <> b").select(F.col("node").alias("a"), "b")
    return components(linked.select(F.col("fp").alias("a"), F.col("root").alias("b")).unionByName(more))


def keep_representatives(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int | None = None) -> DataFrame:
    """docs with one row of each group of near copies, all columns: that with the smallest doc_id (ids that are null
    last; between equal ids the row numbered first). With a radius the links of SimHash within it join groups too."""
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.monotonically_increasing_id().alias("number"))
    schema = numbered.schema.add("node", "long").add("buckets", T.ArrayType(T.LongType())).add("fp", "long")
    rows = cut(numbered.select("*", text_of(F.col("row.text")).cast("binary").alias("text")).mapInArrow(_append_keys(words, radius is not None), schema), "near-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("lacks"), "id", "number")).alias("first")
    nodes = cut(rows.groupBy("node").agg(first), "near-nodes")
    members = candidates(rows.select("node", "buckets"))
    wanted = cut(nodes.join(members.select("node").distinct(), "node", "left_semi").select("first.number"), "near-wanted")
    texts = rows.join(maybe_broadcast(wanted, BROADCAST_NUMBERS), "number", "left_semi").select("node", text_of(F.col("row.text")).cast("binary").alias("text"))
    sets = cut(texts.mapInArrow(_sets(words), "node long, hashes array<long>"), "near-sets")
    linked = links(members, sets, similarity)
    if radius is not None:
        linked = with_fingerprints(linked, cut(rows.select("node", "fp").distinct(), "near-prints"), radius)
    grouped = nodes.join(linked.select(F.col("fp").alias("node"), "root"), "node", "left")
    grouped = grouped.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    stay = cut(grouped.select("first.number"), "near-stay")
    # The rows that go are few beside those that stay, as in simhash.keep_representatives.
    go = cut(rows.select("number").join(stay, "number", "left_anti"), "near-go")
    return rows.join(maybe_broadcast(go, BROADCAST_NUMBERS), "number", "left_anti").select("row.*")
