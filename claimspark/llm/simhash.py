"""SimHash near-dedup: 64-bit fingerprints linked by BK-trees.

A fingerprint has a bit set when more than half of the XXH64 hashes of the text's word shingles have it set.
Fingerprints within the radius are linked; the connected components are the groups of near copies.

How pairs within the radius are found, without comparing all fingerprints: cut into radius + 1 blocks of bits, two
fingerprints within the radius have at least one block in common. Fingerprints that share a block make a shard. A shard
is a BK-tree: children hang below their parent by their integer Hamming distance to it, and a search follows only the
edges whose distance is within the radius of the searched one's. Trees have a bounded number of nodes: in a shard with
more fingerprints the bits outside the block are cut into radius + 1 parts in the same way, and fingerprints that share
one of these too make a shard; should that still be too large, it is cut into several trees by hash, each sent to those
that search it. The trees are not broadcast to all executors, as the number of fingerprints grows with the data; each goes
to the tasks that hold its block.

Exact copies have one fingerprint, so a group of copies is one node whatever its size. A task emits, for what a tree
links, a spanning forest rather than all pairs; no link between different fingerprints is lost for the components.

Defined cases: a null text is empty; a text without words has fingerprint 0, linked like any other; fewer words than a
shingle make one shingle; null ids are allowed, a component's id is its smallest doc_id that is not null; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, text_of

WORDS = 3
SEED = 42
RADIUS = 2
#: Nodes of one BK-tree at most; larger shards become several trees.
TREE_NODES = 1_000
#: So many row numbers (8 bytes each) are broadcast at most; more are met in a shuffled join.
BROADCAST_NUMBERS = 500_000

_SIGN = 1 << 63


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned fingerprint of a text in UTF-8; bytes.split() cuts at the six ASCII white space characters."""
    seen = text.lower().split()
    if not seen:
        return 0
    shingles = map(b" ".join, zip(*[seen[i:] for i in range(words)])) if len(seen) >= words else [b" ".join(seen)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >= _SIGN else x


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, for every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = [signed(fingerprint(texts[i].as_py(), words, seed)) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return rows.mapInArrow(work, "doc_id long, fp long")


class BKTree:
    """Nodes are fingerprints; the children of a node are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new = len(self.values)
        if new:
            at = 0
            while True:
                distance = (self.values[at] ^ value).bit_count()
                below = self.children[at].get(distance)
                if below is None:
                    self.children[at][distance] = new
                    break
                at = below
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Numbers of the nodes within the radius."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            below = self.children[at]
            if below:
                stack += [below[d] for d in range(distance - radius, distance + radius + 1) if d in below]


def _forest(tree: list[int], queries: list[int], same: bool, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over what lies within the radius: of tree (if same), or between queries and tree."""
    built = BKTree()
    roots: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := roots.setdefault(x, x)) != x:
            roots[x] = x = roots[up]
        return x

    links = []
    if not same:
        for value in tree:
            built.add(value)
    for value in tree if same else queries:
        for at in built.within(value, radius):
            a, b = root(value), root(built.values[at])
            if a != b:
                roots[max(a, b)] = min(a, b)
                links.append((value, built.values[at]))
        if same:
            built.add(value)
    return links


def _bits(c: Column, low: int, high: int) -> Column:
    """Bits low to high (exclusive) as a number."""
    return F.shiftrightunsigned(c, low).bitwiseAND(F.lit((1 << (high - low)) - 1)) if high - low < 63 else F.shiftrightunsigned(c, low)


def _without_bits(c: Column, low: int, high: int) -> Column:
    """The bits outside low to high, those above moved down."""
    above = F.shiftleft(_bits(c, high, 64), low) if high < 64 else F.lit(0).cast("long")
    return above.bitwiseOR(_bits(c, 0, low)) if low else above


def _shards(keyed: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, n): those that several fingerprints of keyed have, a written table."""
    return cut(keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), name)


def links(fps: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """fps(fp), each once -> (a, b): links within the radius whose connected components are those of all such links.

    Shards with one fingerprint are dropped after counting. A shard of k trees is searched as k * (k + 1) / 2 pairs of
    trees, each pair a group of its own: no task holds more than two trees' nodes at once.
    """
    spans = [(64 * i // (radius + 1), 64 * (i + 1) // (radius + 1)) for i in range(radius + 1)]
    blocks = [F.struct(F.lit(i).alias("block"), _bits(F.col("fp"), lo, hi).alias("bits"), F.lit(-1).alias("part"), F.lit(0).cast("long").alias("rest")) for i, (lo, hi) in enumerate(spans)]
    shard = ["block", "bits", "part", "rest"]
    keyed = cut(fps.select("fp", F.explode(F.array(*blocks)).alias("key")).select("fp", "key.*"), "simhash-keys")
    shards = _shards(keyed, shard, "simhash-shards")
    placed, large = keyed.join(shards.filter(F.col("n") <= tree_nodes), shard), shards.filter(F.col("n") > tree_nodes)
    if large.limit(1).count():
        parts = F.lit(None).cast("array<struct<part:int,rest:bigint>>")
        for i, (lo, hi) in enumerate(spans):
            width, other = 64 - (hi - lo), _without_bits(F.col("fp"), lo, hi)
            cuts = [width * j // (radius + 1) for j in range(radius + 2)]
            own = F.array(*[F.struct(F.lit(j).alias("part"), _bits(other, x, y).alias("rest")) for j, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))])
            parts = F.when(F.col("block") == i, own).otherwise(parts)
        again = keyed.join(large.select("block", "bits"), ["block", "bits"]).select("fp", "block", "bits", F.explode(parts).alias("p")).select("fp", "block", "bits", "p.part", "p.rest")
        again = cut(again, "simhash-keys-again")
        placed = placed.select("fp", *shard, "n").unionByName(again.join(_shards(again, shard, "simhash-shards-again"), shard).select("fp", *shard, "n"))
    placed = placed.withColumn("k", F.ceil(F.col("n") / F.lit(tree_nodes)).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("k")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda t: F.struct(F.least(t, F.col("own")).alias("lo"), F.greatest(t, F.col("own")).alias("hi")))
    group = [*shard, "lo", "hi"]
    dealt = placed.select("fp", *shard, "own", F.explode(pairs).alias("pair")).select("fp", *shard, "own", "pair.lo", "pair.hi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, queries = None, [], []
        out: list[tuple[int, int]] = []

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
            out.clear()
            return batch

        for batch in batches:
            names = batch.schema.names
            for fp, *rest in zip(*[batch.column(names.index(c)).to_pylist() for c in ("fp", *group, "own")], strict=True):
                *key, own = rest
                if key != now:
                    if len(tree) + len(queries) > 1:
                        out += _forest(tree, queries, now[-2] == now[-1], radius)
                    now, tree, queries = key, [], []
                (tree if own == key[-2] else queries).append(fp)
            if len(out) > 50_000:
                yield flushed()
        if len(tree) + len(queries) > 1:
            out += _forest(tree, queries, now[-2] == now[-1], radius)
        yield flushed()

    return dealt.repartition(*group).sortWithinPartitions(*group, "own", "fp").mapInArrow(work, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a, b) -> (fp, root): every node that has a link, with the smallest node of its connected component.

    Alternating large-star and small-star steps: the number of edges does not grow, and the number of rounds is of the
    order of log^2 of the nodes. Each round is cut, the smallest neighbours too, so that the join of a node with very
    many neighbours reads two tables and its skew can be split. All that reaches the driver is a count and a checksum.
    """
    both = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "simhash-links")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor("b")).first())
    seen = mark(now)
    for _ in range(rounds):
        near = now.select(F.explode(both).alias("e")).select("e.u", "e.v")
        # Large star: a node's larger neighbours go to its smallest neighbour, or to itself if that is smaller.
        least = cut(near.groupBy("u").agg(F.min("v").alias("m")), "simhash-least")
        large = cut(near.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.least("m", "u").alias("b")).distinct(), "simhash-large")
        # Small star: a node and its smaller neighbours go to the smallest of them.
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))
        now = cut(large.join(small, "a").select(F.explode(ends).alias("e")).select("e.a", "e.b").filter("a <> b").distinct(), "simhash-round")
        before, seen = seen, mark(now)
        if before == seen:
            break
    else:
        raise RuntimeError(f"no fixed point within {rounds} rounds")
    return now.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())


def near_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, fp, fingerprint (16 hex digits) and component_id (the smallest doc_id of the
    component)."""
    prints = cut(fingerprints(docs, words, seed), "simhash-prints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    member = cut(components(links(nodes.select("fp"), radius)), "simhash-components")
    ids = nodes.join(member, "fp").groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = member.join(ids, "root").select("fp", "component_id")
    named = cut(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id")), "simhash-named")
    out = prints.join(named, "fp")
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """docs with one row of each group of near copies, all columns: that with the smallest doc_id (ids that are null
    last; between equal ids the row numbered first).

    Rows are numbered when they are written with their fingerprints, so the choice is of one row whatever repeats.
    """
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.monotonically_increasing_id().alias("number"))
    rows = cut(numbered.select("*", text_of(F.col("row.text")).cast("binary").alias("text")).mapInArrow(_append(words, seed), numbered.schema.add("fp", "long")), "simhash-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("lacks"), "id", "number")).alias("first")
    nodes = cut(rows.groupBy("fp").agg(first), "simhash-nodes")
    member = cut(components(links(nodes.select("fp"), radius)), "simhash-components")
    grouped = nodes.join(member, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    stay = cut(grouped.select("first.number"), "simhash-stay")
    # The rows that go are few beside those that stay: they are taken out, so that the texts need not be shuffled as
    # long as the numbers to take out can be broadcast.
    go = cut(rows.select("number").join(stay, "number", "left_anti"), "simhash-go")
    return rows.join(maybe_broadcast(go, BROADCAST_NUMBERS), "number", "left_anti").select("row.*")


def _append(words: int, seed: int):
    """Replaces the last column, the text, by its fingerprint."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, texts = batch.columns
            fps = pa.array([signed(fingerprint(texts[i].as_py(), words, seed)) for i in range(len(texts))], pa.int64())
            yield pa.RecordBatch.from_arrays([*others, fps], names=[*batch.schema.names[:-1], "fp"])

    return work
