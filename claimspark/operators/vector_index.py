"""An inverted-file index of vectors with product-quantised codes (RT8, MM7).

Coarse centroids are fitted on a sample of at most SAMPLE vectors, everything else is done to every vector: each goes into
the list of its nearest centroid and keeps one byte for each of PARTS stretches of the residual, the number of the nearest
of 256 (fewer on small samples) sub-centroids. The lists are a table bucketed and sorted by list, so that a search reads the
lists it probes and joins them without shuffling the index.

A search takes each query to its PROBES nearest lists, estimates the cosine of a list's vectors from tables of the query's
products with the sub-centroids, keeps the RERANK best of each query and list, and ranks those anew by the exact cosine of
the stored vectors. Long lists are cut into chunks of at most CHUNK vectors, so that one list that holds a third of all
rows is many tasks. Results are approximate: recall against the exact search is measured by ``recall``.

Defined cases: null vectors, and vectors with a null or a length other than the most common one of the sample, are not
indexed; a vector of zeros has cosine 0 with any; repeated rows are indexed each; an empty table gives an empty index, which
finds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir
from .windows import topk

#: Vectors the centroids are fitted on, at most.
SAMPLE = 20_000
LISTS, PARTS, PROBES, RERANK, CHUNK = 64, 8, 32, 100, 4096
ROUNDS = 12
BUCKETS = 16


@dataclass
class Quantiser:
    """Centroids of the lists and, for each stretch of the residuals, sub-centroids; a few hundred KB whatever the corpus."""

    lists: np.ndarray
    parts: np.ndarray  # (parts, sub-centroids, width)

    @property
    def size(self) -> int:
        return self.lists.shape[1]

    def residuals(self, v: np.ndarray, at: np.ndarray) -> np.ndarray:
        r = v - self.lists[at]
        n, _, width = self.parts.shape
        return np.pad(r, ((0, 0), (0, n * width - r.shape[1]))).reshape(len(r), n, width)

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = _nearest(v, self.lists)
        cut = self.residuals(v, at)
        return at, np.stack([_nearest(cut[:, p], self.parts[p]) for p in range(len(self.parts))], 1).astype(np.uint8)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)


def _nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1)[None] - 2.0 * v @ centres.T, axis=1)


def _fitted(v: np.ndarray, n: int, seed: int) -> np.ndarray:
    """k-means centres; an empty cluster starts anew at the vector that is worst off."""
    n = max(1, min(n, len(v)))
    centres = v[np.random.default_rng(seed).permutation(len(v))[:n]].copy()
    for _ in range(ROUNDS):
        at = _nearest(v, centres)
        counts = np.bincount(at, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, v)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        if (counts == 0).any():
            far = ((v - centres[at]) ** 2).sum(1)
            centres[counts == 0] = v[np.argsort(-far, kind="stable")[: int((counts == 0).sum())]]
    return centres


def fit(vectors: DataFrame, lists: int = LISTS, parts: int = PARTS, sample: int = SAMPLE, seed: int = 7) -> Quantiser | None:
    """Centroids from the ``sample`` vectors whose ids' hashes are least. vectors(vec_id, v). None if there are none."""
    some = vectors.filter("v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).select("v").toPandas()["v"].tolist()
    if not some:
        return None
    sizes = pd.Series([len(x) for x in some]).mode()
    v = unit(np.array([x for x in some if len(x) == sizes[0]], np.float64))
    coarse = _fitted(v, lists, seed)
    width = -(-v.shape[1] // parts)
    flat = Quantiser(coarse, np.zeros((parts, 1, width)))
    cut = flat.residuals(v, _nearest(v, coarse))
    subs = [_fitted(cut[:, p], 256, seed + p) for p in range(parts)]
    return Quantiser(coarse, np.stack(subs))


@dataclass
class VectorIndex:
    """The table of an index and what it was made with."""

    table: str
    quantiser: Quantiser | None
    path: str


SCHEMA = "list int, vec_id long, code binary, v array<float>"


def build(vectors: DataFrame, quantiser: Quantiser | None = None, path: str | None = None, buckets: int = BUCKETS) -> VectorIndex:
    """Puts every row of vectors(vec_id, v) into the index at path (in the shared folder if none is given)."""
    spark = vectors.sparkSession
    q = quantiser or fit(vectors)
    path = path or f"{shared_dir(spark)}/vector-index-{uuid.uuid4().hex}"
    name = f"vector_index_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({SCHEMA}) USING parquet CLUSTERED BY (list) SORTED BY (list) INTO {buckets} BUCKETS LOCATION '{path}'")
    if q is None:
        return VectorIndex(name, None, path)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            right = [x is not None and len(x) == q.size and not np.isnan(np.asarray(x, np.float64)).any() for x in f["v"]]
            f = f[right]
            if len(f):
                at, codes = q.encode(unit(np.array(f["v"].tolist(), np.float64)))
                yield pd.DataFrame({"list": at.astype(np.int32), "vec_id": f["vec_id"].to_numpy(), "code": [c.tobytes() for c in codes], "v": f["v"].tolist()})

    coded = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<float>").alias("v")).filter("v IS NOT NULL").mapInPandas(work, SCHEMA)
    coded.repartition(buckets, "list").sortWithinPartitions("list").write.insertInto(name)
    spark.catalog.refreshTable(name)
    return VectorIndex(name, q, path)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int = PROBES, rerank: int = RERANK) -> DataFrame:
    """The k nearest vectors of each query by cosine among those that the probed lists' codes put forward: query_id,
    vec_id, score (four digits), rank. queries(query_id, q)."""
    spark, quantiser = queries.sparkSession, index.quantiser
    if quantiser is None:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[[x is not None and len(x) == quantiser.size for x in f["q"]]]
            if len(f):
                q = unit(np.array(f["q"].tolist(), np.float64))
                near = np.argsort(-(q @ quantiser.lists.T), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"list": near.ravel().astype(np.int32), "query_id": np.repeat(f["query_id"].to_numpy(), near.shape[1]), "q": [x.tolist() for x in np.repeat(q, near.shape[1], axis=0)]})

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, _, width = quantiser.parts.shape
        for f in frames:
            for x in f.itertuples(index=False):
                q = np.array([y["q"] for y in x.wanted], np.float64)
                codes = np.frombuffer(b"".join(x.codes), np.uint8).reshape(len(x.ids), parts)
                cut = np.pad(q, ((0, 0), (0, parts * width - q.shape[1]))).reshape(len(q), parts, width)
                estimate = np.repeat((q @ quantiser.lists[x.list])[:, None], len(x.ids), axis=1)
                for p in range(parts):
                    estimate += (cut[:, p] @ quantiser.parts[p].T)[:, codes[:, p]]
                most = min(rerank, len(x.ids))
                best = np.argpartition(-estimate, most - 1, axis=1)[:, :most]
                v = unit(np.asarray(x.flat, np.float64).reshape(len(x.ids), -1))
                ids = np.asarray(x.ids)
                for row, chosen in enumerate(best):
                    yield pd.DataFrame({"query_id": x.wanted[row]["query_id"], "vec_id": ids[chosen], "score": np.round(v[chosen] @ q[row], 4)})

    probed = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).mapInPandas(probe, "list int, query_id long, q array<double>")
    # Lists are gathered in chunks of bounded size, and so are the queries that probe a list.
    n_of = spark.table(index.table).groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    held = spark.table(index.table).join(F.broadcast(n_of), "list").withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), F.ceil(F.col("n") / CHUNK)).cast("int"))
    rows = F.collect_list(F.struct("vec_id", "code", "v")).alias("rows")
    chunks = held.groupBy("list", "chunk").agg(rows).select("list", F.transform("rows", lambda r: r["vec_id"]).alias("ids"), F.transform("rows", lambda r: r["code"]).alias("codes"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("flat"))
    wanted = probed.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(max(1, queries.count() // 256))).cast("int")).groupBy("list", "part").agg(F.collect_list(F.struct("query_id", "q")).alias("wanted"))
    met = chunks.join(wanted.select("list", "wanted"), "list").mapInPandas(work, "query_id long, vec_id long, score double")
    return topk(met, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k, rank="rank")


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of the exact result that was found; a vector as near as the k-th best counts like it."""
    least = exact.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    hits = found.join(least, "query_id").filter(F.col("score") >= F.col("least")).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    return least.join(hits, "query_id", "left").select("query_id", F.round(F.least(F.coalesce("hits", F.lit(0)), F.col("n")) / F.col("n"), 4).alias("recall"))


def drop(spark: SparkSession, index: VectorIndex) -> None:
    """Forgets the table; its files stay at the path."""
    spark.sql(f"DROP TABLE IF EXISTS {index.table}")
