"""A stored index of vectors for exact nearest neighbours without reading every vector.

Unit vectors are grouped around centroids and stored by group. Three bounds leave out what can't
be among the k best of a query, each cheaper to ask than the next:

* groups: every vector lies within its group's radius of the centroid, so by the triangle
  inequality a group that is too far from the query is not read at all (whole partitions);
* codes: each vector has one byte per dimension and the length of what that leaves out. By
  Cauchy-Schwarz the true similarity lies within that length of the code's (a quarter of the
  bytes of the vectors, and the bound is tight in any number of dimensions);
* the vectors themselves are read for the survivors alone, for the exact rank.

Centroids are fitted on a bounded sample (``SAMPLE`` rows); every vector is indexed, and which
centroids come out only changes how much is read, never the result. Groups are cut into
blocks of ``BLOCK_ROWS``, queries of a group into blocks of ``QUERY_BLOCK``: any
number of vectors and queries takes the same path, block against block.

Rows: null vectors, vectors with a null or non-finite element and those of another width than the
most frequent one are left out; a zero vector has similarity 0 to all; ids may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tendero.session import stored

c = F.col

SAMPLE = 50_000  # rows that the centroids are fitted on
MOST_GROUPS = 4096  # centroids are sent to every task: 4096 x dimensions x 8 bytes at most
BLOCK_ROWS, QUERY_BLOCK = 100_000, 1024
PARTS = 64  # folders of the stored vectors
SLACK = 1e-6  # rounding of similarities to six places, and of the arithmetic


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-10)


def usable(df: DataFrame, dimensions: int) -> DataFrame:
    """Rows whose vector has the index's width and finite elements only."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(c("embedding").isNotNull() & (F.size("embedding") == dimensions) & ~bad)


def _coded(centroids: np.ndarray):
    """Nearest centroid, code and bounds of every vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (centroids ** 2).sum(1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                u = unit(_matrix(part.column(1)))
                group = (squares - 2 * (u @ centroids.T)).argmin(1)
                far = np.linalg.norm(u - centroids[group], axis=1)
                scale = np.abs(u).max(1) / 127
                code = np.rint(u / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
                left_out = np.linalg.norm(u - code * scale[:, None], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(group.astype(np.int32)), pa.array([x.tobytes() for x in code], pa.binary()), pa.array(scale),
                     pa.array(left_out), pa.array(far)], ["id", "cluster", "code", "scale", "left_out", "far"])
    return run


def _first_groups(centroids: np.ndarray, rows: np.ndarray, k: int):
    """The nearest groups of each query that hold k vectors."""
    def run(batches):
        for batch in batches:
            u = unit(_matrix(batch.column(1)))
            order = ((centroids ** 2).sum(1) - 2 * (u @ centroids.T)).argsort(1, kind="stable")
            held = np.cumsum(rows[order], 1)
            take = held - rows[order] < k
            which = np.nonzero(take)[0]
            yield _visits(batch, u, which, order[take], np.full(len(u), -2.0))
    return run


def _other_groups(centroids: np.ndarray, radius: np.ndarray, rows: np.ndarray, k: int):
    """All other groups that may hold a vector at least as similar as the query's bound."""
    def run(batches):
        for batch in batches:
            u, least = unit(_matrix(batch.column(1))), batch.column(2).to_numpy()
            away = np.linalg.norm(u[:, None, :] - centroids[None, :, :], axis=2) if len(centroids) * u.size < 1 << 24 else np.stack(
                [np.linalg.norm(centroids - x, axis=1) for x in u])
            order = ((centroids ** 2).sum(1) - 2 * (u @ centroids.T)).argsort(1, kind="stable")
            done = np.zeros(away.shape, bool)
            np.put_along_axis(done, order, np.cumsum(rows[order], 1) - rows[order] < k, 1)
            # unit vectors at distance d have similarity 1 - d^2 / 2; zero vectors (similarity 0) lie at distance 1
            highest = np.maximum(1 - np.maximum(away - radius - SLACK, 0) ** 2 / 2, np.where(away - radius - SLACK <= 1, 0.0, -1.0))
            which, group = np.nonzero(~done & (highest >= least[:, None] - SLACK))
            yield _visits(batch, u, which, group, least)
    return run


def _visits(batch, u: np.ndarray, which: np.ndarray, group: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
    width = u.shape[1]
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(which)), pa.array(group.astype(np.int32)),
         pa.ListArray.from_arrays(pa.array(np.arange(len(which) + 1, dtype=np.int32) * width), pa.array(u[which].ravel())),
         pa.array(least[which])], ["query_id", "cluster", "vector", "least"])


_VISITS = "query_id long, cluster int, vector array<double>, least double"
_BOUNDS = "query_id long, id long, cluster int, low double, high double"


def _bounded(k: int):
    """Vectors of a block that may be among a query's k best, with the bounds of their similarity."""
    names = [x.split()[0] for x in _BOUNDS.split(", ")]
    empty = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "cluster": pa.array([], pa.int32()),
                      "low": pa.array([], pa.float64()), "high": pa.array([], pa.float64())})

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        vectors = _matrix(left["vector"].combine_chunks())
        codes = np.frombuffer(b"".join(right["code"].to_pylist()), np.int8).reshape(right.num_rows, -1)
        scale, left_out = right["scale"].to_numpy(), right["left_out"].to_numpy() + SLACK
        ids, query, least = right["id"].to_numpy(), left["query_id"].to_numpy(), left["least"].to_numpy()
        out = []
        for lo in range(0, len(vectors), 64):
            near = (vectors[lo:lo + 64].astype(np.float32) @ codes.T.astype(np.float32)).astype(np.float64) * scale
            for q, row in enumerate(near, lo):
                low = row - left_out
                bound = max(least[q], np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -2.0)
                keep = np.flatnonzero(row + left_out >= bound - SLACK)
                out.append((np.full(len(keep), query[q]), ids[keep], low[keep], row[keep] + left_out[keep]))
        found = [np.concatenate(x) for x in zip(*out)]
        return pa.table([found[0], found[1], np.full(len(found[0]), key[0].as_py(), np.int32), found[2], found[3]], names=names)
    return run


@dataclass
class Search:
    """What a search found and what it had to look at."""

    hits: DataFrame
    visits: DataFrame  # (query_id, cluster): groups whose codes were read
    survivors: DataFrame  # (query_id, id, ...): vectors that were read


class VectorIndex:
    """An index stored under ``path``: ``codes`` by group, ``vectors`` by part, ``groups``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        # one row for each group: bounded by MOST_GROUPS
        groups = spark.read.parquet(f"{path}/groups").orderBy("cluster").toPandas()
        self.rows, self.radius = groups["rows"].to_numpy(), groups["radius"].to_numpy()
        self.dimensions = len(groups["centroid"][0]) if len(groups) else 0
        self.centroids = np.stack(groups["centroid"].to_numpy()) if len(groups) else np.zeros((0, 0))
        self.blocks = -(-self.rows // BLOCK_ROWS)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, groups: int | None = None, seed: int = 11) -> VectorIndex:
        """Index of ``vectors`` (id, embedding, and optionally active: only active rows count)."""
        spark = vectors.sparkSession
        if "active" in vectors.columns:
            vectors = vectors.where("active")
        vectors = vectors.select(c("id").cast("long"), "embedding")
        widths = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("w")).agg(F.count("*").alias("n"))
        width = widths.orderBy(c("n").desc(), "w").first()
        group_schema = "cluster int, rows long, radius double, centroid array<double>"
        if width is None or not width["w"]:
            spark.createDataFrame([], group_schema).write.parquet(f"{path}/groups")
            return cls(spark, path)
        vectors = usable(vectors, width["w"])
        groups = max(2, groups or min(MOST_GROUPS, int(width["n"] ** 0.5 / 2)))
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)) + 1e-10
        sample = vectors.select(F.xxhash64("id", F.lit(seed)).alias("h"), "id", "embedding").orderBy("h", "id").limit(SAMPLE)
        sample = stored(sample.select(F.transform("embedding", lambda x: x.cast("double") / norm).alias("u")), "sample").select(
            array_to_vector("u").alias("features"))
        model = KMeans(k=groups, seed=seed, maxIter=5, initMode="random").fit(sample)
        centroids = np.array(model.clusterCenters())
        coded = vectors.mapInArrow(_coded(centroids), "id long, cluster int, code binary, scale double, left_out double, far double")
        # a group of any size is dealt to many tasks and files
        coded.repartition("cluster", F.pmod(F.xxhash64("id"), F.lit(16))).write.partitionBy("cluster").parquet(f"{path}/codes")
        vectors.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).repartition("part", F.pmod(F.hash("id"), F.lit(4))).write.partitionBy(
            "part").parquet(f"{path}/vectors")
        facts = spark.read.parquet(f"{path}/codes").groupBy("cluster").agg(F.count("*").alias("rows"), F.max("far").alias("radius")).collect()
        held = {r["cluster"]: (r["rows"], r["radius"]) for r in facts}
        spark.createDataFrame([(k, *held.get(k, (0, 0.0)), x.tolist()) for k, x in enumerate(centroids)], group_schema).coalesce(1).write.parquet(f"{path}/groups")
        return cls(spark, path)

    def _bounds(self, visits: DataFrame, k: int) -> DataFrame:
        """Candidates among the codes of the visited groups, block against block."""
        # at most one name for each group
        named = [r["cluster"] for r in visits.select("cluster").distinct().collect()]
        codes = self.spark.read.parquet(f"{self.path}/codes").where(c("cluster").isin(named)).drop("far")
        blocks = F.element_at(F.array(*[F.lit(int(b)) for b in self.blocks]), c("cluster") + 1)
        asked = visits.groupBy("cluster").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts"))
        left = (visits.join(asked, "cluster").withColumn("side", F.pmod(F.xxhash64("query_id"), c("parts")).cast("int"))
                .withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("parts"))
        right = (codes.join(asked, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
                 .withColumn("side", F.explode(F.sequence(F.lit(0), c("parts") - 1))).drop("parts"))
        key = ["cluster", "block", "side"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_bounded(k), _BOUNDS)

    def search(self, queries: DataFrame, k: int = 15, threshold: float | None = 0.30) -> Search:
        """The k most similar vectors of each query (query_id, embedding), as by a scan of all of them.

        Similarity has six places; equal ones are ordered by id; the threshold holds before rounding.
        """
        hits = "query_id long, id long, similarity double, place int"
        if not len(self.rows):
            none = self.spark.createDataFrame([], hits)
            return Search(none, none.selectExpr("query_id", "place as cluster"), none.select("query_id", "id"))
        queries = stored(usable(queries.select(c("query_id").cast("long"), "embedding"), self.dimensions)
                         .dropDuplicates(["query_id"]), "queries")
        floor = -2.0 if threshold is None else float(threshold)
        first = stored(queries.mapInArrow(_first_groups(self.centroids, self.rows, k), _VISITS), "visits")
        seen = stored(self._bounds(first, k), "bounds")

        def kth(bounds: DataFrame) -> DataFrame:
            """The k-th best lower bound of each query: what the result can't fall under."""
            place = Window.partitionBy("query_id").orderBy(c("low").desc(), "id")
            best = bounds.withColumn("n", F.row_number().over(place)).where(c("n") <= k)
            return best.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("low")).alias("low"))

        least = F.greatest(F.coalesce("low", F.lit(-2.0)), F.lit(floor))
        known = queries.join(kth(seen), "query_id", "left").select("query_id", "embedding", least.alias("least"))
        rest = stored(known.mapInArrow(_other_groups(self.centroids, self.radius, self.rows, k), _VISITS), "visits")
        bounds = seen.union(stored(self._bounds(rest, k), "bounds"))
        bounds = bounds.join(kth(bounds).select("query_id", least.alias("least")), "query_id").where(c("high") >= c("least") - SLACK)
        survivors = stored(bounds.select("query_id", "id").distinct(), "survivors")
        wanted = survivors.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"))
        # folders that hold no survivor are not listed
        parts = [r["part"] for r in wanted.select("part").distinct().collect()]
        vectors = self.spark.read.parquet(f"{self.path}/vectors").where(c("part").isin(parts)).select("part", "id", c("embedding").alias("v"))
        pairs = wanted.join(vectors, ["part", "id"]).join(queries, "query_id")

        def length(x) -> Column:
            return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v)) + 1e-10

        dot = F.aggregate(F.arrays_zip(c("v").alias("a"), c("embedding").alias("b")), F.lit(0.0), lambda s, p: s + p["a"].cast("double") * p["b"])
        pairs = pairs.withColumn("exact", dot / (length(c("v")) * length(c("embedding")))).where(c("exact") >= floor)
        place = Window.partitionBy("query_id").orderBy(c("similarity").desc(), "id")
        ranked = (pairs.select("query_id", "id", F.round("exact", 6).alias("similarity"))
                  .withColumn("place", F.row_number().over(place)).where(c("place") <= k))
        visits = first.select("query_id", "cluster").union(rest.select("query_id", "cluster"))
        return Search(ranked, visits, survivors)
