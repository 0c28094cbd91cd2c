"""Connected components of an edge table, without collecting it.

Every partition first joins its own edges with union-find; what is left are rounds
of two groupings (each node's neighbours move to the smallest of them), written to
the shared folder after each round, until nothing moves.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendero.session import stored


def _forest(batches):
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [n for n in parent if root(n) != n]
    for at in range(0, len(nodes), 100_000):
        part = nodes[at:at + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int64()), pa.array([root(n) for n in part], pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Self edges and repeated edges are allowed; null ends are left out. An empty table
    gives an empty result.
    """
    links = edges.select("a", "b").where("a is not null and b is not null and a != b")
    links = stored(links.mapInArrow(_forest, "a long, b long"), "links")
    state = _state(links)
    while state[0]:
        both = links.union(links.select("b", "a"))
        # neighbours larger than a node move to the smallest node around it
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # then the smaller neighbours of a node, and the node, move to the smallest
        moved = moved.where("a != b").distinct()
        least = moved.groupBy("a").agg(F.min("b").alias("m"))
        tied = moved.join(least, "a")
        links = stored(tied.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
                       .union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = _state(links)
        if now == state:
            break
        state = now
    return (links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
            .union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
            .groupBy("node").agg(F.min("component").alias("component")))


def _state(links: DataFrame) -> tuple:
    """Count and order-free checksum of the edges."""
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
