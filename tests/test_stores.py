"""Vector index, references found in data, and the stored catalog."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from tendero.operators import catalog, references, retrieval
from tendero.operators import vector_index as vi
from tendero.operators.vector_index import VectorIndex
from tendero.sources.snapshots import SnapshotTable


# --- vector index ------------------------------------------------------------------

def brute(vectors, queries, k, threshold):
    out = []
    for q, x in queries:
        near = []
        for i, v in vectors:
            a, b = np.asarray(v, float), np.asarray(x, float)
            s = a @ b / ((np.linalg.norm(a) + 1e-10) * (np.linalg.norm(b) + 1e-10))
            if threshold is None or s >= threshold:
                near.append((-round(s, 6) + 0.0, i))
        out += [(q, i, -s + 0.0, n) for n, (s, i) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


def made_vectors():
    r = np.random.default_rng(1)
    middles = r.normal(size=(6, 16))
    vectors = [(k, (middles[k % 6] * (1 + k % 3) + r.normal(size=16) * 0.15).tolist()) for k in range(300)]
    vectors += [(1000 + k, vectors[0][1]) for k in range(30)]  # ties beyond k
    vectors += [(2000 + k, r.normal(size=16).tolist()) for k in range(60)] + [(3000, [0.0] * 16)]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in vectors]


@pytest.mark.parametrize("k, threshold, blocks", [(10, 0.3, 100_000), (7, None, 40), (400, 0.0, 100_000)])
def test_index_equals_a_scan(spark, tmp_path, monkeypatch, k, threshold, blocks):
    monkeypatch.setattr(vi, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(vi, "QUERY_BLOCK", 4)
    vectors = made_vectors()
    extra = [(9000, None), (9001, [1.0] * 5), (9002, [float("nan")] * 16), (9003, [None] * 16)]
    df = spark.createDataFrame(vectors + extra, "id long, embedding array<float>").repartition(4)
    asked = [(q, v) for q, v in vectors if q % 50 == 0]
    queries = spark.createDataFrame(asked + [(77, None), (78, [1.0])], "query_id long, embedding array<float>")
    found = VectorIndex.build(df, str(tmp_path / "ix"), groups=6).search(queries, k=k, threshold=threshold)
    got = sorted((r.query_id, r.id, r.similarity + 0.0, r.place) for r in found.hits.collect())
    assert got == brute(vectors, asked, k, threshold)


def test_groups_that_are_too_far_are_not_read(spark, tmp_path):
    vectors = made_vectors()[:300]
    df = spark.createDataFrame(vectors, "id long, embedding array<float>")
    index = VectorIndex.build(df, str(tmp_path / "ix"), groups=6)
    found = index.search(spark.createDataFrame(vectors[:12], "query_id long, embedding array<float>"), k=5)
    found.hits.collect()
    assert found.visits.count() < 12 * len(index.rows) / 2


def test_under_half_of_the_vectors_are_read(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id as id", "embedding")
    queries = df.where("id % 100 = 0").selectExpr("id as query_id", "embedding")
    index = VectorIndex.build(df, str(tmp_path / "ix"))
    found = index.search(queries, k=10)
    scan = retrieval.cosine_topk(df, queries, k=10)
    assert {tuple(r) for r in found.hits.collect()} == {tuple(r) for r in scan.collect()}
    assert found.survivors.select("id").distinct().count() < df.count() / 2


def test_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, embedding array<float>")
    index = VectorIndex.build(empty, str(tmp_path / "ix"))
    assert index.search(empty.withColumnRenamed("id", "query_id")).hits.collect() == []
    inactive = spark.createDataFrame([(1, [1.0], False), (2, [1.0], True)], "id long, embedding array<float>, active boolean")
    found = VectorIndex.build(inactive, str(tmp_path / "iy")).search(spark.createDataFrame([(5, [2.0])], "query_id long, embedding array<float>"))
    assert [tuple(r) for r in found.hits.collect()] == [(5, 2, 1.0, 1)]


# --- references --------------------------------------------------------------------

def test_inclusions_equal_set_comparison(spark):
    r = np.random.default_rng(2)
    tables = {
        "a": {"a_id": list(range(40)), "b_id": r.integers(0, 20, 40).tolist(), "other": r.integers(-5, 60, 40).tolist()},
        "b": {"b_id": list(range(20)), "flag": [0, 1] * 10, "a_ref": [None] * 10 + list(range(10))},
        "c": {"c_id": [3, 3, 4, None], "b_id": [None] * 4, "long_id": [1 << 40, 5, 6, 7]},
        "none": {"x": [], "y": []},
    }
    frames = {}
    for name, cols in tables.items():
        rows = list(zip(*cols.values()))
        frames[name] = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in cols)).withColumn("text", references.F.lit("x"))
    got = {tuple(r)[:4] for r in references.inclusions(frames).collect()}
    want = set()
    cells = {(t, n): [v for v in vs if v is not None] for t, cols in tables.items() for n, vs in cols.items()}
    for a, va in cells.items():
        for b, vb in cells.items():
            if a != b and va and set(va) <= set(vb) and len(set(vb)) == len(vb):
                want.add((*a, *b))
    assert got == want
    named = {tuple(r)[:4] for r in references.found_references(frames).collect()}
    assert named == {x for x in want if x[0] != x[2] and x[1].removeprefix("a_").removeprefix("b_").removeprefix("c_")
                     == x[3].removeprefix("a_").removeprefix("b_").removeprefix("c_")}


def test_names_meet_without_their_prefix(spark):
    frames = {"orders": spark.createDataFrame([(1, 5), (2, 5)], "o_orderkey long, o_custkey long"),
              "customer": spark.createDataFrame([(5,), (6,)], "c_custkey int")}
    assert [tuple(r)[:4] for r in references.found_references(frames).collect()] == [("orders", "o_custkey", "customer", "c_custkey")]
    assert references.inclusions({"t": spark.createDataFrame([("x",)], "s string"), "u": spark.createDataFrame([], "k long")}).collect() == []


# --- stored catalog ------------------------------------------------------------------

def test_only_stale_tables_are_described_again(spark, tmp_path, monkeypatch):
    keys = {"A": ("id",), "B": ("id",), "C": ("id",)}
    frame = lambda n: spark.range(n)
    at = datetime(2024, 5, 1, 12)
    store = catalog.refresh_catalog(str(tmp_path / "c"), spark, {"A": frame(3), "B": frame(4)}, keys, (), at)
    assert isinstance(store, SnapshotTable)
    seen, real = [], catalog.described_tables
    monkeypatch.setattr(catalog, "described_tables", lambda s, tables, *rest: seen.append(sorted(tables)) or real(s, tables, *rest))
    counts = lambda: {r.table_name: r.row_count for r in store.read().collect()}
    catalog.refresh_catalog(store, spark, {"A": frame(5), "B": frame(6)}, keys, (), at + timedelta(hours=11))
    assert seen == [] and counts() == {"A": 3, "B": 4}
    catalog.refresh_catalog(store, spark, {"A": frame(5), "C": frame(1)}, keys, (), at + timedelta(hours=11))
    assert seen == [["C"]] and counts() == {"A": 3, "C": 1}
    catalog.refresh_catalog(store, spark, {"A": frame(7), "C": frame(2)}, keys, (), at + timedelta(hours=13))
    assert seen[1:] == [["A"]] and counts() == {"A": 7, "C": 1}
    catalog.refresh_catalog(store, spark, {"A": frame(8), "C": frame(2)}, keys, (), at + timedelta(hours=13), force=True)
    assert counts() == {"A": 8, "C": 2}
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert "Range (" not in plan
