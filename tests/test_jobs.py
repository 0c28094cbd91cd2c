"""Profiling, catalog, retrieval, logs, conversations, streams and reports."""

import json
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tendero.operators import catalog as cat
from tendero.operators import conversations as cnv
from tendero.operators import profiling as prf
from tendero.operators import querylog as log
from tendero.operators import ranking, reports
from tendero.operators import retrieval as ret
from tendero.streaming import state

c = F.col


# --- profiling ---

def test_profile_of_awkward_columns(spark):
    df = spark.createDataFrame(
        [("b", None, 3.0, True, "2024-01-01"), ("a", None, 1.0, True, "2024-01-02x"),
         ("b", None, 4.0, False, None), ("a", None, 1.0, None, "2023-12-31"), ("a'", None, 3.0, None, "2024-01-01")],
        "t string, nothing string, d double, flag boolean, day string").withColumn("d", c("d").cast("decimal(9,2)"))
    got = {r.column: r for r in prf.profile(df).collect()}
    assert got["t"].most_frequent == "a" and got["t"].unique == 3 and got["t"].potential_date is False
    assert (got["nothing"].non_null, got["nothing"].nulls, got["nothing"].most_frequent) == (0, 5, None)
    assert got["d"].kind == "numeric" and got["d"].median == 3.0 and got["d"].max == 4.0
    assert got["flag"].kind == "boolean" and got["flag"].nulls == 2 and got["flag"].most_frequent is None
    assert got["day"].potential_date is True


@pytest.mark.parametrize("common", [0.0, 0.9])
def test_exact_quantiles(spark, common):
    rng = random.Random(5)
    values = [7.0 if rng.random() < common else rng.random() * 100 for _ in range(4000)]
    freq = prf.frequencies(spark.createDataFrame([(v,) for v in values], "x double"), ["x"], "double")
    got = prf.value_stats(freq, {"a": 0.25, "b": 0.5, "c": 0.99, "z": 1.0}, cuts=16).first()
    for name, p in (("a", 0.25), ("b", 0.5), ("c", 0.99), ("z", 1.0)):
        assert got[name] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_summary_and_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None)], "n int, s string")
    r = prf.summary(df).first()
    assert (r.rows, r.duplicates, r.completeness_label, r.numeric_columns, r.text_columns) == (4, 2, "87.5%", 1, 1)
    assert prf.duplicate_rows(df.limit(0)).first().duplicates == 0


def test_only_stale_counts_are_renewed(spark):
    stored = prf.table_stats({"a": spark.range(5)}, "2024-01-01 00:00:00").unionByName(
        prf.table_stats({"b": spark.range(6)}, "2024-01-01 20:00:00"))
    now = {"a": spark.range(50), "b": spark.range(60), "n": spark.range(7)}
    got = {r.table_name: r.row_count for r in prf.refresh_stats(stored, now, "2024-01-02 00:00:00").collect()}
    assert got == {"a": 50, "b": 6, "n": 7}
    forced = prf.refresh_stats(stored, now, "2024-01-02 00:00:00", force=True)
    assert {r.row_count for r in forced.collect()} == {50, 60, 7}


def test_integrity(spark):
    tables = {"f": spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "k int"),
              "d": spark.createDataFrame([(1,), (2,), (2,)], "id int")}
    r = prf.fk_integrity(tables, [("f", ("k",), "d", ("id",))]).first()
    assert (r["rows"], r.orphans) == (4, 1)
    u = {r.table_name: r for r in prf.key_uniqueness(tables, {"f": ("k",), "d": ("id",)}).collect()}
    assert (u["f"].repeated, u["f"].null_rows, u["d"].repeated) == (1, 1, 1)


# --- catalog ---

def _catalog(spark, rows):
    return spark.createDataFrame(
        [(n, [(x, "VARCHAR") for x in cols], pk, [(t, [f"{t}_a", f"{t}_b"], ["a", "b"]) for t in fks], count)
         for n, cols, pk, fks, count in rows], cat.TABLE_SCHEMA + ", row_count long")


def test_catalog_rules(spark):
    got = {r.table_name: r for r in cat.tag_tables(_catalog(spark, [
        ("OLD_VENTAS", ["a"], [], ["X"], 500), ("TIPOS_PAGO", ["TIPO_ID", "NOMBRE"], ["TIPO_ID"], [], 0),
        ("VACIA", ["a"], [], [], 0), ("LIGADA", ["a"], [], ["X"], 0), ("SIN_CONTAR", ["a"], [], [], -1),
        ("DOCTOS_PV_DET", ["DOCTO_PV_ID", "FECHA", "IMPORTE", "UNIDADES"], ["DOCTO_PV_ID"], ["DOCTOS_PV"], 5_000_000),
    ])).collect()}
    assert {n: r.active for n, r in got.items()} == {
        "OLD_VENTAS": False, "TIPOS_PAGO": True, "VACIA": False, "LIGADA": True, "SIN_CONTAR": False,
        "DOCTOS_PV_DET": True}
    det = got["DOCTOS_PV_DET"]
    assert det.relevance == 100 + 10 + 20 + 8 + 15 and not got["VACIA"].kept
    # words match inside longer ones: "pos" is in "tipos"
    assert det.category == "VENTAS" and got["TIPOS_PAGO"].category == "VENTAS" and got["VACIA"].category == "OTROS"
    assert det.semantic_fields == ["cantidades", "fechas y tiempos", "identificación", "importes y precios"]
    assert det.purpose == "Registra transacciones de venta. Detalle de productos vendidos en cada operación"
    assert got["VACIA"].purpose == "Tabla vacia"
    assert det.summary == ("Identificadores: DOCTO_PV_ID | Valores monetarios: IMPORTE | Cantidades: UNIDADES"
                           " | Fechas: FECHA")
    assert det.terms == sorted(det.terms) and len(det.terms) <= 25


def test_composite_references_keep_their_pairs(spark):
    edges = cat.fk_edges(_catalog(spark, [("T", ["a"], [], ["P", "Q"], 1)]))
    assert sorted((r.dst, r.columns, r.referenced_columns) for r in edges.collect()) == [
        ("P", ["P_a", "P_b"], ["a", "b"]), ("Q", ["Q_a", "Q_b"], ["a", "b"])]


def test_sample_patterns(spark):
    df = spark.createDataFrame(
        [(i, f"n{i}", datetime(2024, 1, i), 1.0 * i, 2.0) for i in range(1, 6)],
        "ID long, NOMBRE string, FECHA timestamp_ntz, PRECIO double, IMPORTE double")
    r = cat.describe_sample("T", df, ["ID"]).first()
    assert r.patterns == ("datos operacionales actuales | registros secuenciales | catálogo maestro"
                          " | gestión financiera")
    assert r.examples == ('ID: rango 1.00 a 5.00 | NOMBRE: "n1, n2, n3, n4, n5" | FECHA: desde 2024-01-01'
                          " | PRECIO: rango 1.00 a 5.00 | IMPORTE: 2.0")


def test_merge_and_dictionaries(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({
        "tablas": {"A": {"categoria": "VIEJA", "row_count": 1}, "B": {"categoria": "B"}},
        "keywords_busqueda": {"A": ["uno"]}}))
    (tmp_path / "g.json").write_text(json.dumps({"graph": {"A": ["B", "C"]}}))
    old = cat.read_dictionary(spark, str(tmp_path / "d.json"))
    new = spark.createDataFrame([("A", "NUEVA", 9, "Control de mercancía.", ["dos"])],
                                "table_name string, category string, row_count long, purpose string, terms array<string>")
    got = {r.table_name: r for r in cat.merge_metadata(old, new).collect()}
    assert (got["A"].category, got["A"].row_count, got["A"].terms) == ("NUEVA", 9, ["control", "dos", "uno"])
    assert got["B"].category == "B" and got["B"].terms == []
    graph = cat.read_graph(spark, str(tmp_path / "g.json"))
    assert sorted(map(tuple, graph.collect())) == [("A", "B"), ("A", "C")]
    held = spark.createDataFrame([("A", "B", "x")], "src string, dst string, column string")
    edges = spark.createDataFrame([("A", "B", ["x"]), ("A", "C", ["y"])], "src string, dst string, columns array<string>")
    assert cat.merge_relations(held, edges).count() == 2


# --- retrieval ---

def _vec(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>, active boolean")


def test_cosine_topk_edges(spark, monkeypatch):
    vectors = _vec(spark, [(1, [0.0, 0.0], True), (2, [2.0, 0.0], True), (3, [1.0, 0.0], True),
                           (4, [-1.0, 0.0], True), (5, [1.0, 0.0], False), (6, [1.0, 1.0], True)])
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, embedding array<float>")
    want = [(1, 2, 1.0), (1, 3, 1.0), (1, 6, 0.707107), (2, 6, 0.707107)]
    got = ret.cosine_topk(vectors, queries, k=3)
    assert sorted((r.query_id, r.id, r.similarity) for r in got.collect()) == want
    everything = ret.cosine_topk(vectors, queries, k=10, threshold=None)
    assert everything.where("query_id = 1").count() == 5
    monkeypatch.setattr(ret, "MAX_SENT_QUERIES", 1)
    monkeypatch.setattr(ret, "QUERY_BLOCK", 1)
    monkeypatch.setattr(ret, "VECTOR_BLOCK", 2)
    blocked = ret.cosine_topk(vectors, queries, k=3)
    assert sorted((r.query_id, r.id, r.similarity) for r in blocked.collect()) == want


def test_topk_keeps_ties_with_the_last_place(spark):
    vectors = _vec(spark, [(i, [1.0, 0.0], True) for i in range(200, 0, -1)])
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    got = ret.cosine_topk(vectors.repartition(3), queries, k=4)
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 4]


def test_synonyms_are_whole_words_in_order(spark):
    df = spark.createDataFrame([("Ventas por sucursal",), ("preventas",), ("punto de venta",)], "q string")
    got = [r.expanded for r in ret.expand_synonyms(df, "q").collect()]
    assert got[0] == "Ventas por sucursal almacén almacenes bodega facturas tickets transacciones"
    assert got[1] == "preventas"
    assert got[2] == "punto de venta almacén sucursal tienda factura ticket transacción"


def test_vectors_of_texts(spark):
    df = spark.createDataFrame([(1, "uno dos dos"), (2, ""), (3, None), (4, "tres")], "id long, text string")
    got = {r.id: np.array(r.embedding) for r in ret.TextVectors(df, "text", 64).add(df, "text").collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-6) and not got[2].any() and not got[3].any()
    model = ret.embed_with(df, "text", lambda texts: np.array([[len(t), 1.0] for t in texts]), 2)
    assert {r.id: r.embedding for r in model.collect()} == {1: [11, 1], 2: [0, 0], 3: [0, 0], 4: [4, 1]}


def test_neighbours_and_expansion(spark):
    edges = spark.createDataFrame([("A", "B"), ("A", "B"), ("C", "A"), ("B", "A"), ("D", "D")], "src string, dst string")
    near = {(r.table_name, r.related): r.direction for r in ret.neighbours(edges).collect()}
    assert near[("A", "B")] == "outgoing" and near[("A", "C")] == "incoming" and near[("D", "D")] == "outgoing"
    hits = spark.createDataFrame([(1, "A", 0.8), (1, "B", 0.6)], "query_id long, table_name string, score double")
    graph = spark.createDataFrame([("A", "A_DETALLE"), ("A", "X"), ("A", "C")], "src string, dst string")
    got = {r.table_name: (round(r.score, 4), r.related) for r in ret.expand_related(hits, edges, graph, most=2).collect()}
    assert got == {"A": (0.8, False), "B": (0.6, False), "C": (0.6, True), "A_DETALLE": (0.56, True), "X": (0.56, True)}


def test_context_score(spark):
    df = spark.createDataFrame([("ventas por cliente", "VENTAS_DET", ["CLIENTE_ID", "X"], "tabla de ventas", 999, 2, 10)],
                               "q string, name string, cols array<string>, d string, n long, fk int, w int")
    imp = ret.importance(c("n"), c("fk"), c("w"), F.lit(False))
    kw = ret.keyword_score(ret.query_words(c("q")), c("name"), c("cols"), c("d"))
    r = df.select(imp.alias("i"), kw.alias("k"), ret.rescore(F.lit(0.5), imp, kw).alias("s")).first()
    assert r.i == pytest.approx(0.5 * 0.4 + 0.4 * 0.3 + 0.2 * 0.2 + 0.1)
    assert r.k == pytest.approx(0.4 + 0.08 + 0.02)
    assert r.s == pytest.approx(0.3 + 0.2 * r.i + 0.2 * r.k)


def test_whole_retrieval_finds_the_table(spark):
    described = spark.createDataFrame(
        [("VENTAS", "registro de facturas y tickets de venta", True, 100), ("CLIENTES", "compradores y cuentas", True, 50),
         ("APAGADA", "facturas tickets", False, 5)],
        "table_name string, description string, active boolean, row_count long").selectExpr(
        "*", "array(named_struct('name', 'id', 'type', 'BIGINT')) columns",
        "cast(array() as array<struct<referenced_table: string>>) foreign_keys")
    questions = spark.createDataFrame([(1, "total de ventas")], "query_id long, question string")
    edges = spark.createDataFrame([("VENTAS", "CLIENTES")], "src string, dst string")
    got = ret.retrieve_tables(questions, described, edges, threshold=0.1).orderBy("place").collect()
    assert [(r.table_name, r.related) for r in got] == [("VENTAS", False), ("CLIENTES", True)]


def test_procedure_search(spark):
    got = ret.keyword_search(ret.procedures(spark), "ventas por periodo", 2).collect()
    assert [r.name for r in got] == ["SP_VENTAS_PERIODO", "SP_EXISTENCIAS_ARTICULO"]
    # "por" is also inside "reportes", so both uses count
    assert got[0].score == pytest.approx(20 + 15 + 20 + 7.5)


def test_vector_store_upsert(spark):
    schema = "table_name string, embedding array<float>, created_at string"
    old = spark.createDataFrame([("A", [1.0], "2024-01-01"), ("B", [2.0], "2024-01-01")], schema)
    new = spark.createDataFrame([("A", [9.0], "2024-01-02")], schema)
    assert {r.table_name: r.embedding for r in ret.upsert_vectors(old, new).collect()} == {"A": [9.0], "B": [2.0]}


# --- query log ---

def test_sql_verdicts(spark):
    cases = [("", "empty"), ("  \n", "empty"), ("SELECT 1", "ok"), ("with a as (select 1) select * from a", "ok"),
             ("DELETE FROM t", "not a select"), ("SELECT 1 -- x", "line comment"), ("SELECT /* x */ 1", "block comment"),
             ("SELECT 1; SELECT 2", "several statements"), ("SELECT 1; ", "ok"),
             ("SELECT 1 UNION SELECT 2", "nested select"), ("SELECT * FROM SP_X", "procedure"),
             ("select 1; drop table t", "statement"), ("SELECT UPDATED FROM T", "ok"), (None, "empty")]
    df = spark.createDataFrame(cases, "q string, want string")
    assert [r.q for r in df.where(log.sql_verdict(c("q")) != c("want")).collect()] == []


def test_tables_and_speed(spark):
    df = spark.createDataFrame([("select * from a join B on 1=1 join a x", 11.0), ("SELECT 1", 5.0), ("from c", 7.0)],
                               "q string, s double")
    assert {r.table_name: r.statements for r in log.table_usage(df, "q").collect()} == {"A": 1, "B": 1, "C": 1}
    assert {r.speed: r.statements for r in log.slow_queries(df, "s").collect()} == {"slow": 1, "ok": 1, "notice": 1}


def test_complexity_golden_values(spark):
    heavy = ["DOCTOS_PV_DET", "EXISTENCIAS", "PRECIOS_ARTICULOS", "CLAVES_ARTICULOS", "DOCTOS_CC_DET"]

    def named(n, h):
        return heavy[:h] + [f"T{i}" for i in range(n - h)]

    cases = [
        ("Dame los clientes activos", named(1, 0), 0, "simple", "light"),
        ("Dame las ventas del mes con total por cliente", named(3, 1), 48, "complex", "strong"),
        ("Análisis de rentabilidad por producto con tendencia mensual y márgenes", named(6, 3), 88, "very_complex", "strong"),
        ("Comparar ventas vs compras por artículo con análisis de rotación, tendencias y proyecciones", named(9, 5), 100,
         "very_complex", "strong"),
        ("Dame el análisis de ventas por cliente con tendencia mensual y margen de utilidad", named(5, 2), 100,
         "very_complex", "strong")]
    df = spark.createDataFrame(cases, "q string, tables array<string>, score int, level string, tier string")
    got = log.complexity(df.select("q", "tables"), "q", c("tables")).collect()
    assert [(r.score, r.level, r.tier) for r in got] == [x[2:] for x in cases]


def test_answers_and_intent(spark):
    text = "Resultado:\n```sql\nSELECT 1\n```\nLa consulta SQL fue\nTotal 5\n\nfrom here on\n"
    df = spark.createDataFrame([(text, "Dame el total"), ("x", "zzz")], "a string, q string")
    r = df.select(log.clean_answer(c("a")).alias("a"), log.asks_for_data(c("q")).alias("i"),
                  log.asks_for_data(c("q"), ["zz"]).alias("own")).collect()
    assert r[0].a == "Resultado:\n\nTotal 5" and r[0].i and not r[1].i and r[1].own


def test_recent_questions(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (" ", 9)], "q string, t int")
    assert [r.q for r in log.recent_questions(df, "q", ["t"], 2).collect()] == ["a", "b"]


def test_shares(spark):
    df = spark.createDataFrame([("x",)] * 2 + [("y",)], "g string")
    assert {r.g: r.percentage for r in ranking.shares(df, "g").collect()} == {"x": 66.7, "y": 33.3}
    assert ranking.shares(df.limit(0), "g").count() == 0


# --- conversations ---

def test_conversations(spark):
    rows = [(1, 0, "assistant", "hola"), (1, 1, "user", "ventas"), (2, 0, "user", "  " + "palabra " * 12), (2, 1, "assistant", "x")]
    messages = spark.createDataFrame(rows, "session long, at int, role string, text string")
    got = {r.session: r for r in cnv.summaries(messages).collect()}
    assert got[1].title == cnv.DEFAULT_TITLE and got[1].preview == "hola" and got[1].user_queries == 1
    assert got[2].title == "palabra palabra palabra palabra palabra palabra..."
    assert [r.session for r in cnv.search(messages, "VENTAS").collect()] == [1]
    assert [r.session for r in cnv.search(messages, "nueva conv").collect()] == [1]


def test_context_cuts_before_it_filters(spark):
    rows = [(1, i, "system" if i > 8 else "user", "t") for i in range(12)]
    messages = spark.createDataFrame(rows, "session long, at int, role string, text string")
    assert sorted(r.at for r in cnv.context(messages).collect()) == [2, 3, 4, 5, 6, 7, 8]


def test_date_buckets(spark):
    days = ["2024-05-10T08:00:00", "2024-05-09", "2024-05-03", "2024-04-10", "2024-04-09", "no date", None]
    df = spark.createDataFrame([(d,) for d in days], "d string")
    got = [r[0] for r in df.select(cnv.date_bucket(c("d"), F.lit("2024-05-10").cast("date"))).collect()]
    assert got == ["Hoy", "Ayer", "Esta semana", "Este mes", "Anteriores", "Anteriores", "Anteriores"]


# --- streams and reports ---

def test_stream_state_continues_where_it_stopped(spark, tmp_path):
    schema = "session long, at int, seq int, role string"
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    parts = [[(1, 1, 1, "user"), (2, 1, 2, "user")], [(1, 5, 3, "assistant"), (1, 0, 4, "late")]]
    seen = []
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/part{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source)
        state.run_to_end(state.session_state(stream), work, "update")
        seen += rows
        now = state.current(spark.read.parquet(f"{work}/changes"), "session")
        batch = state.session_state(spark.createDataFrame(seen, schema))
        assert sorted(map(tuple, now.collect())) == sorted(map(tuple, batch.collect()))


def test_stream_export_appends_new_rows_once(spark, tmp_path):
    source, work = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(2):
        spark.range(n * 3, n * 3 + 3).coalesce(1).write.parquet(f"{source}/part{n}")
        stream = spark.readStream.schema("id long").option("recursiveFileLookup", True).parquet(source)
        path = state.export_new(stream, work, "csv")
    got = spark.read.schema("id long").option("header", True).csv(path)
    assert sorted(r.id for r in got.collect()) == list(range(6))


@pytest.mark.parametrize("fmt", reports.FORMATS)
def test_reports_read_back(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a", None), (2, None, datetime(2024, 1, 2, 3, 4, 5))], "n int, s string, t timestamp_ntz")
    paths = reports.write_report(df, str(tmp_path / "r"), fmt)
    assert set(paths) == {"data", "analysis", "columns", "numbers", "metadata"}
    reader = spark.read.schema(df.schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("timestampNTZFormat", reports.STAMP)
    assert sorted(map(tuple, reader.format(fmt).load(paths["data"]).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        reports.export(df, paths["metadata"], fmt)


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        reports.export(spark.range(1), str(tmp_path / "x"), "pdf")


def test_csv_writes_null_as_nothing(spark, tmp_path):
    path = str(tmp_path / "c")
    assert reports.export(spark.createDataFrame([("a", None)], "x string, y string").coalesce(1), path) == 1
    (file,) = (tmp_path / "c").glob("*.csv")
    assert file.read_text() == "x,y\na,\n"


def test_closed_period_holds_its_last_day(spark):
    from tendero.functions.predicates import in_closed_period
    rows = spark.sql("select timestamp_ntz '2001-01-31 18:00:00' as at union all select timestamp_ntz '2001-02-01 00:00:00'")
    assert rows.where(in_closed_period(F.col("at"), "2001-01-01", "2001-01-31")).count() == 1


def test_whole_numbers_have_no_decimals(spark):
    from tendero.functions.columns import thousands
    row = spark.sql("select 1234 as a, 5.0D as b, cast(null as int) as n").select(*[thousands(x) for x in "abn"]).first()
    assert tuple(row) == ("1,234", "5.00", "N/A")


def test_graph_places_go_hit_by_hit(spark):
    from tendero.operators.retrieval import expand_related
    hits = spark.createDataFrame([(1, "A", 0.9), (1, "B", 0.8)], "query_id long, table_name string, score double")
    edges = spark.createDataFrame([], "src string, dst string")
    graph = spark.createDataFrame([("A", "X1"), ("B", "X1"), ("B", "X2")], "src string, dst string")
    got = {r.table_name: r.via for r in expand_related(hits, edges, graph, most=1).collect() if r.related}
    assert got == {"X1": "Tabla relacionada con A", "X2": "Tabla relacionada con B"}


def test_stream_reads_files_and_folders(spark, tmp_path):
    from tendero.streaming.state import stream_table
    rows = spark.range(100)
    rows.repartition(3).write.parquet(f"{tmp_path}/things.parquet")
    rows.toPandas().to_parquet(f"{tmp_path}/other.parquet")
    rows.toPandas().to_parquet(f"{tmp_path}/other2.parquet")
    for name in ("things", "other"):
        query = (stream_table(spark, str(tmp_path), name).writeStream.format("memory").queryName(f"seen_{name}")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        assert spark.table(f"seen_{name}").count() == 100
    with pytest.raises(Exception):
        stream_table(spark, str(tmp_path), "missing")
