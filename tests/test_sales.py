"""Edge rows of the sales rules: one small table per rule."""

import itertools
import random
from collections import Counter
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tendero.functions import columns as col
from tendero.functions import predicates as pred
from tendero.operators import baskets, ranking, sales, widening
from tendero.operators.reads import preview, sample_text

D0 = datetime(2024, 5, 10)


def order(key, day=D0, kind="F", customer=1, total=10.0):
    return (key, customer, kind, total, day, "1-URGENT")


def line(doc, article=1, units=1.0, gross=10.0, discount=0.0, number=1, flag="N", moved=D0, supplier=1):
    return (doc, article, supplier, number, units, gross, discount, 0.0, flag, "O", moved)


def part(key, name="x", kind="ECONOMY", size=1, cost=5.0):
    return (key, name, "B", kind, size, cost)


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_measures_must_be_positive(make_tables):
    t = make_tables(orders=[order(1)], part=[part(1)], lineitem=[
        line(1, units=0.0), line(1, units=-1.0), line(1, units=None), line(1, gross=0.0), line(1, number=2)])
    assert sales.sale_lines(t).count() == 1
    r = sales.sale_filter_funnel(t).first()
    assert (r.all_lines, r.with_units, r.with_price, r.with_article, r.all_filters) == (5, 2, 4, 5, 1)


def test_unknown_articles_stay_only_in_the_null_keeping_form(spark):
    names = spark.createDataFrame([(1, None), (2, "VENTA GLOBAL"), (3, "venta global"), (4, "CORTE DE CAJA"),
                                   (5, "MARTILLO")], "id int, n string")
    kept = names.where(pred.real_article(F.col("n")))
    assert values(kept, "id") == [(1,), (3,), (5,)]
    assert values(names.where(pred.real_article(F.col("n"), keep_unknown=False)), "id") == [(3,), (5,)]
    assert values(names.where(pred.is_system(F.col("n"))), "id") == [(2,), (4,)]


def test_code_and_customer_rules(spark):
    df = spark.createDataFrame([("AB123", "CLIENTE MOSTRADOR"), ("GLOBAL", "USO INTERNO 1"), (None, "ANA"),
                                ("XSYS", "LUIS"), ("A1", "PEPE")], "code string, who string")
    assert values(df.where(pred.real_code(F.col("code"))), "code") == [("A1",), ("AB123",), ("XSYS",)]
    assert values(df.where(pred.real_customer(F.col("who"))), "who") == [("ANA",), ("LUIS",), ("PEPE",)]
    assert values(df.where(pred.odd_code(F.col("code"))), "code") == [("AB123",), ("GLOBAL",), ("XSYS",)]


def test_edge_case_filter_reads_the_schema(spark):
    df = spark.createDataFrame(
        [(1, "ajuste de precio", "x"), (2, "tornillo", "CORTE"), (3, None, None)],
        "id int, DESCRIPCION1 string, OTRA string")
    assert values(pred.drop_edge_cases(df), "id") == [(2,), (3,)]


def test_several_codes_do_not_multiply_stock(make_tables):
    t = make_tables(part=[part(1, size=2), part(2, size=2), part(3, size=1, kind="PROMO")],
                    supplier=[(1, "S1", 0, 0.0), (2, "S2", 0, 0.0)],
                    lineitem=[line(1, 1, 4.0, flag="R"), line(1, 1, 4.0, flag="R", supplier=2)])
    assert values(sales.low_stock(t), "article_id", "stock", "supplier") == [
        (1, Decimal("8.00"), "S1"), (2, None, None)]


def test_stock_of_one_article_and_warehouse(make_tables):
    t = make_tables(lineitem=[line(1, 1, 4.0, flag="R"), line(1, 1, 3.0, flag="R", supplier=2), line(1, 2, 9.0, flag="R")])
    assert values(sales.stock_of(t, 1), "warehouse_id", "stock") == [(1, Decimal("4.00")), (2, Decimal("3.00"))]
    assert values(sales.stock_of(t, 1, 2), "stock") == [(Decimal("3.00"),)]
    assert sales.stock_of_article(t, 1).first().stock == Decimal("7.00")


def test_last_sale_skips_system_articles_and_keeps_orphans(make_tables):
    t = make_tables(
        orders=[order(1, datetime(2024, 5, 1)), order(2, datetime(2024, 5, 2)), order(3, datetime(2024, 5, 3), "P")],
        part=[part(1, "CORTE DE CAJA")], lineitem=[line(1, 99), line(2, 1), line(3, 99)])
    r = sales.last_sale(t).collect()
    assert [(x.doc_id, x.article, x.amount) for x in r] == [(1, None, Decimal("10.0000"))]


@pytest.mark.parametrize("old,days", [(datetime(2024, 1, 1), 180), (datetime(2023, 7, 1), 365), (datetime(2020, 1, 1), None)])
def test_widening_takes_the_first_window_with_rows(spark, make_tables, old, days):
    t = make_tables(orders=[order(1, D0, "P"), order(2, old, customer=7)], part=[part(1)], lineitem=[line(2)])
    assert widening.widened_last_sale(t).first().doc_id == 2
    found = widening.widen_by_key(sales.sale_docs(t), "placed_at", ["customer_id"], t.as_of())
    assert values(found, "customer_id", "days") == [(7, days)]
    bounded = widening.widen_by_key(sales.sale_docs(t), "placed_at", ["customer_id"], t.as_of(), unbounded=False)
    assert bounded.count() == (0 if days is None else 1)
    _, used = widening.first_non_empty(
        lambda n: sales.sale_docs(t).where(pred.trailing(F.col("placed_at"), "2024-05-10", n or 99999)), unbounded=False)
    assert used == (365 if days is None else days)


def test_growth_with_missing_and_zero_months(make_tables):
    days = [datetime(2024, m, 1) for m in (1, 2, 4)]
    t = make_tables(customer=[(1, "A", 0, 0.0, "X")], orders=[order(i, d) for i, d in enumerate(days)],
                    lineitem=[line(0, gross=0.0), line(1, gross=10.0), line(2, gross=15.0)])
    assert [r.growth_pct for r in sales.monthly_growth(t).collect()] == [None, None, 50.0]
    trend = sales.customer_trend(t).collect()
    assert [(r.month, r.growth_pct, round(r.mean_3m, 4)) for r in trend] == [(4, 50.0, round(25 / 3, 4))]


def test_sums_pass_the_range_of_a_long(spark):
    df = spark.range(0, 1000).select(F.lit(9 * 10**18).alias("net"), F.lit(-(7 * 10**18) - 3).alias("units"))
    r = df.agg(col.total("net").alias("n"), col.total("units").alias("u")).first()
    assert r.n == Decimal(9 * 10**21) / 10**4
    assert r.u == Decimal(-(7 * 10**18 + 3) * 1000) / 100
    twice = df.groupBy(F.rand(1) > 0.5).agg(*col.halves("net")).agg(col.rolled("net").alias("n")).first()
    assert twice.n == r.n


def test_minor_units_are_the_stored_cents(spark):
    cents = spark.range(0, 200_000).select("id", col.minor(F.col("id") / 100).alias("m"))
    assert cents.where("m != id").count() == 0


@pytest.mark.parametrize("tied", [False, True])
def test_running_total_matches_a_plain_loop(spark, tied):
    rng = random.Random(3)
    rows = [(i, float(7 if tied and i % 3 else rng.randint(1, 500))) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, v double")
    got = {r.id: r.running for r in ranking.running_total(df, "v", "id", cuts=32).collect()}
    running = 0.0
    for i, v in sorted(rows, key=lambda r: (-r[1], r[0])):
        running += v
        assert got[i] == running
    assert len(got) == len(rows)


def test_abc_class_counts_the_share_before(make_tables):
    t = make_tables(orders=[order(1)], part=[part(i) for i in range(1, 5)], lineitem=[
        line(1, 1, gross=80.0), line(1, 2, gross=14.0), line(1, 3, gross=5.0), line(1, 4, gross=1.0)])
    got = {r.article_id: r for r in ranking.abc(t).collect()}
    assert [got[i]["class"] for i in (1, 2, 3, 4)] == ["A", "B", "B", "C"]
    assert got[4].share == 1.0


@pytest.mark.parametrize("least,large", [(1, 3), (2, 3), (3, 3), (2, 1), (2, 50)])
def test_cross_sell_is_exact_for_large_baskets(make_tables, least, large):
    rng = random.Random(least * 10 + large)
    rows = []
    for doc in range(25):
        size = 18 if doc in (3, 4, 5) else rng.randint(1, 5)
        rows += [line(doc, a) for a in rng.sample(range(20), size) for _ in range(rng.randint(1, 2))]
    want = Counter()
    for doc in range(25):
        bought = sorted({r[1] for r in rows if r[0] == doc})
        want.update(itertools.combinations(bought, 2))
    got = {(r.left_article, r.right_article): r.documents
           for r in baskets.cross_sell(make_tables(lineitem=rows), least, large).collect()}
    assert got == {k: n for k, n in want.items() if n >= least}


def test_cross_sell_has_more_partitions_for_more_pairs(make_tables, monkeypatch):
    rows = [line(doc, a) for doc in range(40) for a in range(doc % 3, 6)]
    t = make_tables(lineitem=rows)
    whole = {tuple(r) for r in baskets.cross_sell(t).collect()}
    monkeypatch.setattr(baskets, "PART_ROWS", 20, raising=False)
    parted = baskets.cross_sell(t)
    assert parted.rdd.getNumPartitions() > 20 and {tuple(r) for r in parted.collect()} == whole


def test_preview_flags_more(spark):
    df = spark.range(0, 5)
    assert [(r.id, r.has_more) for r in preview(df, 3, ["id"]).collect()] == [(0, True), (1, True), (2, True)]
    assert {r.has_more for r in preview(df, 5, ["id"]).collect()} == {False}


def test_sample_text(spark):
    df = spark.createDataFrame([(1, "a" * 60), (2, None)], "id int, s string")
    assert [tuple(r) for r in sample_text(df, 5, ["id"]).collect()] == [("1", "a" * 47 + "..."), ("2", "NULL")]


def test_scalar_functions(spark):
    row = spark.sql("""SELECT 1234.5D x, cast(null as double) n, 'select 1 -- c
        /* b */  from t' q, 'abcdefgh' s, timestamp_ntz'2024-01-02 03:04:05' ts,
        'una pregunta muy larga sobre las ventas del mes en la sucursal' t""").select(
        col.thousands("x"), col.thousands("n"), col.plain_sql("q"), col.shorten("s", 6), col.shorten("s", 8),
        col.stamp("ts"), col.stamp("ts", False), col.title_of("t"), col.volume_label(F.lit(150)),
        col.volume_label(F.lit(123456)), col.log_volume(F.lit(999999)),
        col.margin(F.lit(15.0), F.lit(0.0)), col.pending("x", F.lit(None)),
        col.tax_identity(F.lit(10.0), F.lit(1.6), F.lit(11.6))).first()
    assert tuple(row) == ("1,234.50", "N/A", "select 1 from t", "abc...", "abcdefgh", "2024-01-02 03:04:05",
                          "2024-01-02", "una pregunta muy larga sobre las ventas del mes...",
                          "catálogo mediano (150 registros)", "volumen muy alto (123,456 registros)", 1.0, None,
                          1234.5, True)


def test_batches(spark):
    from tendero.operators.reads import batches
    assert [len(b) for b in batches(spark.range(0, 12), 5)] == [5, 5, 2]
