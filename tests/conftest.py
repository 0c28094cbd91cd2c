import pytest

from tendero.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, partitions=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_tables(spark, tmp_path):
    """Stored tables from rows, with the columns the sales model reads."""
    from tendero.sources.tables import Tables
    schemas = {
        "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                  "o_orderdate timestamp_ntz, o_orderpriority string",
        "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                    "l_linestatus string, l_shipdate timestamp_ntz",
        "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
        "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
        "nation": "n_nationkey int, n_name string, n_regionkey int",
        "region": "r_regionkey int, r_name string",
    }

    def make(**rows):
        for name, schema in schemas.items():
            spark.createDataFrame(rows.get(name, []), schema).coalesce(1).write.parquet(
                f"{tmp_path}/{name}.parquet")
        return Tables(spark, str(tmp_path))

    return make
