"""Table sources and the binding of the sales model to stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendero.functions.columns import minor, total

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Declared keys and references of the stored tables (SRC-8, SRC-9). A reference
# is (table, columns, referenced table, referenced columns), columns in order.
PRIMARY_KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",),
    "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",),
    "documents": ("doc_id",), "embeddings": ("vec_id",), "labels": ("doc_id",),
    "conversations": ("conv_id", "turn"), "pages": ("page_id",), "benchmark": ("item_id",),
}
FOREIGN_KEYS = (
    ("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    ("lineitem", ("l_partkey",), "part", ("p_partkey",)),
    ("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
    ("orders", ("o_custkey",), "customer", ("c_custkey",)),
    ("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    ("supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    ("nation", ("n_regionkey",), "region", ("r_regionkey",)),
    ("labels", ("doc_id",), "documents", ("doc_id",)),
)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One stored table; filters and column lists reach the parquet scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str, lower: str,
              upper: str, partitions: int, fetch_rows: int = 5000, **options: str) -> DataFrame:
    """A relational source read in parallel key ranges, read-only (SRC-2, SRC-5).

    5000 rows per fetch is the batch of the interactive cursor; the number of
    ranges sets how many tasks pull at once.
    """
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=partition_column, lowerBound=lower,
                 upperBound=upper, numPartitions=str(partitions), fetchsize=str(fetch_rows),
                 **options)
        .load()
    )


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int) -> None:
    """Store a table bucketed and sorted on its join key.

    Headers and lines stored this way with equal bucket counts join on the
    document without a shuffle of either side.
    """
    (df.write.mode("overwrite").format("parquet")
       .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table))


class Tables:
    """The stored tables, and the sales model bound to them.

    Only the columns an operator names are read: each view below is a
    projection that Catalyst prunes down to the scan.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self._read: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        if name not in self._read:  # the schema is looked up once per table
            self._read[name] = read_table(self.spark, self.root, name)
        return self._read[name]

    @property
    def headers(self) -> DataFrame:
        """Document headers. ``placed_at`` is the stored column, for pushed filters."""
        c = F.col
        return self.orders.select(
            c("o_orderkey").alias("doc_id"), c("o_custkey").alias("customer_id"),
            c("o_orderdate").alias("placed_at"), c("o_orderdate").cast("date").alias("day"),
            c("o_orderstatus").alias("doc_type"), c("o_orderpriority").alias("seller"),
            minor("o_totalprice").alias("doc_total"),
        )

    @property
    def lines(self) -> DataFrame:
        """Document lines with their measures in minor units (``columns.PLACES``)."""
        c = F.col
        gross, rate = minor("l_extendedprice"), minor("l_discount")
        return self.lineitem.select(
            c("l_orderkey").alias("doc_id"), c("l_linenumber").alias("line_no"),
            c("l_partkey").alias("article_id"), c("l_suppkey").alias("warehouse_id"),
            minor("l_quantity").alias("units"), gross.alias("gross"),
            (gross * (100 - rate)).alias("net"),
            (gross * rate).alias("discount"),
            (c("l_returnflag") == "R").alias("is_return"), c("l_returnflag").alias("flag"),
            c("l_shipdate").alias("moved_at"), c("l_shipdate").cast("date").alias("moved_day"),
        )

    @property
    def articles(self) -> DataFrame:
        """Articles; the PROMO line stands for articles that are no longer active."""
        c = F.col
        return self.part.select(
            c("p_partkey").alias("article_id"), c("p_name").alias("article"),
            c("p_brand").alias("code"), c("p_type").alias("line"),
            minor("p_retailprice").alias("cost"),
            (c("p_size") * 5).alias("minimum"), (c("p_type") != "PROMO").alias("active"),
        )

    @property
    def customers(self) -> DataFrame:
        c = F.col
        return self.customer.select(
            c("c_custkey").alias("customer_id"), c("c_name").alias("customer"),
            c("c_nationkey").alias("nation_id"), c("c_mktsegment").alias("segment"),
        )

    @property
    def warehouses(self) -> DataFrame:
        """Suppliers, which stand for warehouses at line level."""
        c = F.col
        return self.supplier.select(
            c("s_suppkey").alias("warehouse_id"), c("s_name").alias("warehouse"),
            c("s_nationkey").alias("nation_id"),
        )

    @property
    def zones(self) -> DataFrame:
        """Nation with its region: 25 rows, whatever the size of the facts."""
        return (
            self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("nation"),
                    F.col("r_name").alias("zone"))
        )

    @property
    def stock(self) -> DataFrame:
        """Stock of each article in each warehouse (one row per pair)."""
        return (
            self.lines.where("is_return").groupBy("article_id", "warehouse_id")
            .agg(total("units").alias("stock"))
        )

    @property
    def stock_by_article(self) -> DataFrame:
        """Stock summed to the article before any join, so no code fans it out."""
        return (self.lines.where("is_return").groupBy("article_id")
                .agg(total("units").alias("stock")))

    def as_of(self):
        """Last document day as a scalar subquery: no date of the clock is used."""
        return self.headers.agg(F.max("day")).scalar()
