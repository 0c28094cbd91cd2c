"""Catalog jobs: one row per table, tagged by rules over names, columns and counts.

A catalog row holds ``table_name``, ``row_count``, ``columns`` (array of name and
type, in position order), ``primary_key`` and ``foreign_keys`` (array of ordered
column pairs). Rules are expressions over that row: no join, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendero import dictionaries as D
from tendero.functions.columns import volume_label
from tendero.functions.predicates import any_of
from tendero.operators.profiling import freshness, table_stats
from tendero.operators.reads import sample_rows
from tendero.sources.snapshots import SnapshotTable

c = F.col

TABLE_SCHEMA = """table_name string, columns array<struct<name: string, type: string>>,
 primary_key array<string>, foreign_keys array<struct<referenced_table: string,
 columns: array<string>, referenced_columns: array<string>>>"""

_TYPE_NAMES = {
    "short": "SMALLINT", "integer": "INTEGER", "long": "BIGINT", "float": "FLOAT",
    "double": "DOUBLE PRECISION", "date": "DATE", "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP", "string": "VARCHAR", "boolean": "BOOLEAN", "binary": "BLOB",
}


def type_name(dt: T.DataType) -> str:
    """Catalog name of a Spark type; nested types have none in the model."""
    if isinstance(dt, T.DecimalType):
        return f"NUMERIC({dt.precision},{dt.scale})"
    return _TYPE_NAMES.get(dt.typeName(), "UNKNOWN")


def table_catalog(spark: SparkSession, tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]],
                  edges) -> DataFrame:
    """One row per table: schema and declared keys, with the row count (SRC-6 .. SRC-9).

    Composite references keep their column pairs in order.
    """
    rows = []
    for name, df in tables.items():
        cols = [(f.name, type_name(f.dataType)) for f in df.schema.fields]
        refs = [(target, list(a), list(b)) for table, a, target, b in edges if table == name]
        rows.append((name, cols, list(keys.get(name, ())), refs))
    described = spark.createDataFrame(rows, TABLE_SCHEMA)
    return described.join(table_stats(tables).select("table_name", "row_count"), "table_name")


def catalog_columns(catalog: DataFrame) -> DataFrame:
    """One row per column, by position (SRC-7)."""
    return catalog.select("table_name", "row_count", F.posexplode("columns").alias("position", "col")).select(
        "table_name", "position", c("col.name").alias("name"), c("col.type").alias("type"), "row_count")


def find_columns(columns: DataFrame, part: str) -> DataFrame:
    """Columns whose name holds a text, whatever its case (SRC-11)."""
    return columns.where(F.upper("name").contains(part.upper())).orderBy("table_name", "position")


def fk_edges(catalog: DataFrame) -> DataFrame:
    """One row per reference (SRC-9)."""
    return catalog.select("table_name", F.explode("foreign_keys").alias("fk")).select(
        c("table_name").alias("src"), c("fk.referenced_table").alias("dst"),
        c("fk.columns").alias("columns"), c("fk.referenced_columns").alias("referenced_columns"))


# --- rules -----------------------------------------------------------------------

def has_word(text: Column, words: Sequence[str]) -> Column:
    """The text holds one of the words as a substring: one alternation, one pass."""
    return text.rlike("|".join(re.escape(w) for w in words))


def column_has(words: Sequence[str]) -> Column:
    """Some column name holds one of the words (which have no spaces)."""
    return has_word(F.lower(F.array_join(c("columns.name"), " ")), words)


def columns_with(words: Sequence[str]) -> Column:
    """Names of the columns that hold one of the words, by position."""
    return F.filter(c("columns.name"), lambda n: has_word(F.lower(n), words))


def active(name: str = "table_name") -> Column:
    """Whether a table is in use (CAT-1): the first rule that applies decides."""
    upper = F.upper(name)
    refs, few = F.size("foreign_keys") > 0, c("row_count").between(1, 99)
    dead = any_of([upper.startswith(p) for p in D.INACTIVE_PREFIXES]
                  + [upper.endswith(s) for s in D.INACTIVE_SUFFIXES])
    alive = (has_word(upper, D.CATALOG_WORDS) | refs | (F.size("columns") > 15)
             | (few & has_word(upper, D.MASTER_WORDS)) | (c("row_count") > 0))
    return F.when(dead, F.lit(False)).otherwise(alive)


def relevance() -> Column:
    """Weight of a table in the catalog (CAT-3); above 10 it is kept."""
    rows = F.when(c("row_count") > 0, F.least(c("row_count") / 1000, F.lit(100.0))).otherwise(0.0)
    return (rows + F.size("foreign_keys") * 10 + F.when(c("active"), 20).otherwise(0)
            + F.size("columns") * 2 + F.when(F.size("primary_key") > 0, 15).otherwise(0))


def semantic_fields() -> Column:
    """Meanings found among the columns, sorted (CAT-6)."""
    found = F.array(*[F.when(column_has(words), F.lit(label)) for label, words in D.FIELD_MEANINGS.items()])
    return F.array_sort(F.filter(found, lambda x: x.isNotNull()))


def category(name: str = "table_name") -> Column:
    """Category by name, then by content, else OTROS (CAT-5)."""
    lower = F.lower(name)
    fields = c("semantic_fields")
    rules = [(has_word(lower, words), label) for label, words in D.CATEGORIES]
    rules.append((F.array_contains(fields, "importes y precios")
                  & F.array_contains(fields, "fechas y tiempos"), "TRANSACCIONES"))
    rules.append((F.array_contains(fields, "nombres y descripciones") & (F.size("columns") <= 10),
                  "CATALOGOS"))
    return F.coalesce(*[F.when(test, F.lit(label)) for test, label in rules], F.lit("OTROS"))


def semantic_summary() -> Column:
    """Column names by meaning, a few of each (CAT-7)."""
    parts = []
    for label, words, most in D.SUMMARY_PARTS:
        names = columns_with(tuple(words) + tuple(D.SUMMARY_ENGLISH[label]))
        text = F.concat(F.lit(f"{label}: "), F.array_join(F.slice(names, 1, most), ", "))
        parts.append(F.when(F.size(names) > 0, text))
    return F.concat_ws(" | ", *parts)


def purpose(name: str = "table_name") -> Column:
    """What the table is for, in sentences (CAT-8)."""
    lower = F.lower(name)
    said = []
    for rule in D.PURPOSES:
        sentences = [F.lit(rule["says"])]
        if "detail" in rule:
            sentences.append(F.when(has_word(lower, rule["detail"]), rule["detail_says"])
                             .otherwise(rule["header_says"]))
        sentences += [F.when(column_has(words), F.lit(s)) for words, s in rule.get("columns", ())]
        sentences += [F.when(has_word(lower, words), F.lit(s)) for words, s in rule.get("table", ())]
        text = F.concat_ws(". ", *sentences)
        if "needs" in rule:
            text = F.when(column_has(rule["needs"]), text).otherwise(F.lit(""))
        said.append(F.when(has_word(lower, rule["name"]), text))
    generic = (
        F.when(column_has(("fecha",)) & column_has(("importe", "monto")), F.lit(D.PURPOSE_TRANSACTIONS))
        .when(column_has(("nombre", "descripcion")), F.lit(D.PURPOSE_CATALOG))
        .otherwise(F.concat(F.lit("Tabla "), lower)))
    return F.coalesce(F.nullif(F.coalesce(*said), F.lit("")), generic)


def search_terms(name: str = "table_name", most: int = 25) -> Column:
    """Terms a user may search the table by: distinct, sorted, then cut (CAT-14, SET-2)."""
    lower = F.lower(name)

    def when(test: Column, terms: Sequence[str]) -> Column:
        words = F.array(*[F.lit(w) for w in terms])
        return F.when(test, words).otherwise(F.array().cast("array<string>"))

    lists = [when(lower.contains(k), v[:8]) for k, v in D.SEARCH_TERMS.items()]
    lists.append(F.array(*[F.lit(w) for w in D.GENERAL_TERMS]))
    lists += [when(column_has(words), terms) for words, terms in D.COLUMN_TERMS]
    lists += [when(has_word(lower, words), terms) for words, terms in D.NAME_TERMS]
    return F.slice(F.array_sort(F.array_distinct(F.concat(*lists))), 1, most)


def tag_tables(catalog: DataFrame) -> DataFrame:
    """All rules over the catalog (CAT-1, 3, 5 .. 8, 14)."""
    return (
        catalog.withColumn("active", active())
        .withColumn("relevance", relevance()).withColumn("kept", c("relevance") > 10)
        .withColumn("semantic_fields", semantic_fields()).withColumn("category", category())
        .withColumn("summary", semantic_summary()).withColumn("purpose", purpose())
        .withColumn("terms", search_terms()).withColumn("volume", volume_label("row_count"))
    )


# --- samples -----------------------------------------------------------------------

def describe_sample(name: str, df: DataFrame, order: Sequence[str], rows: int = 10) -> DataFrame:
    """Examples and patterns of a table from its first rows in key order (PRF-9 .. PRF-11).

    At most ``rows`` rows of the listed columns are gathered, whatever the table holds.
    """
    fields = df.schema.fields
    sample = sample_rows(df, rows, list(order))
    shown = [f for f in fields[:8] if isinstance(f.dataType, (T.StringType, T.NumericType, T.DateType,
                                                             T.TimestampType, T.TimestampNTZType))]
    seq = F.struct(*order)
    parts = [_example(f, seq) for f in shown]
    notes = _patterns(fields, seq)
    return sample.agg(
        F.array_join(F.slice(F.filter(F.array(*parts), lambda x: x.isNotNull()), 1, 6), " | ").alias("examples"),
        F.concat_ws(" | ", *notes).alias("patterns"),
    ).withColumn("table_name", F.lit(name)).select("table_name", "examples", "patterns")


def _first_last(name: str, seq: Column) -> tuple[Column, Column]:
    key = F.when(c(name).isNotNull(), seq)
    return F.min_by(name, key), F.max_by(name, key)


def _example(f: T.StructField, seq: Column) -> Column:
    n, label = f.name, F.lit(f"{f.name}: ")
    if isinstance(f.dataType, T.StringType):
        values = F.slice(F.array_sort(F.collect_set(n)), 1, 5)
        short = F.forall(values, lambda v: F.length(v) < 50)
        listed = F.concat(label, F.lit('"'), F.array_join(values, ", "), F.lit('"'))
        first = F.concat(F.lit(f'{n} ejemplo: "'), F.substring(F.get(values, F.lit(0)), 1, 40), F.lit('"'))
        return F.when(F.size(values) == 0, None).when(short, listed).otherwise(first)
    if isinstance(f.dataType, T.NumericType):
        lo, hi = F.min(c(n).cast("double")), F.max(c(n).cast("double"))
        spread = F.format_string(f"{n}: rango %.2f a %.2f", lo, hi)
        return F.when(lo.isNull(), None).when(lo == hi, F.concat(label, lo.cast("string"))).otherwise(spread)
    first, last = (F.substring(x.cast("string"), 1, 10) for x in _first_last(n, seq))
    return F.when(first.isNull(), None).when(first == last, F.concat(label, first)).otherwise(
        F.concat(label, F.lit("desde "), first))


def _patterns(fields, seq: Column) -> list[Column]:
    notes = []
    dated = [f for f in fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    for f in dated[:2]:
        first, last = (F.substring(x.cast("string"), 1, 10) for x in _first_last(f.name, seq))
        notes.append(F.when(last.rlike("2024|2025"), F.lit("datos operacionales actuales"))
                     .when(first != last, F.concat(F.lit("datos desde "), F.substring(first, 1, 4))))
    ids = [f.name for f in fields[:5] if isinstance(f.dataType, T.IntegralType)
           and any(w in f.name.lower() for w in D.SEQUENCE_WORDS)]
    if ids:
        # The mean of consecutive differences is (last - first) / (n - 1) (WIN-11).
        steps = []
        for n in ids:
            first, last = _first_last(n, seq)
            gap = F.try_divide((last - first).cast("double"), F.count(n) - 1)
            steps.append((F.count(n) >= 3) & (gap > 0) & (gap < 100))
        notes.append(F.when(any_of(steps), F.lit("registros secuenciales")))
    named = [f.name for f in fields[:3] if any(w in f.name.lower() for w in D.NAME_WORDS)]
    if named:
        unique = [(F.count(n) > 0) & (F.size(F.collect_set(n)) == F.count(n)) & (F.count(n) < 20)
                  for n in named]
        notes.append(F.when(any_of(unique), F.lit("catálogo maestro")))
    if sum(any(w in f.name.lower() for w in D.MONEY_WORDS) for f in fields) >= 2:
        notes.append(F.lit("gestión financiera"))
    if any(any(w in f.name.lower() for w in D.AUDIT_WORDS) for f in fields):
        notes.append(F.lit("con auditoría"))
    return notes or [F.lit(None).cast("string")]


def sample_descriptions(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        describe_sample(name, df, keys[name]) for name, df in tables.items() if name in keys])


def full_descriptions(tagged: DataFrame, samples: DataFrame) -> DataFrame:
    """Description of every table as one text (CAT-15): empty parts are skipped."""
    def part(label: str, value: Column) -> Column:
        return F.when(F.length(value) > 0, F.concat(F.lit(label), value))

    refs = F.array_join(F.array_sort(F.array_distinct(
        F.transform("foreign_keys", lambda k: k["referenced_table"]))), ", ")
    text = F.concat_ws(
        " | ", c("purpose"), part("Categoría: ", F.lower(F.translate("category", "_", " "))),
        part("", c("summary")), part("Ejemplos: ", c("examples")), part("Características: ", c("patterns")),
        part("Relacionada con: ", refs),
        F.when(c("row_count") > 0, F.concat(F.lit("Volumen: "), c("volume"))),
        part("Términos: ", F.array_join("terms", ", ")))
    return tagged.join(samples, "table_name", "left").withColumn("description", text)


# --- metadata over time ---------------------------------------------------------------

def described_tables(spark: SparkSession, tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], edges) -> DataFrame:
    """The tagged catalog with samples and descriptions: one row per table, made from its data."""
    tagged = tag_tables(table_catalog(spark, tables, keys, edges))
    return full_descriptions(tagged, sample_descriptions(tables, keys))


def refresh_catalog(store: SnapshotTable | str, spark: SparkSession, tables: Mapping[str, DataFrame],
                    keys: Mapping[str, Sequence[str]], edges, as_of: datetime, ttl_hours: float = 12, force: bool = False) -> SnapshotTable:
    """Brings a stored catalog up to date (SRC-14, CAT-16, PRF-15) and returns it.

    Tables that are new, or whose count is older than its time to live, are read and described
    again; those that are gone get a tombstone; all others are not touched. A run that dies leaves the
    catalog as it was. What is read back before is one short row per table.
    """
    def work(names) -> DataFrame:
        return described_tables(spark, {n: tables[n] for n in names}, keys, edges).withColumn("counted_at", F.lit(as_of).cast("timestamp"))

    if isinstance(store, str):
        store = SnapshotTable.create(spark, store, work(list(tables)[:1]).schema, ["table_name"])
    known = {r["table_name"]: r["stale"] for r in freshness(store.read().select("table_name", "counted_at"), F.lit(as_of), ttl_hours)
             .select("table_name", "stale").collect()}
    todo = [n for n in tables if force or known.get(n, True)]
    if todo:
        store.upsert(work(todo))
    if gone := sorted(set(known) - set(tables)):
        store.delete(spark.createDataFrame([(n,) for n in gone], "table_name string"))
    return store


def merge_metadata(existing: DataFrame, analysis: DataFrame, most: int = 25) -> DataFrame:
    """New analysis over stored metadata (CAT-16).

    Both hold table_name, category, row_count, purpose, terms. New values win, tables
    known to one side only stay, terms are united with the long words of the purpose.
    """
    words = F.slice(F.filter(F.split(F.lower("new.purpose"), r"\s+"),
                             lambda w: (F.length(w) > 4) & w.rlike(r"^\p{L}+$")), 1, 5)
    none = F.array().cast("array<string>")
    terms = F.array_union(F.coalesce("old.terms", none),
                          F.array_union(F.coalesce("new.terms", none), F.coalesce(words, none)))
    merged = existing.alias("old").join(analysis.alias("new"),
                                        c("old.table_name") == c("new.table_name"), "full")
    return merged.select(
        F.coalesce("new.table_name", "old.table_name").alias("table_name"),
        F.coalesce("new.category", "old.category", F.lit("OTROS")).alias("category"),
        F.coalesce("new.row_count", "old.row_count").alias("row_count"),
        F.coalesce("new.purpose", "old.purpose").alias("purpose"),
        F.slice(F.array_sort(terms), 1, most).alias("terms"))


def merge_relations(existing: DataFrame, edges: DataFrame) -> DataFrame:
    """Relations append-if-new (CAT-16, SET-3)."""
    cols = ["src", "dst", "column"]
    return existing.select(*cols).unionByName(
        edges.select("src", "dst", F.get("columns", F.lit(0)).alias("column"))).dropDuplicates(cols)


def category_index(tagged: DataFrame) -> DataFrame:
    """Tables of each category, largest first (AGG-14, CAT-16)."""
    return (tagged.groupBy("category").agg(F.count("*").alias("tables"))
            .orderBy(c("tables").desc(), "category"))


def most_connected(edges: DataFrame, k: int = 10) -> DataFrame:
    """Tables with the most distinct references (CAT-17)."""
    return (edges.groupBy(c("src").alias("table_name")).agg(F.countDistinct("dst").alias("connections"))
            .orderBy(c("connections").desc(), "table_name").limit(k))


def enrichment_report(tagged: DataFrame, edges: DataFrame) -> DataFrame:
    """Totals, tables by category, most connected tables as one list (CAT-17)."""
    totals = tagged.agg(F.count("*").alias("a"), F.countDistinct("category").alias("b"),
                        F.count_if(F.size("terms") > 0).alias("c"),
                        F.count_if(F.size("foreign_keys") > 0).alias("d"))
    rows = totals.select(F.explode(F.array(*[
        F.struct(F.lit("totals").alias("section"), F.lit(label).alias("item"), c(n).alias("value"))
        for label, n in (("tables", "a"), ("categories", "b"), ("with terms", "c"), ("with relations", "d"))
    ])).alias("r")).select("r.*")
    by_category = category_index(tagged).select(
        F.lit("categories").alias("section"), c("category").alias("item"), c("tables").alias("value"))
    linked = most_connected(edges).select(
        F.lit("connections").alias("section"), c("table_name").alias("item"), c("connections").alias("value"))
    return rows.unionByName(by_category).unionByName(linked)


def extraction_check(catalog: DataFrame, per_table: int = 3, overall: int = 10) -> DataFrame:
    """Reference counts and a few examples, three per table, ten in all (CAT-18)."""
    edges = catalog.select("table_name", F.posexplode("foreign_keys").alias("n", "fk"))
    few = (edges.where(c("n") < per_table).orderBy("table_name", "n").limit(overall)
           .agg(F.array_sort(F.collect_list(F.concat_ws(
               " ", "table_name", F.lit("->"), "fk.referenced_table"))).alias("examples")))
    totals = catalog.agg(
        F.count("*").alias("total_tables"),
        F.count_if(F.size("foreign_keys") > 0).alias("tables_with_foreign_keys"),
        F.sum(F.size("foreign_keys")).alias("total_foreign_keys"))
    return totals.withColumn("examples", few.scalar())


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A stored metadata dictionary as one row per table (SRC-13)."""
    table = "struct<categoria: string, row_count: bigint, business_purpose: string>"
    schema = f"tablas map<string, {table}>, keywords_busqueda map<string, array<string>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    words = F.element_at("keywords_busqueda", c("table_name"))
    return doc.select("keywords_busqueda", F.explode("tablas").alias("table_name", "v")).select(
        "table_name", c("v.categoria").alias("category"), c("v.row_count").alias("row_count"),
        c("v.business_purpose").alias("purpose"), words.alias("terms"))


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """A stored relation graph as edges (SRC-13)."""
    doc = spark.read.schema("graph map<string, array<string>>").option("multiLine", True).json(path)
    return doc.select(F.explode("graph").alias("src", "to")).select("src", F.explode("to").alias("dst"))
