"""Registered jobs: profiling, catalog, retrieval, logs, streams and reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendero.functions.columns import (
    date_like, log_volume, plain_sql, shorten, stamp, thousands, volume_label,
)
from tendero.operators import catalog as cat
from tendero.operators import conversations as cnv
from tendero.operators import profiling as prf
from tendero.operators import querylog as log
from tendero.operators import references as refs
from tendero.operators import reports
from tendero.operators import retrieval as ret
from tendero.operators.ranking import latest_per_key
from tendero.operators.sales import sales_by_customer
from tendero.operators.vector_index import VectorIndex
from tendero.session import checkpoint_dir, stored
from tendero.sources.tables import FOREIGN_KEYS, PRIMARY_KEYS, Tables
from tendero.streaming import state

Query = Callable[[Tables], DataFrame]
c = F.col
CATALOG = tuple(PRIMARY_KEYS)


def _all(t: Tables) -> dict[str, DataFrame]:
    return {name: getattr(t, name) for name in CATALOG}


def _catalog(t: Tables) -> DataFrame:
    return cat.table_catalog(t.spark, _all(t), PRIMARY_KEYS, FOREIGN_KEYS)


def _tagged(t: Tables) -> DataFrame:
    return cat.tag_tables(_catalog(t))


def _described(t: Tables) -> DataFrame:
    return cat.full_descriptions(_tagged(t), cat.sample_descriptions(_all(t), PRIMARY_KEYS))


def _edges(t: Tables) -> DataFrame:
    """The declared references; what the data keeps of them is the report of ``fk_integrity``."""
    return t.spark.createDataFrame([(src, dst) for src, _, dst, _ in FOREIGN_KEYS], "src string, dst string")


def _found_edges(t: Tables) -> DataFrame:
    """The references that the stored rows show."""
    found = refs.found_references(_all(t))
    return found.select(c("table_name").alias("src"), c("referenced_table").alias("dst"))


def _refreshed(t: Tables) -> DataFrame:
    """A stored catalog after a refresh: some counts were fresh, most were stale, one table is gone.

    It held counts of thirty days ago; an hour ago events and orders were counted, when the last day
    of events and the last year of orders were not there yet.
    """
    as_of = _events_end(t)
    year = t.orders.agg(F.max(F.year("o_orderdate")).alias("y")).first()["y"]
    before = {"events": t.events.where(c("ts") < as_of - timedelta(days=1)), "orders": t.orders.where(F.year("o_orderdate") < year)}
    now = _all(t)
    store = cat.refresh_catalog(_work(t), t.spark, now, PRIMARY_KEYS, FOREIGN_KEYS, as_of - timedelta(days=30))
    store.upsert(cat.described_tables(t.spark, before, PRIMARY_KEYS, FOREIGN_KEYS).withColumn(
        "counted_at", F.lit(as_of - timedelta(hours=1)).cast("timestamp")))
    store.compact()
    del now["pages"]
    store = cat.refresh_catalog(store, t.spark, now, PRIMARY_KEYS, FOREIGN_KEYS, as_of)
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("counted_at")) / 3600
    return store.read().select("table_name", "row_count", "active", age.cast("int").alias("age_hours"))


def _rounded(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


# --- retrieval ---

def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(c("vec_id").alias("id"), "embedding", "label")


def _indexed_topk(t: Tables) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100, from a stored index."""
    index = VectorIndex.build(_vectors(t), _work(t))
    return index.search(_vectors(t).where("id % 100 = 0").select(c("id").alias("query_id"), "embedding"), k=10).hits


def _topk(t: Tables) -> DataFrame:
    return ret.cosine_topk(_vectors(t), ret.centroids(_vectors(t), "label"))


def _rescored(t: Tables) -> DataFrame:
    """Hits of each label's mean vector, weighed by the size of the hit's own label."""
    sizes = _vectors(t).groupBy("label").agg(F.count("*").alias("row_count"))
    hits = (_topk(t).join(_vectors(t).select("id", "label", F.size("embedding").alias("width")), "id")
            .join(sizes, "label"))
    other = c("label") != c("query_id")
    score = ret.rescore(c("similarity"), ret.importance(c("row_count"), F.lit(1), c("width"), other), F.lit(0.0))
    return hits.select("query_id", "id", "similarity", F.round(score, 5).alias("score"))


def _hits(t: Tables) -> DataFrame:
    """Each table as a query of its own, scored by its share of all references' rows."""
    checked = prf.fk_integrity(_all(t), FOREIGN_KEYS)
    rows = checked.groupBy("table_name").agg(F.sum("rows").alias("rows"))
    return rows.select(F.lit(1).alias("query_id"), "table_name",
                       F.least(F.log10(c("rows") + 1) / 6, F.lit(1.0)).alias("score"))


def _questions(t: Tables) -> DataFrame:
    return t.conversations.where(c("role") == "user").select(
        (c("conv_id") * 1000 + c("turn")).alias("query_id"), "conv_id", "turn", c("text").alias("question"))


def _events_end(t: Tables):
    return t.events.agg(F.max("ts").cast("timestamp").alias("at")).first()["at"]


def _retrieved(t: Tables) -> DataFrame:
    # texts name no table of the model here, so the floor on similarity is off
    # the catalog is read from its store: no table of the model is counted or sampled for a question
    as_of = _events_end(t)
    described = cat.refresh_catalog(_work(t), t.spark, _all(t), PRIMARY_KEYS, FOREIGN_KEYS, as_of).read()
    edges = stored(_edges(t), "edges")
    return ret.retrieve_tables(_questions(t).select("query_id", "question"), described, edges, threshold=0.0)


def _corpus_search(t: Tables) -> DataFrame:
    docs = t.documents.select(c("doc_id").alias("id"), "text")
    asked = t.spark.createDataFrame(
        [(1, "precio de las ventas por sucursal"), (2, "the price and the stock of the store"),
         (3, "les clients et le prix")], "query_id long, question string")
    texts = ret.TextVectors(docs, "text")
    queries = texts.add(ret.expand_synonyms(asked, "question"), "expanded")
    return ret.cosine_topk(texts.add(docs, "text"), queries, k=10, threshold=0.01)


def _keyword_search(t: Tables) -> DataFrame:
    records = t.documents.select(
        c("doc_id").alias("id"), c("source").alias("name"), c("text").alias("description"),
        F.array("lang").alias("uses"), F.least(c("n_chars") / 100, F.lit(100.0)).alias("complexity"))
    return ret.keyword_search(records, "web en the", k=25)


# --- conversations and events ---

def _messages(t: Tables) -> DataFrame:
    return t.conversations.select(
        c("conv_id").alias("session"), c("turn").alias("at"), "role", "text",
        F.when(F.lower("text").contains("select "), c("text")).alias("sql"))


def _event_summaries(t: Tables) -> DataFrame:
    return t.events.groupBy(c("user_id").alias("session")).agg(
        F.max("ts").cast("timestamp").alias("updated_at"), F.count("*").alias("messages"))


def _events_as_of(t: Tables):
    return t.events.agg(F.max("ts").cast("date")).scalar()


# --- streams and reports ---

def _work(t: Tables) -> str:
    return f"{checkpoint_dir(t.spark)}/{uuid.uuid4().hex}"


def _stream_sessions(t: Tables) -> DataFrame:
    rows = state.stream_table(t.spark, t.root, "events").select(
        c("user_id").alias("session"), c("ts").alias("at"), c("event_id").alias("seq"),
        c("event_type").alias("role"))
    return state.run_sessions(rows, _work(t)).sessions


def _stream_usage(t: Tables) -> DataFrame:
    rows = state.stream_table(t.spark, t.root, "conversations").where(c("role") == "user")
    counts = state.tier_usage(rows.select(c("text").alias("question")))
    return state.current(state.run_to_end(counts, _work(t), "complete"), "tier")


def _stream_export(t: Tables) -> DataFrame:
    rows = state.stream_table(t.spark, t.root, "events").where(c("event_type") == "error")
    path = state.export_new(rows.select("event_id", "user_id", "value"), _work(t))
    return t.spark.read.schema("event_id long, user_id long, value double").parquet(path)


def _report(fmt: str) -> Query:
    def run(t: Tables) -> DataFrame:
        result = sales_by_customer(t)
        path = f"{_work(t)}/data"
        reports.export(result, path, fmt)
        reader = t.spark.read.schema(result.schema)
        return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)
    return run


def _text_functions(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", shorten("text", 60).alias("short"), thousands("n_chars", 0).alias("chars"),
        date_like("text").alias("date_like"), plain_sql(c("lang")).alias("plain"))


# Statement texts of all kinds that the audit tells apart; {} is the event's type.
STATEMENTS = (
    "SELECT * FROM {}", "with x as (select 1 as a) select a from x join {} on 1 = 1", "DELETE FROM {}",
    "SELECT * FROM {}; DROP TABLE {}", "SELECT xp_run FROM {}", "SELECT a -- the {}\n  FROM {}",
    "SELECT /* of\n {} */ a  FROM {}", "SELECT a FROM {} UNION SELECT a FROM other", "SELECT a FROM {}; SELECT 2", " \n ",
)


def _statements(t: Tables) -> DataFrame:
    """A log of statements: every event asks for its type in one of the forms above."""
    forms = F.array(*[F.lit(x) for x in STATEMENTS])
    form = F.element_at(forms, (F.pmod("event_id", F.lit(len(STATEMENTS))) + 1).cast("int"))
    return t.events.select("event_id", F.replace(form, F.lit("{}"), F.coalesce("event_type", F.lit(""))).alias("sql"))


def _date_functions(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("at")).select(
        "o_custkey", stamp("at").alias("moment"), stamp("at", False).alias("day"))


JOB_QUERIES: dict[str, Query] = {
    # profiling
    "profile_orders": lambda t: _rounded(prf.profile(t.orders), "mean", "std", "median"),
    "describe_lineitem": lambda t: _rounded(prf.describe(t.lineitem), "mean", "std", "p25", "p50", "p75"),
    "summary_labels": lambda t: prf.summary(t.labels),
    "duplicate_rows": lambda t: prf.duplicate_rows(t.documents.drop("doc_id")),
    "table_stats": lambda t: prf.table_stats(_all(t)),
    "stats_freshness": lambda t: prf.freshness(
        latest_per_key(t.events.select(c("event_type").alias("table_name"), "event_id",
                                       c("ts").cast("timestamp").alias("counted_at")),
                       ["table_name"], ["counted_at", "event_id"]),
        t.events.agg(F.max("ts").cast("timestamp")).scalar()).select("table_name", "stale"),
    "schema_stats": lambda t: prf.schema_stats(_tagged(t)),
    "key_uniqueness": lambda t: prf.key_uniqueness(_all(t), PRIMARY_KEYS),
    "fk_integrity": lambda t: prf.fk_integrity(_all(t), FOREIGN_KEYS),
    "found_references": lambda t: refs.inclusions(_all(t)),
    # catalog
    "catalog_refresh": _refreshed,
    "catalog_columns": lambda t: cat.catalog_columns(_catalog(t)),
    "find_columns": lambda t: cat.find_columns(cat.catalog_columns(_catalog(t)), "key"),
    "table_tags": lambda t: _tagged(t).select(
        "table_name", "row_count", "active", F.round("relevance", 4).alias("relevance"), "kept", "category",
        F.array_join("semantic_fields", ", ").alias("semantic_fields"), "summary", "purpose",
        F.array_join("terms", ", ").alias("terms"), "volume",
        F.round(log_volume("row_count"), 6).alias("log_volume")),
    "table_samples": lambda t: cat.sample_descriptions(_all(t), PRIMARY_KEYS),
    "table_descriptions": lambda t: _described(t).select("table_name", "description"),
    "category_index": lambda t: cat.category_index(_tagged(t)),
    "enrichment_report": lambda t: cat.enrichment_report(_tagged(t), cat.fk_edges(_catalog(t))),
    "extraction_check": lambda t: cat.extraction_check(_catalog(t)).withColumn(
        "examples", F.array_join("examples", "; ")),
    "volume_labels": lambda t: prf.table_stats(_all(t)).select("table_name", volume_label("row_count").alias("volume")),
    # retrieval
    "vector_topk": _topk,
    "vector_rescore": _rescored,
    "vector_index_topk": _indexed_topk,
    "fk_neighbours": lambda t: ret.neighbours(_found_edges(t)).select("table_name", "related", "direction"),
    "expand_related": lambda t: ret.expand_related(_hits(t), stored(_edges(t), "edges")).select(
        "table_name", F.round("score", 6).alias("score"), "related"),
    "retrieve_tables": _retrieved,
    "synonym_expand": lambda t: ret.expand_synonyms(t.documents.select("doc_id", "text"), "text").select(
        "doc_id", F.substring("expanded", F.length("text") + 1, F.length("expanded")).alias("added")),
    "corpus_search": _corpus_search,
    "keyword_search": _keyword_search,
    # query log
    "sql_audit": lambda t: log.sql_audit(t.documents, "text"),
    "table_usage": lambda t: log.table_usage(t.documents, "text"),
    "statement_audit": lambda t: log.sql_audit(_statements(t), "sql"),
    "statement_usage": lambda t: log.table_usage(_statements(t), "sql"),
    "statement_texts": lambda t: _statements(t).groupBy(plain_sql("sql").alias("plain")).agg(F.count("*").alias("statements")),
    "question_complexity": lambda t: log.complexity(_questions(t), "question").drop("question", "query_id"),
    "tier_shares": lambda t: log.tier_shares(log.complexity(_questions(t), "question")),
    "intent_flags": lambda t: _questions(t).select(
        "conv_id", "turn", log.asks_for_data(c("question")).alias("asks_for_data")),
    "clean_answers": lambda t: t.conversations.where(c("role") == "assistant").select(
        "conv_id", "turn", log.clean_answer(c("text")).alias("answer")),
    "recent_questions": lambda t: log.recent_questions(_questions(t), "question", ["turn", "conv_id"]),
    "slow_events": lambda t: log.slow_queries(t.events, "value"),
    # conversations
    "conv_summary": lambda t: cnv.summaries(_messages(t)),
    "conv_list": lambda t: cnv.listed(cnv.summaries(_messages(t))).select("session", "title", "updated_at"),
    "conv_search": lambda t: cnv.search(_messages(t), "the on"),
    "conv_context": lambda t: cnv.context(_messages(t)),
    "session_buckets": lambda t: cnv.buckets(_event_summaries(t), _events_as_of(t)),
    "latest_event_per_user": lambda t: latest_per_key(
        t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]),
    # streams and reports
    "stream_session_state": _stream_sessions,
    "stream_usage": _stream_usage,
    "stream_export": _stream_export,
    "report_csv": _report("csv"),
    "report_json": _report("json"),
    # scalar functions
    "text_functions": _text_functions,
    "date_functions": _date_functions,
}
