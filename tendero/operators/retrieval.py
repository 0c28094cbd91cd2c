"""Vector, keyword and graph retrieval for a table of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendero import dictionaries as D
from tendero.functions.predicates import any_of
from tendero.session import stored

c = F.col

TOP_K, THRESHOLD, MAX_TABLES = 15, 0.30, 8
WEIGHTS = (0.6, 0.2, 0.2)

# Queries are sent to every task up to this many rows; more are joined in blocks.
MAX_SENT_QUERIES = 4096
QUERY_BLOCK, VECTOR_BLOCK = 2048, 200_000


# --- text to query --------------------------------------------------------------

def expand_synonyms(df: DataFrame, text: str, out: str = "expanded") -> DataFrame:
    """Query text with the first three synonyms of each whole-word term in it (RET-1).

    Terms apply in dictionary order and repeats stay. The dictionary is fixed, so it
    becomes one expression per row: no join, nothing to regroup. A plain substring
    test goes before each pattern, so long texts are seldom matched by pattern.
    """
    lower = c("_lower")
    added = [F.when(lower.contains(term) & lower.rlike(rf"(?U)\b{term}\b"), F.lit(" ".join(words)))
             for term, words in D.SYNONYMS.items()]
    return (df.withColumn("_lower", F.lower(text))
            .withColumn(out, F.concat_ws(" ", c(text), *added)).drop("_lower"))


def tokens(text: Column | str) -> Column:
    """Lower-case words of a text."""
    text = c(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"),
                    lambda w: F.length(w) > 0)


class TextVectors:
    """Hashed tf-idf vectors of unit length; an empty text gives zeros (RET-10).

    The fit makes one pass and keeps one number per dimension.
    """

    def __init__(self, corpus: DataFrame, text: str, dimensions: int = 256):
        self.tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions)
        counted = self.tf.transform(corpus.select(tokens(text).alias("_words")))
        self.idf = IDF(inputCol="_tf", outputCol="_idf").fit(counted)
        self.norm = Normalizer(inputCol="_idf", outputCol="_unit")

    def add(self, df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        worked = self.norm.transform(self.idf.transform(self.tf.transform(
            df.withColumn("_words", tokens(text)))))
        return worked.withColumn(out, vector_to_array("_unit", "float32")).drop(
            "_words", "_tf", "_idf", "_unit")


def embed_with(df: DataFrame, text: str, model: Callable[[list[str]], np.ndarray], dimensions: int,
               out: str = "embedding", batch: int = 100) -> DataFrame:
    """Vectors from any model, a hundred texts at a time; empty text gives zeros (RET-10)."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part[text].fillna("").tolist()
            vectors = np.zeros((len(texts), dimensions), dtype=np.float32)
            filled = [i for i, s in enumerate(texts) if s.strip()]
            for at in range(0, len(filled), batch):
                rows = filled[at:at + batch]
                vectors[rows] = model([texts[i] for i in rows])
            yield part.assign(**{out: list(vectors)})

    return df.mapInPandas(run, schema)


# --- nearest vectors ---------------------------------------------------------------

def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-10)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int, threshold: float | None):
    """Row numbers of the k best per query column, ties of the rounded score by id.

    The threshold holds for the score as computed, not for the rounded one.
    """
    rounded = np.round(scores, 6)
    for q in range(rounded.shape[1]):
        s = rounded[:, q]
        keep = np.arange(len(s)) if threshold is None else np.flatnonzero(scores[:, q] >= threshold)
        if len(keep) > 4 * k:  # cut by score first; ties with the k-th stay in
            kth = np.partition(s[keep], len(keep) - k)[len(keep) - k]
            keep = keep[s[keep] >= kth]
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        yield q, keep[order], s[keep[order]]


_HITS = "query_id long, id long, similarity double"


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = TOP_K,
                threshold: float | None = THRESHOLD) -> DataFrame:
    """The k most similar vectors of each query, similarity at 6 places (RET-2, JN-12).

    ``vectors`` has id, embedding and optionally active (only active rows count);
    ``queries`` has query_id, embedding. Each task multiplies its vectors with the
    matrix of queries and keeps k rows per query, so only tasks x queries x k rows are
    shuffled. A query table over ``MAX_SENT_QUERIES`` rows is not sent whole: blocks
    of queries meet blocks of vectors in a cogroup.
    """
    if "active" in vectors.columns:
        vectors = vectors.where("active")
    vectors = vectors.where(c("embedding").isNotNull()).select(c("id").cast("long"), "embedding")
    queries = queries.where(c("embedding").isNotNull()).select(c("query_id").cast("long"), "embedding")
    few = queries.limit(MAX_SENT_QUERIES + 1).toPandas()
    if few.empty:
        return vectors.sparkSession.createDataFrame([], _HITS + ", place int")
    if len(few) <= MAX_SENT_QUERIES:
        hits = _hits_sent(vectors, few, k, threshold)
    else:
        hits = _hits_blocked(vectors, queries, k, threshold)
    w = Window.partitionBy("query_id").orderBy(c("similarity").desc(), "id")
    return hits.withColumn("place", F.row_number().over(w)).where(c("place") <= k)


def _hits_sent(vectors: DataFrame, few: pd.DataFrame, k: int, threshold: float | None) -> DataFrame:
    query_ids = few["query_id"].to_numpy()
    wanted = _unit(np.stack(few["embedding"].to_numpy()))
    vectors = vectors.where(F.size("embedding") == wanted.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            if b.num_rows == 0:
                continue
            ids = b.column("id").to_numpy(zero_copy_only=False)
            scores = _unit(_matrix(b.column("embedding"))) @ wanted.T
            for q, rows, s in _best(ids, scores, k, threshold):
                old = held.get(q)
                all_ids = ids[rows] if old is None else np.concatenate([old[0], ids[rows]])
                all_s = s if old is None else np.concatenate([old[1], s])
                order = np.lexsort((all_ids, -all_s))[:k]
                held[q] = (all_ids[order], all_s[order])
        for q, (found, s) in held.items():
            yield pa.RecordBatch.from_pydict({
                "query_id": np.full(len(found), query_ids[q]), "id": found, "similarity": s})

    return vectors.mapInArrow(run, _HITS)


def _hits_blocked(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None) -> DataFrame:
    spread = vectors.agg(F.count("*")).scalar()
    asked = queries.agg(F.count("*")).scalar()
    v_blocks = F.greatest(F.ceil(spread / VECTOR_BLOCK), F.lit(1)).cast("long")
    q_blocks = F.ceil(asked / QUERY_BLOCK).cast("long")
    left = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), q_blocks)).withColumn(
        "vb", F.explode(F.sequence(F.lit(0).cast("long"), v_blocks - 1)))
    right = vectors.withColumn("vb", F.pmod(F.xxhash64("id"), v_blocks)).withColumn(
        "qb", F.explode(F.sequence(F.lit(0).cast("long"), q_blocks - 1)))

    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "id": [], "similarity": []}
        if len(q) and len(v):
            ids, names = v["id"].to_numpy(), q["query_id"].to_numpy()
            scores = _unit(np.stack(v["embedding"].to_numpy())) @ _unit(np.stack(q["embedding"].to_numpy())).T
            for n, rows, s in _best(ids, scores, k, threshold):
                out["query_id"].extend([names[n]] * len(rows))
                out["id"].extend(ids[rows])
                out["similarity"].extend(s)
        return pd.DataFrame(out)

    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(run, _HITS)


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Mean vector of each group, one partial mean per group and task."""
    mean = Summarizer.mean(array_to_vector(c("embedding").cast("array<double>")))
    return (vectors.where(c("embedding").isNotNull()).groupBy(c(group).cast("long").alias("query_id"))
            .agg(vector_to_array(mean).alias("embedding")))


# --- context score -------------------------------------------------------------------

def importance(rows: Column, fks: Column, columns: Column, related: Column) -> Column:
    """Importance of a table by volume, references, width and being a direct hit."""
    volume = (F.when(rows > 0, F.least(F.log10(rows + 1) / 6, F.lit(1.0)) * 0.4)
              .when(rows == 0, F.lit(-0.3)).otherwise(F.lit(0.0)))
    linked = F.least(fks / 5.0, F.lit(1.0)) * 0.3
    width = F.when(columns > 5, F.least((columns - 5) / 25.0, F.lit(1.0)) * 0.2).otherwise(F.lit(0.0))
    return volume + linked + width + F.when(related, F.lit(0.0)).otherwise(F.lit(0.1))


def query_words(query: Column) -> Column:
    """Words over 3 letters, repeats included."""
    return F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.length(w) > 3)


def keyword_score(words: Column, name: Column, column_names: Column, description: Column) -> Column:
    """Matches of the query's words in name, columns and description."""
    in_name = F.size(F.filter(words, lambda w: F.contains(F.lower(name), w)))
    in_columns = F.size(F.filter(column_names, lambda n: F.exists(
        words, lambda w: F.contains(F.lower(n), w))))
    in_text = F.size(F.filter(words, lambda w: F.contains(F.lower(description), w)))
    return (in_name * 0.4 + F.least(in_columns / 5.0, F.lit(1.0)) * 0.4
            + F.least(in_text / 10.0, F.lit(1.0)) * 0.2)


def rescore(similarity: Column, important: Column, keywords: Column) -> Column:
    """Weighted score within [0, 1] (RET-5)."""
    a, b, d = WEIGHTS
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity * a + important * b + keywords * d))


# --- graph ------------------------------------------------------------------------------

def neighbours(edges: DataFrame) -> DataFrame:
    """Referenced tables first, then referencing ones, each once (RET-6, JN-13)."""
    both = edges.select(c("src").alias("table_name"), c("dst").alias("related"), F.lit(0).alias("side")).unionByName(
        edges.select(c("dst").alias("table_name"), c("src").alias("related"), F.lit(1).alias("side")))
    both = both.where((c("side") == 0) | (c("table_name") != c("related")))
    return (both.groupBy("table_name", "related").agg(F.min("side").alias("side"))
            .withColumn("direction", F.when(c("side") == 0, "outgoing").otherwise("incoming")))


def graph_importance(related: Column, table: Column) -> Column:
    """Weight of a neighbour in the stored graph by the words in its name."""
    lower = F.lower(related)
    base = F.lower(F.regexp_replace(table, "S+$", ""))
    score = F.when(F.contains(lower, base), F.lit(D.NEIGHBOUR_BASE)).otherwise(F.lit(0))
    for weight, words in D.NEIGHBOUR_WORDS:
        score = score + F.when(lower.rlike("|".join(words)), F.lit(weight)).otherwise(F.lit(0))
    return score


def expand_related(hits: DataFrame, edges: DataFrame, graph: DataFrame | None = None,
                   tops: int = 3, most: int = 5) -> DataFrame:
    """Hits with the neighbours of the three best: references at 0.75 of the hit's
    score (RET-7), then the stored graph at 0.7 (RET-8); the first way to a table wins.

    ``hits`` has query_id, table_name, score. At most tops x most rows come per query.
    """
    by_score = Window.partitionBy("query_id").orderBy(c("score").desc(), "table_name")
    best = hits.withColumn("n", F.row_number().over(by_score)).where(c("n") <= tops)
    direct = F.lit(None).cast("string")
    found = [hits.select("query_id", "table_name", "score", direct.alias("via"),
                         F.lit(0).alias("way"), F.lit(0).alias("n"), F.lit(0).alias("m"))]
    near = neighbours(edges)
    order = Window.partitionBy("query_id", "table_name").orderBy("side", "related")
    found.append(
        best.join(near, "table_name").withColumn("m", F.row_number().over(order)).where(c("m") <= most)
        .select("query_id", c("related").alias("table_name"), (c("score") * 0.75).alias("score"),
                F.concat(F.lit("Relacionada por FK con "), "table_name").alias("via"),
                F.lit(1).alias("way"), "n", "m"))
    if graph is not None:
        weighed = best.join(graph.select(c("src").alias("table_name"), c("dst").alias("related")), "table_name")
        weighed = weighed.withColumn("weight", graph_importance(c("related"), c("table_name")))
        heavy = Window.partitionBy("query_id", "table_name").orderBy(c("weight").desc(), "related")
        # hit by hit: tables that are there already, also from a better hit, use up no place
        for n in range(1, tops + 1):
            known = found[0].select("query_id", c("table_name").alias("related"))
            for more in found[1:]:
                known = known.union(more.select("query_id", "table_name"))
            left = weighed.where(c("n") == n).join(known.distinct(), ["query_id", "related"], "left_anti")
            found.append(
                left.withColumn("m", F.row_number().over(heavy)).where(c("m") <= most)
                .select("query_id", c("related").alias("table_name"), (c("score") * 0.7).alias("score"),
                        F.concat(F.lit("Tabla relacionada con "), "table_name").alias("via"),
                        F.lit(2).alias("way"), "n", "m"))
    all_ways = found[0]
    for more in found[1:]:
        all_ways = all_ways.unionByName(more)
    return (
        all_ways.groupBy("query_id", "table_name")
        .agg(F.min_by(F.struct("score", "via"), F.struct("way", "n", "m")).alias("first"))
        .select("query_id", "table_name", "first.score", "first.via",
                c("first.via").isNotNull().alias("related"))
    )


# --- whole retrieval ----------------------------------------------------------------------

def retrieve_tables(questions: DataFrame, described: DataFrame, edges: DataFrame,
                    graph: DataFrame | None = None, k: int = TOP_K, most: int = MAX_TABLES,
                    threshold: float = THRESHOLD, dimensions: int = 256) -> DataFrame:
    """Tables for every question: expand, embed, search, follow, re-score (RET-9).

    ``questions`` has query_id, question; ``described`` is the tagged catalog with a
    description. The roles of the search are turned round: the catalog is the small
    side, so its vectors go to the tasks that hold the questions.
    """
    expanded = expand_synonyms(questions, "question")
    texts = TextVectors(described, "description", dimensions)
    catalog = described.where("active").select("table_name", "description")
    tables = texts.add(catalog, "description").select("table_name", "embedding")
    known = tables.limit(MAX_SENT_QUERIES + 1).toPandas()
    if len(known) > MAX_SENT_QUERIES:
        raise ValueError(f"a catalog of more than {MAX_SENT_QUERIES} tables: search it with cosine_topk")
    if known.empty:
        return questions.sparkSession.createDataFrame(
            [], "query_id long, table_name string, score double, related boolean, place int")
    names = known["table_name"].to_numpy()
    wanted = _unit(np.stack(known["embedding"].to_numpy()))
    name_order = np.argsort(np.argsort(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            scores = wanted @ _unit(_matrix(b.column("embedding"))).T
            ids = b.column("query_id").to_numpy(zero_copy_only=False)
            out = {"query_id": [], "table_name": [], "score": []}
            for q, rows, s in _best(name_order, scores, k, threshold):
                out["query_id"].extend([ids[q]] * len(rows))
                out["table_name"].extend(names[rows])
                out["score"].extend(s)
            yield pa.RecordBatch.from_pydict(
                out, schema=pa.schema([("query_id", pa.int64()), ("table_name", pa.string()),
                                       ("score", pa.float64())]))

    asked = texts.add(expanded, "expanded").select(c("query_id").cast("long"), "embedding")
    hits = stored(asked.mapInArrow(run, "query_id long, table_name string, score double"), "hits")
    wide = expand_related(hits, edges, graph)
    facts = described.select(
        "table_name", "row_count", F.size("foreign_keys").alias("fks"), F.size("columns").alias("width"),
        F.transform("columns", lambda col: col["name"]).alias("column_names"), "description")
    text = F.coalesce("via", "description")
    asked_words = questions.select("query_id", query_words(c("question")).alias("words"))
    scored = wide.join(facts, "table_name").join(asked_words, "query_id").withColumn(
        "score", rescore(c("score"), importance(c("row_count"), c("fks"), c("width"), c("related")),
                         keyword_score(c("words"), c("table_name"), c("column_names"), text)))
    w = Window.partitionBy("query_id").orderBy(c("score").desc(), "table_name")
    return (scored.withColumn("place", F.row_number().over(w)).where(c("place") <= most)
            .select("query_id", "table_name", F.round("score", 6).alias("score"), "related", "place"))


# --- keyword search --------------------------------------------------------------------------

def keyword_search(records: DataFrame, query: str, k: int = 3) -> DataFrame:
    """The k records that match a query's words best (RET-11).

    ``records`` has id, name, description, uses (array) and complexity: 20 for a word
    in the name, 15 in the description, 10 per use, and 0.3 of the complexity.
    """
    words = query.lower().split()

    def match(text: Column) -> Column:
        return any_of([F.contains(F.lower(text), F.lit(w)) for w in words])

    score = (F.when(match(c("name")), 20).otherwise(0)
             + F.when(match(c("description")), 15).otherwise(0)
             + F.size(F.filter("uses", match)) * 10 + c("complexity") * 0.3)
    scored = records.select("id", "name", F.coalesce(score, F.lit(0.0)).alias("score"))
    return scored.where(c("score") > 0).orderBy(c("score").desc(), "id").limit(k)


def procedures(spark: SparkSession) -> DataFrame:
    """The procedures known by name, as records of ``keyword_search``."""
    rows = [(i, n, d, list(u), x) for i, (n, d, u, x) in enumerate(D.PROCEDURES)]
    return spark.createDataFrame(
        rows, "id long, name string, description string, uses array<string>, complexity int")


# --- vector store -------------------------------------------------------------------------------

def upsert_vectors(stored: DataFrame, new: DataFrame, key: str = "table_name",
                   at: str = "created_at") -> DataFrame:
    """Stored vectors with the new ones over them, newest per key (SRC-14, WIN-9).

    The result goes to a new path; readers switch when it is complete.
    """
    from tendero.operators.ranking import latest_per_key
    both = (stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))))
    return latest_per_key(both, [key], [at, "_new"]).drop("_new")
