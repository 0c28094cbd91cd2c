"""Articles sold together (BQ-41, JN-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendero.functions.predicates import positive
from tendero.sources.tables import Tables

c = F.col
PART_ROWS = 200_000  # lines or pairs of articles that a partition takes, so that a task doesn't grow with the tables


def _pairs(baskets: DataFrame) -> DataFrame:
    right = baskets.select("doc_id", c("article_id").alias("right_article"))
    return (
        baskets.select("doc_id", c("article_id").alias("left_article")).join(right, "doc_id")
        .where(c("left_article") < c("right_article"))
    )


def cross_sell(t: Tables, min_documents: int = 2, large: int = 200) -> DataFrame:
    """Pairs of articles on at least ``min_documents`` common documents, exactly.

    Baskets up to ``large`` articles are joined with themselves. A larger basket is
    never paired in full. It is looked up for the pairs the small baskets gave, and
    for pairs that only large baskets can hold: those share a basket even after every
    article has dropped its ``min_documents - 1`` largest ones (the prefix filter of
    set-similarity joins), which removes a single dominating document altogether.
    """
    lines = t.lines.where(positive("units")).select("doc_id", "article_id")
    facts = lines.groupBy("doc_id").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("lines"), F.sum(F.when(c("n") <= large, c("n") * (c("n") - 1) / 2)).alias("pairs")).first()
    by_line, by_pair = (1 + int((facts[n] or 0) // PART_ROWS) for n in ("lines", "pairs"))

    def paired(df: DataFrame) -> DataFrame:
        return df.repartition(max(by_line, by_pair), "left_article", "right_article").groupBy("left_article", "right_article")

    baskets = lines.repartition(by_line, "doc_id").distinct()
    big_docs = (baskets.groupBy("doc_id").agg(F.count("*").alias("articles"))
                .where(c("articles") > large))
    small = baskets.join(big_docs, "doc_id", "left_anti")
    counted = paired(_pairs(small)).agg(F.count("*").alias("documents"))

    big = baskets.join(big_docs, "doc_id")
    largest = Window.partitionBy("article_id").orderBy(c("articles").desc(), "doc_id")
    dropped = (big.withColumn("n", F.row_number().over(largest))
               .where(c("n") <= min_documents - 1).select("doc_id", "article_id"))
    rest = big.join(dropped, ["doc_id", "article_id"], "left_anti")
    # only pairs of articles that large baskets hold are looked up in them
    held = big.select("article_id").distinct()
    known = (counted.select("left_article", "right_article")
             .repartition(by_pair, "left_article")
             .join(held.withColumnRenamed("article_id", "left_article"), "left_article", "left_semi")
             .join(held.withColumnRenamed("article_id", "right_article"), "right_article", "left_semi"))
    candidates = known.unionByName(_pairs(rest).select("left_article", "right_article")).distinct()
    left = big.select(c("article_id").alias("left_article"), "doc_id")
    right = big.select(c("article_id").alias("right_article"), "doc_id")
    looked_up = (
        candidates.join(left, "left_article").join(right, ["doc_id", "right_article"])
        .groupBy("left_article", "right_article").agg(F.count("*").alias("documents"))
    )
    return (
        paired(counted.unionByName(looked_up))
        .agg(F.sum("documents").alias("documents")).where(c("documents") >= min_documents)
    )
