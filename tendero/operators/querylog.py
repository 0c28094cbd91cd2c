"""Jobs over logs of questions, SQL texts and answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendero import dictionaries as D
from tendero.functions.columns import strip
from tendero.functions.predicates import any_of
from tendero.operators.ranking import shares

c = F.col


def sql_verdict(sql: Column) -> Column:
    """Why a statement is refused, or ``ok`` (LOG-1); the first reason counts."""
    text = strip(F.upper(F.coalesce(sql, F.lit(""))))
    verdict = F.when(text == "", "empty").when(
        ~(text.startswith("SELECT") | text.startswith("WITH")), "not a select")
    for label, pattern in D.FORBIDDEN_SQL:
        verdict = verdict.when(text.rlike(pattern), label)
    return verdict.when(text.rlike(r"(?s);.*[^;\s]"), "several statements").otherwise("ok")


def sql_audit(log: DataFrame, sql: str) -> DataFrame:
    """Statements by verdict."""
    return log.groupBy(sql_verdict(c(sql)).alias("verdict")).agg(F.count("*").alias("statements"))


def tables_in(sql: Column) -> Column:
    """Names after FROM and JOIN, upper case, each once (LOG-2)."""
    return F.array_distinct(F.regexp_extract_all(F.upper(sql), F.lit(r"\b(?:FROM|JOIN)\s+(\w+)"), 1))


def table_usage(log: DataFrame, sql: str) -> DataFrame:
    """Statements that use each table."""
    return (log.select(F.explode(tables_in(c(sql))).alias("table_name"))
            .groupBy("table_name").agg(F.count("*").alias("statements")))


def _matches(lower: Column, words: Sequence[str]) -> Column:
    """How many of the words occur as substrings."""
    total = F.lit(0)
    for w in words:
        total = total + F.contains(lower, F.lit(w)).cast("int")
    return total


def complexity(df: DataFrame, question: str, tables: Column | None = None) -> DataFrame:
    """Score 0-100, level and tier of every question (LOG-3, LOG-4).

    ``tables`` is an array of the tables found for the question; without it the
    question counts as one plain table.
    """
    lower = F.lower(c(question))
    known = F.lit(0) if tables is None else F.coalesce(F.size(tables), F.lit(0))
    n = F.greatest(known, F.lit(1))
    heavy = F.lit(0) if tables is None else F.coalesce(F.size(F.filter(
        tables, lambda t: F.upper(t).isin(list(D.HEAVY_TABLES)))), F.lit(0))
    words = F.size(F.filter(F.split(c(question), r"\s+"), lambda w: w != ""))
    families = {f"{name}_words": _matches(lower, found) for name, (_, found) in D.COMPLEXITY_WORDS.items()}
    out = df.withColumns({**families, "multi_words": _matches(lower, D.MULTI_ANALYSIS),
                          "n_tables": n, "heavy_tables": heavy, "n_words": words})
    score = sum((c(f"{name}_words") * weight for name, (weight, _) in D.COMPLEXITY_WORDS.items()), F.lit(0))
    score = score + (F.when(c("n_tables") >= 8, 40).when(c("n_tables") >= 5, 30)
                     .when(c("n_tables") >= 3, 15).when(c("n_tables") >= 2, 5).otherwise(0))
    score = score + c("heavy_tables") * 8 + c("multi_words") * 10
    score = score + F.when(c("n_words") > 20, 15).when(c("n_words") > 10, 8).otherwise(0)
    return (
        out.withColumn("score", F.least(score, F.lit(100))).withColumn("level", level(c("score")))
        .withColumn("tier", tier(c("level"), c("n_tables")))
    )


def level(score: Column) -> Column:
    return (F.when(score >= 70, "very_complex").when(score >= 45, "complex")
            .when(score >= 20, "moderate").otherwise("simple"))


def tier(level_: Column, n_tables: Column, smart: bool = True, from_tables: int = 3) -> Column:
    """Strong or light tier (LOG-4); without smart choice always the strong one."""
    if not smart:
        return F.lit("strong")
    strong = level_.isin("complex", "very_complex") | ((level_ == "moderate") & (n_tables >= from_tables))
    return F.when(strong, "strong").otherwise("light")


def tier_shares(scored: DataFrame) -> DataFrame:
    """Questions and percentage per tier (LOG-5)."""
    return shares(scored, "tier", "questions")


def asks_for_data(text: Column, words: Sequence[str] | None = None) -> Column:
    """The text holds one of the words of a data question (LOG-6).

    One alternation keeps the test a single pass over the text; the word list is a
    parameter, matched as substrings.
    """
    import re
    words = D.intent_words() if words is None else words
    return F.lower(text).rlike("|".join(re.escape(w) for w in words))


def clean_answer(text: Column) -> Column:
    """An answer without SQL blocks and without the lines that name SQL (LOG-7)."""
    text = F.regexp_replace(text, r"(?s)```sql\s*.*?\s*```", "")
    kept = F.filter(F.split(text, "\n", -1),
                    lambda line: ~any_of([F.lower(line).contains(w) for w in D.SQL_LINE_WORDS]))
    return strip(F.array_join(kept, "\n"))


def slowness(seconds: Column, notice: float = 5, warning: float = 10) -> Column:
    """Speed class of a statement (LOG-8)."""
    return F.when(seconds > warning, "slow").when(seconds > notice, "notice").otherwise("ok")


def slow_queries(log: DataFrame, seconds: str) -> DataFrame:
    return log.groupBy(slowness(c(seconds)).alias("speed")).agg(
        F.count("*").alias("statements"), F.max(seconds).alias("longest"))


def recent_questions(log: DataFrame, question: str, order: Sequence[str], k: int = 10) -> DataFrame:
    """Distinct questions, the latest asked first (LOG-11)."""
    asked = log.where(strip(c(question)) != "")
    last = asked.groupBy(question).agg(F.max(F.struct(*order)).alias("last"))
    return last.orderBy(c("last").desc(), question).limit(k).select(question, "last.*")
