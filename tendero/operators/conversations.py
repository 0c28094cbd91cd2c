"""Jobs over conversation logs: a conversation is an aggregate of its messages.

Text is cut before it is aggregated, so a summary moves short strings only. The
frames have session, at (order of the messages), role, text and optionally sql.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendero.functions.columns import title_of

c = F.col
DEFAULT_TITLE = "Nueva conversación"
BUCKETS = ("Hoy", "Ayer", "Esta semana", "Este mes", "Anteriores")


def summaries(messages: DataFrame, preview: int = 100) -> DataFrame:
    """Title, first and last time, messages, preview and answers with SQL (CNV-1, 2, 6)."""
    if "sql" not in messages.columns:
        messages = messages.withColumn("sql", F.lit(None).cast("string"))
    short = messages.select(
        "session", "at", "role", title_of("text").alias("title"),
        F.substring("text", 1, preview).alias("preview"), c("sql").isNotNull().alias("has_sql"))
    return (
        short.groupBy("session").agg(
            F.min("at").alias("created_at"), F.max("at").alias("updated_at"),
            F.count("*").alias("messages"), F.count_if(c("role") == "user").alias("user_queries"),
            F.count_if("has_sql").alias("sql_answers"),
            F.min_by(F.struct("role", "title", "preview"), "at").alias("first"))
        .withColumn("title", F.when(c("first.role") == "user", c("first.title"))
                    .otherwise(F.lit(DEFAULT_TITLE)))
        .withColumn("preview", c("first.preview")).drop("first")
    )


def listed(summary: DataFrame, by: str = "updated_at") -> DataFrame:
    """Conversations, newest first (CNV-3)."""
    return summary.orderBy(c(by).desc(), "session")


def date_bucket(updated: Column, as_of: Column) -> Column:
    """Today, yesterday, last 7 days, last 30 days, older (CNV-4).

    ``updated`` may be text: what does not parse counts as older. A day after
    ``as_of`` falls in the week.
    """
    age = F.datediff(as_of, F.to_date(updated.try_cast("timestamp")))
    return (F.when(age.isNull(), BUCKETS[4]).when(age == 0, BUCKETS[0]).when(age == 1, BUCKETS[1])
            .when(age <= 7, BUCKETS[2]).when(age <= 30, BUCKETS[3]).otherwise(BUCKETS[4]))


def buckets(summary: DataFrame, as_of: Column) -> DataFrame:
    """Conversations and messages per date bucket; empty buckets do not show (CNV-4)."""
    return (summary.groupBy(date_bucket(c("updated_at"), as_of).alias("bucket"))
            .agg(F.count("*").alias("conversations"), F.sum("messages").alias("messages")))


def search(messages: DataFrame, query: str) -> DataFrame:
    """Conversations with the text in their title or in any message (CNV-5).

    The title is a cut of the first message, so it needs its own test only where it
    is the default one.
    """
    wanted = query.lower()
    found = messages.groupBy("session").agg(
        F.count_if(F.contains(F.lower("text"), F.lit(wanted))).alias("matching"),
        F.min_by(F.struct("role", title_of("text").alias("title")), "at").alias("first"))
    title = F.when(c("first.role") == "user", c("first.title")).otherwise(F.lit(DEFAULT_TITLE))
    return (found.withColumn("title", title)
            .where((c("matching") > 0) | F.contains(F.lower("title"), F.lit(wanted)))
            .select("session", "title", "matching"))


def context(messages: DataFrame, last: int = 10) -> DataFrame:
    """The last messages of each conversation, then those of user and assistant (CNV-7, WIN-10).

    The rank is cut before the shuffle, so a huge conversation moves ``last`` rows per task.
    """
    w = Window.partitionBy("session").orderBy(c("at").desc())
    return (
        messages.withColumn("back", F.row_number().over(w)).where(c("back") <= last)
        .where(c("role").isin("user", "assistant")).select("session", "at", "role", "text", "back")
    )
