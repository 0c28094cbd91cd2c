"""Rendezvous hashing of record keys over weighted shards, in built-in functions.

A record goes to the shard with the best score for its key; every (key, shard) pair has
its own uniform value u in (0, 1) from a digest, and the score of a shard of weight w is
-w / ln(u). A shard that is added takes only the records that it wins, one removed gives
up only its own, and nothing else moves. No shuffle: the shard is a function of the row.

Slots number the records of a shard from 0 without gaps. Equal (key, text) rows are one
counted group before anything is sorted, so a key with a third of all rows costs a row per
task; groups are cut into ranges of keys, numbered inside a range, and ranges add up.
Order: by key, then size and checksum of the text; null keys first.

Rows: null texts have size 1 and the checksum of nothing; a null key is a key like any
other; repeated rows each get a slot; extra columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

RANGE_ROWS = 200_000  # groups of a range of the numbering
PIECE = 1_000_000  # rows written out from one counted group at a time


def draw(key: Column, shard: int) -> Column:
    """52 bits of a digest of key and shard, as a whole number from 0."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(shard))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def shard_of(key: Column, weights: list[float]) -> Column:
    """Index of the winning shard; shards of weight 0 win nothing, ties go to the lower index."""
    if not any(w > 0 for w in weights):
        raise ValueError("a shard needs a weight above 0")
    equal = len(set(weights)) == 1

    def score(k: int) -> Column:
        u = draw(key, k)
        # equal weights: -1 / ln(u) grows with u, so the draw itself decides
        return u.cast("double") if equal else -F.lit(float(weights[k])) / F.log((u + 0.5) / float(1 << 52))

    tries = [F.struct(score(k).alias("s"), F.lit(-k).alias("k")) for k in range(len(weights)) if weights[k] > 0]
    best = tries[0] if len(tries) == 1 else F.greatest(*tries)
    return -best["k"]


def assign(records: DataFrame, key: str, weights: list[float], out: str = "shard") -> DataFrame:
    """``records`` with the shard of each row."""
    return records.withColumn(out, shard_of(F.col(key), weights))


def numbered(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    groups = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
    groups = groups.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    key = F.col("doc_id")
    groups = groups.withColumn("shard", shard_of(key, [1.0] * shards)).withColumn("grown_shard", shard_of(key, [1.0] * (shards + 1)))
    # cuts only balance the ranges: the numbers don't depend on them
    rows = docs.select(F.col(id_col).cast("long").alias("k"))
    ranges = -(-rows.count() // RANGE_ROWS)
    cuts = rows.approxQuantile("k", [k / ranges for k in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>")
    groups = groups.withColumn("range", F.coalesce(F.size(F.filter(cuts, lambda c: c <= F.col("doc_id"))), F.lit(0)))
    held = groups.groupBy("shard", "range").agg(F.sum("n").alias("held"))
    before = held.select("shard", "range", (F.sum("held").over(Wd.partitionBy("shard").orderBy("range")) - F.col("held")).alias("before"))
    inside = Wd.partitionBy("shard", "range").orderBy("doc_id", "size", "text_crc32")
    placed = groups.withColumn("first", F.sum("n").over(inside) - F.col("n")).join(before, ["shard", "range"])
    pieces = placed.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {PIECE}"))))
    return pieces.withColumn("_k", F.explode(F.expr(f"sequence(_at * {PIECE}, least(n, (_at + 1) * {PIECE}) - 1)"))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"),
        (F.col("before") + F.col("first") + F.col("_k")).alias("slot"), F.col("grown_shard").cast("int"))


def numbered_sql(shards: int) -> str:
    """The same rows in SQL."""
    def best(n: int) -> str:
        return f"""list_reduce(list_transform(range({n}), lambda k: {{
            's': CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(k AS VARCHAR)), 1, 13) AS BIGINT), 'k': -k}}),
            lambda a, b: CASE WHEN a >= b THEN a ELSE b END).k"""
    return f"""
    WITH crc_table AS MATERIALIZED (
      SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_concat([i], range(8)),
          lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c
        FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
    sized AS (
      SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
        xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
          lambda h: CAST('0x' || h AS BIGINT))), lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295) AS text_crc32,
        -({best(shards)}) AS shard, -({best(shards + 1)}) AS grown_shard
      FROM documents, crc_table)
    SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
      row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
      CAST(grown_shard AS INTEGER) AS grown_shard
    FROM sized"""
