"""Document fingerprints: all shingle hashes below a fixed share of the hash range, in built-in functions.

A text's set is its distinct shingles of five words (a shorter text is one shingle). The
sketch keeps every hash under ``1 / scale`` of the 64-bit range, so its size follows the
text's, two sketches of any sizes share exactly the kept hashes of their common shingles,
and sketches merge by union. A text of which no hash lies that low keeps its smallest one:
short texts can still be told apart, and a union drops such a hash once a lower one is there.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]`` as they stand, upper case apart.

Rows: null counts as empty; empty texts and texts without words have an empty sketch, and two
empty sketches are alike (1). Very long texts are taken whole. Other columns don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from tendero.session import stored

WIDTH = 5
SCALE = 8  # one hash in eight is kept
RANGE_ROWS = 100_000  # rows of a range of the order by id
LEAST = -(1 << 63)

c = F.col


def limit(scale: int) -> int:
    """Hashes below this signed value are kept."""
    return LEAST + (1 << 64) // scale


def kept(hashes: Column, scale: int = SCALE) -> Column:
    """The sketch of an array of hashes: those below the limit, or else the smallest one; sorted."""
    low = F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h < limit(scale))))
    # the least hash comes first; the rest is what lies below the limit
    least = F.array_compact(F.array(F.array_min(hashes)))
    return F.array_union(least, low)


def with_sketch(df: DataFrame, text: str, out: str, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """``df`` with the sketch of a text column as a sorted ``array<bigint>``."""
    words, runs = f"_{out}_words", f"_{out}_runs"
    split = F.array_remove(F.split(F.coalesce(c(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    # columns of their own: a lambda that held these expressions would work them out for every element
    df = df.withColumn(words, F.transform(split, lambda w: F.xxhash64(w)))
    shingle = F.transform(F.sequence(F.lit(0), F.size(words) - width),
                          lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    short = F.array(F.xxhash64(*[F.coalesce(F.get(words, F.lit(k)), F.lit(0)) for k in range(width)], F.size(words)))
    df = df.withColumn(runs, F.when(F.size(words) >= width, shingle).when(F.size(words) > 0, short)
                       .otherwise(F.array().cast("array<bigint>")))
    return df.withColumn(out, kept(c(runs), scale)).drop(words, runs)


def merged(left: Column, right: Column, scale: int = SCALE) -> Column:
    """The sketch of both texts' shingles together."""
    return kept(F.array_union(left, right), scale)


def merged_rows(df: DataFrame, group: str, sketch: str, scale: int = SCALE) -> DataFrame:
    """Sketches of whole groups as rows (group, hash): a group of any size meets in no single task."""
    rows = df.select(c(group).alias("group"), F.explode(sketch).alias("hash")).distinct()
    least = rows.groupBy("group").agg(F.min("hash").alias("least"))
    return rows.join(least, "group").where((c("hash") < limit(scale)) | (c("hash") == c("least"))).select("group", "hash")


def likeness(left: Column, right: Column) -> Column:
    """Estimated share of common shingles among all shingles of both texts."""
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) & (F.size(right) == 0), 1.0).otherwise(both / (F.size(left) + F.size(right) - both))


def containment(part: Column, whole: Column) -> Column:
    """Estimated share of a text's shingles that the other one holds, whatever their sizes; an empty text is contained."""
    return F.when(F.size(part) == 0, 1.0).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))


def printed(sketch: Column) -> Column:
    """A sketch as text: sixteen hexadecimal digits for every hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


# --- every row with the row after it -------------------------------------------------

def _numbers(values: list[int]) -> Column:
    # one string that is parsed once, not one literal expression for every cut
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _at_or_below(cuts: list[tuple], key: list[Column]) -> Column:
    """How many of the sorted cuts are not above the key: a binary search on parallel arrays."""
    if not cuts:
        return F.lit(0)
    arrays = [_numbers([cut[k] for cut in cuts]) for k in range(len(key))]
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]

    def reached(at: Column) -> Column:
        said = F.get(arrays[-1], at) <= key[-1]
        for a, k in zip(arrays[-2::-1], key[-2::-1]):
            said = (F.get(a, at) < k) | ((F.get(a, at) == k) & said)
        return said

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: F.when(
        (at + step <= len(cuts)) & F.coalesce(reached(at + step - 1), F.lit(False)), at + step).otherwise(at))


def ranged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, tie, range): rows in consecutive ranges of the order by id, null ids first.

    Rows of one id are ordered by a hash of the text. Cuts come from a sample and only balance
    the ranges; they fall inside one id, and inside equal rows, where those are many. Equal rows
    are told apart by their place in the input for that alone: which of them comes first doesn't
    show in any result.
    """
    rows = docs.select(c(id_col).cast("long").alias("doc_id"), F.coalesce(c(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    key = [F.coalesce(c("doc_id"), F.lit(LEAST)), c("tie"), F.monotonically_increasing_id()]
    count = docs.count()
    # small inputs: a few ranges for every task
    ranges = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // RANGE_ROWS))
    sample = rows.select(*[k.alias(f"k{i}") for i, k in enumerate(key)]).sample(min(1.0, 50 * ranges / max(count, 1)), 7)
    # one row per range comes to the driver: 24 bytes for every 100,000 rows
    firsts = sample.repartitionByRange(ranges, "k0", "k1", "k2").groupBy(F.spark_partition_id().alias("p")).agg(
        F.min(F.struct("k0", "k1", "k2")).alias("k")).select("k.*").collect()
    return rows.withColumn("range", F.coalesce(_at_or_below(sorted(map(tuple, firsts))[1:], key), F.lit(0)))


def with_next(rows: DataFrame) -> DataFrame:
    """Rows of ``ranged`` with ``next_text`` and ``next_sketch``; the last row is followed by the first.

    The rows of a range are sorted once; its last row takes the first text of the next range.
    """
    every = Wd.partitionBy().orderBy("range")  # one row for each range
    order = rows.select("range").distinct().select(
        "range", F.coalesce(F.lag("range").over(every), F.max("range").over(Wd.partitionBy())).alias("before"))
    rows = rows.repartition("range")  # both uses below read the same shuffle files
    first = rows.groupBy("range").agg(F.min_by("text", F.struct("doc_id", "tie")).alias("first_text"))
    first = with_sketch(first.join(order, "range").select("before", "first_text"), "first_text", "first_sketch")
    inside = Wd.partitionBy("range").orderBy("doc_id", "tie")
    rows = with_sketch(rows, "text", "sketch")
    rows = rows.select("*", F.lead("text").over(inside).alias("lead_text"), F.lead("sketch").over(inside).alias("lead_sketch"))
    joined = rows.join(first, (c("range") == c("before")) & c("lead_text").isNull(), "left")
    return joined.select("doc_id", "text", "sketch", F.coalesce("lead_text", "first_text").alias("next_text"),
                         F.coalesce("lead_sketch", "first_sketch").alias("next_sketch"))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint beside that of the text with its last half replaced from the next document.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    held_edited, held_next): ``near_`` are estimated likenesses, ``held_`` the estimated shares
    of the text's shingles that the edited text and the next document hold. Null ids come first
    in the order, rows of one id by a hash of the text; a single document is its own next one.
    """
    rows = with_next(ranged(docs, id_col, text_col)).withColumn("n_chars", F.length("text"))
    half = F.expr("n_chars div 2").cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), c("n_chars") - half), F.substring("next_text", F.lit(1), half)))
    rows = with_sketch(rows, "edited", "edited_sketch")
    own, other, after = c("sketch"), c("edited_sketch"), c("next_sketch")
    return rows.select(
        "doc_id", c("n_chars").cast("long"), F.sha2("edited", 256).alias("edited_sha256"), printed(own).alias("fingerprint"),
        printed(other).alias("edited_fingerprint"), likeness(own, other).alias("near_edited"), likeness(own, after).alias("near_next"),
        containment(own, other).alias("held_edited"), containment(own, after).alias("held_next"))
