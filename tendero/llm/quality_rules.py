"""Quality rules: fixed limits first, then robust multivariate outliers per language and source.

Five transformed statistics of a text (log of words, mean word length, log share of
signs, root share of repeated lines, share of words in repeated runs) are compared with a
minimum-covariance-determinant estimate of its group: start at medians and quartiles, then
repeat: take the ``SUPPORT`` rows nearest by Mahalanobis distance, take their mean and
covariance. A text beyond ``CUTOFF`` is rejected.

All of it is DataFrame code. Statistics are whole numbers (1/``UNIT`` steps), so sums do not depend
on the order of rows; the nearest rows are found by counting distances in bins, so no
group is ever sorted or collected; a group with a third of all rows is one partial sum per
task. Mean, covariance and its Cholesky factor are columns of one row per group.

Groups under ``min_rows`` rows are pooled by language, what is still too small over all
languages; a pool still too small rejects nothing. A covariance never falls below
``FLOOR``, so groups in which a statistic hardly varies don't reject small changes.

Rows: null or empty texts have no words and fail the base rule; a null language or source
is a group of its own; repeated rows count one by one; long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from tendero.session import stored

SPACES = r"[\x20\x09-\x0D]+"
NAMES = ("x0", "x1", "x2", "x3", "x4")
UNIT = 4096
#: Smallest standard deviation of each statistic.
FLOOR = (0.6, 0.5, 0.7, 0.15, 0.06)
SUPPORT = 0.75  # share of a group's rows that an estimate rests on
STEPS = 3
MEDIAN = 4.351  # median of the chi-square distribution of five degrees
CUTOFF = 45.0  # far beyond its 0.9999 quantile (25.7): the statistics have long tails
BINS = 32  # bins of a doubling of the distance


def statistics(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(*keep, text.alias("_t"), F.filter(F.split(text, SPACES), lambda x: x != "").alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashed = words.select(
        *keep, F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("_l"), F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"))
    runs = hashed.select(
        *keep, "n_words", "word_chars", "n_symbols", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr("case when n_words >= 6 then transform(sequence(0, cast(n_words as int) - 5),"
               " i -> xxhash64(_h[i], _h[i + 1], _h[i + 2], _h[i + 3], _h[i + 4])) end").alias("_g"))
    # only texts with a repeated run sort theirs
    repeated = runs.withColumn("_g", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.col("_g")))
    ordered = repeated.withColumn("_s", F.expr("array_sort(transform(_g, (x, i) -> struct(x as h, i as p)))"))
    places = ordered.withColumn("_d", F.expr(
        "sort_array(transform(filter(_s, (e, k) -> coalesce(e.h = get(_s, k - 1).h, false) or coalesce(e.h = get(_s, k + 1).h, false)), e -> e.p))"))
    covered = F.expr("aggregate(transform(_d, (p, k) -> least(5, coalesce(get(_d, k + 1) - p, 5))), 0, (a, x) -> a + x)")
    return places.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _vector(rows: DataFrame) -> DataFrame:
    """``rows`` with the transformed statistics as whole numbers."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    values = (F.log(n), chars / n, F.log(1 + 100 * F.col("n_symbols") / chars), F.sqrt(F.least(F.lit(1.0), F.col("n_dup_lines") * 5 / n)),
              F.col("n_repeat_words") / n)
    return rows.withColumns({c: F.round(v * UNIT).cast("long") for c, v in zip(NAMES, values)})


def _quantile(counts: DataFrame, by: list[str], bin_col: str, share: float, name: str) -> DataFrame:
    """First bin of each group at which ``share`` of its rows is reached; counts are of bins."""
    w = Wd.partitionBy(*by)
    upto = counts.withColumn("_u", F.sum("n").over(w.orderBy(bin_col))).withColumn("_a", F.sum("n").over(w))
    return upto.where(F.col("_u") >= F.ceil(F.col("_a") * share)).groupBy(*by).agg(F.min(bin_col).alias(name))


def _distance() -> list[Column]:
    """Coordinates y0.. of x0.. - m0.. under the Cholesky factor l00, l10, ...; each may use those before it."""
    parts = []
    for i in range(len(NAMES)):
        rest = F.col(NAMES[i]) / UNIT - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        parts.append(rest / F.col(f"l{i}{i}"))
    return parts


def with_distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """``rows`` with the squared distance ``d2`` from their group's estimate."""
    out = rows.join(estimate, "g")
    for i, y in enumerate(_distance()):
        out = out.withColumn(f"y{i}", y)
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, len(NAMES))), F.col("y0") * F.col("y0"))
    return out.withColumn("d2", d2).select(*rows.columns, "d2")


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + 1e-6) * BINS).cast("long")


def _cholesky(moments: DataFrame) -> DataFrame:
    """Mean and Cholesky factor of each group, from sums of values and products."""
    d = range(len(NAMES))
    n = F.col("n").cast("double")
    out = moments.withColumns({f"m{i}": F.col(f"s{i}").cast("double") / n / UNIT for i in d})
    cov = {(i, j): F.col(f"p{j}{i}").cast("double") / n / UNIT / UNIT - F.col(f"m{i}") * F.col(f"m{j}") + (FLOOR[i] ** 2 if i == j else 0.0)
           for i in d for j in range(i + 1)}
    for j in d:
        for i in range(j, len(NAMES)):
            rest = cov[i, j]
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.select("g", *[f"m{i}" for i in d], *[f"l{i}{j}" for i in d for j in range(i + 1)])


def robust_estimate(rows: DataFrame) -> DataFrame:
    """Mean and Cholesky factor of each group ``g``, so scaled that the median distance is that of a normal group."""
    d = range(len(NAMES))
    long = rows.select("g", F.posexplode(F.array(*[F.floor(F.col(c) * 64 / UNIT) for c in NAMES])).alias("dim", "bin"))
    counts = stored(long.groupBy("g", "dim", "bin").agg(F.count("*").alias("n")), "bins")
    quartiles = _quantile(counts, ["g", "dim"], "bin", 0.5, "q2")
    for name, share in (("q1", 0.25), ("q3", 0.75)):
        quartiles = quartiles.join(_quantile(counts, ["g", "dim"], "bin", share, name), ["g", "dim"])
    floor = F.element_at(F.array(*[F.lit(x) for x in FLOOR]), F.col("dim") + 1)
    spread = quartiles.select("g", "dim", ((F.col("q2") + 0.5) / 64).alias("m"), F.greatest((F.col("q3") - F.col("q1")) / 64 / 1.349, floor).alias("l"))
    pick = lambda c, i: F.max(F.when(F.col("dim") == i, F.col(c)))
    estimate = spread.groupBy("g").agg(*[pick("m", i).alias(f"m{i}") for i in d], *[pick("l", i).alias(f"l{i}{i}") for i in d])
    estimate = estimate.withColumns({f"l{i}{j}": F.lit(0.0) for i in d for j in range(i)})
    for _ in range(STEPS):
        near = with_distance(rows, stored(estimate, "estimate")).withColumn("bin", _bin(F.col("d2")))
        limits = _quantile(near.groupBy("g", "bin").agg(F.count("*").alias("n")), ["g"], "bin", SUPPORT, "limit")
        chosen = near.join(limits, "g").where("bin <= limit")
        big = lambda c: F.sum(c.cast("decimal(20,0)"))
        estimate = _cholesky(chosen.groupBy("g").agg(
            F.count("*").alias("n"), *[big(F.col(c)).alias(f"s{i}") for i, c in enumerate(NAMES)],
            *[big(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p{i}{j}") for i in d for j in range(i, len(NAMES))]))
    estimate = stored(estimate, "estimate")
    near = with_distance(rows, estimate).groupBy("g", _bin(F.col("d2")).alias("bin")).agg(F.count("*").alias("n"))
    middle = _quantile(near, ["g"], "bin", 0.5, "middle")
    # the nearest rows spread less than all: a factor brings the median to its value, never below 1
    factor = F.sqrt(F.greatest(F.pow(F.lit(2.0), (F.col("middle") + 0.5) / BINS) / MEDIAN, F.lit(1.0)))
    return stored(estimate.join(middle, "g").withColumns({f"l{i}{j}": F.col(f"l{i}{j}") * factor for i in d for j in range(i + 1)}).drop("middle"), "estimate")


def judged(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
           min_rows: int = 200) -> DataFrame:
    """(doc_id, statistics, base_failed, kept, distance2) of every row; distance2 is null where no estimate applies."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    facts = statistics(named, keep=("doc_id", "lang", "source"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    facts = stored(_vector(facts).withColumn("base_failed", failed), "facts")
    good = facts.where("not base_failed")
    small = F.col("n") < min_rows
    sources = good.groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("pooled", small)
    langs = sources.where("pooled").groupBy("lang").agg(F.sum("n").alias("n")).select("lang", small.alias("thin"))
    groups = sources.join(langs, "lang", "left").select(
        "lang", "source", F.when(~F.col("pooled"), F.to_json(F.struct("lang", "source")))
        .when(~F.col("thin"), F.to_json(F.struct("lang"))).otherwise(F.lit("all")).alias("g"), "n")
    sizes = groups.groupBy("g").agg(F.sum("n").alias("n")).where(~small).select("g")
    groups = stored(groups.drop("n").join(sizes, "g"), "groups")
    rows = stored(good.join(groups, ["lang", "source"]).select("doc_id", "lang", "source", "g", *NAMES), "vectors")
    estimate = robust_estimate(rows)
    out = (facts.join(groups, ["lang", "source"], "left").join(estimate, "g", "left"))
    for i, y in enumerate(_distance()):
        out = out.withColumn(f"y{i}", y)
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, len(NAMES))), F.col("y0") * F.col("y0"))
    return out.withColumn("distance2", F.when(~F.col("base_failed"), d2)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("distance2") <= CUTOFF, F.lit(True))).alias("kept"), F.round("distance2", 4).alias("distance2"))
