"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are whole runs of characters of keys and tokens, however long: those of at least
16 with a digit, and those of at least 6 that are assigned to a name of a secret. A name
before ``=`` is no part of the value, padding is. Their
features are DataFrame expressions: length, shares and changes of character classes,
coverage by a dictionary (runs of letters that are frequent words of the corpus), the
path (the source column), and the words around. A random forest (Spark ML) learns from
labelled findings, at most ``sample`` of them; all candidates are scored.

``label_findings`` marks clear cases where no reviewed labels exist: mixed values
assigned to a name of a secret, and values that begin as issued keys do, are 1; plain
numbers, dictionary words or bare letters, and values that stand alone in prose, are 0; the rest
stay unlabelled.

Rows: null and empty texts have no candidates. Findings of equal (id, text) rows are
equal; null ids and null paths are allowed. Without findings of both labels nothing can
be learnt and every candidate stays. Long texts are scanned whole.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendero.session import stored

_RUN, _NAMED = "[A-Za-z0-9+/_-]", "(?i:token|secret|api.?key|passw|passwd|pwd|auth|credential|private|access.?key|bearer)"
# a run is taken from its first character to its last; one with ``=`` and a value behind it is a name
PATTERN = (f"(?<!{_RUN})(?:(?=[A-Za-z+/_-]*+[0-9]){_RUN}{{16,}}+"
           f"|(?<=[=:][\\x20\"'`]{{0,3}})(?<={_NAMED}[A-Za-z0-9_-]{{0,16}}[\"'`]?[\\x20]{{0,2}}[=:][\\x20\"'`]{{0,3}}){_RUN}{{6,}}+)"
           f"(?!={_RUN})(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?")
NAMES = r"(?i)(token|secret|api.?key|passw|passwd|pwd|auth|credential|private|access.?key|bearer)"
# First characters of keys as their issuers publish them.
ISSUED = r"^(AKIA|ASIA|AIza|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|sk-|SG\.|npm_|ya29|eyJ)"
EXAMPLES = r"(?i)(example|dummy|sample|placeholder|changeme|your|fake|test)"
ASSIGNED = r"[=:]\s*[\"'`]?$"
FEATURES = ["size", "digits", "upper", "lower", "other", "changes", "digit_changes", "variety", "vowels", "covered", "issued",
            "path_test", "path_conf", "path_known", "named", "named_near", "assigned", "quoted", "example", "words_before", "digit_before"]


def _share(value: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{chars}]", "")) / F.length(value)


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per candidate: its document, number, start (characters), value and surroundings."""
    found = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"),
        F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).where(F.col("text").rlike(PATTERN))
    cut = found.select("doc_id", "path", "text_key", F.regexp_extract_all("text", F.lit(f"({PATTERN})"), F.lit(1)).alias("values"),
                       F.split("text", PATTERN, -1).alias("pieces"))
    return cut.select("doc_id", "path", "text_key", "pieces", "values", F.posexplode("values").alias("number", "value")).select(
        "doc_id", "path", "text_key", "number", "value",
        (F.aggregate(F.slice("pieces", F.lit(1), F.col("number") + 1), F.lit(0), lambda n, x: n + F.length(x))
         + F.aggregate(F.slice("values", F.lit(1), F.col("number")), F.lit(0), lambda n, x: n + F.length(x))).alias("start"),
        F.expr("right(pieces[number], 60)").alias("before"), F.expr("left(coalesce(get(pieces, number + 1), ''), 40)").alias("after"))


def corpus_dictionary(docs: DataFrame, *, text_col: str = "text", at_least: int = 100) -> DataFrame:
    """Lower-case words of three letters or more that occur ``at_least`` times in all texts."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), "[^a-z]+")).alias("word"))
    return words.where("length(word) >= 3").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= at_least).select("word")


def features(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``found`` with the columns of ``FEATURES``."""
    key = ["doc_id", "text_key", "number"]
    runs = found.select(F.explode(F.array_distinct(F.split(F.lower("value"), "[^a-z]+"))).alias("word")).where("length(word) >= 3").distinct()
    known = runs.join(dictionary, "word", "left_semi")
    covered = (found.select("value", F.explode(F.split(F.lower("value"), "[^a-z]+")).alias("word")).distinct()
               .join(known, "word").groupBy("value").agg(F.sum(F.length("word")).alias("known")))
    v = F.col("value")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    digit_runs = F.length(F.regexp_replace(F.regexp_replace(v, "[0-9]+", "0"), "[^0]", ""))
    rows = found.join(covered, "value", "left")
    b, path = F.col("before"), F.coalesce("path", F.lit(""))
    num = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return rows.select(
        *key, "value", "path", "start", "before", "after",
        num(F.length(v)).alias("size"), num(_share(v, "0-9")).alias("digits"), num(_share(v, "A-Z")).alias("upper"),
        num(_share(v, "a-z")).alias("lower"), num(_share(v, "+/_=-")).alias("other"),
        num((F.length(F.regexp_replace(kinds, r"(.)\1*", "x")) - 1) / F.length(v)).alias("changes"),
        num(digit_runs / F.length(v)).alias("digit_changes"),
        num(F.size(F.array_distinct(F.split(v, ""))) / F.length(v)).alias("variety"), num(_share(v, "aeiouAEIOU")).alias("vowels"),
        num(F.coalesce(F.col("known"), F.lit(0)) / F.length(v)).alias("covered"),
        num(v.rlike(ISSUED)).alias("issued"),
        num(path.rlike(r"(?i)(test|example|sample|mock|doc)")).alias("path_test"),
        num(path.rlike(r"(?i)(conf|env|secret|deploy|prod)")).alias("path_conf"), num(path != "").alias("path_known"),
        num(b.rlike(NAMES)).alias("named"), num(F.expr("right(before, 24)").rlike(NAMES)).alias("named_near"),
        num(b.rlike(ASSIGNED)).alias("assigned"), num(b.rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).alias("quoted"),
        num(F.concat(b, F.col("after")).rlike(EXAMPLES)).alias("example"),
        num(F.size(F.split(F.trim(b), r"\s+"))).alias("words_before"), num(b.rlike(r"[0-9]\W*$")).alias("digit_before"))


def label_findings(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label``: 1 clear secrets, 0 clear false positives, null the rest."""
    assigned = "named_near = 1 and assigned = 1 and digits between 0.05 and 0.95 and variety * size >= 5"
    letters = "named_near = 1 and assigned = 1 and quoted = 1 and size >= 16 and upper between 0.1 and 0.9 and covered < 0.3"
    issued = "issued = 1 and size >= 16 and digits > 0 and variety * size >= 8"
    return rows.withColumn("label", F.expr(f"""
        case when example = 0 and ({assigned} or {letters} or {issued}) then 1
             when digits = 1 and (named_near = 0 or assigned = 0) then 0 when digits = 0 and (covered >= 0.5 or quoted = 0) then 0
             when named = 0 and assigned = 0 and issued = 0 then 0 end"""))


def train(labelled: DataFrame, *, sample: int = 20_000, trees: int = 20, depth: int = 6):
    """The forest over rows with ``FEATURES`` and ``label``; None without both labels.

    At most ``sample`` findings of each label, those with the smallest hash of their value.
    """
    rows = labelled.where("label is not null").select("label", *FEATURES, F.xxhash64("value", "before").alias("h"))
    part = [rows.where(f"label = {k}").orderBy("h", *FEATURES).limit(sample) for k in (0, 1)]
    bounded = part[0].union(part[1]).select(F.col("label").cast("double"), *FEATURES)
    if bounded.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(bounded)
    return RandomForestClassifier(labelCol="label", featuresCol="vector", numTrees=trees, maxDepth=depth, seed=7).fit(vectors)


def predict(rows: DataFrame, model, *, threshold: float = 0.5) -> DataFrame:
    """``rows`` with ``probability`` and ``is_secret``."""
    if model is None:
        return rows.withColumn("probability", F.lit(0.5)).withColumn("is_secret", F.lit(True))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(rows)
    scored = model.transform(vectors).withColumn("probability", F.round(vector_to_array("probability").getItem(1), 6))
    return scored.drop("vector", "rawPrediction", "prediction").withColumn("is_secret", F.col("probability") >= threshold)


def scan(docs: DataFrame, *, labels: DataFrame | None = None, sample: int = 20_000, **columns: str) -> DataFrame:
    """All candidates with features, probability and verdict.

    ``labels`` (doc_id, number, label) are reviewed findings; without them clear cases
    are marked by ``label_findings``.
    """
    found = stored(candidates(docs, **columns), "candidates")
    rows = stored(features(found, corpus_dictionary(docs, text_col=columns.get("text_col", "text"))), "features")
    labelled = label_findings(rows) if labels is None else rows.join(labels.select("doc_id", "number", "label"), ["doc_id", "number"], "left")
    return predict(rows, train(labelled, sample=sample))


def redact(docs: DataFrame, verdicts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """``docs`` with every confirmed secret of its texts replaced by ``mark``."""
    hits = (verdicts.where("is_secret").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
            .agg(F.collect_set("number").alias("_numbers")))
    joined = docs.join(hits, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_key")), "left")
    values = F.regexp_extract_all(text_col, F.lit(f"({PATTERN})"), F.lit(1))
    shown = F.transform(values, lambda x, i: F.when(F.array_contains("_numbers", i), F.lit(mark)).otherwise(x))
    pieces = F.split(F.col(text_col), PATTERN, -1)
    new = F.array_join(F.flatten(F.transform(F.arrays_zip(pieces.alias("p"), shown.alias("s")),
                                             lambda z: F.array(z["p"], F.coalesce(z["s"], F.lit(""))))), "")
    text = F.when(F.col("_numbers").isNull(), F.col(text_col)).otherwise(new)
    return joined.withColumn(text_col, text).select(*docs.columns)
