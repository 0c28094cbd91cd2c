"""ANSI SQL for the registered jobs. Word lists are read from the dictionaries."""

from tendero import dictionaries as D
from tendero.plans.oracle_sales import sales_sql
from tendero.sources.tables import FOREIGN_KEYS, PRIMARY_KEYS


# Whole-number columns of the stored tables, in which references are looked for.
_WHOLE = {
    "region": "r_regionkey", "nation": "n_nationkey n_regionkey", "customer": "c_custkey c_nationkey",
    "supplier": "s_suppkey s_nationkey", "part": "p_partkey p_size", "orders": "o_orderkey o_custkey",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber", "events": "event_id user_id", "documents": "doc_id n_chars",
    "embeddings": "vec_id label", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id quality toxic",
    "conversations": "conv_id turn",
}


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _profile(table: str, columns) -> str:
    parts = []
    for at, (name, kind, spark_type) in enumerate(columns):
        numeric, text = kind == "numeric", kind == "text"
        x = f"CAST({name} AS DOUBLE)"
        no = "CAST(NULL AS DOUBLE)"
        mode = (f"(SELECT {name} FROM {table} WHERE {name} IS NOT NULL GROUP BY {name} "
                f"ORDER BY count(*) DESC, {name} LIMIT 1)")
        parts.append(f"""SELECT '{name}' AS "column", {at} AS position, '{spark_type}' AS type, '{kind}' AS kind,
  count({name}) AS non_null, count(*) - count({name}) AS nulls, count(DISTINCT {name}) AS "unique",
  {f'min({x})' if numeric else no} AS min, {f'max({x})' if numeric else no} AS max,
  {f'round(avg({x}), 4)' if numeric else no} AS mean, {f'round(median({x}), 4)' if numeric else no} AS median,
  {f'round(stddev_samp({x}), 4)' if numeric else no} AS std,
  {mode if text else 'CAST(NULL AS VARCHAR)'} AS most_frequent,
  {f"bool_and(regexp_matches({name}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'))" if text else 'CAST(NULL AS BOOLEAN)'} AS potential_date
FROM {table}""")
    return _union(parts)


def _describe(table: str, columns) -> str:
    parts = []
    for name in columns:
        x = f"CAST({name} AS DOUBLE)"
        parts.append(f"""SELECT '{name}' AS "column", count({name}) AS count, round(avg({x}), 4) AS mean,
  round(stddev_samp({x}), 4) AS std, min({x}) AS min, round(quantile_cont({x}, 0.25), 4) AS p25,
  round(quantile_cont({x}, 0.5), 4) AS p50, round(quantile_cont({x}, 0.75), 4) AS p75, max({x}) AS max
FROM {table}""")
    return _union(parts)


_TABLES = tuple(PRIMARY_KEYS)
_COUNTS = _union([f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in _TABLES])
_COLUMNS = f"""
SELECT DISTINCT i.table_name, CAST(ordinal_position - 1 AS INTEGER) AS position, column_name AS name,
  CASE data_type WHEN 'BIGINT' THEN 'BIGINT' WHEN 'INTEGER' THEN 'INTEGER' WHEN 'DOUBLE' THEN 'DOUBLE PRECISION'
    WHEN 'VARCHAR' THEN 'VARCHAR' WHEN 'TIMESTAMP' THEN 'TIMESTAMP' ELSE 'UNKNOWN' END AS type, row_count
FROM information_schema.columns i JOIN ({_COUNTS}) n ON n.table_name = i.table_name"""
_EDGES = ", ".join(f"('{a}', '{b}')" for a, _, b, _ in FOREIGN_KEYS)

_FOUND = f"""
WITH cells AS ({_union([f"SELECT '{t}' AS t, '{n}' AS n, CAST({n} AS BIGINT) AS v, count(*) AS k FROM {t} WHERE {n} IS NOT NULL GROUP BY {n}" for t, names in _WHOLE.items() for n in names.split()])}),
sizes AS (SELECT t, n, count(*) AS size, max(k) AS most FROM cells GROUP BY ALL),
shared AS (SELECT a.t AS t1, a.n AS n1, b.t AS t2, b.n AS n2, count(*) AS size FROM cells a JOIN cells b ON a.v = b.v
           WHERE a.t <> b.t OR a.n <> b.n GROUP BY ALL),
found AS (SELECT t1 AS table_name, n1 AS "column", t2 AS referenced_table, n2 AS referenced_column, x.size AS "values", y.size AS referenced_values
          FROM shared s JOIN sizes x ON x.t = t1 AND x.n = n1 AND x.size = s.size JOIN sizes y ON y.t = t2 AND y.n = n2 AND y.most = 1)"""

_TOPK = """
WITH cells AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v,
                      generate_subscripts(embedding, 1) AS pos FROM embeddings),
m AS (SELECT label, pos, avg(v) AS v FROM cells GROUP BY ALL),
q AS (SELECT CAST(label AS BIGINT) AS query_id, list(v ORDER BY pos) AS qv FROM m GROUP BY label),
sims AS (SELECT query_id, vec_id AS id, label,
                round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv), 6) AS similarity
         FROM embeddings CROSS JOIN q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS place
      FROM sims WHERE similarity >= 0.30)"""

_STRIP = r"regexp_replace(@x, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.replace("@x", x)


_TITLE = f"""CASE WHEN length({_strip('text')}) > 50
  THEN regexp_replace(left({_strip('text')}, 50), ' [^ ]*$', '') || '...' ELSE {_strip('text')} END"""
_SUMMARY = f"""
WITH f AS (SELECT conv_id, role, {_TITLE} AS title, left(text, 100) AS preview,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
g AS (SELECT conv_id, min(turn) AS created_at, max(turn) AS updated_at, count(*) AS messages,
             count(*) FILTER (role = 'user') AS user_queries,
             count(*) FILTER (contains(lower(text), 'select ')) AS sql_answers
      FROM conversations GROUP BY conv_id)
SELECT g.conv_id AS session, created_at, updated_at, messages, user_queries, sql_answers,
       CASE WHEN role = 'user' THEN title ELSE 'Nueva conversación' END AS title, preview
FROM g JOIN f ON f.conv_id = g.conv_id AND n = 1"""


def _matches(words) -> str:
    return " + ".join(f"CAST(contains(q, '{w}') AS INTEGER)" for w in words)


_SCORED = f"""
WITH x AS (SELECT conv_id, turn, lower(text) AS q,
                  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n_words
           FROM conversations WHERE role = 'user'),
y AS (SELECT conv_id, turn, n_words,
  {', '.join(f'{_matches(words)} AS {name}_words' for name, (_, words) in D.COMPLEXITY_WORDS.items())},
  {_matches(D.MULTI_ANALYSIS)} AS multi_words FROM x),
s AS (SELECT *, 1 AS n_tables, 0 AS heavy_tables, least(100,
  {' + '.join(f'{name}_words * {weight}' for name, (weight, _) in D.COMPLEXITY_WORDS.items())}
  + multi_words * 10 + CASE WHEN n_words > 20 THEN 15 WHEN n_words > 10 THEN 8 ELSE 0 END) AS score FROM y),
z AS (SELECT *, CASE WHEN score >= 70 THEN 'very_complex' WHEN score >= 45 THEN 'complex'
                     WHEN score >= 20 THEN 'moderate' ELSE 'simple' END AS level FROM s)
"""
_TIER = "CASE WHEN level IN ('complex', 'very_complex') THEN 'strong' ELSE 'light' END"

_VERDICT = "CASE WHEN u = '' THEN 'empty' WHEN NOT (starts_with(u, 'SELECT') OR starts_with(u, 'WITH')) THEN 'not a select' " + \
    " ".join(f"WHEN regexp_matches(u, '{p}') THEN '{label}'" for label, p in D.FORBIDDEN_SQL) + \
    r" WHEN regexp_matches(u, '(?s);.*[^;\s]') THEN 'several statements' ELSE 'ok' END"

_SYN = ", ".join(
    rf"CASE WHEN regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_]){term}($|[^\p{{L}}\p{{N}}_])') THEN '{' '.join(words)}' END"
    for term, words in D.SYNONYMS.items())
_NAMED_SQL = " OR ".join(f"contains(lower(x), '{w}')" for w in D.SQL_LINE_WORDS)

_JOBS = {
    "profile_orders": _profile("orders", [
        ("o_orderkey", "numeric", "bigint"), ("o_custkey", "numeric", "bigint"),
        ("o_orderstatus", "text", "string"), ("o_totalprice", "numeric", "double"),
        ("o_orderdate", "other", "timestamp_ntz"), ("o_orderpriority", "text", "string")]),
    "describe_lineitem": _describe("lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax"]),
    "summary_labels": """
SELECT count(*) AS rows, 3 AS columns, 100.0e0 AS completeness, '100.0%' AS completeness_label,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM labels)) AS duplicates,
       3 AS numeric_columns, 0 AS text_columns FROM labels""",
    "duplicate_rows": """
SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM
  (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS duplicates FROM documents""",
    "table_stats": f"""
SELECT n.table_name, row_count, CAST(k AS INTEGER) AS column_count FROM ({_COUNTS}) n
JOIN (SELECT table_name, count(DISTINCT column_name) AS k FROM information_schema.columns GROUP BY 1) i
  ON i.table_name = n.table_name""",
    "stats_freshness": """
SELECT event_type AS table_name, (SELECT max(ts) FROM events) - max(ts) > INTERVAL 12 HOUR AS stale
FROM events GROUP BY 1""",
    "schema_stats": f"""
SELECT count(*) AS total_tables, count(*) FILTER (row_count > 0) AS active_tables,
       count(*) FILTER (row_count <= 0) AS inactive_tables, CAST(sum(row_count) AS BIGINT) AS total_rows,
       count(*) FILTER (row_count > 0) AS tables_with_data,
       count(*) FILTER (table_name IN (SELECT a FROM (VALUES {_EDGES}) v(a, b))) AS tables_with_foreign_keys
FROM ({_COUNTS})""",
    "key_uniqueness": _union([f"""
SELECT '{n}' AS table_name, '{', '.join(k)}' AS key_columns, count(*) AS key_values,
       count(*) FILTER (n > 1) AS repeated,
       CAST(coalesce(sum(n) FILTER ({' OR '.join(f'{x} IS NULL' for x in k)}), 0) AS BIGINT) AS null_rows
FROM (SELECT {', '.join(k)}, count(*) AS n FROM {n} GROUP BY ALL)""" for n, k in PRIMARY_KEYS.items()]),
    "fk_integrity": _union([f"""
SELECT '{a}' AS table_name, '{', '.join(x)}' AS columns, '{b}' AS referenced_table,
       '{', '.join(y)}' AS referenced_columns, count(*) AS rows,
       count(*) FILTER (NOT EXISTS (SELECT 1 FROM {b} p WHERE p.{y[0]} = f.{x[0]})) AS orphans
FROM {a} f WHERE f.{x[0]} IS NOT NULL""" for a, x, b, y in FOREIGN_KEYS]),
    "catalog_columns": _COLUMNS,
    "find_columns": f"SELECT * FROM ({_COLUMNS}) WHERE upper(name) LIKE '%KEY%'",
    "volume_labels": f"""
SELECT table_name, CASE WHEN row_count < 100 THEN 'catálogo pequeño' WHEN row_count < 1000 THEN 'catálogo mediano'
  WHEN row_count < 10000 THEN 'volumen moderado' WHEN row_count < 100000 THEN 'volumen alto'
  ELSE 'volumen muy alto' END || ' (' || format('{{:,}}', row_count) || ' registros)' AS volume
FROM ({_COUNTS})""",
    "vector_topk": _TOPK + """
SELECT query_id, id, similarity, CAST(place AS INTEGER) AS place FROM r WHERE place <= 15""",
    "vector_rescore": _TOPK + """
, n AS (SELECT label, count(*) AS row_count FROM embeddings GROUP BY 1)
SELECT query_id, id, similarity, round(greatest(0e0, least(1e0, similarity * 0.6e0 + 0.2e0 * (
         least(log10(row_count + 1) / 6e0, 1e0) * 0.4e0 + 0.2e0 * 0.3e0 + 0.2e0
         + CASE WHEN n.label = query_id THEN 0.1e0 ELSE 0e0 END))), 5) AS score
FROM r JOIN n ON n.label = r.label WHERE place <= 15""",
    "fk_neighbours": _FOUND + """,
e AS (SELECT table_name AS a, referenced_table AS b FROM found
      WHERE table_name <> referenced_table AND regexp_replace("column", '^[a-z]{1,2}_', '') = regexp_replace(referenced_column, '^[a-z]{1,2}_', ''))
SELECT DISTINCT a AS table_name, b AS related, 'outgoing' AS direction FROM e
UNION ALL SELECT DISTINCT b, a, 'incoming' FROM e WHERE (b, a) NOT IN (SELECT a, b FROM e)""",
    "vector_index_topk": """
WITH sims AS (SELECT q.vec_id AS query_id, e.vec_id AS id,
                     round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity
              FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)
SELECT query_id, id, similarity, CAST(place AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS place FROM sims WHERE similarity >= 0.30)
WHERE place <= 10""",
    "found_references": _FOUND + """
SELECT table_name, "column", referenced_table, referenced_column, "values", referenced_values FROM found""",
    "catalog_refresh": f"""
SELECT table_name, CASE table_name
    WHEN 'events' THEN (SELECT count(*) FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY)
    WHEN 'orders' THEN (SELECT count(*) FROM orders WHERE year(o_orderdate) < (SELECT max(year(o_orderdate)) FROM orders))
    ELSE row_count END AS row_count, true AS active, CASE WHEN table_name IN ('events', 'orders') THEN 1 ELSE 0 END AS age_hours
FROM ({_COUNTS}) WHERE table_name <> 'pages'""",
    "synonym_expand": f"""
SELECT doc_id, CASE WHEN added = '' THEN '' ELSE ' ' || added END AS added
FROM (SELECT doc_id, concat_ws(' ', {_SYN}) AS added FROM documents)""",
    "keyword_search": """
SELECT doc_id AS id, source AS name,
  CASE WHEN contains(lower(source), 'web') OR contains(lower(source), 'en') OR contains(lower(source), 'the') THEN 20 ELSE 0 END
  + CASE WHEN contains(lower(text), 'web') OR contains(lower(text), 'en') OR contains(lower(text), 'the') THEN 15 ELSE 0 END
  + CASE WHEN contains(lower(lang), 'web') OR contains(lower(lang), 'en') OR contains(lower(lang), 'the') THEN 10 ELSE 0 END
  + least(n_chars / 100, 100e0) * 0.3e0 AS score
FROM documents ORDER BY score DESC, id LIMIT 25""",
    "sql_audit": f"""
SELECT {_VERDICT} AS verdict, count(*) AS statements
FROM (SELECT {_strip('upper(text)')} AS u FROM documents) GROUP BY 1""",
    "table_usage": r"""
SELECT table_name, count(*) AS statements FROM (
  SELECT unnest(list_distinct(regexp_extract_all(upper(text), '\b(?:FROM|JOIN)\s+(\w+)', 1))) AS table_name
  FROM documents) GROUP BY 1""",
    "question_complexity": _SCORED + f"""
SELECT conv_id, turn, {', '.join(f'{n}_words' for n in D.COMPLEXITY_WORDS)}, multi_words, n_tables,
       heavy_tables, CAST(n_words AS INTEGER) AS n_words, CAST(score AS INTEGER) AS score, level,
       {_TIER} AS tier FROM z""",
    "tier_shares": _SCORED + f"""
SELECT {_TIER} AS tier, count(*) AS questions,
       round(count(*) * 100e0 / (SELECT count(*) FROM z), 1) AS percentage FROM z GROUP BY 1""",
    "stream_usage": _SCORED + f"SELECT {_TIER} AS tier, count(*) AS questions FROM z GROUP BY 1",
    "intent_flags": f"""
SELECT conv_id, turn, len(list_filter([{_quoted(D.intent_words())}], lambda w: contains(lower(text), w))) > 0 AS asks_for_data
FROM conversations WHERE role = 'user'""",
    "clean_answers": rf"""
SELECT conv_id, turn, {_strip('a')} AS answer FROM (
  SELECT conv_id, turn, array_to_string(list_filter(string_split(
    regexp_replace(text, '(?s)```sql\s*.*?\s*```', '', 'g'), chr(10)), lambda x: NOT ({_NAMED_SQL})), chr(10)) AS a
  FROM conversations WHERE role = 'assistant')""",
    "recent_questions": f"""
SELECT question, turn, conv_id FROM (
  SELECT text AS question, turn, conv_id,
         row_number() OVER (PARTITION BY text ORDER BY turn DESC, conv_id DESC) AS n
  FROM conversations WHERE role = 'user' AND {_strip('text')} <> '') WHERE n = 1
ORDER BY turn DESC, conv_id DESC, question LIMIT 10""",
    "slow_events": """
SELECT CASE WHEN value > 10 THEN 'slow' WHEN value > 5 THEN 'notice' ELSE 'ok' END AS speed,
       count(*) AS statements, max(value) AS longest FROM events GROUP BY 1""",
    "conv_summary": _SUMMARY,
    "conv_list": f"SELECT session, title, updated_at FROM ({_SUMMARY})",
    "conv_search": f"""
SELECT session, title, (SELECT count(*) FROM conversations c WHERE c.conv_id = session
                        AND contains(lower(text), 'the on')) AS matching
FROM ({_SUMMARY}) WHERE contains(lower(title), 'the on') OR session IN (
  SELECT conv_id FROM conversations WHERE contains(lower(text), 'the on'))""",
    "conv_context": """
SELECT conv_id AS session, turn AS at, role, text, CAST(n AS INTEGER) AS back FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
WHERE n <= 10 AND role IN ('user', 'assistant')""",
    "session_buckets": """
WITH u AS (SELECT user_id, max(ts) AS t, count(*) AS n FROM events GROUP BY 1),
d AS (SELECT *, date_diff('day', CAST(t AS DATE), (SELECT CAST(max(ts) AS DATE) FROM events)) AS age FROM u)
SELECT CASE WHEN age = 0 THEN 'Hoy' WHEN age = 1 THEN 'Ayer' WHEN age <= 7 THEN 'Esta semana'
            WHEN age <= 30 THEN 'Este mes' ELSE 'Anteriores' END AS bucket,
       count(*) AS conversations, CAST(sum(n) AS BIGINT) AS messages FROM d GROUP BY 1""",
    "latest_event_per_user": """
SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
    "stream_session_state": """
SELECT user_id AS session, count(*) AS messages, max(ts) AS updated_at,
       arg_max(event_type, (ts, event_id)) AS last_role FROM events GROUP BY 1""",
    "stream_export": "SELECT event_id, user_id, value FROM events WHERE event_type = 'error'",
    "text_functions": """
SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE left(text, 57) || '...' END AS short,
       format('{:,}', n_chars) AS chars, regexp_matches(text, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') AS date_like,
       lang AS plain FROM documents""",
    "date_functions": """
SELECT o_custkey, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS moment,
       strftime(max(o_orderdate), '%Y-%m-%d') AS day FROM orders GROUP BY 1""",
}


_FORMS = (
    "'SELECT * FROM ' || e", "'with x as (select 1 as a) select a from x join ' || e || ' on 1 = 1'", "'DELETE FROM ' || e",
    "'SELECT * FROM ' || e || '; DROP TABLE ' || e", "'SELECT xp_run FROM ' || e",
    "'SELECT a -- the ' || e || chr(10) || '  FROM ' || e", "'SELECT /* of' || chr(10) || ' ' || e || ' */ a  FROM ' || e",
    "'SELECT a FROM ' || e || ' UNION SELECT a FROM other'", "'SELECT a FROM ' || e || '; SELECT 2'", "' ' || chr(10) || ' '")
_STATEMENTS = ("SELECT CASE event_id % 10 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_FORMS))
               + " END AS text FROM (SELECT event_id, coalesce(event_type, '') AS e FROM events)")
_STATEMENT_JOBS = {
    "statement_audit": f"""
SELECT {_VERDICT} AS verdict, count(*) AS statements
FROM (SELECT {_strip('upper(text)')} AS u FROM ({_STATEMENTS})) GROUP BY 1""",
    "statement_usage": rf"""
SELECT table_name, count(*) AS statements FROM (
  SELECT unnest(list_distinct(regexp_extract_all(upper(text), '\b(?:FROM|JOIN)\s+(\w+)', 1))) AS table_name
  FROM ({_STATEMENTS})) GROUP BY 1""",
    "statement_texts": rf"""
SELECT trim(regexp_replace(regexp_replace(regexp_replace(text, '--[^\n]*', '', 'g'), '(?s)/\*.*?\*/', '', 'g'), '\s+', ' ', 'g')) AS plain,
       count(*) AS statements FROM ({_STATEMENTS}) GROUP BY 1""",
}


# the categories again: words of the table's name, else what its columns hold
def _holds(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _means(label: str) -> str:
    return _holds("cols", D.FIELD_MEANINGS[label])


_CATEGORIES = f"""
SELECT table_name, CASE {' '.join(f"WHEN {_holds('lower(table_name)', words)} THEN '{label}'" for label, words in D.CATEGORIES)}
  WHEN {_means('importes y precios')} AND {_means('fechas y tiempos')} THEN 'TRANSACCIONES'
  WHEN {_means('nombres y descripciones')} AND k <= 10 THEN 'CATALOGOS' ELSE 'OTROS' END AS category
FROM (SELECT table_name, string_agg(lower(name), ' ') AS cols, count(*) AS k FROM ({_COLUMNS}) GROUP BY 1)"""
_REFERENCES = ", ".join(f"('{a}', '{b}', {n})" for n, (a, _, b, _) in enumerate(FOREIGN_KEYS))
_CATALOG_JOBS = {
    "category_index": f"SELECT category, count(*) AS tables FROM ({_CATEGORIES}) GROUP BY 1",
    "extraction_check": f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY place) AS n FROM (VALUES {_REFERENCES}) v(src, dst, place)),
few AS (SELECT src || ' -> ' || dst AS line FROM r WHERE n <= 3 ORDER BY src, n LIMIT 10)
SELECT (SELECT count(*) FROM ({_COUNTS})) AS total_tables, (SELECT count(DISTINCT src) FROM r) AS tables_with_foreign_keys,
       (SELECT count(*) FROM r) AS total_foreign_keys, (SELECT string_agg(line, '; ' ORDER BY line) FROM few) AS examples""",
    "expand_related": f"""
WITH h AS (SELECT table_name, least(log10(sum(rows) + 1) / 6, 1.0) AS score FROM ({_JOBS['fk_integrity']}) GROUP BY 1),
best AS (SELECT *, row_number() OVER (ORDER BY score DESC, table_name) AS n FROM h QUALIFY n <= 3),
e AS (SELECT * FROM (VALUES {_EDGES}) v(src, dst)),
near AS (SELECT table_name, related, min(side) AS side FROM (
  SELECT src AS table_name, dst AS related, 0 AS side FROM e UNION ALL SELECT dst, src, 1 FROM e WHERE src <> dst) GROUP BY 1, 2),
x AS (SELECT r.related AS name, b.score * 0.75 AS score, b.n, row_number() OVER (PARTITION BY b.n ORDER BY side, r.related) AS m
      FROM best b JOIN near r ON r.table_name = b.table_name QUALIFY m <= 5),
ways AS (SELECT table_name AS name, score, false AS related, 0 AS n, 0 AS m FROM h UNION ALL SELECT name, score, true, n, m FROM x)
SELECT name AS table_name, round(score, 6) AS score, related FROM ways
QUALIFY row_number() OVER (PARTITION BY name ORDER BY n, m) = 1""",
}


def jobs_sql() -> dict[str, str]:
    reported = sales_sql()["sales_by_customer"].replace(" AND day >= DATE '2001-01-01'", "")
    return {**_JOBS, **_STATEMENT_JOBS, **_CATALOG_JOBS, "report_csv": reported, "report_json": reported}
