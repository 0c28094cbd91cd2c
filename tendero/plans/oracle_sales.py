"""ANSI SQL for the sales questions, run by an independent engine as a check."""

BASE = """
WITH h AS (
  SELECT o_orderkey AS doc_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS day,
         o_orderstatus AS doc_type, o_orderpriority AS seller,
         CAST(o_totalprice AS DECIMAL(12,2)) AS doc_total
  FROM orders),
l AS (
  SELECT l_orderkey AS doc_id, l_linenumber AS line_no, l_partkey AS article_id,
         l_suppkey AS warehouse_id, CAST(l_quantity AS DECIMAL(12,2)) AS units,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS gross,
         CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) AS net,
         CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS discount,
         l_returnflag AS flag, CAST(l_shipdate AS DATE) AS moved_day
  FROM lineitem),
a AS (
  SELECT p_partkey AS article_id, p_name AS article, p_brand AS code, p_type AS line,
         CAST(p_retailprice AS DECIMAL(12,2)) AS cost, p_size * 5 AS minimum,
         p_type <> 'PROMO' AS active
  FROM part),
cu AS (SELECT c_custkey AS customer_id, c_name AS customer, c_nationkey AS nation_id,
              c_mktsegment AS segment FROM customer),
w AS (SELECT s_suppkey AS warehouse_id, s_name AS warehouse, s_nationkey AS nation_id FROM supplier),
z AS (SELECT n_nationkey AS nation_id, n_name AS nation, r_name AS zone
      FROM nation JOIN region ON n_regionkey = r_regionkey),
today AS (SELECT max(day) AS d FROM h),
s AS (SELECT h.doc_id, customer_id, day, seller, line_no, article_id, warehouse_id, units, gross, net, discount
      FROM h JOIN l ON h.doc_id = l.doc_id WHERE doc_type = 'F' AND units > 0 AND net > 0),
stock AS (SELECT article_id, warehouse_id, sum(units) AS stock FROM l WHERE flag = 'R' GROUP BY ALL),
stock_a AS (SELECT article_id, sum(units) AS stock FROM l WHERE flag = 'R' GROUP BY ALL),
price AS (SELECT article_id, CAST(sum(gross) AS DOUBLE) / CAST(sum(units) AS DOUBLE) AS price FROM l GROUP BY ALL)
"""


def _d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def _ratio(a: str, b: str) -> str:
    return f"{_d(a)} / nullif({_d(b)}, 0)"


def _pct(a: str, b: str) -> str:
    return f"{_d(a)} / nullif({_d(b)}, 0) * 100"


_NOT_ROD = "(article IS NULL OR (article NOT LIKE '%rod%' AND article NOT LIKE '%widget%'))"
_LATEST = f"""
SELECT doc_id, day, line_no, x.warehouse_id, x.article_id, article, {_d('units')} AS units,
       {_d('net')} AS amount, warehouse
FROM (SELECT s.*, article FROM s LEFT JOIN a ON s.article_id = a.article_id
      WHERE @when AND {_NOT_ROD}
      ORDER BY day DESC, doc_id DESC, line_no, s.article_id, warehouse_id, units, net LIMIT 1) x
LEFT JOIN w ON x.warehouse_id = w.warehouse_id"""
_YEAR = "day >= DATE '2000-01-01' AND day < DATE '2001-01-01'"
_MARGINS = f"""
SELECT a.article_id, article, line, price, {_d('cost')} AS cost,
       price - {_d('cost')} AS profit,
       (price - {_d('cost')}) / nullif({_d('cost')}, 0) * 100 AS margin_pct
FROM a JOIN price ON a.article_id = price.article_id WHERE active AND cost > 0"""
_TOP_CUSTOMERS = f"""
SELECT x.customer_id, {_d('amount')} AS amount, documents, customer
FROM (SELECT customer_id, sum(net) AS amount, count(DISTINCT doc_id) AS documents FROM s
      WHERE @when GROUP BY customer_id ORDER BY amount DESC, customer_id LIMIT @k) x
JOIN cu ON x.customer_id = cu.customer_id"""
_COMPARED = f"""{_d('coalesce(this_period, 0)')} AS this_period, {_d('coalesce(before, 0)')} AS before,
       {_d('coalesce(this_period, 0) - coalesce(before, 0)')} AS difference,
       {_pct('coalesce(this_period, 0) - coalesce(before, 0)', 'coalesce(before, 0)')} AS change_pct"""

_SQL = {
    "article_sales_month": f"""
SELECT s.article_id, article, count(DISTINCT doc_id) AS documents, {_d('sum(units)')} AS units,
       {_d('sum(net)')} AS amount
FROM s JOIN a ON s.article_id = a.article_id
WHERE article = 'red plate' AND day >= DATE '2000-09-01' AND day < DATE '2000-10-01'
GROUP BY s.article_id, article""",
    "last_sale": _LATEST.replace("@when", "day >= (SELECT d - 90 FROM today)"),
    "last_sale_in_period": _LATEST.replace("@when", "day >= DATE '1998-02-01' AND day < DATE '1998-03-01'"),
    "widened_last_sale": _LATEST.replace("@when", "day >= (SELECT d - 90 FROM today)"),
    "best_selling_article": f"""
SELECT a.article_id, article, {_d('sum(units)')} AS units, {_d('sum(gross)')} AS amount
FROM h JOIN l ON h.doc_id = l.doc_id JOIN a ON a.article_id = l.article_id
WHERE day >= DATE '1998-02-01' AND day < DATE '1998-03-01' AND units > 0
  AND article NOT LIKE '%rod%' AND article NOT LIKE '%widget%'
GROUP BY a.article_id, article ORDER BY sum(units) DESC, a.article_id LIMIT 1""",
    "month_totals": f"""
SELECT count(*) AS lines, count(DISTINCT h.doc_id) AS documents, {_d('sum(gross)')} AS total,
       {_ratio('sum(gross)', 'count(*)')} AS mean_line,
       {_ratio('sum(gross)', 'count(DISTINCT h.doc_id)')} AS mean_ticket
FROM h JOIN l ON h.doc_id = l.doc_id
WHERE doc_type = 'F' AND day >= DATE '2001-07-01' AND day < DATE '2001-08-01'""",
    "sales_by_customer": f"""
SELECT h.customer_id, customer, count(DISTINCT h.doc_id) AS documents, {_d('sum(units)')} AS units,
       {_d('sum(gross)')} AS amount
FROM h JOIN l ON h.doc_id = l.doc_id JOIN cu ON cu.customer_id = h.customer_id
WHERE doc_type = 'F' AND day >= DATE '2001-01-01' GROUP BY h.customer_id, customer""",
    "low_stock": f"""
SELECT a.article_id, article, code, {_d('stock')} AS stock, minimum, warehouse AS supplier
FROM a LEFT JOIN stock_a ON a.article_id = stock_a.article_id
LEFT JOIN (SELECT article_id, min(warehouse_id) AS warehouse_id FROM l GROUP BY 1) f
  ON f.article_id = a.article_id
LEFT JOIN w ON w.warehouse_id = f.warehouse_id
WHERE active AND coalesce(stock, 0) < minimum""",
    "top_margin": f"""
SELECT article_id, article, price, cost, profit, margin_pct FROM ({_MARGINS})
ORDER BY margin_pct DESC, article_id LIMIT 20""",
    "monthly_growth": f"""
, m AS (SELECT CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month,
               sum(gross) AS total
        FROM h JOIN l ON h.doc_id = l.doc_id WHERE day >= DATE '1997-01-01' GROUP BY ALL),
p AS (SELECT *, lag(total) OVER (ORDER BY year, month) AS previous FROM m)
SELECT year, month, {_d('total')} AS total, {_d('previous')} AS previous,
       ({_d('total')} - {_d('previous')}) / nullif({_d('previous')}, 0) * 100 AS growth_pct
FROM p""",
    "customer_trend": f"""
, m AS (SELECT customer_id, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month,
               sum(gross) AS total, count(DISTINCT h.doc_id) AS documents, count(*) AS lines
        FROM h JOIN l ON h.doc_id = l.doc_id WHERE day >= DATE '2000-01-01' GROUP BY ALL),
p AS (SELECT *, lag(total) OVER w AS previous,
             sum(total) OVER (PARTITION BY customer_id ORDER BY year, month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS ws,
             count(*) OVER (PARTITION BY customer_id ORDER BY year, month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS wr
      FROM m WINDOW w AS (PARTITION BY customer_id ORDER BY year, month))
SELECT p.customer_id, customer, year, month, {_d('total')} AS total, documents,
       {_ratio('total', 'lines')} AS mean_line, {_d('previous')} AS previous,
       ({_d('total')} - {_d('previous')}) / nullif({_d('previous')}, 0) * 100 AS growth_pct,
       {_ratio('ws', 'wr')} AS mean_3m
FROM p JOIN cu ON cu.customer_id = p.customer_id WHERE previous IS NOT NULL AND previous <> 0""",
    "sales_today": f"""
SELECT count(*) AS documents, {_d('sum(doc_total)')} AS total FROM h WHERE day = (SELECT d FROM today)""",
    "active_articles": "SELECT count(*) AS active_articles FROM a WHERE active",
    "stock_of_article": f"""
SELECT article_id, {_d('sum(units)')} AS stock FROM l WHERE flag = 'R' AND article_id = 100 GROUP BY 1""",
    "stock_of": f"""
SELECT article_id, warehouse_id, {_d('sum(units)')} AS stock FROM l
WHERE flag = 'R' AND article_id = 100 GROUP BY ALL""",
    "sales_between": f"""
SELECT day, count(DISTINCT doc_id) AS documents, {_d('sum(units)')} AS units, {_d('sum(net)')} AS amount
FROM s WHERE {_YEAR} GROUP BY day""",
    "avg_cost": f"""
SELECT l.article_id, {_d('sum(units)')} AS units, {_d('sum(units * cost)')} AS spent,
       {_ratio('sum(units * cost)', 'sum(units)')} AS average_cost
FROM l JOIN a ON l.article_id = a.article_id GROUP BY l.article_id""",
    "stock_of_lateral": f"""
SELECT a.article_id, warehouse_id, {_d('sum(units)')} AS stock
FROM a JOIN l ON l.article_id = a.article_id WHERE flag = 'R' GROUP BY ALL""",
    "sales_between_lateral": f"""
SELECT CAST(date_trunc('month', day) AS DATE) AS month, day, count(DISTINCT doc_id) AS documents,
       {_d('sum(units)')} AS units, {_d('sum(net)')} AS amount
FROM s GROUP BY ALL""",
    "avg_cost_lateral": f"""
SELECT a.article_id, {_d('sum(units)')} AS units, {_d('sum(units * cost)')} AS spent,
       {_ratio('sum(units * cost)', 'sum(units)')} AS average_cost
FROM a LEFT JOIN l ON l.article_id = a.article_id GROUP BY a.article_id""",
    "sales_detail": f"""
SELECT h.doc_id, day, line_no, warehouse, l.article_id, code, article, {_d('units')} AS units,
       {_d('net')} AS net
FROM h JOIN l ON h.doc_id = l.doc_id LEFT JOIN a ON a.article_id = l.article_id
LEFT JOIN w ON w.warehouse_id = l.warehouse_id
WHERE doc_type IS NOT NULL AND day >= DATE '2001-01-01'""",
    "latest_invoices": f"""
SELECT x.customer_id, doc_id, day, doc_type, {_d('doc_total')} AS doc_total, customer
FROM (SELECT * FROM h ORDER BY day DESC, doc_id DESC LIMIT 5) x
LEFT JOIN cu ON x.customer_id = cu.customer_id""",
    "invoice_lines": f"""
SELECT doc_id, line_no, x.article_id, article, {_d('units')} AS units,
       {_d('gross')} / {_d('units')} AS unit_price, {_d('net')} AS net
FROM (SELECT * FROM l WHERE doc_id = (SELECT doc_id FROM h WHERE doc_type = 'F'
                                      ORDER BY day DESC, doc_id DESC LIMIT 1)
      ORDER BY line_no, article_id, warehouse_id, units, net LIMIT 10) x
LEFT JOIN a ON a.article_id = x.article_id""",
    "sale_filter_funnel": f"""
SELECT count(*) AS all_lines, count(*) FILTER (units > 0) AS with_units,
       count(*) FILTER (net > 0) AS with_price, count(l.article_id) AS with_article,
       count(*) FILTER (units > 0 AND net > 0 AND {_NOT_ROD}) AS all_filters
FROM l LEFT JOIN a ON a.article_id = l.article_id""",
    "top_customers_year": _TOP_CUSTOMERS.replace("@when", _YEAR).replace("@k", "10"),
    "top5_buyers_month": _TOP_CUSTOMERS.replace(
        "@when", "day >= (SELECT date_trunc('month', max(day)) FROM h WHERE doc_type = 'F')").replace("@k", "5"),
    "sales_yoy_month": f"""
, n AS (SELECT CAST(month(day) AS INTEGER) AS month, sum(net) AS this_period FROM s WHERE year(day) = 2000 GROUP BY 1),
b AS (SELECT CAST(month(day) AS INTEGER) AS month, sum(net) AS before FROM s WHERE year(day) = 1999 GROUP BY 1)
SELECT coalesce(n.month, b.month) AS month, {_COMPARED} FROM n FULL JOIN b ON n.month = b.month""",
    "customer_ticket": f"""
SELECT s.customer_id, {_d('sum(net)')} AS amount, count(DISTINCT doc_id) AS documents,
       {_ratio('sum(net)', 'count(DISTINCT doc_id)')} AS mean_ticket, customer
FROM s JOIN cu ON cu.customer_id = s.customer_id WHERE {_YEAR} GROUP BY s.customer_id, customer""",
    "top5_per_line": f"""
SELECT article_id, {_d('units')} AS units, article, line, CAST(place AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY units DESC, article_id) AS place FROM (
    SELECT a.article_id, article, line, sum(units) AS units
    FROM s JOIN a ON a.article_id = s.article_id WHERE {_YEAR} GROUP BY ALL)) WHERE place <= 5""",
    "return_rate": f"""
SELECT l.article_id, {_d('sum(units)')} AS units,
       {_d("sum(units) FILTER (flag = 'R')")} AS returned,
       {_pct("sum(units) FILTER (flag = 'R')", 'sum(units)')} AS return_pct, article
FROM l JOIN a ON a.article_id = l.article_id GROUP BY l.article_id, article
HAVING sum(units) FILTER (flag = 'R') > 0""",
    "rotation": f"""
SELECT x.article_id, {_d('sold')} AS sold, {_d('stock')} AS stock, {_ratio('sold', 'stock')} AS rotation,
       article
FROM (SELECT article_id, sum(units) AS sold FROM s
      WHERE day >= (SELECT d - INTERVAL 3 MONTH FROM today) GROUP BY 1) x
LEFT JOIN stock_a ON stock_a.article_id = x.article_id JOIN a ON a.article_id = x.article_id""",
    "stock_value": f"""
SELECT stock.warehouse_id, count(*) AS articles, {_d('sum(stock)')} AS stock,
       {_d('sum(stock * cost)')} AS value, warehouse
FROM stock JOIN a ON a.article_id = stock.article_id JOIN w ON w.warehouse_id = stock.warehouse_id
GROUP BY stock.warehouse_id, warehouse""",
    "no_movement": """
SELECT article_id, article, line FROM a
WHERE article_id NOT IN (SELECT article_id FROM h JOIN l ON h.doc_id = l.doc_id
                         WHERE day >= (SELECT d - INTERVAL 6 MONTH FROM today))
  AND article_id NOT IN (SELECT article_id FROM l
                         WHERE moved_day >= (SELECT d - INTERVAL 6 MONTH FROM today))""",
    "stock_by_wh_supplier": f"""
SELECT nation, warehouse AS supplier, {_d('sum(stock)')} AS stock, {_d('sum(stock * cost)')} AS value
FROM stock JOIN a ON a.article_id = stock.article_id JOIN w ON w.warehouse_id = stock.warehouse_id
JOIN z ON z.nation_id = w.nation_id GROUP BY nation, warehouse""",
    "stock_evolution": f"""
, m AS (SELECT CAST(date_trunc('month', moved_day) AS DATE) AS month,
               coalesce(sum(units) FILTER (flag = 'R'), 0) AS units_in,
               coalesce(sum(units) FILTER (flag = 'A'), 0) AS units_out FROM l GROUP BY 1)
SELECT month, {_d('units_in')} AS units_in, {_d('units_out')} AS units_out,
       {_d('sum(units_in - units_out) OVER (ORDER BY month)')} AS held FROM m""",
    "critical_stock": f"""
SELECT stock.article_id, warehouse_id, {_d('stock')} AS stock, article
FROM stock JOIN a ON a.article_id = stock.article_id WHERE stock < 10""",
    "margin_by_line": f"""
SELECT line, count(*) AS articles, round(avg(margin_pct), 2) AS mean_margin_pct
FROM ({_MARGINS}) GROUP BY line""",
    "receivables": f"""
SELECT h.customer_id, count(*) AS open_documents, {_d('sum(doc_total)')} AS balance, customer
FROM h JOIN cu ON cu.customer_id = h.customer_id WHERE doc_type IN ('O', 'P')
GROUP BY h.customer_id, customer""",
    "sales_vs_purchases": f"""
, x AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, sum(net) AS sold FROM s WHERE {_YEAR} GROUP BY 1),
y AS (SELECT CAST(date_trunc('month', moved_day) AS DATE) AS month, sum(units * cost) AS bought
      FROM l JOIN a ON a.article_id = l.article_id
      WHERE moved_day >= DATE '2000-01-01' AND moved_day < DATE '2001-01-01' GROUP BY 1)
SELECT coalesce(x.month, y.month) AS month, {_d('coalesce(sold, 0)')} AS sold,
       {_d('coalesce(bought, 0)')} AS bought,
       {_d('coalesce(sold, 0) - coalesce(bought, 0)')} AS difference
FROM x FULL JOIN y ON x.month = y.month""",
    "discount_by_customer": f"""
SELECT s.customer_id, {_d('sum(discount)')} AS discount, {_d('sum(gross)')} AS gross,
       {_pct('sum(discount)', 'sum(gross)')} AS discount_pct, customer
FROM s JOIN cu ON cu.customer_id = s.customer_id WHERE {_YEAR} GROUP BY s.customer_id, customer""",
    "zone_stats": f"""
SELECT zone, {_d('sum(net)')} AS amount, count(DISTINCT doc_id) AS documents,
       count(DISTINCT s.customer_id) AS customers,
       {_ratio('sum(net)', 'count(DISTINCT doc_id)')} AS mean_ticket,
       {_ratio('count(DISTINCT doc_id)', 'count(DISTINCT s.customer_id)')} AS documents_per_customer
FROM s JOIN cu ON cu.customer_id = s.customer_id JOIN z ON z.nation_id = cu.nation_id GROUP BY zone""",
    "new_customers_month": """
SELECT CAST(date_trunc('month', f) AS DATE) AS month, count(*) AS new_customers
FROM (SELECT customer_id, min(day) AS f FROM h GROUP BY 1) GROUP BY 1""",
    "bought_now_not_before": """
SELECT h.customer_id, count(*) AS documents, customer FROM h JOIN cu ON cu.customer_id = h.customer_id
WHERE day >= (SELECT date_trunc('month', d) FROM today)
  AND h.customer_id NOT IN (SELECT customer_id FROM h
        WHERE day >= (SELECT date_trunc('month', d) - INTERVAL 1 MONTH FROM today)
          AND day < (SELECT date_trunc('month', d) FROM today))
GROUP BY h.customer_id, customer""",
    "top_product_of_top_customers": f"""
, best AS ({_TOP_CUSTOMERS.replace('@when', 'TRUE').replace('@k', '10')}),
f AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY units DESC, article_id) AS n
      FROM (SELECT s.customer_id, article_id, sum(units) AS units
            FROM s SEMI JOIN best ON best.customer_id = s.customer_id GROUP BY ALL))
SELECT f.article_id, f.customer_id, customer, best.amount AS amount, {_d('units')} AS units, article
FROM f JOIN best ON best.customer_id = f.customer_id JOIN a ON a.article_id = f.article_id WHERE n = 1""",
    "inactive_customers": """
SELECT customer_id, customer, segment FROM cu
WHERE customer_id NOT IN (SELECT customer_id FROM h WHERE day >= (SELECT d - INTERVAL 3 MONTH FROM today))""",
    "purchases_by_supplier": f"""
SELECT l.warehouse_id, {_d('sum(units * cost)')} AS amount, count(DISTINCT doc_id) AS orders,
       warehouse AS supplier
FROM l JOIN a ON a.article_id = l.article_id JOIN w ON w.warehouse_id = l.warehouse_id
WHERE moved_day >= DATE '2000-01-01' AND moved_day < DATE '2001-01-01' GROUP BY l.warehouse_id, warehouse""",
    "articles_per_supplier": """
SELECT l.warehouse_id, count(DISTINCT l.article_id) AS articles, warehouse AS supplier
FROM l JOIN a ON a.article_id = l.article_id JOIN w ON w.warehouse_id = l.warehouse_id
WHERE active GROUP BY l.warehouse_id, warehouse""",
    "lead_time": """
SELECT l.warehouse_id, count(*) AS lines, avg(date_diff('day', day, moved_day)) AS mean_days,
       warehouse AS supplier
FROM h JOIN l ON h.doc_id = l.doc_id JOIN w ON w.warehouse_id = l.warehouse_id
GROUP BY l.warehouse_id, warehouse""",
    "top_suppliers": """
SELECT x.warehouse_id, movements, warehouse AS supplier
FROM (SELECT warehouse_id, count(*) AS movements FROM l
      WHERE moved_day >= (SELECT d - INTERVAL 6 MONTH FROM today) GROUP BY 1
      ORDER BY movements DESC, warehouse_id LIMIT 5) x JOIN w ON w.warehouse_id = x.warehouse_id""",
    "warehouse_ranking": f"""
SELECT x.warehouse_id, lines, {_d('amount')} AS amount, warehouse
FROM (SELECT warehouse_id, count(*) AS lines, sum(net) AS amount FROM s GROUP BY 1
      ORDER BY amount DESC, warehouse_id LIMIT 10) x JOIN w ON w.warehouse_id = x.warehouse_id""",
    "abc": f"""
, x AS (SELECT article_id, sum(net) AS amount FROM s GROUP BY 1),
r AS (SELECT *, sum(amount) OVER (ORDER BY amount DESC, article_id ROWS UNBOUNDED PRECEDING) AS running,
             sum(amount) OVER () AS total FROM x)
SELECT r.article_id, {_d('amount')} AS amount, {_ratio('running', 'total')} AS share,
       CASE WHEN {_ratio('running - amount', 'total')} < 0.80 THEN 'A'
            WHEN {_ratio('running - amount', 'total')} < 0.95 THEN 'B' ELSE 'C' END AS class, article
FROM r JOIN a ON a.article_id = r.article_id""",
    "cross_sell": """
, b AS (SELECT DISTINCT doc_id, article_id FROM l)
SELECT x.article_id AS left_article, y.article_id AS right_article, count(*) AS documents
FROM b x JOIN b y ON x.doc_id = y.doc_id AND x.article_id < y.article_id
GROUP BY ALL HAVING count(*) >= 2""",
    "seller_performance": f"""
SELECT seller, {_d('sum(net)')} AS amount, {_d('sum(units)')} AS units, count(DISTINCT doc_id) AS documents,
       {_ratio('sum(net)', 'count(DISTINCT doc_id)')} AS mean_ticket FROM s GROUP BY seller""",
    "seasonality": f"""
SELECT line, month, {_d('units')} AS units, CAST(place AS INTEGER) AS place FROM (
  SELECT line, CAST(month(day) AS INTEGER) AS month, sum(units) AS units,
         row_number() OVER (PARTITION BY line ORDER BY sum(units) DESC, month(day)) AS place
  FROM s JOIN a ON a.article_id = s.article_id GROUP BY line, month(day)) WHERE place <= 3""",
    "negative_margin": f"""
SELECT l.article_id, article, {_d('cost')} AS cost, count(*) AS lines,
       {_d('sum(units * cost - gross)')} AS loss,
       min({_d('gross')} / {_d('units')}) AS lowest_price
FROM l JOIN a ON a.article_id = l.article_id WHERE units > 0 AND gross < units * cost
GROUP BY l.article_id, article, cost""",
    "multi_criteria_articles": f"""
SELECT a.article_id, article, sales, {_d('stock')} AS stock, price
FROM a JOIN (SELECT article_id, count(*) AS sales FROM s
             WHERE day >= (SELECT d - INTERVAL 12 MONTH FROM today) GROUP BY 1) x
  ON x.article_id = a.article_id
JOIN stock_a ON stock_a.article_id = a.article_id JOIN price ON price.article_id = a.article_id
WHERE line = 'ECONOMY' AND sales > 1 AND stock > 10 AND price > 1000""",
    "zone_big_buyers": f"""
, x AS (SELECT s.* FROM s JOIN cu ON cu.customer_id = s.customer_id JOIN z ON z.nation_id = cu.nation_id
        WHERE zone = 'EUROPE' AND {_YEAR}),
y AS (SELECT customer_id, sum(net) AS amount, count(DISTINCT doc_id) AS documents FROM x GROUP BY 1
      HAVING sum(net) > 50000),
b AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY units DESC, article_id) AS n
      FROM (SELECT customer_id, article_id, sum(units) AS units FROM x GROUP BY ALL))
SELECT b.article_id, y.customer_id, customer, {_d('amount')} AS amount, documents, article AS top_article
FROM y JOIN b ON b.customer_id = y.customer_id AND n = 1 JOIN cu ON cu.customer_id = y.customer_id
JOIN a ON a.article_id = b.article_id""",
    "line_yoy": f"""
, x AS (SELECT line, day, net FROM s JOIN a ON a.article_id = s.article_id),
n AS (SELECT line, sum(net) AS this_period FROM x WHERE day >= DATE '2001-07-01' AND day < DATE '2001-08-01' GROUP BY 1),
b AS (SELECT line, sum(net) AS before FROM x WHERE day >= DATE '2000-07-01' AND day < DATE '2000-08-01' GROUP BY 1)
SELECT coalesce(n.line, b.line) AS line, {_COMPARED} FROM n FULL JOIN b ON n.line = b.line""",
    "overdue_customers": f"""
SELECT h.customer_id, count(*) AS documents, {_d('sum(doc_total)')} AS balance,
       CAST(max(date_diff('day', day, (SELECT d FROM today))) AS INTEGER) AS max_days, customer
FROM h JOIN cu ON cu.customer_id = h.customer_id
WHERE doc_type = 'O' AND day < (SELECT d - 30 FROM today) GROUP BY h.customer_id, customer""",
    "sales_drop_anomaly": f"""
, m AS (SELECT customer_id, CAST(date_trunc('month', day) AS DATE) AS month, sum(net) AS total FROM s GROUP BY ALL),
p AS (SELECT *, avg({_d('total')}) OVER w AS mean, stddev_samp({_d('total')}) OVER w AS spread,
             max(month) OVER (PARTITION BY customer_id) AS last_month
      FROM m WINDOW w AS (PARTITION BY customer_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT customer_id, month, {_d('total')} AS total, round(mean, 2) AS mean, round(spread, 2) AS spread
FROM p WHERE month = last_month AND {_d('total')} < mean - 2.0 * spread""",
    "frequent_customers": """
SELECT x.customer_id, documents, customer
FROM (SELECT customer_id, count(DISTINCT doc_id) AS documents FROM h GROUP BY 1
      ORDER BY documents DESC, customer_id LIMIT 10) x JOIN cu ON x.customer_id = cu.customer_id""",
    "executive_cube": f"""
SELECT segment, line, zone, count(*) AS lines, {_d('sum(units)')} AS units, {_d('sum(net)')} AS amount
FROM s JOIN a ON a.article_id = s.article_id JOIN cu ON cu.customer_id = s.customer_id
JOIN z ON z.nation_id = cu.nation_id GROUP BY CUBE (segment, line, zone)""",
    "sales_by_category": f"""
SELECT line, {_d('sum(units)')} AS units, {_d('sum(net)')} AS amount
FROM s JOIN a ON a.article_id = s.article_id GROUP BY line""",
    # operators behind the questions
    "preview_lines": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       (SELECT count(*) > 1000 FROM lineitem) AS has_more
FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice LIMIT 1000""",
    "page_of_documents": f"""
SELECT doc_id, day, customer_id, {_d('doc_total')} AS doc_total FROM h
ORDER BY day DESC, doc_id DESC LIMIT 50 OFFSET 100""",
    "exclude_system_articles": f"""
SELECT l.article_id, article, count(*) AS lines, {_d('sum(units)')} AS units
FROM l LEFT JOIN a ON a.article_id = l.article_id WHERE {_NOT_ROD} GROUP BY ALL""",
    "excluded_articles": f"""
SELECT l.article_id, article, count(*) AS lines, {_d('sum(units)')} AS units
FROM l JOIN a ON a.article_id = l.article_id WHERE article LIKE '%rod%' OR article LIKE '%widget%'
GROUP BY ALL""",
    "edge_case_filter": """
SELECT article_id, article, code, contains(upper(coalesce(article, '')), 'ROD')
       OR contains(upper(coalesce(article, '')), 'WIDGET') AS excluded FROM a""",
    "widen_until_found": f"""
, n AS (SELECT customer_id, max(day) AS last_day FROM h WHERE doc_type = 'F' GROUP BY 1),
b AS (SELECT customer_id, CASE WHEN last_day >= (SELECT d - 90 FROM today) THEN 90
             WHEN last_day >= (SELECT d - 180 FROM today) THEN 180
             WHEN last_day >= (SELECT d - 365 FROM today) THEN 365 END AS days FROM n)
SELECT h.customer_id, CAST(any_value(days) AS INTEGER) AS days, count(*) AS documents,
       {_d('sum(doc_total)')} AS total
FROM h JOIN b ON h.customer_id = b.customer_id
WHERE doc_type = 'F' AND (days IS NULL OR day >= (SELECT d FROM today) - CAST(days AS INTEGER))
GROUP BY h.customer_id""",
}


def sales_sql() -> dict[str, str]:
    return {key: BASE + body for key, body in _SQL.items()}
