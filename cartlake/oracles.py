"""Independent ANSI SQL for the registered queries, over the same benchmark tables."""

from __future__ import annotations

CUSTOMERS = """customers AS (
  SELECT c_custkey AS customer_id, c_name AS first_name, c_mktsegment AS last_name,
         c_name || '@example.org' AS email,
         CASE c_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Other' END AS gender,
         n_name AS country, DATE '2022-01-01' + CAST(c_custkey * 37 % 730 AS INTEGER) AS registration_date
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""
PRODUCTS = """products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
         CAST(p_retailprice AS DECIMAL(12,2)) AS price, p_brand || ' ' || p_name AS description
  FROM part)"""
PURCHASES = """purchases AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
         CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount, o_orderstatus AS status
  FROM orders)"""
SHIPPED = """shipped AS (
  SELECT purchases.*, country AS shipping_country FROM purchases LEFT JOIN customers USING (customer_id))"""
ITEMS = """items AS (
  SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id, l_partkey AS product_id,
         CAST(l_quantity AS INTEGER) AS quantity,
         CAST(floor(l_extendedprice * 100 / l_quantity) / 100 AS DECIMAL(12,2)) AS unit_price
  FROM lineitem)"""
REVIEWS = """reviews AS (
  SELECT event_id AS review_id, event_id // 6 AS product_id, user_id AS customer_id,
         CAST(floor(value) AS INTEGER) % 5 + 1 AS rating, event_type AS review_text,
         CAST(ts AS DATE) AS review_date
  FROM events)"""
LOGS = """logs AS (
  SELECT event_id, ts, user_id, event_type, CAST(value AS DECIMAL(12,2)) AS value FROM events)"""

ORDER_COLUMNS = "order_id, customer_id, order_date, CAST(total_amount AS DOUBLE) AS total_amount, status"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def _sliding(rule: str, severity: str, condition: str, key: str, minutes: int, every: int, threshold: int) -> str:
    """Count per key in every window that covers an event; a window starts each ``every`` minutes."""
    return f"""{_with(LOGS)},
spread AS (
  SELECT time_bucket(to_minutes({every}), ts) - to_minutes({every} * CAST(step AS INTEGER)) AS window_start,
         CAST({key} AS VARCHAR) AS key
  FROM logs, range({minutes // every}) AS steps(step) WHERE {condition})
SELECT '{rule}' AS rule, '{severity}' AS severity, window_start, window_start + to_minutes({minutes}) AS window_end, key,
       COUNT(*) AS event_count
FROM spread GROUP BY window_start, key HAVING COUNT(*) > {threshold}"""


def _tumbling(minutes: int, keys: str, measures: str) -> str:
    return f"""{_with(LOGS)},
slotted AS (SELECT time_bucket(to_minutes({minutes}), ts) AS window_start, * FROM logs)
SELECT window_start, window_start + to_minutes({minutes}) AS window_end, {keys} {measures}
FROM slotted GROUP BY ALL"""


ACCOUNT_ALERTS = _sliding("Repeated Errors", "High", "event_type = 'error'", "user_id", 15, 5, 1)
ERROR_ALERTS = _sliding("Costly Events", "Medium", "value >= 100", "event_type", 30, 10, 2)
EPISODES = f"""WITH alerting AS ({ERROR_ALERTS}),
marked AS (
  SELECT *, coalesce(window_start > MAX(window_end) OVER (PARTITION BY rule, key ORDER BY window_start
                                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens
  FROM alerting),
numbered AS (SELECT *, COUNT(*) FILTER (opens) OVER (PARTITION BY rule, key ORDER BY window_start) AS episode FROM marked)
SELECT rule, severity, key, MIN(window_start) AS "begin", MAX(window_end) AS "end", MAX(event_count) AS peak
FROM numbered GROUP BY rule, severity, key, episode"""
HOURS = f"""{_with(LOGS)}
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type AS metric,
       COUNT(value) AS samples, CAST(SUM(value) AS DOUBLE) / COUNT(value) AS average, CAST(MAX(value) AS DOUBLE) AS maximum
FROM logs GROUP BY ALL"""
ROLLUP = _tumbling(1, "event_type,", "CAST(SUM(value) AS DOUBLE) / COUNT(value) AS average, "
                   "CAST(MAX(value) AS DOUBLE) AS maximum")
REQUESTS = _tumbling(5, "", "COUNT(*) AS total")
EVOLVED = f"""{_with(CUSTOMERS, PURCHASES, SHIPPED)}
SELECT {ORDER_COLUMNS}, CASE WHEN order_date >= DATE '1999-01-01' THEN shipping_country END AS shipping_country
FROM shipped"""
WRITTEN = """written AS (
  SELECT CASE WHEN lang <> 'es' THEN source || '-' || lang || '.txt' ELSE 'hello_world_20240304_050607.txt' END AS filename,
         arg_max(coalesce(text, ''), doc_id) AS content
  FROM documents GROUP BY 1)"""


def _each_table(columns: str) -> str:
    """One SELECT per lake table; ``columns`` may use {name} and {width}."""
    sources = [("customers", "customers", 7), ("products", "products", 5), ("orders", "shipped", 6),
               ("order_items", "items", 5), ("product_reviews", "reviews", 6)]
    return _with(CUSTOMERS, PRODUCTS, PURCHASES, SHIPPED, ITEMS, REVIEWS) + "\n" + "\nUNION ALL ".join(
        f"SELECT '{name}' AS table_name, {columns.format(width=width)} COUNT(*) AS row_count FROM {view}"
        for name, view, width in sources)


def _unique(table: str, view: str, key: str) -> str:
    return (f"SELECT '{table}.{key} unique' AS check_name, COUNT(*) AS violations "
            f"FROM (SELECT {key} FROM {view} WHERE {key} IS NOT NULL GROUP BY {key} HAVING COUNT(*) > 1)\n"
            f"UNION ALL SELECT '{table}.{key} not null', COUNT(*) FROM {view} WHERE {key} IS NULL")


def _orphans(table: str, view: str, column: str, parent: str, parent_view: str) -> str:
    return (f"SELECT '{table}.{column} in {parent}', COUNT(*) FROM {view} AS child WHERE {column} IS NOT NULL "
            f"AND NOT EXISTS (SELECT 1 FROM {parent_view} AS p WHERE p.{column} = child.{column})")


ORACLES: dict[str, str] = {
    # Lines are counted per order and product once; sales, buyers and shares all come from these counts.
    "q01_top_seller_per_country": f"""{_with(CUSTOMERS, PRODUCTS, PURCHASES, SHIPPED, ITEMS, REVIEWS)},
baskets AS (SELECT product_id, order_id, COUNT(*) AS lines, SUM(quantity) AS pieces FROM items GROUP BY ALL),
sales AS (
  SELECT shipping_country, product_id, SUM(lines * total_amount) AS amount, SUM(pieces) AS pieces
  FROM shipped JOIN baskets ON baskets.order_id = shipped.order_id GROUP BY ALL),
placed AS (SELECT *, RANK() OVER (PARTITION BY shipping_country ORDER BY amount DESC) AS place FROM sales
           WHERE product_id IN (SELECT product_id FROM products)),
leaders AS (SELECT *, DENSE_RANK() OVER (ORDER BY amount DESC, shipping_country) AS country_place FROM placed WHERE place = 1),
per_buyer AS (
  SELECT product_id, customer_id, SUM(lines) AS lines
  FROM baskets JOIN purchases ON purchases.order_id = baskets.order_id
  WHERE product_id IN (SELECT product_id FROM leaders) GROUP BY ALL),
shares AS (
  SELECT product_id, COUNT(*) AS people, SUM(lines * CAST(gender = 'Male' AS INTEGER)) AS men,
         SUM(lines * CAST(gender = 'Female' AS INTEGER)) AS women
  FROM per_buyer JOIN customers ON customers.customer_id = per_buyer.customer_id GROUP BY product_id)
SELECT shipping_country AS country, product_name, CAST(amount AS DOUBLE) AS total_sales,
       CAST(leaders.pieces AS BIGINT) AS total_quantity,
       (SELECT SUM(rating) / CAST(COUNT(rating) AS DOUBLE) FROM reviews WHERE reviews.product_id = leaders.product_id)
         AS avg_rating,
       people AS customer_count, 100.0::DOUBLE * men / people AS male_percent,
       100.0::DOUBLE * women / people AS female_percent
FROM leaders JOIN products ON products.product_id = leaders.product_id
LEFT JOIN shares ON shares.product_id = leaders.product_id
WHERE country_place <= 10""",

    "q02_customer_demographics": f"""{_with(CUSTOMERS, PURCHASES)}
SELECT country, COUNT(DISTINCT customers.customer_id) AS total_customers,
       COUNT(*) FILTER (gender = 'Male') AS male_customers, COUNT(*) FILTER (gender = 'Female') AS female_customers,
       COUNT(DISTINCT order_id) AS total_orders,
       ROUND(CAST(SUM(total_amount) AS DOUBLE) / COUNT(total_amount), 2) AS avg_order_value
FROM customers LEFT JOIN purchases ON purchases.customer_id = customers.customer_id
GROUP BY country ORDER BY total_customers DESC, country LIMIT 10""",

    "q03_sales_by_category": f"""{_with(PRODUCTS, ITEMS)}
SELECT category, COUNT(DISTINCT order_id) AS total_orders, CAST(SUM(quantity) AS BIGINT) AS total_quantity_sold,
       CAST(SUM(quantity * unit_price) AS DOUBLE) AS total_revenue,
       ROUND(CAST(SUM(unit_price) AS DOUBLE) / COUNT(unit_price), 2) AS avg_price
FROM items JOIN products USING (product_id) GROUP BY category ORDER BY total_revenue DESC, category""",

    # The published segment names and lower bounds.
    "q04_customer_segments": f"""{_with(CUSTOMERS, PURCHASES)},
levels(customer_segment, least) AS (VALUES ('Low Frequency', 0), ('Medium Frequency', 5), ('High Frequency', 10)),
totals AS (SELECT customer_id, COUNT(*) AS orders, SUM(total_amount) AS spent FROM purchases GROUP BY customer_id),
ranged AS (
  SELECT coalesce(spent, 0) AS spent, (SELECT MAX(least) FROM levels WHERE least <= coalesce(orders, 0)) AS least
  FROM customers LEFT JOIN totals USING (customer_id))
SELECT customer_segment, COUNT(*) AS customer_count, ROUND(CAST(SUM(spent) AS DOUBLE) / COUNT(*), 2) AS avg_lifetime_value
FROM levels JOIN ranged USING (least) GROUP BY customer_segment""",

    "q05_customers_since": f"""{_with(CUSTOMERS)}
SELECT country, COUNT(*) AS customers FROM customers WHERE registration_date >= DATE '2023-01-01'
GROUP BY country ORDER BY customers DESC, country""",

    "q06_top_products": f"""{_with(PRODUCTS, ITEMS)}
SELECT product_name, category, CAST(SUM(quantity * unit_price) AS DOUBLE) AS total_revenue,
       COUNT(DISTINCT order_id) AS order_count
FROM items JOIN products USING (product_id) GROUP BY product_id, product_name, category
ORDER BY SUM(quantity * unit_price) DESC, product_id LIMIT 20""",

    "q07_monthly_sales": f"""{_with(PURCHASES)}
SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, COUNT(*) AS total_orders,
       CAST(SUM(total_amount) AS DOUBLE) AS total_revenue,
       CAST(SUM(total_amount) AS DOUBLE) / COUNT(total_amount) AS avg_order_value
FROM purchases WHERE order_date >= DATE '1998-01-01' GROUP BY 1 ORDER BY 1""",

    "q08_monthly_retention": f"""{_with(PURCHASES)},
active AS (
  SELECT DISTINCT customer_id, CAST(date_trunc('month', order_date) AS DATE) AS order_month FROM purchases)
SELECT cur.order_month, COUNT(cur.customer_id) AS active_customers, COUNT(past.customer_id) AS retained_customers,
       ROUND(100.0 * COUNT(past.customer_id) / COUNT(cur.customer_id), 2) AS retention_rate
FROM active AS cur LEFT JOIN active AS past ON past.customer_id = cur.customer_id
  AND past.order_month = CAST(cur.order_month - INTERVAL 1 MONTH AS DATE)
GROUP BY cur.order_month ORDER BY cur.order_month""",

    "q09_revenue_by_category": f"""{_with(PRODUCTS, ITEMS)}
SELECT category, CAST(SUM(quantity * unit_price) AS DOUBLE) AS revenue
FROM items JOIN products USING (product_id) GROUP BY category ORDER BY revenue DESC, category""",

    "q10_top_countries": f"""{_with(CUSTOMERS)}
SELECT country, COUNT(*) AS customers FROM customers GROUP BY country ORDER BY customers DESC, country LIMIT 10""",

    "q11_customers_of_country": f"{_with(CUSTOMERS)}\nSELECT * FROM customers WHERE country = 'NATION_1'",

    "order_line_revenue": f"""{_with(ITEMS)}
SELECT order_item_id, product_id, CAST(quantity * unit_price AS DOUBLE) AS revenue FROM items""",

    "orders_with_buyer": f"""{_with(CUSTOMERS, PURCHASES)}
SELECT {ORDER_COLUMNS}, gender, country FROM purchases LEFT JOIN customers USING (customer_id)""",

    **dict.fromkeys(("lines_of_a_hot_order", "bucketed_lines_of_a_hot_order"), f"""{_with(PURCHASES, ITEMS)},
moved AS (SELECT * REPLACE (CASE WHEN order_item_id % 3 = 0 THEN 1 ELSE order_id END AS order_id) FROM items)
SELECT order_item_id, moved.order_id, product_id, quantity, CAST(unit_price AS DOUBLE) AS unit_price,
       customer_id, order_date, status
FROM moved LEFT JOIN purchases ON purchases.order_id = moved.order_id"""),

    "order_totals_by_status": f"""{_with(PURCHASES)}
SELECT status, CAST(date_trunc('month', order_date) AS DATE) AS month, COUNT(*) AS order_count,
       CAST(SUM(total_amount) AS DOUBLE) AS total_amount
FROM purchases WHERE status IN ('F', 'O') GROUP BY 1, 2 HAVING COUNT(*) > 1""",

    "buyers_of_large_orders": f"""{_with(PURCHASES)}
SELECT status, COUNT(DISTINCT customer_id) AS buyers,
       COUNT(DISTINCT CASE WHEN total_amount >= 250000 THEN customer_id END) AS large_order_buyers
FROM purchases GROUP BY status""",

    "customer_active_months": f"""{_with(PURCHASES)},
months AS (SELECT DISTINCT customer_id, CAST(date_trunc('month', order_date) AS DATE) AS order_month FROM purchases)
SELECT *, LAG(order_month) OVER (PARTITION BY customer_id ORDER BY order_month) AS previous_active_month FROM months""",

    "dearest_products_per_category": f"""{_with(PRODUCTS)}
SELECT product_id, product_name, category, CAST(price AS DOUBLE) AS price, description
FROM products AS p WHERE price = (SELECT MAX(price) FROM products AS q WHERE q.category = p.category)""",

    "sql_with_parameters": f"""{_with(CUSTOMERS)}
SELECT gender, COUNT(*) AS customers FROM customers WHERE registration_date >= DATE '2023-01-01' GROUP BY gender""",

    "sql_on_files": "SELECT p_type AS category, COUNT(*) AS products FROM part GROUP BY p_type",

    "load_configured_tables": _each_table("'created' AS first_load, 'exists' AS second_load,"),
    "import_parquet_table": f"{_with(CUSTOMERS)}\nSELECT * FROM customers",
    "export_parquet": f"{_with(CUSTOMERS)}\nSELECT * FROM customers",
    "export_and_import_csv": f"""{_with(PURCHASES)}
SELECT order_id::INTEGER AS order_id, customer_id::INTEGER AS customer_id, order_date,
       CAST(total_amount AS DOUBLE) AS total_amount, status
FROM purchases WHERE order_date >= DATE '1999-01-01'""",
    "customers_as_records": f"""{_with(CUSTOMERS)},
top AS (SELECT country, COUNT(*) AS customers FROM customers GROUP BY country ORDER BY 2 DESC, 1 LIMIT 10)
SELECT '{{"country":"' || country || '","customers":' || customers || '}}' AS record FROM top""",
    "time_sliced_orders": f"""{_with(PURCHASES)}
SELECT {ORDER_COLUMNS} FROM purchases WHERE order_date >= DATE '1999-01-01'""",
    "rewritten_slice_of_orders": f"""{_with(PURCHASES)}
SELECT * REPLACE (CAST(CASE WHEN year(order_date) = 1998 THEN 2 * total_amount ELSE total_amount END AS DOUBLE) AS total_amount),
       CAST(year(order_date) AS INTEGER) AS slice_year FROM purchases""",
    "rewritten_period_of_orders": f"""{_with(PURCHASES)}
SELECT {ORDER_COLUMNS}, CAST(year(order_date) AS INTEGER) AS slice_year FROM purchases
WHERE order_date NOT BETWEEN DATE '1997-07-01' AND DATE '1998-03-31' OR order_id % 2 = 0""",
    "upserted_orders": f"""{_with(PURCHASES)},
merged AS (
  SELECT * REPLACE (CASE WHEN order_id % 50 = 0 THEN CAST(order_date + INTERVAL 1 YEAR AS DATE) ELSE order_date END AS order_date,
                    CASE WHEN order_id % 50 = 0 THEN 'M' ELSE status END AS status)
  FROM purchases WHERE order_id % 60 <> 7 OR order_id % 50 = 0
  UNION ALL SELECT * REPLACE (-order_id AS order_id) FROM purchases WHERE order_id % 75 = 1)
SELECT {ORDER_COLUMNS}, CAST(year(order_date) AS INTEGER) AS slice_year FROM merged""",
    "incrementally_loaded_orders": f"{_with(PURCHASES)}\nSELECT {ORDER_COLUMNS} FROM purchases",
    "widened_orders": f"""{_with(PURCHASES)}
SELECT order_id, customer_id, CAST(order_date AS TIMESTAMP) AS order_date, status,
       CASE WHEN order_date < DATE '1999-01-01' THEN CAST(CAST(total_amount AS FLOAT) AS DOUBLE)
            ELSE CAST(total_amount AS DOUBLE) END AS total_amount
FROM purchases""",
    "orders_loaded_as_declared": f"""{_with(PURCHASES)}
SELECT order_id, customer_id, order_date, CAST(total_amount AS DOUBLE) AS total_amount,
       CASE WHEN order_date >= DATE '1999-01-01' THEN status END AS status
FROM purchases""",
    "compacted_folders_keep_their_names": f"""{_with(PURCHASES)}
SELECT {ORDER_COLUMNS}, (['007', '07', '7', '1e2', '100', '0x1F', '2024-01-01'])[order_id % 7 + 1] AS code FROM purchases""",
    "clustered_orders": f"{_with(PURCHASES)}\nSELECT {ORDER_COLUMNS} FROM purchases",
    "changed_orders": f"""{_with(PURCHASES)},
late AS (SELECT * FROM purchases WHERE order_date >= DATE '1998-01-01')
SELECT -order_id AS order_id, 'inserted' AS change, CAST(0 AS BIGINT) AS rows_before, CAST(1 AS BIGINT) AS rows_after
FROM purchases WHERE order_id % 90 = 5
UNION ALL SELECT order_id, 'deleted', 1, 0 FROM late WHERE order_id % 40 = 3
UNION ALL SELECT order_id, 'updated', 1, 1 FROM late WHERE order_id % 30 = 0 AND order_id % 40 <> 3 AND status <> 'X'""",
    "orders_after_changes": f"""{_with(PURCHASES)}
SELECT {ORDER_COLUMNS.replace("status", "")}
       CASE WHEN order_date >= DATE '1998-01-01' AND order_id % 30 = 0 THEN 'X' ELSE status END AS status
FROM purchases WHERE order_date < DATE '1998-01-01' OR order_id % 40 <> 3
UNION ALL SELECT -order_id, customer_id, order_date, CAST(total_amount AS DOUBLE), status FROM purchases WHERE order_id % 90 = 5""",
    **dict.fromkeys(("alert_episodes", "alert_episodes_stream"), EPISODES),
    "hourly_metrics_from_states": HOURS,
    "order_statistics_from_slices": f"""{_with(PURCHASES)}
""" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", COUNT(*) AS rows, COUNT(*) FILTER ({c} IS NULL) AS nulls,
       CAST(MIN({c}) AS VARCHAR) AS least, CAST(MAX({c}) AS VARCHAR) AS greatest FROM purchases"""
                         for c in ("order_id", "customer_id", "order_date", "total_amount", "status")),
    "orphans_among_new_items": f"""{_with(PURCHASES, ITEMS)}
SELECT order_id, COUNT(*) AS occurrences FROM items
WHERE order_item_id % 4 = 1 AND order_id NOT IN (SELECT order_id FROM purchases WHERE order_id % 100 <> 3) GROUP BY order_id""",
    "csv_of_awkward_texts": """
SELECT doc_id, CASE WHEN lang = 'de' THEN '' WHEN lang <> 'fr'
       THEN text || ' "' || source || '", \\n' || chr(92) || chr(13) END AS text
FROM documents""",
    "export_and_read_texts": f"""{_with(WRITTEN)}
SELECT filename, length(content) AS characters, md5(content) AS digest FROM written""",
    "file_inventory": f"{_with(WRITTEN)}\nSELECT filename, strlen(content) + 1 AS size FROM written",
    "folder_summary": f"""{_with(WRITTEN)}
SELECT filename, CAST(1 AS BIGINT) AS file_count, strlen(content) + 1 AS total_bytes FROM written""",
    "database_size": f"""{_with(WRITTEN)}
SELECT filename AS table_name, CAST(1 AS BIGINT) AS file_count, strlen(content) + 1 AS total_bytes FROM written""",
    "event_iso_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS modified FROM events",
    "evolved_slices_compacted": f"""{_with(CUSTOMERS, PURCHASES, SHIPPED)}
SELECT {ORDER_COLUMNS}, CASE WHEN order_date >= DATE '2000-01-01' THEN shipping_country END AS shipping_country
FROM shipped WHERE order_date >= DATE '1999-01-01'""",

    "table_stats": _each_table("{width} AS column_count,"),
    "analyzed_row_counts": _each_table(""),
    "integrity_report": _with(CUSTOMERS, PRODUCTS, PURCHASES, ITEMS, REVIEWS) + "\n" + "\nUNION ALL ".join([
        _unique("customers", "customers", "customer_id"),
        _unique("products", "products", "product_id"),
        _unique("orders", "purchases", "order_id"),
        _unique("order_items", "items", "order_item_id"),
        _unique("product_reviews", "reviews", "review_id"),
        _orphans("orders", "purchases", "customer_id", "customers", "customers"),
        _orphans("order_items", "items", "order_id", "orders", "purchases"),
        _orphans("order_items", "items", "product_id", "products", "products"),
        _orphans("product_reviews", "reviews", "product_id", "products", "products"),
        _orphans("product_reviews", "reviews", "customer_id", "customers", "customers"),
    ]),
    "duplicated_item_ids": f"""{_with(ITEMS)}
SELECT order_item_id, COUNT(*) AS occurrences FROM items WHERE order_item_id IS NOT NULL
GROUP BY order_item_id HAVING COUNT(*) > 1""",
    "orphaned_order_ids": f"""{_with(PURCHASES, ITEMS)}
SELECT order_id, COUNT(*) AS occurrences FROM items
WHERE order_id NOT IN (SELECT order_id FROM purchases) GROUP BY order_id""",
    "compacted_order_items": f"""{_with(ITEMS)}
SELECT order_item_id, order_id, product_id, quantity, CAST(unit_price AS DOUBLE) AS unit_price FROM items""",
    "snapshot_manifest": _each_table(""),
    "orders_as_of": f"""{_with(PURCHASES)}
SELECT {ORDER_COLUMNS} FROM purchases WHERE order_date < DATE '1999-01-01'""",
    "evolved_orders": EVOLVED,
    "union_of_evolved_orders": EVOLVED,
    "stored_revenue_by_category": f"""{_with(PRODUCTS, ITEMS)}
SELECT category, CAST(SUM(quantity * unit_price) AS DOUBLE) AS revenue
FROM items JOIN products USING (product_id) GROUP BY category""",

    "account_alerts": ACCOUNT_ALERTS,
    "account_alerts_stream": ACCOUNT_ALERTS,
    "error_alerts": ERROR_ALERTS,
    "error_alerts_stream": ERROR_ALERTS,
    "metric_rollup": ROLLUP,
    "metric_rollup_stream": ROLLUP,
    "request_counts": REQUESTS,
    "request_counts_stream": REQUESTS,
    "container_log": f"""{_with(LOGS)}
SELECT event_id, ts, user_id, event_type, CAST(value AS DOUBLE) AS value FROM logs
WHERE event_type = 'click' ORDER BY ts DESC""",
    "container_log_stream": f"""{_with(LOGS)}
SELECT event_id, ts, user_id, event_type, CAST(value AS DOUBLE) AS value FROM logs WHERE event_type = 'click'""",
    "log_retention_tiers": """
SELECT CASE WHEN date_diff('second', ts, TIMESTAMP '2024-01-31') // 86400 > 20 THEN 'drop'
            WHEN date_diff('second', ts, TIMESTAMP '2024-01-31') // 86400 > 10 THEN 'archive'
            ELSE 'keep' END AS tier, COUNT(*) AS events
FROM events GROUP BY 1""",
    **dict.fromkeys(("retained_logs", "retained_daily_logs"), f"""{_with(LOGS)}
SELECT event_id, ts, user_id, event_type, CAST(value AS DOUBLE) AS value,
       CASE WHEN ts <= TIMESTAMP '2024-01-20' THEN 'archive' ELSE 'keep' END AS tier
FROM logs WHERE ts > TIMESTAMP '2024-01-10'"""),
    "unexpired_temp_events": f"""{_with(LOGS)}
SELECT event_id, ts, user_id, event_type, CAST(value AS DOUBLE) AS value FROM logs WHERE ts > TIMESTAMP '2024-01-23'""",
}
