"""Independent SQL (DuckDB dialect) for every catalogue query.

Written from the definitions, not from the Spark plans: the adapters are
restated as CTEs over the driver's tables, and the changelogs use plain SQL
window functions (one task in DuckDB, which is fine at test scale).
"""

from __future__ import annotations

from ledgerlane.sources.events import (DROPPED_FORMS, EMPTY_VALUE_FORM, HUGE_FORM, NO_EMAIL_FORM,
                                        RENDER_FORMS)


def _uuid(h: str) -> str:
    return (f"substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || "
            f"substr({h},17,4) || '-' || substr({h},21,12)")


FAILED_COND = "(event_type = 'error' OR round(value, 2) = 0)"

ORDER_EVENTS = f"""order_events AS (
  SELECT event_id,
         CAST(event_id AS VARCHAR) AS order_number,
         'user' || CAST(user_id AS VARCHAR) || '@example.com' AS order_email,
         CASE WHEN {FAILED_COND} THEN 'FAILED' ELSE 'CONFIRMED' END AS order_status,
         CAST(CASE WHEN {FAILED_COND} THEN 0 ELSE value END AS DECIMAL(18,2)) AS total_order_value,
         ts AS arrival
  FROM events)"""

REQUESTS = f"""request_headers AS (
  SELECT o_orderkey AS order_key,
         {_uuid("md5('order-' || CAST(o_orderkey AS VARCHAR))")} AS order_number,
         'user' || CAST(o_custkey AS VARCHAR) || '@example.com' AS order_email
  FROM orders),
request_lines AS (
  SELECT l_orderkey AS order_key, CAST(l_linenumber AS BIGINT) AS id,
         CASE WHEN (7 * l_orderkey + l_linenumber) % 50 = 0 THEN 'x' ELSE '' END
           || CAST(l_partkey AS VARCHAR) AS sku_code,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
         CAST(trunc(l_quantity) AS INTEGER) - 5 AS quantity
  FROM lineitem),
valid_lines AS (SELECT * FROM request_lines WHERE quantity > 0),
stock AS (
  SELECT CAST(p_partkey AS VARCHAR) AS sku_code, CAST(p_size % 10 AS INTEGER) AS quantity
  FROM part),
per_sku AS (
  SELECT order_key, sku_code, count(*) AS n, sum(price * quantity) AS s
  FROM valid_lines GROUP BY order_key, sku_code),
answered AS (
  SELECT p.order_key, p.n, p.s, coalesce(i.quantity > 0, false) AS in_stock
  FROM per_sku p LEFT JOIN stock i ON p.sku_code = i.sku_code),
totals AS (
  SELECT order_key,
         CAST(sum(CASE WHEN in_stock THEN CAST(n AS DECIMAL(18,0)) * CAST(s AS DECIMAL(20,2))
                       ELSE 0 END) AS DECIMAL(38,2)) AS total_value,
         bool_and(in_stock) AS all_in_stock
  FROM answered GROUP BY order_key),
decisions AS (
  SELECT h.order_key, h.order_number, h.order_email,
         (coalesce(t.all_in_stock, true) AND coalesce(t.total_value, 0) > 0) AS ok,
         CASE WHEN coalesce(t.all_in_stock, true) AND coalesce(t.total_value, 0) > 0
              THEN 'CONFIRMED' ELSE 'FAILED' END AS order_status,
         CAST(CASE WHEN coalesce(t.all_in_stock, true) AND coalesce(t.total_value, 0) > 0
                   THEN t.total_value ELSE 0 END AS DECIMAL(38,2)) AS total_order_value
  FROM request_headers h LEFT JOIN totals t ON h.order_key = t.order_key)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


EV = _with(ORDER_EVENTS)
RQ = _with(REQUESTS)


def _plain(value: str) -> str:
    """Decimal text without trailing zeros (the value has a decimal point)."""
    return f"rtrim(rtrim(CAST({value} AS VARCHAR), '0'), '.')"


def _event_json(value_expr: str) -> str:
    return ("'{\"orderNumber\":' || CAST(to_json(order_number) AS VARCHAR) || "
            "',\"orderEmail\":' || CAST(to_json(order_email) AS VARCHAR) || "
            "',\"orderStatus\":' || CAST(to_json(order_status) AS VARCHAR) || "
            f"',\"totalOrderValue\":' || {_plain(value_expr)} || '}}'")


def _event_text() -> str:
    return ("'OrderEvent(orderNumber=' || coalesce(order_number, 'null') || "
            "', orderEmail=' || coalesce(order_email, 'null') || "
            "', orderStatus=' || coalesce(order_status, 'null') || "
            "', totalOrderValue=' || coalesce(CAST(total_order_value AS VARCHAR), 'null') || ')'")


def _draw(salt: str) -> str:
    return f"(('0x' || substr(md5('{salt}-' || CAST(event_id AS VARCHAR)), 1, 8))::BIGINT % 4)"


SYNTHETIC = f"""synthetic AS (
  SELECT event_id AS id,
         {_uuid("md5('synthetic-' || CAST(event_id AS VARCHAR))")} AS order_number,
         list_extract(['ana@example.com', 'ben@example.com', 'chen@example.com', 'dara@example.com'],
                      1 + {_draw('email')}) AS order_email,
         list_extract([0, 41000, 56000, 65000], 1 + {_draw('price')}) AS price
  FROM events)"""

_BUCKET = "time_bucket(INTERVAL '30 seconds', arrival)"
_RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

ORACLE_SQL: dict[str, str] = {
    "order_requests": RQ + """
SELECT h.order_key, h.order_number, h.order_email, CAST(coalesce(c.n, 0) AS BIGINT) AS line_count
FROM request_headers h
LEFT JOIN (SELECT order_key, count(*) AS n FROM request_lines GROUP BY order_key) c
  ON h.order_key = c.order_key""",
    "order_requests_nested": """
SELECT o_orderkey AS order_key, 'user' || CAST(o_custkey AS VARCHAR) || '@example.com' AS order_email,
       CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 5 AS BIGINT) END AS line_count,
       o_orderkey % 11 = 0 AS no_list
FROM orders""",
    "order_lines_nested": """
SELECT order_key, 'sku' || CAST((order_key * 3 + i) % 1000 AS VARCHAR) AS sku_code,
       CAST(CAST(order_key % 1000 + i AS DECIMAL(18,6)) / 100 AS DOUBLE) AS price,
       CAST((order_key + i) % 4 - 1 AS INTEGER) AS quantity
FROM (SELECT o_orderkey AS order_key, unnest(range(1, o_orderkey % 5 + 1)) AS i
      FROM orders WHERE o_orderkey % 11 <> 0)""",
    "request_prices": """
SELECT o_orderkey AS order_key, CAST(1 AS BIGINT) AS id, 'price' AS sku_code,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price_text,
       regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '\\.?0+$', '') AS price
FROM orders
UNION ALL
SELECT o_orderkey, 2, 'a"price": 5',
       list_extract(['7.25', '1.0000005', '12345678901234.5', '1E3', '8.50', '1.5000000', '123456789012345678901.5',
                     'abc', '12.000001', '12300000000000000000000E-9'], CAST(o_orderkey % 10 + 1 AS INTEGER)),
       list_extract(['7.25', NULL, '12345678901234.5', '1000', '8.5', '1.5', NULL, NULL, '12.000001', '12300000000000'],
                    CAST(o_orderkey % 10 + 1 AS INTEGER))
FROM orders""",
    "unrepresentable_prices": """
SELECT o_orderkey AS order_key, CAST(1 AS INTEGER) AS position,
       CASE o_orderkey % 10 WHEN 1 THEN '1.0000005' WHEN 6 THEN '123456789012345678901.5' ELSE 'abc' END AS price_text,
       CASE WHEN o_orderkey % 10 = 7 THEN 'price is no number' ELSE 'price beyond decimal(26,6)' END AS reason
FROM orders WHERE o_orderkey % 10 IN (1, 6, 7)""",
    "stock_answer_lists": RQ + """
SELECT h.order_key, CAST(0 AS BIGINT) AS part, count(l.sku_code) AS answer_count,
       coalesce(string_agg(l.sku_code || ':' || CASE WHEN coalesce(i.quantity > 0, false) THEN 'true' ELSE 'false' END,
                           ',' ORDER BY l.id, l.sku_code, l.price, l.quantity), '') AS answers
FROM request_headers h LEFT JOIN valid_lines l ON h.order_key = l.order_key
LEFT JOIN stock i ON l.sku_code = i.sku_code
GROUP BY h.order_key""",
    "quarantined_requests": RQ + """,
damaged AS (
  SELECT order_key, CASE WHEN order_key % 97 <> 0 THEN quantity END AS quantity,
         CASE WHEN order_key % 89 <> 0 THEN sku_code END AS sku_code,
         CASE WHEN order_key % 83 <> 0 THEN price END AS price
  FROM request_lines),
raised AS (
  SELECT order_key, 'null quantity' AS reason FROM damaged WHERE quantity IS NULL
  UNION ALL
  SELECT order_key, 'null sku' FROM damaged WHERE quantity > 0 AND sku_code IS NULL
  UNION ALL
  SELECT d.order_key, 'null price' FROM damaged d JOIN stock s ON d.sku_code = s.sku_code
  WHERE d.quantity > 0 AND d.price IS NULL AND s.quantity > 0)
SELECT order_key, min(reason) AS reason FROM raised GROUP BY order_key
UNION ALL
SELECT o_orderkey, 'null line list' FROM orders WHERE o_orderkey % 11 = 0""",
    "quarantined_events": EV + f"""
SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'null order number'
                      WHEN event_id % 89 = 0 THEN 'null status' ELSE 'null value' END AS reason
FROM order_events WHERE event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 83 = 0
UNION ALL
SELECT event_id, 'value beyond decimal(38,6)' FROM order_events WHERE event_id % {RENDER_FORMS} = {HUGE_FORM}""",
    "console_lines": EV + f"""
SELECT event_id, chr(10) || '> ' || {_event_text()} || ' PROCESSING' AS line FROM order_events""",
    "order_lines": RQ + """
SELECT order_key, sku_code, CAST(price AS DOUBLE) AS price, quantity FROM request_lines""",
    "valid_order_lines": RQ + """
SELECT order_key, sku_code, CAST(price AS DOUBLE) AS price, quantity FROM valid_lines""",
    "line_values": RQ + """
SELECT order_key, id, sku_code, CAST(price * quantity AS DOUBLE) AS line_value FROM valid_lines""",
    "inventory": RQ + "SELECT sku_code, quantity FROM stock",
    "inventory_in_list": RQ + """
SELECT sku_code, quantity FROM stock WHERE sku_code IN (SELECT sku_code FROM valid_lines)""",
    "sku_exists": RQ + """
SELECT s.sku_code, EXISTS (SELECT 1 FROM stock i WHERE i.sku_code = s.sku_code) AS sku_exists
FROM (SELECT DISTINCT sku_code FROM valid_lines) s""",
    "sku_lookup": RQ + """
SELECT s.sku_code, i.quantity
FROM (SELECT DISTINCT sku_code FROM valid_lines) s JOIN stock i ON s.sku_code = i.sku_code""",
    "stock_answers": RQ + """
SELECT l.order_key, l.id, l.sku_code, coalesce(i.quantity > 0, false) AS in_stock
FROM valid_lines l LEFT JOIN stock i ON l.sku_code = i.sku_code""",
    "order_totals": RQ + """
SELECT order_key, CAST(total_value AS DOUBLE) AS total_value FROM totals""",
    "order_all_in_stock": RQ + "SELECT order_key, all_in_stock FROM totals",
    "placement_decisions": RQ + """
SELECT order_key, order_number, order_email, order_status,
       CAST(total_order_value AS DOUBLE) AS total_order_value
FROM decisions""",
    "confirmed_orders": RQ + """
SELECT order_key, order_number, order_email, CAST(total_order_value AS DOUBLE) AS total_order_value
FROM decisions WHERE order_status = 'CONFIRMED'""",
    "confirmed_order_lines": RQ + """
SELECT d.order_number, l.sku_code, CAST(l.price AS DOUBLE) AS price, l.quantity
FROM valid_lines l JOIN decisions d ON l.order_key = d.order_key
WHERE d.order_status = 'CONFIRMED'""",
    "published_events": RQ + f"""
SELECT 'notificationId' AS topic, {_event_json('total_order_value')} AS value FROM decisions
UNION ALL
SELECT 'flinkTopic' AS topic, {_event_json('total_order_value')} AS value FROM decisions""",
    "status_counts": EV + """
SELECT order_status, count(*) AS event_count FROM order_events GROUP BY order_status""",
    "status_running_counts": EV + f"""
SELECT order_number, order_status, event_id,
       count(*) OVER (PARTITION BY order_status ORDER BY arrival, event_id {_RUN}) AS running_count
FROM order_events""",
    "revenue_total": EV + """
SELECT CAST(sum(total_order_value) AS DOUBLE) AS total_revenue, count(*) AS event_count
FROM order_events""",
    "revenue_running": EV + f"""
SELECT order_number, event_id,
       CAST(sum(total_order_value) OVER (ORDER BY arrival, event_id {_RUN}) AS DOUBLE)
         AS running_revenue
FROM order_events""",
    "revenue_tumbling_30s": EV + f"""
SELECT strftime({_BUCKET}, '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime({_BUCKET} + INTERVAL '30 seconds', '%Y-%m-%d %H:%M:%S') AS window_end,
       CAST(sum(total_order_value) AS DOUBLE) AS window_revenue, count(*) AS event_count
FROM order_events GROUP BY {_BUCKET}""",
    "decode_order_events": EV + f"""
SELECT event_id, order_number,
       CASE WHEN event_id % {RENDER_FORMS} = {NO_EMAIL_FORM} THEN NULL ELSE order_email END
         AS order_email,
       order_status,
       CASE WHEN event_id % {RENDER_FORMS} <> {EMPTY_VALUE_FORM} THEN CAST(total_order_value AS DOUBLE) END
         AS total_order_value,
       CASE WHEN event_id % {RENDER_FORMS} <> {EMPTY_VALUE_FORM} THEN CAST(total_order_value AS VARCHAR) END
         AS value_text
FROM order_events
WHERE event_id % {RENDER_FORMS} NOT IN ({', '.join(map(str, DROPPED_FORMS))})""",
    "encode_order_events": EV + f"""
SELECT order_number AS key, {_event_json('CAST(total_order_value AS DECIMAL(38,2))')} AS value
FROM order_events WHERE order_number IS NOT NULL""",
    "processing_lines": EV + f"""
SELECT event_id, {_event_text()} || ' PROCESSING' AS line FROM order_events""",
    "processed_messages": EV + """
SELECT event_id,
       CAST(to_json('OrderEvent(' || coalesce(order_number, 'null') || ') PROCESSED') AS VARCHAR)
         AS value
FROM order_events""",
    "notification_lines": EV + f"""
SELECT event_id, 'Received Notification for Order - ' || {_event_text()} AS line FROM order_events""",
    "timed_order_events": EV + """
SELECT order_number, order_email, order_status,
       CAST(total_order_value AS DOUBLE) AS total_order_value,
       epoch_us(arrival) // 1000 AS "timestamp",
       strftime(make_timestamp((epoch_us(arrival) // 1000) * 1000) + INTERVAL 330 MINUTE,
                '%Y-%m-%dT%H:%M:%S.%gZ') AS instant,
       'TimedOrderEvent(orderNumber=' || order_number || ', orderEmail=' || order_email
         || ', orderStatus=' || order_status
         || ', totalOrderValue=' || CAST(total_order_value AS VARCHAR)
         || ', timestamp=' || CAST(epoch_us(arrival) // 1000 AS VARCHAR)
         || ', instant=' || CASE WHEN (epoch_us(arrival) // 1000) % 1000 = 0
              THEN strftime(make_timestamp((epoch_us(arrival) // 1000) * 1000)
                            + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%SZ')
              ELSE strftime(make_timestamp((epoch_us(arrival) // 1000) * 1000)
                            + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S.%gZ') END || ')' AS line
FROM order_events""",
    "synthetic_order_events": _with(SYNTHETIC) + """
SELECT id, order_number, order_email, CAST(price AS DOUBLE) AS total_order_value,
       CASE WHEN price > 0 THEN 'CONFIRMED' ELSE 'FAILED' END AS order_status
FROM synthetic""",
    "synthetic_order_json": _with(SYNTHETIC) + """
SELECT id, '{"orderNumber":"' || order_number || '","orderEmail":"' || order_email
          || '","totalOrderValue":' || CAST(price AS VARCHAR) || ',"orderStatus":"'
          || CASE WHEN price > 0 THEN 'CONFIRMED' ELSE 'FAILED' END || '"}' AS value
FROM synthetic""",
}

def _branch(name: str, text: str, source: str) -> str:
    return (f"SELECT '{name}' AS branch, count(*) AS row_count, CAST(coalesce(sum(('0x' || substr(md5("
            f"{text}), 1, 8))::BIGINT), 0) AS BIGINT) AS checksum FROM {source}")


ORACLE_SQL["order_dashboard"] = EV + "\nUNION ALL\n".join([
    _branch("quarantine", "order_number", "order_events WHERE order_number IS NULL"),
    _branch("processing", _event_text() + " || ' PROCESSING'", "order_events"),
    _branch("processed", "CAST(to_json('OrderEvent(' || order_number || ') PROCESSED') AS VARCHAR)",
            "order_events"),
    _branch("status_running", "order_number || '|' || order_status || '|' || CAST(n AS VARCHAR)",
            "(SELECT *, count(*) OVER (PARTITION BY order_status ORDER BY arrival, event_id "
            f"{_RUN}) AS n FROM order_events)"),
    _branch("revenue_running", "order_number || '|' || CAST(CAST(s AS DECIMAL(38,2)) AS VARCHAR)",
            f"(SELECT *, sum(total_order_value) OVER (ORDER BY arrival, event_id {_RUN}) AS s FROM order_events)"),
    _branch("revenue_30s", f"strftime(w, '%Y-%m-%d %H:%M:%S') || '|' || CAST(CAST(s AS DECIMAL(38,2)) AS VARCHAR)"
            " || '|' || CAST(n AS VARCHAR)",
            f"(SELECT {_BUCKET} AS w, sum(total_order_value) AS s, count(*) AS n FROM order_events GROUP BY 1)"),
])

_DECIDED = ORACLE_SQL["placement_decisions"]

# Batch twins that only streaming queries use (not registered as batch queries).
TWIN_SQL: dict[str, str] = {
    "placement_restocked": f"""
SELECT * FROM ({_DECIDED}) WHERE order_key % 2 = 0
UNION ALL
SELECT * FROM ({_DECIDED.replace("p_size % 10", "(p_size + 1) % 10")}) WHERE order_key % 2 = 1""",
    "order_events": EV + """
SELECT event_id, order_number, order_email, order_status,
       CAST(total_order_value AS DOUBLE) AS total_order_value
FROM order_events""",
    "processed_values": EV + """
SELECT CAST(to_json('OrderEvent(' || coalesce(order_number, 'null') || ') PROCESSED') AS VARCHAR)
         AS value
FROM order_events""",
}
