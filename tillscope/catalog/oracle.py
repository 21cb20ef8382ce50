"""The registered queries stated once more as SQL over the given tables.

Plain result types on both sides: money and ratios as DOUBLE, counts as BIGINT,
days and times as ISO text.
"""

from __future__ import annotations

FULL = "date >= DATE '1995-01-01' AND date < DATE '2002-01-01'"
PART = "date >= DATE '1997-04-10' AND date < DATE '1999-08-21'"
BEFORE = "date >= DATE '1990-01-01' AND date < DATE '1990-01-02'"

ORDER = "ord_line, ord_part, ord_supp, ord_qty, ord_price"
ORDER_OUT = "ord_line, ord_part, ord_supp, ord_qty, CAST(ord_price AS DOUBLE) AS ord_price"

# Typed sales lines.
SALES = """
priced AS (
    SELECT
        concat('SQ', l_orderkey) AS transaction_id,
        concat('PMT', l_orderkey) AS payment_id,
        CAST(o_orderdate AS DATE) AS date,
        o_orderdate + to_seconds(25200 + (o_orderkey * 7919) % 54000) AS transaction_ts,
        concat('P-', l_partkey) AS sku,
        p_name AS item,
        p_type AS category,
        CAST(l_quantity AS BIGINT) AS qty,
        'Regular' AS price_point_name,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS gross_sales,
        CAST(-round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)), 2)
             AS DECIMAL(18,2)) AS discounts,
        CAST(l_tax AS DECIMAL(4,2)) AS rate,
        o_orderpriority AS device_name,
        'Main' AS location,
        CAST(l_linenumber AS BIGINT) AS ord_line,
        l_partkey AS ord_part,
        l_suppkey AS ord_supp,
        CAST(l_quantity AS BIGINT) AS ord_qty,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS ord_price
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN part ON l_partkey = p_partkey
),
netted AS (
    SELECT *, CAST(gross_sales + discounts AS DECIMAL(18,2)) AS net_sales FROM priced
),
sales AS (
    SELECT *, CAST(round(net_sales * rate, 2) AS DECIMAL(18,2)) AS tax FROM netted
)
"""

# What cleaning leaves of the damaged export.
CLEANED = f"""{SALES},
cleaned AS (
    SELECT
        CASE WHEN ord_part % 83 <> 0 THEN date END AS date,
        concat(
            CASE WHEN hour(transaction_ts) % 12 < 10 AND hour(transaction_ts) % 12 > 0 THEN '0' ELSE '' END,
            CASE WHEN hour(transaction_ts) % 12 = 0 THEN 12 ELSE hour(transaction_ts) % 12 END,
            strftime(transaction_ts, ':%M:%S'),
            CASE WHEN hour(transaction_ts) < 12 THEN ' AM' ELSE ' PM' END
        ) AS time,
        'America/Chicago' AS time_zone,
        category,
        item,
        sku,
        CASE WHEN ord_part % 97 <> 0 THEN CAST(qty AS DOUBLE) END AS qty,
        price_point_name,
        CASE WHEN ord_part % 89 <> 0 THEN gross_sales END AS gross_sales,
        CASE WHEN ord_part % 79 <> 0 THEN discounts END AS discounts,
        net_sales,
        tax,
        transaction_id,
        payment_id,
        device_name,
        'Payment' AS event_type,
        location,
        CAST(NULL AS VARCHAR) AS dining_option,
        {ORDER},
        CASE WHEN ord_part % 83 <> 0 THEN transaction_ts END AS transaction_ts
    FROM sales
)
"""

# The same with some quantities, taxes and items outside the contract.
BROKEN = f"""{CLEANED},
broken AS (
    SELECT * REPLACE (
        CASE WHEN ord_part % 73 = 0 THEN 0.0 ELSE qty END AS qty,
        CASE WHEN ord_part % 71 = 0 THEN tax - 1000000 ELSE tax END AS tax,
        CASE WHEN ord_part % 67 <> 0 THEN item END AS item
    )
    FROM cleaned
)
"""

NUMBERED = f"""{SALES},
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY {ORDER}) AS n FROM sales
)
"""

BASKETS = f"""{NUMBERED},
baskets AS (
    SELECT
        transaction_id,
        max(CASE WHEN n = 1 THEN transaction_ts END) AS transaction_ts,
        max(CASE WHEN n = 1 THEN date END) AS date,
        count(*) AS num_line_items,
        sum(qty) AS total_qty,
        sum(gross_sales) AS total_gross_sales,
        sum(discounts) AS total_discounts,
        sum(net_sales) AS total_net_sales,
        sum(tax) AS total_tax,
        max(CASE WHEN n = 1 THEN payment_id END) AS payment_id,
        max(CASE WHEN n = 1 THEN device_name END) AS device_name,
        max(CASE WHEN n = 1 THEN location END) AS location
    FROM numbered
    GROUP BY transaction_id
),
transactions AS (
    SELECT *, hour(transaction_ts) AS hour, dayname(transaction_ts) AS weekday FROM baskets
)
"""

DAILY_BODY = """
daily AS (
    SELECT
        date,
        sku,
        min(item) AS item,
        min(category) AS category,
        sum(qty) AS units_sold,
        sum(gross_sales) AS gross_sales,
        sum(discounts) AS discounts,
        sum(net_sales) AS net_sales,
        sum(tax) AS tax,
        count(DISTINCT transaction_id) AS transactions_count
    FROM sales
    GROUP BY date, sku
)
"""
DAILY = f"{SALES},{DAILY_BODY}"

# Lines without some headers and items; ties of the row order go to the smallest value.
PATCHY = f"""{SALES},
patchy AS (
    SELECT * REPLACE (
        CASE WHEN ord_part % 3 = 0 THEN concat(payment_id, '-', ord_line) END AS payment_id,
        CASE WHEN ord_part % 2 = 1 THEN concat(device_name, '/', sku) END AS device_name,
        CASE WHEN ord_part % 50 = 7 THEN concat('Aisle ', ord_line) END AS location,
        CASE WHEN ord_line % 2 = 0 THEN concat(item, ' ', transaction_id) END AS item,
        CASE WHEN ord_part % 5 <> 0 THEN concat(category, ' ', ord_line) END AS category
    )
    FROM sales
)
"""


def _first_there(column: str) -> str:
    return f"first({column} ORDER BY {ORDER}, {column}) FILTER ({column} IS NOT NULL) AS {column}"


WINDOWS_BODY = """
windows AS (
    SELECT
        concat('P-', p_partkey) AS sku,
        DATE '1995-01-01' + CAST((p_partkey * 37) % 2300 AS INTEGER) AS start_date,
        DATE '1995-01-01' + CAST((p_partkey * 37) % 2300 + 7 + p_partkey % 15 AS INTEGER) AS end_date
    FROM part
)
"""

# All files of one shape: typed cleaned rows.
_CLEAN_OUT = f"""
SELECT
    CAST(date AS VARCHAR) AS date, time, time_zone, category, item, sku, qty, price_point_name,
    CAST(gross_sales AS DOUBLE) AS gross_sales, CAST(discounts AS DOUBLE) AS discounts,
    CAST(net_sales AS DOUBLE) AS net_sales, CAST(tax AS DOUBLE) AS tax,
    transaction_id, payment_id, device_name, event_type, location, dining_option,
    {ORDER_OUT}, CAST(transaction_ts AS VARCHAR) AS transaction_ts
FROM cleaned
"""


def _failures_of(column: str, check: str, where: str, case: str = "CAST(NULL AS VARCHAR)") -> str:
    return (
        f"SELECT 'column' AS scope, '{column}' AS \"column\", '{check}' AS \"check\", {case} AS failure_case, "
        f"transaction_id, {ORDER_OUT} FROM broken WHERE {where}"
    )


_FAILURES = "\nUNION ALL\n".join(
    [
        _failures_of(c, "not_nullable", f"{c} IS NULL")
        for c in (
            "transaction_id",
            "transaction_ts",
            "date",
            "category",
            "item",
            "sku",
            "qty",
            "gross_sales",
            "net_sales",
            "tax",
        )
    ]
    + [_failures_of("qty", "greater_than(0)", "qty <= 0", "CAST(qty AS VARCHAR)")]
    + [
        _failures_of(c, "greater_than_or_equal_to(0)", f"{c} < 0", f"CAST({c} AS VARCHAR)")
        for c in ("gross_sales", "net_sales", "tax")
    ]
)

_FAILURE_COUNT = """
    (CASE WHEN date IS NULL THEN 2 ELSE 0 END)
    + (CASE WHEN item IS NULL THEN 1 ELSE 0 END)
    + (CASE WHEN qty IS NULL OR qty <= 0 THEN 1 ELSE 0 END)
    + (CASE WHEN gross_sales IS NULL OR gross_sales < 0 THEN 1 ELSE 0 END)
    + (CASE WHEN net_sales IS NULL OR net_sales < 0 THEN 1 ELSE 0 END)
    + (CASE WHEN tax IS NULL OR tax < 0 THEN 1 ELSE 0 END)
"""


def _kpis(where: str) -> str:
    return f"""
WITH {SALES}, chosen AS (SELECT * FROM sales WHERE {where})
SELECT
    coalesce(CAST(sum(net_sales) AS DOUBLE), 0.0) AS net_sales,
    count(DISTINCT transaction_id) AS transactions,
    coalesce(CAST(sum(net_sales) AS DOUBLE) / nullif(count(DISTINCT transaction_id), 0), 0.0) AS avg_basket,
    coalesce(CAST(sum(qty) AS BIGINT), 0) AS units,
    count(DISTINCT item) AS distinct_items
FROM chosen
"""


def _mix(where: str) -> str:
    return f"""
WITH {SALES},
by_category AS (
    SELECT category, sum(net_sales) AS net_sales FROM sales WHERE {where} GROUP BY category
)
SELECT
    category,
    CAST(net_sales AS DOUBLE) AS net_sales,
    CAST(net_sales AS DOUBLE) * 100.0 / CAST((SELECT sum(net_sales) FROM by_category) AS DOUBLE) AS pct_of_total
FROM by_category
ORDER BY net_sales DESC, category
"""


_WEEK = """
slots AS (
    SELECT i // 24 AS idx, i % 24 AS hour,
        ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][i // 24 + 1] AS weekday
    FROM range(168) AS r(i)
),
grid AS (
    SELECT idx, weekday, hour, coalesce(n, 0) AS transactions FROM slots LEFT JOIN counts USING (weekday, hour)
)
"""
_GRID_OUT = "SELECT weekday, hour, CAST(transactions AS BIGINT) AS transactions FROM grid ORDER BY idx, hour"


def _grid(where: str) -> str:
    return f"""
WITH {BASKETS},
counts AS (SELECT weekday, hour, count(*) AS n FROM transactions WHERE {where} GROUP BY weekday, hour),
{_WEEK}
{_GRID_OUT}
"""


def _trend(where: str, unit: str = "month") -> str:
    return f"""
WITH {SALES},
monthly AS (
    SELECT CAST(date_trunc('{unit}', date) AS DATE) AS month, sum(net_sales) AS net_sales
    FROM sales WHERE {where} GROUP BY 1
),
lagged AS (SELECT *, lag(net_sales) OVER (ORDER BY month) AS before FROM monthly)
SELECT
    CAST(month AS VARCHAR) AS month,
    CAST(net_sales AS DOUBLE) AS net_sales,
    CASE WHEN before <> 0
         THEN CAST(net_sales - before AS DOUBLE) * 100.0 / CAST(before AS DOUBLE) END AS mom_pct_change
FROM lagged
ORDER BY month
"""


def _top(by: str, name: str, kind: str) -> str:
    return f"""
WITH {SALES}
SELECT item, CAST(sum({by}) AS {kind}) AS {name}
FROM sales WHERE {PART}
GROUP BY item
ORDER BY sum({by}) DESC, item
LIMIT 20
"""


_TOTALS = "totals AS (SELECT date, sum(net_sales) AS net_sales FROM sales GROUP BY date)"


def _lift(totals: str, where: str, yes: str, no: str) -> str:
    def mean(condition: str) -> str:
        return (
            f"CAST(sum(CASE WHEN {condition} THEN net_sales END) AS DOUBLE)"
            f" / CAST(count(CASE WHEN {condition} THEN 1 END) AS DOUBLE)"
        )

    return f"WITH {SALES}, {totals} SELECT {mean(where)} AS {yes}, {mean(f'NOT ({where})')} AS {no} FROM totals"


_SAMPLE = f"""{SALES},
ids AS (SELECT DISTINCT date, transaction_id FROM sales),
ranked AS (
    SELECT *,
        row_number() OVER (PARTITION BY date ORDER BY md5(concat('42:', transaction_id)), transaction_id) AS r,
        count(*) OVER (PARTITION BY date) AS n
    FROM ids
),
kept AS (
    SELECT DISTINCT transaction_id FROM ranked
    WHERE r <= least(n, greatest(1, CAST(round_even(n * 0.1, 0) AS BIGINT)))
)
"""

_RANGES = """
bounds AS (SELECT min(date) AS lo, max(date) AS hi FROM sales),
ranges AS (
    SELECT 'all days' AS label, lo AS start, hi AS "end" FROM bounds
    UNION ALL
    SELECT 'second of three parts',
           lo + CAST(date_diff('day', lo, hi) // 3 AS INTEGER),
           lo + CAST(2 * date_diff('day', lo, hi) // 3 AS INTEGER)
    FROM bounds
)
"""

_RECONCILED = f"""{SALES},
{_RANGES},
kpis AS (
    SELECT
        concat(label, ': ', start, ' to ', "end") AS date_range,
        CAST(sum(net_sales) AS DOUBLE) AS net_sales,
        count(DISTINCT transaction_id) AS transactions,
        CAST(sum(qty) AS DOUBLE) AS units,
        count(DISTINCT item) AS distinct_items
    FROM sales JOIN ranges ON date >= start AND date <= "end"
    GROUP BY ALL
),
checks AS (
    SELECT date_range, 'Net Sales' AS kpi, net_sales AS v, TRUE AS is_money FROM kpis
    UNION ALL SELECT date_range, 'Transactions', CAST(transactions AS DOUBLE), FALSE FROM kpis
    UNION ALL SELECT date_range, 'Average Basket', round(net_sales / transactions, 2), TRUE FROM kpis
    UNION ALL SELECT date_range, 'Units', units, FALSE FROM kpis
    UNION ALL SELECT date_range, 'Distinct Items Sold', CAST(distinct_items AS DOUBLE), FALSE FROM kpis
)
"""

_RECONCILED_OUT = f"""
WITH {_RECONCILED}
SELECT date_range, kpi, v AS independent_value, v AS application_value,
    CAST(0 AS DOUBLE) AS difference, 'PASS' AS status, is_money
FROM checks
"""

ORACLE: dict[str, str] = {
    # ingestion
    "clean_line_items": f"WITH {CLEANED} {_CLEAN_OUT}",
    "csv_round_trip": f"WITH {CLEANED} {_CLEAN_OUT}",
    "csv_pruned_scan": f"WITH {SALES} SELECT transaction_id, concat('$', CAST(net_sales AS VARCHAR)) AS net_sales FROM sales",
    "raw_currency_parse": f"""
WITH {SALES}
SELECT {ORDER_OUT}, transaction_id,
    CAST(CASE ord_part % 13
        WHEN 0 THEN gross_sales
        WHEN 1 THEN -gross_sales
        WHEN 2 THEN gross_sales
        WHEN 9 THEN CASE WHEN gross_sales < 1000 THEN gross_sales END
        WHEN 10 THEN floor(gross_sales)
    END AS DOUBLE) AS amount
FROM sales
""",
    "raw_timestamp_parse": f"""
WITH {SALES}
SELECT {ORDER_OUT}, transaction_id,
    CASE WHEN ord_part % 11 IN (0, 1, 2, 3, 10) THEN CAST(date AS VARCHAR) END AS date,
    CASE WHEN ord_part % 11 IN (0, 1, 2, 3, 10) THEN CAST(transaction_ts AS VARCHAR) END AS transaction_ts
FROM sales
""",
    "raw_date_only_parse": f"""
WITH {SALES}
SELECT {ORDER_OUT}, transaction_id,
    CASE WHEN ord_part % 83 <> 0 THEN CAST(date AS VARCHAR) END AS date,
    CASE WHEN ord_part % 83 <> 0 THEN CAST(CAST(date AS TIMESTAMP) AS VARCHAR) END AS transaction_ts
FROM sales
""",
    "raw_qty_parse": f"""
WITH {SALES}
SELECT {ORDER_OUT}, transaction_id,
    CASE WHEN ord_part % 9 IN (0, 1, 2, 8) THEN CAST(qty AS DOUBLE) END AS qty
FROM sales
""",
    # contract
    "contract_failures": f"WITH {BROKEN} {_FAILURES}",
    "contract_summary": f"""
WITH {BROKEN}
SELECT sum({_FAILURE_COUNT}) = 0 AS is_valid, count(*) AS row_count,
       CAST(sum({_FAILURE_COUNT}) AS BIGINT) AS error_count, 'damaged' AS data
FROM broken
UNION ALL
SELECT TRUE, count(*), CAST(0 AS BIGINT), 'intact' FROM sales
""",
    "missing_column_report": f"""
WITH {CLEANED}
SELECT 'frame' AS scope, c AS "column", 'column_in_dataframe' AS "check", CAST(1 AS BIGINT) AS failures
FROM (VALUES ('sku'), ('net_sales')) AS v(c)
UNION ALL
SELECT 'column', 'item', 'dtype(''string'')', 1
UNION ALL
SELECT 'column', 'date', 'dtype(''date'')', 1
UNION ALL
SELECT 'column', c, 'not_nullable', n
FROM (
    SELECT 'transaction_ts' AS c, count(*) FILTER (transaction_ts IS NULL) AS n FROM cleaned
    UNION ALL SELECT 'qty', count(*) FILTER (qty IS NULL) FROM cleaned
    UNION ALL SELECT 'gross_sales', count(*) FILTER (gross_sales IS NULL) FROM cleaned
) AS nulls
WHERE n > 0
""",
    "quarantine_split": f"""
WITH {BROKEN}
SELECT transaction_id, {ORDER_OUT}, CAST({_FAILURE_COUNT} AS BIGINT) AS failures FROM broken
""",
    "private_columns": f"WITH {SALES} SELECT count(*) AS lines, CAST(0 AS BIGINT) AS tables_with_private FROM sales",
    # tables
    "line_items": f"""
WITH {NUMBERED}
SELECT
    concat(transaction_id, '-', n) AS line_item_id, transaction_id, CAST(date AS VARCHAR) AS date,
    CAST(transaction_ts AS VARCHAR) AS transaction_ts, sku, item, category, qty, price_point_name,
    CAST(gross_sales AS DOUBLE) AS gross_sales, CAST(discounts AS DOUBLE) AS discounts,
    CAST(net_sales AS DOUBLE) AS net_sales, CAST(tax AS DOUBLE) AS tax
FROM numbered
""",
    "transactions": f"""
WITH {BASKETS}
SELECT
    transaction_id, CAST(transaction_ts AS VARCHAR) AS transaction_ts, CAST(date AS VARCHAR) AS date,
    num_line_items, CAST(total_qty AS BIGINT) AS total_qty,
    CAST(total_gross_sales AS DOUBLE) AS total_gross_sales,
    CAST(total_discounts AS DOUBLE) AS total_discounts,
    CAST(total_net_sales AS DOUBLE) AS total_net_sales, CAST(total_tax AS DOUBLE) AS total_tax,
    payment_id, device_name, location, hour, weekday
FROM transactions
""",
    "daily_item_sales": f"""
WITH {DAILY}
SELECT
    CAST(date AS VARCHAR) AS date, sku, item, category, CAST(units_sold AS BIGINT) AS units_sold,
    CAST(gross_sales AS DOUBLE) AS gross_sales, CAST(discounts AS DOUBLE) AS discounts,
    CAST(net_sales AS DOUBLE) AS net_sales, CAST(tax AS DOUBLE) AS tax, transactions_count
FROM daily
""",
    "transactions_patchy_headers": f"""
WITH {PATCHY}
SELECT transaction_id, count(*) AS num_line_items,
       {", ".join(map(_first_there, ("payment_id", "device_name", "location")))}
FROM patchy GROUP BY transaction_id
""",
    "daily_patchy_items": f"""
WITH {PATCHY}
SELECT CAST(date AS VARCHAR) AS date, sku, {", ".join(map(_first_there, ("item", "category")))},
       CAST(sum(qty) AS BIGINT) AS units_sold, count(DISTINCT transaction_id) AS transactions_count
FROM patchy GROUP BY date, sku
""",
    "stored_tables": f"""
WITH {BASKETS}, {DAILY_BODY}
SELECT 'line_items' AS table_name, count(*) AS row_count, CAST(sum(net_sales) AS DOUBLE) AS net_sales FROM sales
UNION ALL
SELECT 'transactions', count(*), CAST(sum(total_net_sales) AS DOUBLE) FROM transactions
UNION ALL
SELECT 'daily_item_sales', count(*), CAST(sum(net_sales) AS DOUBLE) FROM daily
""",
    "units_by_category_sql": f"""
WITH {DAILY} SELECT category, CAST(sum(units_sold) AS BIGINT) AS units FROM daily GROUP BY category
""",
    # reports
    "date_bounds": f"""
WITH {SALES}
SELECT CAST(min(date) AS VARCHAR) AS min_date, CAST(max(date) AS VARCHAR) AS max_date FROM sales
""",
    "date_bounds_of_footers": f"""
WITH {SALES}
SELECT CAST(min(date) AS VARCHAR) AS min_date, CAST(max(date) AS VARCHAR) AS max_date FROM sales
""",
    "kpis_full": _kpis(FULL),
    "kpis_range": _kpis(PART),
    "kpis_empty_range": _kpis(BEFORE),
    "kpis_from_day_totals": f"WITH {SALES}\n"
    + " UNION ALL ".join(
        f"""
SELECT '{label}' AS label, CAST(coalesce(sum(net_sales), 0) AS DOUBLE) AS net_sales,
       count(DISTINCT transaction_id) AS transactions,
       CASE WHEN count(DISTINCT transaction_id) = 0 THEN 0
            ELSE CAST(sum(net_sales) AS DOUBLE) / count(DISTINCT transaction_id) END AS avg_basket,
       CAST(coalesce(sum(qty), 0) AS BIGINT) AS units, count(DISTINCT item) AS distinct_items
FROM sales WHERE {where}
"""
        for label, where in (("full", FULL), ("part", PART), ("before", BEFORE))
    ),
    "kpi_cards": f"""
WITH {SALES},
agg AS (
    SELECT sum(net_sales) AS net_sales, count(DISTINCT transaction_id) AS transactions,
           sum(qty) AS units, count(DISTINCT item) AS distinct_items
    FROM sales WHERE {FULL}
)
SELECT
    format('${{:,.2f}}', CAST(net_sales AS DOUBLE)) AS net_sales,
    format('{{:,}}', transactions) AS transactions,
    format('${{:,.2f}}', CAST(net_sales AS DOUBLE) / transactions) AS avg_basket,
    format('{{:,}}', CAST(units AS BIGINT)) AS units,
    format('{{:,}}', distinct_items) AS distinct_items
FROM agg
""",
    "category_mix": _mix(FULL),
    "category_mix_range": _mix(PART),
    "category_mix_ascending": f"SELECT * FROM ({_mix(FULL)}) ORDER BY net_sales, category DESC",
    "hour_weekday_grid": _grid(PART),
    "hour_weekday_grid_empty": _grid(BEFORE),
    "hour_weekday_grid_events": f"""
WITH counts AS (
    SELECT dayname(ts) AS weekday, hour(ts) AS hour, count(*) AS n
    FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2025-01-01'
    GROUP BY 1, 2
),
{_WEEK}
{_GRID_OUT}
""",
    "hour_weekday_pivot": f"""
WITH {BASKETS},
counts AS (SELECT weekday, hour, count(*) AS n FROM transactions WHERE {FULL} GROUP BY weekday, hour),
{_WEEK}
SELECT weekday, {", ".join(f"CAST(sum(transactions) FILTER (hour = {h}) AS BIGINT) AS h{h:02d}" for h in range(24))}
FROM grid GROUP BY idx, weekday ORDER BY idx
""",
    "month_over_month": _trend(FULL),
    "month_over_month_gaps": _trend(FULL, "quarter"),
    "top_items_by_units": _top("qty", "units", "BIGINT"),
    "top_items_by_sales": _top("net_sales", "net_sales", "DOUBLE"),
    "top_skus_by_units": f"""
WITH {DAILY}
SELECT sku, item, CAST(sum(units_sold) AS BIGINT) AS units_sold
FROM daily GROUP BY sku, item ORDER BY units_sold DESC, sku, item LIMIT 5
""",
    "units_by_category_from_rollup": f"""
WITH {DAILY} SELECT category, CAST(sum(units_sold) AS BIGINT) AS units FROM daily GROUP BY category
""",
    # profile
    "dataset_summary": f"""
WITH {BASKETS}
SELECT
    CAST(min(date) AS VARCHAR) AS min_date, CAST(max(date) AS VARCHAR) AS max_date,
    (SELECT count(*) FROM transactions) AS transactions,
    CAST(sum(qty) AS BIGINT) AS units, CAST(sum(net_sales) AS DOUBLE) AS net_sales,
    (SELECT CAST(sum(num_line_items) AS DOUBLE) / count(*) FROM transactions) AS avg_items_per_basket,
    (SELECT CAST(sum(total_net_sales) AS DOUBLE) / count(*) FROM transactions) AS avg_basket_value
FROM sales
""",
    "daily_totals": f"""
WITH {SALES}, {_TOTALS}
SELECT CAST(date AS VARCHAR) AS date, CAST(net_sales AS DOUBLE) AS net_sales FROM totals
""",
    "weekend_vs_weekday": _lift(
        _TOTALS, "dayname(date) IN ('Friday', 'Saturday', 'Sunday')", "weekend_avg", "weekday_avg"
    ),
    "first_of_month_vs_other": _lift(_TOTALS, "day(date) IN (1, 2, 3)", "opening_avg", "other_avg"),
    "category_season_daily_mean": _lift(
        "totals AS (SELECT date, sum(net_sales) AS net_sales FROM sales WHERE category = 'PROMO' GROUP BY date)",
        "month(date) IN (6, 7, 8)",
        "summer_avg",
        "other_avg",
    ),
    "category_share_rounded": f"""
WITH {SALES}
SELECT category,
    round(CAST(sum(net_sales) AS DOUBLE) * 100.0 / CAST((SELECT sum(net_sales) FROM sales) AS DOUBLE), 1) AS pct
FROM sales GROUP BY category ORDER BY sum(net_sales) DESC, category
""",
    "row_count_tolerance": f"""
WITH {CLEANED},
whole AS (SELECT * FROM cleaned WHERE date IS NOT NULL AND qty IS NOT NULL AND gross_sales IS NOT NULL)
SELECT count(*) AS row_count,
       count(*) BETWEEN 0.9 * (SELECT count(*) FROM sales) AND 1.1 * (SELECT count(*) FROM sales) AS in_tolerance
FROM whole
""",
    # stockout windows
    "window_calendar": f"""
WITH {WINDOWS_BODY}
SELECT sku, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date,
    CAST(CAST(unnest(generate_series(CAST(start_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP), INTERVAL 1 DAY))
         AS DATE) AS VARCHAR) AS date
FROM windows
""",
    "sale_days_in_windows": f"""
WITH {DAILY}, {WINDOWS_BODY}
SELECT w.sku, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date,
    date_diff('day', start_date, end_date) + 1 AS window_days, count(d.date) AS sale_days
FROM windows w LEFT JOIN daily d ON d.sku = w.sku AND d.date BETWEEN w.start_date AND w.end_date
GROUP BY w.sku, w.start_date, w.end_date
""",
    "stockout_violations": f"""
WITH {DAILY}, {WINDOWS_BODY}
SELECT CAST(date AS VARCHAR) AS date, sku, CAST(units_sold AS BIGINT) AS units_sold,
    CAST(net_sales AS DOUBLE) AS net_sales
FROM daily d
WHERE EXISTS (SELECT 1 FROM windows w WHERE w.sku = d.sku AND d.date BETWEEN w.start_date AND w.end_date)
""",
    "sales_outside_windows": f"""
WITH {SALES}, {WINDOWS_BODY}
SELECT category, count(*) AS lines, CAST(sum(net_sales) AS DOUBLE) AS net_sales
FROM sales s
WHERE NOT EXISTS (SELECT 1 FROM windows w WHERE w.sku = s.sku AND s.date BETWEEN w.start_date AND w.end_date)
GROUP BY category
""",
    "out_of_stock_flags": f"""
WITH {SALES}, {WINDOWS_BODY}
SELECT transaction_id, CAST(date AS VARCHAR) AS date, s.sku, {ORDER_OUT},
    coalesce(date BETWEEN w.start_date AND w.end_date, FALSE) AS out_of_stock
FROM sales s LEFT JOIN windows w ON w.sku = s.sku
""",
    # sampling and checks
    "sample_whole_baskets": f"""
WITH {_SAMPLE}
SELECT transaction_id, CAST(date AS VARCHAR) AS date, sku, {ORDER_OUT}, CAST(net_sales AS DOUBLE) AS net_sales
FROM sales WHERE transaction_id IN (SELECT transaction_id FROM kept)
""",
    "sample_completeness": f"""
WITH {_SAMPLE}
SELECT CAST(date AS VARCHAR) AS date, count(*) AS baskets,
    least(count(*), greatest(1, CAST(round_even(count(*) * 0.1, 0) AS BIGINT))) AS kept,
    CAST(0 AS BIGINT) AS split_baskets
FROM ids GROUP BY date
""",
    "check_ranges": f"""
WITH {SALES}, {_RANGES}
SELECT label, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end" FROM ranges
""",
    "kpi_reconciliation": _RECONCILED_OUT,
    "export_reconciliation": _RECONCILED_OUT,
    "reconciliation_verdict": f"""
WITH {_RECONCILED}
SELECT count(*) AS checks, count(*) FILTER (v IS NULL) AS failed, 'PASS' AS verdict FROM checks
""",
    "grain_consistency": f"""
WITH {BASKETS}, {DAILY_BODY},
l AS (
    SELECT count(*) AS n_lines, count(DISTINCT transaction_id) AS n, sum(qty) AS units,
           sum(gross_sales) AS gross, sum(net_sales) AS net FROM sales
),
b AS (
    SELECT count(*) AS n, sum(num_line_items) AS n_lines, sum(total_qty) AS units,
           sum(total_gross_sales) AS gross, sum(total_net_sales) AS net FROM transactions
),
d AS (SELECT sum(units_sold) AS units, sum(net_sales) AS net FROM daily)
SELECT
    CAST(l.n_lines - b.n_lines AS BIGINT) AS line_count_diff,
    CAST(l.n - b.n AS BIGINT) AS basket_count_diff,
    CAST(l.units - b.units AS BIGINT) AS basket_units_diff,
    CAST(l.gross - b.gross AS DOUBLE) AS basket_gross_diff,
    CAST(l.net - b.net AS DOUBLE) AS basket_net_diff,
    CAST(l.units - d.units AS BIGINT) AS rollup_units_diff,
    CAST(l.net - d.net AS DOUBLE) AS rollup_net_diff
FROM l, b, d
""",
    "basket_comparison": f"""
WITH {BASKETS}
SELECT value_name,
       CASE WHEN weekday = 'Sunday' AND value_name = 'total_qty' THEN 'FAIL' ELSE 'PASS' END AS status,
       count(*) AS baskets
FROM transactions, (VALUES ('total_qty'), ('total_gross_sales')) AS v(value_name)
GROUP BY 1, 2
""",
    "differing_baskets": f"""
WITH {SALES},
own AS (SELECT *, CAST(substr(transaction_id, 3) AS BIGINT) AS basket FROM sales),
changed AS (SELECT * REPLACE (CASE WHEN basket % 997 = 0 THEN qty + 1 ELSE qty END AS qty) FROM own),
other AS (
    SELECT * FROM changed WHERE NOT (basket % 1009 = 1 AND ord_line = 1)
    UNION ALL SELECT * FROM changed WHERE basket % 1013 = 2 AND ord_line = 1
),
touched AS (
    SELECT date, transaction_id FROM (SELECT * FROM own EXCEPT ALL SELECT * FROM other)
    UNION SELECT date, transaction_id FROM (SELECT * FROM other EXCEPT ALL SELECT * FROM own)
)
SELECT CAST(date AS VARCHAR) AS date, transaction_id,
       (SELECT count(*) FROM own o WHERE o.date = t.date AND o.transaction_id = t.transaction_id) AS left_rows,
       (SELECT count(*) FROM other o WHERE o.date = t.date AND o.transaction_id = t.transaction_id) AS right_rows
FROM touched t
""",
    "key_set_differences": f"""
WITH {SALES},
catalogue AS (SELECT DISTINCT concat('P-', p_partkey) AS sku, p_type AS category FROM part),
sold AS (SELECT DISTINCT sku, CASE WHEN ord_part % 10 = 0 THEN 'OTHER' ELSE category END AS category FROM sales)
SELECT sku, category, 'left' AS side FROM (SELECT * FROM catalogue EXCEPT SELECT * FROM sold)
UNION ALL
SELECT sku, category, 'right' FROM (SELECT * FROM sold EXCEPT SELECT * FROM catalogue)
""",
    "key_multiset_differences": f"""
WITH {SALES},
a AS (SELECT sku, category FROM sales),
b AS (
    SELECT sku, category FROM sales WHERE ord_part % 10 <> 0
    UNION ALL SELECT sku, category FROM sales WHERE ord_part % 25 = 0
)
SELECT sku, category, 'left' AS side, count(*) AS surplus
FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY sku, category
UNION ALL
SELECT sku, category, 'right' AS side, count(*) AS surplus
FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY sku, category
""",
    "common_key_set": f"""
WITH {SALES}
SELECT item, category FROM sales
INTERSECT
SELECT p.p_name, n.p_type FROM part p JOIN part n ON n.p_partkey = p.p_partkey + 1
""",
    "opening_lines": f"""
WITH {SALES}
SELECT transaction_id, CAST(date AS VARCHAR) AS date, sku, {ORDER_OUT}
FROM sales ORDER BY sales.date, transaction_ts, transaction_id, {ORDER} LIMIT 20
""",
    "month_change_check": f"""
WITH {SALES},
monthly AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, sum(net_sales) AS net FROM sales GROUP BY 1),
lagged AS (SELECT *, lag(net) OVER (ORDER BY month) AS before FROM monthly)
SELECT CAST(month AS VARCHAR) AS month, CAST(net AS DOUBLE) AS net_sales,
       CASE WHEN before <> 0 THEN round(CAST((net - before) * 100 AS DOUBLE) / CAST(before * 100 AS DOUBLE) * 100, 6) END AS pct_change
FROM lagged
""",
}
