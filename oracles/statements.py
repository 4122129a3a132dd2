"""One SQL statement per registered query."""

from __future__ import annotations

from oracles.roles import CHANGED_ROLES, DIRTY_ROLES, with_roles


def rounded(value: str, digits: int) -> str:
    """Round as decimal arithmetic does: 64.07 / 2 is 32.04."""
    return f"cast(round(cast({value} AS decimal(38,10)), {digits}) AS double)"


def share(part: str, whole: str, digits: int = 2) -> str:
    return rounded(
        f"100.0 * cast({part} AS double) / nullif(cast({whole} AS double), 0)", digits
    )


def quotient(top: str, bottom: str, digits: int = 2) -> str:
    return rounded(f"cast({top} AS double) / nullif(cast({bottom} AS double), 0)", digits)


def mean(column: str, digits: int = 2) -> str:
    return quotient(f"sum({column})", f"count({column})", digits)


def dbl(expression: str) -> str:
    return f"cast({expression} AS double)"


def big(expression: str) -> str:
    return f"cast({expression} AS bigint)"


YM = "strftime({}, '%Y-%m')"
BOUGHT_YM = YM.format("bought")

QUALITY = {
    "dq_row_counts": """
        SELECT 'customers' AS tbl, count(*) AS rows_cnt FROM r_customers
        UNION ALL SELECT 'orders', count(*) FROM r_orders
        UNION ALL SELECT 'order_items', count(*) FROM r_items
        UNION ALL SELECT 'order_payments', count(*) FROM r_payments
        UNION ALL SELECT 'order_reviews', count(*) FROM r_reviews
        UNION ALL SELECT 'products', count(*) FROM r_products
        UNION ALL SELECT 'sellers', count(*) FROM r_sellers
        UNION ALL SELECT 'category_name', count(*) FROM r_names""",
    "dq_pk_duplicates": """
        SELECT 'orders.order_id' AS check_item, count(*) - count(DISTINCT order_id) AS dup_cnt
        FROM r_orders
        UNION ALL SELECT 'customers.customer_id', count(*) - count(DISTINCT customer_id)
        FROM r_customers
        UNION ALL SELECT 'products.product_id', count(*) - count(DISTINCT product_id)
        FROM r_products
        UNION ALL SELECT 'sellers.seller_id', count(*) - count(DISTINCT seller_id)
        FROM r_sellers
        UNION ALL SELECT 'order_reviews.review_id', count(*) - count(DISTINCT review_id)
        FROM r_reviews""",
    "dq_status_distribution": f"""
        SELECT order_status, count(*) AS order_cnt,
               {share('count(*)', '(SELECT count(*) FROM r_orders)')} AS pct
        FROM r_orders GROUP BY order_status""",
    "dq_null_rates": f"""
        SELECT {share('count(*) - count(bought)', 'count(*)')} AS purchase_null_pct,
               {share('count(*) - count(approved)', 'count(*)')} AS approved_null_pct,
               {share('count(*) - count(arrived)', 'count(*)')} AS delivered_null_pct,
               {share('count(*) - count(promised)', 'count(*)')} AS estimated_null_pct
        FROM r_orders""",
    "dq_orphan_orders": """
        SELECT count(*) AS orphan_orders FROM r_orders
        WHERE customer_id IS NULL
           OR customer_id NOT IN (SELECT customer_id FROM r_customers)""",
    "dq_payment_multiplicity": """
        SELECT pay_cnt, count(*) AS order_cnt
        FROM (SELECT count(*) AS pay_cnt FROM r_payments GROUP BY order_id)
        GROUP BY pay_cnt""",
    "dq_score_distribution": """
        SELECT cast(stars AS bigint) AS review_score, count(*) AS review_cnt
        FROM r_reviews WHERE stars IS NOT NULL GROUP BY stars""",
    "dq_price_anomalies": """
        SELECT count(*) FILTER (WHERE price < 0) AS price_neg,
               count(*) FILTER (WHERE price IS NULL) AS price_null,
               count(*) FILTER (WHERE freight < 0) AS freight_neg,
               count(*) FILTER (WHERE freight IS NULL) AS freight_null
        FROM r_items""",
}


def _key_check(table: str, view: str, columns: list[str], shown: str | None = None) -> str:
    keys = ", ".join(columns)
    return f"""
        SELECT '{table}' AS tbl, '{shown or ",".join(columns)}' AS key_columns,
               count(*) FILTER (WHERE n > 1) AS repeated_keys,
               cast(coalesce(sum(n - 1), 0) AS bigint) AS surplus_rows
        FROM (SELECT {keys}, count(*) AS n FROM {view} GROUP BY {keys})"""


def _orphan_check(reference: str, parent: str, child_view: str, parent_view: str, key: str) -> str:
    return f"""
        SELECT '{reference}' AS reference, '{parent}' AS parent,
               count(DISTINCT {key}) AS missing_keys, count(*) AS orphan_rows
        FROM {child_view}
        WHERE {key} IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM {parent_view} WHERE {parent_view}.{key} = {child_view}.{key})"""


def _null_check(table: str, view: str, **columns: str) -> str:
    return "\n UNION ALL ".join(
        f"SELECT '{table}' AS tbl, '{rule}' AS rule,"
        f" count(*) FILTER (WHERE {column} IS NULL) AS null_rows FROM {view}"
        for rule, column in columns.items()
    )


CHECKS = {
    "check_primary_keys": "\n UNION ALL ".join(
        [
            _key_check("category_name", "r_names", ["raw_name"], "product_category_name"),
            _key_check("sellers", "r_sellers", ["seller_id"]),
            _key_check("products", "r_products", ["product_id"]),
            _key_check("customers", "r_customers", ["customer_id"]),
            _key_check("orders", "r_orders", ["order_id"]),
            _key_check("order_items", "r_items", ["order_id", "order_item_id"]),
            _key_check("order_payments", "r_payments", ["order_id", "payment_sequential"]),
            _key_check("order_reviews", "r_reviews", ["review_id"]),
        ]
    ),
    "check_foreign_keys": "\n UNION ALL ".join(
        [
            _orphan_check("orders.customer_id", "customers", "r_orders", "r_customers", "customer_id"),
            _orphan_check("order_items.order_id", "orders", "r_items", "r_orders", "order_id"),
            _orphan_check("order_items.product_id", "products", "r_items", "r_products", "product_id"),
            _orphan_check("order_items.seller_id", "sellers", "r_items", "r_sellers", "seller_id"),
            _orphan_check("order_payments.order_id", "orders", "r_payments", "r_orders", "order_id"),
            _orphan_check("order_reviews.order_id", "orders", "r_reviews", "r_orders", "order_id"),
        ]
    ),
    "check_not_null": "\n UNION ALL ".join(
        [
            _null_check("category_name", "r_names", product_category_name="raw_name"),
            _null_check("sellers", "r_sellers", seller_id="seller_id"),
            _null_check("products", "r_products", product_id="product_id"),
            _null_check(
                "customers", "r_customers",
                customer_id="customer_id", customer_unique_id="customer_unique_id",
            ),
            _null_check("orders", "r_orders", order_id="order_id", customer_id="customer_id"),
            _null_check("order_items", "r_items", order_id="order_id", order_item_id="order_item_id"),
            _null_check(
                "order_payments", "r_payments",
                order_id="order_id", payment_sequential="payment_sequential",
            ),
            _null_check("order_reviews", "r_reviews", review_id="review_id", order_id="order_id"),
        ]
    ),
    "check_domains": """
        SELECT 'order_items' AS tbl, 'price < 0' AS rule,
               count(*) FILTER (WHERE price < 0) AS bad_rows FROM r_items
        UNION ALL SELECT 'order_items', 'freight_value < 0',
               count(*) FILTER (WHERE freight < 0) FROM r_items
        UNION ALL SELECT 'order_payments', 'payment_value < 0',
               count(*) FILTER (WHERE payment_value < 0) FROM r_payments
        UNION ALL SELECT 'order_reviews', 'review_score out of range',
               count(*) FILTER (WHERE stars < 1 OR stars > 5) FROM r_reviews""",
}

MONTH_SALES = f"""
    SELECT {BOUGHT_YM} AS ym, count(DISTINCT order_id) AS orders, sum(price) AS gmv
    FROM sold GROUP BY ym"""

BUSINESS = {
    "biz_core_kpis": f"""
        SELECT {dbl('sum(price)')} AS gmv, {dbl('sum(freight)')} AS freight,
               count(DISTINCT order_id) AS valid_orders,
               {quotient('sum(price)', 'count(DISTINCT order_id)')} AS aov,
               (SELECT count(DISTINCT customer_unique_id) FROM r_customers) AS persons,
               (SELECT count(DISTINCT seller_id) FROM r_sellers) AS sellers,
               (SELECT count(DISTINCT product_id) FROM r_products) AS products
        FROM sold""",
    "biz_all_vs_delivered": f"""
        SELECT count(DISTINCT i.order_id) AS all_orders, {dbl('sum(i.price)')} AS all_gmv,
               {quotient('sum(i.price)', 'count(DISTINCT i.order_id)')} AS all_aov,
               (SELECT {dbl('sum(price)')} FROM sold) AS delivered_gmv
        FROM r_items i JOIN r_orders o ON o.order_id = i.order_id""",
    "biz_monthly_trend": f"""
        SELECT ym, orders, {dbl('gmv')} AS gmv, {quotient('gmv', 'orders')} AS aov,
               {share('gmv', 'sum(gmv) OVER ()')} AS gmv_pct
        FROM ({MONTH_SALES})""",
    "biz_monthly_mom": f"""
        SELECT ym, {dbl('gmv')} AS gmv, {dbl('earlier')} AS prev_gmv,
               {share('(gmv - earlier)', 'earlier')} AS mom_pct
        FROM (SELECT ym, gmv, lag(gmv) OVER (ORDER BY ym) AS earlier FROM ({MONTH_SALES}))""",
    "biz_state_performance": f"""
        WITH per_state AS (
            SELECT b.state, count(DISTINCT b.order_id) AS orders, sum(i.price) AS gmv,
                   count(DISTINCT b.person) AS persons
            FROM bought_by b JOIN r_items i ON i.order_id = b.order_id GROUP BY b.state)
        SELECT state, orders, {dbl('gmv')} AS gmv, {quotient('gmv', 'orders')} AS aov, persons,
               {share('gmv', '(SELECT sum(gmv) FROM per_state)')} AS gmv_pct
        FROM per_state ORDER BY per_state.gmv DESC, state LIMIT 15""",
    "biz_category_structure": f"""
        SELECT coalesce(english, raw_name, 'unknown') AS category,
               count(DISTINCT order_id) AS orders, {dbl('sum(price)')} AS gmv
        FROM sold_named GROUP BY english, raw_name
        ORDER BY sum(price) DESC, category, raw_name LIMIT 20""",
}

PERSON_COUNTS = "SELECT person, count(DISTINCT order_id) AS n FROM bought_by GROUP BY person"
RFM = f"""
    SELECT b.person, date_diff('day', cast(max(b.bought) AS date),
               cast((SELECT max(bought) FROM r_orders WHERE order_status = 'delivered') AS date)) AS r,
           count(DISTINCT b.order_id) AS f, sum(i.price) AS m
    FROM bought_by b LEFT JOIN r_items i ON i.order_id = b.order_id GROUP BY b.person"""
RFM_BANDS = f"""
    SELECT person, r, f, m,
           CASE WHEN row_number() OVER (ORDER BY r NULLS FIRST, person) * 10 <= count(*) OVER () * 3
                THEN 'near' ELSE 'far' END AS r_band,
           CASE WHEN row_number() OVER (ORDER BY f DESC NULLS LAST, person) * 10 <= count(*) OVER () * 3
                THEN 'high' ELSE 'low' END AS f_band,
           CASE WHEN row_number() OVER (ORDER BY m DESC NULLS LAST, person) * 10
                     <= count(*) OVER () * 3 THEN 'high' ELSE 'low' END AS m_band
    FROM ({RFM})"""
GAPS = """
    SELECT date_diff('day', cast(lag(bought) OVER (PARTITION BY person ORDER BY bought) AS date),
                     cast(bought AS date)) AS gap FROM bought_by"""
COHORT = f"""
    SELECT first_ym, ym AS purchase_ym,
           date_diff('month', strptime(first_ym || '-01', '%Y-%m-%d'),
                     strptime(ym || '-01', '%Y-%m-%d')) + 1 AS period,
           count(DISTINCT person) AS users
    FROM (SELECT person, {BOUGHT_YM} AS ym,
                 {YM.format('min(bought) OVER (PARTITION BY person)')} AS first_ym
          FROM bought_by)
    GROUP BY first_ym, ym"""

CUSTOMERS = {
    "cust_id_vs_person": """
        SELECT count(DISTINCT customer_id) AS customer_ids,
               count(DISTINCT customer_unique_id) AS persons, count(*) AS customer_rows
        FROM r_customers""",
    "cust_frequency": f"""
        SELECT n AS order_cnt, count(*) AS persons,
               {share('count(*)', 'sum(count(*)) OVER ()')} AS pct
        FROM ({PERSON_COUNTS}) GROUP BY n""",
    "cust_repeat_rate": f"""
        SELECT count(*) AS buyers, count(*) FILTER (WHERE n >= 2) AS repeat_buyers,
               {share('count(*) FILTER (WHERE n >= 2)', 'count(*)')} AS repeat_pct
        FROM ({PERSON_COUNTS})""",
    "cust_new_by_month": f"""
        SELECT first_ym, count(*) AS new_persons
        FROM (SELECT person, {YM.format('min(bought)')} AS first_ym FROM bought_by GROUP BY person)
        GROUP BY first_ym""",
    "cust_repeat_gap": f"""
        SELECT {quotient('sum(gap)', 'count(gap)', 1)} AS avg_gap,
               {dbl('quantile_disc(gap, 0.5)')} AS median_gap
        FROM ({GAPS}) WHERE gap IS NOT NULL""",
    "cust_cohort_retention": f"""
        WITH active AS ({COHORT})
        SELECT a.first_ym, a.purchase_ym, a.period, a.users, b.users AS cohort_size,
               {share('a.users', 'b.users')} AS retention_pct
        FROM active a JOIN active b ON b.first_ym = a.first_ym AND b.purchase_ym = b.first_ym""",
    "cust_rfm": f"""
        SELECT person, r AS r_days, f AS f_orders, {dbl('m')} AS m_gmv, r_band, f_band, m_band
        FROM ({RFM_BANDS}) ORDER BY m DESC NULLS LAST, person LIMIT 20""",
}

CATEGORY_SALES = """
    SELECT english, raw_name, count(DISTINCT order_id) AS orders, sum(price) AS gmv,
           count(product_id) AS units
    FROM sold_named GROUP BY english, raw_name"""

PRODUCTS = {
    "prod_category_rank": f"""
        SELECT coalesce(english, raw_name, 'unknown') AS category, orders, {dbl('gmv')} AS gmv, units,
               {quotient('gmv', 'orders')} AS gmv_per_order,
               {quotient('units', 'orders')} AS units_per_order,
               rank() OVER (ORDER BY c.gmv DESC) AS gmv_rank,
               dense_rank() OVER (ORDER BY c.units DESC) AS units_rank
        FROM ({CATEGORY_SALES}) c ORDER BY c.gmv DESC, category, raw_name LIMIT 20""",
    "prod_category_concentration": f"""
        SELECT coalesce(english, raw_name) AS category, {dbl('gmv')} AS gmv,
               {share('gmv', 'sum(c.gmv) OVER ()')} AS gmv_pct,
               {share('sum(c.gmv) OVER (ORDER BY c.gmv DESC)', 'sum(c.gmv) OVER ()')} AS cum_pct
        FROM ({CATEGORY_SALES}) c
        ORDER BY c.gmv DESC, category NULLS FIRST, raw_name NULLS FIRST LIMIT 10""",
    "prod_top_per_category": f"""
        SELECT category, product_id, orders, {dbl('gmv')} AS gmv
        FROM (SELECT coalesce(english, raw_name) AS category, product_id, sum(price) AS gmv,
                     count(DISTINCT order_id) AS orders,
                     row_number() OVER (
                         PARTITION BY coalesce(english, raw_name)
                         ORDER BY count(DISTINCT order_id) DESC, sum(price) DESC, product_id) AS place
              FROM sold_named GROUP BY english, raw_name, product_id) p
        WHERE place = 1 ORDER BY p.gmv DESC, product_id LIMIT 15""",
    "prod_freight_sensitivity": f"""
        SELECT coalesce(english, raw_name) AS category, {mean('price')} AS avg_price,
               {mean('freight')} AS avg_freight,
               {share('(cast(sum(freight) AS double) / count(freight))',
                      '(cast(sum(price) AS double) / count(price))', 1)} AS freight_pct
        FROM sold_named GROUP BY english, raw_name HAVING count(DISTINCT order_id) >= 50
        ORDER BY freight_pct DESC NULLS LAST, category NULLS FIRST, raw_name NULLS FIRST LIMIT 15""",
    "prod_category_score": f"""
        SELECT coalesce(english, raw_name, 'unknown') AS category,
               count(DISTINCT s.order_id) AS orders, {dbl('sum(price)')} AS gmv,
               {mean('score')} AS avg_score
        FROM sold_named s JOIN stars_of USING (order_id) WHERE score IS NOT NULL
        GROUP BY english, raw_name HAVING count(DISTINCT s.order_id) >= 30
        ORDER BY orders DESC, category, raw_name LIMIT 20""",
}

SELLER_SALES = """
    SELECT seller_id, sum(price) AS gmv, count(DISTINCT order_id) AS orders
    FROM sold GROUP BY seller_id"""


def _tiers(head: int, mid: int) -> str:
    return f"""
        SELECT tier, count(*) AS sellers, {dbl('sum(gmv)')} AS gmv,
               {share('sum(gmv)', 'sum(sum(gmv)) OVER ()')} AS gmv_pct
        FROM (SELECT gmv, CASE
                 WHEN place <= ceil(n * {head} / 100.0) THEN 'head'
                 WHEN place <= ceil(n * {mid} / 100.0) THEN 'mid' ELSE 'tail' END AS tier
              FROM (SELECT gmv, count(*) OVER () AS n,
                           row_number() OVER (ORDER BY gmv DESC, seller_id) AS place
                    FROM ({SELLER_SALES}))) t
        GROUP BY tier"""


def _volume_bands(cases: str) -> str:
    return f"""
        SELECT band_order, band, count(*) AS sellers,
               {share('count(*)', 'sum(count(*)) OVER ()')} AS pct
        FROM (SELECT unnest(CASE {cases} END) FROM ({SELLER_SALES}))
        GROUP BY band_order, band"""


def _risk(min_orders: int, score: float, gmv: float) -> str:
    return f"""
        WITH rated AS (
            SELECT seller_id, {mean('score')} AS avg_score, count(*) AS reviewed_orders
            FROM (SELECT DISTINCT seller_id, order_id FROM sold) JOIN stars_of USING (order_id)
            GROUP BY seller_id)
        SELECT seller_id, {dbl('s.gmv')} AS gmv, orders, avg_score, reviewed_orders,
               CASE WHEN avg_score <= {score} AND s.gmv > {gmv} THEN 'risk' ELSE 'normal' END AS flag
        FROM ({SELLER_SALES}) s JOIN rated USING (seller_id)
        WHERE orders >= {min_orders} AND avg_score IS NOT NULL
        ORDER BY s.gmv DESC, seller_id LIMIT 25"""


def _case(band: int, label: str) -> str:
    return f"{{'band_order': {big(band)}, 'band': '{label}'}}"


SELLERS = {
    "seller_concentration": f"""
        SELECT seller_id, {dbl('gmv')} AS gmv, orders, {share('gmv', 'sum(s.gmv) OVER ()')} AS gmv_pct,
               {share('sum(s.gmv) OVER (ORDER BY s.gmv DESC)', 'sum(s.gmv) OVER ()')} AS cum_pct
        FROM ({SELLER_SALES}) s ORDER BY s.gmv DESC, seller_id LIMIT 15""",
    "seller_tiers": _tiers(2, 20),
    "seller_order_bands": _volume_bands(
        f"WHEN orders <= 1 THEN {_case(1, '1')} WHEN orders <= 5 THEN {_case(2, '2-5')}"
        f" WHEN orders <= 20 THEN {_case(3, '6-20')} ELSE {_case(4, '>20')}"
    ),
    "seller_order_bands_wide": _volume_bands(
        f"WHEN orders <= 160 THEN {_case(1, '1-160')} WHEN orders <= 180 THEN {_case(2, '161-180')}"
        f" WHEN orders <= 200 THEN {_case(3, '181-200')} ELSE {_case(4, '>200')}"
    ),
    "seller_quality_risk": _risk(10, 4, 30000),
    "seller_quality_risk_strict": _risk(10, 3, 10400),
    "seller_geography": f"""
        SELECT seller_state AS state, count(*) AS sellers,
               {share('count(*)', 'sum(count(*)) OVER ()')} AS pct
        FROM r_sellers GROUP BY seller_state ORDER BY sellers DESC, state LIMIT 12""",
}


def _punctual(late: str) -> str:
    return f"""
        SELECT count(*) AS orders, count(*) FILTER (WHERE NOT {late}) AS on_time,
               count(*) FILTER (WHERE {late}) AS late,
               {share(f'count(*) FILTER (WHERE {late})', 'count(*)')} AS late_pct,
               {share(f'count(*) FILTER (WHERE NOT {late})', 'count(*)')} AS on_time_pct
        FROM arrivals a WHERE late IS NOT NULL"""


def _by_punctuality(late: str) -> str:
    return f"""
        SELECT CASE WHEN {late} THEN 'late' ELSE 'on_time' END AS fulfillment,
               count(*) AS orders, {mean('score')} AS avg_score
        FROM arrivals a JOIN stars_of USING (order_id) WHERE late IS NOT NULL GROUP BY fulfillment"""


LATE_SHARE = share("count(*) FILTER (WHERE late)", "count(*)")
LOGISTICS = {
    "log_delivery_time": f"""
        SELECT {mean('days', 1)} AS avg_days, {dbl('quantile_disc(days, 0.5)')} AS median_days,
               count(*) AS delivered
        FROM arrivals""",
    "log_on_time_rate": _punctual("a.late"),
    "log_on_time_rate_timestamp": _punctual("a.late_to_the_second"),
    "log_late_bands": f"""
        SELECT band_order, band, count(*) AS orders,
               {share('count(*)', 'sum(count(*)) OVER ()')} AS pct
        FROM (SELECT unnest(CASE WHEN overdue <= 0 THEN {_case(1, 'on_time')}
                     WHEN overdue <= 3 THEN {_case(2, 'late_1_3')}
                     WHEN overdue <= 7 THEN {_case(3, 'late_4_7')}
                     ELSE {_case(4, 'late_over_7')} END)
              FROM arrivals WHERE overdue IS NOT NULL)
        GROUP BY band_order, band""",
    "log_state": f"""
        SELECT c.customer_state AS state, count(*) AS orders, {mean('days', 1)} AS avg_days,
               {LATE_SHARE} AS late_pct
        FROM arrivals a JOIN r_customers c ON c.customer_id = a.customer_id
        WHERE late IS NOT NULL
        GROUP BY c.customer_state HAVING count(*) >= 200
        ORDER BY late_pct DESC, state LIMIT 12""",
    "log_seller": f"""
        SELECT seller_id, count(*) AS orders, {LATE_SHARE} AS late_pct, {mean('days', 1)} AS avg_days
        FROM (SELECT DISTINCT seller_id, order_id FROM r_items) JOIN arrivals USING (order_id)
        WHERE late IS NOT NULL
        GROUP BY seller_id HAVING count(*) >= 20
        ORDER BY late_pct DESC, seller_id LIMIT 12""",
    "log_days_band_vs_score": f"""
        SELECT band_order, band, count(*) AS orders, {mean('score')} AS avg_score,
               count(*) FILTER (WHERE late) AS late, {LATE_SHARE} AS late_pct
        FROM (SELECT unnest(CASE WHEN days <= 3 THEN {_case(1, '<=3')}
                     WHEN days <= 7 THEN {_case(2, '4-7')} WHEN days <= 10 THEN {_case(3, '8-10')}
                     WHEN days <= 15 THEN {_case(4, '11-15')} ELSE {_case(5, '>15')} END),
                     score, late
              FROM arrivals JOIN stars_of USING (order_id) WHERE late IS NOT NULL) b
        GROUP BY band_order, band""",
    "log_on_time_vs_score": _by_punctuality("a.late"),
    "log_on_time_vs_score_timestamp": _by_punctuality("a.late_to_the_second"),
}

REVIEWS = {
    "rev_order_score_summary": f"""
        SELECT count(*) AS orders, {mean('score')} AS avg_score,
               count(*) FILTER (WHERE score <= 2) AS bad_orders,
               {share('count(*) FILTER (WHERE score <= 2)', 'count(score)')} AS bad_pct,
               count(*) FILTER (WHERE score <= 1) AS one_star_orders
        FROM stars_of""",
    "rev_value_band_vs_score": f"""
        SELECT band_order, band, count(*) AS orders, {mean('score')} AS avg_score
        FROM (SELECT unnest(CASE WHEN paid < 50 THEN {_case(1, '<50')}
                     WHEN paid < 100 THEN {_case(2, '50-100')}
                     WHEN paid < 200 THEN {_case(3, '100-200')}
                     WHEN paid < 400 THEN {_case(4, '200-400')} ELSE {_case(5, '>400')} END), score
              FROM (SELECT order_id, sum(price) AS paid FROM sold GROUP BY order_id)
              JOIN stars_of USING (order_id))
        GROUP BY band_order, band""",
    "rev_payment_vs_score": f"""
        SELECT payment_type, count(*) AS orders, {mean('score')} AS avg_score,
               {share('count(*) FILTER (WHERE score <= 2)', 'count(score)')} AS bad_pct
        FROM (SELECT DISTINCT order_id, payment_type FROM r_payments WHERE payment_type IS NOT NULL)
        JOIN stars_of USING (order_id) GROUP BY payment_type""",
    "rev_category_score": f"""
        SELECT category, count(*) AS reviewed_orders, {mean('score')} AS avg_score
        FROM (SELECT DISTINCT coalesce(english, raw_name, 'unknown') AS category, order_id
              FROM sold_named) JOIN stars_of USING (order_id)
        GROUP BY category HAVING count(*) >= 100""",
}

RAW_APPROVED = """CASE WHEN order_id % 50 = 1 THEN 'not a date'
    ELSE strftime(approved, '%Y-%m-%d %H:%M:%S') END"""
RAW_CARRIED = "CASE WHEN order_id % 40 = 0 THEN '' ELSE strftime(carried, '%Y-%m-%d %H:%M:%S') END"
STAMP = "%Y-%m-%d %H:%M:%S"

CLEANING = {
    "clean_customers": """
        SELECT cast(customer_id AS varchar) AS customer_id,
               cast(customer_unique_id AS varchar) AS customer_unique_id,
               cast(lpad(cast(customer_zip_code_prefix AS varchar), 5, '0') AS bigint)
                   AS customer_zip_code_prefix, customer_city, customer_state
        FROM r_customers""",
    "clean_orders": f"""
        SELECT cast(order_id AS varchar) AS order_id, cast(customer_id AS varchar) AS customer_id,
               order_status, strftime(bought, '{STAMP}') AS order_purchase_timestamp,
               strftime(try_cast({RAW_APPROVED} AS timestamp), '{STAMP}') AS order_approved_at,
               strftime(try_cast({RAW_CARRIED} AS timestamp), '{STAMP}')
                   AS order_delivered_carrier_date,
               strftime(arrived, '{STAMP}') AS order_delivered_customer_date,
               strftime(promised, '{STAMP}') AS order_estimated_delivery_date
        FROM r_orders""",
    "clean_order_items": f"""
        SELECT cast(order_id AS varchar) AS order_id, {big('order_item_id')} AS order_item_id,
               cast(product_id AS varchar) AS product_id, cast(seller_id AS varchar) AS seller_id,
               strftime(shipping_limit_date, '{STAMP}') AS shipping_limit_date,
               {dbl('price')} AS price, {dbl('freight')} AS freight_value
        FROM r_items""",
    "clean_order_payments": f"""
        SELECT cast(order_id AS varchar) AS order_id, {big('payment_sequential')} AS payment_sequential,
               payment_type, {big('payment_installments')} AS payment_installments,
               {dbl('payment_value')} AS payment_value
        FROM r_payments""",
    "clean_order_reviews": f"""
        SELECT review_id, review_id AS order_id, {dbl('stars')} AS review_score,
               title AS review_comment_title, message AS review_comment_message,
               created AS review_creation_date, answered AS review_answer_timestamp
        FROM (SELECT *, row_number() OVER (
                     PARTITION BY review_id
                     ORDER BY created, answered NULLS FIRST, stars NULLS FIRST, title, message) AS place
              FROM (SELECT cast(order_id AS varchar) AS review_id, stars, title, message,
                           strftime(created, '{STAMP}') AS created,
                           CASE WHEN review_id % 100 <> 3
                                THEN strftime(answered, '{STAMP}') END AS answered
                    FROM r_reviews))
        WHERE place = 1""",
    "clean_products": f"""
        SELECT cast(product_id AS varchar) AS product_id,
               coalesce(raw_name, 'unknown') AS product_category_name,
               {dbl('name_length')} AS product_name_lenght, {dbl('weight')} AS product_weight_g,
               {', '.join(f"{dbl('NULL')} AS product_{c}" for c in (
                   'description_lenght', 'photos_qty', 'length_cm', 'height_cm', 'width_cm'))}
        FROM r_products""",
    "clean_sellers": """
        SELECT cast(seller_id AS varchar) AS seller_id, cast(zip AS bigint) AS seller_zip_code_prefix,
               city AS seller_city, seller_state
        FROM r_sellers""",
    "clean_category_name": """
        SELECT raw_name AS product_category_name, english AS product_category_name_english
        FROM r_names""",
}

PROFILING = {
    "eda_table_profile": """
        SELECT 'customers' AS tbl, count(*) AS rows_cnt, 'customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state' AS first_columns FROM r_customers
        UNION ALL SELECT 'orders', count(*), 'order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date' FROM r_orders
        UNION ALL SELECT 'order_items', count(*), 'order_id,order_item_id,product_id,seller_id,shipping_limit_date,price' FROM r_items
        UNION ALL SELECT 'order_payments', count(*), 'order_id,payment_sequential,payment_type,payment_installments,payment_value' FROM r_payments
        UNION ALL SELECT 'order_reviews', count(*), 'review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date' FROM r_reviews
        UNION ALL SELECT 'products', count(*), 'product_id,product_category_name,product_name_lenght,product_weight_g' FROM r_products
        UNION ALL SELECT 'sellers', count(*), 'seller_id,seller_zip_code_prefix,seller_city,seller_state' FROM r_sellers
        UNION ALL SELECT 'category_name', count(*), 'product_category_name,product_category_name_english' FROM r_names""",
    "eda_order_profile": """
        SELECT count(*) AS order_rows, count(DISTINCT order_id) AS order_ids,
               count(*) - count(approved) AS approved_nulls, count(*) - count(carried) AS carrier_nulls,
               count(*) - count(arrived) AS delivered_nulls,
               count(*) - count(promised) AS estimated_nulls
        FROM r_orders""",
    "eda_status_counts": """
        SELECT order_status, count(*) AS order_cnt FROM r_orders GROUP BY order_status""",
    "eda_review_duplicates": """
        SELECT count(*) AS raw_rows, count(DISTINCT order_id) AS clean_rows,
               count(*) - count(DISTINCT order_id) AS removed_rows
        FROM r_reviews""",
    "eda_multi_review_orders": """
        SELECT count(*) AS reviewed_orders, count(*) FILTER (WHERE n > 1) AS multi_review_orders
        FROM (SELECT count(*) AS n FROM r_reviews GROUP BY order_id)""",
    "eda_payment_split": """
        SELECT count(*) FILTER (WHERE n = 1) AS single_payment_orders,
               count(*) FILTER (WHERE n > 1) AS multi_payment_orders
        FROM (SELECT count(*) AS n FROM r_payments GROUP BY order_id)""",
    "eda_sales_check": f"""
        SELECT count(DISTINCT order_id) AS valid_orders, {dbl('sum(price)')} AS gmv,
               {quotient('sum(price)', 'count(DISTINCT order_id)')} AS aov,
               {dbl('sum(freight)')} AS freight
        FROM sold""",
    "eda_repeat_check": f"""
        SELECT count(*) AS buyers, count(*) FILTER (WHERE n >= 2) AS repeat_buyers,
               {share('count(*) FILTER (WHERE n >= 2)', 'count(*)')} AS repeat_pct
        FROM (SELECT count(DISTINCT c.customer_id) AS n
              FROM r_customers c JOIN r_orders o ON o.customer_id = c.customer_id
              WHERE o.order_status = 'delivered' GROUP BY c.customer_unique_id)""",
    "eda_late_score_check": f"""
        SELECT {rounded('a', 2)} AS on_time_score, {rounded('b', 2)} AS late_score,
               {rounded('a - b', 2)} AS score_drop
        FROM (SELECT cast(sum(score) FILTER (WHERE NOT late_to_the_second) AS double)
                         / count(score) FILTER (WHERE NOT late_to_the_second) AS a,
                     cast(sum(score) FILTER (WHERE late_to_the_second) AS double)
                         / count(score) FILTER (WHERE late_to_the_second) AS b
              FROM arrivals JOIN stars_of USING (order_id))""",
}

DERIVED = {
    "gmv_inflation": f"""
        SELECT {dbl('whole')} AS all_gmv, {dbl('part')} AS delivered_gmv,
               {share('(whole - part)', 'part')} AS inflation_pct
        FROM (SELECT (SELECT sum(price) FROM r_items JOIN r_orders USING (order_id)) AS whole,
                     (SELECT sum(price) FROM sold) AS part)""",
    "freight_ratio": f"""
        SELECT {dbl('sum(price)')} AS gmv, {dbl('sum(s.freight)')} AS freight,
               {share('sum(s.freight)', 'sum(price)')} AS freight_pct
        FROM sold s""",
    "active_by_month": f"""
        SELECT {BOUGHT_YM} AS ym, count(DISTINCT person) AS active_persons
        FROM bought_by GROUP BY ym""",
    "rfm_segments": f"""
        SELECT r_band, f_band, m_band, count(*) AS persons, {dbl('sum(m)')} AS gmv,
               {share('count(*)', 'sum(count(*)) OVER ()')} AS persons_pct,
               {share('sum(m)', 'sum(sum(m)) OVER ()')} AS gmv_pct
        FROM ({RFM_BANDS}) GROUP BY r_band, f_band, m_band""",
    "tier_by_cum_share": f"""
        SELECT tier, cast(count(*) AS bigint) AS sellers, {dbl('sum(gmv)')} AS gmv,
               {share('sum(gmv)', 'sum(sum(gmv)) OVER ()')} AS gmv_pct
        FROM (SELECT gmv, CASE WHEN sum(gmv) OVER (ORDER BY gmv DESC) * 100
                                    <= sum(gmv) OVER () * 80 THEN 'head'
                               WHEN sum(gmv) OVER (ORDER BY gmv DESC) * 100
                                    <= sum(gmv) OVER () * 95 THEN 'mid' ELSE 'tail' END AS tier
              FROM ({SELLER_SALES})) t
        GROUP BY tier""",
    "seller_health": f"""
        SELECT seller_id, count(*) AS orders, {dbl('sum(g)')} AS gmv,
               {share('count(*) FILTER (WHERE NOT late)', 'count(late)')} AS on_time_pct,
               {quotient('sum(days) FILTER (WHERE late IS NOT NULL)', 'count(days) FILTER (WHERE late IS NOT NULL)', 1)} AS avg_days,
               count(score) AS scored_orders,
               {share('count(*) FILTER (WHERE score <= 2)', 'count(score)')} AS bad_pct
        FROM (SELECT seller_id, order_id, sum(price) AS g FROM sold GROUP BY seller_id, order_id)
        LEFT JOIN arrivals USING (order_id) LEFT JOIN stars_of USING (order_id)
        GROUP BY seller_id""",
    "category_new_buyers": """
        WITH firsts AS (
            SELECT person, order_id, row_number() OVER (
                PARTITION BY person ORDER BY bought, order_id) AS place FROM bought_by)
        SELECT coalesce(english, raw_name, 'unknown') AS category,
               count(DISTINCT person) AS new_persons
        FROM firsts JOIN sold_named USING (order_id) WHERE place = 1 GROUP BY category""",
    "monthly_yoy": f"""
        WITH m AS ({MONTH_SALES})
        SELECT m.ym, {dbl('m.gmv')} AS gmv, {dbl('e.gmv')} AS last_year_gmv,
               {share('(m.gmv - e.gmv)', 'e.gmv')} AS yoy_pct
        FROM m LEFT JOIN m e
          ON cast(substr(e.ym, 1, 4) AS int) + 1 = cast(substr(m.ym, 1, 4) AS int)
         AND substr(e.ym, 6) = substr(m.ym, 6)""",
    "payments_per_order": f"""
        SELECT order_id, {dbl('sum(payment_value)')} AS paid, count(*) AS records,
               count(DISTINCT payment_type) AS payment_types
        FROM r_payments GROUP BY order_id""",
}

SALES_ROWS = """
    SELECT b.order_id, b.person, b.state, strftime(b.bought, '%Y-%m') AS ym,
           i.order_id AS item_order, i.price, i.freight
    FROM bought_by b LEFT JOIN r_items i ON i.order_id = b.order_id"""


def _sales_by(*dims: str, rows: str = SALES_ROWS, where: str = "true") -> str:
    keys = "".join(f"{d}, " for d in dims)
    group = f"GROUP BY {', '.join(dims)}" if dims else ""
    on = " AND ".join(f"a.{d} IS NOT DISTINCT FROM b.{d}" for d in dims) or "true"
    return f"""
        WITH facts AS (SELECT * FROM ({rows}) WHERE {where}),
        sums AS (
            SELECT {keys} sum(price) AS gmv, sum(freight) AS freight,
                   count(DISTINCT item_order) AS valid_orders, count(DISTINCT person) AS buyers
            FROM facts {group}),
        repeats AS (
            SELECT {keys} count(*) FILTER (WHERE n >= 2) AS repeat_buyers
            FROM (SELECT {keys} person, count(DISTINCT order_id) AS n
                  FROM facts GROUP BY {keys} person) {group})
        SELECT {''.join(f'a.{d}, ' for d in dims)} {dbl('a.gmv')} AS gmv, {dbl('a.freight')} AS freight,
               valid_orders, {quotient('a.gmv', 'valid_orders')} AS aov, buyers, repeat_buyers,
               {share('repeat_buyers', 'buyers')} AS repeat_rate
        FROM sums a JOIN repeats b ON {on}"""


CATEGORY_ROWS = """
    SELECT b.order_id, b.person, s.order_id AS item_order, s.price, s.freight,
           coalesce(s.english, s.raw_name, 'unknown') AS category
    FROM bought_by b JOIN sold_named s ON s.order_id = b.order_id"""
SELLER_ROWS = """
    SELECT b.order_id, b.person, strftime(b.bought, '%Y-%m') AS ym, i.order_id AS item_order,
           i.price, i.freight, v.seller_state
    FROM bought_by b JOIN r_items i ON i.order_id = b.order_id
    JOIN r_sellers v ON v.seller_id = i.seller_id"""


def _service_by(*dims: str) -> str:
    keys = "".join(f"{d}, " for d in dims)
    group = f"GROUP BY {', '.join(dims)}" if dims else ""
    return f"""
        SELECT {keys} count(days) AS delivered, {mean('days', 1)} AS avg_days,
               {share('count(*) FILTER (WHERE late)', 'count(late)')} AS late_rate,
               {mean('score')} AS avg_score
        FROM (SELECT a.order_id, a.days, a.late, b.state, strftime(b.bought, '%Y-%m') AS ym
              FROM arrivals a JOIN bought_by b ON b.order_id = a.order_id
              WHERE a.late IS NOT NULL)
        LEFT JOIN stars_of USING (order_id) {group}"""


def _service_over(dim: str, values: str) -> str:
    """Service measures by a dimension of which an order can have several values."""
    return f"""
        SELECT {dim}, count(days) AS delivered, {mean('days', 1)} AS avg_days,
               {share('count(*) FILTER (WHERE late)', 'count(late)')} AS late_rate,
               {mean('score')} AS avg_score
        FROM (SELECT DISTINCT {dim}, a.order_id, a.days, a.late
              FROM arrivals a JOIN ({values}) v ON v.order_id = a.order_id
              JOIN bought_by b ON b.order_id = a.order_id WHERE a.late IS NOT NULL)
        LEFT JOIN stars_of USING (order_id) GROUP BY {dim}"""


METRICS = {
    "metric_sales_total": _sales_by(),
    "metric_sales_by_month": _sales_by("ym"),
    "metric_sales_by_state": _sales_by("state"),
    "metric_sales_by_category": _sales_by("category", rows=CATEGORY_ROWS),
    "metric_sales_by_seller_state_month": _sales_by("seller_state", "ym", rows=SELLER_ROWS),
    "metric_sales_filtered": _sales_by("ym", where="state = 'NATION_3'"),
    "metric_service_total": _service_by(),
    "metric_service_by_state": _service_by("state"),
    "metric_service_by_month": _service_by("ym"),
    "metric_service_by_category": _service_over("category", CATEGORY_ROWS),
    "metric_service_by_payment_type": _service_over("payment_type", "SELECT * FROM r_payments"),
    "metric_all_by_seller_state": f"""
        SELECT coalesce(a.seller_state, s.seller_state) AS seller_state, gmv, freight, valid_orders,
               aov, buyers, repeat_buyers, repeat_rate, delivered, avg_days, late_rate, avg_score
        FROM ({_sales_by('seller_state', rows=SELLER_ROWS)}) a
        FULL JOIN ({_service_over('seller_state', SELLER_ROWS)}) s
            ON a.seller_state IS NOT DISTINCT FROM s.seller_state""",
}

PAGES = {
    "page_overview_figures": BUSINESS["biz_core_kpis"],
    "page_customer_figures": f"""
        SELECT {share('count(*) FILTER (WHERE n >= 2)', 'count(*)')} AS repeat_pct,
               count(*) AS buyers, count(*) FILTER (WHERE n >= 2) AS repeat_buyers,
               count(*) FILTER (WHERE n < 2) AS one_time_buyers,
               (SELECT {dbl('quantile_disc(gap, 0.5)')} FROM ({GAPS}) WHERE gap IS NOT NULL)
                   AS median_gap,
               (SELECT {quotient('sum(gap)', 'count(gap)', 1)} FROM ({GAPS})) AS avg_gap
        FROM ({PERSON_COUNTS})""",
    "page_supply_figures": f"""
        WITH t AS ({_tiers(2, 20)}),
        c AS (SELECT * FROM ({CATEGORY_SALES}) q
              ORDER BY q.gmv DESC, coalesce(english, raw_name, 'unknown'), raw_name LIMIT 1)
        SELECT (SELECT coalesce(english, raw_name, 'unknown') FROM c) AS top_category,
               (SELECT {dbl('gmv')} FROM c) AS top_category_gmv,
               (SELECT gmv_pct FROM t WHERE tier = 'head') AS head_gmv_pct,
               (SELECT sellers FROM t WHERE tier = 'head') AS head_sellers,
               (SELECT gmv_pct FROM t WHERE tier = 'tail') AS tail_gmv_pct,
               (SELECT sellers FROM t WHERE tier = 'tail') AS tail_sellers,
               {mean('score')} AS avg_score,
               {share('count(*) FILTER (WHERE score <= 2)', 'count(score)')} AS bad_pct
        FROM stars_of""",
    "page_logistics_figures": f"""
        SELECT {mean('days', 1)} AS avg_days, {dbl('quantile_disc(days, 0.5)')} AS median_days,
               count(*) AS delivered,
               {share('count(*) FILTER (WHERE NOT late)', 'count(late)')} AS on_time_pct,
               {share('count(*) FILTER (WHERE late)', 'count(late)')} AS late_pct,
               count(*) FILTER (WHERE late) AS late_orders,
               {quotient('sum(score) FILTER (WHERE NOT late)', 'count(score) FILTER (WHERE NOT late)')}
                   AS on_time_score,
               {quotient('sum(score) FILTER (WHERE late)', 'count(score) FILTER (WHERE late)')}
                   AS late_score
        FROM arrivals LEFT JOIN stars_of USING (order_id)""",
    "page_top_categories": f"""
        SELECT coalesce(english, raw_name, 'unknown') AS category, orders, {dbl('gmv')} AS gmv
        FROM ({CATEGORY_SALES}) c ORDER BY c.gmv DESC, category, raw_name LIMIT 10""",
    "page_cohort_matrix": f"""
        WITH active AS ({COHORT}),
        cohort AS (SELECT first_ym, users FROM active WHERE purchase_ym = first_ym),
        grid AS (SELECT first_ym, users, unnest(range(1, (SELECT max(period) FROM active) + 1)) AS period
                 FROM cohort)
        SELECT g.first_ym, g.users AS cohort_size, g.period,
               {share('a.users', 'g.users')} AS retention_pct
        FROM grid g LEFT JOIN active a ON a.first_ym = g.first_ym AND a.period = g.period""",
    "page_category_scatter": f"""
        SELECT coalesce(english, raw_name, 'unknown') AS category,
               coalesce(raw_name, '') AS raw_category, orders, {dbl('gmv')} AS gmv
        FROM ({CATEGORY_SALES})""",
    "page_state_late_rates": f"""
        SELECT c.customer_state AS state, count(*) AS orders, {mean('days', 1)} AS avg_days,
               {LATE_SHARE} AS late_pct
        FROM arrivals a JOIN r_customers c ON c.customer_id = a.customer_id
        WHERE late IS NOT NULL GROUP BY c.customer_state""",
}

GRAINS = {
    "grain_valid_orders": f"""
        SELECT order_id, customer_id, {YM.format('bought')} AS ym
        FROM r_orders WHERE order_status = 'delivered'""",
    "grain_order_value": f"""
        SELECT order_id, {dbl('sum(price)')} AS gmv, {dbl('sum(freight)')} AS freight,
               count(*) AS units
        FROM r_items GROUP BY order_id""",
    "grain_order_score": f"""
        SELECT order_id, {dbl('score')} AS score FROM stars_of""",
    "grain_seller_orders": f"""
        SELECT seller_id, order_id, {dbl('sum(price)')} AS gmv, count(*) AS units
        FROM sold GROUP BY seller_id, order_id""",
    "grain_category_orders": """
        SELECT DISTINCT coalesce(english, raw_name, 'unknown') AS category, order_id
        FROM sold_named""",
    "grain_payment_types": """
        SELECT DISTINCT order_id, payment_type FROM r_payments""",
    "grain_delivery": f"""
        SELECT order_id, {big('days')} AS delivery_days, {big('overdue')} AS late_days,
               CASE WHEN late THEN 1 ELSE 0 END::bigint AS is_late
        FROM arrivals WHERE late IS NOT NULL""",
    "grain_category_label": """
        SELECT product_id, p.raw_name AS raw_category, english AS english_category,
               coalesce(english, p.raw_name, 'unknown') AS category
        FROM r_products p LEFT JOIN r_names n ON n.raw_name = p.raw_name""",
    "grain_person_orders": f"""
        SELECT person, order_id, {YM.format('bought')} AS ym FROM bought_by""",
    "seller_ranking": f"""
        SELECT seller_id, {dbl('gmv')} AS gmv, place,
               {share('passed', 'whole', 4)} AS running_pct
        FROM (SELECT seller_id, gmv, row_number() OVER w AS place,
                     sum(gmv) OVER (w ROWS UNBOUNDED PRECEDING) AS passed,
                     sum(gmv) OVER () AS whole
              FROM (SELECT seller_id, sum(price) AS gmv FROM sold GROUP BY seller_id)
              WINDOW w AS (ORDER BY gmv DESC NULLS LAST, seller_id NULLS FIRST))""",
    "prod_top5_per_category": f"""
        SELECT category, product_id, orders, {dbl('gmv')} AS gmv
        FROM (SELECT coalesce(english, raw_name) AS category, product_id, sum(price) AS gmv,
                     count(DISTINCT order_id) AS orders,
                     row_number() OVER (
                         PARTITION BY coalesce(english, raw_name)
                         ORDER BY count(DISTINCT order_id) DESC, sum(price) DESC, product_id) AS place
              FROM sold_named GROUP BY english, raw_name, product_id) p
        WHERE place <= 5 ORDER BY p.gmv DESC, product_id LIMIT 100""",
}

LAYERS = {
    "csv_monthly_trend": BUSINESS["biz_monthly_trend"],
    "csv_review_records": f"""
        SELECT {big('stars')} AS review_score, count(*) AS records,
               {big('sum(length(message))')} AS message_chars,
               count(message) AS whole_messages
        FROM (SELECT stars, 'line one, "' || order_id || '"' || chr(10) || chr(10)
                  || 'line three "' || cast(stars AS bigint) || '"' AS message FROM r_reviews)
        GROUP BY stars""",
    "warehouse_monthly_trend": BUSINESS["biz_monthly_trend"],
    "warehouse_category_rank": PRODUCTS["prod_category_rank"],
    "warehouse_seller_concentration": SELLERS["seller_concentration"],
    "warehouse_category_score": REVIEWS["rev_category_score"],
    "warehouse_core_kpis": BUSINESS["biz_core_kpis"],
    "warehouse_metric_month": _sales_by("ym", where="ym = '1996-03'"),
    "layer_monthly_trend": BUSINESS["biz_monthly_trend"],
    "layer_core_kpis": BUSINESS["biz_core_kpis"],
    "layer_seller_tiers": SELLERS["seller_tiers"],
    "layer_seller_concentration": SELLERS["seller_concentration"],
    "layer_category_rank": PRODUCTS["prod_category_rank"],
    "layer_top_products": PRODUCTS["prod_top_per_category"],
    "layer_repeat_rate": CUSTOMERS["cust_repeat_rate"],
    "layer_frequency": CUSTOMERS["cust_frequency"],
    "layer_new_by_month": CUSTOMERS["cust_new_by_month"],
    "layer_cohort_retention": CUSTOMERS["cust_cohort_retention"],
    "layer_active_by_month": DERIVED["active_by_month"],
    "layer_metric_sales_by_month": METRICS["metric_sales_by_month"],
    "warehouse_reload_reviews_category_score": REVIEWS["rev_category_score"],
    "warehouse_reload_prices_core_kpis": BUSINESS["biz_core_kpis"],
    "warehouse_merge_core_kpis": BUSINESS["biz_core_kpis"],
    "warehouse_merge_payment_vs_score": REVIEWS["rev_payment_vs_score"],
    "layer_refresh_prices_monthly_trend": BUSINESS["biz_monthly_trend"],
    "layer_refresh_categories_rank": PRODUCTS["prod_category_rank"],
    "bucketed_core_kpis": BUSINESS["biz_core_kpis"],
    "bucketed_order_value": GRAINS["grain_order_value"],
    "bucketed_payment_vs_score": REVIEWS["rev_payment_vs_score"],
    "layer_monthly_service": f"""
        SELECT strftime(o.bought, '%Y-%m') AS ym, count(late) AS eligible,
               {share('count(*) FILTER (WHERE late)', 'count(late)')} AS late_pct,
               count(score) AS scored_orders, {mean('score')} AS avg_score
        FROM r_orders o LEFT JOIN arrivals a ON a.order_id = o.order_id
        LEFT JOIN stars_of s ON s.order_id = o.order_id
        WHERE o.order_status = 'delivered' GROUP BY ym""",
}

LAYERS["layer_refresh_reviews_monthly_service"] = LAYERS["layer_monthly_service"]
LAYERS |= {
    f"layer_{name}": METRICS[name]
    for name in (
        "metric_sales_by_state",
        "metric_sales_by_category",
        "metric_sales_by_seller_state_month",
        "metric_sales_filtered",
        "metric_service_by_state",
        "metric_service_by_category",
        "metric_all_by_seller_state",
    )
}
LAYERS |= {
    "layer_refresh_prices_metric_sales_by_category": METRICS["metric_sales_by_category"],
    "layer_refresh_reviews_metric_service_by_state": METRICS["metric_service_by_state"],
}

GROUPS = (
    QUALITY, CHECKS, BUSINESS, CUSTOMERS, PRODUCTS, SELLERS, LOGISTICS, REVIEWS,
    CLEANING, PROFILING, DERIVED, METRICS, PAGES, GRAINS, LAYERS,
)


CHANGED = {
    "warehouse_reload_monthly_trend": BUSINESS["biz_monthly_trend"],
    "warehouse_reload_category_score": REVIEWS["rev_category_score"],
    "warehouse_months_core_kpis": BUSINESS["biz_core_kpis"],
    "layer_refresh_monthly_trend": BUSINESS["biz_monthly_trend"],
    "layer_refresh_seller_tiers": SELLERS["seller_tiers"],
    "layer_refresh_monthly_service": LAYERS["layer_monthly_service"],
    "layer_refresh_cohort_retention": CUSTOMERS["cust_cohort_retention"],
    "layer_refresh_repeat_rate": CUSTOMERS["cust_repeat_rate"],
    "layer_refresh_partial_monthly_trend": BUSINESS["biz_monthly_trend"],
    "layer_refresh_partial_seller_tiers": SELLERS["seller_tiers"],
}

DIRTY = {
    "dq_orphan_orders_dirty": QUALITY["dq_orphan_orders"],
    "dq_price_anomalies_dirty": QUALITY["dq_price_anomalies"],
    "check_foreign_keys_dirty": CHECKS["check_foreign_keys"],
    "check_not_null_dirty": CHECKS["check_not_null"],
    "check_domains_dirty": CHECKS["check_domains"],
}


def all_statements() -> dict[str, str]:
    found = {name: with_roles(sql) for group in GROUPS for name, sql in group.items()}
    found |= {name: with_roles(sql, CHANGED_ROLES) for name, sql in CHANGED.items()}
    return found | {name: with_roles(sql, DIRTY_ROLES) for name, sql in DIRTY.items()}
