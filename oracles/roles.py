"""SQL views of the marketplace tables over the star-schema Parquet."""

from __future__ import annotations

import re

PRICE = "cast(cast(floor(l_extendedprice / 1000) AS bigint) + l_linenumber * 0.01 AS decimal(12,2))"

ROLES: dict[str, str] = {
    "r_customers": """
        SELECT o_orderkey AS customer_id, o_custkey AS customer_unique_id,
               cast(o_custkey % 100000 AS int) AS customer_zip_code_prefix,
               c_mktsegment AS customer_city, n_name AS customer_state
        FROM orders
        JOIN customer ON c_custkey = o_custkey
        JOIN nation ON n_nationkey = c_nationkey""",
    "r_orders": """
        SELECT o_orderkey AS order_id, o_orderkey AS customer_id,
               CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
                    ELSE 'canceled' END AS order_status,
               o_orderdate + to_hours(cast(o_orderkey % 24 AS int)) AS bought,
               CASE WHEN o_orderkey % 50 <> 0
                    THEN o_orderdate + to_hours(cast(o_orderkey % 24 + 1 AS int)) END AS approved,
               CASE WHEN o_orderkey % 40 <> 0 THEN o_orderdate + to_days(1) END AS carried,
               CASE WHEN o_orderstatus = 'F' AND o_orderkey % 97 <> 0
                    THEN o_orderdate + to_days(cast(1 + (o_orderkey * 7) % 30 AS int)) + to_hours(10)
               END AS arrived,
               o_orderdate + to_days(cast(8 + o_custkey % 20 AS int)) AS promised
        FROM orders""",
    "r_items": f"""
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
               l_suppkey AS seller_id, l_shipdate AS shipping_limit_date,
               {PRICE} AS price, cast(l_quantity AS decimal(12,2)) AS freight
        FROM lineitem""",
    "r_payments": f"""
        SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential,
               CASE l_returnflag WHEN 'A' THEN 'credit_card' WHEN 'N' THEN 'boleto'
                    ELSE 'voucher' END AS payment_type,
               l_linenumber AS payment_installments, {PRICE} AS payment_value
        FROM lineitem""",
    "r_reviews": """
        SELECT event_id AS review_id,
               event_id - CASE WHEN event_id % 10 = 9 THEN 1 ELSE 0 END AS order_id,
               CASE WHEN event_type <> 'error' THEN cast(1 + floor(value) % 5 AS int) END AS stars,
               event_type AS title, props AS message, ts AS created,
               ts + to_days(cast(event_id % 3 AS int)) AS answered
        FROM events""",
    "r_products": """
        SELECT p_partkey AS product_id, CASE WHEN p_size <> 1 THEN p_brand END AS raw_name,
               length(p_name) AS name_length, p_size AS weight
        FROM part""",
    "r_sellers": """
        SELECT s_suppkey AS seller_id, s_suppkey % 100000 AS zip, s_name AS city,
               n_name AS seller_state
        FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "r_names": """
        SELECT DISTINCT p_brand AS raw_name,
               'cat_' || cast(cast(substr(p_brand, 7) AS int) % 20 AS varchar) AS english
        FROM part WHERE p_brand <> 'Brand#25'""",
    # Relations most statements need.
    "sold": """
        SELECT i.*, o.customer_id, o.bought, o.arrived, o.promised
        FROM r_items i JOIN r_orders o ON o.order_id = i.order_id
        WHERE o.order_status = 'delivered'""",
    "bought_by": """
        SELECT o.order_id, o.bought, c.customer_unique_id AS person, c.customer_state AS state
        FROM r_orders o JOIN r_customers c ON c.customer_id = o.customer_id
        WHERE o.order_status = 'delivered'""",
    "sold_named": """
        SELECT s.*, p.raw_name, n.english
        FROM sold s JOIN r_products p ON p.product_id = s.product_id
        LEFT JOIN r_names n ON n.raw_name = p.raw_name""",
    "stars_of": """
        SELECT order_id, cast(avg(stars) AS decimal(14,4)) AS score
        FROM r_reviews GROUP BY order_id""",
    "arrivals": """
        SELECT order_id, customer_id, date_diff('day', cast(bought AS date), cast(arrived AS date)) AS days,
               date_diff('day', cast(promised AS date), cast(arrived AS date)) AS overdue,
               cast(arrived AS date) > cast(promised AS date) AS late,
               arrived > promised AS late_to_the_second
        FROM r_orders WHERE order_status = 'delivered' AND arrived IS NOT NULL""",
}


# Orders after a month has been emptied and some orders have moved to another month.
CHANGED_ROLES = ROLES | {
    "r_orders": f"""
        SELECT * REPLACE (CASE WHEN order_id % 10 = 4 THEN bought + to_days(45) ELSE bought END
            AS bought)
        FROM ({ROLES['r_orders']}) WHERE strftime(bought, '%Y-%m') <> '1995-01'""",
}

# Tables that break every rule the checks know.
DIRTY_ROLES = ROLES | {
    "r_customers": f"SELECT * FROM ({ROLES['r_customers']}) WHERE customer_id % 11 <> 5",
    "r_orders": f"""
        SELECT * REPLACE (CASE WHEN order_id % 23 <> 7 THEN customer_id END AS customer_id)
        FROM ({ROLES['r_orders']}) WHERE order_id % 29 <> 8""",
    "r_items": f"""
        SELECT * REPLACE (CASE WHEN order_id % 13 = 2 THEN -price ELSE price END AS price,
            CASE WHEN order_id % 19 <> 3 THEN order_item_id END AS order_item_id,
            CASE WHEN order_id % 17 = 1 THEN -1 ELSE freight END AS freight)
        FROM ({ROLES['r_items']})""",
    "r_payments": f"""
        SELECT * REPLACE (CASE WHEN order_id % 31 = 4 THEN -payment_value ELSE payment_value END
            AS payment_value)
        FROM ({ROLES['r_payments']})""",
    "r_reviews": f"""
        SELECT * REPLACE (CASE WHEN order_id % 7 = 6 THEN 9 ELSE stars END AS stars)
        FROM ({ROLES['r_reviews']})""",
}


def with_roles(statement: str, roles: dict[str, str] = ROLES) -> str:
    """Prefix a statement with the views it names, and those that they name in turn."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in roles.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                needed.append(name)

    visit(statement)
    views = ",\n".join(f"{name} AS ({roles[name]})" for name in needed)
    body = statement.strip()
    if not views:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
