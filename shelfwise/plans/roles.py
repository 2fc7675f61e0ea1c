"""Maps the given star-schema tables to the roles of a recommendation data set.

Every role is one SELECT in the common subset of Spark SQL and DuckDB SQL, so a registered query and
its SQL twin start from the same input.  The given tables are clean; the expressions below add blank
ids, stray decimals, bad numbers, cancelled invoices and so on by fixed rules, so that the cleaning
operators have something to clean.  ``{name}`` stands for another role or a given table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

ROLES: dict[str, str] = {
    # customers with their features and tenant
    "shoppers": """
        SELECT CAST(c_custkey AS STRING) AS customer_id, c_custkey, c_name, c_acctbal, c_mktsegment,
               CAST(c_nationkey AS DOUBLE) AS c_nationkey, r_name AS tenant_id
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    # an untidy export of the customers: padded ids, '.0' tails, blanks, dirty numbers, repeated rows
    "raw_customers": """
        SELECT c_custkey * 2 AS seq,
               CASE WHEN c_custkey % 37 = 0 THEN ' NaN ' WHEN c_custkey % 41 = 0 THEN CAST(NULL AS STRING)
                    WHEN c_custkey % 3 = 0 THEN ' ' || c_custkey || '.0' ELSE CAST(c_custkey AS STRING) END AS customerID,
               CASE WHEN c_custkey % 19 = 0 THEN ' ' ELSE CAST(c_acctbal AS STRING) END AS balance,
               CASE WHEN c_custkey % 23 = 0 THEN 'UNKNOWN' WHEN c_custkey % 29 = 0 THEN CAST(NULL AS STRING)
                    ELSE c_mktsegment END AS segment,
               CAST(c_nationkey AS STRING) AS nation
        FROM {customer}
        UNION ALL
        SELECT c_custkey * 2 + 1, CAST(c_custkey AS STRING), '0', 'REPEATED', '99'
        FROM {customer} WHERE c_mktsegment = 'BUILDING'""",
    # the catalogue: standard columns, specs and tags, with gaps
    "shelf": """
        SELECT CAST(p_partkey AS STRING) AS product_id, p_partkey, p_name AS product_name,
               CASE WHEN p_partkey % 43 = 0 THEN CAST(NULL AS STRING) ELSE p_type END AS category,
               CASE WHEN p_partkey % 10 = 3 THEN 'archived' WHEN p_partkey % 10 = 4 THEN ' Active ' ELSE 'active' END AS status,
               CASE WHEN p_partkey % 47 = 0 THEN CAST(NULL AS STRING) ELSE p_brand END AS brand,
               CASE WHEN p_partkey % 53 = 0 THEN CAST(NULL AS DOUBLE) WHEN p_partkey % 59 = 0 THEN 0.0
                    ELSE ROUND(p_retailprice * p_size / 10, 2) END AS price,
               CASE WHEN p_partkey % 7 = 0 THEN CAST(NULL AS STRING) WHEN p_partkey % 11 = 0 THEN 'n/a'
                    WHEN p_partkey % 13 = 0 THEN 'nan' WHEN p_partkey % 17 = 0 THEN '1e12' WHEN p_partkey % 19 = 0 THEN '1.0'
                    WHEN p_partkey % 5 = 0 THEN '0' ELSE '1' END AS in_stock,
               'a ' || p_name || ' made by ' || p_brand || ' for ' || lower(p_type) || ' use' AS description,
               CAST(NULL AS STRING) AS image_url, '/p/' || p_partkey AS product_url,
               '2024-01-01' AS created_at,
               CASE WHEN p_partkey % 6 = 0 THEN '2024-02-15' ELSE '2024-01-01' END AS updated_at,
               CASE WHEN p_partkey % 31 = 0 THEN CAST(NULL AS STRING)
                    ELSE 'size_cm=' || p_size || '; weight_g: ' || (p_partkey % 90) || 'g; bad; colour=red' ||
                         CASE WHEN p_partkey % 4 = 0 THEN '; ram_gb=' || (p_partkey % 16) ELSE '' END ||
                         CASE WHEN p_partkey % 8 = 0 THEN '; storage_gb=' || (p_partkey % 64) ELSE '' END END AS specs,
               CASE WHEN p_partkey % 5 = 0 THEN lower(p_brand) || ' sale' ELSE '' END AS tags
        FROM {part}""",
    # clean fact rows: one per order line
    "bought": """
        SELECT CAST(o_custkey AS STRING) AS customer_id, CAST(l_partkey AS STRING) AS product_id,
               l_quantity AS weight, o_orderdate AS ts, l_orderkey, l_linenumber
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # one row per bought (customer, product)
    "pairs": "SELECT DISTINCT customer_id, product_id FROM {bought}",
    # the same facts as an untidy transaction log
    "till": """
        SELECT l_orderkey * 10 + l_linenumber AS seq,
               CASE WHEN l_orderkey % 83 = 0 THEN 'INV' || l_orderkey
                    WHEN l_orderkey % 31 = 0 THEN ' c' || l_orderkey
                    WHEN l_orderkey % 37 = 0 THEN ' ' ELSE 'INV' || l_orderkey END AS InvoiceNo,
               CASE WHEN l_orderkey % 97 = 0 THEN '  ' WHEN o_custkey % 2 = 0 THEN o_custkey || '.0'
                    ELSE ' ' || o_custkey END AS CustomerID,
               CASE WHEN l_partkey % 89 = 0 THEN 'nan' WHEN l_orderkey % 61 = 0 THEN CAST(NULL AS STRING)
                    ELSE CAST(l_partkey AS STRING) END AS StockCode,
               CASE WHEN l_orderkey % 71 = 0 THEN 'none'
                    ELSE ' item ' || l_partkey || ' ' || l_returnflag || l_linestatus END AS Description,
               CASE WHEN (l_orderkey + l_linenumber) % 53 = 0 THEN 'n/a' ELSE CAST(l_quantity AS STRING) END AS Quantity,
               CASE WHEN l_orderkey % 59 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS InvoiceDate
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # tracking requests as they arrive
    "clicks": """
        SELECT event_id, 't' || (user_id % 5) AS tenant_id,
               CASE WHEN event_type = 'signup' THEN 'add_to_cart' ELSE event_type END AS event_type,
               CASE WHEN event_id % 73 = 0 THEN ' ' ELSE 's' || user_id || '_' || (event_id % 20) END AS session_id,
               CASE WHEN event_id % 3 = 0 THEN ' u' || user_id || ' ' WHEN event_id % 50 = 1 THEN 'null'
                    ELSE CAST(NULL AS STRING) END AS customer_id,
               CASE WHEN event_id % 61 = 0 THEN '' ELSE regexp_extract(props, '[0-9]+', 0) END AS product_id,
               CASE WHEN event_id % 43 = 0 THEN 'many' WHEN event_id % 47 = 0 THEN '-1' WHEN event_id % 4 = 0
                    THEN CAST(NULL AS STRING) ELSE CAST(event_id % 5 AS STRING) END AS quantity,
               ts,
               CASE event_id % 7 WHEN 0 THEN 'similar' WHEN 1 THEN 'recommendation' WHEN 2 THEN 'organic'
                    WHEN 3 THEN 'recommendation' WHEN 4 THEN 'similar' ELSE CAST(NULL AS STRING) END AS source,
               CASE WHEN event_id % 101 = 0 THEN 'not-hex' WHEN event_id % 2 = 0
                    THEN substr(md5(CAST(event_id % 700 AS STRING)), 1, 16) ELSE CAST(NULL AS STRING) END AS rec_id,
               CASE WHEN event_id % 29 = 0 THEN 'test' ELSE 'live' END AS request_source
        FROM {events}""",
    # telemetry: every tracking request, plus one recommendation record per view
    "signals": """
        SELECT 'event' AS type, tenant_id, ts, event_type, product_id, session_id, customer_id, source, rec_id,
               request_source, CAST(NULL AS STRING) AS kind, FALSE AS fallback, CAST(NULL AS STRING) AS shown,
               CAST(NULL AS STRING) AS target_product_id, event_id
        FROM {clicks}
        UNION ALL
        SELECT 'recommendation', tenant_id, ts, CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING),
               customer_id, CASE WHEN event_id % 17 = 0 THEN 'test' ELSE 'sdk' END, rec_id, request_source,
               CASE WHEN event_id % 4 = 0 THEN 'similar' WHEN event_id % 4 = 1 THEN CAST(NULL AS STRING)
                    ELSE 'recommendation' END,
               event_id % 6 = 0,
               event_id % 90 || ',' || (event_id % 33) || ',' || (event_id % 14 + 50) || ',,' || product_id,
               CASE WHEN event_id % 8 = 0 THEN product_id ELSE CAST(NULL AS STRING) END, event_id
        FROM {clicks} WHERE event_type = 'view'""",
    # a file of catalogue rows offered for upload, with errors
    "upload": """
        SELECT p_partkey + 2 AS row_num,
               CASE WHEN p_partkey % 101 = 0 THEN CAST(NULL AS STRING) WHEN p_partkey % 103 = 0 THEN ' none '
                    WHEN p_partkey % 50 = 7 THEN CAST(p_partkey - 1 AS STRING)
                    WHEN p_partkey % 9 = 0 THEN 'N' || p_partkey ELSE ' ' || p_partkey END AS product_id,
               CASE WHEN p_partkey % 107 = 0 THEN ' ' ELSE upper(p_name) END AS product_name,
               CASE WHEN p_partkey % 109 = 0 THEN CAST(NULL AS STRING) ELSE p_type END AS category,
               CASE WHEN p_partkey % 113 = 0 THEN 'free' WHEN p_partkey % 127 = 0 THEN '-5.00'
                    WHEN p_partkey % 6 = 0 THEN CAST(NULL AS STRING)
                    ELSE '$' || CAST(p_retailprice AS STRING) || ' USD' END AS price,
               CASE WHEN p_partkey % 15 = 0 THEN CAST(NULL AS STRING) WHEN p_partkey % 14 = 0 THEN 'x' ELSE '3' END AS in_stock
        FROM {part} WHERE p_size <= 40""",
    # per-customer yes/no columns from what was bought, in the shape of a subscription table
    "services": """
        SELECT CASE WHEN c_custkey % 37 = 0 THEN 'null' ELSE CAST(c_custkey AS STRING) END AS customerID,
               CASE WHEN n_urgent IS NULL THEN CAST(NULL AS STRING) WHEN n_urgent > 1 THEN 'Yes' ELSE 'No' END AS ExpressDelivery,
               CASE WHEN n_low > 2 THEN 'Yes' WHEN n_low > 0 THEN 'No' ELSE 'No internet service' END AS PhoneService,
               CASE WHEN n_high > 1 THEN 'Yes' ELSE 'No' END AS StreamingTV,
               CASE WHEN n_all % 3 = 0 THEN 'DSL' WHEN n_all % 3 = 1 THEN 'Fiber optic' ELSE 'No' END AS InternetService
        FROM {customer} LEFT JOIN (
            SELECT o_custkey, SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS n_urgent,
                   SUM(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS n_low,
                   SUM(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS n_high, COUNT(*) AS n_all
            FROM {orders} GROUP BY o_custkey) o ON c_custkey = o_custkey""",
    # ratings with '|'-joined genres
    "ratings": """
        SELECT o_custkey AS user_id, l_partkey AS movie_id, l_linenumber, l_orderkey, (l_quantity % 10) / 2.0 AS rating
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "movies": """
        SELECT p_partkey AS movie_id,
               CASE WHEN p_partkey % 20 = 0 THEN '(no genres listed)'
                    WHEN p_partkey % 3 = 0 THEN p_type ELSE p_type || '|' || p_brand END AS genres
        FROM {part}""",
    # one training job per order
    "jobs": """
        SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'queued' END AS status,
               o_orderdate AS updated_at FROM {orders}""",
    # one small tenant per customer with its training state
    "accounts": """
        SELECT 'acct' || c_custkey AS tenant_id,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'ready_to_train' WHEN 'AUTOMOBILE' THEN 'running' WHEN 'MACHINERY' THEN 'completed'
                    WHEN 'HOUSEHOLD' THEN 'queued' ELSE CAST(NULL AS STRING) END AS status,
               c_nationkey % 3 = 0 AS trained
        FROM {customer}""",
    # training state of every tenant (a region is one tenant)
    "tenants": """
        SELECT r_name AS tenant_id,
               CASE r_regionkey % 5 WHEN 0 THEN 'ready_to_train' WHEN 1 THEN 'completed' WHEN 2 THEN 'running'
                    WHEN 3 THEN 'queued' ELSE CAST(NULL AS STRING) END AS status,
               r_regionkey % 5 = 1 AS trained,
               r_regionkey
        FROM {region}""",
}

_NAME = re.compile(r"{(\w+)}")


def inputs(spark: SparkSession, sf_dir: str, *names: str, given: dict[str, DataFrame] | None = None) -> list[DataFrame]:
    """The named roles or given tables as DataFrames; ``given`` replaces tables (by streams, say)."""
    found: dict[str, DataFrame] = dict(given or {})

    def get(name: str) -> DataFrame:
        if name not in found:
            if name in TABLES:
                found[name] = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
            else:
                text = ROLES[name]
                found[name] = spark.sql(text, **{n: get(n) for n in set(_NAME.findall(text))})
        return found[name]

    return [get(n) for n in names]


def one(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return inputs(spark, sf_dir, name)[0]


def twin(body: str, *roles: str) -> str:
    """SQL text for DuckDB: the needed roles as common table expressions in front of ``body``."""
    order: list[str] = []

    def visit(name: str):
        if name in TABLES or name in order:
            return
        for dep in _NAME.findall(ROLES[name]):
            visit(dep)
        order.append(name)

    for r in roles:
        visit(r)
    ctes = [f"{n} AS ({_NAME.sub(lambda m: m.group(1), ROLES[n]).strip()})" for n in order]
    body = body.strip()
    if not ctes:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body[:len(head)].upper() == head:
            return head + ",\n".join(ctes) + ",\n" + body[len(head):]
    return "WITH " + ",\n".join(ctes) + "\n" + body
