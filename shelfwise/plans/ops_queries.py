"""Telemetry, profiling, tenant operations, sinks, rate limits and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shelfwise.operators import identity, keyed, limiter, ops, profile, telemetry as tel
from shelfwise.plans import sqltext as q
from shelfwise.plans.core_queries import COUNTS, EFFECTIVE, MAPPING, active, tenant_counts_frame
from shelfwise.plans.registry import query
from shelfwise.plans.roles import inputs, one
from shelfwise.session import durable_path
from shelfwise.sources import tables
from shelfwise.streaming import jobs

TODAY, DAYS = dt.date(2024, 1, 30), 7
LIVE = "source IS DISTINCT FROM 'test' AND request_source IS DISTINCT FROM 'test'"
WINDOW = f"{LIVE} AND CAST(ts AS DATE) BETWEEN DATE '2024-01-24' AND DATE '2024-01-30'"
REC = f"type = 'recommendation' AND coalesce(kind, 'recommendation') <> 'similar' AND {WINDOW}"


def signals(spark, sf):
    return one(spark, sf, "signals").withColumn("recommended_products", F.split("shown", ","))


# ---- telemetry --------------------------------------------------------------------------------

@query("events_by_day", "signals", sql=f"""
    WITH d AS (SELECT tenant_id, CAST(d AS DATE) AS date FROM (SELECT DISTINCT tenant_id FROM signals) CROSS JOIN generate_series(DATE '2024-01-24', DATE '2024-01-30', INTERVAL 1 DAY) g(d)),
    e AS (SELECT tenant_id, CAST(ts AS DATE) AS date, event_type FROM signals WHERE type = 'event' AND {WINDOW})
    SELECT d.tenant_id, CAST(d.date AS VARCHAR) AS date, strftime(d.date, '%a') AS label, {', '.join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in tel.SHOWN_TYPES)}, count(event_type) AS total
    FROM d LEFT JOIN e ON e.tenant_id = d.tenant_id AND e.date = d.date GROUP BY 1, 2, 3""")
def events_by_day(spark, sf):
    return tel.events_by_day(signals(spark, sf), TODAY, DAYS)


@query("fn_day_label", "events", sql="""
    SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS date, strftime(CAST(d AS DATE), '%a') AS label FROM (
        SELECT unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)) + 3, INTERVAL 1 DAY)) AS d FROM events)""")
def fn_day_label(spark, sf):
    span = one(spark, sf, "events").agg(F.min(tel.day()).alias("a"), F.date_add(F.max(tel.day()), 3).alias("b"))
    return tel.calendar(span, F.col("a"), F.col("b")).select(F.col("date").cast("string").alias("date"), "label")


@query("recommendation_totals", "signals", sql=f"""
    SELECT tenant_id, count(*) AS total, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-30') AS today, count(*) FILTER (fallback) AS fallbacks,
        round(count(*) FILTER (fallback) / count(*), 4) AS fallback_rate FROM signals WHERE {REC} GROUP BY 1""")
def recommendation_totals(spark, sf):
    return tel.recommendation_totals(signals(spark, sf), TODAY, DAYS)


@query("top_recommended_products", "signals", "shelf", sql=f"""
    WITH s AS (SELECT tenant_id, unnest(string_split(shown, ',')) AS product_id FROM signals WHERE {REC}), a AS {q.ACTIVE_SHELF},
    c AS (SELECT tenant_id, product_id, count(*) AS n FROM s JOIN a USING (product_id) GROUP BY 1, 2)
    SELECT tenant_id, product_id, n, row_number() OVER (PARTITION BY tenant_id ORDER BY n DESC, product_id) AS rank, product_name FROM c JOIN a USING (product_id) QUALIFY rank <= 5""")
def top_recommended_products(spark, sf):
    return tel.top_recommended(signals(spark, sf), active(spark, sf), TODAY, DAYS)


@query("top_similar_sources", "signals", "shelf", sql=f"""
    WITH s AS (SELECT tenant_id, coalesce(nullif(target_product_id, ''), nullif(customer_id, '')) AS product_id FROM signals WHERE type = 'recommendation' AND kind = 'similar' AND {WINDOW}),
    c AS (SELECT tenant_id, product_id, count(*) AS n FROM s WHERE product_id IS NOT NULL GROUP BY 1, 2)
    SELECT tenant_id, c.product_id, n, row_number() OVER (PARTITION BY tenant_id ORDER BY n DESC, c.product_id) AS rank, coalesce(product_name, c.product_id) AS product_name
    FROM c LEFT JOIN shelf USING (product_id) QUALIFY rank <= 5""")
def top_similar_sources(spark, sf):
    return tel.top_similar_sources(signals(spark, sf), one(spark, sf, "shelf"), TODAY, DAYS)


@query("ctr_by_source", "signals", sql=f"""
    WITH w AS (SELECT * FROM signals WHERE {WINDOW}), s AS (SELECT DISTINCT tenant_id, x AS source FROM w CROSS JOIN (VALUES ('similar'), ('recommendation')) v(x)),
    r AS (SELECT tenant_id, CASE WHEN kind = 'similar' THEN 'similar' ELSE 'recommendation' END AS source, count(*) AS requests FROM w WHERE type = 'recommendation' GROUP BY 1, 2),
    c AS (SELECT tenant_id, source, count(DISTINCT rec_id) AS clicked FROM w WHERE type = 'event' AND event_type = 'click' AND source IN ('similar', 'recommendation') GROUP BY 1, 2)
    SELECT tenant_id, source, coalesce(requests, 0) AS requests, coalesce(clicked, 0) AS clicked, CASE WHEN requests > 0 THEN round(least(1.0, coalesce(clicked, 0) / requests), 4) END AS ctr
    FROM s LEFT JOIN r USING (tenant_id, source) LEFT JOIN c USING (tenant_id, source)""")
def ctr_by_source(spark, sf):
    return tel.ctr_by_source(signals(spark, sf), TODAY, DAYS)


@query("funnel_by_source", "signals", sql=f"""
    SELECT tenant_id, source, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'add_to_cart') AS add_to_carts, count(*) FILTER (event_type = 'purchase') AS purchases
    FROM signals WHERE type = 'event' AND source IN ('similar', 'recommendation') AND {WINDOW} GROUP BY 1, 2""")
def funnel_by_source(spark, sf):
    return tel.funnel_by_source(signals(spark, sf), TODAY, DAYS)


@query("recent_events_enriched", "signals", "shelf", sql="""
    SELECT tenant_id, rank, event_id, event_type, product_id, coalesce(product_name, product_id) AS product_name,
        CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 172800 THEN 'Yesterday' ELSE strftime(ts, '%b %d') END AS ago
    FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY ts DESC, event_id DESC) AS rank, greatest(0, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) // 1000000) AS s
          FROM signals WHERE type = 'event' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-29' AND DATE '2024-01-31') LEFT JOIN (SELECT product_id, product_name FROM shelf) USING (product_id) WHERE rank <= 20""")
def recent_events_enriched(spark, sf):
    return tel.recent_events(signals(spark, sf), one(spark, sf, "shelf"), dt.datetime(2024, 1, 31))


@query("telemetry_retention", "signals", sql="""
    SELECT tenant_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, count(*) AS n FROM signals WHERE CAST(ts AS DATE) < DATE '2024-02-15' - 30 GROUP BY 1, 2""")
def telemetry_retention(spark, sf):
    days = tables.with_day(one(spark, sf, "signals")).groupBy("tenant_id", "dt").agg(F.count("*").alias("n"))
    return tel.expired(days, dt.date(2024, 2, 15)).withColumn("dt", F.col("dt").cast("string"))


# ---- sinks ------------------------------------------------------------------------------------

@query("sink_tenant_tables", "shoppers", "bought", sql="""
    WITH f AS (SELECT tenant_id, product_id FROM bought JOIN shoppers USING (customer_id))
    SELECT tenant_id, 'customers' AS table_name, count(*) AS n FROM shoppers GROUP BY 1 UNION ALL SELECT tenant_id, 'interactions', count(*) FROM f GROUP BY 1
    UNION ALL SELECT tenant_id, 'products', count(DISTINCT product_id) FROM f GROUP BY 1""")
def sink_tenant_tables(spark, sf):
    shoppers, bought = inputs(spark, sf, "shoppers", "bought")
    facts = bought.join(shoppers.select("customer_id", "tenant_id"), "customer_id")
    path = durable_path(spark, "tenants")
    tables.write_tenant_tables(path, {"customers": shoppers, "interactions": facts, "products": facts.select("tenant_id", "product_id").distinct()})
    return tables.written_counts(spark, path, ["customers", "interactions", "products"])


@query("sink_telemetry_partitioned", "signals", sql="SELECT tenant_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, count(*) AS n FROM signals GROUP BY 1, 2")
def sink_telemetry_partitioned(spark, sf):
    path = durable_path(spark, "telemetry")
    tables.write_telemetry(one(spark, sf, "signals"), path)
    return tables.read_telemetry(spark, path).groupBy("tenant_id", F.col("dt").cast("string").alias("dt")).agg(F.count("*").alias("n"))


@query("scan_date_range", "signals", sql="""
    SELECT type, count(*) AS n FROM signals WHERE tenant_id = 't3' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-24' AND DATE '2024-01-30' GROUP BY 1""")
def scan_date_range(spark, sf):
    path = durable_path(spark, "telemetry")
    tables.write_telemetry(one(spark, sf, "signals"), path)
    return tables.read_telemetry(spark, path, "t3", *tel.window_of(TODAY, DAYS)).groupBy("type").agg(F.count("*").alias("n"))


# ---- profiling --------------------------------------------------------------------------------

PROFILED = {
    "till": ("seq", "InvoiceNo", "CustomerID", "StockCode", "Description", "Quantity", "InvoiceDate"),
    "raw_customers": ("seq", "customerID", "balance", "segment", "nation"),
    "services": ("customerID", "ExpressDelivery", "PhoneService", "StreamingTV", "InternetService"),
}
TYPED = {"seq"}
ROLES_OF = tuple(PROFILED)


def words(names):
    return "'" + "|".join(names) + "'"


STATS = "(" + " UNION ALL ".join(f"""SELECT '{t}' AS table_name, {i} AS position, '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count,
    {'count(' + c + ')' if c in TYPED else f'count(try_cast({c} AS DOUBLE)) FILTER (NOT isnan(try_cast({c} AS DOUBLE)))'} AS parsed, count({c}) AS present,
    coalesce(bool_or(lower(trim(CAST({c} AS VARCHAR))) IN ({', '.join(repr(x) for x in profile.BINARY_TOKENS)})), FALSE) AS has_binary FROM {t}"""
                              for t, cols in PROFILED.items() for i, c in enumerate(cols)) + ")"
RATES = f"(SELECT *, CASE WHEN present > 0 THEN parsed / present ELSE 0 END AS parse_rate, unique_count / total_rows AS uniqueness, null_count / total_rows * 100 AS null_percentage FROM {STATS})"
DTYPES = f"""(SELECT *, CASE WHEN present = 0 THEN 'categorical' WHEN parse_rate > 0.95 THEN 'numeric' WHEN unique_count <= 50 THEN 'categorical' ELSE 'likely_free_text_or_id' END AS suggested_dtype,
    uniqueness > 0.98 AND regexp_matches(lower(column_name), {words(profile.ID_HINTS)}) AS is_id_column, unique_count IN (2, 3) AND has_binary AS is_binary_service FROM {RATES})"""


def all_profiles(spark, sf):
    out = None
    for t in PROFILED:
        rows = profile.profile(one(spark, sf, t)).withColumn("table_name", F.lit(t))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("profile_columns", *ROLES_OF, sql=f"""
    SELECT table_name, column_name, total_rows, null_count, round(null_percentage, 4) AS null_percentage, unique_count, round(parse_rate, 6) AS parse_rate, round(uniqueness, 6) AS uniqueness FROM {RATES}""")
def profile_columns(spark, sf):
    return all_profiles(spark, sf).select("table_name", "column_name", "total_rows", "null_count", F.round("null_percentage", 4).alias("null_percentage"),
                                          "unique_count", F.round("parse_rate", 6).alias("parse_rate"), F.round("uniqueness", 6).alias("uniqueness"))


@query("profile_dtype", *ROLES_OF, sql=f"SELECT table_name, column_name, suggested_dtype FROM {DTYPES}")
def profile_dtype(spark, sf):
    return all_profiles(spark, sf).select("table_name", "column_name", "suggested_dtype")


@query("profile_distinct_values", "raw_customers", sql="""
    SELECT DISTINCT 'segment' AS column_name, segment AS value FROM raw_customers WHERE segment IS NOT NULL""")
def profile_distinct_values(spark, sf):
    return profile.distinct_values(one(spark, sf, "raw_customers"))


@query("profile_flags", *ROLES_OF, sql=f"SELECT table_name, column_name, is_id_column, is_binary_service FROM {DTYPES}")
def profile_flags(spark, sf):
    return all_profiles(spark, sf).select("table_name", "column_name", "is_id_column", "is_binary_service")


SCORED = f"""(SELECT *, CASE WHEN present = 0 THEN 0.0 WHEN suggested_dtype = 'numeric' AND unique_count BETWEEN 2 AND 4 THEN 0.5 WHEN suggested_dtype = 'numeric' AND parse_rate < 0.98 THEN 0.55
    WHEN suggested_dtype = 'numeric' AND regexp_matches(lower(column_name), {words(profile.NUMERIC_HINTS + profile.DATE_HINTS)}) THEN 0.95 WHEN suggested_dtype = 'numeric' THEN 0.8
    WHEN is_id_column THEN 0.95 WHEN uniqueness > 0.95 AND NOT regexp_matches(lower(column_name), {words(profile.ID_HINTS)}) THEN 0.5 WHEN suggested_dtype = 'categorical' AND is_binary_service THEN 0.95
    WHEN suggested_dtype = 'categorical' AND regexp_matches(lower(column_name), {words(profile.CATEGORY_HINTS)}) THEN 0.9 WHEN suggested_dtype = 'categorical' THEN 0.8 ELSE 0.75 END AS confidence FROM {DTYPES})"""


@query("profile_confidence", *ROLES_OF, sql=f"""
    SELECT table_name, column_name, CAST(confidence AS DOUBLE) AS confidence, confidence < 0.78 AS needs_review, CASE WHEN confidence >= 0.78 THEN NULL
        WHEN present = 0 THEN 'Column contains only null values — unable to reliably infer data type.'
        WHEN suggested_dtype = 'numeric' AND unique_count BETWEEN 2 AND 4 THEN 'Only ' || unique_count || ' distinct numeric values found — this might be a category coded as numbers, not a true numeric feature.'
        WHEN suggested_dtype = 'numeric' AND parse_rate < 0.98 THEN printf('%.1f', (1 - parse_rate) * 100) || '% of non-null values failed numeric parsing — verify if column is truly numeric or dirty categorical data.'
        WHEN suggested_dtype <> 'numeric' AND NOT is_id_column AND uniqueness > 0.95 AND NOT regexp_matches(lower(column_name), {words(profile.ID_HINTS)}) THEN 'High uniqueness (' || printf('%.1f', uniqueness * 100) || '%) but column name lacks clear ID naming hints — could be a primary key or high-cardinality categorical feature.'
        ELSE 'Confidence score (' || printf('%.2f', confidence) || ') is below threshold (0.78) — data supports inference but column name lacks specific pattern hints.' END AS review_reason FROM {SCORED}""")
def profile_confidence(spark, sf):
    out = None
    for t in PROFILED:
        rows = profile.profile(one(spark, sf, t), 0.78).withColumn("table_name", F.lit(t))
        out = rows if out is None else out.unionByName(rows)
    return out.select("table_name", "column_name", "confidence", "needs_review", "review_reason")


def first_at(names, extra="position <> id0 AND null_percentage < 99"):
    return f"min(position) FILTER (regexp_matches(lower(column_name), {words(names)}) AND {extra}) OVER (PARTITION BY table_name)"


@query("column_roles", *ROLES_OF, sql=f"""
    WITH p AS MATERIALIZED (SELECT * FROM {DTYPES}),
    i AS (SELECT table_name, coalesce(min(position) FILTER (is_id_column), min(position) FILTER (contains(lower(column_name), 'id') AND unique_count > 1), arg_max(position, (unique_count, -position))) AS id0 FROM p GROUP BY 1),
    c AS (SELECT *, {first_at(profile.PRODUCT_WORDS)} AS prod, {first_at(profile.INVOICE_WORDS)} AS inv, {first_at(profile.NAME_WORDS)} AS nm, {first_at(profile.QUANTITY_WORDS)} AS qty,
          {first_at(profile.CUSTOMER_WORDS, 'null_percentage < 99')} AS cust, count(*) FILTER (is_binary_service AND position <> id0) OVER (PARTITION BY table_name) AS services FROM p JOIN i USING (table_name)),
    l AS (SELECT *, prod IS NOT NULL AND (inv IS NOT NULL OR qty IS NOT NULL OR services = 0) AS sales FROM c),
    f AS (SELECT *, CASE WHEN sales THEN coalesce(cust, id0) ELSE id0 END AS id1, CASE WHEN sales AND cust <> id0 THEN coalesce(inv, id0) ELSE inv END AS inv1 FROM l)
    SELECT table_name, column_name, CASE WHEN sales THEN 'transactional' ELSE 'services' END AS layout, CASE WHEN position = id1 THEN 'customer_id' WHEN NOT sales THEN CASE WHEN is_binary_service THEN 'service' ELSE 'feature' END
        WHEN position = prod THEN 'product_id' WHEN position = nm THEN 'description' WHEN position = inv1 THEN 'invoice' WHEN position = qty THEN 'quantity'
        WHEN regexp_matches(lower(column_name), {words(profile.EXCLUDED_WORDS)}) OR null_percentage >= 99 THEN 'excluded' ELSE 'feature' END AS role FROM f""")
def column_roles(spark, sf):
    return profile.column_roles(all_profiles(spark, sf)).drop("position")


# ---- tenant operations ------------------------------------------------------------------------

@query("discover_tenants", "shoppers", "clicks", "accounts", sql="""
    SELECT DISTINCT tenant_id FROM (SELECT tenant_id FROM shoppers UNION ALL SELECT tenant_id FROM clicks UNION ALL SELECT tenant_id FROM accounts UNION ALL SELECT trim(session_id) FROM clicks) WHERE trim(tenant_id) <> ''""")
def discover_tenants(spark, sf):
    shoppers, clicks, accounts = inputs(spark, sf, "shoppers", "clicks", "accounts")
    return ops.discover_tenants(shoppers, clicks, accounts, clicks.select(F.col("session_id").alias("tenant_id")))


@query("training_readiness", "shoppers", "bought", "clicks", "tenants", sql=f"""
    WITH s AS (SELECT * FROM tenants WHERE NOT trained), c AS {COUNTS},
    o AS (SELECT * FROM (VALUES ('ASIA', 50, 1000000000), ('EUROPE', 1, NULL)) v(tenant_id, a, b)),
    x AS (SELECT s.tenant_id, coalesce(customers, 0) AS customers, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a ELSE 50 END AS min_customers, coalesce(interactions, 0) AS interactions,
        CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b ELSE 200 END AS min_interactions, status AS current_status FROM s LEFT JOIN c USING (tenant_id) LEFT JOIN o USING (tenant_id))
    SELECT tenant_id, customers, min_customers, interactions, min_interactions, customers >= min_customers AND interactions >= min_interactions AS is_ready, current_status,
        CASE WHEN NOT (customers >= min_customers AND interactions >= min_interactions) THEN 'below_threshold' WHEN current_status IN ('ready_to_train', 'ready-to-train') THEN 'already_marked' ELSE 'marked_ready_to_train' END AS action FROM x""")
def training_readiness(spark, sf):
    overrides = spark.createDataFrame([("ASIA", 50, 1_000_000_000), ("EUROPE", 1, None)], "tenant_id string, min_customers int, min_interactions int")
    return ops.readiness(one(spark, sf, "tenants"), tenant_counts_frame(spark, sf), overrides)


@query("retrain_plan", "accounts", sql="""
    SELECT tenant_id, CASE WHEN status IN ('queued', 'running') THEN 'in_progress' WHEN trained THEN 'already_trained' WHEN status = 'ready_to_train' THEN 'new_ready' ELSE 'below_threshold' END AS tenant_type,
        CASE WHEN status IN ('queued', 'running') THEN 'skipped' WHEN trained THEN 'retrain' WHEN status = 'ready_to_train' THEN 'first_training' ELSE 'skipped' END AS action,
        CASE WHEN status IN ('queued', 'running') OR (NOT trained AND status IS DISTINCT FROM 'ready_to_train') THEN 'skipped' ELSE 'queued' END AS status FROM accounts""")
def retrain_plan(spark, sf):
    return ops.retrain_plan(one(spark, sf, "accounts"))


@query("stalled_jobs", "jobs", sql="""
    SELECT job_id, CASE WHEN status IN ('queued', 'running') AND epoch_us(TIMESTAMP '1998-06-15 00:15:00') - epoch_us(updated_at) > 900000000 THEN 'stalled' ELSE status END AS status FROM jobs""")
def stalled_jobs(spark, sf):
    now = F.lit("1998-06-15 00:15:00").cast("timestamp_ntz")
    return one(spark, sf, "jobs").select("job_id", ops.effective_status(F.col("status"), F.col("updated_at"), now).alias("status"))


# the scope of a tracking request, and limits of some tenants and scopes; the others have the default of their scope
SCOPE = "CASE event_type WHEN 'view' THEN 'recommendations' WHEN 'click' THEN 'catalog' WHEN 'purchase' THEN 'onboarding' ELSE 'tracking' END"
OWN_LIMITS = [("t0", "recommendations", 3), ("t0", None, 6), ("t1", None, 4), ("t2", "tracking", 0), ("t2", "catalog", 9)]
LIMITED = f"""(SELECT c.*, coalesce(o.n, a.n, CASE scope {" ".join(f"WHEN '{k}' THEN {v}" for k, v in limiter.LIMITS.items())} ELSE {limiter.OTHER_LIMIT} END) AS lim
    FROM (SELECT *, {SCOPE} AS scope FROM clicks) c
    LEFT JOIN (VALUES {", ".join(f"('{t}', '{x}', {n})" for t, x, n in OWN_LIMITS if x)}) o(t, x, n) ON tenant_id = o.t AND scope = o.x
    LEFT JOIN (VALUES {", ".join(f"('{t}', {n})" for t, x, n in OWN_LIMITS if not x)}) a(t, n) ON tenant_id = a.t)"""


def limited(spark, sf):
    own = spark.createDataFrame(OWN_LIMITS, "tenant_id string, scope string, limit_per_minute int")
    return limiter.with_limits(one(spark, sf, "clicks").withColumn("scope", F.expr(SCOPE)), own)


@query("rate_limit_sliding", "clicks", sql=f"""
    WITH RECURSIVE asked AS (SELECT event_id, tenant_id, scope, lim, epoch_us(ts) AS us, row_number() OVER (PARTITION BY tenant_id, scope ORDER BY ts, event_id) AS i FROM {LIMITED}),
    fold AS (SELECT DISTINCT tenant_id, scope, 0::BIGINT AS i, NULL::BIGINT AS event_id, []::BIGINT[] AS times, FALSE AS allowed, 0::BIGINT AS remaining, 0::BIGINT AS retry_after FROM asked
        UNION ALL
        SELECT tenant_id, scope, i, event_id, CASE WHEN len(kept) < lim THEN list_append(kept, us) ELSE kept END, len(kept) < lim,
            CASE WHEN len(kept) < lim THEN lim - len(kept) - 1 ELSE 0 END,
            CASE WHEN len(kept) < lim THEN 0 WHEN len(kept) = 0 THEN 21600 ELSE greatest(1, CAST(ceil((kept[1] + 21600000000 - us) / 1000000) AS BIGINT)) END
        FROM (SELECT r.*, list_filter(f.times, lambda x: x > r.us - 21600000000) AS kept FROM fold f JOIN asked r ON r.tenant_id = f.tenant_id AND r.scope = f.scope AND r.i = f.i + 1))
    SELECT tenant_id, scope, event_id, allowed, CAST(remaining AS INTEGER) AS remaining, CAST(retry_after AS INTEGER) AS retry_after FROM fold WHERE i > 0""")
def rate_limit_sliding(spark, sf):
    """Every request under the limit of its tenant and scope; the window is six hours, as the test events are sparse."""
    return limiter.limit_requests(limited(spark, sf), ["tenant_id", "scope"], "ts", "event_id", F.col("limit_per_minute"), 6 * 3600)


@query("request_rate_limits", "clicks", sql=f"""
    SELECT event_id, tenant_id, scope, lim AS limit_per_minute, in_window, in_window > lim AS over_limit FROM (
        SELECT *, count(*) OVER (PARTITION BY tenant_id, scope ORDER BY ts RANGE BETWEEN INTERVAL 21599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS in_window FROM {LIMITED})""")
def request_rate_limits(spark, sf):
    """Requests of the trailing window next to the limit of their tenant and scope."""
    seen = keyed.trailing_count(limited(spark, sf), ["tenant_id", "scope"], "ts", 6 * 3600, "in_window")
    return seen.select("event_id", "tenant_id", "scope", "limit_per_minute", "in_window", (F.col("in_window") > F.col("limit_per_minute")).alias("over_limit"))


@query("custom_adapter", "shoppers", "bought", "part", sql="""
    SELECT 'customers' AS table_name, count(*) AS n FROM shoppers UNION ALL SELECT 'products', count(*) FROM part
    UNION ALL SELECT 'interactions', count(*) FROM (SELECT DISTINCT customer_id, product_id FROM bought)""")
def custom_adapter(spark, sf):
    from shelfwise.plans.adapters import StarSchemaAdapter

    return StarSchemaAdapter(spark, sf).run().counts()


@query("run_adapter", "raw_customers", "till", sql=f"""
    SELECT 'customers' AS table_name, count(DISTINCT {q.clean_id('customerID')}) AS n FROM raw_customers WHERE {q.has_id('customerID')}
    UNION ALL SELECT 'products', count(DISTINCT {q.clean_id('StockCode')}) FROM till WHERE {q.has_id('StockCode')}
    UNION ALL SELECT 'interactions', count(*) FROM {q.SALES}""")
def run_adapter(spark, sf):
    from shelfwise.config import Tenant
    from shelfwise.plans.adapters import DeclaredAdapter
    from shelfwise.plans.ingest_queries import FEATURES, TILL

    customers, till = inputs(spark, sf, "raw_customers", "till")
    tenant = Tenant("demo", "customerID", FEATURES, transactions=TILL)
    return DeclaredAdapter(tenant, till, customers, order=[F.col("seq")]).run().counts()


# ---- streams ----------------------------------------------------------------------------------

def click_stream(spark, sf):
    """The tracking requests as a stream over the events file."""
    schema = one(spark, sf, "events").schema
    stream = jobs.file_stream(spark, sf, schema, "events.parquet")
    return inputs(spark, sf, "clicks", given={"events": stream})[0].withColumn("ts", F.col("ts").cast("timestamp"))


WEIGHT = """(CASE event_type WHEN 'add_to_cart' THEN 2.0 WHEN 'purchase' THEN 5.0 ELSE 1.0 END)
    * CASE WHEN try_cast(quantity AS DOUBLE) > 0 THEN try_cast(quantity AS DOUBLE) ELSE 1 END"""


@query("stream_events_to_interactions", "clicks", sql=f"""
    SELECT event_id, {EFFECTIVE.replace('mapped', 'NULL')} AS customer_id, trim(product_id) AS product_id, event_type, {WEIGHT} AS weight FROM clicks c
    WHERE {q.has_id('product_id')} AND ({q.has_id('customer_id')} OR {q.has_id('session_id')})""")
def stream_events_to_interactions(spark, sf):
    path = jobs.new_path(spark, "interactions")
    jobs.finished(jobs.append_to(jobs.interactions(click_stream(spark, sf)), path))
    return spark.read.parquet(path).select("event_id", "customer_id", "product_id", "event_type", "weight")


@query("stream_dead_letter", "clicks", sql=f"""
    SELECT event_id, CASE WHEN NOT {q.has_id('customer_id')} AND NOT {q.has_id('session_id')} THEN 'no_identity' ELSE 'no_product' END AS reject_reason FROM clicks
    WHERE NOT {q.has_id('product_id')} OR (NOT {q.has_id('customer_id')} AND NOT {q.has_id('session_id')})""")
def stream_dead_letter(spark, sf):
    path = jobs.new_path(spark, "letters")
    jobs.finished(jobs.split_events(click_stream(spark, sf), path))
    return spark.read.parquet(path).where("outcome = 'rejected'").select("event_id", "reject_reason")


@query("stream_identity_transitions", "clicks", sql=f"SELECT session_id, mapped FROM {MAPPING}")
def stream_identity_transitions(spark, sf):
    path = jobs.new_path(spark, "links")
    jobs.finished(jobs.identity_transitions(click_stream(spark, sf), path))
    links = spark.read.parquet(path)
    return links.groupBy("session_id").agg(F.max_by("mapped", F.struct("ts", "event_id")).alias("mapped"))


@query("stream_identity_merge", "clicks", sql=f"""
    SELECT event_id, {EFFECTIVE} AS customer_id, trim(product_id) AS product_id, {WEIGHT} AS weight FROM clicks c LEFT JOIN {MAPPING} m ON trim(c.session_id) = m.session_id
    WHERE {q.has_id('product_id')} AND {EFFECTIVE} IS NOT NULL""")
def stream_identity_merge(spark, sf):
    """Raw events are stored as they come; earlier anonymous rows follow a later link when read."""
    path = jobs.new_path(spark, "raw")
    jobs.finished(jobs.append_to(click_stream(spark, sf), path))
    stored = spark.read.parquet(path)
    return identity.event_interactions(stored, identity.identity_map(stored)).select("event_id", "customer_id", "product_id", "weight")


def deliveries(spark, sf):
    """The tracking requests in micro-batches of a file: every fifth event comes last however old it is, every tenth comes again with it."""
    clicks = one(spark, sf, "clicks").withColumn("ts", F.col("ts").cast("timestamp"))
    late = F.col("event_id") % 5 == 0
    path = jobs.new_path(spark, "deliveries")
    half = clicks.where(~late & (F.col("event_id") % 2 == 0))
    for part in (half, clicks.where(~late & (F.col("event_id") % 2 == 1)), clicks.where(late).unionByName(clicks.where("event_id % 10 IN (0, 1)"))):
        part.write.mode("append").parquet(path)
    return spark.readStream.schema(clicks.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("stream_dedupe", "clicks", sql="SELECT event_id, event_type, count(*) AS n FROM clicks GROUP BY 1, 2")
def stream_dedupe(spark, sf):
    """Late events are kept, events that are delivered again, days later or in the same batch, are not."""
    path = jobs.new_path(spark, "deduped")
    jobs.finished(jobs.append_once(deliveries(spark, sf), path))
    return spark.read.parquet(path).groupBy("event_id", "event_type").agg(F.count("*").alias("n"))


@query("stream_daily_counts", "clicks", sql="""
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_type, count(*) + count(*) FILTER (event_id % 10 IN (0, 1)) AS n FROM clicks GROUP BY 1, 2""")
def stream_daily_counts(spark, sf):
    """Counts of all deliveries, late ones included."""
    path = jobs.new_path(spark, "daily")
    jobs.finished(jobs.keep_updates(jobs.daily_counts(deliveries(spark, sf)), path))
    return jobs.latest_updates(spark, path, ["date", "event_type"]).withColumn("date", F.col("date").cast("string"))


@query("stream_popularity", "clicks", sql="SELECT trim(product_id) AS product_id, count(*) AS n FROM clicks WHERE trim(product_id) <> '' GROUP BY 1")
def stream_popularity(spark, sf):
    path = jobs.new_path(spark, "popularity")
    jobs.finished(jobs.keep_updates(jobs.running_popularity(click_stream(spark, sf)), path))
    return jobs.latest_updates(spark, path, ["product_id"])


@query("stream_telemetry_flush", "clicks", sql="SELECT tenant_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, count(*) AS n FROM clicks GROUP BY 1, 2")
def stream_telemetry_flush(spark, sf):
    path = jobs.new_path(spark, "flush")
    jobs.finished(jobs.append_to(tables.with_day(click_stream(spark, sf)), path, ["tenant_id", "dt"]))
    return spark.read.parquet(path).groupBy("tenant_id", F.col("dt").cast("string").alias("dt")).agg(F.count("*").alias("n"))
