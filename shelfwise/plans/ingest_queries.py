"""Queries over raw tables: scans, cleaning, reshaping, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.config import Feature, ServiceColumns, TransactionColumns
from shelfwise.functions import events as ev, ids, text
from shelfwise.operators import cleaning, ingest, keyed
from shelfwise.plans import sqltext as q
from shelfwise.plans.registry import query
from shelfwise.plans.roles import inputs, one
from shelfwise.session import durable_path
from shelfwise.sources import raw

SEGMENTS = ("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE")
SEGMENT_LIST = ", ".join(f"'{s}'" for s in SEGMENTS)
FEATURES = (Feature("balance"), Feature("segment", "categorical", SEGMENTS), Feature("nation"))
TILL = TransactionColumns("CustomerID", "StockCode", "Quantity", "InvoiceNo", "Description", ("C",))
SERVICES = ServiceColumns(("ExpressDelivery", "PhoneService", "StreamingTV"), ("No", "No internet service"),
                          multi_value=ingest.INTERNET_VALUES)
GENRES = ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE")


@query("scan_raw_table", "raw_customers", sql="""
    SELECT customerID AS "customerID", try_cast(nullif(trim(balance), '') AS DOUBLE) AS balance, segment, count(*) AS n
    FROM raw_customers GROUP BY ALL""")
def scan_raw_table(spark, sf):
    """The untidy export as it arrives, half of it as CSV and half as JSON lines, read back by the raw readers."""
    df = one(spark, sf, "raw_customers").withColumnsRenamed({"customerID": " customerID ", "balance": "balance  "})
    csv, lines = durable_path(spark, "raw-csv"), durable_path(spark, "raw-json")
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.where("seq % 2 = 0").drop("seq").write.options(header=True, **keep).csv(csv)
    df.where("seq % 2 = 1").drop("seq").write.json(lines)
    parts = [raw.read_raw(spark, path, kind, numeric=["balance"]) for kind, path in (("csv", csv), ("json", lines))]
    found = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return found.groupBy("customerID", "balance", "segment").agg(F.count("*").alias("n"))


@query("scan_header_aliases", "till", sql="""
    SELECT InvoiceNo, CustomerID, StockCode, count(*) AS n FROM till GROUP BY ALL""")
def scan_header_aliases(spark, sf):
    df = one(spark, sf, "till").withColumnsRenamed({"InvoiceNo": "invoice", "CustomerID": "Customer ID", "StockCode": "stock_code"})
    return raw.canonical_columns(df, raw.RETAIL_HEADERS).groupBy("InvoiceNo", "CustomerID", "StockCode").agg(F.count("*").alias("n"))


@query("sample_customers", "raw_customers", sql=f"""
    SELECT DISTINCT {q.clean_id('customerID')} AS "customerID" FROM raw_customers WHERE {q.has_id('customerID')} ORDER BY 1 LIMIT 20""")
def sample_customers(spark, sf):
    return raw.sample_ids(one(spark, sf, "raw_customers"), "customerID", 20)


@query("dataset_stats", "shoppers", "bought", sql="""
    WITH t AS (SELECT DISTINCT tenant_id FROM shoppers),
    facts AS (SELECT tenant_id, product_id FROM bought JOIN shoppers USING (customer_id))
    SELECT tenant_id, 'customers' AS table_name, count(*) AS n FROM shoppers GROUP BY 1
    UNION ALL SELECT tenant_id, 'interactions', count(*) FROM facts GROUP BY 1
    UNION ALL SELECT tenant_id, 'products', count(DISTINCT product_id) FROM facts GROUP BY 1""")
def dataset_stats(spark, sf):
    shoppers, bought = inputs(spark, sf, "shoppers", "bought")
    facts = bought.join(shoppers.select("customer_id", "tenant_id"), "customer_id")
    products = facts.select("tenant_id", "product_id").distinct()
    from shelfwise.operators.ops import table_counts

    return table_counts({"customers": shoppers, "interactions": facts, "products": products})


@query("seed_catalog", "upload", sql="""
    SELECT trim(product_id) AS product_id, trim(product_name) AS product_name,
           coalesce(nullif(trim(category), ''), 'General') AS category, 'active' AS status,
           coalesce(CAST(trunc(try_cast(in_stock AS DOUBLE)) AS INTEGER), 1) AS in_stock, '2024-03-01' AS created_at
    FROM upload WHERE trim(product_id) <> ''
    QUALIFY row_number() OVER (PARTITION BY trim(product_id) ORDER BY row_num) = 1""")
def seed_catalog(spark, sf):
    out = ingest.seed_catalog(one(spark, sf, "upload"), [F.col("row_num")], F.lit("2024-03-01"))
    return out.select("product_id", "product_name", "category", "status", "in_stock", "created_at")


@query("validate_columns", "raw_customers", sql="""
    SELECT 'customers' AS table_name, 'balance' AS column_name, 'non_numeric' AS violation, count(*) AS bad_rows
    FROM raw_customers WHERE balance IS NOT NULL AND try_cast(balance AS DOUBLE) IS NULL
    UNION ALL
    SELECT 'customers', 'segment', 'non_numeric', count(*) FROM raw_customers WHERE segment IS NOT NULL
    UNION ALL SELECT 'customers', 'customer_id', 'missing', 0""")
def validate_columns(spark, sf):
    return cleaning.column_violations(one(spark, sf, "raw_customers"), "customers", ["customer_id"], ["balance", "nation", "segment"])


@query("validate_allowed_values", "raw_customers", sql=f"""
    SELECT 'segment' AS column_name, segment AS value, count(*) AS n FROM raw_customers
    WHERE segment IS NOT NULL AND segment NOT IN ({SEGMENT_LIST}) GROUP BY segment""")
def validate_allowed_values(spark, sf):
    return cleaning.value_violations(one(spark, sf, "raw_customers"), {"segment": SEGMENTS})


@query("normalize_ids", "till", sql=f"""
    SELECT CustomerID AS raw_id, {q.clean_id('CustomerID')} AS customer_id, count(*) AS n FROM till GROUP BY 1, 2""")
def normalize_ids(spark, sf):
    df = one(spark, sf, "till").groupBy(F.col("CustomerID").alias("raw_id")).agg(F.count("*").alias("n"))
    return df.select("raw_id", ids.clean_id(F.col("raw_id")).alias("customer_id"), "n")


@query("filter_null_tokens", "till", sql=f"""
    SELECT StockCode AS stock_code, count(*) AS n FROM till
    WHERE {q.has_id('CustomerID')} AND {q.has_id('StockCode')} GROUP BY 1""")
def filter_null_tokens(spark, sf):
    df = one(spark, sf, "till").where(ids.has_id(F.col("CustomerID")) & ids.has_id(F.col("StockCode")))
    return df.groupBy(F.col("StockCode").alias("stock_code")).agg(F.count("*").alias("n"))


CUSTOMERS = f"""(SELECT {q.clean_id('customerID')} AS customer_id, try_cast(balance AS DOUBLE) AS balance, segment,
    try_cast(nation AS DOUBLE) AS nation FROM raw_customers WHERE {q.has_id('customerID')}
    QUALIFY row_number() OVER (PARTITION BY {q.clean_id('customerID')} ORDER BY seq) = 1)"""


@query("build_customers", "raw_customers", sql=f"SELECT * FROM {CUSTOMERS}")
def build_customers(spark, sf):
    return cleaning.build_customers(one(spark, sf, "raw_customers"), "customerID", FEATURES, [F.col("seq")])


@query("coerce_feature_types", "raw_customers", sql="""
    SELECT seq, try_cast(balance AS DOUBLE) AS balance, segment, try_cast(nation AS DOUBLE) AS nation FROM raw_customers""")
def coerce_feature_types(spark, sf):
    df = cleaning.coerce_features(one(spark, sf, "raw_customers"), FEATURES + (Feature("absent"),))
    return df.select("seq", "balance", "segment", "nation")


@query("active_catalog", "shelf", sql=f"""
    SELECT product_id, product_name, category, brand, price, in_stock FROM {q.ACTIVE_SHELF} WHERE in_stock <> 0""")
def active_catalog(spark, sf):
    return cleaning.active_catalog(one(spark, sf, "shelf"), hide_out_of_stock=True).select(
        "product_id", "product_name", "category", "brand", "price", "in_stock")


@query("catalog_search", "shelf", sql="""
    SELECT product_id, product_name, brand FROM shelf
    WHERE lower(status) = 'active' AND (contains(lower(product_id), 'ring') OR contains(lower(product_name), 'ring')
        OR contains(lower(coalesce(description, '')), 'ring') OR contains(lower(coalesce(brand, '')), 'ring')
        OR contains(lower(coalesce(category, '')), 'ring'))""")
def catalog_search(spark, sf):
    return cleaning.catalog_search(one(spark, sf, "shelf"), " RING", "Active").select("product_id", "product_name", "brand")


@query("validate_events", "clicks", sql="""
    SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click', 'add_to_cart', 'purchase') THEN 'event_type'
        WHEN trim(session_id) = '' THEN 'session_id' WHEN trim(product_id) = '' THEN 'product_id'
        WHEN quantity IS NOT NULL AND try_cast(quantity AS DOUBLE) IS NULL THEN 'quantity'
        WHEN try_cast(quantity AS DOUBLE) < 0 THEN 'quantity'
        WHEN source NOT IN ('similar', 'recommendation', 'organic') THEN 'source'
        WHEN NOT regexp_matches(rec_id, '^[0-9a-fA-F]{1,32}$') THEN 'rec_id' END AS reject_reason
    FROM clicks""")
def validate_events(spark, sf):
    return one(spark, sf, "clicks").select("event_id", ev.reject_reason().alias("reject_reason"))


@query("exclude_test_traffic", "signals", sql="""
    SELECT type, count(*) AS n FROM signals
    WHERE source IS DISTINCT FROM 'test' AND request_source IS DISTINCT FROM 'test' GROUP BY type""")
def exclude_test_traffic(spark, sf):
    df = one(spark, sf, "signals").where(ev.is_live(F.col("source"), F.col("request_source")))
    return df.groupBy("type").agg(F.count("*").alias("n"))


@query("year_filter", "till", sql="""
    SELECT InvoiceDate AS invoice_date, count(*) AS n FROM till
    WHERE year(try_cast(InvoiceDate AS DATE)) = 1997 GROUP BY 1""")
def year_filter(spark, sf):
    df = cleaning.in_year(one(spark, sf, "till"), "InvoiceDate", 1997)
    return df.groupBy(F.col("InvoiceDate").alias("invoice_date")).agg(F.count("*").alias("n"))


@query("sample_rows", "till", sql="""
    SELECT seq, StockCode AS stock_code FROM till ORDER BY md5('42|' || seq), seq LIMIT 500""")
def sample_rows(spark, sf):
    return cleaning.sample_rows(one(spark, sf, "till"), 500, 42, ["seq"]).select("seq", F.col("StockCode").alias("stock_code"))


@query("upload_validation", "upload", sql=f"""
    WITH b AS {q.UPLOAD_BASE}
    SELECT row_num, CASE WHEN product_id IS NULL THEN 'Missing required column ''product_id''' ELSE 'product_id cannot be empty' END AS message
    FROM b WHERE pid IS NULL
    UNION ALL SELECT row_num, 'Duplicate product_id ''' || pid || ''' in file (first seen on row ' || first_row || ')'
    FROM b WHERE pid IS NOT NULL AND row_num > first_row
    UNION ALL SELECT row_num, 'Missing required column ''product_name''' FROM b WHERE {q.nul('product_name')} IS NULL
    UNION ALL SELECT row_num, 'Missing required column ''category''' FROM b WHERE {q.nul('category')} IS NULL
    UNION ALL SELECT row_num, 'Invalid price ''' || price || ''': must be a numeric value' FROM b WHERE price IS NOT NULL AND pr IS NULL
    UNION ALL SELECT row_num, 'Invalid price ''' || price || ''': must be non-negative (>= 0)' FROM b WHERE pr < 0""")
def upload_validation(spark, sf):
    return cleaning.upload_errors(one(spark, sf, "upload"))


FLAG_SQL = " UNION ALL ".join(
    f"SELECT customerID AS customer_id, '{c}' AS product_id FROM services WHERE {q.has_id('customerID')} "
    f"AND coalesce({c} NOT IN ('No', 'No internet service'), TRUE)" for c in SERVICES.flags)
INTERNET_SQL = f"""SELECT customerID AS customer_id, CASE InternetService WHEN 'DSL' THEN 'InternetService_DSL'
    ELSE 'InternetService_Fiber' END AS product_id FROM services
    WHERE {q.has_id('customerID')} AND InternetService IN ('DSL', 'Fiber optic')"""


@query("interactions_from_services", "services", sql=f"{FLAG_SQL} UNION ALL {INTERNET_SQL}")
def interactions_from_services(spark, sf):
    return ingest.service_interactions(one(spark, sf, "services"), "customerID", SERVICES)


@query("interactions_from_multivalue", "services", sql=INTERNET_SQL)
def interactions_from_multivalue(spark, sf):
    return ingest.multi_value_interactions(one(spark, sf, "services"), "customerID", SERVICES)


@query("products_from_services", "services", sql=f"""
    WITH p AS (SELECT * FROM (VALUES ('ExpressDelivery', 'Express Delivery', 'Add-on'), ('PhoneService', 'Phone Service', 'Core'),
        ('StreamingTV', 'Streaming TV', 'Add-on'), ('InternetService_DSL', 'Internet - DSL', 'Core'),
        ('InternetService_Fiber', 'Internet - Fiber Optic', 'Core')) t(product_id, product_name, category)),
    n AS (SELECT product_id, count(*) AS n FROM ({FLAG_SQL} UNION ALL {INTERNET_SQL}) x GROUP BY 1)
    SELECT product_id, product_name, category, coalesce(n, 0) AS customers FROM p LEFT JOIN n USING (product_id)""")
def products_from_services(spark, sf):
    """The derived product table, with the number of customers of each product."""
    wide = one(spark, sf, "services")
    n = ingest.service_interactions(wide, "customerID", SERVICES).groupBy("product_id").agg(F.count("*").alias("n"))
    return ingest.service_products(wide, SERVICES).join(n, "product_id", "left").select(
        "product_id", "product_name", "category", F.coalesce("n", F.lit(0)).alias("customers"))


@query("transactional_interactions", "till", sql=f"SELECT * FROM {q.SALES}")
def transactional_interactions(spark, sf):
    return ingest.sale_interactions(one(spark, sf, "till"), TILL)


@query("transactional_pairs", "till", sql=f"SELECT customer_id, product_id FROM {q.SALES}")
def transactional_pairs(spark, sf):
    cols = TransactionColumns("CustomerID", "StockCode", None, "InvoiceNo", None, ("C",))
    return ingest.sale_interactions(one(spark, sf, "till"), cols)


@query("products_from_transactions", "till", sql=f"""
    WITH r AS (SELECT {q.clean_id('StockCode')} AS product_id, CASE WHEN {q.has_id('Description')} THEN trim(Description) END AS name
               FROM till WHERE {q.has_id('StockCode')}),
    c AS (SELECT product_id, name, count(*) AS n FROM r GROUP BY 1, 2)
    SELECT product_id, coalesce(name, product_id) AS product_name FROM c
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY name IS NULL, n DESC, name) = 1""")
def products_from_transactions(spark, sf):
    return ingest.sale_products(one(spark, sf, "till"), "StockCode", "Description")


@query("wide_flags_from_events", "ratings", "movies", sql="""
    WITH p AS (SELECT user_id, genres FROM ratings JOIN movies USING (movie_id) WHERE rating >= 3.5)
    SELECT u.user_id, """ + ", ".join(
    f"CASE WHEN bool_or(contains(genres, '{g}')) THEN 'Yes' ELSE 'No' END AS {g.lower()}" for g in GENRES) + """
    FROM (SELECT DISTINCT user_id FROM ratings) u LEFT JOIN p ON u.user_id = p.user_id GROUP BY 1""")
def wide_flags_from_events(spark, sf):
    return ingest.wide_flags(*inputs(spark, sf, "ratings", "movies"), GENRES)


@query("user_stats", "ratings", sql="""
    SELECT user_id, count(rating) AS rating_count, round(avg(rating), 2) AS avg_rating FROM ratings GROUP BY 1""")
def user_stats(spark, sf):
    return ingest.user_stats(one(spark, sf, "ratings"))


@query("favorite_category", "ratings", "movies", sql="""
    WITH g AS (SELECT user_id, unnest(string_split(genres, '|')) AS genre FROM ratings JOIN movies USING (movie_id)
               WHERE rating >= 3.5 AND genres <> '(no genres listed)'),
    c AS (SELECT user_id, genre, count(*) AS n FROM g GROUP BY 1, 2),
    b AS (SELECT user_id, genre FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, genre) = 1)
    SELECT user_id, coalesce(genre, 'Drama') AS favorite_genre FROM (SELECT DISTINCT user_id FROM ratings) u LEFT JOIN b USING (user_id)""")
def favorite_category(spark, sf):
    return ingest.favorite_genre(*inputs(spark, sf, "ratings", "movies"))


@query("behavioral_features", "shoppers", "bought", sql="""
    SELECT customer_id, count(product_id) AS interaction_count FROM shoppers LEFT JOIN bought USING (customer_id) GROUP BY 1""")
def behavioral_features(spark, sf):
    shoppers, bought = inputs(spark, sf, "shoppers", "bought")
    return ingest.behavioral_features(shoppers.select("customer_id"), bought)


# ---- scalar functions -------------------------------------------------------------------------

def _function_query(key, role, source, column, expr_sql, role_sql_name=None):
    """A query that applies one Column function to every distinct value of a source column."""
    name = role_sql_name or role

    @query(key, role, sql=f"SELECT v, {expr_sql} AS result, n FROM (SELECT {source} AS v, count(*) AS n FROM {name} GROUP BY 1)")
    def run(spark, sf):
        values = one(spark, sf, role).groupBy(F.expr(source).alias("v")).agg(F.count("*").alias("n"))
        return values.select("v", column(F.col("v")).alias("result"), "n")

    return run


_function_query("fn_slugify", "part", "p_brand || ' -- ' || p_type || '!'", text.slugify,
                "trim(regexp_replace(lower(trim(v)), '[^a-z0-9]+', '_', 'g'), '_')")
_function_query("fn_humanize", "part", "upper(substr(p_name, 1, 1)) || substr(p_name, 2, 2) || p_type || 'Line' || p_brand", text.humanize,
                "regexp_replace(v, '(\\p{Ll})(\\p{Lu})', '\\1 \\2', 'g')")
_function_query("fn_clean_price", "orders",
                "CASE WHEN o_orderkey % 7 = 0 THEN 'free' WHEN o_orderkey % 7 = 1 THEN CAST(NULL AS STRING) "
                "WHEN o_orderkey % 7 = 2 THEN '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ',000.25' "
                "ELSE '-' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ' USD' END", text.clean_price, q.price("v"))

# key and number of every part of a specification text, last value per key
SPEC_ROWS = """(SELECT product_id, k, arg_max(v, i) AS v, min(i) AS pos FROM (
    SELECT product_id, i, lower(trim(CASE WHEN contains(t, '=') THEN split_part(t, '=', 1) ELSE split_part(t, ':', 1) END)) AS k,
        coalesce(try_cast(raw AS DOUBLE), try_cast(nullif(regexp_extract(raw, '^[-+]?([0-9]*\\.[0-9]+|[0-9]+)', 0), '') AS DOUBLE)) AS v
    FROM (SELECT product_id, i, t, trim(CASE WHEN contains(t, '=') THEN substr(t, instr(t, '=') + 1) ELSE substr(t, instr(t, ':') + 1) END) AS raw
          FROM (SELECT product_id, generate_subscripts(string_split(specs, ';'), 1) AS i, unnest(string_split(specs, ';')) AS t
                FROM {source} WHERE specs IS NOT NULL) WHERE contains(t, '=') OR contains(t, ':')))
    WHERE k <> '' AND v IS NOT NULL GROUP BY 1, 2)"""


@query("fn_parse_specs", "shelf", sql=f"SELECT product_id, k AS spec, v AS value FROM {SPEC_ROWS.format(source='shelf')}")
def fn_parse_specs(spark, sf):
    return one(spark, sf, "shelf").select("product_id", F.explode(text.parse_specs(F.col("specs"))).alias("spec", "value"))


def _with_extras(df):
    extras = F.create_map(F.lit(" Size_CM "), F.lit("1"), F.lit("shelf_no"), (F.col("p_partkey") % 9).cast("string"),
                          F.lit("price"), F.col("price").cast("string"), F.lit("note"), F.lit("x"))
    return text.with_extra_specs(text.parse_specs(F.col("specs")), extras)


ALL_SPECS = f"""(SELECT product_id, k, v, pos FROM {SPEC_ROWS.format(source='shelf')}
    UNION ALL SELECT product_id, 'shelf_no', CAST(p_partkey % 9 AS DOUBLE), 101 FROM shelf
    UNION ALL SELECT product_id, 'size_cm', 1.0, 100 FROM shelf WHERE specs IS NULL)"""


@query("fn_extra_numeric_specs", "shelf", sql=f"SELECT product_id, k AS spec, v AS value FROM {ALL_SPECS}")
def fn_extra_numeric_specs(spark, sf):
    df = one(spark, sf, "shelf")
    return df.select("product_id", F.explode(_with_extras(df)).alias("spec", "value"))


@query("fn_format_specs", "shelf", sql=f"""
    SELECT product_id, string_agg(label || '=' || txt, ', ' ORDER BY pos) AS specs FROM (
        SELECT product_id, pos, CASE k WHEN 'ram_gb' THEN 'RAM (GB)' WHEN 'storage_gb' THEN 'Storage (GB)'
            WHEN 'weight_g' THEN 'Weight (g)' WHEN 'size_cm' THEN 'Size Cm' WHEN 'shelf_no' THEN 'Shelf No' END AS label,
            CAST(CAST(v AS BIGINT) AS VARCHAR) AS txt FROM {ALL_SPECS}) GROUP BY 1""")
def fn_format_specs(spark, sf):
    df = one(spark, sf, "shelf")
    rows = F.transform(text.format_specs(_with_extras(df)), lambda s: F.concat(s.label, F.lit("="), s.value))
    return df.select("product_id", F.array_join(rows, ", ").alias("specs"))


@query("fn_price_diff", "shelf", sql="""
    SELECT s.product_id, round(s.price - m.price, 2) AS price_diff,
           CASE WHEN m.price > 0 THEN round((s.price - m.price) / m.price * 100, 1) END AS price_diff_pct
    FROM shelf s LEFT JOIN (SELECT category, min(price) AS price FROM shelf GROUP BY 1) m USING (category)""")
def fn_price_diff(spark, sf):
    """Distance of every product to the cheapest price of its category."""
    from shelfwise.operators.similarity import price_diff, price_diff_pct

    shelf = one(spark, sf, "shelf")
    cheapest = shelf.groupBy("category").agg(F.min("price").alias("target"))
    both = shelf.join(cheapest, "category", "left")
    return both.select("product_id", price_diff(F.col("price"), F.col("target")).alias("price_diff"),
                       price_diff_pct(F.col("price"), F.col("target")).alias("price_diff_pct"))


@query("fn_time_ago", "events", sql="""
    SELECT event_id, CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago'
        WHEN s < 172800 THEN 'Yesterday' ELSE strftime(ts, '%b %d') END AS ago
    FROM (SELECT event_id, ts, greatest(0, (epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(ts)) // 1000000) AS s FROM events)""")
def fn_time_ago(spark, sf):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return one(spark, sf, "events").select("event_id", text.time_ago(F.col("ts"), now).alias("ago"))


@query("fn_event_weight", "clicks", sql="""
    SELECT event_id, (CASE event_type WHEN 'view' THEN 1.0 WHEN 'add_to_cart' THEN 2.5 WHEN 'purchase' THEN 5.0 ELSE 1.0 END)
        * CASE WHEN try_cast(quantity AS DOUBLE) > 0 THEN try_cast(quantity AS DOUBLE) ELSE 1 END AS weight FROM clicks""")
def fn_event_weight(spark, sf):
    w = ev.event_weight(F.col("event_type"), F.col("quantity"), {"ADD_TO_CART": 2.5})
    return one(spark, sf, "clicks").select("event_id", w.alias("weight"))


@query("fn_product_row_format", "upload", sql="""
    SELECT row_num, trim(product_id) AS product_id, trim(product_name) AS product_name, try_cast(price AS DOUBLE) AS price,
           CASE WHEN in_stock IS NOT NULL THEN coalesce(CAST(try_cast(in_stock AS DOUBLE) AS INTEGER), 1) END AS in_stock FROM upload""")
def fn_product_row_format(spark, sf):
    df = cleaning.format_catalog_rows(one(spark, sf, "upload"))
    return df.select(F.col("row_num").cast("bigint").alias("row_num"), "product_id", "product_name", "price", "in_stock")


@query("dedupe_keep_first", "raw_customers", sql=f"""
    SELECT {q.clean_id('customerID')} AS customer_id, segment FROM raw_customers
    QUALIFY row_number() OVER (PARTITION BY {q.clean_id('customerID')} ORDER BY seq) = 1""")
def dedupe_keep_first(spark, sf):
    df = one(spark, sf, "raw_customers").withColumn("customer_id", ids.clean_id(F.col("customerID")))
    return keyed.first_per_key(df, ["customer_id"], [F.col("seq")]).select("customer_id", "segment")


@query("dedupe_keep_last", "raw_customers", sql=f"""
    SELECT {q.clean_id('customerID')} AS customer_id, segment FROM raw_customers
    QUALIFY row_number() OVER (PARTITION BY {q.clean_id('customerID')} ORDER BY seq DESC) = 1""")
def dedupe_keep_last(spark, sf):
    df = one(spark, sf, "raw_customers").withColumn("customer_id", ids.clean_id(F.col("customerID")))
    return keyed.first_per_key(df, ["customer_id"], [F.col("seq").desc()]).select("customer_id", "segment")
