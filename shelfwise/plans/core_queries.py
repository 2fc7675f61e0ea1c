"""Joins, aggregates, windows, sets, serving and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.config import Segmentation
from shelfwise.functions import events as ev
from shelfwise.operators import catalog as cat, cleaning, content, encode, evaluate, keyed, ops, ranking, serve
from shelfwise.operators.similarity import candidate_counts, price_bounds
from shelfwise.plans import sqltext as q
from shelfwise.plans.registry import query
from shelfwise.plans.roles import inputs, one
from shelfwise.session import cut_lineage

NUMERIC, CATEGORICAL = ("c_acctbal", "c_nationkey"), ("c_mktsegment",)
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

# customer vectors in DuckDB: scaled numbers, then indicators
VEC = f"""(SELECT customer_id, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS f0,
    (c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER () AS f1, {', '.join(
        f"CAST(c_mktsegment = '{s}' AS DOUBLE) AS f{i + 2}" for i, s in enumerate(SEGMENTS))} FROM shoppers)"""
DIMS = [f"f{i}" for i in range(7)]
PROFILES = f"(SELECT product_id, {', '.join(f'avg({f}) AS {f}' for f in DIMS)} FROM bought JOIN {VEC} v USING (customer_id) GROUP BY 1)"
CONTENT = f"""(SELECT customer_id, product_id, round(s, 9) AS score,
    row_number() OVER (PARTITION BY customer_id ORDER BY round(s, 9) DESC, product_id) AS rank FROM (
    SELECT v.customer_id, p.product_id, ({' + '.join(f'v.{f} * p.{f}' for f in DIMS)}) /
        (sqrt({' + '.join(f'v.{f} * v.{f}' for f in DIMS)}) * sqrt({' + '.join(f'p.{f} * p.{f}' for f in DIMS)})) AS s
    FROM {VEC} v CROSS JOIN {PROFILES} p))"""


def content_model(spark, sf):
    shoppers, bought = inputs(spark, sf, "shoppers", "bought")
    return content.fit(shoppers, bought, NUMERIC, CATEGORICAL)


def active(spark, sf):
    return cleaning.active_catalog(one(spark, sf, "shelf"))


# ---- joins ------------------------------------------------------------------------------------

@query("join_interactions_features", "shoppers", "bought", sql=f"""
    SELECT customer_id, product_id, count(*) AS cnt, {', '.join(f'round(any_value({f}), 6) AS {f}' for f in DIMS[:3])}
    FROM bought LEFT JOIN {VEC} v USING (customer_id) GROUP BY 1, 2""")
def join_interactions_features(spark, sf):
    shoppers, bought = inputs(spark, sf, "shoppers", "bought")
    vectors, _ = content.customer_vectors(shoppers, NUMERIC, CATEGORICAL)
    rows = content.join_vectors(bought, vectors)
    return rows.select("customer_id", "product_id", "cnt", *[F.round(F.get("vec", F.lit(i)), 6).alias(f"f{i}") for i in range(3)])


@query("join_inner_items", "bought", "shelf", sql="""
    SELECT category, count(*) AS n, sum(weight) AS weight FROM bought JOIN shelf USING (product_id) GROUP BY 1""")
def join_inner_items(spark, sf):
    bought, shelf = inputs(spark, sf, "bought", "shelf")
    # per product first: the join then sees one row per product, however popular it is
    per_product = bought.groupBy("product_id").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    return per_product.join(shelf.select("product_id", "category"), "product_id").groupBy("category").agg(
        F.sum("n").alias("n"), F.sum("weight").alias("weight"))


@query("join_dim_lookup", "bought", "shelf", sql=f"""
    SELECT p.product_id, p.n, a.product_name, a.category, a.price
    FROM (SELECT product_id, count(*) AS n FROM bought GROUP BY 1) p LEFT JOIN {q.ACTIVE_SHELF} a USING (product_id)""")
def join_dim_lookup(spark, sf):
    pop = serve.popularity(one(spark, sf, "bought"))
    return pop.join(active(spark, sf).select("product_id", "product_name", "category", "price"), "product_id", "left")


@query("join_anti_known", "shoppers", "bought", sql=f"""
    SELECT customer_id, product_id, round(score, 6) AS score FROM {CONTENT}
    WHERE rank <= 100 AND (customer_id, product_id) NOT IN (SELECT customer_id, product_id FROM bought)""")
def join_anti_known(spark, sf):
    """The pairs that the content model scores, its 100 best of all products for every customer, without what the customer owns."""
    scored = content.top_products(content_model(spark, sf), 100).select("customer_id", "product_id", F.round("score", 6).alias("score"))
    return serve.drop_owned(scored, one(spark, sf, "bought").select("customer_id", "product_id").distinct())


@query("join_semi_active", "bought", "shelf", sql=f"""
    SELECT product_id, count(*) AS n FROM bought WHERE product_id IN (SELECT product_id FROM {q.ACTIVE_SHELF}) GROUP BY 1""")
def join_semi_active(spark, sf):
    return serve.popularity(one(spark, sf, "bought")).join(active(spark, sf), "product_id", "left_semi")


@query("join_cross_candidates", "customer", "part", "bought", sql="""
    WITH c AS (SELECT DISTINCT c_mktsegment || '/' || c_nationkey AS customer_id FROM customer),
    p AS (SELECT DISTINCT p_type || '/' || p_brand AS product_id FROM part),
    k AS (SELECT DISTINCT c_mktsegment || '/' || c_nationkey AS customer_id, p_type || '/' || p_brand AS product_id
          FROM bought JOIN customer ON CAST(c_custkey AS VARCHAR) = customer_id JOIN part ON CAST(p_partkey AS VARCHAR) = product_id)
    SELECT c.customer_id, p.product_id, CASE WHEN k.product_id IS NULL THEN 0 ELSE 1 END AS target
    FROM c CROSS JOIN p LEFT JOIN k ON k.customer_id = c.customer_id AND k.product_id = p.product_id""")
def join_cross_candidates(spark, sf):
    """Full candidate frame of customer groups and product lines, a size the pair limit allows."""
    customer, part, bought = inputs(spark, sf, "customer", "part", "bought")
    group = F.concat_ws("/", "c_mktsegment", "c_nationkey")
    line = F.concat_ws("/", "p_type", "p_brand")
    who = customer.select(F.col("c_custkey").cast("string").alias("customer_id"), group.alias("grp"))
    what = part.select(F.col("p_partkey").cast("string").alias("product_id"), line.alias("line"))
    known = bought.join(who, "customer_id").join(what, "product_id").select(F.col("grp").alias("customer_id"), F.col("line").alias("product_id"))
    return ranking.all_pairs(who.select(F.col("grp").alias("customer_id")).distinct(),
                             what.select(F.col("line").alias("product_id")).distinct(), known)


MAPPING = f"""(SELECT trim(session_id) AS session_id, arg_max(trim(customer_id), (ts, event_id)) AS mapped FROM clicks
    WHERE {q.has_id('session_id')} AND {q.has_id('customer_id')} AND trim(session_id) <> trim(customer_id) GROUP BY 1)"""
EFFECTIVE = f"""CASE WHEN {q.has_id('customer_id')} THEN trim(customer_id)
    WHEN {q.has_id('c.session_id')} THEN coalesce(mapped, trim(c.session_id)) END"""


@query("join_identity_resolve", "clicks", sql=f"""
    SELECT event_id, {EFFECTIVE} AS customer_id FROM clicks c LEFT JOIN {MAPPING} m ON trim(c.session_id) = m.session_id""")
def join_identity_resolve(spark, sf):
    from shelfwise.operators.identity import identity_map, resolve

    clicks = one(spark, sf, "clicks")
    return resolve(clicks, identity_map(clicks)).select("event_id", F.col("effective_customer").alias("customer_id"))


@query("fn_effective_customer", "clicks", sql=f"""
    SELECT event_id, {EFFECTIVE.replace('mapped', 'NULL')} AS customer_id,
           CASE WHEN NOT {q.has_id('customer_id')} AND NOT {q.has_id('session_id')} THEN 'no_identity'
                WHEN NOT {q.has_id('product_id')} THEN 'no_product' END AS reject
    FROM clicks c""")
def fn_effective_customer(spark, sf):
    c = {x: F.col(x) for x in ("customer_id", "session_id", "product_id")}
    return one(spark, sf, "clicks").select(
        "event_id", ev.effective_customer(c["customer_id"], F.lit(None).cast("string"), c["session_id"]).alias("customer_id"),
        ev.transform_reject(c["customer_id"], c["session_id"], c["product_id"]).alias("reject"))


@query("join_missing_catalog", "clicks", "shelf", sql=f"""
    SELECT product_id, product_name, category, status FROM shelf
    UNION ALL SELECT DISTINCT trim(product_id) || 'x', trim(product_id) || 'x', 'General', 'active' FROM clicks WHERE {q.has_id('product_id')}""")
def join_missing_catalog(spark, sf):
    clicks, shelf = inputs(spark, sf, "clicks", "shelf")
    seen = clicks.where(F.trim("product_id") != "").select(F.concat(F.trim("product_id"), F.lit("x")).alias("product_id"))
    out = serve.add_missing_products(shelf, seen.unionByName(shelf.select("product_id")), F.lit("2024-03-01"))
    return out.select("product_id", "product_name", "category", "status")


@query("join_self_category_pairs", "shelf", sql=f"""
    WITH a AS (SELECT product_id, lower(category) AS cat, price FROM {q.ACTIVE_SHELF})
    SELECT t.product_id, count(c.product_id) AS candidates FROM a t LEFT JOIN a c ON (t.cat IS NULL OR t.cat = c.cat)
        AND t.product_id <> c.product_id AND (coalesce(t.price, 0) <= 0 OR coalesce(c.price, 0) <= 0
        OR (c.price >= t.price / 2 AND c.price <= t.price * 2)) GROUP BY 1""")
def join_self_category_pairs(spark, sf):
    """How many products of the same category and price band each product can be compared with."""
    return candidate_counts(active(spark, sf), 2.0)


@query("price_band_filter", "shelf", sql=f"""
    WITH a AS (SELECT product_id, lower(category) AS cat, price FROM {q.ACTIVE_SHELF}),
    m AS (SELECT cat, min(price) AS target FROM a WHERE price > 0 GROUP BY 1)
    SELECT product_id FROM a JOIN m USING (cat) WHERE price IS NULL OR price <= 0 OR (price >= target / 2 AND price <= target * 2)""")
def price_band_filter(spark, sf):
    """Products within the price band of the cheapest one of their category."""
    df = active(spark, sf).withColumn("cat", F.lower("category"))
    cheapest = df.where("price > 0").groupBy("cat").agg(F.min("price").alias("target"))
    return df.join(cheapest, "cat").where(cleaning.in_price_band(F.col("target"), F.col("price"), 2.0)).select("product_id")


# ---- aggregates -------------------------------------------------------------------------------

@query("popularity", "bought", "clicks", sql="""
    SELECT product_id, count(*) AS n FROM (SELECT product_id FROM bought UNION ALL SELECT trim(product_id) FROM clicks WHERE trim(product_id) <> '') GROUP BY 1""")
def popularity(spark, sf):
    return serve.popularity(*inputs(spark, sf, "bought", "clicks"))


@query("product_popularity_by_name", "pairs", "shelf", sql="""
    SELECT product_name, count(*) AS subscribers FROM pairs JOIN shelf USING (product_id) GROUP BY 1""")
def product_popularity_by_name(spark, sf):
    pairs, shelf = inputs(spark, sf, "pairs", "shelf")
    per_product = pairs.groupBy("product_id").agg(F.count("*").alias("n"))
    return per_product.join(shelf.select("product_id", "product_name"), "product_id").groupBy("product_name").agg(F.sum("n").alias("subscribers"))


@query("products_per_customer", "pairs", sql="""
    SELECT n_products, count(*) AS customers FROM (SELECT customer_id, count(*) AS n_products FROM pairs GROUP BY 1) GROUP BY 1""")
def products_per_customer(spark, sf):
    sizes = one(spark, sf, "pairs").groupBy("customer_id").agg(F.count("*").alias("n_products"))
    return sizes.groupBy("n_products").agg(F.count("*").alias("customers"))


@query("describe_customers", "shoppers", sql="""
    SELECT 'c_acctbal' AS column_name, count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std,
           min(c_acctbal) AS min, max(c_acctbal) AS max, CAST(NULL AS BIGINT) AS uniques, CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq FROM shoppers
    UNION ALL SELECT 'c_nationkey', count(c_nationkey), round(avg(c_nationkey), 4), round(stddev_samp(c_nationkey), 4), min(c_nationkey), max(c_nationkey), NULL, NULL, NULL FROM shoppers
    UNION ALL SELECT 'c_mktsegment', sum(n)::BIGINT, NULL, NULL, NULL, NULL, count(*), first(c_mktsegment ORDER BY n DESC, c_mktsegment), max(n)
    FROM (SELECT c_mktsegment, count(*) AS n FROM shoppers GROUP BY 1)""")
def describe_customers(spark, sf):
    from shelfwise.operators.profile import describe

    return describe(one(spark, sf, "shoppers"), NUMERIC, CATEGORICAL)


@query("product_profiles", "shoppers", "bought", sql=f"SELECT product_id, {', '.join(f'round({f}, 6) AS {f}' for f in DIMS)} FROM {PROFILES}")
def product_profiles(spark, sf):
    model = content_model(spark, sf)
    return model.profiles.select("product_id", *[F.round(F.get("vec", F.lit(i)), 6).alias(f"f{i}") for i in range(model.dims)])


TRAINED = "(SELECT DISTINCT product_id FROM bought WHERE CAST(ts AS DATE) < DATE '1995-02-01')"


@query("catalog_summary", "shelf", "bought", sql=f"""
    SELECT count(*) FILTER (lower(status) = 'active') AS active, count(*) FILTER (lower(status) = 'archived') AS archived,
        count(*) FILTER (lower(status) = 'active' AND {q.STOCK} = 0) AS out_of_stock,
        count(*) FILTER (lower(status) = 'active' AND t.product_id IS NULL) AS added_since,
        count(*) FILTER (lower(status) = 'active' AND t.product_id IS NOT NULL AND updated_at > '2024-02-01') AS changed_since
    FROM shelf s LEFT JOIN {TRAINED} t ON s.product_id = t.product_id""")
def catalog_summary(spark, sf):
    shelf, bought = inputs(spark, sf, "shelf", "bought")
    return cat.summary(shelf, bought.where(F.col("ts").cast("date") < "1995-02-01").select("product_id"), F.lit("2024-02-01"))


@query("catalog_by_category", "shelf", sql=f"SELECT coalesce(category, 'nan') AS category, count(*) AS n FROM shelf WHERE {q.ACTIVE} GROUP BY 1")
def catalog_by_category(spark, sf):
    return cat.by_category(one(spark, sf, "shelf"))


COUNTS = f"""(WITH facts AS (SELECT tenant_id, customer_id FROM bought JOIN shoppers USING (customer_id)),
    queued AS (SELECT CASE right(tenant_id, 1) WHEN '0' THEN 'AFRICA' WHEN '1' THEN 'AMERICA' WHEN '2' THEN 'ASIA' ELSE tenant_id END AS tenant_id, customer_id FROM clicks),
    people AS (SELECT DISTINCT tenant_id, trim(customer_id) AS c FROM (SELECT * FROM facts UNION ALL SELECT tenant_id, customer_id FROM shoppers UNION ALL SELECT * FROM queued) WHERE {q.has_id('customer_id')}),
    rows AS (SELECT tenant_id, count(*) AS n FROM (SELECT tenant_id FROM facts UNION ALL SELECT tenant_id FROM queued) GROUP BY 1)
    SELECT tenant_id, (SELECT count(*) FROM people p WHERE p.tenant_id = t.tenant_id) AS customers,
           coalesce((SELECT n FROM rows r WHERE r.tenant_id = t.tenant_id), 0) AS interactions
    FROM (SELECT tenant_id FROM people UNION SELECT tenant_id FROM rows) t)"""


def tenant_counts_frame(spark, sf):
    shoppers, bought, clicks = inputs(spark, sf, "shoppers", "bought", "clicks")
    last = F.substring("tenant_id", -1, 1)
    tenant = F.when(last == "0", "AFRICA").when(last == "1", "AMERICA").when(last == "2", "ASIA").otherwise(F.col("tenant_id"))
    facts = bought.join(shoppers.select("customer_id", "tenant_id"), "customer_id")
    return ops.tenant_counts(facts, shoppers, clicks.select(tenant.alias("tenant_id"), "customer_id"))


@query("tenant_counts", "shoppers", "bought", "clicks", sql=f"SELECT * FROM {COUNTS}")
def tenant_counts(spark, sf):
    return tenant_counts_frame(spark, sf)


@query("minmax_by_category", "shelf", sql=f"""
    SELECT coalesce(lower(category), '__general__') AS category, round(min(ln(1 + price)), 6) AS min_log_price, round(max(ln(1 + price)), 6) AS max_log_price
    FROM {q.ACTIVE_SHELF} WHERE price > 0 GROUP BY 1""")
def minmax_by_category(spark, sf):
    b = price_bounds(active(spark, sf))
    return b.select("category", F.round("lo", 6).alias("min_log_price"), F.round("hi", 6).alias("max_log_price"))


@query("segment_median", "shoppers", sql="SELECT median(c_acctbal) AS median, count(*) AS customers FROM shoppers")
def segment_median(spark, sf):
    df = one(spark, sf, "shoppers")
    return df.agg(F.lit(keyed.exact_median(df, "c_acctbal")).alias("median"), F.count("*").alias("customers"))


# ---- windows, limits, sets --------------------------------------------------------------------

def test_rows(max_test=2, source="pairs"):
    """Test rows of the split in DuckDB."""
    return f"""(SELECT customer_id, product_id FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
        ORDER BY md5('42|' || customer_id || '|' || product_id), product_id) AS rn, count(*) OVER (PARTITION BY customer_id) AS cnt FROM {source})
        WHERE rn <= CASE WHEN cnt <= 1 THEN 1 ELSE least({max_test}, cnt - 1) END)"""


@query("train_test_split", "pairs", sql=f"""
    SELECT customer_id, product_id, t.customer_id IS NOT NULL AS is_test FROM pairs LEFT JOIN {test_rows()} t USING (customer_id, product_id)""")
def train_test_split(spark, sf):
    train, test = evaluate.train_test(one(spark, sf, "pairs"))
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


@query("latest_identity_map", "clicks", sql=f"SELECT session_id, mapped FROM {MAPPING}")
def latest_identity_map(spark, sf):
    from shelfwise.operators.identity import identity_map

    return identity_map(one(spark, sf, "clicks"))


@query("request_rate_60s", "clicks", sql="""
    SELECT event_id, count(*) OVER (PARTITION BY tenant_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS in_window FROM clicks""")
def request_rate_60s(spark, sf):
    """Requests of the tenant in the trailing window; the test events are sparse, so an hour."""
    return keyed.trailing_count(one(spark, sf, "clicks"), ["tenant_id"], "ts", 3600, "in_window").select("event_id", "in_window")


@query("recency_events", "clicks", sql="SELECT event_id, event_type FROM clicks ORDER BY ts DESC, event_id DESC LIMIT 20")
def recency_events(spark, sf):
    return one(spark, sf, "clicks").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(20).select("event_id", "event_type")


@query("topk_per_customer", "bought", sql="""
    SELECT customer_id, product_id, score, rank FROM (SELECT customer_id, product_id, score,
        row_number() OVER (PARTITION BY customer_id ORDER BY round(score, 9) DESC, product_id) AS rank
        FROM (SELECT customer_id, product_id, sum(weight) AS score FROM bought GROUP BY 1, 2)) WHERE rank <= 5""")
def topk_per_customer(spark, sf):
    scores = one(spark, sf, "bought").groupBy("customer_id", "product_id").agg(F.sum("weight").alias("score"))
    return keyed.top_per_key(scores, ["customer_id"], keyed.by_score(), 5)


@query("topk_products", "bought", sql="SELECT product_id, count(*) AS n FROM bought GROUP BY 1 ORDER BY n DESC, product_id LIMIT 5")
def topk_products(spark, sf):
    return serve.popularity(one(spark, sf, "bought")).orderBy(F.col("n").desc(), "product_id").limit(5)


@query("catalog_page", "shelf", sql="""
    WITH t AS (SELECT count(*) AS total FROM shelf), s AS (SELECT total, CAST(ceil(total / 50.0) AS BIGINT) AS total_pages FROM t)
    SELECT product_id, total, total_pages, least(3, total_pages) AS page FROM (SELECT product_id, row_number() OVER (ORDER BY product_id) AS rn FROM shelf) CROSS JOIN s
    WHERE (rn - 1) // 50 + 1 = least(3, total_pages)""")
def catalog_page(spark, sf):
    return cat.page(one(spark, sf, "shelf"), 3, 50).select("product_id", "total", "total_pages", "page")


@query("union_batch_stream", "bought", "clicks", sql=f"""
    SELECT customer_id, product_id, 1.0 AS weight, CAST(NULL AS VARCHAR) AS event_type FROM bought
    UNION ALL SELECT {EFFECTIVE}, trim(product_id), (CASE event_type WHEN 'add_to_cart' THEN 2.0 WHEN 'purchase' THEN 5.0 ELSE 1.0 END)
        * CASE WHEN try_cast(quantity AS DOUBLE) > 0 THEN try_cast(quantity AS DOUBLE) ELSE 1 END, event_type
    FROM clicks c LEFT JOIN {MAPPING} m ON trim(c.session_id) = m.session_id
    WHERE {q.has_id('product_id')} AND {EFFECTIVE} IS NOT NULL""")
def union_batch_stream(spark, sf):
    from shelfwise.operators.identity import event_interactions, identity_map, union_interactions

    bought, clicks = inputs(spark, sf, "bought", "clicks")
    streamed = event_interactions(clicks, identity_map(clicks))
    return union_interactions(bought.select("customer_id", "product_id"), streamed).select("customer_id", "product_id", "weight", "event_type")


@query("set_upload_diff", "shelf", "upload", sql=f"""
    WITH f AS (SELECT DISTINCT product_id FROM {q.UPLOAD_OK})
    SELECT (SELECT count(*) FROM (SELECT product_id FROM f EXCEPT SELECT product_id FROM shelf)) AS to_add,
        (SELECT count(*) FROM (SELECT product_id FROM f INTERSECT SELECT product_id FROM shelf)) AS to_update,
        (SELECT count(*) FROM (SELECT product_id FROM shelf WHERE lower(status) = 'active' EXCEPT SELECT product_id FROM f)) AS to_archive""")
def set_upload_diff(spark, sf):
    shelf, upload = inputs(spark, sf, "shelf", "upload")
    return cat.upload_diff(shelf, cleaning.valid_upload(upload), replace=True)


@query("set_active_vs_trained", "shelf", "bought", sql=f"SELECT product_id FROM shelf WHERE {q.ACTIVE} EXCEPT SELECT product_id FROM {TRAINED}")
def set_active_vs_trained(spark, sf):
    shelf, bought = inputs(spark, sf, "shelf", "bought")
    trained = bought.where(F.col("ts").cast("date") < "1995-02-01").select("product_id")
    return shelf.where(cleaning.is_active()).select("product_id").subtract(trained)


# ---- serving ----------------------------------------------------------------------------------

POP = "(SELECT product_id, count(*) AS n FROM bought GROUP BY 1)"
FALLBACK = f"""(SELECT product_id, row_number() OVER (ORDER BY coalesce(n, 0) DESC, product_id) AS rank
    FROM {q.ACTIVE_SHELF} a LEFT JOIN {POP} p USING (product_id) ORDER BY 2 LIMIT {{n}})"""


@query("popularity_fallback", "shelf", "bought", sql=f"SELECT product_id, rank FROM {FALLBACK.format(n=50)}")
def popularity_fallback(spark, sf):
    pop = serve.popularity(one(spark, sf, "bought"))
    return serve.popularity_fallback(active(spark, sf), pop, 50).select("product_id", "rank")


@query("unseen_popular", "shoppers", "bought", "shelf", sql=f"""
    SELECT customer_id, product_id, product_name, rank FROM (
        SELECT customer_id, a.product_id, a.product_name, row_number() OVER (PARTITION BY customer_id ORDER BY coalesce(n, 0) DESC, a.product_id) AS rank
        FROM shoppers CROSS JOIN {q.ACTIVE_SHELF} a LEFT JOIN {POP} p ON p.product_id = a.product_id
        WHERE (customer_id, a.product_id) NOT IN (SELECT customer_id, product_id FROM bought)) WHERE rank <= 5""")
def unseen_popular(spark, sf):
    """Five popular active products not yet bought, for every customer."""
    shoppers, bought, pairs = inputs(spark, sf, "shoppers", "bought", "pairs")
    ranked = serve.ranked_active(active(spark, sf), serve.popularity(bought))
    return serve.unseen_popular(shoppers, pairs, ranked, 5)


def requested(spark, sf):
    """Every customer, plus ids that no customer table knows."""
    shoppers, clicks = inputs(spark, sf, "shoppers", "clicks")
    ghosts = clicks.where(F.trim("customer_id").startswith("u")).select(F.trim("customer_id").alias("customer_id")).distinct()
    return shoppers.select("customer_id").unionByName(ghosts)


@query("recommend_all", "shoppers", "bought", "shelf", "clicks", sql=f"""
    WITH l AS MATERIALIZED (SELECT * FROM {CONTENT} WHERE customer_id IN (SELECT customer_id FROM bought)), a AS {q.ACTIVE_SHELF}, fb AS {FALLBACK.format(n=5)},
    r AS (SELECT customer_id FROM shoppers UNION ALL SELECT DISTINCT trim(customer_id) FROM clicks WHERE trim(customer_id) LIKE 'u%'),
    w AS (SELECT customer_id, CASE WHEN customer_id NOT IN (SELECT customer_id FROM shoppers) THEN 'unknown_customer'
        WHEN customer_id NOT IN (SELECT customer_id FROM l) THEN 'no_history' END AS reason FROM r),
    u AS (SELECT customer_id, product_id, min(rank) AS pos FROM (
        SELECT customer_id, product_id, rank FROM l WHERE product_id IN (SELECT product_id FROM a)
        UNION ALL SELECT customer_id, product_id, 1000000000 + rank FROM w CROSS JOIN fb) GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY pos) AS rank FROM u)
    SELECT customer_id, k.rank, k.product_id, product_name, category, price, reason FROM k JOIN w USING (customer_id) LEFT JOIN a USING (product_id) WHERE k.rank <= 5""")
def recommend_all(spark, sf):
    shoppers, bought = inputs(spark, sf, "shoppers", "bought")
    act = active(spark, sf)
    lists = content.top_products(content_model(spark, sf), 5, offered=act).join(
        bought.select("customer_id").distinct(), "customer_id", "left_semi")
    fallback = serve.popularity_fallback(act, serve.popularity(bought), 5)
    return serve.recommend_all(requested(spark, sf), shoppers, lists, act, fallback, 5)


# ---- evaluation -------------------------------------------------------------------------------

TRAIN = f"(SELECT p.customer_id, p.product_id FROM pairs p LEFT JOIN {test_rows()} t USING (customer_id, product_id) WHERE t.customer_id IS NULL)"
# two models to compare: popular products not in the training rows, and largest training weight
POPULAR = f"""(SELECT customer_id, product_id, rank FROM (
      SELECT customer_id, p.product_id, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, p.product_id) AS rank
      FROM shoppers CROSS JOIN (SELECT product_id, count(*) AS n FROM {TRAIN} GROUP BY 1) p
      WHERE (customer_id, p.product_id) NOT IN (SELECT customer_id, product_id FROM {TRAIN})) WHERE rank <= 5)"""
RECS = f"""(SELECT *, 'popular' AS model FROM {POPULAR}
    UNION ALL SELECT customer_id, product_id, rank, 'content' FROM {CONTENT} WHERE rank <= 5)"""


def two_models(spark, sf, first=None):
    """Training and test rows, and the lists of two models for all customers, or for the ``first`` evaluated ones by id."""
    shoppers, bought, pairs, shelf = inputs(spark, sf, "shoppers", "bought", "pairs", "shelf")
    train, test = evaluate.train_test(pairs)
    pop = serve.popularity(train)
    ranked = keyed.global_rank(pop.withColumn("product_name", F.col("product_id")), [F.col("n").desc(), F.col("product_id").asc()], "position")
    asked = None
    if first is not None:
        asked = cut_lineage(evaluate.first_customers(test, first).select("customer_id").distinct())
        shoppers, owned = (df.join(asked, "customer_id", "left_semi") for df in (shoppers, train))
    popular = serve.unseen_popular(shoppers, train if first is None else owned, ranked, 5)
    cols = ["customer_id", "product_id", "rank"]
    lists = evaluate.with_model({"popular": popular.select(*cols), "content": content.top_products(content_model(spark, sf), 5, asked=asked).select(*cols)})
    return train, test, lists


def popular_list(spark, sf):
    """The popular products of the training rows for all customers, and the test rows."""
    shoppers, pairs = inputs(spark, sf, "shoppers", "pairs")
    train, test = evaluate.train_test(pairs)
    ranked = keyed.global_rank(serve.popularity(train).withColumn("product_name", F.col("product_id")),
                               [F.col("n").desc(), F.col("product_id").asc()], "position")
    return serve.unseen_popular(shoppers, train, ranked, 5), test


METRIC = f"""(SELECT t.customer_id, n_rel, coalesce(h, 0) AS n_hits, coalesce(h, 0) / 5.0 AS precision, coalesce(h, 0) / n_rel AS recall,
    coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 6) r(i) WHERE i <= n_rel) AS ndcg
    FROM (SELECT customer_id, count(*) AS n_rel FROM {test_rows()} GROUP BY 1) t LEFT JOIN (
        SELECT customer_id, count(*) AS h, sum(1 / log2(rank + 1)) AS dcg FROM {{recs}} r JOIN {test_rows()} x USING (customer_id, product_id) GROUP BY 1) d USING (customer_id))"""
POPULAR_METRIC = METRIC.format(recs=POPULAR)


@query("join_hits", "shoppers", "pairs", sql=f"""
    SELECT customer_id, product_id, rank, CASE WHEN t.product_id IS NULL THEN 0 ELSE 1 END AS hit
    FROM {POPULAR} r LEFT JOIN {test_rows()} t USING (customer_id, product_id)""")
def join_hits(spark, sf):
    recs, test = popular_list(spark, sf)
    return evaluate.hits(recs, test).select("customer_id", "product_id", "rank", "hit")


def _metric_query(key, column):
    @query(key, "shoppers", "pairs", sql=f"SELECT customer_id, round({column}, 6) AS {column} FROM {POPULAR_METRIC}")
    def run(spark, sf):
        recs, test = popular_list(spark, sf)
        return evaluate.customer_metrics(recs, test).select("customer_id", F.round(column, 6).alias(column))


_metric_query("precision_at_k", "precision")
_metric_query("recall_at_k", "recall")
_metric_query("ndcg_at_k", "ndcg")


@query("evaluate_customers", "shoppers", "pairs", sql=f"""
    SELECT count(*) AS customers, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM {POPULAR_METRIC}""")
def evaluate_customers(spark, sf):
    recs, test = popular_list(spark, sf)
    m = evaluate.mean_metrics(evaluate.customer_metrics(recs, test))
    return m.select("customers", *[F.round(c, 6).alias(c) for c in evaluate.METRICS])


@query("segment_assign", "shoppers", sql="""
    SELECT customer_id, CASE WHEN c_acctbal <= (SELECT median(c_acctbal) FROM shoppers) THEN 'newer' ELSE 'established' END AS by_median,
           CASE WHEN lower(c_mktsegment) = 'building' THEN 'home' ELSE 'other' END AS by_category FROM shoppers""")
def segment_assign(spark, sf):
    df = one(spark, sf, "shoppers")
    a = evaluate.segment_of(df, Segmentation("c_acctbal")).withColumnRenamed("segment", "by_median")
    b = evaluate.segment_of(df, Segmentation("c_mktsegment", "categorical", category_value="Building", lower_label="home", upper_label="other"))
    return a.join(b.withColumnRenamed("segment", "by_category"), "customer_id")


@query("segment_history_assign", "shoppers", "pairs", sql=f"""
    SELECT customer_id, CASE WHEN count(t.product_id) <= 30 THEN 'newer' ELSE 'established' END AS segment
    FROM shoppers LEFT JOIN {TRAIN} t USING (customer_id) GROUP BY 1""")
def segment_history_assign(spark, sf):
    """The threshold is raised from 2 to 30 so that both segments occur in this data."""
    shoppers, pairs = inputs(spark, sf, "shoppers", "pairs")
    return evaluate.history_segment(shoppers, evaluate.train_test(pairs)[0], 30)


BOTH = "(" + " UNION ALL ".join(
    f"SELECT *, '{m}' AS model FROM {METRIC.format(recs=f'(SELECT * FROM lists WHERE model = {chr(39)}{m}{chr(39)})')}" for m in ("popular", "content")) + ")"


@query("segment_metrics", "shoppers", "bought", "pairs", sql=f"""
    WITH lists AS MATERIALIZED {RECS},
    s AS (SELECT customer_id, CASE WHEN c_acctbal <= (SELECT median(c_acctbal) FROM shoppers) THEN 'newer' ELSE 'established' END AS segment FROM shoppers),
    m AS (SELECT segment, model, count(*) AS customers, avg(precision) AS precision, avg(recall) AS recall, avg(ndcg) AS ndcg FROM {BOTH} b JOIN s USING (customer_id) GROUP BY 1, 2)
    SELECT segment, model, customers, round(precision, 6) AS precision, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg,
        row_number() OVER (PARTITION BY segment ORDER BY round(ndcg, 9) DESC, model) = 1 AS is_winner FROM m""")
def segment_metrics(spark, sf):
    _, test, lists = two_models(spark, sf)
    per = evaluate.customer_metrics(lists, test, models=("popular", "content"))
    out = evaluate.segment_metrics(per, evaluate.segment_of(one(spark, sf, "shoppers"), Segmentation("c_acctbal")))
    return out.select("segment", "model", "customers", *[F.round(c, 6).alias(c) for c in evaluate.METRICS], "is_winner")


@query("leaderboard", "shoppers", "bought", "pairs", sql=f"""
    WITH lists AS MATERIALIZED {RECS}, m AS (SELECT model, avg(precision) AS precision, avg(recall) AS recall, avg(ndcg) AS ndcg FROM {BOTH} GROUP BY 1)
    SELECT k.model, round(precision, 6) AS precision, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, coalesce(model_status, 'done') AS status, k.model = 'popular' AS is_winner
    FROM (VALUES ('popular', NULL), ('content', NULL), ('hybrid', 'failed'), ('ranking', NULL)) k(model, model_status) LEFT JOIN m USING (model)""")
def leaderboard(spark, sf):
    _, test, lists = two_models(spark, sf)
    per = evaluate.customer_metrics(lists, test, models=("popular", "content"))
    known = spark.createDataFrame([("popular", None), ("content", None), ("hybrid", "failed"), ("ranking", None)], "model string, model_status string")
    board = evaluate.leaderboard(known, evaluate.mean_metrics(per, "model"), F.lit("completed"), F.lit("popular"))
    return board.select("model", *[F.round(c, 6).alias(c) for c in evaluate.METRICS], "status", "is_winner")


@query("qualitative_examples", "shoppers", "bought", "pairs", "shelf", sql=f"""
    WITH lists AS MATERIALIZED {RECS}, chosen AS (SELECT DISTINCT customer_id FROM {test_rows()} ORDER BY 1 LIMIT 3),
    own AS (SELECT customer_id, string_agg(DISTINCT product_name, ', ' ORDER BY product_name) AS owned FROM {TRAIN} JOIN shelf USING (product_id) WHERE customer_id IN (FROM chosen) GROUP BY 1),
    held AS (SELECT customer_id, string_agg(DISTINCT product_name, ', ' ORDER BY product_name) AS held_out FROM {test_rows()} JOIN shelf USING (product_id) GROUP BY 1),
    rec AS (SELECT customer_id, model, string_agg(product_name, ', ' ORDER BY rank) AS recommended FROM lists JOIN shelf USING (product_id) GROUP BY 1, 2)
    SELECT customer_id, c_acctbal, c_mktsegment, owned, held_out, model, recommended FROM chosen JOIN shoppers USING (customer_id) LEFT JOIN own USING (customer_id)
        LEFT JOIN held USING (customer_id) LEFT JOIN rec USING (customer_id)""")
def qualitative_examples(spark, sf):
    shoppers, shelf = inputs(spark, sf, "shoppers", "shelf")
    train, test, lists = two_models(spark, sf, first=3)
    return evaluate.examples(shoppers.select("customer_id", "c_acctbal", "c_mktsegment"), train, test, lists, shelf, 3)


# ---- encoding and the content model -----------------------------------------------------------

@query("encode_one_hot", "shoppers", sql="""
    SELECT customer_id, c_acctbal AS customer_c_acctbal, c_name AS customer_c_name, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS customer_c_mktsegment_building,
           CAST(c_mktsegment = 'FURNITURE' AS INTEGER) AS customer_c_mktsegment_furniture FROM shoppers""")
def encode_one_hot(spark, sf):
    from shelfwise.config import Feature

    features = (Feature("c_acctbal"), Feature("c_name", "categorical"), Feature("absent"),
                Feature("c_mktsegment", "categorical", ("BUILDING", "FURNITURE"), "one_hot"))
    return encode.encode(one(spark, sf, "shoppers"), features, ["customer_id"], "customer_")


@query("infer_feature_specs", "shelf", sql="""
    SELECT 'price' AS column_name, 'numeric' AS dtype, CAST(NULL AS VARCHAR) AS value
    UNION ALL SELECT DISTINCT 'brand', 'categorical', brand FROM shelf WHERE brand IS NOT NULL
    UNION ALL SELECT DISTINCT 'category', 'categorical', category FROM shelf WHERE category IS NOT NULL""")
def infer_feature_specs(spark, sf):
    return encode.infer_features(one(spark, sf, "shelf"), ["price", "brand", "category"])


@query("standard_scale", "shoppers", sql=f"SELECT customer_id, round(f0, 6) AS c_acctbal, round(f1, 6) AS c_nationkey FROM {VEC}")
def standard_scale(spark, sf):
    df = encode.standard_scale(one(spark, sf, "shoppers"), NUMERIC, ["customer_id"])
    return df.select("customer_id", *[F.round(c, 6).alias(c) for c in NUMERIC])


@query("dummy_encode", "shoppers", sql=f"SELECT customer_id, {', '.join(f'{f} AS c_mktsegment_{s}' for f, s in zip(DIMS[2:], SEGMENTS))} FROM {VEC}")
def dummy_encode(spark, sf):
    df = one(spark, sf, "shoppers")
    return df.select("customer_id", *[e.alias(n) for n, e in encode.dummy_columns(encode.vocabulary(df, CATEGORICAL)).items()])


@query("content_based_fit", "shoppers", "bought", sql=f"""
    SELECT 'customer' AS side, customer_id AS id, {', '.join(f'round({f}, 6) AS {f}' for f in DIMS)} FROM {VEC}
    UNION ALL SELECT 'product', product_id, {', '.join(f'round({f}, 6)' for f in DIMS)} FROM {PROFILES}""")
def content_based_fit(spark, sf):
    model = content_model(spark, sf)
    both = model.vectors.select(F.lit("customer").alias("side"), F.col("customer_id").alias("id"), "vec").unionByName(
        model.profiles.select(F.lit("product").alias("side"), F.col("product_id").alias("id"), "vec"))
    return both.select("side", "id", *[F.round(F.get("vec", F.lit(i)), 6).alias(f) for i, f in enumerate(DIMS)])


@query("content_based_topk", "shoppers", "bought", sql=f"SELECT customer_id, product_id, round(score, 6) AS score, rank FROM {CONTENT} WHERE rank <= 5")
def content_based_topk(spark, sf):
    out = content.top_products(content_model(spark, sf), 5)
    return out.select("customer_id", "product_id", F.round("score", 6).alias("score"), "rank")
