"""Product similarity, catalogue maintenance, feeds and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import catalog as cat, cleaning, serve, similarity as sim
from shelfwise.plans import sqltext as q
from shelfwise.plans.core_queries import active
from shelfwise.plans.ingest_queries import SPEC_ROWS
from shelfwise.plans.registry import query
from shelfwise.plans.roles import inputs, one
from shelfwise.sources import audit, catalog_store, feeds

STOP = ("by", "for", "made", "use")
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)

# ---- feature blocks ---------------------------------------------------------------------------

A = q.ACTIVE_SHELF
# parsed specifications, then the one numeric column that catalogues do not have in common
SPECS = f"(SELECT product_id, k, v, pos FROM {SPEC_ROWS.format(source=A)} UNION ALL SELECT product_id, 'p_partkey', CAST(product_id AS DOUBLE), 100 FROM {A})"
GRP = "coalesce(lower(category), '__general__')"


def scaled(x):
    return f"CASE WHEN hi > lo THEN ({x} - lo) / (hi - lo) ELSE 0.5 END"


CATEGORY_SQL = f"(SELECT product_id, 'cat:' || lower(category) AS feature, sqrt(0.3) AS value FROM {A} WHERE category IS NOT NULL)"
BRAND_SQL = f"(SELECT product_id, 'brand:' || lower(brand) AS feature, sqrt(0.15) AS value FROM {A} WHERE brand IS NOT NULL)"
PRICE_SQL = f"""(SELECT product_id, feature, CASE feature WHEN 'price:0' THEN s ELSE 1 - s END * sqrt(0.05 / 2) AS value FROM (
    SELECT product_id, {scaled('ln(1 + price)')} AS s FROM (SELECT *, min(ln(1 + price)) OVER (PARTITION BY {GRP}) AS lo,
    max(ln(1 + price)) OVER (PARTITION BY {GRP}) AS hi FROM {A} WHERE price > 0)) CROSS JOIN (VALUES ('price:0'), ('price:1')) f(feature))"""
SPECS_SQL = f"""(SELECT product_id, 'spec:' || grp || '__' || k || ':' || side AS feature, CASE side WHEN 0 THEN s ELSE 1 - s END * sqrt(0.35 / 2) AS value FROM (
    SELECT product_id, grp, k, {scaled('v')} AS s FROM (SELECT *, min(v) OVER (PARTITION BY grp, k) AS lo, max(v) OVER (PARTITION BY grp, k) AS hi
    FROM {SPECS} r JOIN (SELECT product_id, {GRP} AS grp FROM {A}) g USING (product_id))) CROSS JOIN (VALUES (0), (1)) f(side))"""
TEXT_SQL = f"""(WITH tok AS (SELECT product_id, unnest(regexp_extract_all(lower(trim(product_name || ' ' || coalesce(description, '') || ' ' || coalesce(tags, ''))), '\\b\\w\\w+\\b')) AS term FROM {A}),
    cnt AS (SELECT product_id, term, count(*) AS tf FROM tok WHERE term NOT IN ({STOP_SQL}) GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM cnt GROUP BY 1 ORDER BY total DESC, term LIMIT 2000),
    x AS (SELECT product_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM {A})) / (1 + df)) + 1) AS x FROM cnt JOIN df USING (term))
    SELECT product_id, 'text:' || term AS feature, x / sqrt(sum(x * x) OVER (PARTITION BY product_id)) * sqrt(0.15) AS value FROM x)"""
VECTORS = f"""(SELECT product_id, feature, value / sqrt(sum(value * value) OVER (PARTITION BY product_id)) AS value FROM (
    SELECT * FROM {CATEGORY_SQL} UNION ALL SELECT * FROM {BRAND_SQL} UNION ALL SELECT * FROM {PRICE_SQL} UNION ALL SELECT * FROM {SPECS_SQL}
    UNION ALL SELECT * FROM {TEXT_SQL}) WHERE value <> 0)"""


def _block_query(key, sql, build):
    @query(key, "shelf", sql=f"SELECT product_id, feature, round(value, 6) AS value FROM {sql}")
    def run(spark, sf):
        return build(active(spark, sf)).select("product_id", "feature", F.round("value", 6).alias("value"))


_block_query("sim_category_block", CATEGORY_SQL, lambda a: sim.category_block(a, 0.3))
_block_query("sim_brand_block", BRAND_SQL, lambda a: sim.brand_block(a, 0.15))
_block_query("sim_price_block", PRICE_SQL, lambda a: sim.price_block(a, 0.05))
_block_query("sim_specs_block", SPECS_SQL, lambda a: sim.specs_block(a, 0.35))
_block_query("sim_text_tfidf", TEXT_SQL, lambda a: sim.text_block(a, 0.15, STOP))


def vectors(spark, sf):
    return sim.unit_vectors(active(spark, sf), STOP)


@query("sim_feature_vectors", "shelf", sql=f"SELECT product_id, feature, round(value, 6) AS value FROM {VECTORS}")
def sim_feature_vectors(spark, sf):
    rows = vectors(spark, sf).select("product_id", F.explode(F.arrays_zip("feats", "vals")).alias("r"))
    return rows.select("product_id", F.col("r.feats").alias("feature"), F.round("r.vals", 6).alias("value"))


def matches_sql(k, same_category=True):
    where = "(a.category IS NULL OR a.category = b.category) AND" if same_category else ""
    return f"""(SELECT product_id, other_id, round(s, 4) AS similarity, rank FROM (
        SELECT product_id, other_id, s, row_number() OVER (PARTITION BY product_id ORDER BY round(s, 9) DESC, other_id) AS rank FROM (
            SELECT a.product_id, b.product_id AS other_id, coalesce(s, 0) AS s FROM {A} a JOIN {A} b ON {where} a.product_id <> b.product_id
                AND (coalesce(a.price, 0) <= 0 OR coalesce(b.price, 0) <= 0 OR (b.price >= a.price / 2 AND b.price <= a.price * 2))
            LEFT JOIN (SELECT x.product_id, y.product_id AS other_id, sum(x.value * y.value) AS s FROM vec x JOIN vec y ON x.feature = y.feature
                       GROUP BY 1, 2) d ON d.product_id = a.product_id AND d.other_id = b.product_id)) WHERE rank <= {k})"""


@query("sim_topk_same_category", "shelf", sql=f"""
    WITH vec AS MATERIALIZED (SELECT * FROM {VECTORS}) SELECT * FROM {matches_sql(4)}""")
def sim_topk_same_category(spark, sf):
    return sim.top_similar(vectors(spark, sf), 4)


@query("sim_topk_global", "shelf", sql=f"""
    WITH vec AS MATERIALIZED (SELECT * FROM {VECTORS}) SELECT * FROM {matches_sql(4, same_category=False)}""")
def sim_topk_global(spark, sf):
    return sim.top_similar(vectors(spark, sf), 4, same_category=False)


@query("sim_dense_topk", "embeddings", sql="""
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings)
    SELECT vec_id, other_id, round(s, 5) AS score, rank FROM (
        SELECT vec_id, other_id, s, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, CAST(other_id AS VARCHAR)) AS rank FROM (
            SELECT a.vec_id, b.vec_id AS other_id, list_dot_product(a.v, b.v) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id)) WHERE rank <= 5""")
def sim_dense_topk(spark, sf):
    from shelfwise.operators.blocks import top_matches
    from shelfwise.operators.content import unit

    e = one(spark, sf, "embeddings")
    rows = e.select(F.col("vec_id").cast("string").alias("qid"), unit(F.col("embedding").cast("array<double>")).alias("vec"))
    dims = e.select(F.max(F.size("embedding")).alias("n")).first().n
    out = top_matches(rows, rows.withColumnRenamed("qid", "iid"), 5, dims, exclude=rows.select("qid", F.col("qid").alias("iid")))
    return out.select(F.col("qid").cast("bigint").alias("vec_id"), F.col("iid").cast("bigint").alias("other_id"), F.round("score", 5).alias("score"), "rank")


def word_set(c):
    return f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: w <> ''))"


REASONS = f"""(SELECT m.product_id, m.other_id, m.rank, m.similarity, list_filter([
        CASE WHEN t.category = c.category THEN 'Same category' END, CASE WHEN t.brand = c.brand THEN 'Same brand' END,
        CASE WHEN t.price > 0 AND c.price > 0 THEN CASE WHEN round(t.price - c.price) >= 1 THEN 'Lower price by ' || format('{{:,}}', CAST(round(t.price - c.price) AS BIGINT))
            WHEN round(t.price - c.price) <= -1 THEN 'Higher price by ' || format('{{:,}}', CAST(round(c.price - t.price) AS BIGINT)) ELSE 'Same price' END END,
        CASE WHEN ram >= 0.7 AND disk >= 0.7 THEN 'Similar RAM and storage' WHEN ram >= 0.7 THEN 'Similar RAM' WHEN disk >= 0.7 THEN 'Similar storage'
            WHEN ram IS NULL AND disk IS NULL AND size >= 0.75 THEN 'Similar size cm' WHEN ram IS NULL AND disk IS NULL AND weight >= 0.75 THEN 'Similar weight'
            WHEN ram IS NULL AND disk IS NULL AND number >= 0.75 THEN 'Similar p partkey' END], lambda x: x IS NOT NULL) AS why,
        len(list_intersect({word_set('t.description')}, {word_set('c.description')})) >= 3 AS described
    FROM m JOIN {A} t ON t.product_id = m.product_id JOIN {A} c ON c.product_id = m.other_id LEFT JOIN (
        SELECT product_id, other_id, max(r) FILTER (k = 'ram_gb') AS ram, max(r) FILTER (k = 'storage_gb') AS disk,
            max(r2) FILTER (k = 'size_cm') AS size, max(r2) FILTER (k = 'weight_g') AS weight, max(r2) FILTER (k = 'p_partkey') AS number FROM (
            SELECT m.product_id, m.other_id, x.k, least(x.v, y.v) / greatest(1e-6, greatest(x.v, y.v)) AS r, CASE WHEN greatest(x.v, y.v) > 0 THEN least(x.v, y.v) / greatest(x.v, y.v) END AS r2
            FROM m JOIN sp x ON x.product_id = m.product_id JOIN sp y ON y.product_id = m.other_id AND x.k = y.k) GROUP BY 1, 2) z ON z.product_id = m.product_id AND z.other_id = m.other_id)"""
WHY = "CASE WHEN len(why) < 2 AND described THEN list_append(why, 'Similar description') ELSE why END"


@query("sim_reasons", "shelf", sql=f"""
    WITH vec AS MATERIALIZED (SELECT * FROM {VECTORS}), m AS MATERIALIZED (SELECT * FROM {matches_sql(4)}), sp AS MATERIALIZED (SELECT * FROM {SPECS})
    SELECT product_id, other_id, CASE WHEN len({WHY}) = 0 THEN 'Similar attributes' ELSE array_to_string({WHY}, '; ') END AS reasons FROM {REASONS}""")
def sim_reasons(spark, sf):
    act = active(spark, sf)
    rows = sim.explained(sim.top_similar(vectors(spark, sf), 4), act)
    return rows.select("product_id", "other_id", F.array_join("reasons", "; ").alias("reasons"))


@query("sim_topup", "shelf", "bought", sql=f"""
    WITH pop AS (SELECT product_id, count(*) AS n FROM bought GROUP BY 1),
    c AS (SELECT t.product_id, a.product_id AS other_id, row_number() OVER (PARTITION BY t.product_id ORDER BY coalesce(n, 0) DESC, a.product_id) AS rank
        FROM (SELECT * FROM shelf WHERE NOT {q.ACTIVE}) t JOIN {A} a ON (t.category IS NULL OR lower(t.category) = lower(a.category)) AND a.product_id <> t.product_id
        LEFT JOIN pop ON pop.product_id = a.product_id)
    SELECT product_id, other_id, rank FROM c WHERE rank <= 4""")
def sim_topup(spark, sf):
    """Popular products in place of similar ones for every archived product."""
    shelf, bought = inputs(spark, sf, "shelf", "bought")
    return sim.popular_fill(shelf.where(~cleaning.is_active()), active(spark, sf), serve.popularity(bought), 4)


LABELS = "CASE k WHEN 'ram_gb' THEN 'RAM (GB)' WHEN 'storage_gb' THEN 'Storage (GB)' WHEN 'weight_g' THEN 'Weight (g)' WHEN 'size_cm' THEN 'Size Cm' WHEN 'p_partkey' THEN 'P Partkey' END"


@query("sim_result_rows", "shelf", "bought", "clicks", sql=f"""
    WITH vec AS MATERIALIZED (SELECT * FROM {VECTORS}), m AS MATERIALIZED (SELECT * FROM {matches_sql(4)}), sp AS MATERIALIZED (SELECT * FROM {SPECS}),
    txt AS (SELECT product_id, string_agg({LABELS} || '=' || CAST(v AS BIGINT), ', ' ORDER BY pos) AS specs FROM sp GROUP BY 1),
    pop AS (SELECT product_id, count(*) AS n FROM bought GROUP BY 1),
    dead AS (SELECT product_id, category, price, 'inactive_product' AS reason FROM shelf WHERE NOT {q.ACTIVE}
             UNION ALL SELECT DISTINCT 'x' || trim(product_id), NULL, NULL, 'unknown_product' FROM clicks WHERE trim(product_id) <> ''),
    fill AS (SELECT d.product_id, a.product_id AS other_id, d.category, d.price, d.reason, row_number() OVER (PARTITION BY d.product_id ORDER BY coalesce(n, 0) DESC, a.product_id) AS rank
             FROM dead d JOIN {A} a ON (d.category IS NULL OR lower(d.category) = lower(a.category)) AND a.product_id <> d.product_id LEFT JOIN pop ON pop.product_id = a.product_id),
    r AS (SELECT product_id, other_id, rank, round(similarity, 2) AS similarity, CASE WHEN len({WHY}) = 0 THEN 'Similar attributes' ELSE array_to_string({WHY}, '; ') END AS reasons,
              (SELECT price FROM {A} t WHERE t.product_id = x.product_id) AS target, NULL AS reason FROM {REASONS} x
          UNION ALL SELECT product_id, other_id, rank, 0, CASE WHEN category IS NULL THEN 'Popular product' ELSE 'Popular in this category' END, price, reason FROM fill WHERE rank <= 4
          UNION ALL SELECT product_id, NULL, NULL, NULL, NULL, NULL, 'limited_product_data' FROM {A} WHERE product_id NOT IN (SELECT product_id FROM m))
    SELECT r.product_id, r.rank, r.other_id, c.product_name, c.category, c.brand, c.price, r.similarity, r.reasons, CASE WHEN r.other_id IS NOT NULL THEN coalesce(txt.specs, '') END AS specs, round(c.price - target, 2) AS price_diff,
        CASE WHEN target > 0 THEN round((c.price - target) / target * 100, 1) END AS price_diff_pct, reason AS fallback_reason
    FROM r LEFT JOIN {A} c ON c.product_id = r.other_id LEFT JOIN txt ON txt.product_id = r.other_id""")
def sim_result_rows(spark, sf):
    shelf, bought, clicks = inputs(spark, sf, "shelf", "bought", "clicks")
    unknown = clicks.where(F.trim("product_id") != "").select(F.concat(F.lit("x"), F.trim("product_id")).alias("product_id")).distinct()
    requests = shelf.select("product_id").unionByName(unknown)
    act = active(spark, sf)
    return sim.result_rows(requests, shelf, act, sim.top_similar(vectors(spark, sf), 4), serve.popularity(bought), 4)


# ---- catalogue maintenance --------------------------------------------------------------------

NOW = "2024-03-01"


@query("feed_upsert", "shelf", "upload", sql="""
    WITH f AS (SELECT trim(product_id) AS product_id, product_name, category FROM upload WHERE product_id IS NOT NULL
               QUALIFY row_number() OVER (PARTITION BY trim(product_id) ORDER BY row_num DESC) = 1)
    SELECT * FROM f UNION ALL SELECT product_id, product_name, category FROM shelf WHERE product_id NOT IN (SELECT product_id FROM f)""")
def feed_upsert(spark, sf):
    shelf, upload = inputs(spark, sf, "shelf", "upload")
    feed = upload.where("product_id is not null").select("row_num", "product_id", "product_name", "category")
    out = cat.feed_upsert(shelf.select("product_id", "product_name", "category"), feed, F.col("row_num"))
    return out.select("product_id", "product_name", "category")


@query("feed_counts", "shelf", "upload", sql="""
    WITH f AS (SELECT trim(product_id) AS product_id FROM upload WHERE product_id IS NOT NULL), d AS (SELECT DISTINCT product_id FROM f)
    SELECT (SELECT count(*) FROM f) AS fetched, (SELECT count(*) FROM d WHERE product_id IN (SELECT product_id FROM shelf)) AS updated,
        (SELECT count(*) FROM d WHERE product_id NOT IN (SELECT product_id FROM shelf)) AS added,
        (SELECT count(*) FROM (SELECT product_id FROM d UNION SELECT product_id FROM shelf)) AS total""")
def feed_counts(spark, sf):
    shelf, upload = inputs(spark, sf, "shelf", "upload")
    return cat.feed_counts(shelf, upload.where("product_id is not null"))


def commit_sql(replace):
    gone = "f.product_id IS NULL AND lower(s.status) = 'active'" if replace else "FALSE"
    return f"""SELECT product_id, coalesce(f.product_name, s.product_name) AS product_name, CASE WHEN f.product_id IS NOT NULL THEN f.price ELSE s.price END AS price,
        CASE WHEN f.product_id IS NOT NULL THEN 'active' WHEN {gone} THEN 'archived' ELSE s.status END AS status,
        CASE WHEN f.product_id IS NOT NULL THEN coalesce(CAST(trunc(try_cast(f.in_stock AS DOUBLE)) AS INTEGER), 1) ELSE try_cast(s.in_stock AS INTEGER) END AS in_stock,
        CASE WHEN f.product_id IS NULL THEN s.brand END AS brand, coalesce(s.created_at, '{NOW}') AS created_at,
        CASE WHEN f.product_id IS NOT NULL OR {gone} THEN '{NOW}' ELSE s.updated_at END AS updated_at
        FROM (SELECT *, product_id AS fid FROM {q.UPLOAD_OK}) f FULL JOIN shelf s USING (product_id)""".replace("f.product_id", "f.fid")


def _commit(spark, sf, replace):
    shelf, upload = inputs(spark, sf, "shelf", "upload")
    rows = cleaning.valid_upload(upload).select("product_id", "product_name", "category", "price", "in_stock")
    out = cat.commit_upload(shelf, rows, F.lit(NOW), replace)
    return out.select("product_id", "product_name", "price", "status", "in_stock", "brand", "created_at", "updated_at")


@query("commit_upsert", "shelf", "upload", sql=commit_sql(False))
def commit_upsert(spark, sf):
    return _commit(spark, sf, False)


@query("commit_replace", "shelf", "upload", sql=commit_sql(True))
def commit_replace(spark, sf):
    return _commit(spark, sf, True)


@query("bulk_archive_restore", "shelf", "clicks", sql=f"""
    WITH i AS (SELECT DISTINCT trim(product_id) AS product_id FROM clicks WHERE event_type = 'purchase')
    SELECT product_id, CASE WHEN i.product_id IS NOT NULL THEN 'archived' ELSE status END AS status, i.product_id IS NOT NULL AS affected,
        CASE WHEN i.product_id IS NOT NULL THEN '{NOW}' ELSE updated_at END AS updated_at FROM shelf LEFT JOIN (SELECT product_id, product_id AS p FROM i) i USING (product_id)""".replace("i.product_id IS", "i.p IS"))
def bulk_archive_restore(spark, sf):
    shelf, clicks = inputs(spark, sf, "shelf", "clicks")
    out = cat.bulk_status(shelf, clicks.where("event_type = 'purchase'"), "archived", F.lit(NOW))
    return out.select("product_id", "status", "affected", "updated_at")


@query("bulk_delete_archived", "shelf", "clicks", sql="""
    SELECT product_id, status FROM shelf WHERE NOT (lower(status) = 'archived' AND product_id IN (SELECT trim(product_id) FROM clicks))""")
def bulk_delete_archived(spark, sf):
    shelf, clicks = inputs(spark, sf, "shelf", "clicks")
    return cat.bulk_delete(shelf, clicks).select("product_id", "status")


CHANGES = """(SELECT CASE WHEN p_partkey % 10 = 0 THEN 'M' || p_partkey ELSE CAST(p_partkey AS STRING) END AS product_id,
    CASE p_partkey % 6 WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'archive' WHEN 3 THEN 'delete' WHEN 4 THEN 'restore' ELSE 'update' END AS action,
    CASE WHEN p_partkey % 21 = 1 THEN ' ' WHEN p_partkey % 2 = 0 THEN 'new ' || p_name ELSE CAST(NULL AS STRING) END AS product_name,
    CASE WHEN p_partkey % 22 = 1 THEN '' WHEN p_partkey % 4 = 0 OR p_partkey % 6 = 0 THEN ' LARGE ' ELSE CAST(NULL AS STRING) END AS category,
    CASE WHEN p_partkey % 25 = 0 THEN '-3' WHEN p_partkey % 26 = 1 THEN 'x' WHEN p_partkey % 3 = 1 THEN '12.50' ELSE CAST(NULL AS STRING) END AS price,
    CASE WHEN p_partkey % 27 = 1 THEN 'gone' WHEN p_partkey % 5 = 0 THEN 'Archived' ELSE CAST(NULL AS STRING) END AS status FROM {part})"""
OUTCOMES = f"""(SELECT ch.*, {q.price('ch.price')} AS pr, lower(trim(s.status)) AS now_status, s.product_id AS sid,
    CASE WHEN action = 'create' AND {q.nul('ch.product_name')} IS NULL THEN 'blank product_name' WHEN action = 'create' AND {q.nul('ch.category')} IS NULL THEN 'blank category'
        WHEN action = 'create' AND ch.price IS NOT NULL AND coalesce({q.price('ch.price')}, -1) < 0 THEN 'invalid price' WHEN action = 'create' AND s.product_id IS NOT NULL THEN 'duplicate'
        WHEN action <> 'create' AND s.product_id IS NULL THEN 'not found' WHEN action = 'update' AND trim(ch.product_name) = '' THEN 'blank product_name'
        WHEN action = 'update' AND trim(ch.category) = '' THEN 'blank category' WHEN action = 'update' AND ch.price IS NOT NULL AND coalesce({q.price('ch.price')}, -1) < 0 THEN 'invalid price'
        WHEN action = 'update' AND lower(ch.status) NOT IN ('active', 'archived') THEN 'invalid status' WHEN action = 'delete' AND lower(trim(s.status)) <> 'archived' THEN 'active product' END AS reason
    FROM {CHANGES.replace('{part}', 'part')} ch LEFT JOIN shelf s ON s.product_id = ch.product_id)"""


def _changes(spark, sf):
    part = one(spark, sf, "part")
    return spark.sql(f"SELECT * FROM {CHANGES}", part=part)


@query("product_changes_apply", "shelf", sql=f"""
    SELECT product_id, action, CASE WHEN reason IS NULL THEN 'applied' ELSE 'rejected' END AS outcome, reason FROM {OUTCOMES}""")
def product_changes_apply(spark, sf):
    return cat.change_outcomes(one(spark, sf, "shelf"), _changes(spark, sf)).select("product_id", "action", "outcome", "reason")


@query("product_changes_result", "shelf", sql=f"""
    WITH ok AS (SELECT * FROM {OUTCOMES} WHERE reason IS NULL)
    SELECT coalesce(s.product_id, k.product_id) AS product_id, coalesce(trim(k.product_name), s.product_name) AS product_name, coalesce(trim(k.category), s.category) AS category,
        coalesce(k.pr, s.price) AS price, CASE k.action WHEN 'archive' THEN 'archived' WHEN 'restore' THEN 'active' WHEN 'create' THEN 'active' ELSE coalesce(lower(k.status), s.status) END AS status,
        CASE WHEN k.product_id IS NOT NULL THEN '{NOW}' ELSE s.updated_at END AS updated_at
    FROM shelf s FULL JOIN ok k ON k.product_id = s.product_id WHERE k.action IS DISTINCT FROM 'delete'""")
def product_changes_result(spark, sf):
    out = cat.apply_changes(one(spark, sf, "shelf"), _changes(spark, sf), F.lit(NOW))
    return out.select("product_id", "product_name", "category", "price", "status", "updated_at")


@query("snapshot_and_undo", "shelf", sql="SELECT * FROM shelf")
def snapshot_and_undo(spark, sf):
    """Two commits and one undo: the result is the catalogue after the first commit."""
    from shelfwise.session import durable_path

    shelf, upload = inputs(spark, sf, "shelf", "upload")
    store = catalog_store.CatalogStore(spark, durable_path(spark, "catalog"))
    store.commit(shelf)
    rows = cleaning.valid_upload(upload).select("product_id", "product_name", "category", "price", "in_stock")
    store.commit(cat.commit_upload(shelf, rows, F.lit(NOW), replace=True))
    store.undo()
    return store.current()


@query("training_products", "shelf", sql=f"SELECT product_id, product_name, category, brand, price FROM shelf WHERE {q.ACTIVE}")
def training_products(spark, sf):
    return cat.training_products(one(spark, sf, "shelf"))


# ---- feeds and audit --------------------------------------------------------------------------

FEED_TWIN = f"""SELECT product_id, product_name, price, category FROM (
    SELECT 'P' || p_partkey AS product_id, CASE WHEN p_partkey % 3 = 0 THEN 'P' || p_partkey ELSE p_name END AS product_name,
        CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS price, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS category, p_partkey FROM part) WHERE p_partkey % 11 <> 0"""


@query("feed_json_parse", "part", sql=FEED_TWIN)
def feed_json_parse(spark, sf):
    """Feeds with different id, title and price fields under different roots, one document per product group."""
    part = one(spark, sf, "part")
    k = F.col("p_partkey")
    pid = F.when(k % 11 != 0, F.concat(F.lit("P"), k.cast("string")))
    title, price, kind = F.when(k % 3 != 0, F.col("p_name")), F.when(k % 7 != 0, F.concat(F.lit("$"), F.col("p_retailprice").cast("string"))), F.when(k % 4 != 0, F.col("p_type"))
    names = [("product_id", "title", "price", "product_type"), ("sku", "name", "sale_price", "category"), ("id", "product_name", "regular_price", "google_product_category")]
    item = F.lit(None).cast("string")
    for i, (a, b, c, d) in enumerate(names):
        item = F.when(k % 3 == i, F.to_json(F.struct(pid.alias(a), title.alias(b), price.alias(c), kind.alias(d)))).otherwise(item)
    # documents of at most 100 products
    docs = part.select(F.floor(k / 100).alias("doc"), item.alias("item")).groupBy("doc").agg(F.array_join(F.collect_list("item"), ",").alias("items"))
    root = F.when(F.col("doc") % 3 == 0, F.concat(F.lit("["), "items", F.lit("]"))).when(
        F.col("doc") % 3 == 1, F.concat(F.lit('{"products":['), "items", F.lit("]}"))).otherwise(F.concat(F.lit('{"catalog":['), "items", F.lit("]}")))
    return feeds.parse_json_feed(docs.select(root.alias("payload")), "payload")


@query("shop_json_flatten", "part", sql="""
    SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name, CASE WHEN p_partkey % 5 = 0 THEN 1.5 ELSE p_retailprice END AS price,
        CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS category FROM part WHERE p_partkey <> 0""")
def shop_json_flatten(spark, sf):
    part = one(spark, sf, "part")
    k = F.col("p_partkey")
    variants = F.when(k % 5 != 0, F.array(F.struct(F.col("p_retailprice").cast("string").alias("price")), F.struct(F.lit("0.1").alias("price"))))
    doc = F.to_json(F.struct(k.alias("id"), F.col("p_name").alias("title"), F.when(k % 4 != 0, F.col("p_type")).alias("product_type"),
                             F.lit("1.50").alias("price"), variants.alias("variants")))
    return feeds.parse_shop_products(part.select(doc.alias("payload")), "payload")


@query("feed_xml_parse", "part", sql=FEED_TWIN)
def feed_xml_parse(spark, sf):
    """RSS and Atom documents, one per product group."""
    part = one(spark, sf, "part")
    k = F.col("p_partkey")

    def tag(name, value):
        return F.coalesce(F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>")), F.lit(""))

    pid = F.when(k % 11 != 0, F.concat(F.lit("P"), k.cast("string")))
    title, price, kind = F.when(k % 3 != 0, F.col("p_name")), F.when(k % 7 != 0, F.concat(F.col("p_retailprice").cast("string"), F.lit(" USD"))), F.when(k % 4 != 0, F.col("p_type"))
    doc = F.floor(k / 100)
    # a nested price is not the product's; names come with a numeric entity and as CDATA
    nested, plain = F.lit("<g:shipping><g:price>3 USD</g:price></g:shipping>"), title
    title = F.when(k % 2 == 0, F.concat(F.lit("<![CDATA["), plain, F.lit("]]>"))).otherwise(F.concat(F.lit("&#x"), F.lower(F.hex(F.ascii(plain))), F.lit(";"), F.substring(plain, F.lit(2), F.length(plain))))
    rss = F.concat(F.lit("<item>"), nested, tag("g:id", pid), tag("title", title), tag("g:price", price), tag("g:product_type", kind), F.lit("</item>"))
    atom = F.concat(F.lit("<entry>"), tag("id", pid), tag("g:title", title), tag("price", price), tag("category", kind), F.lit("</entry>"))
    docs = part.select(doc.alias("doc"), F.when(doc % 2 == 0, rss).otherwise(atom).alias("item")).groupBy("doc").agg(F.array_join(F.collect_list("item"), "").alias("items"))
    head = '<rss xmlns:g="http://base.google.com/ns/1.0" version="2.0"><channel>'
    xml = F.when(F.col("doc") % 2 == 0, F.concat(F.lit(head), "items", F.lit("</channel></rss>"))).otherwise(
        F.concat(F.lit('<feed xmlns:g="http://base.google.com/ns/1.0">'), "items", F.lit("</feed>")))
    return feeds.parse_xml_feed(docs.select(xml.alias("payload")), "payload")


@query("audit_history", "shelf", sql="""
    SELECT 'bulk_archive' AS action, brand AS who, count(*) AS product_ids_count, least(100, count(*)) AS kept FROM shelf WHERE brand IS NOT NULL GROUP BY brand
    ORDER BY brand DESC LIMIT 10""")
def audit_history(spark, sf):
    """One mutation per brand, written as audit records; the ten newest are read back."""
    from shelfwise.session import durable_path

    shelf = one(spark, sf, "shelf").where("brand is not null")
    path = durable_path(spark, "audit")
    rows = shelf.select(F.lit("t").alias("tenant_id"), F.col("brand").alias("who"), F.concat(F.lit("2024-03-01T"), "brand").alias("when"),
                        F.lit("bulk_archive").alias("action"), "product_id")
    audit.append(audit.records(rows), path)
    return audit.history(spark, path, "t", 10).select("action", "who", "product_ids_count", F.size("product_ids").alias("kept"))
