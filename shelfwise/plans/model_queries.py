"""Collaborative, hybrid and learned ranking, the tournament, and the run over all tenants."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.config import Feature
from shelfwise.operators import cleaning, content, evaluate, factors, ranking
from shelfwise.plans import sqltext as q
from shelfwise.plans.core_queries import CATEGORICAL, CONTENT, NUMERIC, SEGMENTS, content_model
from shelfwise.plans.registry import query
from shelfwise.plans.roles import inputs, one
from shelfwise.plans.tenant_run import MODELS, run_tenants, score_models

CUSTOMER_FEATURES = (Feature("c_acctbal"), Feature("c_nationkey"), Feature("c_mktsegment", "categorical", SEGMENTS, "one_hot"))
PRODUCT_FEATURES = (Feature("price"), Feature("category", "categorical", ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"), "one_hot"))


@query("cf_interaction_matrix", "bought", sql="SELECT customer_id, product_id, count(*) AS cnt FROM bought GROUP BY 1, 2")
def cf_interaction_matrix(spark, sf):
    return factors.interaction_matrix(one(spark, sf, "bought"))


@query("cf_gram", "bought", sql="""
    WITH x AS (SELECT customer_id, product_id, count(*) AS cnt FROM bought GROUP BY 1, 2)
    SELECT a.product_id, CAST(sum(a.cnt * b.cnt) FILTER (a.product_id = b.product_id) AS BIGINT) AS self_weight,
           CAST(sum(a.cnt * b.cnt) AS BIGINT) AS total_weight FROM x a JOIN x b USING (customer_id) GROUP BY 1""")
def cf_gram(spark, sf):
    """Diagonal and row sums of the item-item matrix; the twin builds it entry by entry."""
    return factors.gram_summary(factors.interaction_matrix(one(spark, sf, "bought")))


@query("cf_svd_fit")
def cf_svd_fit(spark, sf):
    model = factors.svd_fit(one(spark, sf, "bought"), 5)
    return model.products.select("product_id", *[F.get("vec", F.lit(i)).alias(f"v{i}") for i in range(model.rank)])


@query("cf_topk")
def cf_topk(spark, sf):
    return factors.top_products(factors.svd_fit(one(spark, sf, "bought"), 5), 5)


@query("hybrid_blend")
def hybrid_blend(spark, sf):
    closest = content.top_products(content_model(spark, sf), 10)
    collaborative = factors.top_products(factors.svd_fit(one(spark, sf, "bought"), 20), 10)
    return factors.hybrid(closest, collaborative, 5)


# the leading factor by plain power iteration; it has no negative entry and lies far from the next one
LEADING = """
    cells AS MATERIALIZED (SELECT customer_id, product_id, count(*) AS cnt FROM bought GROUP BY 1, 2),
    power AS (SELECT 0 AS step, product_id, CAST(1 AS DOUBLE) AS v FROM (SELECT DISTINCT product_id FROM cells)
        UNION ALL
        SELECT step, product_id, s / sqrt(sum(s * s) OVER ()) FROM (
            SELECT step + 1 AS step, c.product_id, sum(c.cnt * u) AS s FROM cells c JOIN (
                SELECT step, customer_id, sum(cnt * v) AS u FROM power JOIN cells USING (product_id) WHERE step < 60 GROUP BY 1, 2) USING (customer_id) GROUP BY 1, 2)),
    factor AS (SELECT product_id, v FROM power WHERE step = 60),
    people AS (SELECT customer_id, sum(cnt * v) AS u FROM cells JOIN factor USING (product_id) GROUP BY 1),
    led AS (SELECT customer_id, product_id, round(score, 9) AS score, row_number() OVER (PARTITION BY customer_id ORDER BY round(score, 9) DESC, product_id) AS rank FROM (
        SELECT customer_id, f.product_id, u * v AS score FROM people, factor f) s
        WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.customer_id = s.customer_id AND c.product_id = s.product_id))"""


def leading_factor(spark, sf):
    return factors.svd_fit(one(spark, sf, "bought"), 1, tolerance=1e-11)


@query("cf_svd_leading", "bought", sql=f"WITH RECURSIVE {LEADING.strip()} SELECT product_id, round(v, 7) AS v0 FROM factor")
def cf_svd_leading(spark, sf):
    """The first factor alone, where plain SQL can follow."""
    return leading_factor(spark, sf).products.select("product_id", F.round(F.abs(F.get("vec", F.lit(0))), 7).alias("v0"))


@query("cf_topk_leading", "bought", sql=f"WITH RECURSIVE {LEADING.strip()} SELECT customer_id, product_id, round(score, 6) AS score, rank FROM led WHERE rank <= 5")
def cf_topk_leading(spark, sf):
    out = factors.top_products(leading_factor(spark, sf), 5)
    return out.select("customer_id", "product_id", F.round("score", 6).alias("score"), "rank")


@query("hybrid_blend_leading", "shoppers", "bought", sql=f"""
    WITH RECURSIVE {LEADING.strip()}, near AS (SELECT customer_id, product_id, rank FROM {CONTENT} WHERE rank <= 10),
    s AS (SELECT customer_id, product_id, sum(points) AS score FROM (
        SELECT customer_id, product_id, 0.5 * (count(*) OVER (PARTITION BY customer_id) - rank + 1) AS points FROM near
        UNION ALL SELECT customer_id, product_id, 0.5 * (count(*) OVER (PARTITION BY customer_id) - rank + 1) FROM led WHERE rank <= 10) GROUP BY 1, 2)
    SELECT customer_id, product_id, CAST(score AS DOUBLE) AS score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, product_id) AS rank FROM s) WHERE rank <= 5""")
def hybrid_blend_leading(spark, sf):
    """The hybrid of content and collaborative lists with one factor."""
    return factors.hybrid(content.top_products(content_model(spark, sf), 10), factors.top_products(leading_factor(spark, sf), 10), 5)


@query("rank_blend_generic", "shoppers", "bought", sql=f"""
    WITH p AS (SELECT customer_id, product_id, row_number() OVER (PARTITION BY customer_id ORDER BY sum(weight) DESC, product_id) AS rank FROM bought GROUP BY 1, 2),
    c AS (SELECT customer_id, product_id, rank FROM {CONTENT} WHERE rank <= 10), b AS (SELECT * FROM p WHERE rank <= 10),
    s AS (SELECT customer_id, product_id, sum(points) AS score FROM (
        SELECT customer_id, product_id, 0.5 * (count(*) OVER (PARTITION BY customer_id) - rank + 1) AS points FROM c
        UNION ALL SELECT customer_id, product_id, 0.5 * (count(*) OVER (PARTITION BY customer_id) - rank + 1) FROM b) GROUP BY 1, 2)
    SELECT customer_id, product_id, CAST(score AS DOUBLE) AS score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, product_id) AS rank FROM s) WHERE rank <= 5""")
def rank_blend_generic(spark, sf):
    from shelfwise.operators.keyed import by_score, top_per_key

    closest = content.top_products(content_model(spark, sf), 10).select("customer_id", "product_id", "rank")
    weights = one(spark, sf, "bought").groupBy("customer_id", "product_id").agg(F.sum("weight").alias("score"))
    heavy = top_per_key(weights, ["customer_id"], by_score(), 10).select("customer_id", "product_id", "rank")
    return factors.blend([(closest, 0.5), (heavy, 0.5)], 5)


SAMPLED = f"""(WITH known AS (SELECT DISTINCT customer_id, product_id FROM bought),
    pos AS (SELECT * FROM known WHERE product_id IN (SELECT product_id FROM {q.ACTIVE_SHELF}) AND customer_id IN (SELECT customer_id FROM shoppers)),
    num AS (SELECT product_id AS pick, row_number() OVER (ORDER BY product_id) AS position FROM {q.ACTIVE_SHELF}),
    draw AS (SELECT customer_id, product_id, t, CAST('0x' || substr(md5('42|' || customer_id || '|' || product_id || '|' || t), 1, 13) AS BIGINT) % (SELECT count(*) FROM num) + 1 AS position
             FROM pos CROSS JOIN range(1, 6) r(t)),
    free AS (SELECT d.customer_id, d.product_id, d.t, n.pick FROM draw d JOIN num n USING (position)
             WHERE (d.customer_id, n.pick) NOT IN (SELECT customer_id, product_id FROM known))
    SELECT customer_id, product_id, 1 AS target FROM pos
    UNION ALL SELECT customer_id, arg_min(pick, t), 0 FROM free GROUP BY customer_id, product_id)"""


def sampled(spark, sf):
    shoppers, bought, shelf = inputs(spark, sf, "shoppers", "bought", "shelf")
    return ranking.sampled_pairs(shoppers, cleaning.active_catalog(shelf), bought, max_positives=None)


@query("negative_sampling", "shoppers", "bought", "shelf", sql=f"SELECT * FROM {SAMPLED}")
def negative_sampling(spark, sf):
    return sampled(spark, sf)


@query("candidate_training_frame", "shoppers", "bought", "shelf", sql=f"""
    SELECT s.customer_id, s.product_id, target, c_acctbal AS customer_c_acctbal, c_nationkey AS customer_c_nationkey,
        {', '.join(f"CAST(c_mktsegment = '{x}' AS DOUBLE) AS customer_c_mktsegment_{x.lower()}" for x in SEGMENTS)},
        coalesce(price, 0) AS product_price, {', '.join(f"coalesce(CAST(category = '{x}' AS DOUBLE), 0) AS product_category_{x.lower()}" for x in PRODUCT_FEATURES[1].allowed)}
    FROM {SAMPLED} s JOIN shoppers USING (customer_id) JOIN {q.ACTIVE_SHELF} a ON a.product_id = s.product_id""")
def candidate_training_frame(spark, sf):
    shoppers, shelf = inputs(spark, sf, "shoppers", "shelf")
    left = ranking.encoded_side(shoppers, CUSTOMER_FEATURES, "customer_id", "customer_")
    right = ranking.encoded_side(cleaning.active_catalog(shelf), PRODUCT_FEATURES, "product_id", "product_")
    return ranking.training_frame(sampled(spark, sf), left, right)


def ranking_model(spark, sf, trees=100):
    shoppers, bought, shelf = inputs(spark, sf, "shoppers", "bought", "shelf")
    return ranking.fit(shoppers, cleaning.active_catalog(shelf), bought, CUSTOMER_FEATURES, PRODUCT_FEATURES, trees=trees)


@query("ranking_fit")
def ranking_fit(spark, sf):
    """Probability of every bought pair under trees fitted on the sampled pairs."""
    model = ranking_model(spark, sf)
    return ranking.score_pairs(model, model.known)


@query("ranking_topk")
def ranking_topk(spark, sf):
    return ranking.top_products(ranking_model(spark, sf), 5)


@query("model_tournament")
def model_tournament(spark, sf):
    """All four models on the training rows, measured on the held-out ones."""
    shoppers, pairs, shelf = inputs(spark, sf, "shoppers", "pairs", "shelf")
    train, test = evaluate.train_test(pairs)
    return score_models(shoppers, cleaning.active_catalog(shelf), train, test, NUMERIC, CATEGORICAL, PRODUCT_FEATURES)


def trained_tenants(spark, sf, models):
    shoppers, bought, shelf = inputs(spark, sf, "shoppers", "bought", "shelf")
    facts = bought.join(shoppers.select("customer_id", "tenant_id"), "customer_id").select("tenant_id", "customer_id", "product_id")
    return run_tenants(shoppers, shelf, facts, NUMERIC, CATEGORICAL, PRODUCT_FEATURES, models=models, n=5)


@query("train_all_tenants")
def train_all_tenants(spark, sf):
    """Content against collaborative model per tenant; lists of the winner for all customers."""
    return trained_tenants(spark, sf, ("content", "collaborative")).lists


@query("run_pipeline_all_tenants")
def run_pipeline_all_tenants(spark, sf):
    """Split, fit all four models, measure and refit the winner per tenant; its lists for all customers."""
    return trained_tenants(spark, sf, MODELS).lists


@query("tenant_trained_products", "shelf", "shoppers", "bought", sql=f"""
    SELECT tenant_id, product_id FROM (SELECT DISTINCT tenant_id FROM shoppers) CROSS JOIN {q.ACTIVE_SHELF}
    UNION SELECT DISTINCT tenant_id, product_id FROM bought JOIN shoppers USING (customer_id) WHERE product_id NOT IN (SELECT product_id FROM shelf)""")
def tenant_trained_products(spark, sf):
    """The products that each tenant's winner knows."""
    return trained_tenants(spark, sf, ("content",)).trained


# tenant-wise split, scaled content profiles, nearest products and their metrics, written out in SQL
TENANT_CONTENT = f"""
    own AS (SELECT DISTINCT tenant_id, tenant_id || chr(31) || customer_id AS customer_id, tenant_id || chr(31) || product_id AS product_id
            FROM bought JOIN shoppers USING (customer_id)),
    drawn AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY md5('42|' || customer_id || '|' || product_id), product_id) AS r,
              count(*) OVER (PARTITION BY customer_id) AS n FROM own),
    flagged AS (SELECT *, r <= CASE WHEN n <= 1 THEN 1 ELSE least(2, n - 1) END AS test FROM drawn),
    people AS (SELECT tenant_id || chr(31) || customer_id AS customer_id, tenant_id,
        CASE WHEN d0 > 0 THEN (x0 - m0) / d0 ELSE x0 - m0 END AS f0, CASE WHEN d1 > 0 THEN (x1 - m1) / d1 ELSE x1 - m1 END AS f1,
        {", ".join(f"CAST(coalesce(c_mktsegment = '{x}', FALSE) AS DOUBLE) AS f{i + 2}" for i, x in enumerate(SEGMENTS))}
        FROM (SELECT *, coalesce(c_acctbal, 0) AS x0, coalesce(c_nationkey, 0) AS x1 FROM shoppers) JOIN (
            SELECT tenant_id, avg(coalesce(c_acctbal, 0)) AS m0, stddev_pop(coalesce(c_acctbal, 0)) AS d0, avg(coalesce(c_nationkey, 0)) AS m1,
                   stddev_pop(coalesce(c_nationkey, 0)) AS d1 FROM shoppers GROUP BY 1) USING (tenant_id)),
    profiles AS (SELECT product_id, f.tenant_id, {", ".join(f"avg(f{i}) AS f{i}" for i in range(7))} FROM flagged f JOIN people p USING (customer_id) WHERE NOT test GROUP BY 1, 2),
    offered AS (SELECT p.* FROM profiles p WHERE split_part(product_id, chr(31), 2) IN (SELECT product_id FROM {q.ACTIVE_SHELF})
                OR split_part(product_id, chr(31), 2) NOT IN (SELECT product_id FROM shelf)),
    near AS (SELECT customer_id, product_id, tenant_id, row_number() OVER (PARTITION BY customer_id ORDER BY round(score, 9) DESC, product_id) AS rank FROM (
        SELECT a.customer_id, b.product_id, a.tenant_id, ({" + ".join(f"a.f{i} * b.f{i}" for i in range(7))})
            / sqrt({" + ".join(f"a.f{i} * a.f{i}" for i in range(7))}) / sqrt({" + ".join(f"b.f{i} * b.f{i}" for i in range(7))}) AS score
        FROM people a JOIN offered b ON a.tenant_id = b.tenant_id) QUALIFY rank <= 5),
    held AS (SELECT tenant_id, customer_id, product_id, count(*) OVER (PARTITION BY customer_id) AS relevant FROM flagged WHERE test),
    per AS (SELECT h.tenant_id, h.customer_id, any_value(relevant) AS relevant, count(rank) AS hits, coalesce(sum(1 / log2(rank + 1)), 0) AS dcg
        FROM held h LEFT JOIN near USING (customer_id, product_id) GROUP BY 1, 2)"""


@query("tenant_model_scores", "shoppers", "bought", "shelf", sql=f"""
    WITH {TENANT_CONTENT.strip()}
    SELECT tenant_id, 'content' AS model, count(*) AS customers, round(avg(hits / 5), 4) AS precision, round(avg(hits / relevant), 4) AS recall,
        round(avg(dcg / CASE relevant WHEN 1 THEN 1 ELSE 1 + 1 / log2(3) END), 4) AS ndcg, 'completed' AS status, TRUE AS is_winner FROM per GROUP BY 1""")
def tenant_model_scores(spark, sf):
    """Split, content model, evaluation and winner of every tenant; the twin writes the whole run out in SQL."""
    return trained_tenants(spark, sf, ("content",)).scores
