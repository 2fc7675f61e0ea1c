import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from shelfwise.config import Feature
from shelfwise.operators import blocks, content, factors, ranking
from shelfwise.plans import tenant_run
from shelfwise.session import durable_dir


def test_content_keeps_owned(make):
    customers = make("customer_id string, tenure int, charge double, contract string", ("c1", 12, 70.0, "Month-to-month"), ("c2", 24, 90.0, "One year"))
    inter = make("customer_id string, product_id string", ("c1", "p1"), ("c2", "p2"), ("c1", "p2"))
    model = content.fit(customers, inter, ["tenure", "charge"], ["contract"])
    assert rows(model.profiles, "product_id") == [("p1",), ("p2",)]
    got = {r.customer_id: r.product_id for r in content.top_products(model, 5).where("rank = 1").collect()}
    assert got == {"c1": "p1", "c2": "p2"}
    assert content.top_products(model, 5).count() == 4


def random_matrix(spark, n=30, m=20, seed=0, density=0.3):
    rng = np.random.default_rng(seed)
    x = (rng.random((n, m)) < density) * rng.integers(1, 4, (n, m))
    data = [(f"c{i}", f"p{j:02d}") for i in range(n) for j in range(m) for _ in range(x[i, j])]
    return x, spark.createDataFrame(data, "customer_id string, product_id string")


def test_svd_matches_numpy(spark):
    x, df = random_matrix(spark)
    model = factors.svd_fit(df, 4)
    got = {r.product_id: r.vec for r in model.products.collect()}
    v = np.array([got[f"p{j:02d}"] for j in range(x.shape[1])])
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(model.singular, s[:4], rtol=1e-6)
    assert np.allclose(v @ v.T, vt[:4].T @ vt[:4], atol=1e-4)
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-8)


@pytest.mark.parametrize("dense_bytes, products", [(None, 150), (0, 60)])
def test_svd_converges_beyond_its_basis(spark, monkeypatch, dense_bytes, products):
    """More products than the basis holds, so directions are dropped on the way; both ways, vectors on the driver and in tables."""
    monkeypatch.setattr(factors, "BASIS_BLOCKS", 3)
    x, df = random_matrix(spark, 200, products, seed=8, density=0.1)
    df = df.replace({f"p{j:02d}": f"p{j:03d}" for j in range(100)})
    model = factors.svd_fit(df, 3, oversample=6, dense_bytes=dense_bytes)
    got = {r.product_id: r.vec for r in model.products.collect()}
    v = np.array([got[f"p{j:03d}"] for j in range(products)])
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(model.singular, s[:3], rtol=1e-6)
    assert np.allclose(v @ v.T, vt[:3].T @ vt[:3], atol=2e-3)


def test_svd_with_stored_vectors_keeps_only_the_last_ones(spark, monkeypatch):
    """Many ranges on both sides, one of them without cells; what a step replaces is gone from the shared folder."""
    import glob

    monkeypatch.setattr(factors, "STORED_BYTES", 8 * 7 * 3 * 5)
    x, df = random_matrix(spark, 90, 37, seed=11, density=0.2)
    before = set(glob.glob(f"{durable_dir(spark)}/shelfwise/*/*"))
    model = factors.svd_fit(df, 3, oversample=4, tolerance=1e-9, dense_bytes=0)
    left = set(glob.glob(f"{durable_dir(spark)}/shelfwise/*/*")) - before
    assert not [p for p in left if "/vectors-" in p or "/cells-" in p] and len(left) < 12
    got = {r.product_id: r.vec for r in model.products.collect()}
    v = np.array([got[f"p{j:02d}"] for j in range(x.shape[1])])
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(model.singular, s[:3], rtol=1e-9)
    assert np.allclose(v @ v.T, vt[:3].T @ vt[:3], atol=1e-7)


def test_stored_svd_with_equal_singular_values(spark):
    """Three copies of a matrix on one diagonal: vectors that have converged must not let rounding errors in beside the slow ones."""
    rng = np.random.default_rng(3)
    x = (rng.random((200, 100)) < 0.9) * rng.integers(1, 4, (200, 100))
    data = [(f"{b}c{i}", f"{b}p{j:02d}") for b in range(3) for i in range(200) for j in range(100) for _ in range(x[i, j])]
    df = spark.createDataFrame(data, "customer_id string, product_id string")
    model = factors.svd_fit(df, 12, oversample=1, dense_bytes=0)
    assert np.allclose(model.singular, np.repeat(np.linalg.svd(x, compute_uv=False)[:4], 3), rtol=1e-6)


@pytest.mark.parametrize("dense_bytes", [None, 8 * 7 * 25])
def test_svd_per_scope(spark, dense_bytes):
    """Scopes of different size share their passes (or are split over several) and each gets the factors it has alone."""
    made = {t: random_matrix(spark, 40, m, seed=i, density=0.3) for i, (t, m) in enumerate((("a", 24), ("b", 9), ("c", 2), ("d", 40)))}
    every = None
    for t, (_, df) in made.items():
        df = df.selectExpr(f"'{t}' AS tenant_id", f"concat('{t}', customer_id) AS customer_id", f"concat('{t}', product_id) AS product_id")
        every = df if every is None else every.unionByName(df)
    model = factors.svd_fit(every, 3, oversample=4, scope="tenant_id", dense_bytes=dense_bytes)
    got = {r.product_id: r.vec for r in model.products.collect()}
    for t, (x, _) in made.items():
        v = np.array([got[f"{t}p{j:02d}"] for j in range(x.shape[1])])
        _, _, vt = np.linalg.svd(x, full_matrices=False)
        rank = min(3, max(x.shape[1] - 1, 1))
        assert np.allclose(v @ v.T, vt[:rank].T @ vt[:rank], atol=1e-3)
    lists = factors.top_products(model, 2).collect()
    assert lists and all(r.customer_id[0] == r.product_id[0] for r in lists)


def test_cf_topk_drops_owned_and_matches_numpy(spark):
    x, df = random_matrix(spark, seed=2)
    model = factors.svd_fit(df, 3)
    got = {}
    for r in factors.top_products(model, 4).orderBy("customer_id", "rank").collect():
        got.setdefault(int(r.customer_id[1:]), []).append((r.product_id, r.score))
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    scores = np.where(x > 0, -np.inf, x @ vt[:3].T @ vt[:3])
    for i, listed in got.items():
        assert all(x[i, int(p[1:])] == 0 for p, _ in listed)
        assert np.allclose([s for _, s in listed], np.sort(scores[i])[::-1][:4], atol=1e-3)


def test_gram_summary(spark):
    x, df = random_matrix(spark, seed=4)
    g = x.T @ x
    for r in factors.gram_summary(factors.interaction_matrix(df)).collect():
        j = int(r.product_id[1:])
        assert (r.self_weight, r.total_weight) == (g[j, j], g[j].sum())


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_top_matches_both_ways(spark, broadcast_bytes):
    rng = np.random.default_rng(5)
    q, it = rng.normal(size=(40, 3)), rng.normal(size=(70, 3))
    it[10] = it[11]  # a tie is broken by id
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "qid string, vec array<double>")
    items = spark.createDataFrame([(f"i{j:02d}", v.tolist()) for j, v in enumerate(it)], "iid string, vec array<double>")
    banned = [(f"q{i}", f"i{j:02d}") for i in range(40) for j in range(70) if (i * j) % 5 == 1]
    out = blocks.top_matches(queries, items, 6, 3, spark.createDataFrame(banned, "qid string, iid string"), broadcast_bytes, block_rows=16)
    got = {}
    for r in out.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.iid)
    for i in range(40):
        s = sorted((-round(float(q[i] @ it[j]), 9), f"i{j:02d}") for j in range(70) if (i * j) % 5 != 1)
        assert got[f"q{i}"] == [iid for _, iid in s[:6]]


@pytest.mark.parametrize("part_bytes", [1 << 20, 4000])
def test_top_matches_reads_cells_instead_of_shuffling_pairs(spark, part_bytes):
    rng = np.random.default_rng(8)
    q, it = np.round(rng.normal(size=(60, 3))), np.round(rng.normal(size=(900, 3)), 1)  # many ties
    q[:3], it[::9] = 0, 0
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "qid string, vec array<double>")
    items = spark.createDataFrame([(f"i{j:03d}", v.tolist()) for j, v in enumerate(it)], "iid string, vec array<double>")
    banned = spark.createDataFrame([("q1", f"i{j:03d}") for j in range(898)], "qid string, iid string")
    out = blocks.top_matches(queries, items, 6, 3, banned, 0, part_bytes=part_bytes)
    assert "CoGroup" not in out._jdf.queryExecution().toString()
    got = {}
    for r in out.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.iid)
    for i in range(60):
        s = sorted((-round(float(q[i] @ it[j]), 9) + 0.0, f"i{j:03d}") for j in range(900) if i != 1 or j >= 898)
        assert got[f"q{i}"] == [iid for _, iid in s[:6]]


@pytest.mark.parametrize("ratio, block_rows", [(2.0, 2048), (2.0, 5), (0.0, 7), (1.5, 1000)])
def test_similar_products_brute_force(spark, ratio, block_rows):
    rng = np.random.default_rng(6)
    data, names = [], [f"f{i}" for i in range(8)]
    for i in range(60):
        price = [None, 0.0, float(np.round(10 ** rng.uniform(0, 2), 2))][0 if i % 11 == 0 else 1 if i % 13 == 0 else 2]
        pick = sorted(rng.choice(names, 3, replace=False).tolist())
        vals = rng.random(3)
        data.append((f"p{i:02d}", None if i % 7 == 0 else f"g{i % 2}", price, pick, (vals / np.linalg.norm(vals)).tolist()))
    df = spark.createDataFrame(data, "product_id string, grp string, price double, feats array<string>, vals array<double>")
    got = {}
    for r in blocks.similar_products(df, 4, ratio, block_rows).orderBy("product_id", "rank").collect():
        got.setdefault(r.product_id, []).append(r.other_id)
    for a in data:
        def ok(b):
            if a[0] == b[0] or (a[1] is not None and a[1] != b[1]):
                return False
            t, c = a[2] or 0, b[2] or 0
            return ratio <= 0 or t <= 0 or c <= 0 or t / ratio <= c <= t * ratio
        va = dict(zip(a[3], a[4]))
        s = sorted((-round(sum(va.get(f, 0) * v for f, v in zip(b[3], b[4])), 9), b[0]) for b in data if ok(b))
        assert got.get(a[0], []) == [x for _, x in s[:4]]


def test_similar_products_shuffles_numbers_of_blocks(spark):
    data = [(f"p{i:03d}", None, 1.0 + i % 3, [f"f{i % 4}", "g"], [0.6, 0.8]) for i in range(90)]
    df = spark.createDataFrame(data, "product_id string, grp string, price double, feats array<string>, vals array<double>")
    out = blocks.similar_products(df, 3, 2.0, 7)
    assert "CoGroup" not in out._jdf.queryExecution().toString()
    got = {}
    for r in out.orderBy("product_id", "rank").collect():
        got.setdefault(r.product_id, []).append((r.other_id, r.score))
    for a in data:
        s = sorted((-(1.0 if a[3] == b[3] else 0.64), b[0]) for b in data if a[0] != b[0] and a[2] / 2 <= b[2] <= a[2] * 2)
        assert got[a[0]] == [(x, -v) for v, x in s[:3]]


def test_similar_products_with_blocks_that_the_hash_leaves_empty(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("product_id"), F.lit("g").alias("grp"), F.lit(1.0).alias("price"),
                                 F.array(F.lit("f")).alias("feats"), F.array(F.lit(1.0)).alias("vals"))
    df = df.where(F.pmod(F.xxhash64("product_id"), F.lit(4)) == 0)
    ids = sorted(r.product_id for r in df.collect())
    got = {}
    for r in blocks.similar_products(df, 2, 2.0, len(ids) - 1).orderBy("product_id", "rank").collect():
        got.setdefault(r.product_id, []).append(r.other_id)
    assert got == {i: [x for x in ids if x != i][:2] for i in ids}


def test_hybrid_without_history_is_content(make):
    c = make("customer_id string, product_id string, rank int", ("a", "x", 1), ("a", "y", 2), ("b", "y", 1), ("b", "x", 2))
    cf = make("customer_id string, product_id string, rank int", ("a", "y", 1), ("a", "z", 2))
    got = rows(factors.hybrid(c, cf, 2), "customer_id", "rank", "product_id")
    assert got == [("a", 1, "y"), ("a", 2, "x"), ("b", 1, "y"), ("b", 2, "x")]


def test_ranking(make):
    customers = make("customer_id string, tenure int", ("c1", 1), ("c2", 9), ("c3", 5))
    products = make("product_id string, category string", ("p1", "Core"), ("p2", "Add-on"), ("p3", "Add-on"))
    known = make("customer_id string, product_id string", ("c1", "p1"), ("c2", "p2"), ("zz", "p1"))
    model = ranking.fit(customers, products, known, [Feature("tenure")], [Feature("category", "categorical", ("Core", "Add-on"), "one_hot")], trees=3)
    got = ranking.top_products(model, 5)
    assert {r.product_id for r in got.where("customer_id = 'c1'").collect()} == {"p2", "p3"}
    assert got.where("customer_id = 'zz'").count() == 0
    pairs = customers.select("customer_id").crossJoin(products.select("product_id"))
    direct = {(r.customer_id, r.product_id): r.score for r in ranking.score_pairs(model, pairs).collect()}
    for r in got.collect():
        assert np.isclose(r.score, direct[r.customer_id, r.product_id], atol=1e-6)


def test_ranking_by_kind(spark, monkeypatch):
    rng = np.random.default_rng(11)
    customers = spark.createDataFrame([(f"c{i:02d}", int(rng.integers(0, 40))) for i in range(40)], "customer_id string, tenure int")
    products = spark.createDataFrame([(f"p{i:03d}", "abc"[i % 3], float(rng.integers(1, 9))) for i in range(120)], "product_id string, category string, price double")
    pairs = {(f"c{i:02d}", f"p{j:03d}") for i in range(39) for j in rng.choice(120, 1 + i % 7, replace=False)}
    pairs |= {("c00", f"p{j:03d}") for j in range(117)}  # has nearly all, so it gets three
    known = spark.createDataFrame(sorted(pairs), "customer_id string, product_id string")
    features = [Feature("price"), Feature("category", "categorical", ("a", "b", "c"), "one_hot")]
    model = ranking.fit(customers, products, known, [Feature("tenure")], features, trees=4)
    plain = sorted((r.customer_id, r.rank, r.product_id, r.score) for r in ranking.top_products(model, 5).collect())
    assert [len([r for r in plain if r[0] == c]) for c in ("c00", "c39")] == [3, 5]

    def fail(*args, **kwargs):
        raise AssertionError("many products are ranked by kind")

    with monkeypatch.context() as many:
        many.setattr(blocks, "BROADCAST_ROWS", 50)
        many.setattr(ranking, "BROADCAST_ROWS", 50, raising=False)
        many.setattr(blocks, "_blocked", fail)
        assert [r[:3] for r in sorted((r.customer_id, r.rank, r.product_id, r.score) for r in ranking.top_products(model, 5).collect())] == [r[:3] for r in plain]
        twice = ranking.RankingModel(model.model, model.customers, model.products.unionByName(model.products.where("product_id < 'p010'")), model.known)
        got = [(r.customer_id, r.product_id) for r in ranking.top_products(twice, 5).collect()]
        assert not set(got) & pairs
    with monkeypatch.context() as many:  # too many kinds
        many.setattr(blocks, "BROADCAST_ROWS", 50)
        many.setattr(ranking, "BROADCAST_ROWS", 50)
        many.setattr(ranking, "MAX_KINDS", 1)
        got = sorted((r.customer_id, r.rank, r.product_id, r.score) for r in ranking.top_products(model, 5).collect())
        assert [r[:3] for r in got] == [r[:3] for r in plain] and np.allclose([r[3] for r in got], [r[3] for r in plain])


def test_sampled_pairs_are_free(spark):
    _, df = random_matrix(spark, seed=7)
    customers = df.select("customer_id").distinct()
    products = df.select("product_id").distinct().where("product_id <> 'p00'")
    out = ranking.sampled_pairs(customers, products, df, max_positives=None)
    pos, neg = out.where("target = 1"), out.where("target = 0")
    assert pos.count() == df.distinct().where("product_id <> 'p00'").count()
    assert neg.join(df.distinct(), ["customer_id", "product_id"]).count() == 0
    assert 0 < neg.count() <= pos.count()
    assert ranking.sampled_pairs(customers, products, df, max_positives=10).where("target = 1").count() == 10


def test_pair_limit(spark):
    with pytest.raises(ValueError):
        ranking.all_pairs(spark.range(20).selectExpr("cast(id as string) customer_id"), spark.range(20).selectExpr("cast(id as string) product_id"),
                          spark.createDataFrame([], "customer_id string, product_id string"), limit=399)


def test_boosted_trees():
    from shelfwise.operators import boost

    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=20_000), rng.integers(0, 3, 20_000), rng.normal(size=20_000)])
    chance = 1 / (1 + np.exp(-(2 * (x[:, 0] > 0.3) * (x[:, 1] == 2) - 1 + 0.5 * (x[:, 2] > 0))))
    y = (rng.random(len(x)) < chance).astype(float)
    model = boost.fit_trees(x, y, 60, 3, 0.2)
    terms = ranking.factored(boost.leaf_conditions(model, 2))
    margin = sum(sum(w * ranking.holds(x[:, :2], c) for c, w in mine) * ranking.holds(x[:, 2:], other) for other, mine in terms)
    assert np.abs(1 / (1 + np.exp(-margin)) - chance).mean() < 0.04
    # leaves as products of conditions give what walking down the trees gives
    walked = np.zeros(len(x))
    for f, t, v in zip(model["feature"], model["limit"], model["value"]):
        at = np.zeros(len(x), int)
        for _ in range(3):
            at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] > t[at])
        walked += v[at - 7]
    assert np.allclose(margin, walked)
    flat = boost.fit_trees(np.ones((5, 2)), np.array([0, 1, 0, 1, 0.0]), 2, 2, 0.1)
    assert np.isinf(flat["limit"]).all()


def test_ranking_fits_on_all_known_pairs(spark):
    """More known pairs than 50,000: each is a training row, and the stored trees score pairs as their leaves do."""
    from shelfwise.operators import boost

    customers = spark.range(300).selectExpr("concat('c', id) AS customer_id", "CAST(id % 17 AS DOUBLE) AS tenure")
    products = spark.range(400).selectExpr("concat('p', id) AS product_id", "CAST(id % 5 AS DOUBLE) AS price")
    known = customers.crossJoin(products).where("crc32(concat(customer_id, product_id)) % 100 < CASE WHEN price > 2 THEN 70 ELSE 30 END").select("customer_id", "product_id")
    total = known.count()
    assert total > 52_000
    assert ranking.sampled_pairs(customers, products, known).where("target = 1").count() == total
    one_tenant = [df.withColumn("tenant_id", F.lit("t")) for df in (customers, products, known)]
    assert boost.sampled_pairs(*one_tenant).where("target = 1").count() == total
    model = ranking.fit(customers, products, known, [Feature("tenure")], [Feature("price")], trees=6)
    scores = {(r.customer_id, r.product_id): r.score for r in ranking.score_pairs(model, customers.crossJoin(products)).collect()}
    mean = {high: np.mean([v for (_, p), v in scores.items() if (int(p[1:]) % 5 > 2) == high]) for high in (True, False)}
    assert mean[True] > mean[False] + 0.1
    top = ranking.top_products(model, 3).collect()
    assert len(top) == 900 and all(np.isclose(r.score, scores[r.customer_id, r.product_id]) for r in top)


def test_stored_trees_are_those_of_one_task(spark, monkeypatch):
    from shelfwise.operators import boost, trees

    monkeypatch.setattr(trees, "CHUNK_ROWS", 300)
    rng = np.random.default_rng(5)
    data, plain = [], []
    for s, n in enumerate((4000, 900)):
        x = np.column_stack([np.round(rng.normal(size=n), 2), rng.integers(0, 4, n), rng.normal(size=n), np.ones(n)])
        y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] + (x[:, 1] == 2) - 0.5 * (x[:, 2] > 0.2))))).astype(float)
        order = np.lexsort((*x.T, y))
        plain.append(boost.fit_trees(x[order], y[order], 7, 3, 0.3))
        data += [(s, int(b), a.tolist(), i * 7919) for i, (a, b) in enumerate(zip(x, y))]
    frame = spark.createDataFrame(data, "scope int, target int, x array<double>, key long")
    for got, want in zip(trees.fit_stored(frame, 2, 7, 3, 0.3), plain):
        assert np.array_equal(got["feature"], want["feature"]) and np.array_equal(got["limit"], want["limit"]) and np.allclose(got["value"], want["value"])


def test_tenant_trees_take_all_pairs(make):
    from shelfwise.operators import boost

    people, goods, facts = tenants_data(make)
    key = lambda df, *ids: df.select("tenant_id", *[F.concat("tenant_id", c).alias(c) for c in ids], *[c for c in df.columns if c not in ("tenant_id", *ids)])
    people = key(people, "customer_id")
    goods = key(goods.crossJoin(people.select("tenant_id").distinct()), "product_id")
    facts = key(facts, "customer_id", "product_id").distinct()
    every = facts.join(people, "customer_id", "left_semi").join(goods, "product_id", "left_semi").count()
    assert boost.sampled_pairs(people, goods, facts).where("target = 1").count() == every
    one, many = (boost.fit(people, goods, facts, [Feature("tenure")], [Feature("price")], trees=4, task_rows=n).collect() for n in (1000, 50))
    one, many = ({r.tenant_id: (boost.unpack(bytes(r.model)), r.n_customer) for r in m} for m in (one, many))
    assert set(one) == set(many) == {"a", "b", "c"}
    for t, (m, n) in one.items():
        assert n == many[t][1] and all(np.allclose(m[k], many[t][0][k]) for k in m)


def tenants_data(make):
    people = make("customer_id string, tenant_id string, tenure int, plan string", *[
        (str(i), t, (7 * i) % 11, "ab"[i % 2] if t != "c" else None) for t in "abc" for i in range(30 if t != "c" else 4)])
    goods = make("product_id string, product_name string, category string, status string, in_stock string, price double, brand string, created_at string, updated_at string",
                 *[(str(j), f"n{j}", "xyz"[j % 3], "archived" if j == 8 else "active", "1", float(j), None, "", "") for j in range(9)])
    draw = np.random.default_rng(9)
    bought = [(str(i), str(j)) for i in range(30) for j in draw.choice(9, 3, replace=False, p=np.arange(1, 10) / 45)]
    facts = make("tenant_id string, customer_id string, product_id string", *[(t, *pair) for t in "ab" for pair in bought],
                 ("a", "3", "only here"), ("a", "unknown", "2"), ("a", "unknown", "3"), ("b", "1", None), ("b", " ", "2"), ("c", "1", "4"))
    return people, goods, facts


def test_run_of_all_tenants(make):
    """Equal tenants get equal scores although ids clash, and every tenant has lists, a winner and its own products."""
    people, goods, facts = tenants_data(make)
    run = tenant_run.run_tenants(people, goods, facts, ["tenure"], ["plan"], [Feature("price")], n=3, k=3, trees=5)
    scores = {(r.tenant_id, r.model): r for r in run.scores.collect()}
    assert {t for t, _ in scores} == {"a", "b", "c"} and len(scores) == 12
    assert all(sum(r.is_winner for (t, _), r in scores.items() if t == x) == 1 for x in "ab")
    # tenant c has one customer with one row, which is held out: nothing to fit on, no winner and no lists
    assert {r.status for (t, _), r in scores.items() if t == "c"} == {"failed"}
    winners = {t: m for (t, m), r in scores.items() if r.is_winner}
    lists = run.lists.collect()
    assert {r.tenant_id for r in lists} == {"a", "b"} and all(r.model == winners[r.tenant_id] for r in lists)
    assert len(lists) == 2 * 30 * 3 and all("\x1f" not in r.product_id + r.customer_id + r.product_name for r in lists)
    assert {r.product_id for r in run.trained.where("tenant_id = 'b'").collect()} == {str(j) for j in range(8)}
    assert {r.product_id for r in run.trained.where("tenant_id = 'a'").collect()} == {str(j) for j in range(8)} | {"only here"}


def test_tenants_alone_and_together(make):
    """A tenant's scores and lists do not depend on who else is in the run."""
    people, goods, facts = tenants_data(make)
    both = tenant_run.run_tenants(people, goods, facts, ["tenure"], ["plan"], [Feature("price")], n=3, k=3, trees=5)
    alone = tenant_run.run_tenants(people.where("tenant_id = 'b'"), goods, facts.where("tenant_id = 'b'"), ["tenure"], ["plan"], [Feature("price")], n=3, k=3, trees=5)
    for one, other in ((both.scores, alone.scores), (both.lists, alone.lists)):
        assert rows(one.where("tenant_id = 'b'").na.fill("-")) == rows(other.na.fill("-"))


def test_many_values(spark):
    """20,000 values of a category: the plan does not grow with them, vectors and profiles are right."""
    def model(n):
        people = spark.range(n).selectExpr("concat('c', id) AS customer_id", "CAST(id % 7 AS DOUBLE) AS size", "IF(id = 3, NULL, lpad(id, 6, '0')) AS tag", "IF(id % 2 = 0, 'x', 'y') AS kind")
        bought = spark.createDataFrame([("c1", "p1"), ("c1", "p1"), ("c2", "p1"), ("c3", "p2"), ("zz", "p3")], "customer_id string, product_id string")
        return content.fit(people, bought, ["size"], ["tag", "kind"])

    large, small = model(20_000), model(5)
    plan = lambda df: len(df._jdf.queryExecution().analyzed().toString().splitlines())
    assert large.dims == 1 + 19_999 + 2 and plan(large.profiles) == plan(small.profiles) and plan(large.vectors) == plan(small.vectors)
    got = {r.product_id: np.array(r.vec) for r in large.profiles.collect()}
    # positions: size, then tags by value (number 3 is missing), then x and y
    assert np.allclose(got["p1"][[1 + 1, 1 + 2, -2, -1]], [2 / 3, 1 / 3, 1 / 3, 2 / 3]) and np.count_nonzero(got["p1"][1:]) == 4
    assert np.allclose(got["p2"][1:-2], 0) and got["p2"][-1] == 1 and not got["p3"].any()


def test_profiles_in_one_pass(spark, make):
    """Means over interactions without a list of distinct pairs; products of unknown customers only get zeros."""
    vectors = make("customer_id string, vec array<double>", ("a", [1.0, 2.0]), ("b", [4.0, -1.0]))
    inter = make("customer_id string, product_id string", ("a", "p"), ("a", "p"), ("b", "p"), ("x", "p"), ("x", "q"), ("a", None))
    out = content.product_profiles(inter, vectors, 2)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    got = {r.product_id: r.vec for r in out.collect()}
    assert np.allclose(got["p"], [2.0, 1.0]) and got["q"] == got[None] == [0.0, 0.0]
    wide = make("customer_id string, vec array<double>", ("a", [1.0] * 70), ("b", [4.0] * 70))
    assert np.allclose({r.product_id: r.vec for r in content.product_profiles(inter, wide, 70).collect()}["p"], [2.0] * 70)


def test_negatives_draw_again_only_where_needed(spark, monkeypatch):
    import hashlib

    owned = [(f"c{i}", f"p{j}") for i in range(12) for j in range(10) if (i + j) % (i + 1) or j == i % 10]
    customers = spark.createDataFrame([(f"c{i}",) for i in range(12)], "customer_id string")
    products = spark.createDataFrame([(f"p{j}",) for j in range(10)], "product_id string")
    sizes, cut = [], ranking.cut_lineage

    def counted(df):
        out = cut(df)
        if "_owned" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(ranking, "cut_lineage", counted)
    out = ranking.sampled_pairs(customers, products, spark.createDataFrame(owned + owned[:9], "customer_id string, product_id string"), None)
    got = sorted(tuple(r) for r in out.where("target = 0").collect())
    assert len(sizes) > 1 and sizes[0] == len(owned) and all(a > b for a, b in zip(sizes, sizes[1:]))
    wanted = []
    for c, p in owned:
        picks = [f"p{int(hashlib.md5(f'42|{c}|{p}|{t}'.encode()).hexdigest()[:13], 16) % 10}" for t in range(1, 6)]
        wanted += [(c, x, 0) for x in [x for x in picks if (c, x) not in owned][:1]]
    assert got == sorted(wanted)


def test_large_groups_read_cells(spark, monkeypatch):
    """Groups beyond the limit get cells of their own; smaller ones and vectors of another length stay with blocks."""
    monkeypatch.setattr(blocks, "BROADCAST_ROWS", 40)
    calls, blocked = [], blocks._blocked
    monkeypatch.setattr(blocks, "_blocked", lambda *a: calls.append(a[3]) or blocked(*a))
    rng = np.random.default_rng(4)
    qs, its, wanted = [], [], {}
    for g, (n, m, d) in {"a": (15, 90, 3), "b": (8, 12, 2), "c": (9, 70, 4)}.items():
        q, it = np.round(rng.normal(size=(n, d)), 1), np.round(rng.normal(size=(m, d)), 1)
        qs += [(g, f"{g}q{i}", v.tolist()) for i, v in enumerate(q)]
        its += [(g, f"{g}i{j:02d}", v.tolist()) for j, v in enumerate(it)]
        for i in range(n):
            wanted[f"{g}q{i}"] = [x for _, x in sorted((-round(float(q[i] @ it[j]), 9), f"{g}i{j:02d}") for j in range(m) if j != i)[:5]]
    banned = [(q, f"{q[0]}i{int(q[2:]):02d}") for q in wanted]
    out = blocks.top_matches(spark.createDataFrame(qs, "grp string, qid string, vec array<double>"), spark.createDataFrame(its, "grp string, iid string, vec array<double>"),
                             5, None, spark.createDataFrame(banned, "qid string, iid string"), grouped=True)
    got = {}
    for r in out.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.iid)
    assert got == wanted and calls == [3, 4]
