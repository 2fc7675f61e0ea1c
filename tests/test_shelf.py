import pytest
from pyspark.sql import functions as F

from helpers import rows
from shelfwise.operators import catalog, similarity as sim
from shelfwise.session import durable_path
from shelfwise.sources import audit, catalog_store, feeds

PRODUCTS = "product_id string, product_name string, category string, brand string, price double, specs string, description string, image_url string, tags string"


def product(pid, name, category="phone", brand="A", price=1000.0, specs=None, description=None):
    return (pid, name, category, brand, price, specs, description, None, None)


def test_similar_phones_rank_first(make):
    df = make(PRODUCTS, product("target", "Galaxy phone", specs="ram_gb=8; storage_gb=256"), product("phone_similar", "Galaxy phone plus", specs="ram_gb=8; storage_gb=256"),
              product("phone_budget", "Basic phone", brand="B", price=300.0, specs="ram_gb=2; storage_gb=32"),
              product("laptop", "Work laptop", category="laptop", brand="C", price=2000.0, specs="ram_gb=16; storage_gb=512"))
    got = sim.top_similar(sim.unit_vectors(df), 3, same_category=False, ratio=0).where("product_id = 'target'").orderBy("rank")
    assert [r.other_id for r in got.collect()] == ["phone_similar", "phone_budget", "laptop"]


def test_price_band(make):
    df = make(PRODUCTS, product("t", "x"), product("a", "x", price=1800.0), product("b", "x", price=600.0), product("c", "x", price=3000.0), product("d", "x", price=200.0))
    got = sim.top_similar(sim.unit_vectors(df), 4, ratio=2.0).where("product_id = 't'")
    assert {r.other_id for r in got.collect()} == {"a", "b"}
    counts = dict(rows(sim.candidate_counts(df, 2.0)))
    assert counts == {"t": 2, "a": 2, "b": 1, "c": 1, "d": 0}


def test_reasons(make):
    df = make(PRODUCTS, product("t", "x", specs="ram_gb=8; storage_gb=256", description="fast slim light phone"),
              product("a", "x", price=500.0, specs="ram_gb=8; storage_gb=64"), product("b", "x", "other", "Z", None, None, "slim light fast tablet"),
              product("c", "x", "other", "Z", None, "weight_g=1", None), product("d", "x", price=3500.0, specs="weight_g=100"))
    pairs = make("product_id string, other_id string, rank int", ("t", "a", 1), ("t", "b", 2), ("t", "c", 3), ("t", "d", 4))
    got = {r.other_id: r.reasons for r in sim.explained(pairs, df).collect()}
    assert got["a"] == ["Same category", "Same brand", "Lower price by 500", "Similar RAM"]
    assert got["b"] == ["Similar description"] and got["c"] == ["Similar attributes"]
    assert got["d"] == ["Same category", "Same brand", "Higher price by 2,500"]


def test_products_without_features_or_partners(make):
    empty = product("z", "x", None, None, None, None, None)
    df = make(PRODUCTS, empty, product("a", "phone"), product("b", "phone", category="lonely"))
    vectors = sim.unit_vectors(df)
    assert {r.product_id for r in vectors.collect()} == {"a", "b", "z"}
    out = sim.result_rows(df.select("product_id"), df, df, sim.top_similar(vectors, 2), make("product_id string, n long"), 2).collect()
    assert {(r.product_id, r.other_id, r.fallback_reason) for r in out} == {
        ("z", "a", None), ("z", "b", None), ("a", None, "limited_product_data"), ("b", None, "limited_product_data")}


def test_numeric_extra_columns_are_specs(make):
    df = make(PRODUCTS, product("a", "x", specs="ram_gb=8"), product("b", "y", specs=None)).selectExpr("*", "if(product_id = 'a', '5', 'no') AS Watts")
    assert rows(sim.spec_rows(df).select("product_id", "spec", "x")) == [("a", "ram_gb", 8.0), ("a", "watts", 5.0)]


def test_weights():
    w = sim.block_weights({"brand": 0, "unknown": 3})
    assert w["brand"] == 0 and abs(sum(w.values()) - 1) < 1e-12


def test_fill_and_results(make):
    active = make(PRODUCTS, product("a", "x"), product("b", "x"), product("c", "x", "laptop"))
    shelf = active.unionByName(make(PRODUCTS, product("old", "x")))
    pop = make("product_id string, n long", ("b", 5), ("c", 9))
    targets = make("product_id string, category string", ("old", "Phone"), ("new", None))
    assert rows(sim.popular_fill(targets, active, pop, 2)) == [("new", "b", 2), ("new", "c", 1), ("old", "a", 2), ("old", "b", 1)]
    asked = make("product_id string", "a", "old", "new")
    out = sim.result_rows(asked, shelf, active, sim.top_similar(sim.unit_vectors(active), 2), pop, 2).collect()
    assert {(r.product_id, r.fallback_reason) for r in out} == {("a", None), ("old", "inactive_product"), ("new", "unknown_product")}
    assert {r.reasons for r in out if r.product_id == "old"} == {"Popular in this category"}


CATALOG = "product_id string, product_name string, category string, status string, price double, in_stock string, created_at string, updated_at string"


def shelf_of(make, *ids):
    return make(CATALOG, *[(i, f"n{i}", "c", "active", 1.0, "1", "old", "old") for i in ids])


def test_upsert_then_replace(make):
    upload = "product_id string, product_name string, category string, price double"
    cat = shelf_of(make, "P1", "P2")
    file1 = make(upload, ("P2", "new2", "c", 2.0), ("P3", "n3", "c", None))
    assert rows(catalog.upload_diff(cat, file1)) == [(1, 1, 0)]
    one = catalog.commit_upload(cat, file1, F.lit("now"))
    assert rows(one, "product_id", "product_name", "status", "created_at", "updated_at") == [
        ("P1", "nP1", "active", "old", "old"), ("P2", "new2", "active", "old", "now"), ("P3", "n3", "active", "now", "now")]
    two = catalog.commit_upload(one, make(upload, ("P3", "n3", "c", 1.0), ("P4", "n4", "c", 1.0)), F.lit("later"), replace=True)
    assert rows(two, "product_id", "status") == [("P1", "archived"), ("P2", "archived"), ("P3", "active"), ("P4", "active")]


def test_feed_upsert(make):
    old = make("product_id string, product_name string, price double, brand string", ("1", "a", 1.0, "x"), ("2", "b", 2.0, "y"))
    feed = make("seq int, product_id string, product_name string, price double", (1, "1", "A", 9.0), (2, "3", "C", 3.0))
    got = catalog.feed_upsert(old, feed, F.col("seq"))
    assert got.columns[:2] == ["product_id", "product_name"]
    assert rows(got.fillna("-"), "product_id", "product_name", "brand") == [("1", "A", "-"), ("2", "b", "y"), ("3", "C", "-")]
    assert rows(catalog.feed_counts(old, feed)) == [(2, 1, 1, 3)]


def test_bulk(make):
    cat = shelf_of(make, "1", "2")
    ids = make("product_id string", " 1 ", "9")
    done = catalog.bulk_status(cat, ids, "archived", F.lit("now"))
    assert rows(done, "product_id", "status", "affected") == [("1", "archived", True), ("2", "active", False)]
    assert rows(catalog.bulk_delete(done, make("product_id string", "1", "2")), "product_id") == [("2",)]


def test_store(spark, make):
    store = catalog_store.CatalogStore(spark, durable_path(spark, "t"), keep=2)
    with pytest.raises(ValueError):
        store.current()
    for i in range(5):
        store.commit(shelf_of(make, str(i)))
    assert store.versions() == [3, 4, 5]
    assert rows(store.undo(), "product_id") == [("3",)]
    assert rows(store.undo(), "product_id") == [("2",)]
    with pytest.raises(ValueError):
        store.undo()


def test_feeds(make):
    rss = '<rss xmlns:g="x"><channel><title>Shop</title><item><g:id>1</g:id><title>A &amp; B</title><g:price>19.99 USD</g:price><g:product_type>T</g:product_type></item>' \
          '<item><title>no id</title></item></channel></rss>'
    atom = '<feed xmlns="a" xmlns:g="x"><entry><id>2</id><g:title><![CDATA[C]]></g:title></entry></feed>'
    got = feeds.parse_xml_feed(make("v string", rss, atom), "v").fillna("-").fillna(0.0)
    assert rows(got) == [("1", "A & B", 19.99, "T"), ("2", "C", 0.0, "-")]
    odd = '<rss xmlns:g="x"><channel><item><id>3</id><shipping><price>3</price></shipping><price>5</price><title>Bob&#39;s caf&#xe9;</title></item>' \
          '<item><id>4</id><title>broken & bare</title></item></channel></rss>'
    assert rows(feeds.parse_xml_feed(make("v string", odd), "v").fillna("-")) == [("3", "Bob's café", 5.0, "-")]
    falsy = make("v string", '[{"id": "0", "title": "false", "price": "0"}, {"id": 0, "title": "x"}, {"id": 1, "title": false, "price": 0, "sale_price": 2}]')
    assert rows(feeds.parse_json_feed(falsy, "v").fillna("-")) == [("0", "false", 0.0, "-"), ("1", "1", 2.0, "-")]
    js = make("v string", '[{"id": 7, "title": "x", "sale_price": 3}, {"title": "none"}]', '{"items": [{"sku": "s", "price": "$4"}]}', '{"other": 1}')
    assert rows(feeds.parse_json_feed(js, "v").fillna("-")) == [("7", "x", 3.0, "-"), ("s", "s", 4.0, "-")]
    shop = make("v string", '{"id": 5, "title": "t", "variants": [{"price": "9.5"}], "price": "1"}', '{"id": 6, "product_type": "k", "variants": [], "price": 2}', '{"title": "x"}')
    assert rows(feeds.parse_shop_products(shop, "v").fillna("-")) == [("5", "t", 9.5, "-"), ("6", "6", 2.0, "k")]


def test_audit(spark, make):
    path = durable_path(spark, "audit")
    df = spark.range(250).selectExpr("'t' tenant_id", "'me' who", "'2024-01-02T00' `when`", "'archive' action", "cast(id as string) product_id")
    audit.append(audit.records(df), path)
    audit.append(audit.records(df.limit(1).withColumn("when", F.lit("2024-01-03T00"))), path)
    got = audit.history(spark, path, "t", 5).collect()
    assert [(r.when, r.product_ids_count, len(r.product_ids)) for r in got] == [("2024-01-03T00", 1, 1), ("2024-01-02T00", 250, 100)]
