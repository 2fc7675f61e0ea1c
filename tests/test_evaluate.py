import math

import numpy as np
import pytest

from helpers import rows
from shelfwise.config import Segmentation
from shelfwise.operators import evaluate, keyed


def lists(make, recommended, relevant):
    recs = make("customer_id string, product_id string, rank int", *[("c", p, i + 1) for i, p in enumerate(recommended)])
    held = make("customer_id string, product_id string", *[("c", p) for p in relevant])
    return recs, held


@pytest.mark.parametrize("rec, rel, k, precision, recall", [
    ("abc", "abc", 3, 1.0, 1.0), ("axc", "abc", 3, 2 / 3, 2 / 3), ("xyz", "abc", 3, 0.0, 0.0), ("ABCXY", "ACZ", 5, 2 / 5, 2 / 3)])
def test_metrics(make, rec, rel, k, precision, recall):
    got = evaluate.customer_metrics(*lists(make, rec, rel), k=k).first()
    assert math.isclose(got.precision, precision) and math.isclose(got.recall, recall)
    dcg = sum(1 / math.log2(i + 2) for i, p in enumerate(rec[:k]) if p in rel)
    assert math.isclose(got.ndcg, dcg / sum(1 / math.log2(i + 2) for i in range(min(k, len(rel)))))


def test_split(make):
    df = make("customer_id string, product_id string", ("cust_1", "A"), ("cust_1", "B"), ("cust_1", "C"), ("cust_2", "A"), ("cust_2", "D"), ("cust_3", "E"))
    train, test = evaluate.train_test(df)
    assert train.count() == 2 and test.count() == 4
    assert not set(rows(train)) & set(rows(test)) and ("cust_3", "E") in rows(test)
    with pytest.raises(ValueError):
        evaluate.split_flags(df, 0)


def test_single_rows_all_go_to_test(make):
    train, test = evaluate.train_test(make("customer_id string, product_id string", ("a", "x"), ("b", "y")))
    assert train.count() == 0 and test.count() == 2


def test_segments(make):
    df = make("customer_id string, v string", ("a", "1"), ("b", "2"), ("c", "3"), ("d", None), ("e", "x"))
    assert rows(evaluate.segment_of(df, Segmentation("v"))) == [
        ("a", "newer"), ("b", "newer"), ("c", "established"), ("d", "newer"), ("e", "newer")]
    assert rows(evaluate.segment_of(df, Segmentation("v", threshold=1.0)))[1] == ("b", "established")


def test_tournament_ties(make):
    df = make("model string, customers long, precision double, recall double, ndcg double",
              ("ranking", 1, .1, .1, .5), ("collaborative", 1, .1, .1, .50001), ("content", 1, .1, .1, .1), ("hybrid", 0, None, None, None))
    got = {r.model: r.is_winner for r in evaluate.tournament(df, ("content", "collaborative", "hybrid", "ranking")).collect()}
    assert got == {"content": False, "collaborative": True, "hybrid": False, "ranking": False}


def test_global_rank(spark):
    df = spark.range(5000).selectExpr("cast(id as string) k", "id % 7 v")
    got = keyed.global_rank(df, [df.v.desc(), df.k.asc()]).collect()
    want = sorted(got, key=lambda r: (-r.v, r.k))
    assert [r["rank"] for r in want] == list(range(1, 5001))


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0, 5.0, 5.0, 1.0], list(np.random.default_rng(1).normal(size=999)), [1e300, -1e300, 0.0], [1.0, 1.0 + 2 ** -52]])
def test_exact_median(make, values):
    assert keyed.exact_median(make("v double", *[float(v) for v in values]), "v") == float(np.median(values))


def test_trailing_count(spark):
    rng = np.random.default_rng(3)
    data = [(("a" if i % 3 else "b"), int(t)) for i, t in enumerate(rng.integers(0, 2000, 400))]
    df = spark.createDataFrame(data, "k string, s long").selectExpr("k", "timestamp_seconds(s) ts", "s")
    for r in keyed.trailing_count(df, ["k"], "ts", 60, "n").collect():
        assert r.n == sum(1 for k, s in data if k == r.k and r.s - 60 < s <= r.s)


def test_trailing_count_does_not_walk_its_window(spark):
    """A busy key: one running sum a slot instead of a frame that is added up again for every row."""
    rng = np.random.default_rng(3)
    at = np.sort(rng.integers(0, 400, 600))
    data = [(i, int(t), "a" if i % 5 else "b") for i, t in enumerate(at)]
    df = spark.createDataFrame(data, "id int, s long, k string").selectExpr("id", "timestamp_seconds(s) ts", "k")
    out = keyed.trailing_count(df, ["k"], "ts", 60, "n")
    assert "RangeFrame, -" not in out._jdf.queryExecution().toString()
    assert out.columns == ["id", "ts", "k", "n"]
    key = np.array(["a" if i % 5 else "b" for i in range(600)])
    for r in out.collect():
        assert r.n == ((key == r.k) & (at <= at[r.id]) & (at > at[r.id] - 60)).sum()


def test_examples_rank_only_the_customers_they_show(spark, sf):
    from shelfwise.plans import core_queries

    _, test, lists = core_queries.two_models(spark, sf, first=3)
    chosen = {r.customer_id for r in evaluate.first_customers(test, 3).select("customer_id").distinct().collect()}
    got = {tuple(r) for r in lists.collect()}
    assert {r[0] for r in got} <= chosen and len(chosen) == 3
    _, _, every = core_queries.two_models(spark, sf)
    assert got == {tuple(r) for r in every.collect() if r.customer_id in chosen}
