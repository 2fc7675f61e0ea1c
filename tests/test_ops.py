import datetime as dt
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from shelfwise.operators import identity, limiter, ops, profile
from shelfwise.plans import tenant_run
from shelfwise.session import durable_path
from shelfwise.sources import tables
from shelfwise.streaming import jobs

EVENTS = "event_id long, ts timestamp, event_type string, session_id string, customer_id string, product_id string, quantity string"


def event(i, session, customer, product="p", kind="view", quantity=None):
    return (i, dt.datetime(2024, 1, 1, 0, 0, i), kind, session, customer, product, quantity)


def test_identity_merge(make):
    df = make(EVENTS, event(1, "s", None), event(2, "s", None), event(3, "s", "c", kind="purchase", quantity="3"), event(4, "s", None), event(5, " ", "null"))
    got = identity.event_interactions(df, identity.identity_map(df))
    assert rows(got, "event_id", "customer_id", "weight") == [(1, "c", 1.0), (2, "c", 1.0), (3, "c", 15.0), (4, "c", 1.0)]


def brute_force(requests, limit, size):
    history, out = {}, {}
    for key, t, i in sorted(requests, key=lambda r: (r[0], r[1], r[2])):
        h = history.setdefault(key, deque())
        while h and h[0] <= t - size:
            h.popleft()
        if len(h) >= limit:
            out[i] = (False, 0, max(1, -(-(h[0] + size - t) // 1)))
        else:
            h.append(t)
            out[i] = (True, limit - len(h), 0)
    return out


def test_rate_limit(spark):
    rng = np.random.default_rng(8)
    # quiet stretches, bursts and a permanently busy key
    data = []
    for i, t in enumerate(np.concatenate([rng.integers(0, 4000, 300), rng.integers(1000, 1100, 80), rng.integers(1200, 1230, 40)])):
        data.append(("busy" if i % 4 == 0 else "other", int(t), i))
    data += [("steady", t, 1000 + t) for t in range(0, 600, 3)]
    df = spark.createDataFrame(data, "k string, s long, id long").selectExpr("k", "timestamp_seconds(s) ts", "id")
    for limit in (1, 5, 12):
        want = brute_force(data, limit, 60)
        got = {r.id: (r.allowed, r.remaining, r.retry_after) for r in limiter.limit_requests(df, ["k"], "ts", "id", limit, 60).collect()}
        assert got == want


def test_limits_per_tenant_and_scope(make):
    asked = make("tenant_id string, scope string, s long, id long", *[(t, s, i, 10 * n + i) for n, (t, s) in enumerate(
        [("a", "catalog"), ("a", "tracking"), ("b", "catalog"), ("c", "onboarding"), ("c", "other"), ("d", "catalog")]) for i in range(8)])
    limits = make("tenant_id string, scope string, limit_per_minute int", ("a", "catalog", 2), ("a", None, 4), ("b", None, 3), ("d", "catalog", 0))
    df = limiter.with_limits(asked, limits).selectExpr("*", "timestamp_seconds(s) ts")
    out = limiter.limit_requests(df, ["tenant_id", "scope"], "ts", "id", F.col("limit_per_minute"))
    allowed = out.where("allowed").groupBy("tenant_id", "scope").count().collect()
    assert {(r[0], r[1]): r[2] for r in allowed} == {
        ("a", "catalog"): 2, ("a", "tracking"): 4, ("b", "catalog"): 3, ("c", "onboarding"): 5, ("c", "other"): 8}
    assert {r.retry_after for r in out.where("tenant_id = 'd'").collect()} == {60}


def test_failed_models(make, monkeypatch):
    def lists(name, *_):
        if name != "hybrid":
            raise ValueError(name)
        return make("customer_id string, product_id string, rank int", ("a", "y", 1))

    monkeypatch.setattr(tenant_run, "model_lists", lists)
    people, held = make("customer_id string", "a"), make("customer_id string, product_id string", ("a", "x"))
    got = {r.model: (r.status, r.is_winner) for r in tenant_run.score_models(people, held, held, held, [], [], []).collect()}
    # the only model that ran wins with nothing found
    assert got == {"content": ("failed", False), "collaborative": ("failed", False), "hybrid": ("completed", True), "ranking": ("failed", False)}
    with pytest.raises(ValueError, match="every model failed"):
        tenant_run.score_models(people, held, held, held, [], [], [], models=("content", "ranking"))


def test_readiness_and_plan(make):
    status = make("tenant_id string, status string, trained boolean", ("a", None, False), ("b", "ready_to_train", False), ("c", "running", False), ("d", "completed", True), ("e", None, False))
    counts = make("tenant_id string, customers long, interactions long", ("a", 50, 200), ("b", 60, 300), ("e", 49, 900))
    got = {r.tenant_id: r.action for r in ops.readiness(status, counts).collect()}
    assert got == {"a": "marked_ready_to_train", "b": "already_marked", "c": "below_threshold", "e": "below_threshold"}
    plan = {r.tenant_id: r.action for r in ops.retrain_plan(status).collect()}
    assert plan == {"a": "skipped", "b": "first_training", "c": "skipped", "d": "retrain", "e": "skipped"}


def test_profile(make, spark):
    df = spark.range(100).selectExpr("cast(id as string) customer_id", "id charges", "if(id % 25 = 0, 'x', cast(id as string)) mostly", "if(id % 5 = 0, 'x', cast(id as string)) text20",
                                     "if(id % 2 = 0, 'Yes', 'No') has_phone", "id % 3 contract_code", "cast(null as string) empty", "uuid() notes", "cast(id % 40 as string) || 'a' plan")
    got = {r.column_name: r for r in profile.profile(df).collect()}
    assert got["charges"].suggested_dtype == "numeric" and got["charges"].confidence == 0.95
    assert got["mostly"].suggested_dtype == "numeric" and got["mostly"].confidence == 0.55
    assert got["text20"].suggested_dtype == "likely_free_text_or_id"
    assert got["has_phone"].is_binary_service and got["has_phone"].confidence == 0.95
    assert got["contract_code"].confidence == 0.5 and got["contract_code"].needs_review
    assert got["empty"].suggested_dtype == "categorical" and got["empty"].confidence == 0.0
    assert got["notes"].confidence == 0.5 and "High uniqueness (100.0%)" in got["notes"].review_reason
    assert got["plan"].confidence == 0.9 and got["plan"].review_reason is None


def test_id_flags(spark):
    df = spark.range(60).selectExpr("concat('u', id) userID", "concat('k', id) session_key", "concat('d', id % 4) department_id", "concat('n', id) random_notes")
    got = {r.column_name: r.is_id_column for r in profile.profile(df).collect()}
    assert got == {"userID": True, "session_key": True, "department_id": False, "random_notes": False}


def test_telemetry_folders(spark, make):
    path = durable_path(spark, "tel")
    df = make("tenant_id string, ts timestamp", ("a", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 1, 26)), ("b", dt.datetime(2024, 1, 26)))
    tables.write_telemetry(df, path)
    assert tables.read_telemetry(spark, path, "a", dt.date(2024, 1, 20)).count() == 1
    assert tables.drop_expired(spark, path, dt.date(2024, 2, 5)) == 1
    assert tables.read_telemetry(spark, path).count() == 2


def test_tenant_tables_replace_only_their_tenant(spark, make):
    path = durable_path(spark, "tenants")
    tables.write_tenant_tables(path, {"customers": make("tenant_id string, id int", ("a", 1), ("b", 2))})
    tables.write_tenant_tables(path, {"customers": make("tenant_id string, id int", ("a", 3), ("a", 4))})
    assert rows(spark.read.parquet(f"{path}/customers"), "id") == [(2,), (3,), (4,)]


def stream_of(spark, sf, n):
    """The events table in ``n`` files, one per micro-batch."""
    path = durable_path(spark, "source")
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(n, "ts").write.parquet(path)
    return events, jobs.file_stream(spark, path, events.schema, files_per_batch=1)


def test_stream_equals_batch_over_many_batches(spark, sf):
    events, stream = stream_of(spark, sf, 4)
    path = jobs.new_path(spark, "daily")
    jobs.finished(jobs.keep_updates(jobs.daily_counts(stream, "40 days"), path))
    want = events.groupBy(F.col("ts").cast("date").alias("date"), "event_type").agg(F.count("*").alias("n"))
    assert rows(jobs.latest_updates(spark, path, ["date", "event_type"]), "date", "event_type", "n") == rows(want)


def test_stream_dedupe(spark, sf):
    events, stream = stream_of(spark, sf, 3)
    path = jobs.new_path(spark, "dedupe")
    jobs.finished(jobs.append_to(jobs.deduplicated(stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))), "40 days"), path))
    assert spark.read.parquet(path).count() == events.count()


def test_late_and_redelivered_events(spark, make):
    """Three batches: the last has an event far behind all watermarks, one from the first batch again, and one twice in itself."""
    path = durable_path(spark, "deliveries")
    for batch in ([(1, "view", "2024-01-05"), (2, "view", "2024-01-05")], [(3, "view", "2024-03-01")],
                  [(4, "view", "2023-12-31"), (1, "view", "2024-01-05"), (5, "buy", "2024-03-02"), (5, "buy", "2024-03-02")]):
        df = spark.createDataFrame(batch, "event_id long, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(path)

    def stream():
        return jobs.file_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1)

    once = jobs.new_path(spark, "once")
    jobs.finished(jobs.append_once(stream(), once))
    assert rows(spark.read.parquet(once), "event_id") == [(1,), (2,), (3,), (4,), (5,)]
    daily = jobs.new_path(spark, "daily")
    jobs.finished(jobs.keep_updates(jobs.daily_counts(stream()), daily))
    got = {(str(r.date), r.event_type): r.n for r in jobs.latest_updates(spark, daily, ["date", "event_type"]).collect()}
    assert got == {("2024-01-05", "view"): 3, ("2024-03-01", "view"): 1, ("2023-12-31", "view"): 1, ("2024-03-02", "buy"): 2}


def test_hot_and_blank_sessions(spark, monkeypatch):
    """A third of the events without a session, a third of one session: the links still find all of them."""
    from shelfwise.operators import keyed

    monkeypatch.setattr(keyed, "HOT_ROWS", 100)
    events = spark.range(3000).selectExpr("id AS event_id", "CASE id % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'bot' ELSE concat('s', id) END AS session_id",
                                          "IF(id % 50 = 2, concat('c', id), IF(id = 2998, 'owner', NULL)) AS customer_id", "timestamp_seconds(id) AS ts")
    got = {r.event_id: r.effective_customer for r in identity.resolve(events, identity.identity_map(events)).collect()}
    for i in range(3000):
        own = f"c{i}" if i % 50 == 2 else "owner" if i == 2998 else None
        assert got[i] == (own or (None if i % 3 == 0 else "owner" if i % 3 == 1 else f"s{i}"))


def test_all_pairs_without_limit(spark, monkeypatch):
    from shelfwise.operators import ranking

    monkeypatch.setattr(ranking, "LIST_IDS", 7)
    who = spark.range(30).selectExpr("concat('c', id) AS customer_id")
    what = spark.range(40).selectExpr("concat('p', id) AS product_id")
    known = spark.createDataFrame([("c1", "p2"), ("c1", "p2"), ("zz", "p1")], "customer_id string, product_id string")
    out = ranking.all_pairs(who, what, known, limit=None)
    assert out.count() == out.select("customer_id", "product_id").distinct().count() == 1200
    assert [tuple(r) for r in out.where("target = 1").collect()] == [("c1", "p2", 1)]
    with pytest.raises(ValueError):
        ranking.all_pairs(who, what, known, limit=1199)
