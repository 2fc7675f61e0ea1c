from pyspark.sql import functions as F

from shelfwise.functions import events, ids, text


def values(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_clean_id(make):
    df = make("v string", "123.0", " 5 ", None, "-7.0", "1.05", "x.0", "12.0.0")
    assert values(df, ids.clean_id(F.col("v"))) == ["123", "5", "", "-7", "1.05", "x.0", "12.0.0"]


def test_null_tokens(make):
    df = make("v string", "", " NaN ", "None", "null", None, "0", "nano")
    assert values(df, ids.has_id(F.col("v"))) == [False, False, False, False, False, True, True]


def test_clean_price(make):
    df = make("v string", "19.99 USD", "$49.50", "£120.00", "1,299.95", "85.5", None, "free", "-5")
    assert values(df, text.clean_price(F.col("v"))) == [19.99, 49.5, 120.0, 1299.95, 85.5, None, None, -5.0]


def test_slugify_and_humanize(make):
    df = make("v string", " Month-to-month! ", "Fiber  optic", "StreamingTV", "PhoneService")
    assert values(df, text.slugify(F.col("v"))) == ["month_to_month", "fiber_optic", "streamingtv", "phoneservice"]
    assert values(df, text.humanize(F.col("v")))[2:] == ["Streaming TV", "Phone Service"]
    assert text.slug(" Month-to-month! ") == "month_to_month"


def test_parse_specs(make):
    df = make("v string", "ram_gb=8; Storage_GB: 256GB; bad; =3; x=; colour=red; ram_gb=16; a=b=3; s=6.6in", None, "")
    got = values(df, text.parse_specs(F.col("v")))
    assert got[0] == {"ram_gb": 16.0, "storage_gb": 256.0, "s": 6.6}
    assert got[1] == {} and got[2] == {}


def test_format_specs(make):
    df = make("v string", "ram_gb=8; screen_in=6.625; two words=1; size_3d=2; a=1; b=2; c=3; d=4; e=5")
    got = values(df, text.format_specs(text.parse_specs(F.col("v"))))[0]
    assert [(r.label, r.value) for r in got] == [
        ("RAM (GB)", "8"), ("Screen (in)", "6.63"), ("Two Words", "1"), ("Size 3D", "2"), ("A", "1"), ("B", "2"), ("C", "3"), ("D", "4")]


def test_extra_specs(make):
    df = make("v string, e map<string,string>", ("ram_gb=8", {"RAM_GB": "4", " Watts ": "65", "price": "9", "note": "x"}))
    assert values(df, text.with_extra_specs(text.parse_specs(F.col("v")), F.col("e"))) == [{"ram_gb": 8.0, "watts": 65.0}]


def test_time_ago(make):
    df = make("v string", "2024-01-30 11:59:30", "2024-01-30 11:10:00", "2024-01-30 02:00:00", "2024-01-29 01:00:00", "2024-01-05 00:00:00", None)
    got = values(df, text.time_ago(F.col("v").cast("timestamp"), F.lit("2024-01-30 12:00:00").cast("timestamp")))
    assert got == ["Just now", "50m ago", "10h ago", "Yesterday", "Jan 05", "Unknown"]


def test_event_weight_and_customer(make):
    df = make("t string, q string, c string, s string, p string",
              ("view", None, None, "s1", "p"), ("add_to_cart", "0", "cust", "s1", "p"), ("purchase", "3", "cust", None, "p"),
              ("click", "x", "null", " ", "p"), ("view", None, "c", "s", " "))
    assert values(df, events.event_weight(F.col("t"), F.col("q"))) == [1.0, 2.0, 15.0, 1.0, 1.0]
    assert values(df, events.effective_customer(F.col("c"), F.lit(None).cast("string"), F.col("s"))) == ["s1", "cust", "cust", None, "c"]
    assert values(df, events.transform_reject(F.col("c"), F.col("s"), F.col("p"))) == [None, None, None, "no_identity", "no_product"]


def test_identity_link(make):
    df = make("s string, c string", ("sess_01", "cust_100"), ("sess_01", None), ("sess_01", "null"), ("same", "same"))
    assert values(df, events.is_identity_link(F.col("s"), F.col("c"))) == [True, False, False, False]
