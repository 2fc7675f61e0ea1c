"""Feature encoders that compile declared features to columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelfwise.config import Feature
from shelfwise.functions.text import slug
from shelfwise.operators.keyed import global_rank
from shelfwise.session import cut_lineage

MAX_VOCABULARY = 100_000


def encoded_columns(features: Sequence[Feature], present: Sequence[str], prefix: str = "") -> list[Column]:
    """Numeric and pass-through features as they are, one-hot features as one 0/1 column per value."""
    out = []
    for f in features:
        if f.name not in present:
            continue
        c = F.col(f"`{f.name}`")
        if f.dtype == "numeric" or f.encoding == "passthrough":
            out.append(c.alias(f"{prefix}{f.name}"))
            continue
        if not f.allowed:
            raise ValueError(f"one_hot feature '{f.name}' needs its allowed values")
        text = c.cast("string")
        out += [F.coalesce((text == v).cast("int"), F.lit(0)).alias(f"{prefix}{slug(f.name)}_{slug(v)}") for v in f.allowed]
    return out


def encode(df: DataFrame, features: Sequence[Feature], keys: Sequence[str] = (), prefix: str = "") -> DataFrame:
    return df.select(*keys, *encoded_columns(features, df.columns, prefix))


def infer_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per inferred encoder output: numeric columns once, others once per distinct value."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    texts = [c for c in columns if c not in numeric]
    schema = "column_name string, dtype string, value string"
    out = df.sparkSession.createDataFrame([(c, "numeric", None) for c in columns if c in numeric], schema)
    if texts:
        cells = df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.lit("categorical").alias("dtype"), F.col(f"`{c}`").cast("string").alias("value"))
            for c in texts])))
        out = out.union(cells.where("value is not null").distinct())
    return out


def resolve_features(df: DataFrame, columns: Sequence[str]) -> tuple[Feature, ...]:
    """Inferred features on the driver; refuses a column that is no category at all."""
    rows = infer_features(df, columns).orderBy("column_name", "value").limit(MAX_VOCABULARY + 1).collect()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} distinct category values in {list(columns)}")
    values: dict[str, list[str]] = {}
    for r in rows:
        values.setdefault(r.column_name, []).extend([r.value] if r.value is not None else [])
    numeric = {r.column_name for r in rows if r.dtype == "numeric"}
    return tuple(
        Feature(c) if c in numeric else Feature(c, "categorical", tuple(values.get(c, ())), "one_hot")
        for c in columns if c in numeric or values.get(c))


def with_scaled(df: DataFrame, columns: Sequence[str], scope: str | None = None) -> DataFrame:
    """Replaces the columns by (x - mean) / population deviation: null counts as 0, a flat column is only
    centred.

    Mean and deviation of all columns come from one aggregate that Spark runs once, as a scalar subquery; with
    ``scope`` every value of that column has its own.
    """
    filled = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for c in columns}
    stats = F.array(*[F.struct(F.avg(x).alias("mean"), F.stddev_pop(x).alias("dev")) for x in filled.values()]).alias("_stats")
    if scope is None:
        held = df.withColumn("_stats", df.agg(stats).scalar())
    else:
        held = df.join(cut_lineage(df.groupBy(scope).agg(stats)), scope)  # a row a scope, so Spark knows whether it is small

    def scale(i: int, x: Column) -> Column:
        s = F.get("_stats", F.lit(i))
        return (x - s["mean"]) / F.when(s["dev"] > 0, s["dev"]).otherwise(1.0)

    return held.withColumns({c: scale(i, x) for i, (c, x) in enumerate(filled.items())}).drop("_stats")


def standard_scale(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return with_scaled(df, columns).select(*keys, *columns)


def vocabulary(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, str]]:
    features = resolve_features(df.select(*[F.col(c).cast("string").alias(c) for c in columns]), columns) if columns else ()
    return [(f.name, v) for f in features for v in f.allowed]


def dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, position): the distinct values of ``columns``, numbered from 0 by column and value; a written table."""
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("at"), F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)])))
    ranked = global_rank(cells.where("value IS NOT NULL").distinct(), [F.col("at"), F.col("value")], "position")
    return cut_lineage(ranked.select("column_name", "value", (F.col("position") - 1).cast("int").alias("position")))


def with_indicators(df: DataFrame, columns: Sequence[str], values: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: an array of 0 and 1 over the positions of ``values`` (:func:`dictionary`); an unseen or missing value is 0 everywhere.

    The plan has a join a column, however many values there are; Spark broadcasts the dictionary while it is small.
    """
    size = values.count()
    at = []
    for i, c in enumerate(columns):
        own = values.where(F.col("column_name") == c).select(F.col("value").alias(f"_v{i}"), F.col("position").alias(f"_p{i}"))
        df = df.join(own, F.col(f"`{c}`").cast("string") == F.col(f"_v{i}"), "left")
        at.append(f"_p{i}")
    if not size:
        return df.withColumn(out, F.array().cast("array<double>")).drop(*at, *[f"_v{i}" for i in range(len(at))])
    ones = F.array_compact(F.array(*at))
    cells = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda p: F.array_contains(F.col("_ones"), p).cast("double"))
    return df.withColumn("_ones", ones).withColumn(out, cells).drop("_ones", *at, *[f"_v{i}" for i in range(len(at))])


def dummy_columns(pairs: Sequence[tuple[str, str]]) -> dict[str, Column]:
    """0/1 columns for observed values; an unseen or missing value is 0 everywhere."""
    return {f"{c}_{v}": F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0)) for c, v in pairs}
