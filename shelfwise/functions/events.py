"""Rules for single tracking events as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from shelfwise.functions.ids import blank_to_null, has_id, id_or_null, strip

# fixed values
EVENT_TYPES = ("view", "click", "add_to_cart", "purchase")
EVENT_SOURCES = ("similar", "recommendation", "organic")
EVENT_WEIGHTS = {"view": 1.0, "add_to_cart": 2.0, "purchase": 5.0}


def reject_reason(quantity: Column | None = None) -> Column:
    """First broken ingest rule of a tracking request, null for an accepted one."""
    qty = F.col("quantity") if quantity is None else quantity
    number = qty.try_cast("double")
    return (
        F.when(F.col("event_type").isNull() | ~F.col("event_type").isin(*EVENT_TYPES), "event_type")
        .when(blank_to_null(F.col("session_id")).isNull(), "session_id")
        .when(blank_to_null(F.col("product_id")).isNull(), "product_id")
        .when(qty.isNotNull() & number.isNull(), "quantity")
        .when(number < 0, "quantity")
        .when(F.col("source").isNotNull() & ~F.col("source").isin(*EVENT_SOURCES), "source")
        .when(F.col("rec_id").isNotNull() & ~F.col("rec_id").rlike("^[0-9a-fA-F]{1,32}$"), "rec_id")
    )


def event_weight(event_type: Column, quantity: Column, overrides: Mapping[str, float] | None = None) -> Column:
    """Base weight of the type, times the quantity when that is positive."""
    weights = {**EVENT_WEIGHTS, **{k.lower(): float(v) for k, v in (overrides or {}).items()}}
    kind = F.lower(strip(F.coalesce(event_type, F.lit("view"))))
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    base = F.coalesce(F.try_element_at(table, kind), F.lit(1.0))
    number = quantity.try_cast("double")
    return F.when(number > 0, base * number).otherwise(base)


def effective_customer(customer: Column, mapped: Column, session: Column) -> Column:
    """Own id, else the customer linked to the session, else the session; null when nothing is usable."""
    return F.coalesce(id_or_null(customer), F.when(has_id(session), F.coalesce(mapped, strip(session))))


def transform_reject(customer: Column, session: Column, product: Column) -> Column:
    return (
        F.when(~has_id(customer) & ~has_id(session), "no_identity")
        .when(~has_id(product), "no_product")
    )


def is_identity_link(session: Column, customer: Column) -> Column:
    return has_id(session) & has_id(customer) & (strip(session) != strip(customer))


def is_live(source: Column, request_source: Column) -> Column:
    """Not test traffic; a missing marker counts as live."""
    return ~source.eqNullSafe("test") & ~request_source.eqNullSafe("test")
