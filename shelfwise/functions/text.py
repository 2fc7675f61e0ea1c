"""Text, price and specification parsing as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from shelfwise.functions.ids import strip
from shelfwise.functions.values import let, rounded

# fixed values: display names of well-known specifications
SPEC_LABELS = {
    "ram_gb": "RAM (GB)",
    "ram": "RAM (GB)",
    "storage_gb": "Storage (GB)",
    "storage": "Storage (GB)",
    "rom_gb": "Storage (GB)",
    "screen_in": "Screen (in)",
    "screen_size": "Screen (in)",
    "display_in": "Screen (in)",
    "battery_mah": "Battery (mAh)",
    "battery": "Battery (mAh)",
    "camera_mp": "Camera (MP)",
    "camera": "Camera (MP)",
    "cpu_cores": "CPU (Cores)",
    "cores": "CPU (Cores)",
    "weight_g": "Weight (g)",
    "weight": "Weight (g)",
    "refresh_rate_hz": "Refresh Rate (Hz)",
}

# fixed values: catalogue columns that never count as a specification
RESERVED_COLUMNS = (
    "product_id", "item_id", "id", "product_name", "title", "name", "category", "product_type", "brand",
    "price", "in_stock", "description", "image_url", "product_url", "status", "created_at", "updated_at",
    "tags", "specs",
)


def slugify(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def slug(text: str) -> str:
    """Driver-side twin of :func:`slugify`, for column names."""
    kept = "".join(ch if ch in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for ch in text.lower())
    return "_".join(kept.split())


def humanize(c: Column) -> Column:
    return F.regexp_replace(c, r"(\p{Ll})(\p{Lu})", "$1 $2")


def clean_price(c: Column) -> Column:
    """First signed number of a price text, thousands commas ignored; null when there is none."""
    number = F.regexp_extract(F.replace(c.cast("string"), F.lit(","), F.lit("")), r"[-+]?\d+(?:\.\d+)?", 0)
    return number.try_cast("double")


def _last_wins(pairs: Column) -> Column:
    """array<struct<k,v>> to a map; a repeated key keeps its first place and its last value."""
    def build(rows: Column) -> Column:
        return let(
            F.array_distinct(F.transform(rows, lambda p: p.k)),
            lambda keys: F.map_from_arrays(
                keys, F.transform(keys, lambda k: F.element_at(F.filter(rows, lambda p: p.k == k), -1).v)),
        )

    return let(pairs, build)


def parse_specs(c: Column) -> Column:
    """``'ram_gb=8; screen: 6.6in'`` to map<string,double>; anything without a number is ignored."""

    def pair(token: Column) -> Column:
        at = F.when(F.instr(token, "=") > 0, F.instr(token, "=")).otherwise(F.instr(token, ":"))
        key = F.when(at > 0, F.lower(strip(F.substring(token, F.lit(1), at - 1))))
        value = let(
            F.when(at > 0, strip(F.substring(token, at + 1, F.length(token)))),
            lambda t: F.coalesce(
                t.try_cast("double"), F.regexp_extract(t, r"^[-+]?([0-9]*\.[0-9]+|[0-9]+)", 0).try_cast("double")),
        )
        return F.struct(key.alias("k"), value.alias("v"))

    pairs = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), pair)
    return _last_wins(F.filter(pairs, lambda p: (p.k != "") & p.v.isNotNull()))


def with_extra_specs(specs: Column, extras: Column, reserved: Iterable[str] = RESERVED_COLUMNS) -> Column:
    """Add numeric values of pass-through columns; parsed specs win over a column of the same name."""
    reserved = F.array(*[F.lit(r) for r in reserved])
    cleaned = F.transform(
        F.map_entries(extras),
        lambda e: F.struct(F.lower(strip(e.key)).alias("k"), e.value.try_cast("double").alias("v")),
    )

    def merge(known: Column) -> Column:
        usable = F.filter(
            cleaned,
            lambda e: e.v.isNotNull() & ~F.array_contains(reserved, e.k) & ~F.map_contains_key(known, e.k),
        )
        return F.map_concat(known, _last_wins(usable))

    return let(specs, merge)


def _title(c: Column) -> Column:
    """Upper-case every letter that does not follow a letter, lower-case the others."""
    def cased(chars: Column) -> Column:
        return F.transform(
            chars,
            lambda ch, i: F.when((i > 0) & F.get(chars, i - 1).rlike(r"\p{L}"), F.lower(ch)).otherwise(F.upper(ch)))

    return F.array_join(let(F.split(c, ""), cased), "")


def number_text(c: Column) -> Column:
    """Whole numbers without decimals, others rounded to two."""
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(rounded(c, 2).cast("string"))


def format_specs(specs: Column, limit: int = 8) -> Column:
    """map<string,double> to ``array<struct<label,value>>``: at most ``limit`` readable labels."""
    labels = F.create_map(*[F.lit(x) for pair in SPEC_LABELS.items() for x in pair])
    rows = F.transform(
        F.map_entries(specs),
        lambda e: F.struct(
            F.coalesce(F.try_element_at(labels, F.lower(e.key)), _title(F.replace(e.key, F.lit("_"), F.lit(" "))))
            .alias("k"),
            number_text(e.value).alias("v"),
        ),
    )

    def shown(entries: Column) -> Column:
        names = F.transform(entries, lambda r: r.k)

        def build(seen: Column) -> Column:
            # with all places taken, later entries no longer overwrite earlier ones
            full_at = F.when(F.size(seen) == limit, F.array_position(names, F.element_at(seen, -1)))
            used = F.slice(entries, F.lit(1), F.coalesce(full_at.cast("int"), F.size(entries)))
            return let(used, lambda u: F.transform(
                seen,
                lambda k: F.struct(k.alias("label"), F.element_at(F.filter(u, lambda r: r.k == k), -1).v.alias("value"))))

        return let(F.slice(F.array_distinct(names), 1, limit), build)

    return let(rows, shown)


def time_ago(ts: Column, now: Column) -> Column:
    """Readable distance between ``ts`` and a fixed ``now``."""
    sec = F.greatest(F.lit(0), F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 1_000_000))
    return (
        F.when(ts.isNull(), "Unknown")
        .when(sec < 60, "Just now")
        .when(sec < 3600, F.concat(F.floor(sec / 60).cast("string"), F.lit("m ago")))
        .when(sec < 86400, F.concat(F.floor(sec / 3600).cast("string"), F.lit("h ago")))
        .when(sec < 172800, "Yesterday")
        .otherwise(F.date_format(ts, "MMM dd"))
    )
