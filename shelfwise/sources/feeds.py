"""Product feeds: RSS/Atom XML, JSON and shop-platform JSON to (product_id, product_name, price, category)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.functions.ids import strip
from shelfwise.functions.text import clean_price

# fixed values: accepted field names, first non-empty one wins
ID_FIELDS = ("product_id", "id", "sku", "g:id")
NAME_FIELDS = ("product_name", "title", "name", "g:title")
PRICE_FIELDS = ("price", "sale_price", "regular_price", "g:price")
CATEGORY_FIELDS = ("category", "product_type", "google_product_category", "g:product_type")
# fixed values: object keys that may hold the product list
ROOTS = ("products", "items", "feed", "catalog", "data")
# fixed values: XML element names per column
XML_FIELDS = {
    "product_id": ("id", "product_id", "sku"),
    "product_name": ("title", "product_name", "name"),
    "price": ("price", "sale_price", "regular_price"),
    "category": ("product_type", "google_product_category", "category"),
}


def _shape(pid: Column, name: Column, price: Column, category: Column) -> list[Column]:
    return [strip(pid).alias("product_id"), F.coalesce(strip(name), strip(pid)).alias("product_name"),
            clean_price(price).alias("price"), strip(category).alias("category")]


def parse_json_feed(df: DataFrame, payload: str) -> DataFrame:
    """Rows of every JSON document: a list, or an object with the list under one of ROOTS.

    Items without an id are dropped.  Fields are read as text, so numbers and texts both work; the JSON type only tells
    the number 0 and the value false, which count as absent, from the texts "0" and "false".
    """
    text = F.col(payload)
    lists = [F.from_json(F.get_json_object(text, "$"), "array<string>")] + [
        F.from_json(F.get_json_object(text, f"$.{r}"), "array<string>") for r in ROOTS]
    is_list = F.startswith(F.ltrim(text), F.lit("["))
    items = F.when(is_list, lists[0]).otherwise(F.coalesce(*lists[1:]))
    rows = df.select(F.explode(items).alias("item"))
    fields = ", ".join(f"`{f}` string" for f in (*ID_FIELDS, *NAME_FIELDS, *PRICE_FIELDS, *CATEGORY_FIELDS))
    rows = rows.select(F.from_json("item", fields).alias("i"), F.try_parse_json("item").alias("v"))

    def present(n: str) -> Column:
        value = F.col(f"i.`{n}`")
        is_text = F.schema_of_variant(F.try_variant_get("v", f"$['{n}']", "variant")) == "STRING"
        empty = (value == "") | ((value == "false") | (value.try_cast("double") == 0)) & ~F.coalesce(is_text, F.lit(False))
        return F.when(~F.coalesce(empty, F.lit(False)), value)

    def first(names: tuple[str, ...]) -> Column:
        return F.coalesce(*[present(n) for n in names])

    return rows.where(first(ID_FIELDS).isNotNull()).select(
        *_shape(first(ID_FIELDS), first(NAME_FIELDS), first(PRICE_FIELDS), first(CATEGORY_FIELDS)))


def parse_shop_products(df: DataFrame, payload: str) -> DataFrame:
    """Rows of shop-platform products, one JSON object per row; the first variant's price wins."""
    schema = "id string, title string, product_type string, category string, price string, variants array<struct<price:string>>"
    p = df.select(F.from_json(payload, schema).alias("p")).where("p.id is not null and p.id not in ('', '0')")

    def present(c: str) -> Column:
        return F.when(F.col(c) != "", F.col(c))

    price = F.coalesce(F.get("p.variants", F.lit(0))["price"], F.col("p.price"))
    return p.select(*_shape(F.col("p.id"), present("p.title"), price, F.coalesce(present("p.product_type"), present("p.category"))))


def parse_xml_feed(df: DataFrame, payload: str) -> DataFrame:
    """Rows of RSS ``item`` and Atom ``entry`` elements, whatever their namespace prefix.

    Elements are cut out by pattern, their direct children read by XPath; per column the first non-empty child in
    document order wins.  An element that is no well-formed XML is left out.
    """
    element = r"(?is)<(?:\w+:)?(?:item|entry)(?:\s[^>]*)?>.*?</(?:\w+:)?(?:item|entry)\s*>"
    rows = df.select(F.explode(F.regexp_extract_all(F.col(payload), F.lit(element), F.lit(0))).alias("xml"))
    # prefixes need no declaration once names are compared without them
    sound = F.from_xml("xml", "_corrupt_record string", {"mode": "PERMISSIVE"})["_corrupt_record"].isNull()
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def first(names: tuple[str, ...]) -> Column:
        own = " or ".join(f"translate(local-name(), '{upper}', '{lower}') = '{n}'" for n in names)
        text = F.xpath_string("xml", F.lit(f"/*/*[{own}]/text()[normalize-space()][1]"))
        return F.when(sound, F.nullif(strip(text), F.lit("")))

    found = rows.select(*[first(names).alias(c) for c, names in XML_FIELDS.items()])
    return found.where("product_id is not null").select(
        *_shape(F.col("product_id"), F.col("product_name"), F.col("price"), F.col("category")))
