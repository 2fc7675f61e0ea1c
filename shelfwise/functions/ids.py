"""Identifier cleaning as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: texts that count as a missing identifier
NULL_TOKENS = ("", "nan", "none", "null")

_BLANKS = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c.cast("string"), F.lit(_BLANKS))


def clean_id(c: Column) -> Column:
    """Trimmed text, null as '', integral decimals without their '.0'."""
    s = strip(c)
    # the pattern only runs on the few texts that can match it
    return F.coalesce(F.when(F.endswith(s, F.lit(".0")), F.regexp_replace(s, r"^(-*\d+)\.0$", "$1")).otherwise(s), F.lit(""))


def has_id(c: Column) -> Column:
    """True when ``c`` holds a usable identifier."""
    return c.isNotNull() & ~F.lower(strip(c)).isin(*NULL_TOKENS)


def blank_to_null(c: Column) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def id_or_null(c: Column) -> Column:
    """The trimmed identifier, null for a missing one."""
    return F.when(has_id(c), strip(c))
