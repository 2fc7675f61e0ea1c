"""Expression helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rounded(c: Column, digits: int) -> Column:
    """Round the scaled double half away from zero: the binary value decides, not its decimal text."""
    scale = 10.0 ** digits
    return F.round(c * scale) / scale
