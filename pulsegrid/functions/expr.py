"""Small helpers for expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once a row: a plain column would be put in each place, within lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
