"""Helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often then names it."""
    return F.get(F.transform(F.array(value), then), 0)
