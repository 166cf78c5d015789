"""Milliseconds, samples, seconds and decibels; whole numbers are cut off toward zero."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 44100
#: least magnitude in decibel conversion
FLOOR = 1e-10


def ms_to_sample(ms: Column, rate: int = RATE) -> Column:
    """Multiply, divide, cut."""
    return (ms * rate / 1000).cast("long")


def sample_to_ms(sample: Column, rate: int = RATE) -> Column:
    """Divide first, then multiply and cut: not the same as whole-number arithmetic."""
    return (sample / rate * 1000).cast("long")


def seconds_to_ms(seconds: Column) -> Column:
    """Cut the double product: 1.001 s is 1000 ms."""
    return (seconds.cast("double") * F.lit(1e3)).cast("long")


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / F.lit(20.0))


def linear_to_db(value: Column) -> Column:
    return F.lit(20.0) * F.log10(F.greatest(F.abs(value), F.lit(FLOOR)))


def wall_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    micros = (F.extract(F.lit("SECOND"), ts) * 1000000).cast("long")
    return day * 86_400_000 + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.floor(micros / 1000)


def _round4(values: pd.Series) -> pd.Series:
    value = values.to_numpy(np.float64)
    scaled = value * 1e4
    out = np.rint(scaled) / 1e4
    # the product is not exact: near ties, and where it has no decimals left, the exact value decides
    close = np.flatnonzero((np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6) | (np.abs(scaled) > 1e9))
    out[close] = [round(v, 4) for v in value[close].tolist()]
    return pd.Series(out).where(values.notna().to_numpy())


def round4(value: Column) -> Column:
    """Four decimals by the exact binary value, ties to even; built-in rounding goes by the printed value."""
    return F.pandas_udf(_round4, "double")(value)


def job_id(location: Column) -> Column:
    """Last part of a location, without slashes at its end."""
    return F.element_at(F.split(F.regexp_replace(location, "/+$", ""), "/"), -1)
