"""Decibels and linear power."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_db(power: Column) -> Column:
    return F.lit(10.0) * F.log10(F.greatest(power, F.lit(1e-20)))


def to_power(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10.0)
