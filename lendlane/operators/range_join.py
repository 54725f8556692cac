"""Joining values to the ranges that hold them, by equality on bins.

The span of the values is cut into bins of several widths, each `FAN` times the one before. A range
lies in the bins of the one width at which it covers about `FAN` of them at most; a value looks into its bin of each width that
any range uses. So every pair meets once, in an equality join, and the bounds are then compared in their own
type. Ranges may overlap, be points, be of any mixture of widths, and be open at either end (a NULL bound). Where
few ranges are wide, their few bins would be hot keys: rows are spread over `SALTS` copies of each range.

A NULL or NaN value is in no range; neither is anything in a range whose bounds are reversed or NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

FAN = 16
# Bins of the least width over the whole span, as a power of FAN.
LEVELS = 7
SALTS = 4
# What the bounds of a range include.
CLOSED = {"both": (True, True), "left": (True, False), "right": (False, True), "neither": (False, False)}
_NAMES = ("range_level", "range_bin", "range_salt")


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def within(value: Column, low: Column, high: Column, closed: str = "both") -> Column:
    """Whether a value lies in a range; a NULL bound is no bound."""
    with_low, with_high = CLOSED[closed]
    above = value >= low if with_low else value > low
    below = value <= high if with_high else value < high
    return F.coalesce(above, low.isNull()) & F.coalesce(below, high.isNull())


def range_join(rows: DataFrame, ranges: DataFrame, value: str, low: str, high: str, how: str = "inner", key: str | None = None,
               closed: str = "both", salts: int = SALTS) -> DataFrame:
    """Each row with every range that holds its `value`. `rows` is a stored table: its span is looked up first.

    With `how="left"`, rows in no range come too, with NULLs; `key` then names a column that tells rows apart.
    """
    if set(rows.columns) & set(ranges.columns):
        raise ValueError("rows and ranges must not share column names")
    if how not in ("inner", "left") or (how == "left" and key is None):
        raise ValueError("how is inner, or left with a key")
    as_double = lambda c: F.col(c).cast("double")
    found = _matched(rows, ranges, value, low, high, closed, salts, as_double)
    if how == "inner":
        return found
    alone = rows.join(found.select(key).distinct(), key, "left_anti").select(*rows.columns)
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in ranges.schema.fields]
    return found.unionByName(alone.select(*rows.columns, *nothing))


def _matched(rows, ranges, value, low, high, closed, salts, as_double) -> DataFrame:
    number = as_double(value)
    first, last = rows.where(_finite(number)).agg(F.min(number), F.max(number)).first()
    first, last = (0.0, 0.0) if first is None else (first, last)
    width = (last - first) / FAN**LEVELS or 1.0
    # Values beyond the finite span count as at its ends. It keeps the order, and so do bins.
    within_span = lambda x: F.least(F.greatest(x, F.lit(first)), F.lit(last)) - F.lit(first)
    bin_at = lambda x, level: F.floor(x / (F.lit(width) * F.pow(F.lit(float(FAN)), level))).cast("bigint")
    begin = within_span(F.coalesce(as_double(low), F.lit(first)))
    end = within_span(F.coalesce(as_double(high), F.lit(last)))
    level = F.greatest(F.lit(0.0), F.ceil(F.log(F.greatest(end - begin, F.lit(width)) / (F.lit(width) * FAN)) / math.log(FAN)))
    sound = ~F.coalesce(F.isnan(as_double(low)) | F.isnan(as_double(high)), F.lit(False)) & F.coalesce(F.col(low) <= F.col(high), F.lit(True))
    laid = ranges.where(sound).withColumn(_NAMES[0], level.cast("int"))
    # At most LEVELS + 1 numbers.
    levels = sorted(r[0] for r in laid.select(_NAMES[0]).distinct().collect())
    laid = laid.withColumn(_NAMES[1], F.explode(F.sequence(bin_at(begin, F.col(_NAMES[0])), bin_at(end, F.col(_NAMES[0]))))).withColumn(
        _NAMES[2], F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    plain = [c for c, t in rows.dtypes if not t.startswith(("map", "variant", "struct", "array"))]
    at = F.array(*[F.struct(F.lit(x).cast("int").alias(_NAMES[0]), bin_at(within_span(number), F.lit(float(x))).alias(_NAMES[1])) for x in levels])
    if not levels:
        at = F.array().cast(f"array<struct<{_NAMES[0]}:int,{_NAMES[1]}:bigint>>")
    looking = rows.where(F.col(value).isNotNull() & ~F.isnan(number)).select(
        *rows.columns, F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int").alias(_NAMES[2]), F.inline(at))
    met = looking.join(laid, list(_NAMES))
    return met.where(within(F.col(value), F.col(low), F.col(high), closed)).select(*rows.columns, *ranges.columns)
