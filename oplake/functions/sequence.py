"""Dense numbers 1..n in a global order without ordering the table in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that quantiles are asked for at a time, at most; ranges of a larger table hold more rows each.
RANGES = 1 << 16
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean", "date", "timestamp")


def _constant(values: list[float]) -> Column:
    return F.split(F.lit(",".join("Infinity" if v == math.inf else repr(v) for v in values)), ",").cast("array<double>")


def _range(cuts: list[float], value: Column) -> Column:
    """The range of a value among ascending cuts: 2i between the i-th cut and the next, 2i - 1 on the
    i-th itself, found by halving."""
    if not cuts:
        return F.lit(0).cast("long")
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    all_ = _constant(cuts + [math.inf] * (2 * steps[0] - 1 - len(cuts)))
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda p, step: p + F.when(F.element_at(all_, p + step) <= value, step).otherwise(F.lit(0)))
    place = F.least(found, F.lit(len(cuts)))
    on = F.when(place > 0, F.element_at(all_, F.greatest(place, F.lit(1))) == value).otherwise(F.lit(False))
    return (place * 2 - on.cast("int")).cast("long")


def _number(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(float("-inf")))


def _cuts(df: DataFrame, value: Column, ranges: int) -> list[float]:
    ranges = min(ranges, RANGES)
    if ranges < 2:
        return []
    return sorted(set(df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * max(ranges, 1000)).alias("q")).first().q or []))


def dense_sequence(df: DataFrame, order: list[str], name: str = "sequence", rows_per_range: int = 250_000, count: int | None = None) -> DataFrame:
    """Adds ``name``: the rank by ``order``, whose first column is a number.

    Rows are dealt into ranges of the first column at its approximate quantiles, as many as the rows
    ask for; each range is numbered on its own and raised by the count of the ranges before it.
    Where very many rows share one value, they are dealt again by the second column, if that is a
    number.  Only one count per range reaches the driver.  A null first column comes first.
    ``count``, where it is known, spares the pass that counts.
    """
    n = df.count() if count is None else count
    if n <= rows_per_range:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))
    lead = _number(F.col(order[0]))
    at = _range(_cuts(df, lead, -(-n // rows_per_range)), lead)
    found = df.groupBy(at.alias("r")).agg(F.count("*").alias("n"), F.min(order[0]).alias("low"), F.max(order[0]).alias("high")).collect()
    heavy = [r.r for r in found if r.n > 2 * rows_per_range and r.low == r.high]
    if heavy and len(order) > 1 and dict(df.dtypes)[order[1]].startswith(_NUMBERS):
        among, next_ = at.isin(heavy), _number(F.col(order[1]))
        most = max(r.n for r in found if r.r in set(heavy))
        inner = _range(_cuts(df.where(among), next_, -(-most // rows_per_range) * len(heavy)), next_)
        at = at * (4 * RANGES) + F.when(among, inner).otherwise(F.lit(0))
        found = df.groupBy(at.alias("r")).agg(F.count("*").alias("n")).collect()
    base, total = [], 0
    for r in sorted(found, key=lambda r: r.r):
        base.append((r.r, total))
        total += r.n
    before = F.broadcast(df.sparkSession.createDataFrame(base, "__range long, __before long"))  # two numbers a range
    ranked = df.withColumn("__range", at).withColumn("__rank", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return ranked.join(before, "__range").withColumn(name, F.col("__before") + F.col("__rank")).drop("__range", "__rank", "__before")
