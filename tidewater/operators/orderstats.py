"""Order statistics of groups of any size: exact, and no group in one array.

A mergeable sketch gives each group a grid of approximate quantiles; a wanted place lies
between two of its points, so only the rows between them, grouped by value, are ordered, and
all below are a count.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points of the grid, and the sketch's accuracy: a point's rank is off by 1 / ACCURACY of the rows at most.
GRID, ACCURACY = 256, 10_000


def order_statistics(df: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``by, n`` and a column per name of ``places``: the sorted values at the place (from 0) that the function makes of n.

    Null values do not count, and a group of nothing else has no row; a place outside of the
    group gives null.  Equal values are interchangeable, so ties settle nothing.  What one
    task orders of a group is the distinct values of some grid cells around the places.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    grid = F.percentile_approx("_v", [i / GRID for i in range(GRID + 1)], ACCURACY)
    sketch = rows.groupBy(*by).agg(F.count("*").alias("n"), grid.alias("_g")).withColumns({f"_p{i}": f(F.col("n")) for i, f in enumerate(places.values())})
    least, most = (reduce(f, [F.col(f"_p{i}") for i in range(len(places))]) if len(places) == 1 else f(*[F.col(f"_p{i}") for i in range(len(places))]) for f in (F.least, F.greatest))
    share = lambda place: place / F.greatest(F.col("n") - 1, F.lit(1)) * GRID
    low, high = F.floor(share(least)) - 1, F.ceil(share(most)) + 1
    sketch = sketch.withColumns({"_lo": F.when(low >= 0, F.try_element_at("_g", (low + 1).cast("int"))), "_hi": F.when(high <= GRID, F.try_element_at("_g", (high + 1).cast("int")))}).drop("_g")
    near = rows.join(sketch, by).where(F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi")))
    inside = F.col("_lo").isNull() | (F.col("_v") >= F.col("_lo"))
    names = ["n", *[f"_p{i}" for i in range(len(places))]]
    counted = near.groupBy(*by, F.when(inside, F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"), *[F.first(c).alias(c) for c in names])
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = counted.withColumn("_upto", upto).where(F.col("_v").isNotNull())
    at = lambda p: F.min(F.when((F.col(p) >= 0) & (F.col("_upto") > F.col(p)), F.col("_v")))
    return found.groupBy(*by).agg(F.first("n").alias("n"), *[at(f"_p{i}").alias(name) for i, name in enumerate(places)])


def upper_median(n: Column) -> Column:
    """The place of the middle value; of two the greater."""
    return F.floor(n / 2)


def nearest_rank(q: float) -> Callable[[Column], Column]:
    """The place int(q * (n - 1) + 0.5)."""
    return lambda n: F.floor((n - 1) * q + 0.5)


def peer_median_in_order(df: DataFrame, by: list[str], value: str, least: int = 3) -> DataFrame:
    """:func:`peer_median` where groups are many and small: one shuffle and one sort, each group's rows in one task."""
    # rows that belong to no group meet nobody: they are spread by their value
    alone = F.when(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in by]), F.xxhash64(value))
    group = Window.partitionBy(*by, "_alone").orderBy(F.col(value).asc_nulls_last())
    every = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = df.withColumn("_alone", alone).withColumns({"_at": F.row_number().over(group) - 1, "_n": F.count(value).over(every)})
    first = F.floor((F.col("_n") - 2) / 2)
    at = lambda i: F.max(F.when(F.col("_at") == F.least(first + i, F.col("_n") - 1), F.col(value))).over(every)
    return _relative(placed.withColumns({f"_s{i}": at(i) for i in range(3)}), value, F.col("_n"), F.col("_alone").isNull(), least).drop("_alone", "_at", "_n", "_s0", "_s1", "_s2")


def _relative(both: DataFrame, value: str, n: Column, grouped: Column, least: int) -> DataFrame:
    """``relative`` from a group's size and the three values around its middle, ``_s0`` to ``_s2``."""
    # the others' k-th value is the group's, one further on if the row itself stands before it
    other = lambda k: F.when(F.col(value) > F.col(f"_s{k}"), F.col(f"_s{k}")).otherwise(F.col(f"_s{k + 1}"))
    middle = F.when(n % 2 == 0, other(0)).otherwise((other(0) + other(1)) / 2)
    return both.withColumn("relative", F.when(grouped & F.col(value).isNotNull() & (n - 1 >= least), F.col(value) - middle))


def peer_median(df: DataFrame, group: str | list[str], value: str, least: int = 3) -> DataFrame:
    """Each row's value less the median of the other members of its group, as ``relative``; null for a null value or with fewer than ``least`` others.

    Without one of its members a group's middle lies on one of three of its values, whatever the
    member: those three go back to the rows.
    """
    by = [group] if isinstance(group, str) else group
    first = lambda n: F.floor((n - 2) / 2)  # noqa: E731  of n - 1 others the lower middle one
    places = {f"_s{i}": (lambda n, i=i: F.least(first(n) + i, n - 1)) for i in range(3)}
    found = order_statistics(df, by, value, places)
    return _relative(df.join(found, by, "left"), value, F.col("n"), F.lit(True), least).drop("n", *places)
