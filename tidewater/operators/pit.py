"""Point-in-time reads: a row is visible only when it was knowable strictly before the instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(df: DataFrame, instant: Column, knowable: str = "knowable_at") -> DataFrame:
    """The rows that were knowable strictly before an instant."""
    return df.where(F.col(knowable) < instant)


def between(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Optional bounds: a bound that is None does not appear in the plan."""
    if start is not None:
        df = df.where(F.col(column) >= start)
    return df if end is None else df.where(F.col(column) <= end)


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each key's last row by ``order`` (name a unique column last, so that ties are settled).

    One aggregation with map-side combination: no window sorts a hot key's rows.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def last_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key; the position counts back from 1 in ``recency``."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, right_order: list[str], values: list[str]) -> DataFrame:
    """Each left row with the last right row of its key strictly before it (nulls where there is none).

    Both sides are laid out in one order per key and the last right row is carried
    forward: one shuffle and one sort, whatever the number of matches.  At equal instants
    the left row sorts first, which keeps the boundary strict.
    """
    mark = F.struct(*[F.col(c) for c in values])
    a = left.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(mark.alias("m")).schema["m"].dataType).alias("_right"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(right_order)])
    b = right.select(*keys, F.col(right_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), mark.alias("_right"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(right_order)])
    w = Window.partitionBy(*keys).orderBy("_at", "_side", *[f"_o{i}" for i in range(len(right_order))]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where("_side = 0")
    return both.select("_left.*", *[F.col(f"_right.`{c}`").alias(c if c not in left.columns else f"right_{c}") for c in values])


def asof_many(left: DataFrame, facts: dict[str, tuple[DataFrame, str, list[str], list[str]]], keys: list[str], at: str) -> DataFrame:
    """Each left row with a struct per kind of fact: its key's last one strictly before the row (null without one).

    ``facts``: kind to (table, its time, its order at one time, its values).  All kinds and the
    left rows are laid out in one order, and the last row of every kind is carried forward:
    one shuffle and one sort, however many kinds there are.
    """
    kinds = {k: df.select(F.struct(*values).alias("v")).schema["v"].dataType for k, (df, _, _, values) in facts.items()}
    # each kind has its own order columns: between kinds of one time the order does not matter
    orders = {(k, i): df.schema[c].dataType for k, (df, _, order, _) in facts.items() for i, c in enumerate(order)}
    whole = left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType

    def laid(df: DataFrame, time: str, side: int, row, of: str | None = None, order: list[str] = (), values: list[str] = ()) -> DataFrame:
        held = [(F.struct(*values) if k == of else F.lit(None).cast(t)).alias(f"_{k}") for k, t in kinds.items()]
        places = [(F.col(order[i]) if k == of else F.lit(None).cast(t)).alias(f"_o_{k}_{i}") for (k, i), t in orders.items()]
        return df.select(*keys, F.col(time).alias("_at"), F.lit(side).alias("_side"), row.alias("_row"), *held, *places)

    both = laid(left, at, 0, F.struct(*left.columns))
    for k, (df, time, order, values) in facts.items():
        both = both.unionByName(laid(df, time, 1, F.lit(None).cast(whole), k, order, values))
    w = Window.partitionBy(*keys).orderBy("_at", "_side", *[f"_o_{k}_{i}" for k, i in orders]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumns({f"_{k}": F.last(f"_{k}", ignorenulls=True).over(w) for k in kinds}).where("_side = 0")
    return carried.select("_row.*", *[F.col(f"_{k}").alias(k) for k in kinds])


def first_match(left: DataFrame, right: DataFrame, on: Column, left_id: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """Each left row with its first matching right row by ``order`` (a lateral join with limit 1)."""
    met = left.alias("l").join(right.alias("r"), on).groupBy(*[F.col(f"l.{c}").alias(c) for c in left_id])
    best = met.agg(F.min_by(F.struct(*[F.col(f"r.{v}").alias(v) for v in values]), F.struct(*order)).alias("_m"))
    return left.join(best, left_id, "left").select(*left.columns, *[F.col(f"_m.`{v}`").alias(v) for v in values])


def sessions(days: DataFrame, day: str = "day") -> DataFrame:
    """The session axis: distinct days with a dense index and both neighbours."""
    w = Window.orderBy(day)  # a calendar: some hundred rows a year, whatever the data
    return days.select(day).distinct().select(day, F.row_number().over(w).alias("session_idx"), F.lag(day).over(w).alias("previous_session"), F.lead(day).over(w).alias("next_session"))


def spine(keys: DataFrame, axis: DataFrame, rows: DataFrame, key: str, day: str) -> DataFrame:
    """Every key on every session with its row, or nulls: a dense axis.

    The axis is a calendar and is broadcast; keys are not.
    """
    return keys.select(key).distinct().join(F.broadcast(axis), F.lit(True)).join(rows, [key, day], "left")


def islands(df: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """Runs of equal state in a row: key, state, first, last, length."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = (~F.col(state).eqNullSafe(F.lag(state).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    run = df.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(w))
    return run.groupBy(*keys, "_run", state).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("_run")


def insert_if_absent(stored: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Append-only write: the rows to append, and the conflicts (same key, other values)."""
    absent = new.join(stored.select(*keys), keys, "left_anti")
    old = stored.select(*keys, *[F.col(v).alias(f"_old_{v}") for v in values])
    differs = ~F.expr(" AND ".join(f"`{v}` <=> `_old_{v}`" for v in values))
    return absent, new.join(old, keys).where(differs).select(*new.columns)


def master_diff(current: DataFrame, master: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """What a new master list does to the stored one: NEW, CHANGED, SEEN or GONE per key."""
    a = current.select(key, F.struct(*attributes).alias("_a"))
    b = master.select(key, F.struct(*attributes).alias("_b"))
    state = F.when(F.col("_a").isNull(), "NEW").when(F.col("_b").isNull(), "GONE").when(F.col("_a").eqNullSafe(F.col("_b")), "SEEN").otherwise("CHANGED")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))
