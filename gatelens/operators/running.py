"""Running totals along time that stay distributed for a hot key.

A window over ``partitionBy(key)`` sorts all rows of one key in one task; a provider may own a third of the log. Here
every key is cut into slices along the order: rows are accumulated inside their (key, slice), and the totals of the
earlier slices come from a table with one row per (key, slice). These totals are carried in two levels, inside blocks of
``BLOCK`` slices and over the blocks, so that no task sees more than a block's slices or a key's blocks.

Slices are short stretches of time, and the plan is the same at every size. Rows that all have one time (a wrong clock) share
a slice: Spark sorts it in one task, on disk if need be.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    # greatest / least skip NULL
    return F.greatest(carried, local) if kind == "max" else F.least(carried, local)


def running(
    df: DataFrame,
    key: list[str],
    order: list[str],
    slice_by: Column,
    totals: dict[str, tuple[str, Column]],
    *,
    reverse: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Add running ``totals`` = {name: ("sum" | "max" | "min", column)} per key in the given order.

    ``slice_by`` must grow with the first order column, so that slices follow the order. ``reverse`` runs from the end;
    ``inclusive=False`` leaves the row itself out. Keys must not be NULL.
    """
    values = {f"__v_{name}": column for name, (_, column) in totals.items()}
    sliced = df.withColumns({"__slice": slice_by, **values})
    per_slice = sliced.groupBy(*key, "__slice").agg(
        *[_AGG[kind](f"__v_{name}").alias(f"__s_{name}") for name, (kind, _) in totals.items()]
    )

    def directed(columns: list[str]) -> list[Column]:
        return [F.col(c).desc() if reverse else F.col(c).asc() for c in columns]

    def earlier(rows: DataFrame, groups: list[str], by: str, prefix: str) -> DataFrame:
        """The totals before each row of its group."""
        before = Window.partitionBy(*groups).orderBy(*directed([by])).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({f"{prefix}{name}": _AGG[kind](f"__s_{name}").over(before) for name, (kind, _) in totals.items()})

    blocked = per_slice.withColumn("__block", int_div(F.col("__slice"), BLOCK))
    blocks = blocked.groupBy(*key, "__block").agg(
        *[_AGG[kind](f"__s_{name}").alias(f"__s_{name}") for name, (kind, _) in totals.items()]
    )
    over_blocks = earlier(blocks, key, "__block", "__b_").drop(*[f"__s_{name}" for name in totals])
    carried = (
        earlier(blocked, [*key, "__block"], "__slice", "__i_")
        .join(over_blocks, [*key, "__block"])
        # the first slice of a key carries nothing: most short keys never reach the join with the rows
        .filter(reduce(or_, [F.col(f"__{level}_{name}").isNotNull() for name in totals for level in "bi"]))
        .select(*key, "__slice", *[
            _combine(kind, F.col(f"__b_{name}"), F.col(f"__i_{name}")).alias(f"__c_{name}") for name, (kind, _) in totals.items()
        ])
    )

    frame = Window.unboundedPreceding, (0 if inclusive else -1)
    inside = Window.partitionBy(*key, "__slice").orderBy(*directed(order)).rowsBetween(*frame)
    local = sliced.withColumns(
        {f"__l_{name}": _AGG[kind](f"__v_{name}").over(inside) for name, (kind, _) in totals.items()}
    )
    # the window output is already partitioned and sorted by (key, slice): the join adds no shuffle of the big side
    joined = local.join(carried, [*key, "__slice"], "left")
    combined = [
        _combine(kind, F.col(f"__c_{name}"), F.col(f"__l_{name}")).alias(name) for name, (kind, _) in totals.items()
    ]
    return joined.select(*[F.col(c) for c in df.columns], *combined)


def int_div(column: Column, n: int) -> Column:
    """Whole part of a division. Never NULL for a non-null input, and declared so: Catalyst then adds no null filters,
    and plans that read the same shuffle twice stay equal and share it.
    """
    return F.coalesce(F.call_function("div", column, F.lit(n).cast("bigint")), F.lit(0).cast("bigint"))


def time_slice(us: str | Column, seconds: int) -> Column:
    """Slice number of a time in microseconds."""
    column = F.col(us) if isinstance(us, str) else us
    return int_div(column, seconds * 1_000_000)
