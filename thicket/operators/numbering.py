"""Running sums and numbers over an order, without a window over a whole key or table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, keys: list[str], order: list[str], slices: Column | str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of the same keys up to each, in ``order``, as ``name``.

    ``slices`` says which slice of the order a row is in and must not fall as
    the order rises. Each slice is summed up in a task of its own; only the
    slices' totals, a row for each, are summed up over a key. So the keys may
    be few, hot or none, as long as the slices are many and of bounded size.
    Without keys, ``slices`` may name a column that is never null; the result
    is then dealt by it.
    """
    # keys and slice as one value, which is never null: so the join is dealt as the window before it
    at, part = slices, rows
    if not isinstance(slices, str):
        at, part = "_at", rows.withColumn("_at", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], slices.alias("slice")))
    totals = part.groupBy(at).agg(F.sum(value).alias("_total"))
    apart = Window.partitionBy(*[F.col(f"_at.k{i}") for i in range(len(keys))])
    before = totals.select(at, F.sum("_total").over(apart.orderBy(f"{at}.slice" if at == "_at" else at).rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = part.withColumn("_inside", F.sum(value).over(Window.partitionBy(at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return inside.join(before, at).select(*rows.columns, (F.coalesce("_before", F.lit(0)) + F.col("_inside")).alias(name))


def numbered(rows: DataFrame, keys: list[str], order: list[str], slices: Column, name: str, first: int = 1) -> DataFrame:
    """``rows`` with their number in order within the keys."""
    found = running(rows.withColumn("_one", F.lit(1).cast("long")), keys, order, slices, "_one", name)
    return found.drop("_one").withColumn(name, F.col(name) + F.lit(first - 1))
