"""Ordered windows over groups of any size.

A group with more than ``HOT_ROWS`` rows isn't one task: its rows are dealt by range of the order, a window sees one slice of a group, and what it needs from the slices before
(the last value, the last few rows) is handed over.  Other groups are windows as usual, with the same results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions import exprs as E

HOT_ROWS = 5_000_000


def hot_groups(df: DataFrame, keys: list[str], limit: int = HOT_ROWS) -> dict[str, list[str]]:
    """For each of the columns ``keys``, its values with more than ``limit`` rows: at most rows / ``limit`` of them."""
    one = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in keys))).alias("x")).select("x.k", "x.v")
    found = one.where("v is not null").groupBy("k", "v").count().where(F.col("count") > limit).collect()
    return {k: sorted(r["v"] for r in found if r["k"] == k) for k in keys}


def apart(df: DataFrame, key: str, hot: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of the hot groups and the others, those without key among these."""
    one = F.coalesce(F.col(key).cast("string").isin(hot), F.lit(False))
    return df.where(one), df.where(~one)


def slices(df: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``_slice``, computed once, and a row for each group and slice: ``_start`` (rows of the group before it) and ``_before`` (the last value of the
    first of ``order`` there).  Rows that are equal in ``order`` share a slice."""
    ranged = E.cut(df.repartitionByRange(key, *order).withColumn("_slice", F.spark_partition_id()))
    sums = ranged.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_rows"), F.max(order[0]).alias("_last"))
    turn = Window.partitionBy(key).orderBy("_slice")
    starts = sums.select(key, "_slice", F.coalesce(F.sum("_rows").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.lag("_last").over(turn).alias("_before"))
    return ranged, E.cut(starts)


def lagged(df: DataFrame, key: str, order: list[str], out: str, hot: list[str], group: list[Column]) -> DataFrame:
    """``df`` with the value that the first of ``order`` has in the row before, within ``group`` (the key, or more where it is null)."""
    name = order[0]
    some, rest = apart(df, key, hot) if hot else (None, df)
    rest = rest.withColumn(out, F.lag(name).over(Window.partitionBy(*group).orderBy(*order)))
    if some is None:
        return rest
    rows, starts = slices(some, key, order)
    rows = rows.join(F.broadcast(starts), [key, "_slice"])  # a row for each hot group and slice
    rows = rows.withColumn(out, F.coalesce(F.lag(name).over(Window.partitionBy(key, "_slice").orderBy(*order)), "_before"))
    return rest.unionByName(rows.select(*rest.columns))


def first_of_pair(df: DataFrame, key: str, other: str, order: list[str], out: str, hot: list[str], group: list[Column]) -> DataFrame:
    """``out`` 1.0 in the first row of each pair of key and other, else 0.0; of rows that are equal in ``order`` one is the first."""
    some, rest = apart(df, key, hot) if hot else (None, df)
    rest = rest.withColumn(out, (F.row_number().over(Window.partitionBy(*group, other).orderBy(*order)) == 1).cast("double"))
    if some is None:
        return rest
    first = some.groupBy(key, other).agg(F.min(F.struct(*order)).alias("_first")).withColumnsRenamed({key: "_key", other: "_other"})
    rows = some.join(first, (F.col(key) == F.col("_key")) & F.col(other).eqNullSafe(F.col("_other")), "left")
    again = F.row_number().over(Window.partitionBy(key, other, *order).orderBy(F.lit(0)))
    return rest.unionByName(rows.withColumn(out, ((F.struct(*order) == F.col("_first")) & (again == 1)).cast("double")).select(*rest.columns))


def trailing_mean(df: DataFrame, key: str, order: list[str], name: str, rows: int, out: str, hot: list[str], group: list[Column]) -> DataFrame:
    """``df`` with the mean of ``name`` over the last ``rows`` rows of the group, this one included."""
    some, rest = apart(df, key, hot) if hot else (None, df)
    rest = rest.withColumn(out, F.avg(name).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(-(rows - 1), 0)))
    if some is None:
        return rest
    dealt, starts = slices(some, key, order)
    inside = Window.partitionBy(key, "_slice")
    numbered = dealt.join(F.broadcast(starts), [key, "_slice"]).withColumn("_n", F.col("_start") + F.row_number().over(inside.orderBy(*order)))
    numbered = E.cut(numbered.withColumn("_left", F.count(F.lit(1)).over(inside) + F.col("_start") - F.col("_n")))
    # the last rows before a slice: numbers _start - rows + 2 to _start, from whichever slices
    tails = numbered.where((F.col("_left") < rows - 1)).select(key, "_n", name, F.explode(F.sequence(F.col("_n"), F.col("_n") + rows - 2)).alias("_start"))
    handed = tails.join(F.broadcast(starts.where("_start > 0").select(key, "_start", "_slice")), [key, "_start"]).select(key, "_slice", "_n", name, F.lit(False).alias("_own"))
    both = numbered.select(key, "_slice", "_n", name, F.lit(True).alias("_own")).unionByName(handed)
    means = both.withColumn(out, F.avg(name).over(inside.orderBy("_n").rowsBetween(-(rows - 1), 0))).where("_own").select(key, "_slice", "_n", out)
    return rest.unionByName(numbered.join(means, [key, "_slice", "_n"]).select(*rest.columns))
