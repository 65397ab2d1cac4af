"""Ranks and running sums in two levels, so that no task sees all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, pos: str, value: str, out: str = "before", block: int = 65_536) -> DataFrame:
    """Column ``out``: the sum of ``value`` over all rows before by ``pos`` (a number).

    Block sums, one row in 65,536 places, are summed up in one small window; the rows' own window runs in each block.
    """
    rows = rows.withColumn("__block", F.expr(f"{pos} div {block}"))
    sums = rows.groupBy("__block").agg(F.sum(value).alias("__n"))
    sums = sums.select("__block", F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("__block").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__own", own).join(sums, "__block").withColumn(out, F.col("__own") + F.col("__before")).drop("__own", "__before", "__block")


def hash_rank(rows: DataFrame, groups: list[str], key: Column, out: str = "rank", digits: int = 3) -> DataFrame:
    """Column ``out``: the row's place from 1 in its group by ``key`` (hex digits, as ``stream_key`` gives).

    The key's first digits deal a group to 4,096 cells of about equal size. Rows are ranked in their cell, and the
    cells' counts are summed up, so a group that holds a third of all rows is ranked by thousands of tasks.
    """
    rows = rows.withColumn("__key", key).withColumn("__cell", F.conv(F.substring("__key", 1, digits), 16, 10).cast("int"))
    counts = rows.groupBy(*groups, "__cell").agg(F.count("*").alias("__n"))
    earlier = (Window.partitionBy(*groups) if groups else Window.partitionBy()).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*groups, "__cell", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*groups, "__cell").orderBy("__key"))
    return rows.withColumn("__own", own).join(counts, [*groups, "__cell"]).withColumn(out, (F.col("__before") + F.col("__own")).cast("long")).drop("__key", "__cell", "__own", "__before")


def running_sum_by(rows: DataFrame, by: str, value: str, out: str = "before", cells: int = 4096) -> DataFrame:
    """Column ``out``: the sum of ``value`` over all rows with a smaller ``by`` (any number, distinct).

    The span of ``by`` is cut into ``cells``; the cells' sums are summed up in one small window, rows in their cell.
    """
    span = rows.agg(F.min(by).alias("__lo"), F.max(by).alias("__hi"))
    share = (F.col(by).cast("double") - F.col("__lo").cast("double")) / F.nullif(F.col("__hi").cast("double") - F.col("__lo").cast("double"), F.lit(0.0))
    rows = rows.join(F.broadcast(span)).withColumn("__cell", F.coalesce(F.least(F.floor(share * cells), F.lit(cells - 1)), F.lit(0)).cast("int")).drop("__lo", "__hi")
    sums = rows.groupBy("__cell").agg(F.sum(value).alias("__n"))
    sums = sums.select("__cell", F.coalesce(F.sum("__n").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("__cell").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__own", own).join(F.broadcast(sums), "__cell").withColumn(out, F.col("__own") + F.col("__before")).drop("__own", "__before", "__cell")
