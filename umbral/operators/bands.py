"""Orders over whole tables without a task that sees a whole table: rows are cut into bands of the order, windows run
within bands, and what crosses bands is a row per band."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BANDS, SAMPLE = 64, 4096


def banded(df: DataFrame, by: list[str]) -> DataFrame:
    """df with __band: 0 for the first rows by these columns (ascending, nulls first), at most BANDS in all.

    Bounds come from SAMPLE random rows, at once; they set how even the bands are, not what results are. Rows that are
    equal in all columns share a band. Without columns, bands are partitions in reading order and __at numbers rows."""
    if not by:
        return df.withColumn("__at", F.monotonically_increasing_id()).withColumn("__band", F.shiftright("__at", 33))
    kinds = dict(df.select(*by).dtypes)
    rows = df.select(*by).orderBy(F.rand(42)).limit(SAMPLE).orderBy(*by).collect()
    bounds = list(dict.fromkeys(tuple(r) for r in rows[:: max(1, len(rows) // BANDS)][1:]))
    key = F.struct(*by)
    above = [(key >= F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(by, b, strict=True)])).cast("int") for b in bounds]
    return df.withColumn("__band", reduce(Column.__add__, above, F.lit(0)))


def _beside(df: DataFrame, totals: DataFrame) -> DataFrame:
    return df.join(totals.withColumnRenamed("__band", "__of"), F.col("__band") == F.col("__of"), "left")


def fill(df: DataFrame, names: list[str], by: list[str], forward: bool) -> DataFrame:
    """df with nulls of names replaced by the last value before them, or the next one after.

    Backward, rows are taken in the opposite order: a frame that ends with its band would be read anew for every row."""
    kept, rows = df.columns, banded(df, by)
    order = by or ["__at"]
    turn, best = (F.asc, F.max_by) if forward else (F.desc, F.min_by)
    inside = Window.partitionBy("__band").orderBy(*[turn(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.orderBy(turn("__band")).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("__band").agg(*[best(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"__end{i}") for i, c in enumerate(names)])
    ends = ends.select("__band", *[F.last(f"__end{i}", ignorenulls=True).over(across).alias(f"__end{i}") for i in range(len(names))])
    made = {c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"__end{i}")) for i, c in enumerate(names)}
    return _beside(rows, ends).withColumns(made).select(*kept)


def running(df: DataFrame, values: dict[str, str], by: str) -> DataFrame:
    """df with the sums of columns (name: the sum's name) over all rows up to each row by a column whose values differ."""
    kept, rows = df.columns, banded(df, [by])
    before = Window.orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("__band").agg(*[F.sum(v).alias(f"__sum{i}") for i, v in enumerate(values)])
    sums = sums.select("__band", *[F.coalesce(F.sum(f"__sum{i}").over(before), F.lit(0)).alias(f"__base{i}") for i in range(len(values))])
    inside = Window.partitionBy("__band").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    made = {name: F.col(f"__base{i}") + F.sum(v).over(inside) for i, (v, name) in enumerate(values.items())}
    return _beside(rows, sums).withColumns(made).select(*kept, *made)
