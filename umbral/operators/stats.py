"""Counts, profiles and correlations, each in one aggregation where it can be."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bands import running


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def count(df: DataFrame, col: str | None = None) -> DataFrame:
    return df.agg(F.count(F.lit(1) if col is None else col).alias("n"))


def _long(row: DataFrame, names: list[str], value: str) -> DataFrame:
    return row.unpivot([], [F.col(c) for c in names], "column", value)


def count_nulls(df: DataFrame) -> DataFrame:
    """column, nulls."""
    return _long(df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]), df.columns, "nulls")


def nunique(df: DataFrame, *, with_null: bool = True, approx: bool = False) -> DataFrame:
    """column, n_unique; null counts as a value unless told otherwise.

    Exact counts unpivot to (column, value) and count distinct pairs, so no column blows up the plan."""
    if approx:
        row = df.agg(*[(F.approx_count_distinct(c) + (F.max(F.col(c).isNull().cast("int")) if with_null else F.lit(0))).alias(c) for c in df.columns])
        return _long(row, df.columns, "n_unique")
    long = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], [F.col(c) for c in df.columns], "column", "value")
    pairs = long.distinct()
    return pairs.groupBy("column").agg((F.count("*") if with_null else F.count("value")).alias("n_unique"))


def profile_columns(df: DataFrame, *, approx: bool = False) -> DataFrame:
    """column, dtype, nulls, n_unique (null counts as a value; approximate if asked)."""
    kinds = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    return count_nulls(df).join(nunique(df, approx=approx), "column").select("column", kinds[F.col("column")].alias("dtype"), "nulls", "n_unique")


def value_counts(df: DataFrame, col: str, *, normalize: bool = False, n: int = 20) -> DataFrame:
    """The n most frequent values; shares are of those n."""
    top = df.groupBy(col).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.col(col).asc_nulls_last()).limit(n)
    return top.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy())) if normalize else top


def describe(df: DataFrame, columns: list[str] | None = None, percentiles=(0.25, 0.5, 0.75)) -> DataFrame:
    """column, count, null_count, mean, std, min, percentiles, max of numeric columns, in one pass."""
    names = columns or numeric(df)
    stats = [F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.count_if(F.col(c).isNull()).alias("null_count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), *[F.percentile(c, F.lit(p)).alias(f"p{round(p * 100)}") for p in percentiles], F.max(c).cast("double").alias("max")) for c in names]
    return df.agg(F.array(*stats).alias("all")).select(F.inline("all"))


def ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as average ranks; ties share the mean of their places. Ranks come from cumulated value counts."""
    out = df.select(*columns)
    for c in columns:
        freq = out.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("__n"))
        freq = running(freq, {"__n": "__up"}, c).select(F.col(c).alias("__v"), (F.col("__up") - (F.col("__n") - 1) / 2).alias("__r"))
        out = out.join(freq, F.col(c) == F.col("__v"), "left").withColumn(c, F.col("__r")).drop("__v", "__r")
    return out


def corr(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """a, b, corr for each pair of columns (pairs of rows with both), in one aggregation; spearman ranks first;
    kendall counts concordances of pairs of distinct values."""
    names = columns or numeric(df)
    pairs = list(combinations(names, 2))
    if method == "kendall":
        return _kendall(df, pairs)
    if method == "spearman":
        parts = [ranks(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), [a, b]).agg(F.corr(a, b).alias("corr")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "corr") for a, b in pairs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    if method != "pearson":
        raise ValueError(f"no method: {method}")
    made = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("corr")) for a, b in pairs]
    return df.agg(F.array(*made).alias("all")).select(F.inline("all"))


def _kendall(df: DataFrame, pairs) -> DataFrame:
    """tau-b over a grid of value counts; meant for columns of few distinct values."""
    out = None
    for a, b in pairs:
        g = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).agg(F.count("*").cast("double").alias("n"))
        h = g.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("n").alias("n2"))
        w = F.col("n") * F.col("n2")
        s = g.join(h, F.col("x") < F.col("x2")).agg(F.sum(w * F.signum(F.col("y2") - F.col("y"))).alias("s"))
        t = lambda c: g.groupBy(c).agg(F.sum("n").alias("n")).agg((F.sum("n") * (F.sum("n") - 1) / 2 - F.sum(F.col("n") * (F.col("n") - 1) / 2)).alias("t"))
        one = s.crossJoin(t("x").withColumnRenamed("t", "tx")).crossJoin(t("y").withColumnRenamed("t", "ty"))
        one = one.select(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col("s") / F.sqrt(F.col("tx") * F.col("ty"))).alias("corr"))
        out = one if out is None else out.unionByName(one)
    return out


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def schema(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def info(df: DataFrame) -> str:
    """A printed summary: shape, types, nulls."""
    rows = df.agg(F.count("*"), *[F.count_if(F.col(c).isNull()) for c in df.columns]).first()
    lines = [f"{rows[0]} rows x {len(df.columns)} columns"]
    lines += [f"{n:<24} {kind:<16} {rows[i + 1] / max(rows[0], 1):.1%} null" for i, (n, kind) in enumerate(df.dtypes)]
    return "\n".join(lines)


def diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """column, changed_pct, nulls before and after, by a row key."""
    names = [c for c in before.columns if c in after.columns and c != key]
    both = before.select(key, *[F.col(c).cast("string").alias(f"a_{c}") for c in names]).join(after.select(key, *[F.col(c).cast("string").alias(f"b_{c}") for c in names]), key)
    made = [F.struct(F.lit(c).alias("column"), (100 * F.avg((~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).cast("double"))).alias("changed_pct"), F.count_if(F.col(f"a_{c}").isNull()).alias("nulls_before"), F.count_if(F.col(f"b_{c}").isNull()).alias("nulls_after")) for c in names]
    return both.agg(F.array(*made).alias("all")).select(F.inline("all"))
