"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Slot t of the mix lies at the golden-ratio point frac(t g); the sources' cumulative target shares turn points into
sources, so every stretch of the schedule follows the weights. A slot's rank within its source picks a block of
`block` words of that source's shuffled stream of documents, going round at most `epochs` times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, ranked

#: floor(2^32 / golden ratio), odd; multiples modulo 2^32 are the schedule's points.
GOLDEN = 2654435769
SPACES = " \t\n\x0b\f\r"


def n_words(text):
    """The number of [^\\x20\\x09-\\x0D]+; 0 for null."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).otherwise(0).cast("long")


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A broadcast hint, but only for a table that was counted and is small."""
    return F.broadcast(df) if df.count() <= most else df


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Of source, source_size: also place (from 0, by code point, null last), target, low and high (the share of the mix).

    Targets follow the weights and stop at cap * source_size; what that leaves is shared again by weight, until none is
    above: with sources by cap / weight, the capped ones come first.
    """
    by = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    df = sizes.withColumn("place", F.row_number().over(by) - 1)
    df = df.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    df = df.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    ahead, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    df = df.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    df = df.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))) / F.sum("weight").over(behind))
    df = df.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    df = df.withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(every))
    df = df.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("level") * F.col("weight")))
    up = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("all_targets", F.sum("target").over(every)).withColumn("high", F.when(F.col("all_targets") > 0, F.sum("target").over(up) / F.col("all_targets")).otherwise(0.0))
    df = df.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("place")), F.lit(0.0)))
    df = df.withColumn("high", F.when(F.col("place") == F.max("place").over(every), F.lit(1.0)).otherwise(F.col("high")))
    return df.select("source", "source_size", "place", "target", "low", "high")


def schedule(plan: DataFrame, slots: int, buckets: int = 1024, stretch: int = 4096) -> DataFrame:
    """t, place (of the source), rank (of the slot within its source, from 0)."""
    spark = plan.sparkSession
    points = spark.range(slots).select(F.col("id").alias("t"), (F.pmod(F.pmod("id", F.lit(1 << 31)) * F.lit(GOLDEN), F.lit(1 << 32)) / F.lit(float(1 << 32))).alias("u"))
    points = points.withColumn("bucket", F.floor(F.col("u") * buckets).cast("int"))
    reach = plan.where("high > low").select("place", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * buckets).cast("int"), F.least(F.floor(F.col("high") * buckets), F.lit(buckets - 1)).cast("int"))).alias("bucket"))
    dealt = points.join(small(reach), "bucket").where("u >= low and u < high").select("t", "place", F.floor(F.col("t") / stretch).alias("stretch"))
    return ranked(dealt, ["place"], "stretch", ["t"], name="rank").select("t", "place", "rank")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, block: int = 64) -> tuple[DataFrame, DataFrame]:
    """Returns (rows, slots).

    rows: id, source, size (words), source_size, target (its source's words), taken (words the mix takes, repeats
    counted); a row for each row. slots: t, place, rank, block: the schedule, in order. The mix has share times all
    words; sources by code point (null is one, last) get the weights in turn, capped at epochs times their size.
    Documents are shuffled by the MD5 of their id, so reruns agree. Null or empty texts have size 0 and are never
    taken; an empty table gives empty results. No document is taken more than epochs times. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("shuffle"))
    base = cut(base, "sizes")
    plan = cut(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs), "plan")
    words = int(base.agg(F.sum("size")).first()[0] or 0)
    known = plan.select(F.col("source").alias("s"), "place", "source_size", "target")
    rows = base.join(small(known), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    laid = ranked(rows.withColumn("bucket", F.substring("shuffle", 1, 3)), ["place"], "bucket", ["shuffle", "size"], value=F.col("size"), name="start")
    laid = cut(laid.drop("bucket", "shuffle"), "stream")

    slots = schedule(plan, -(-int(share * words) // block))
    blocks = F.ceil(F.col("source_size") / F.lit(block))
    slots = slots.join(small(plan.select("place", "source_size")), "place").where(F.col("rank") < blocks * epochs).select("t", "place", "rank", F.pmod(F.col("rank"), blocks).alias("block"))
    times = slots.groupBy("place", "block").agg(F.count("*").alias("times"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = laid.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    here = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    own = ["id", "source", "place", "start", "size", "source_size", "target"]
    taken = pieces.withColumn("here", here).join(times, ["place", "block"], "left")
    taken = taken.groupBy(*own).agg(F.sum(F.col("here") * F.coalesce("times", F.lit(0))).alias("taken"))
    out = taken.unionByName(laid.where("size = 0").select(*own, F.lit(0).cast("long").alias("taken")))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.col("taken").cast("long").alias("taken")), slots
