"""Balanced label propagation over shards, in DataFrame operations only.

Documents with equal texts are linked. Every round each document looks at the shards of its neighbours and wants the
one that most of them are in; a shard then admits documents up to its quota, linked ones first, and what it can't
admit fills the shards that are short. So links move together while counts never differ by more than one. A group that
is larger than half a quota is spread over as many shards as it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ranked

GROUP = ["text_crc32", "text_key", "size"]


def _bucket(hot):
    """Whole groups in order, apart from hot ones, which are split; unlinked documents last."""
    part = F.pmod(F.col("text_key"), F.lit(256)) * 64 + F.when(hot, F.pmod(F.crc32("name"), F.lit(64))).otherwise(F.lit(0))
    return F.when(F.col("linked"), part).otherwise(256 * 64 + F.pmod(F.crc32("name"), F.lit(4096))).cast("long")


def _admit(df: DataFrame, shards: int, rows: int) -> DataFrame:
    """From want to shard: each shard takes its quota; the rest go where places are left."""
    quota = [rows // shards + (s < rows % shards) for s in range(shards)]
    limit = F.element_at(F.array(*[F.lit(q) for q in quota]), (F.col("want") + 1).cast("int"))
    order = [*GROUP, "name"]
    df = cut(ranked(df, ["want"], "bucket", order, name="rank").withColumn("limit", limit), "wants")
    stay = df.where("rank < limit").withColumn("shard", F.col("want"))
    got = {r["want"]: r["n"] for r in stay.groupBy("want").agg(F.count("*").alias("n")).collect()}  # a row per shard
    over, shard, at = ranked(df.where("rank >= limit").drop("rank"), [], "bucket", order, name="rank"), F.lit(shards - 1), 0
    for s in range(shards):
        at += quota[s] - got.get(s, 0)
        shard = F.when(F.col("rank") < at, F.lit(s)).otherwise(shard) if s == 0 else F.when((F.col("rank") < at) & (F.col("rank") >= at - quota[s] + got.get(s, 0)), F.lit(s)).otherwise(shard)
    return stay.drop("rank", "limit", "want").unionByName(over.withColumn("shard", shard).drop("rank", "limit", "want"))


def balanced_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, rounds: int = 12) -> DataFrame:
    """Puts documents into shards 0 to shards - 1, equal texts together as far as equal counts allow.

    Law `rows`: counts differ by one at most. Returns id, size (UTF-8 bytes of the text, none for null, plus 1),
    text_crc32 (unsigned), law, shard, slot (0, 1, ... within the shard), grown_shard (null under this law). A null text
    equals an empty one. Rows that repeat an id and a text are ordinary members of their group; rows may have null ids.
    Propagation goes on while linked documents outside their group's largest shard get fewer, and for `rounds` rounds
    at most; the assignment with the fewest is returned.
    Fewer rows than shards leave the last ones empty; an empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_key"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary").alias("name"))
    base = cut(base, "documents")
    n = base.count()
    groups = base.groupBy(*GROUP).agg(F.count("*").alias("members")).where("members > 1")
    groups = cut(groups, "groups")
    df = base.join(groups, GROUP, "left").withColumn("linked", F.col("members").isNotNull())
    half = max(1, n // shards // 2)
    df = df.withColumn("bucket", _bucket(F.coalesce("members", F.lit(0)) > half))
    df = df.withColumn("want", F.pmod(F.crc32("name"), F.lit(shards)).cast("int"))
    df = cut(_admit(df, shards, n), "shards")
    before, least = df, None
    for _ in range(rounds):
        votes = df.where("linked").groupBy(*GROUP, "shard").agg(F.count("*").alias("votes"))
        best = votes.groupBy(*GROUP).agg(F.max(F.struct("votes", -F.col("shard"))).alias("best"), F.sum("votes").alias("all"))
        best = cut(best.select(*GROUP, (-F.col("best")["col2"]).alias("to"), (F.col("all") - F.col("best")["votes"]).alias("apart")), "votes")
        apart = best.agg(F.sum("apart")).first()[0] or 0
        if least is not None and apart >= least:
            df = before if apart > least else df
            break
        before, least = df, apart
        if not apart:
            break
        moved = df.join(best.drop("apart"), GROUP, "left")
        spread = F.pmod(F.crc32("name"), F.ceil(F.col("members") / F.lit(half)))
        to = F.when(F.col("members") > half, F.pmod(F.col("to") + spread, F.lit(shards))).otherwise(F.col("to"))
        moved = moved.withColumn("want", F.coalesce(to, F.col("shard")).cast("int")).drop("to", "shard")
        df = cut(_admit(moved, shards, n), "shards")
    out = ranked(df, ["shard"], "bucket", [*GROUP, "name"], name="slot")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
