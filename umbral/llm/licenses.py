"""License scan by diagonal voting, in DataFrame operations only.

All rolling k-word grams of the texts are hashed and joined to the template positions (a fixed table, broadcast).
A match at word p of a text and word t of a template votes for diagonal p - t. Diagonals of one template that lie
within `slack` of each other are merged, as an inserted or dropped word moves the rest of a span by one; the merged
span is verified by the share of the template's grams it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Phrases that must stand word by word.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Longer templates of our own, found also when some words differ.
TEMPLATES = {
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "gpl-3": "licensed under the gnu general public license version 3",
    "apache-2-notice": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "bsd-3-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "all-rights-reserved": "all rights reserved no part of this publication may be reproduced",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3


def _templates(spark: SparkSession, phrases: dict, templates: dict) -> DataFrame:
    """A row for each gram of each template: hash, words, place, grams and words of the template."""
    rows = []
    for exact, group in ((True, phrases), (False, templates)):
        for label, text in group.items():
            w = text.split()
            for t in range(len(w) - K + 1):
                rows.append((label, exact, t, len(w) - K + 1, *w[t : t + K]))
    df = spark.createDataFrame(rows, "label string, exact boolean, t int, grams int, " + ", ".join(f"g{i} string" for i in range(K)))
    return df.withColumn("gram", F.xxhash64(*[f"g{i}" for i in range(K)]))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict = PHRASES, templates: dict = TEMPLATES, slack: int = 2, share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Returns (documents, spans).

    Words: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z went to lower case. documents: id, n_words, n_base, first_word,
    last_word (places of phrases), base_labels, labels (phrases' and templates'), score (the largest share of a
    template's grams that one span holds, 1 for a phrase). spans: id, label, exact, first, last (words), score.
    Null or empty texts have no words, empty labels and score 0. Rows that repeat an id and its text count once in
    spans and are each returned; null ids are kept; other columns are ignored; an empty table gives empty results.
    Every occurrence counts; no text is cut. A template's span is at most 2 * slack words longer than the template:
    a chain of neighbouring diagonals that reaches further is no copy of it.
    """
    spark = docs.sparkSession
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(lowered).alias("text_key"), F.filter(F.split(lowered, GAPS), lambda w: w != "").alias("w"))
    n = F.size("w")
    grams = F.arrays_zip(*[F.slice("w", i + 1, F.greatest(n - K + 1, F.lit(0))).alias(f"w{i}") for i in range(K)])
    laid = rows.select("id", "text_key", grams.alias("all")).select("id", "text_key", F.posexplode("all").alias("p", "g"))
    laid = laid.select("id", "text_key", "p", *[F.col(f"g.w{i}").alias(f"w{i}") for i in range(K)]).withColumn("gram", F.xxhash64(*[f"w{i}" for i in range(K)]))
    table = _templates(spark, phrases, templates)
    same = F.lit(True)
    for i in range(K):
        same &= F.col(f"w{i}") == F.col(f"g{i}")
    votes = laid.join(F.broadcast(table), "gram").where(same)  # the templates are a fixed table of a few hundred rows
    votes = votes.select("id", "text_key", "label", "exact", "grams", "t", "p", (F.col("p") - F.col("t")).alias("diagonal")).distinct()
    votes = cut(votes, "votes")  # phrases and templates both read them: the texts are split and hashed once
    by = ["id", "text_key", "label", "exact", "grams"]
    diagonals = votes.groupBy(*by, "diagonal").agg(F.count("*").alias("votes"), F.min("p").alias("first"), F.max("p").alias("last"))
    # a phrase needs every gram on one diagonal
    whole = diagonals.where("exact and votes = grams").select("id", "text_key", "label", "exact", "first", (F.col("last") + K - 1).alias("last"), F.lit(1.0).alias("score"))
    order = Window.partitionBy(*by).orderBy("diagonal")
    near = diagonals.where("not exact").withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(order) > slack).cast("int"))
    near = near.withColumn("span", F.sum(F.coalesce("new", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = near.groupBy(*by, "span").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("diagonal").alias("low"))
    held = F.least(F.lit(1.0), F.col("votes") / F.col("grams"))
    fuzzy = merged.select("id", "text_key", "label", "exact", "first", (F.col("last") + K - 1).alias("last"), held.alias("score"), (F.col("last") - F.col("first") + 1).alias("long"), "grams")
    fuzzy = fuzzy.where((F.col("score") >= share) & (F.col("long") <= F.col("grams") + 2 * slack)).drop("long", "grams")
    spans = whole.unionByName(fuzzy)

    found = spans.groupBy("id", "text_key").agg(
        F.count(F.when(F.col("exact"), 1)).alias("n_base"), F.min(F.when(F.col("exact"), F.col("first"))).cast("long").alias("first_word"), F.max(F.when(F.col("exact"), F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"), F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score"),
    )  # fmt: skip  # sets of labels: as many as there are templates
    found = found.select(F.col("id").alias("id_"), F.col("text_key").alias("key_"), *found.columns[2:])
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(lowered).alias("text_key"), F.size(F.filter(F.split(lowered, GAPS), lambda w: w != "")).cast("long").alias("n_words"))
    out = base.join(found, F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_")), "left")
    out = out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return out, spans.select(F.col("id").alias(id_col), "label", "exact", "first", "last", "score")
