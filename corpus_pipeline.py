"""From raw documents to sampled segmentations: language ID, near duplicates, mixing, SentencePiece.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbral.llm import jaccard, langid, mixing, pieces
from umbral.llm.common import cut
from umbral.llm.queries import PIECE_MODEL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose best language is less likely than this go.
LEAST = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null, have no letter, or whose language is uncertain (calibrated score under LEAST).

    The model learns from the rows whose crc32(doc_id) mod 3 isn't 1, as in the query of the operator."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    model = langid.train(docs.where(fold != 1))
    return langid.predict(docs.select(*COLUMNS), model, least=LEAST)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps exactly one row of each component of the n-gram Jaccard join, that with the smallest id; rows that link with none stay.

    Where rows repeat an id or have none, they are numbered first and told apart by number; named rows go before nameless ones."""
    docs, key = docs.select(*COLUMNS), "doc_id"
    numbered = docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count()
    if numbered:
        docs, key = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "rows"), "__row"
    found = cut(jaccard.ngram_jaccard_join(docs, id_col=key), "found")
    if numbered:
        rows = found.select("__row", "component_id").join(docs.select("__row", "doc_id"), "__row")
        first = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("first"))
        gone = rows.join(first, "component_id").where("__row <> first.__row").select("__row")
    else:
        gone = found.where("doc_id <> component_id").select("doc_id")
    gone = cut(gone, "gone")
    few = F.broadcast(gone) if gone.count() <= 1 << 20 else gone
    return docs.join(few, key, "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes of its words, rounded; documents that it doesn't take go.

    Empty documents hold no words to take and go as well."""
    rows = mixing.mix_sources(docs)[0].where("size > 0")
    copies = rows.groupBy("doc_id").agg(F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("__copies")).where("__copies > 0")
    copies = cut(copies.withColumnRenamed("doc_id", "__id"), "copies")
    few = F.broadcast(copies) if copies.count() <= 1 << 20 else copies
    out = docs.select(*COLUMNS).join(few, F.col("doc_id").eqNullSafe(F.col("__id")))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations, and the SHA-256 of the text decoded from them."""
    return pieces.sentencepiece_encode(docs.select(*COLUMNS), PIECE_MODEL, proof=True)


STAGES = [("language ID", language_id), ("near duplicates", near_duplicates), ("mixing", mix), ("SentencePiece", sentencepiece)]

#: The stages learn models and sample; SQL can't express them. Tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
