"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import edits, jaccard, langid, licenses, lm, media, mixing, pieces, sharding, topk

TOKENIZERS = os.environ.get("UMBRAL_TOKENIZERS", "/opt/tokenizers")
PIECE_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
BPE_RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mod(n: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_exact_top_k(spark, sf_dir):
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_ngram_jaccard_join(spark, sf_dir):
    return jaccard.ngram_jaccard_join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_license_scan(spark, sf_dir):
    return licenses.license_scan(_table(spark, sf_dir, "documents"))[0]


def op4_bloom_lm_score(spark, sf_dir):
    return lm.bloom_lm_score(_table(spark, sf_dir, "documents"), _mod(7) == 2)


def op5_mix_sources(spark, sf_dir):
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken")


def op6_balanced_shards(spark, sf_dir):
    return sharding.balanced_shards(_table(spark, sf_dir, "documents"))


def op7_media_columns(spark, sf_dir):
    rows, folder = media.store_media(_table(spark, sf_dir, "documents"))
    out = media.media_features(media.media_metadata(rows, folder), folder)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth")


def op8_sentencepiece(spark, sf_dir):
    """ids and n_pieces of each text; text_bytes and text_sha256 are of the text decoded from the ids again."""
    return pieces.sentencepiece_encode(_table(spark, sf_dir, "documents"), PIECE_MODEL, proof=True)


def op9_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (_mod(3) == 1).alias("held_out"))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def planned_edits():
    """Three edits a text: one at its start, one in its middle that drops up to 15 characters, one at its end."""
    n = F.coalesce(F.length("text"), F.lit(0))
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    one = lambda start, deleted, inserted: F.struct(start.cast("int").alias("start"), deleted.cast("int").alias("deleted"), inserted.alias("inserted"))
    return F.array(
        one(F.lit(0), F.lit(0), F.lit("Title: ")),
        one(key % (n + 1), key % 16, F.concat(F.lit(" revised "), F.col("doc_id").cast("string"))),
        one(n * 2 + 100, F.lit(0), F.lit("\n\nSee also.")),
    )


def op10_token_counts(spark, sf_dir):
    return edits.edit_aware_counts(_table(spark, sf_dir, "documents"), planned_edits(), BPE_RANKS)


QUERIES = {
    f.__name__: f
    for f in (op1_exact_top_k, op2_ngram_jaccard_join, op3_license_scan, op4_bloom_lm_score, op5_mix_sources, op6_balanced_shards, op7_media_columns, op8_sentencepiece, op9_language_id, op10_token_counts)
}

ORACLE = {
    "op1_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * x.e[i])) AS BIGINT) AS score
                   FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.e) = len(x.e) WHERE q.vec_id % 100 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "op2_ngram_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS g FROM d),
             x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
             o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
             l AS (SELECT a, b FROM o WHERE 100 * c >= 80 * (na + nb - c)),
             both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
             reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
        SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, (SELECT min(r.b) FROM reach r WHERE r.a = s.doc_id) AS component_id FROM s""",
    "op5_mix_sources": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
             s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
             s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s0),
             s2 AS (SELECT *, CAST([5, 2, 1][1 + place % 3] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s1),
             s3 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
             s4 AS (SELECT *, max(CASE WHEN cap > level * weight THEN level END) OVER () AS top, cap <= level * weight AS capped FROM s3),
             s5 AS (SELECT *, CASE WHEN capped THEN cap ELSE top * weight END AS target FROM s4),
             s6 AS (SELECT *, sum(target) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) / nullif(sum(target) OVER (), 0) AS high, max(place) OVER () AS last FROM s5),
             plan AS (SELECT source, source_size, place, target, coalesce(lag(high) OVER (ORDER BY place), 0) AS low, CASE WHEN place = last THEN 1.0::DOUBLE ELSE high END AS high FROM s6),
             slots AS (SELECT t, ((t % 2147483648) * 2654435769 % 4294967296) / 4294967296.0::DOUBLE AS u FROM (SELECT unnest(range(CAST(ceil(floor(1.5 * (SELECT sum(size) FROM d)) / 64) AS BIGINT))) AS t)),
             dealt AS (SELECT p.place, p.source_size, row_number() OVER (PARTITION BY p.place ORDER BY t) - 1 AS rank FROM slots JOIN plan p ON u >= low AND u < high),
             times AS (SELECT place, rank % CAST(ceil(source_size / 64) AS BIGINT) AS block, count(*) AS times FROM dealt WHERE rank < 2 * CAST(ceil(source_size / 64) AS BIGINT) GROUP BY 1, 2),
             laid AS (SELECT d.*, p.place, p.source_size, p.target, CAST(sum(size) OVER (PARTITION BY p.place ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
             cover AS (SELECT *, unnest(range(start // 64, (start + size - 1) // 64 + 1)) AS block FROM laid WHERE size > 0),
             got AS (SELECT c.doc_id, sum((least(c.start + c.size, (c.block + 1) * 64) - greatest(c.start, c.block * 64)) * coalesce(t.times, 0)) AS taken FROM cover c LEFT JOIN times t ON c.place = t.place AND c.block = t.block GROUP BY 1)
        SELECT l.doc_id, l.size, l.source_size, l.target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken FROM laid l LEFT JOIN got g ON l.doc_id = g.doc_id""",
}
