"""The corpus operators as queries over whole tables, and SQL for those that have any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, mixing, nearest, pii, sharding, simhash, similar, substring, toxicity, warc
from .common import table

_KEPT_FOLD = "crc32(cast(cast(doc_id as bigint) as string)) % 3 <> 1"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(*toxicity.sample(docs, table(spark, sf_dir, "labels").filter(_KEPT_FOLD)))
    held_out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_vantage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_by_cosine(table(spark, sf_dir, "embeddings"))


def op3_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def _surrogate_key(spark: SparkSession) -> str:
    """The session's own; the named one is public and only for the synthetic tables."""
    return spark.conf.get("spark.dyadloom.surrogate.key", "for synthetic tables only")


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = pii.replace(table(spark, sf_dir, "documents"), _surrogate_key(spark))
    return rows.select("row.doc_id", "row.text", "n_replaced")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("group_key")


def op6_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(bpe.encode_and_decode(table(spark, sf_dir, "documents"), bpe.public_vocabulary()))


def _digests(done: DataFrame, *more: str) -> DataFrame:
    return done.select(
        "doc_id",
        *more,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.top_by_product(table(spark, sf_dir, "embeddings"))


def op9_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = mixing.qualities(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), quality).select("doc_id", "size", "source_size", "target", "taken")


def op10_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


# --- stages of the pipeline: documents to documents ---------------------------------------


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. Rows with one doc_id go or stay by their
    own texts: the decision is made beside the row, not joined to it. Learned, as op1 is,
    without the labels of the held-out third, so what is measured on that third is new."""
    model = toxicity.train(*toxicity.sample(docs, table(spark, sf_dir, "labels").filter(_KEPT_FOLD)))
    return toxicity.keep(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id: tries over
    SimHash bits joined with themselves, their links held to the exact similarity."""
    return similar.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text with surrogates and its length made anew."""
    return pii.replace(docs, _surrogate_key(spark))[0].select("row.*")


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it: some not at all, most once or twice."""
    return mixing.mixed(docs, mixing.qualities(table(spark, sf_dir, "labels")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) for every row: the training data."""
    return _digests(bpe.encode_and_decode(docs, bpe.public_vocabulary()), "ids")


def queries() -> dict:
    own = (op1_toxicity, op2_vantage_search, op3_extendible_shards, op4_surrogates, op5_simhash, op6_chunked_bpe, op7_recompression, op8_ball_tree, op9_weighted_mix, op10_warc_chunks)
    return {f.__name__: f for f in own}


# --- SQL ------------------------------------------------------------------------------------

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         -- the first 36 bits; those of a row's place are not looked at where rows differ
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 9))::BIGINT << 24 AS hash
  FROM documents),
s AS (
  SELECT k.depth, d.hash >> (60 - k.depth)::BIGINT AS prefix, sum(n_bytes)::BIGINT AS shard_bytes
  FROM d, (SELECT unnest(range(0, 37)) AS depth) k GROUP BY ALL),
p AS (
  SELECT d.doc_id, d.n_bytes, d.hash, s.depth, s.shard_bytes,
         row_number() OVER (PARTITION BY d.hash, d.doc_id ORDER BY s.depth) AS rn
  FROM d JOIN s ON d.hash >> (60 - s.depth)::BIGINT = s.prefix WHERE s.shard_bytes <= {sharding.LIMIT})
SELECT doc_id, n_bytes, substr(lpad(bin(hash), 60, '0'), 1, depth::INT) AS shard, depth::INT AS depth, shard_bytes,
       shard_bytes > {sharding.LIMIT} AS oversized
FROM p WHERE rn = 1
"""

OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS k FROM d),
x AS (SELECT doc_id, k, array_to_string(w[k:k + 19], ' ') AS part FROM s),
r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY part ORDER BY doc_id, k) AS nth FROM x),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS k FROM r WHERE nth > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
left_over AS (
  SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.k) AS kept, count(*) AS n
  FROM words a ANTI JOIN gone b ON a.doc_id = b.doc_id AND a.k = b.k GROUP BY a.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

OP9_SQL = f"""
WITH q AS (
  SELECT doc_id, {mixing.POOR} + {mixing.GOOD - mixing.POOR} * least(greatest(avg(quality::DOUBLE), 0), 1) AS weight FROM labels GROUP BY doc_id),
d AS (
  SELECT d.doc_id, source, len({_WORDS})::BIGINT AS size,
         -ln(((('0x' || substr(md5('mix|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
           / coalesce(q.weight, {mixing.UNKNOWN})::DOUBLE AS key
  FROM documents d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
l AS (
  SELECT *, row_number() OVER up AS place,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (up ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c WINDOW up AS (ORDER BY ratio, source NULLS LAST)),
o AS (SELECT min(place) AS place FROM l WHERE ratio > level),
t AS (
  SELECT source, source_size,
         CASE WHEN o.place IS NULL OR l.place < o.place THEN most ELSE (SELECT level FROM l x WHERE x.place = o.place) * weight END AS target
  FROM l, o),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
p AS (
  SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN ahead + size / 2 < rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""

OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (
  SELECT *, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (g // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (g % 4))) & 31) + 1)::INT, 1), '' ORDER BY g)
             FROM (SELECT unnest(range(0, 32)) AS g)) AS payload_digest,
         min(page_id) OVER (PARTITION BY h) AS first_id
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""


def oracle_sql() -> dict:
    return {"op3_extendible_shards": OP3_SQL, "op7_recompression": OP7_SQL, "op8_ball_tree": OP8_SQL, "op9_weighted_mix": OP9_SQL, "op10_warc_chunks": OP10_SQL}
