"""One thin query for each operator over its whole table, and SQL where SQL says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, langid, minhash, mixing, packing, substr, tokens, urls, vecdedup


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(_read(spark, sf_dir, "conversations"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substr.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), length=35, digest=True)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected", "ce")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=85)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mixing.mix(docs, keep=["doc_id", "source"])
    return out.select("doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), (F.col("__mix_copies") * F.col("__mix_size")).alias("taken"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (1 + (row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3)::BIGINT AS weight FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source IS NULL, source COLLATE "C") AS k,
         sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS weights
  FROM w
), b AS (
  SELECT a.k, coalesce(sum(c.source_size), 0)::BIGINT AS size_before, coalesce(sum(c.weight), 0)::BIGINT AS weight_before
  FROM o a LEFT JOIN o c ON c.k < a.k GROUP BY a.k
), f AS (
  SELECT o.*, total - 3.0::DOUBLE * size_before AS free, weights - weight_before AS rest,
         weight * (total - 3.0::DOUBLE * size_before) > 3.0::DOUBLE * source_size * (weights - weight_before) AS stops
  FROM o JOIN b USING (k)
), l AS (
  SELECT free AS level_free, rest AS level_rest FROM f WHERE NOT stops ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size,
         CASE WHEN stops OR level_free IS NULL THEN 3.0::DOUBLE * source_size ELSE weight * level_free / level_rest END AS target
  FROM f LEFT JOIN l ON true
), r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS ratio,
         ('0x' || substr(md5(coalesce(d.source, '')), 1, 4))::INTEGER / 65536.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(i * ratio + u) - floor((i - 1) * ratio + u)))::BIGINT AS taken FROM r
"""


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP1_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(CASE WHEN role <> '' THEN regexp_replace(role, '[^A-Za-z0-9_-]', '_', 'g') END, 'unknown') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), who AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
), seen AS (
  SELECT t.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS shown_as
  FROM t JOIN who ON t.conv_id IS NOT DISTINCT FROM who.conv_id
), heads AS (
  SELECT *, CASE WHEN shown_as = 'user' THEN speaker END AS name,
         '<|turn|>' || shown_as || coalesce(CASE WHEN shown_as = 'user' THEN ' name=' || speaker END, '') || chr(10) AS head FROM seen
), segments AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM heads
), placed AS (
  SELECT *, length(segment) AS size, row_number() OVER w - 1 AS pos, (sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS "end"
  FROM segments WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text)
)
SELECT conv_id, perspective, pos, speaker, shown_as, name, segment, "end" - size AS "start", "end",
       CASE WHEN shown_as = 'assistant' THEN "end" - size + length(head) ELSE "end" END AS mask_start, "end" AS mask_end
FROM placed
"""

OP2_SQL = """
WITH w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS words FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 33)) AS s FROM w WHERE len(words) >= 35
), hashed AS MATERIALIZED (
  SELECT doc_id, s, md5(array_to_string(words[s:s + 34], ' ')) AS h FROM windows JOIN w USING (doc_id)
), repeated AS MATERIALIZED (
  SELECT doc_id, s FROM hashed WHERE h IN (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, s + i AS p FROM repeated, range(0, 35) t(i)
), lost AS (
  SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id
), kept AS (
  SELECT doc_id, list(word ORDER BY p) AS words
  FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(kept.words, ' '), '')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP6_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS words FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
         ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) END AS s FROM w
), classes AS MATERIALIZED (
  SELECT min(doc_id) AS rep, s, len(s)::BIGINT AS n FROM sets WHERE len(s) > 0 GROUP BY s
), items AS MATERIALIZED (
  SELECT rep, n, unnest(s) AS g FROM classes
), common AS (
  SELECT a.rep AS u, b.rep AS v, a.n AS nu, b.n AS nv, count(*) AS shared
  FROM items a JOIN items b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL
), links AS MATERIALIZED (
  SELECT u, v FROM common WHERE 100 * shared >= 85 * (nu + nv - shared)
), sym AS MATERIALIZED (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT u AS id, u AS root FROM sym
  UNION
  SELECT sym.v, reach.root FROM reach JOIN sym ON sym.u = reach.id WHERE reach.root < sym.v
), comp AS (
  SELECT id, min(root) AS root FROM reach GROUP BY id
)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(comp.root, classes.rep, sets.doc_id) AS component_id,
       sets.doc_id = coalesce(comp.root, classes.rep, sets.doc_id) AS kept
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN comp ON comp.id = classes.rep
"""


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS MATERIALIZED (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), sym AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT u AS id, u AS root FROM sym
  UNION
  SELECT sym.v, reach.root FROM reach JOIN sym ON sym.u = reach.id WHERE reach.root < sym.v
), comp AS (
  SELECT id, min(root) AS root FROM reach GROUP BY id
), n AS (
  SELECT u AS id, count(*)::BIGINT AS n_links FROM sym GROUP BY u
)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(comp.root, v.vec_id) AS component_id, v.vec_id = coalesce(comp.root, v.vec_id) AS kept
FROM v LEFT JOIN n ON n.id = v.vec_id LEFT JOIN comp ON comp.id = v.vec_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_perspectives": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op9_embedding_dedup": OP9_SQL, "op6_near_duplicates": OP6_SQL, "op8_mix_sources": OP8_SQL}
