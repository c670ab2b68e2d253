"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.llm.chat import HISTORY, STRIDE, TURN_TOKENS, chat_windows, read_back
from reelgrid.llm.embed_dedup import embedding_groups
from reelgrid.llm.exact_dedup import exact_groups
from reelgrid.llm.html_extract import extract_main_text
from reelgrid.llm.langid import predict_languages
from reelgrid.llm.lm_score import lm_scores
from reelgrid.llm.mixing import PRIME, SEEDS, mix_plan
from reelgrid.llm.packing import pack
from reelgrid.llm.phrases import collocations
from reelgrid.llm.pii import digest, personal_data
from reelgrid.llm.sharding import shard_rows
from reelgrid.llm.simhash import simhash_groups
from reelgrid.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(personal_data(_table(spark, sf_dir, "documents")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(_table(spark, sf_dir, "embeddings"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_rows(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(_table(spark, sf_dir, "documents"))


ODD = r"\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = _table(spark, sf_dir, "conversations")
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD).alias("text"),
    )
    read = read_back(chat_windows(convs.select(*odd.columns).unionByName(odd)))
    return read.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_pii, op2_exact_dedup, op3_embedding_dedup, op4_main_text, op5_language, op6_simhash, op7_packing, op8_sharding, op9_mixing, op10_chat, op11_whitening, op12_lm_score, op13_phrases,
    )}


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm, row_number() OVER w AS nth, first_value(doc_id) OVER w AS keep_id
  FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
)
SELECT doc_id, keep_id, count(*) OVER (PARTITION BY norm) AS group_size, nth = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""


_DRAWS = [f"((base * {2 * k + 1} + {7919 * k}) % {PRIME})::DOUBLE / {PRIME}.0::DOUBLE" for k in range(SEEDS)]
_TAKEN = [f"sum(size * (floor(rate)::BIGINT + ({u} < rate - floor(rate))::INT))" for u in _DRAWS]

OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 8))::BIGINT AS base
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM d GROUP BY source
), p AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total, coalesce(sum(source_size) OVER o, 0)::BIGINT AS before, sum(w) OVER r::BIGINT AS rest
  FROM s WINDOW o AS (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                r AS (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), l AS (
  SELECT min_by((1.5::DOUBLE * total - (2 * before)::DOUBLE) / rest::DOUBLE, before) FILTER (WHERE
    (2 * source_size)::DOUBLE > w * ((1.5::DOUBLE * total - (2 * before)::DOUBLE) / rest::DOUBLE)) AS level FROM p
), t AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR (2 * source_size)::DOUBLE <= w * level THEN (2 * source_size)::DOUBLE ELSE w * level END AS target FROM s, l
), k AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate FROM t
), e AS (
  SELECT k.source, k.source_size, k.target, k.rate, [{", ".join(f"abs({t} - k.target)" for t in _TAKEN)}] AS off
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source GROUP BY k.source, k.source_size, k.target, k.rate
), j AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, [{", ".join(_DRAWS)}] AS u, e.rate, list_position(e.off, list_min(e.off)) AS seed
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
), c AS (
  SELECT doc_id, size, source_size, target, floor(rate)::BIGINT + (u[seed] < rate - floor(rate))::BIGINT AS copies FROM j
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93
), r AS (
  SELECT vec_id, vec_id AS c FROM v UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.vec_id
), m AS (
  SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id
), n AS (
  SELECT x, count(*) AS n FROM l GROUP BY x
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n ON x = vec_id
"""

OP10_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, * FROM (VALUES (0::BIGINT, 'user', '{ODD}'), (1::BIGINT, 'assistant', '{ODD}'))
), t AS (
  SELECT *, row_number() OVER w AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {TURN_TOKENS} AS tokens,
    length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<]', '', 'g')) + length('<turn >') + 1 + 1 + length('</turn>') + 1 AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)
), s AS (
  SELECT *, k = 1 AND role = 'system' AS sys, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM t
), p AS (
  SELECT *, CASE WHEN sys THEN 0 ELSE start // {STRIDE} END AS w FROM s
), u AS (
  SELECT conv_id, w, min(start) FILTER (WHERE NOT sys) AS first FROM p GROUP BY conv_id, w
), n AS (
  SELECT *, lead(first) OVER (PARTITION BY conv_id ORDER BY w) AS next_first FROM u
), h AS (
  SELECT p.conv_id, sum(chars) AS again FROM p JOIN n ON p.conv_id IS NOT DISTINCT FROM n.conv_id AND p.w = n.w
  WHERE NOT sys AND next_first - start <= {HISTORY} GROUP BY p.conv_id
), y AS (
  SELECT p.conv_id, sum(chars) AS again FROM p JOIN n ON p.conv_id IS NOT DISTINCT FROM n.conv_id AND n.w > 0 WHERE sys GROUP BY p.conv_id
), a AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns,
    coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '') AS loss, sum(chars) AS chars FROM p GROUP BY conv_id
)
SELECT a.conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  (chars + coalesce(h.again, 0) + coalesce(y.again, 0))::BIGINT AS formatted_chars
FROM a LEFT JOIN h ON a.conv_id IS NOT DISTINCT FROM h.conv_id LEFT JOIN y ON a.conv_id IS NOT DISTINCT FROM y.conv_id
"""


OP13_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (
  SELECT lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') AS w FROM t
), n AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang
), s AS (
  SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) AS sizes(m) WHERE len(w) >= m
), g AS (
  SELECT lang, w[i:i + m - 1] AS ws, any_value(m) AS m, count(*) AS f FROM s GROUP BY lang, ws HAVING count(*) >= 30
), c AS (
  SELECT lang, ws, m, f AS a, unnest(range(1, m)) AS k FROM g WHERE m > 1
), b AS (
  SELECT c.lang, c.ws, c.m, c.a, min(((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f), k, x.f, y.f)) AS cut
  FROM c JOIN g x ON x.lang = c.lang AND x.ws = c.ws[1:k] JOIN g y ON y.lang = c.lang AND y.ws = c.ws[k + 1:c.m] GROUP BY ALL
), u AS (
  SELECT lang, ws[j:j + z - 1] AS ws, max(f) AS longer FROM (SELECT lang, ws, m, f, z, unnest(range(1, m - z + 2)) AS j FROM g, (VALUES (2), (3)) AS sizes(z) WHERE z < m) GROUP BY ALL
), k AS (
  SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, b.a, cut[3] AS l, cut[4] AS r, cut[1]::BIGINT AS score
  FROM b LEFT JOIN u ON u.lang = b.lang AND u.ws = b.ws WHERE u.longer IS NULL OR 100::HUGEINT * u.longer < 80::HUGEINT * b.a
)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM k JOIN n USING (lang)
) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op3_embedding_dedup": OP3_SQL, "op9_mixing": OP9_SQL, "op10_chat": OP10_SQL, "op13_phrases": OP13_SQL}
