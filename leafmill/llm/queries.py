"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm.bayes_jaccard import near_duplicates
from leafmill.llm.chat_collapse import maximal_chats
from leafmill.llm.common import read_table
from leafmill.llm.lang_mixture import language_query
from leafmill.llm.mix_schedule import mix_query
from leafmill.llm.norm_topk import top_products
from leafmill.llm.permutation_ann import nearest
from leafmill.llm.piece_stream import round_trip
from leafmill.llm.prefix_bpe import token_counts
from leafmill.llm.secret_cost import secret_query
from leafmill.llm.toxic_crf import toxicity_query


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))


def op2_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), limit=512)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(read_table(spark, sf_dir, "embeddings"), every=100, k=10, scale=1024)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_query(read_table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_query(read_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_query(read_table(spark, sf_dir, "documents"))


def op9_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_chats(read_table(spark, sf_dir, "conversations"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the whole result; the others are tested against brute force."""
    return {"op5_exact_topk": OP5, "op7_source_mix": OP7, "op9_chat_collapse": OP9}


OP5 = """
WITH good AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""

OP7 = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS draw FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, coalesce(sum(2 * source_size) OVER before, 0) AS capped_before, sum(weight) OVER onward AS weight_onward,
         sum(source_size) OVER () * 3 AS twice_total FROM sources
  WINDOW before AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         onward AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
capped AS (
  SELECT *, 4 * source_size * weight_onward <= (twice_total - 2 * capped_before) * weight AS full_up FROM filled),
rest AS (
  SELECT max(twice_total) - coalesce(sum(4 * source_size) FILTER (WHERE full_up), 0) AS left_twice,
         coalesce(sum(weight) FILTER (WHERE NOT full_up), 0) AS weight_left FROM capped),
targets AS (
  SELECT source, source_size, CASE WHEN full_up THEN CAST(2 * source_size AS DOUBLE)
         ELSE CAST(left_twice * weight AS DOUBLE) / CAST(2 * weight_left AS DOUBLE) END AS target FROM capped, rest),
placed_rows AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS quota,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
places AS (
  SELECT source, quota, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place,
         CAST(sum(quota) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(greatest(sum(quota) OVER (), 1) AS DOUBLE) AS cumulative,
         (quota + 1023) // 1024 AS blocks FROM (SELECT source, CAST(floor(target) AS BIGINT) AS quota FROM targets)),
amounts AS (SELECT CAST(sum(blocks) AS BIGINT) AS slots, count(*) AS n FROM places),
dealt AS (
  SELECT slot, (SELECT least(count(*) FILTER (WHERE cumulative <= point), count(*) - 1) FROM places) AS place FROM (
    SELECT slot, CAST((CAST(slot + 1 AS HUGEINT) * 11400714819323198485) % 18446744073709551616 AS DOUBLE) / 18446744073709551616.0 AS point
    FROM (SELECT unnest(range(CASE WHEN slots > 0 THEN slots + 4 * n + 64 ELSE 0 END)) AS slot FROM amounts))),
ranked AS (SELECT slot, place, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS rank FROM dealt),
early AS (SELECT slot, place, rank FROM ranked JOIN places USING (place) WHERE rank < blocks),
late AS (
  SELECT place, unnest(range(CAST(coalesce(had, 0) AS BIGINT), CAST(blocks AS BIGINT))) AS rank
  FROM places LEFT JOIN (SELECT place, count(*) AS had FROM early GROUP BY place) USING (place)),
schedule AS (
  SELECT slot, place, rank FROM early
  UNION ALL SELECT slots + 4 * n + 64 + rank * n + place, place, rank FROM late, amounts),
passes AS (
  SELECT l.doc_id, l.begin, p.place, l.begin + k * l.source_size AS starts, least(l.begin + k * l.source_size + l.size, l.quota) AS stop
  FROM placed_rows l JOIN places p ON l.source IS NOT DISTINCT FROM p.source, range(2) t(k)
  WHERE l.size > 0 AND l.begin + k * l.source_size < l.quota),
blocks AS (SELECT *, unnest(range(CAST(starts // 1024 AS BIGINT), CAST((stop - 1) // 1024 + 1 AS BIGINT))) AS rank FROM passes),
got AS (
  SELECT place, begin, sum(least(stop, (rank + 1) * 1024) - greatest(starts, rank * 1024)) AS taken, min(slot) AS first_slot
  FROM blocks JOIN schedule USING (place, rank) GROUP BY place, begin)
SELECT l.doc_id, l.size, l.source_size, l.target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken, CAST(g.first_slot AS BIGINT) AS first_slot
FROM placed_rows l JOIN places p ON l.source IS NOT DISTINCT FROM p.source
LEFT JOIN got g ON g.place = p.place AND g.begin = l.begin AND l.size > 0
"""

OP9 = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
whole AS (
  SELECT conv_id, count(*) AS n_turns, list(md5(role || chr(0) || text) ORDER BY pos) AS marks,
         string_agg('<|' || replace(role, '|', '\\|') || '|>' || chr(10) || replace(text, '<|', '<\\|') || chr(10), '' ORDER BY pos) AS rendered
  FROM turns GROUP BY conv_id),
folded AS (
  SELECT min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, marks, count(*) AS n_copies, any_value(rendered) AS rendered
  FROM whole GROUP BY marks)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, CAST(n_copies AS BIGINT) AS n_copies, rendered FROM folded f
WHERE NOT EXISTS (SELECT 1 FROM folded g WHERE g.n_turns > f.n_turns AND g.marks[1:f.n_turns] = f.marks)
"""
