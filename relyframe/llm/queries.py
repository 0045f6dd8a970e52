"""The queries of the text operators: one op<N>_<name> for each, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from relyframe.llm import (align, bpe, chat, decontaminate, jaccard, langid, pii, quality, repair, substring_dedup,
                            suffix_dedup, token_store, toxicity)
from relyframe.llm.common import documents
from relyframe.session import scratch_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                keep_ids=False)


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql("""SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'),
                         (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)""")
    return chat.digests(chat.format_conversations(rows.unionByName(probe)))


ORACLES["op5_chat_format"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS txt FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, lag(role, 1, 'start') OVER w AS prev, row_number() OVER w - 1 AS place,
             row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS is_last
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, txt)),
m AS (SELECT *, (prev || '>' || role) IN ('start>system', 'start>user', 'system>user', 'user>assistant',
                                         'assistant>user') AS ok,
             length(replace(replace(txt, '\', '\b'), '<', '\l')) AS n_txt,
             length(replace(replace(replace(role, '\', '\b'), '<', '\l'), chr(10), '\n')) AS n_role FROM n)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || txt || chr(10), '' ORDER BY turn, role, txt)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(txt) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(txt, '' ORDER BY turn, role, txt) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + n_role + 1 + n_txt + 11)::BIGINT AS formatted_chars,
       bool_and(ok) AND bool_or(is_last AND role = 'assistant') AS valid,
       min(place) FILTER (NOT ok) AS bad_turn
FROM m GROUP BY conv_id"""


@query
def op1_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(documents(spark, sf_dir)).drop("k1", "k2")


@query
def op4_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(documents(spark, sf_dir)).select(
        "doc_id", *quality.COUNTS, "base_failed", "kept", "log_ppl", "word_log_ppl")


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(documents(spark, sf_dir), items).drop("k1", "k2")


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_passages(documents(spark, sf_dir))


@query
def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    token_store.write_store(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_store(spark, path)


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(documents(spark, sf_dir)).drop("k1", "k2", "component")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(documents(spark, sf_dir), labels).drop("k1", "k2")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair.report(rows, repair.damage(rows))


ORACLES["op11_conversation_repair"] = r"""
WITH RECURSIVE
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce("text", ' ') AS txt,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1),
                lambda i: ascii(substring(k, i, 1))::BIGINT)),
             lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)),
                lambda v, b: xor(v >> 1, (v & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 20 AS kind FROM c),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt,
             unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY turn NULLS FIRST) > 1 AS again FROM d),
r AS (SELECT *, row_number() OVER w AS i, left(role, 1) AS a, lag(left(role, 1)) OVER w AS b
      FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt, again)),
f AS (SELECT *, CASE WHEN NOT regexp_matches(txt, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
                     WHEN NOT regexp_matches(txt, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM r),
ins(q, e, cost, p) AS (VALUES (0, '', 0, 0), (1, '', 0, 1), (2, '', 0, 2), (3, '', 0, 3), (0, 'I', 5, 2), (1, 'I', 5, 2),
                              (2, 'I', 5, 3), (3, 'I', 5, 2), (0, 'II', 10, 3), (1, 'II', 10, 3)),
dp AS (
  SELECT conv_id, 1::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, '' AS body FROM f GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i + 1, q, min({'c': cost, 'e': audit}).c, min({'c': cost, 'e': audit}).e,
         arg_min(body, {'c': cost, 'e': audit})
  FROM (
    SELECT dp.conv_id, dp.i, o.p AS q, dp.cost + ins.cost + o.cost + CASE WHEN o.e <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END AS cost,
           dp.audit || ins.e || o.e AS audit,
           dp.body || CASE ins.e WHEN 'I' THEN chr(10) || CASE ins.p WHEN 2 THEN 'user:' ELSE 'assistant:' END
                                 WHEN 'II' THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE '' END
                   || CASE o.e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.txt
                               ELSE chr(10) || CASE o.p WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.txt END AS body
    FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i JOIN ins ON ins.q = dp.q
    JOIN (VALUES ('D', 2, 0, 0, ''), ('D', 2, 1, 1, ''), ('D', 2, 2, 2, ''), ('D', 2, 3, 3, ''),
                 ('K', 0, 0, 1, 's'), ('K', 0, 0, 2, 'u'), ('K', 0, 1, 2, 'u'), ('K', 0, 3, 2, 'u'), ('K', 0, 2, 3, 'a'),
                 ('R', 1, 0, 2, ''), ('R', 1, 1, 2, ''), ('R', 1, 3, 2, ''), ('R', 1, 2, 3, '')) o(e, cost, q, p, needs)
      ON o.q = ins.p AND (o.needs = '' OR o.needs = f.a) AND (o.e = 'D' OR f.fault NOT IN ('blank', 'duplicate'))) x
  GROUP BY conv_id, i, q),
best AS (
  SELECT conv_id, min({'c': cost, 'e': audit}) AS m, arg_min(body, {'c': cost, 'e': audit}) AS body
  FROM (SELECT dp.conv_id, cost + e.c AS cost, audit || e.e AS audit, body || e.b AS body
        FROM dp JOIN (SELECT conv_id AS id, max(i) + 1 AS n FROM f GROUP BY conv_id) z ON z.id IS NOT DISTINCT FROM dp.conv_id AND dp.i = z.n
        JOIN (VALUES (0, 0, '', ''), (1, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
                     (2, 5, 'I', chr(10) || 'assistant:'), (3, 0, '', '')) e(q, c, e, b) ON e.q = dp.q) y
  GROUP BY conv_id),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (b IS NOT NULL AND (b || a) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(m.c, 0)::BIGINT AS cost,
       coalesce(m.e, '') AS audit, sha256(coalesce(substring(body, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id"""


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                                 public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))
