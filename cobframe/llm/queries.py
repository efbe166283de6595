"""Registered queries of the training-data operators, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobframe.llm import (ann, chat, collocations, common, decontaminate, exact_dedup, packing, secret_scan, simhash,
                          substring, token_alignment, token_counts, toxicity, wrappers)

PACKING_VOCABULARY = "word_bpe_49k.json"
COUNTING_VOCABULARY = "byte_bpe_50k.json"
ALIGNED_VOCABULARIES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, the same on every executor."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_hierarchical_kmeans_tree(spark: SparkSession, sf: str) -> DataFrame:
    return ann.search(common.table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_simhash_golay(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf, "documents"), words=4, max_bits=4)


def op3_wrapper_induction(spark: SparkSession, sf: str) -> DataFrame:
    return wrappers.main_text(common.table(spark, sf, "pages"))


def op4_factorization_machine(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(common.table(spark, sf, "documents"), common.table(spark, sf, "labels"), threshold=0.3)


def op5_first_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(common.table(spark, sf, "documents"), vocabulary(PACKING_VOCABULARY), capacity=4096, closing=2)


def op6_secret_network(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.find_secrets(common.table(spark, sf, "documents"))


def op7_sentence_spans(spark: SparkSession, sf: str) -> DataFrame:
    return substring.remove_repeats(common.table(spark, sf, "documents"))


def op8_rank_synchronous_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(common.table(spark, sf, "documents"), vocabulary(COUNTING_VOCABULARY), limit=512)


def op9_prefix_target_chat(spark: SparkSession, sf: str) -> DataFrame:
    rows = common.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat.digests(chat.format_turns(rows.unionByName(extra)))


def op10_template_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.findings(common.table(spark, sf, "documents"), common.table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "item_windows", "share", "exact")


def op11_fragment_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return token_alignment.alignments(common.table(spark, sf, "documents"), *map(vocabulary, ALIGNED_VOCABULARIES))


def op12_phrase_graph(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(common.table(spark, sf, "documents"))


def op13_bloom_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_duplicates(common.table(spark, sf, "documents"))


CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, 15 + length(replace(regexp_replace(role, '([\\#<])', 'xx', 'g'), ': ', 'xxx'))
            + length(regexp_replace(text, '([\\#<])', 'xx', 'g')) AS chars FROM rows
), placed AS (
  SELECT *, row_number() OVER w AS place, sum(chars) OVER w AS upto FROM sized
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY place), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       count(*) FILTER (role = 'assistant') AS n_examples,
       CAST(sum(CASE WHEN role = 'assistant' THEN upto ELSE 0 END) AS BIGINT) AS example_chars
FROM placed GROUP BY conv_id
"""


COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), numbered AS (
  SELECT lang, row_number() OVER () AS piece_no, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') AS words FROM pieces
), placed AS (
  SELECT lang, piece_no, unnest(words) AS w, generate_subscripts(words, 1) AS word_no FROM numbered
), runs AS (
  SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4, lead(w, 4) OVER p AS w5
  FROM placed WINDOW p AS (PARTITION BY piece_no ORDER BY word_no)
), f AS (
  SELECT lang, [w1] AS g, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2] AS g, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3] AS g, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3, w4] AS g, count(*) FROM runs WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3, w4, w5] AS g, count(*) FROM runs WHERE w5 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
), totals AS (
  SELECT lang, count(*) AS n FROM placed GROUP BY lang
), cuts AS (
  SELECT lang, g, f AS a, unnest(range(1, len(g))) AS cut FROM f WHERE len(g) > 1
), scores AS (
  SELECT c.lang, c.g, c.a, c.cut, x.f AS l, y.f AS r, n, 1000::HUGEINT * c.a * n // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.cut] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.cut + 1:]
  JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, g[i:j] AS g, max(f) AS longer
  FROM (SELECT lang, g, f, i, unnest(range(i + 1, len(g) + 1)) AS j
        FROM (SELECT lang, g, f, unnest(range(1, len(g))) AS i FROM f WHERE len(g) > 2))
  WHERE j - i + 1 < len(g) GROUP BY ALL
), ranked AS (
  SELECT s.lang, array_to_string(s.g, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score,
         row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, array_to_string(s.g, ' ')) AS rank
  FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.g = s.g WHERE longer IS NULL OR 100 * longer < 100 * a
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked WHERE rank <= 2000
"""

EXACT_DEDUP_SQL = """
WITH rows AS (
  SELECT doc_id, row_number() OVER () AS place,
         sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), told AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place_in_group FROM rows
  WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST, place)
)
SELECT doc_id, keep_id, group_size, place_in_group = 1 AS kept, text_sha256 FROM told
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {fn.__name__: fn for fn in (
        op1_hierarchical_kmeans_tree, op2_simhash_golay, op3_wrapper_induction, op4_factorization_machine,
        op5_first_fit_packing, op6_secret_network, op7_sentence_spans, op8_rank_synchronous_counts,
        op9_prefix_target_chat, op10_template_decontamination, op11_fragment_alignment, op12_phrase_graph, op13_bloom_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op9_prefix_target_chat": CHAT_SQL, "op12_phrase_graph": COLLOCATION_SQL,
            "op13_bloom_exact_dedup": EXACT_DEDUP_SQL}
