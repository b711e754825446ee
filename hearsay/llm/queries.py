"""The corpus operators as queries over the given tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearsay.llm import (
    best_fit, bpe_rounds, code_language, column_scan, fill_middle, multi_index, pair_ranking, prefix_trie, rans_ids,
    simhash_trie, split_tree, trie_counts, url_trees,
)
from hearsay.llm.common import stored, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trees.judge(table(spark, sf_dir, "pages"))


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


def op3_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_trie.near_groups(table(spark, sf_dir, "documents"), words=3, budget=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("group").alias("component_id"))


def op4_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_ranking.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.token_counts(table(spark, sf_dir, "documents"))


def op6_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_language.identify(table(spark, sf_dir, "documents"))


def op7_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored(rans_ids.segments(table(spark, sf_dir, "documents")), "token-segments")
    return rans_ids.read_back(files)


def op8_bpe_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_rounds.digests(table(spark, sf_dir, "documents"))


def op9_split_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = split_tree.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "source", "size", "source_size", "target",
                       (F.col("size") * F.size("draws")).alias("taken"), "draws")


def op10_column_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_scan.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = stored(best_fit.pieces(table(spark, sf_dir, "documents")), "pieces")
    return best_fit.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    """One query per operator."""
    found = [op1_url_trees, op2_multi_index, op3_simhash_trie, op4_quality_ranking, op5_trie_counts, op6_language_codes,
             op7_rans_ids, op8_bpe_rounds, op9_split_tree, op10_column_scan, op11_best_fit, op12_prefix_trie,
             op13_fill_middle]
    return {f.__name__: f for f in found}


#: All pairs, and what they reach; vectors without a finite, non-zero value take no part.
OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
),
reached(node, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.other
),
roots AS (SELECT node, min(other) AS component_id FROM reached GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN roots r ON r.node = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id"""

OP13_SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents
),
drawn AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || digest[1:8] AS BIGINT) AS h1, CAST('0x' || digest[9:16] AS BIGINT) AS h2,
    CAST('0x' || digest[25:32] AS BIGINT) AS h4
  FROM cut
),
spans AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
),
parts AS (
  SELECT *, array_to_string(units[1:i], '') AS prefix, array_to_string(units[i + 1:j], '') AS middle,
    array_to_string(units[j + 1:], '') AS suffix
  FROM spans
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts"""


def oracle_sql() -> dict[str, str]:
    """The results that SQL can express. The others need hashes, tokenizers or fitted models that it
    lacks; the tests hold them against plain versions."""
    return {"op2_multi_index": OP2_SQL, "op13_fill_middle": OP13_SQL}
