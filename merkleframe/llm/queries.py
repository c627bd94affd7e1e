"""The registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, rptrees, toxicity
from .common import fold, table
from .linedup import MIN_WORDS, drop_repeated_runs
from .neighbours import search
from .packing import pack_documents
from .pieces import round_trip_digests
from .sharding import shard_documents
from .simhash import fingerprint_hex, near_duplicates
from .tokenids import token_ids


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are on this machine; every executor has the same."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rptrees.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op5_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = toxicity.learn(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2, with_ids=False)


def op7_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language.learn(docs.filter(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language.predicted(model, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def op8_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.filter("vec_id % 100 = 0"))


def op9_suffix_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_runs(docs, MIN_WORDS, count="removed_lines")


#: Brute force: the runs themselves are compared, as texts.
OP9_SQL = r"""
WITH numbered AS (
  SELECT coalesce(doc_id, 9223372036854775807) AS d, text, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS idx
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
worded AS (
  SELECT *, len(regexp_extract_all(line, '[^ 	-
]+')) AS w FROM numbered),
sequence AS (
  SELECT d, text, line, idx, w, row_number() OVER (PARTITION BY d, text ORDER BY idx) AS seq
  FROM worded WHERE w > 0),
framed AS (
  SELECT d, text, seq, idx,
         list(line) OVER f AS lines_f, list(w) OVER f AS w_f, list(idx) OVER f AS idx_f,
         list(line) OVER b AS lines_b, list(w) OVER b AS w_b, list(idx) OVER b AS idx_b
  FROM sequence
  WINDOW f AS (PARTITION BY d, text ORDER BY seq ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING),
         b AS (PARTITION BY d, text ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
shortest AS (
  SELECT *, list_filter(range(1, len(w_f) + 1), lambda n: list_sum(w_f[:n]) >= 50)[1] AS fm,
         list_filter(range(1, len(w_b) + 1), lambda n: list_sum(w_b[len(w_b) - n + 1:]) >= 50)[1] AS bm
  FROM framed),
runs AS (
  SELECT d, text, seq AS start, idx AS a, idx_f[fm] AS z, lines_f[:fm] AS run FROM shortest WHERE fm IS NOT NULL
  UNION
  SELECT d, text, seq - bm + 1, idx_b[len(idx_b) - bm + 1], idx, lines_b[len(lines_b) - bm + 1:] FROM shortest WHERE bm IS NOT NULL),
later AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY d, text, start) AS copy FROM runs),
gone AS (
  SELECT DISTINCT d, text, unnest(range(a, z + 1)) AS idx FROM later WHERE copy > 1),
left_over AS (
  SELECT n.d, n.text, coalesce(string_agg(n.line, chr(10) ORDER BY n.idx) FILTER (WHERE g.idx IS NULL), '') AS new_text, count(g.idx) AS removed
  FROM numbered n LEFT JOIN gone g ON n.d = g.d AND n.text = g.text AND n.idx = g.idx GROUP BY n.d, n.text)
SELECT doc_id, new_text AS text, coalesce(removed, 0)::BIGINT AS removed_lines
FROM documents LEFT JOIN left_over l ON l.d = coalesce(doc_id, 9223372036854775807) AND l.text = documents.text
"""


def op10_piece_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


#: Brute force over all pairs of a label; rows count as vectors of their own.
OP1_SQL = """
WITH RECURSIVE numbered AS (SELECT vec_id, label, embedding, row_number() OVER () AS r FROM embeddings),
usable AS (
  SELECT r, label, embedding::DOUBLE[] AS v FROM numbered
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b
  ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reached AS (
  SELECT r, r AS other FROM numbered
  UNION SELECT r.r, l.b FROM reached r JOIN links l ON l.a = r.other),
component AS (SELECT reached.r, min(n.vec_id) AS component_id FROM reached JOIN numbered n ON n.r = reached.other GROUP BY reached.r),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(l.n, 0) AS n_links, c.component_id, e.vec_id IS NOT DISTINCT FROM c.component_id AS kept
FROM numbered e JOIN component c USING (r) LEFT JOIN counted l ON l.a = e.r
"""

QUERIES = {
    "op1_projection_forest": op1_projection_forest,
    "op2_minimax_sharding": op2_minimax_sharding,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_simhash": op4_simhash,
    "op5_compression_toxicity": op5_compression_toxicity,
    "op6_simple8b": op6_simple8b,
    "op7_hyperdimensional_language": op7_hyperdimensional_language,
    "op8_adaptive_scan": op8_adaptive_scan,
    "op9_suffix_line_dedup": op9_suffix_line_dedup,
    "op10_piece_merges": op10_piece_merges,
}
ORACLE_SQL = {"op1_projection_forest": OP1_SQL, "op9_suffix_line_dedup": OP9_SQL}
