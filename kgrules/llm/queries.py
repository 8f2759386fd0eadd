"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, lines, lm, media, minhash, mixing, pii, secrets, toxicity
from .common import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components_of(table(spark, sf_dir, "documents"), words=2, percent=80)


def op3_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op4_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe.code(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, digests=True)
    return out.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn, (n, f, p, u) = mixing.probabilities(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", F.col(n).cast("long").alias("n_tokens"), F.round(f, 6).alias("factor"), F.round(p, 6).alias("probability"), (F.col(u) < F.col(p)).alias("sampled"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replace(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("pii_n").alias("n_entities"), *(F.element_at("pii_counts", F.lit(t)).alias(f"n_{t}") for t in ("mail", "ip", "card", "phone", "name")), "text")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicate(table(spark, sf_dir, "documents"), counts=True).select("doc_id", "n_lines", "n_kept", "text")


def op10_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_minhash": op2_minhash, "op3_maxent": op3_maxent, "op4_jpeg": op4_jpeg, "op5_bpe": op5_bpe, "op6_secrets": op6_secrets, "op7_lines": op7_lines, "op8_mixing": op8_mixing, "op9_pii": op9_pii, "op10_ivfpq": op10_ivfpq}


OP2_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
         ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM w
), size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
same AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
edge AS (SELECT x, y FROM same JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
both_ways AS (SELECT x, y FROM edge UNION ALL SELECT y, x FROM edge),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.y FROM reach r JOIN both_ways e ON r.b = e.x)
SELECT w.doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, c.m AS component_id, w.doc_id = c.m AS kept
FROM w LEFT JOIN size USING (doc_id) JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash": OP2_SQL}
