"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import chat, decontaminate, embed_dedup, html_text, mixing, ngram_lm, pseudonyms, secrets, simhash, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[secrets.counted(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.shown(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.shown(F.col("spans")).alias("spans"),
    )


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.held_out_scores(_table(spark, sf_dir, "documents"), order=3)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def domains(labels: DataFrame) -> DataFrame:
    """Domains of the labelled documents: toxic, good or poor; null where the label says nothing."""
    domain = F.when(F.col("toxic") > 0, "toxic").when((F.col("toxic") == 0) & (F.col("quality") > 0), "good").when((F.col("toxic") == 0) & (F.col("quality") == 0), "poor")
    return labels.select("doc_id", domain.alias("domain"))


#: Target weights of the registered query.
WEIGHTS = {"good": 0.75, "poor": 0.2, "toxic": 0.05}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), domains(_table(spark, sf_dir, "labels")), WEIGHTS)[0]


#: Key of the registered query and the pipeline; a deployment passes its own secret.
PSEUDONYMS = pseudonyms.Pseudonyms(key="siftlake-demo-key")


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.report(_table(spark, sf_dir, "documents"), PSEUDONYMS)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "start", "matches")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


#: The conversation that every run of op10 adds: control strings and the escape character inside texts.
PROBE = r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    done = chat.format_conversations(turns)
    back = done.select("*", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, row_number() OVER w AS pos, lag(role) OVER w AS before,
    length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t')) AS body,
    CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9
      ELSE 5 + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c')) END AS label
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + label + 2 + body + 8)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'user' THEN role = 'assistant'
    WHEN before IN ('system', 'assistant') THEN role = 'user' ELSE false END) AS valid
FROM sized GROUP BY conv_id
"""


#: All pairs of a label, and what is reachable from each vector.
OP9_SQL = r"""
WITH RECURSIVE
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
good AS (
  SELECT * FROM e WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reached AS (SELECT vec_id, vec_id AS other FROM e UNION SELECT reached.vec_id, links.b FROM reached JOIN links ON links.a = reached.other)
SELECT vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(other) AS component_id, min(other) = vec_id AS kept
FROM reached LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = vec_id GROUP BY vec_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_ngram_lm": op2_ngram_lm,
        "op3_html_text": op3_html_text,
        "op4_mixing": op4_mixing,
        "op5_pseudonyms": op5_pseudonyms,
        "op6_simhash": op6_simhash,
        "op7_decontaminate": op7_decontaminate,
        "op8_toxicity": op8_toxicity,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_chat_format": op10_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_decontaminate": decontaminate.SQL, "op9_embedding_dedup": OP9_SQL, "op10_chat_format": OP10_SQL}
