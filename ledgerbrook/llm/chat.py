"""Chat formatting: collapse of cumulative conversation snapshots, then rendering. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table


def with_prefix_hashes(turns: DataFrame) -> DataFrame:
    """turns (conv, turn, role, text) plus place (from 1), a and b: 128 bits that name the conversation up to that turn.

    Each turn is hashed with its place, role and text under two seeds; the running XOR over a conversation is the
    rolling hash of its prefix. Ties in `turn` are ordered by role and text, nulls first.
    """
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    by_conv = W.partitionBy("conv").orderBy(*order)
    so_far = by_conv.rowsBetween(W.unboundedPreceding, 0)
    parts = [F.col("place"), F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull()]
    rows = turns.withColumn("place", F.row_number().over(by_conv))
    return rows.withColumn("a", F.bit_xor(F.xxhash64(F.lit("first"), *parts)).over(so_far)).withColumn("b", F.bit_xor(F.xxhash64(F.lit("second"), *parts)).over(so_far))


def maximal(turns: DataFrame) -> DataFrame:
    """The rows of with_prefix_hashes of conversations that are no proper prefix of another; one (the smallest conv) of equal ones.

    Prefix hashes are made distinct before the anti-join, so a first turn that many conversations share is one key.
    """
    rows = with_prefix_hashes(turns)
    last = W.partitionBy("conv").orderBy(F.col("place").desc())
    marked = rows.withColumn("final", F.row_number().over(last) == 1)
    prefixes = marked.where(~F.col("final")).select("place", "a", "b").distinct()
    finals = marked.where("final").groupBy("place", "a", "b").agg(F.min("conv").alias("conv"))  # equal ones collapse first
    keep = finals.join(prefixes, ["place", "a", "b"], "left_anti").select("conv", F.col("place").alias("turns"))
    return rows.join(keep, "conv")


def chat_format(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per maximal conversation: its id, n_turns, n_chars and the rendered text.

    A turn renders as `<|role|>\\n` + text + `<|end|>\\n`; a null role is `unknown`, a null text is empty. Rows with a null
    id belong to no conversation and are left out. A repeated turn row is a turn. Empty table: empty result. Extra
    columns are ignored. Texts may be of any length, as long as a rendered conversation fits in a row. A rendered conversation is one row, so it is gathered in one place; only after the collapse.
    """
    turns = conversations.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).where(F.col("conv").isNotNull())
    shown = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    rows = maximal(turns).groupBy("conv").agg(F.max("turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("place", shown.alias("shown")))).alias("all"))
    rendered = F.array_join(F.transform("all", lambda x: x["shown"]), "")
    return rows.select(F.col("conv").alias(id_col), F.col("n_turns").cast("long").alias("n_turns"), rendered.alias("rendered")).withColumn("n_chars", F.length("rendered").cast("long"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, ts FROM c GROUP BY ts),
p AS (SELECT DISTINCT ts[1:n] AS ts FROM (SELECT ts, unnest(range(1, len(ts))) AS n FROM u))
SELECT conv_id, CAST(len(ts) AS BIGINT) AS n_turns, r AS rendered, CAST(length(r) AS BIGINT) AS n_chars
FROM (SELECT conv_id, ts, array_to_string(list_transform(ts, lambda x: '<|' || coalesce(x.r, 'unknown') || '|>' || chr(10) || coalesce(x.t, '') || '<|end|>' || chr(10)), '') AS r
      FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.ts = u.ts))
"""
