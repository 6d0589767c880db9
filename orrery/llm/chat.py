"""Chat formatting (operator 7): prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, the turn is the target, and
only the target (its text and end mark) is trainable. A turn is written as ``<|role|>``, a line break, its text and
``<|end|>`` with a line break; the prompt ends with the opened assistant turn. ``<|`` inside a text becomes ``< |``, so that
no text can open or end a turn.

Columns: conv_id, turn, n_context (turns before the target), prompt, target, train_from and train_to (the trainable
characters of prompt followed by target; the end is exclusive).

Cases: null and empty texts are empty turns; they stay in the context, but an assistant turn without text is no
target. Null roles are written as ``unknown``; roles count without case and outer blanks. Turns are put in order of
turn, then role and text, nulls first; identical rows are one turn. Rows without a conv_id belong to no conversation and
give nothing; an empty table gives an empty result; other columns aren't carried over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

END = "<|end|>\n"


def examples(conversations: DataFrame) -> DataFrame:
    """One row for each assistant turn with text; a conversation's rows meet once, in one shuffle by conv_id."""
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce(F.lower(F.trim(F.col("role").cast("string"))), F.lit("unknown")).alias("role"),
        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    # array_sort puts null turns last; they come first here
    ordered = whole.select("conv_id", F.expr("concat(filter(turns, t -> t.turn IS NULL), filter(turns, t -> t.turn IS NOT NULL)) AS turns"))
    written = ordered.withColumn("written", F.expr(r"transform(turns, t -> concat('<|', t.role, '|>\n', t.text, '<|end|>\n'))"))
    each = written.select("conv_id", "turns", "written", F.expr("explode(filter(sequence(0, size(turns) - 1), i -> turns[i].role = 'assistant' AND turns[i].text <> '')) AS n_context"))
    made = each.select(
        "conv_id", F.expr("turns[n_context].turn AS turn"), "n_context",
        F.expr(r"concat(array_join(slice(written, 1, n_context), ''), '<|assistant|>\n') AS prompt"), F.expr(r"concat(turns[n_context].text, '<|end|>\n') AS target"),
    )
    return made.withColumn("train_from", F.length("prompt")).withColumn("train_to", F.length("prompt") + F.length("target"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every example of the whole table ``conversations``."""
    return examples(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(lower(trim(role)), 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1)::INTEGER AS n FROM turns),
made AS (
  SELECT a.conv_id, a.turn, a.n AS n_context,
    coalesce(string_agg('<|' || b.role || '|>' || chr(10) || b.text || '<|end|>' || chr(10), '' ORDER BY b.n), '') || '<|assistant|>' || chr(10) AS prompt,
    a.text || '<|end|>' || chr(10) AS target
  FROM numbered a LEFT JOIN numbered b ON a.conv_id = b.conv_id AND b.n < a.n
  WHERE a.role = 'assistant' AND a.text <> '' GROUP BY a.conv_id, a.turn, a.n, a.text)
SELECT *, length(prompt)::INTEGER AS train_from, (length(prompt) + length(target))::INTEGER AS train_to FROM made
"""
