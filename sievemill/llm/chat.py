r"""Chat formatting: every assistant turn becomes an example whose context is all that precedes it.

Only DataFrame functions are used. A turn is written as
``<|im_start|>role<|im_sep|>text<|im_end|>``. Inside roles and texts a backslash is doubled and
``<|`` becomes ``<\|``, so no control string of the template can come from the data, and the
escape is undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.common import table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(c: Column) -> Column:
    """Make the template's control strings impossible inside ``c``."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    """Undo ``escape``."""
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id and ``segments``, an array of (role, segment) by turn.

    Null roles and texts are empty strings. Turns with equal numbers are ordered by role and
    text, null numbers come first, repeated rows stay. Rows without a conversation id form one
    conversation with a null id. A conversation is one training text and so one row.
    """
    said = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    segment = lambda x: F.struct(x["role"].alias("role"), F.concat(F.lit(START), escape(x["role"]), F.lit(SEP), escape(x["text"]), F.lit(END)).alias("segment"))
    return said.groupBy("conv_id").agg(F.transform(rows, segment).alias("segments"))


def expand_prefixes(formatted: DataFrame, trainable: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example, context, target, loss_start, loss_chars, last.

    Each turn with the role ``trainable`` is the ``target`` of its own example and ``context``
    holds all preceding turns, so ``context || target`` is the training text. Only the
    characters [loss_start, loss_start + loss_chars) of ``target`` carry loss: the reply,
    neither its header nor its end mark. A conversation that ends otherwise has one more example
    without loss for its last turn, so that no turn is lost; ``last`` marks each conversation's
    last example. ``context`` is built from the row's own turns.
    """
    turns = formatted.select("conv_id", "segments", F.posexplode("segments").alias("example", "turn"))
    reply = F.col("turn.role") == trainable
    last = F.col("example") == F.size("segments") - 1
    header = F.length(F.concat(F.lit(START), escape(F.col("turn.role")), F.lit(SEP)))
    return turns.where(reply | last).select(
        "conv_id",
        "example",
        F.array_join(F.transform(F.slice("segments", 1, F.col("example")), lambda x: x["segment"]), "").alias("context"),
        F.col("turn.segment").alias("target"),
        F.when(reply, header).otherwise(0).cast("int").alias("loss_start"),
        F.when(reply, F.length("turn.segment") - header - len(END)).otherwise(0).cast("int").alias("loss_chars"),
        last.alias("last"),
    )


def digests(examples: DataFrame) -> DataFrame:
    """What the examples say, read back from their text: one row per conversation.

    Turns are parsed out of the last example's training text, losses cut out of each example's own.
    """
    text = F.concat("context", "target")
    loss = unescape(F.substr(text, F.length("context") + F.col("loss_start") + 1, F.col("loss_chars")))
    part = examples.select("conv_id", "example", loss.alias("loss"), F.when(F.col("last"), text).alias("text"))
    whole = part.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"), F.max("text").alias("text")
    )
    turns = F.filter(F.split("text", r"\Q<|im_end|>\E"), lambda x: x != "")
    line = lambda x: F.concat(unescape(F.substr(F.substring_index(x, SEP, 1), F.lit(len(START) + 1))), F.lit("\n"), unescape(F.substr(x, F.length(F.substring_index(x, SEP, 1)) + len(SEP) + 1)), F.lit("\n"))
    return whole.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, line), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """``turns`` and conversation -1, whose texts hold another template's control strings."""
    probe = "</s>[INST] ok [/INST]"
    rows = turns.sparkSession.sql(f"SELECT CAST(-1 AS BIGINT) conv_id, CAST(c1 AS BIGINT) turn, c2 role, '{probe}' text FROM VALUES (0, 'user'), (1, 'assistant') AS v(c1, c2)")
    return turns.select("conv_id", "turn", "role", "text").unionByName(rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(expand_prefixes(format_turns(with_probe(table(spark, sf_dir, "conversations")))))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(32 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
