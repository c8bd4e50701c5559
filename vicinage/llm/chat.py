"""Chat examples by prefix-target expansion: every assistant turn becomes an example of its own, with all turns before it as
context, and only that reply is trainable. Only DataFrame functions are used.

Template of a turn: ``<|turn|>role<|text|>words<|end|>``. Inside roles and texts the characters ``<``, ``>``, ``[``, ``]``
and ``&`` are written as ``&lt;``, ``&gt;``, ``&#91;``, ``&#93;`` and ``&amp;``, so that no control string of this or another common template can
appear there; the way back is exact. A conversation that does not end with a reply has a last example without a target,
so that its other turns are kept.

Cases: a null role or text counts as empty; turns with a null number come first; turns with equal numbers follow one another by role and
text; repeated rows are turns of their own; a null conversation id is one conversation; an empty table gives an empty
table; only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: In the order in which they are put in; the way back takes the reverse order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"), ("]", "&#93;"))


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def expand(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """One row per example: conversation, ``example`` (number of its last turn, from 1), ``formatted``, and the trainable
    part of it: ``loss_start`` (0-based, in code points) and ``loss_length``; null and 0 in an example without a target.
    ``is_last`` marks the example that holds all turns."""
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = df.select(F.col(conv).alias("conv"), row.alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    heads = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT)).alias("head"), escaped(t["text"]).alias("text")))
    ready = turns.select("conv", heads.alias("turns")).withColumn("n", F.size("turns"))
    examples = ready.select("conv", "turns", "n", F.explode(F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (i == F.col("n")) | (F.element_at("turns", i)["role"] == target))).alias("example"))
    whole = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("example") - 1), lambda t: F.concat(t["head"], t["text"], F.lit(END))), "")
    last = F.element_at("turns", F.col("example"))
    made = examples.select("conv", "example", (F.col("example") == F.col("n")).alias("is_last"), whole.alias("context"), last.alias("t"))
    trains = F.col("t.role") == target
    return made.select(
        F.col("conv").alias(conv),
        "example",
        "is_last",
        F.concat("context", "t.head", "t.text", F.lit(END)).alias("formatted"),
        F.when(trains, F.length("context") + F.length("t.head")).alias("loss_start"),
        F.when(trains, F.length("t.text")).otherwise(0).alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted example."""
    parts = F.filter(F.split(formatted, F.lit(r"<\|end\|>")), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.substring_index(F.substring(p, F.lit(len(TURN) + 1), F.length(p)), TEXT, 1)).alias("role"),
            unescaped(F.substring_index(p, TEXT, -1)).alias("text"),
        ),
    )


def digest(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its examples: its turns, and all text under the loss masks in order."""
    loss = unescaped(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length")))
    parts = examples.select(
        conv,
        "example",
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("loss_start").isNotNull(), loss).alias("loss"),
        F.when(F.col("is_last"), read_turns(F.col("formatted"))).alias("turns"),
    )
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: F.coalesce(x["loss"], F.lit(""))), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole = parts.groupBy(conv).agg(F.max_by("turns", F.when(F.col("turns").isNotNull(), F.col("example"))).alias("turns"), joined.alias("loss"), F.count("loss").alias("n_targets"), F.sum("chars").alias("formatted_chars"))
    return whole.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_targets",
    )


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -7L AS conv_id, stack(2, 0L, 'user', '{probe}', 1L, 'assistant', '{probe}') AS (turn, role, text)")
    return digest(expand(rows.unionByName(more)))


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]')) v(turn, role, text)
), numbered AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         sum(16 + 7 + length(replace(replace(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&#91;'), ']', '&#93;'))) OVER (w ROWS UNBOUNDED PRECEDING) AS chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars) FILTER (role = 'assistant' OR k = n)::BIGINT AS formatted_chars,
       count(*) FILTER (role = 'assistant') AS n_targets
FROM numbered GROUP BY conv_id
"""
