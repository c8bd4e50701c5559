"""Token counts of a corpus: the exact histogram of encoded lengths, and what it answers for every context limit.

Cases: a null or empty text has length 0; texts of any length are encoded whole; repeated rows count each; an empty table
gives an empty histogram; only the text column is read, so extra columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tables
from .encoding import SeenPieces, encoded_slabs, encoder

#: Lengths are summed within blocks of so many, and then over blocks, so that no task has to order all lengths.
BLOCK = 1024


def token_lengths(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``n_tokens`` of each row's text. ``path``: a vocabulary file, whose added tokens are one token each in a text."""

    def run(batches):
        encode, added = encoder(path, pattern)
        seen = SeenPieces()
        for batch in batches:
            for _, _, at in encoded_slabs(batch.column(0), encode, added, seen):
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(at))], ["n_tokens"])

    return df.select(text).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per length: documents of it; documents and tokens of at least it (suffix sums); and for that length as a context
    limit the tokens that remain (``truncated_total``) and go (``lost_tokens``), and the share of documents up to it."""
    counts = tables.kept(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    counts = counts.withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row per BLOCK lengths
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(above), zero).alias(f"{c}_above") for c in "dt"], *[F.sum(c).over(everything).alias(f"{c}_all") for c in "dt"])
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    n, d, t = F.col("n_tokens"), F.col("docs_at_least"), F.col("tokens_at_least")
    sums = counts.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(within) + F.col("d_above")).alias("docs_at_least"),
        (F.sum("tokens").over(within) + F.col("t_above")).alias("tokens_at_least"),
        "d_all",
        "t_all",
    )
    return sums.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("t_all") - t + n * d).alias("truncated_total"),
        (t - n * d).alias("lost_tokens"),
        ((F.col("d_all") - d + F.col("n_docs")) / F.col("d_all")).alias("share_up_to"),
    )


def answer(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For any context limits: documents longer than it, tokens that remain under it, tokens that go."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    n, c = F.col("n_tokens"), F.col("context_limit")
    pairs = histogram.select("n_tokens", "n_docs").withColumn("context_limit", F.explode(F.array(*[F.lit(int(x)) for x in limits])))
    found = pairs.groupBy("context_limit").agg(
        F.sum(F.when(n > c, F.col("n_docs")).otherwise(0)).alias("docs_over"),
        F.sum(F.least(n, c) * F.col("n_docs")).alias("truncated_total"),
        F.sum(F.greatest(n - c, F.lit(0)) * F.col("n_docs")).alias("lost_tokens"),
    )
    return asked.join(found, "context_limit", "left").na.fill(0)


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least the share of documents do not exceed (no row for an empty corpus)."""
    return histogram.filter(F.col("share_up_to") >= share).agg(F.min("n_tokens").alias("n_tokens")).filter("n_tokens is not null")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return length_histogram(token_lengths(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))
