"""Streams of tokens as blocks of bounded size, and windows read from them by a range join.

A stream is the documents of a group in order; positions are running sums. A block holds the tokens of ``size`` positions
and, if asked, the first ones of what follows, so that every window of n tokens lies in one block whole (overlap n - 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import running

SIZE = 1 << 16
#: Bytes of text in a bucket of a written table of blocks, about.
BUCKET_BYTES = 16 << 20


def token_blocks(docs: DataFrame, order: str, tokens: str, by: list[str] | None = None, size: int = SIZE, overlap: int = 0) -> DataFrame:
    """(by, block, at, tokens), a row for ``size`` positions; documents are cut at the edges of blocks."""
    by = by or []
    if not 0 <= overlap <= size:
        raise ValueError("the overlap is at most a block")
    placed = running(docs.select(*by, order, F.col(tokens).alias("_t")), order, F.size("_t"), "_p", by).filter(F.size("_t") > 0)
    end = F.col("_p") + F.size("_t")
    spans = F.sequence(F.greatest(F.floor((F.col("_p") - overlap) / size), F.lit(0)).cast("long"), F.floor((end - 1) / size).cast("long"))
    each = placed.select(*by, "_t", "_p", end.alias("_e"), F.explode(spans).alias("block"))
    low, high = F.greatest("_p", F.col("block") * size), F.least("_e", (F.col("block") + 1) * size + overlap)
    pieces = each.select(*by, "block", F.struct(low.alias("at"), F.slice("_t", (low - F.col("_p") + 1).cast("int"), (high - low).cast("int")).alias("t")).alias("piece"))
    blocks = pieces.groupBy(*by, "block").agg(F.array_sort(F.collect_list("piece")).alias("l"))
    return blocks.select(*by, "block", (F.col("block") * size).alias("at"), F.flatten(F.transform("l", lambda x: x["t"])).alias("tokens"))


def buckets_of(size: int) -> int:
    """Buckets for that many bytes of text: one task reads one of them."""
    return max(8, -(-size // BUCKET_BYTES))


def save_blocks(blocks: DataFrame, name: str, path: str, by: list[str] | None = None, buckets: int = 8) -> DataFrame:
    """Blocks as a table bucketed by (by, block): reading windows then moves the picks only, never the tokens."""
    keys = [*(by or []), "block"]
    blocks.repartition(buckets, *keys).write.mode("errorifexists").format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return blocks.sparkSession.table(name)


def windows(blocks: DataFrame, picks: DataFrame, length: int, by: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """Each pick (by, start and its own columns) with ``tokens``, the ``length`` tokens from its start.

    A range join by bins of ``size`` positions: a window lies in few of them, and so does a block. Blocks without a column
    ``block`` (as of files, whose last block is short) may begin anywhere; a pair that meets in two bins counts in one.
    """
    by = by or []
    spans = lambda low, n: F.explode(F.sequence(F.floor(low / size).cast("long"), F.floor((low + n - 1) / size).cast("long")))
    own = [c for c in picks.columns if c not in by]
    asked = picks.select(*by, *own, spans(F.col("start"), F.lit(length)).alias("block"))
    side = blocks if "block" in blocks.columns else blocks.filter(F.size("tokens") > 0).withColumn("block", spans(F.col("at"), F.size("tokens")))
    met = asked.join(side.select(*by, "block", F.col("at").alias("_at"), F.col("tokens").alias("_t")), [*by, "block"])
    low, high = F.greatest("_at", "start"), F.least(F.col("_at") + F.size("_t"), F.col("start") + length)
    met = met.filter((low < high) & (F.col("block") == F.floor(low / size)))
    piece = F.struct(low.alias("at"), F.slice("_t", (low - F.col("_at") + 1).cast("int"), (high - low).cast("int")).alias("t"))
    out = met.select(*by, *own, piece.alias("_piece")).groupBy(*by, *own).agg(F.array_sort(F.collect_list("_piece")).alias("_l"))
    out = out.withColumn("tokens", F.flatten(F.transform("_l", lambda x: x["t"]))).drop("_l")
    return out.withColumn("tokens", F.when(F.size("tokens") == length, F.col("tokens")).otherwise(F.raise_error(F.lit("a window lies outside its stream")).cast("array<int>" if dict(blocks.dtypes)["tokens"] == "array<int>" else "array<string>")))


def batch(read: DataFrame) -> DataFrame:
    """X and y of each window, y one token later."""
    n = F.size("tokens")
    return read.withColumn("x", F.slice("tokens", F.lit(1), n - 1)).withColumn("y", F.slice("tokens", F.lit(2), n - 1)).drop("tokens")
