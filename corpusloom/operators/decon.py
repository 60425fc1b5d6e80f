"""Decontamination by token n-grams: holdout grams, document filter, residual scan, leak gate.

Grams are joined by a 64-bit hash and the gram itself is compared after the join, so a
collision cannot drop a document. The holdout side is broadcast behind a check of its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SEPARATOR, draw, gram_text, grams
from ..sources.scratch import Scratch
from ..sources.tables import bounded
from .blocks import token_blocks


def holdout_grams(items: DataFrame, tokens: str, n: int) -> DataFrame:
    """A1: distinct grams (h, gram) of the items."""
    return grams(items, tokens, n, []).select("h", "gram").distinct()


def gram_hits(docs: DataFrame, tokens: str, keep: list[str], held: DataFrame, n: int) -> DataFrame:
    """(keep, at, gram) of windows of documents that are held-out grams."""
    side = bounded(held.select("h", F.col("gram").alias("held_gram")))
    # the text of a window is put together only where its hash is found
    return grams(docs, tokens, n, keep, text=False).join(side, "h").filter(gram_text("t", n) == F.col("held_gram")).select(*keep, "at", F.col("held_gram").alias("gram"))


def split_contaminated(docs: DataFrame, key: str, tokens: str, held: DataFrame, n: int) -> DataFrame:
    """Documents with a flag ``dropped``: some window is a held-out gram."""
    bad = Scratch(docs.sparkSession, "dropped").cut(gram_hits(docs, tokens, [key], held, n).select(key).distinct(), "keys")
    return docs.join(bounded(bad.withColumn("dropped", F.lit(True))), key, "left").withColumn("dropped", F.coalesce("dropped", F.lit(False)))


def counters(flagged: DataFrame, tokens: str) -> DataFrame:
    """Documents and tokens (with a separator each) kept and dropped."""
    size = F.size(tokens) + 1
    part = lambda flag: F.coalesce(F.sum(F.when(F.col("dropped") == flag, size)), F.lit(0)).cast("long")
    return flagged.agg(F.count("*").alias("docs_in"), F.count(F.when(F.col("dropped"), 1)).alias("docs_dropped"), part(False).alias("tokens_kept"), part(True).alias("tokens_dropped"))


def stream_grams(docs: DataFrame, order: str, tokens: str, n: int, by: list[str], text: bool = True) -> DataFrame:
    """(by, at, h, gram or t): every window of streams of documents with a separator after each, just once.

    Streams are blocks that overlap by n - 1 tokens, so no row holds a stream, however long it or a document is.
    """
    streams = docs.select(*by, order, F.concat(tokens, F.array(F.lit(SEPARATOR))).alias("_stream"))
    blocks = token_blocks(streams, order, "_stream", by, overlap=n - 1).withColumnRenamed("at", "_at0")
    found = grams(blocks, "tokens", n, [*by, "_at0"], text)
    return found.withColumn("at", F.col("_at0") + F.col("at")).drop("_at0")


def residual(kept: DataFrame, items: DataFrame, order: str, tokens: str, n: int, shard: Column, item_order: str) -> DataFrame:
    """Windows of each kept shard, across documents, that are held-out grams, also across items.

    Windows inside a document are sought where it lies. Those across documents are made of the n - 1 tokens at their ends, so only
    these are brought together, with a null between the two ends of one document; a short document goes whole.
    """
    held = bounded(stream_grams(items, item_order, tokens, n, []).select("h", F.col("gram").alias("held_gram")).distinct())
    own = kept.select(shard.alias("shard"), order, F.concat(tokens, F.array(F.lit(SEPARATOR))).alias("_stream"))
    size = F.size("_stream")
    ends = F.concat(F.slice("_stream", F.lit(1), F.lit(n - 1)), F.array(F.lit(None).cast("string")), F.slice("_stream", size - n + 2, F.lit(n - 1)))
    ends = own.select("shard", order, F.when(size > 2 * n - 2, ends).otherwise(F.col("_stream")).alias("_ends"))
    inside = grams(own.filter(size > 2 * n - 2), "_stream", n, ["shard"], text=False)
    across = grams(token_blocks(ends, order, "_ends", ["shard"], overlap=n - 1), "tokens", n, ["shard"], text=False)
    whole = F.concat(*[F.col(f"t.t{i}") for i in range(n)]).isNotNull()  # no null in it
    found = [w.join(held, "h").filter((gram_text("t", n) == F.col("held_gram")) & whole).select("shard") for w in (inside, across)]
    return own.select("shard").distinct().join(found[0].unionByName(found[1]).groupBy("shard").count(), "shard", "left").select("shard", F.coalesce("count", F.lit(0)).alias("windows"))


def sampled_grams(splits: DataFrame, split: str, key: str, tokens: str, n: int, k: int, seed: int) -> DataFrame:
    """K windows of each split, the least by a hash of their place; a written table.

    The k-th least hash is found from the hashes alone; only windows up to it are put together.
    """
    all_of = grams(splits, tokens, n, [split, key], text=False).withColumn("d", draw(seed, F.col(split), F.col(key), F.col("at")))
    # the least k of each of 64 parts first, so no task sees a whole split
    part = all_of.select(split, "d", F.pmod(F.col("d"), F.lit(64)).alias("p"))
    few = part.withColumn("r", F.row_number().over(Window.partitionBy(split, "p").orderBy("d"))).filter(F.col("r") <= k)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy(split).orderBy("d"))).filter(F.col("r") <= k)
    scratch = Scratch(splits.sparkSession, "sampled-grams")
    last = bounded(scratch.cut(few.groupBy(split).agg(F.max("d").alias("last")), "last"))
    near = all_of.join(last, split).filter(F.col("d") <= F.col("last"))
    few = near.withColumn("r", F.row_number().over(Window.partitionBy(split).orderBy("d", key, "at"))).filter(F.col("r") <= k)
    return scratch.cut(few.select(split, "r", "h", gram_text("t", n).alias("gram")), "grams")


def leak_report(splits: DataFrame, train: DataFrame, split: str, key: str, tokens: str, n: int, k: int, seed: int) -> DataFrame:
    """Per split its samples, leaks into train, and the control: every sample is found in its own split."""
    picked = sampled_grams(splits, split, key, tokens, n, k, seed)
    leak = gram_hits(train, tokens, [], picked.select("h", "gram").distinct(), n).select("gram").distinct().withColumn("leak", F.lit(1))
    own = grams(splits, tokens, n, [split], text=False).join(bounded(picked.select(F.col(split).alias("s"), "h", "gram").distinct()), "h")
    own = own.filter((gram_text("t", n) == F.col("gram")) & (F.col(split) == F.col("s"))).select(split, "gram").distinct().withColumn("own", F.lit(1))
    told = picked.join(leak, "gram", "left").join(own, [split, "gram"], "left").groupBy(split)
    told = told.agg(F.count("*").alias("samples"), F.count("leak").alias("leaks"), (F.count("own") == F.count("*")).alias("control"))
    return told.withColumn("passed", (F.col("leaks") == 0) & F.col("control"))
