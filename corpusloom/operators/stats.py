"""Vocabulary statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(tokens: DataFrame, token: str, by: list[str] | None = None) -> DataFrame:
    """Occurrences of each token, per domain; partial counts first."""
    return tokens.groupBy(*(by or []), token).agg(F.count("*").alias("n"))


def zero_filled(hist: DataFrame, vocabulary: DataFrame, token: str) -> DataFrame:
    """A2: a row for every token of the vocabulary."""
    return vocabulary.join(hist, token, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def thresholds(hist: DataFrame, at: tuple[int, ...] = (1, 10, 100, 1000, 10000)) -> DataFrame:
    """A3: how many tokens (with the separator) occur at least so often."""
    row = hist.agg(*[F.count(F.when(F.col("n") >= t, 1)).alias(f"t{t}") for t in at])
    return row.select(F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("at_least"), F.col(f"t{t}").alias("tokens")) for t in at])).alias("r")).select("r.*")


def rare_share(hist: DataFrame, separator: Column, at: tuple[int, ...] = (10, 100)) -> DataFrame:
    """A4: the share of tokens (without the separator) that occur fewer than so often."""
    own = hist.filter(~separator)
    row = own.agg(F.count("*").alias("v"), *[F.count(F.when(F.col("n") < t, 1)).alias(f"t{t}") for t in at])
    return row.select(F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("below"), (F.col(f"t{t}") / F.col("v")).alias("share")) for t in at])).alias("r")).select("r.*")


def top_mass(hist: DataFrame, separator: Column, ks: tuple[int, ...] = (100, 500, 1000, 4000, 8000)) -> DataFrame:
    """A5: the share of occurrences (without the separator) that the k most frequent tokens have.

    Tokens of one frequency are one row, so the running sum is over distinct frequencies, not over the vocabulary.
    """
    freq = hist.filter(~separator).groupBy("n").agg(F.count("*").alias("m"))
    w = Window.orderBy(F.desc("n"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    told = freq.withColumn("rank", F.coalesce(F.sum("m").over(before), F.lit(0))).withColumn("mass", F.coalesce(F.sum(F.col("m") * F.col("n")).over(before), F.lit(0)))
    every = freq.agg(F.sum(F.col("m") * F.col("n")).alias("every"))
    part = lambda k: F.sum(F.when(F.col("rank") < k, F.least(F.lit(k) - F.col("rank"), F.col("m")) * F.col("n")))
    row = told.agg(*[part(k).alias(f"k{k}") for k in ks]).join(F.broadcast(every))  # one row each
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), (F.col(f"k{k}") / F.col("every")).alias("share")) for k in ks])).alias("r")).select("r.*")


def top_tokens(hist: DataFrame, token: str, separator: Column, n: int) -> DataFrame:
    """A6, T-2, T-3: the n most frequent tokens, ties by token."""
    return hist.filter(~separator & (F.col("n") > 0)).orderBy(F.desc("n"), token).limit(n)


def describe(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """N, min, median, max and sample deviation (null for one row)."""
    c = F.col(value)
    return rows.groupBy(*by).agg(F.count(c).alias("n"), F.min(c).alias("low"), F.percentile(c, F.lit(0.5)).alias("median"), F.max(c).alias("high"), F.when(F.count(c) > 1, F.stddev_samp(c)).alias("sd"))
