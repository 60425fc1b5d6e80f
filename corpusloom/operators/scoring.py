"""Windows over token streams, a relational n-gram model for per-token losses, scores and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SEPARATOR, draw
from ..sources.scratch import Scratch
from .corpus import running

#: Draws of a bootstrap that one task makes, about.
DRAWS = 1 << 20


def token_stream(docs: DataFrame, order: str, tokens: str, by: str) -> DataFrame:
    """(by, pos, prev, tok): documents of a domain joined by separators, positions from 0.

    ``prev`` is the token before, which for a document's first is the separator of the one before it.
    """
    own = docs.withColumn("_t", F.concat(tokens, F.array(F.lit(SEPARATOR))))
    placed = running(own, order, F.size("_t"), "_at", [by])
    zipped = F.arrays_zip(F.concat(F.array(F.lit(SEPARATOR)), F.slice("_t", F.lit(1), F.size("_t") - 1)).alias("p"), F.transform("_t", lambda x: x).alias("t"))
    return placed.select(by, "_at", F.posexplode(zipped).alias("i", "z")).select(by, (F.col("_at") + F.col("i")).alias("pos"), F.col("z.p").alias("prev"), F.col("z.t").alias("tok"))


def token_pairs(docs: DataFrame, tokens: str, by: str) -> DataFrame:
    """(by, prev, tok) of documents without positions: what counts of pairs need, and no shuffle."""
    separator = F.array(F.lit(SEPARATOR))
    zipped = F.arrays_zip(F.concat(separator, tokens).alias("p"), F.concat(tokens, separator).alias("t"))
    return docs.select(by, F.explode_outer(zipped).alias("z")).select(by, F.col("z.p").alias("prev"), F.col("z.t").alias("tok"))


def window_of_target(stream: DataFrame, by: str, ctx: int, cap: int | None = None) -> DataFrame:
    """Each target token with its window w and offset: the window's inputs are the ctx tokens from w * ctx,
    its targets those one later. Windows: max((n - 1) div ctx, 0) of a stream of n; ``cap`` keeps the first ones."""
    sizes = stream.groupBy(by).agg(F.greatest(F.floor((F.count("*") - 1) / ctx), F.lit(0)).alias("_n"))
    at = F.col("pos") - 1
    out = stream.filter(F.col("pos") > 0).join(F.broadcast(sizes), by)  # a row per domain
    out = out.withColumn("w", F.floor(at / ctx).cast("long")).withColumn("offset", F.pmod(at, F.lit(ctx)).cast("int"))
    limit = F.col("_n") if cap is None else F.least(F.col("_n"), F.lit(cap))
    return out.filter(F.col("w") < limit).drop("_n")


def ngram_nll(targets: DataFrame, train: DataFrame) -> DataFrame:
    """M3 stand-in: adds nll: -ln of half an add-one unigram plus half a bigram model of the train stream.

    The pairs of both are counted in one grouping, into a written table of the different ones: how often the train stream has
    each, and whether the targets ask for it. So nothing is joined with the train stream's pairs; ``targets`` are read twice.
    """
    scratch = Scratch(train.sparkSession, "ngrams")
    both = train.select("prev", "tok", F.lit(1).alias("own")).unionByName(targets.select("prev", "tok", F.lit(0).alias("own")))
    bi = scratch.cut(both.groupBy("prev", "tok").agg(F.sum("own").alias("c2"), (F.min("own") == 0).alias("asked")), "pairs")
    seen = bi.filter("c2 > 0")  # every token has one before it, so sums over pairs are the other counts
    uni = scratch.cut(seen.groupBy("tok").agg(F.sum("c2").alias("c1")), "tokens")
    pre = seen.groupBy("prev").agg(F.sum("c2").alias("c0"))
    total = uni.agg(F.sum("c1").alias("n"), F.count("*").alias("v"))
    # joins on words, of which some are in most pairs, see each different pair of the targets once
    out = bi.filter("asked").join(uni, "tok", "left").join(pre, "prev", "left").join(F.broadcast(total))  # one row
    p1 = (F.coalesce("c1", F.lit(0)) + 1.0) / (F.col("n") + F.col("v") + 1.0)
    p2 = F.coalesce(F.col("c2") / F.col("c0"), F.lit(0.0))
    return targets.join(out.select("prev", "tok", (-F.log(0.5 * p1 + 0.5 * p2)).alias("nll")), ["prev", "tok"])


def window_losses(scored: DataFrame, by: list[str], early: tuple[int, int], late: tuple[int, int]) -> DataFrame:
    """Mean nll, tokens, and the means over the late and early offsets of each window."""
    part = lambda r: F.avg(F.when((F.col("offset") >= r[0]) & (F.col("offset") < r[1]), F.col("nll")))
    return scored.groupBy(*by, "w").agg(F.avg("nll").alias("mean_nll"), F.count("*").alias("n"), part(late).alias("late"), part(early).alias("early"))


def perplexity(losses: DataFrame, by: list[str]) -> DataFrame:
    """Exp of the token-weighted mean."""
    return losses.groupBy(*by).agg(F.count("*").alias("windows"), F.sum("n").alias("tokens"), F.exp(F.sum(F.col("mean_nll") * F.col("n")) / F.sum("n")).alias("perplexity"))


def sequence_logprob(scored: DataFrame, by: list[str], position: str, nll: str, context: int) -> DataFrame:
    """The sum (not the mean) of log probabilities of a sequence's tokens after the first, which is context.

    ``scored`` has a row per token, position from 0. Sequences under two tokens or over ``context`` are refused.
    """
    out = scored.groupBy(*by).agg(F.count("*").alias("tokens"), F.sum(F.when(F.col(position) > 0, -F.col(nll))).alias("logprob"))
    fit = F.col("tokens").between(2, context)
    return out.withColumn("logprob", F.when(fit, F.col("logprob")).otherwise(F.raise_error(F.format_string("a sequence of %d tokens", "tokens")).cast("double")))


def icl_score(losses: DataFrame, by: list[str]) -> DataFrame:
    """Mean over windows of late minus early."""
    return losses.groupBy(*by).agg((F.avg("late") - F.avg("early")).alias("icl"))


def resampled(units: DataFrame, resamples: int, seed: int, by: list[str] | None = None, unit: str = "unit") -> DataFrame:
    """(r, unit, times): how often each unit is drawn in each resample; draws are hashes of (seed, r, j).

    Unit j makes draw j of every resample; units are few and are dealt out first, so that no task makes more than about
    ``DRAWS`` draws. Only counts of draws are shuffled, and a unit row is joined at most once per resample however many draws hit it.
    """
    by = by or []
    size = units.groupBy(*by).agg(F.count("*").alias("n"))
    each = units.select(*by, F.col(unit).cast("long").alias("j"))
    if (tasks := units.count() * resamples // DRAWS + 1) > 1:
        each = each.repartition(tasks, *by, "j")
    draws = (each.join(size, by) if by else each.join(F.broadcast(size))).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))))  # one row without ``by``
    return draws.select(*by, "r", F.pmod(draw(seed, F.col("r"), F.col("j")), F.col("n")).alias(unit)).groupBy(*by, "r", unit).agg(F.count("*").alias("times"))


def of_values(statistic: Callable[[np.ndarray], float], *columns: str) -> Callable[[Column], Column]:
    """Any statistic of the drawn rows as a grouped aggregate: ``statistic`` gets an array (n, k) of the columns, a row
    as often as it is drawn (n for one column), and gives a number.

    One task holds a resample's units, which are windows or readings and not tokens; what sums or weighted percentiles
    (``F.percentile`` takes counts) can say is better built as a column.
    """

    def run(times: pd.Series, *values: pd.Series) -> float:
        drawn = np.repeat(np.column_stack([v.to_numpy(np.float64) for v in values]), times.to_numpy(np.int64), axis=0)
        return float(statistic(drawn[:, 0] if len(values) == 1 else drawn))

    udf = F.pandas_udf(run, "double")
    return lambda times: udf(times, *[F.col(c).cast("double") for c in columns])


def bootstrap(units: DataFrame, statistic: Callable[[Column], Column], resamples: int, seed: int, alpha: float = 0.05, by: list[str] | None = None, unit: str = "unit") -> DataFrame:
    """Percentile interval; the point is the statistic of the observed units.

    ``units`` has a column ``unit`` numbered from 0 per ``by``; ``statistic`` builds an aggregate from a column of weights,
    or from any function of the drawn rows (``of_values``). The units are read some times, so they are best a written table.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    if resamples < 1:
        raise ValueError("there is one resample at least")
    by = by or []
    once = units.withColumn("_once", F.lit(1).cast("long"))
    # two aggregates, as a grouped function in Python does not stand beside others
    point = once.groupBy(*by).agg(statistic(F.col("_once")).alias("point"))
    count = once.groupBy(*by).agg(F.count("*").alias("units"))
    point = point.join(count, by) if by else point.join(F.broadcast(count))  # one row
    each = resampled(units, resamples, seed, by, unit).join(units, [*by, unit]).groupBy(*by, "r").agg(statistic(F.col("times")).alias("s"))
    ends = each.groupBy(*by).agg(F.percentile("s", F.lit(alpha / 2)).alias("ci_low"), F.percentile("s", F.lit(1 - alpha / 2)).alias("ci_high"))
    return point.join(ends, by) if by else point.join(F.broadcast(ends))
