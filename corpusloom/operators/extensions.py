"""Registered measures beyond the trajectory core, the wrapping polynomial hash, and a search in nested results."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .trajectory import placed

#: Fixed value: the base of the polynomial hash.
BASE = 1_000_000_007


def band_trigger(points: DataFrame, run: str, score: str, before: int, sigma: float = 3.0, in_a_row: int = 3) -> DataFrame:
    """The first of ``in_a_row`` points above mean + sigma deviations of the first ``before`` points of the run."""
    p = placed(points, run)
    early = p.filter(F.col("pos") <= before).groupBy(run).agg((F.avg(score) + sigma * F.stddev_samp(score)).alias("level"))
    w = Window.partitionBy(run).orderBy("pos").rowsBetween(0, in_a_row - 1)
    high = p.filter(F.col("pos") > before).join(early, run).withColumn("k", F.sum((F.col(score) > F.col("level")).cast("int")).over(w))
    return high.groupBy(run).agg(F.first("level").alias("level"), F.min(F.when(F.col("k") == in_a_row, F.col("tokens"))).alias("tokens"))


def plateau_anchors(points: DataFrame, run: str, score: str, last: int = 3, shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """The first tokens at which the score reaches shares of its plateau, the mean of the last points."""
    p = placed(points, run)
    n = p.groupBy(run).agg(F.max("pos").alias("n"))
    flat = p.join(n, run).filter(F.col("pos") > F.col("n") - last).groupBy(run).agg(F.avg(score).alias("plateau"))
    at = [F.min(F.when(F.col(score) >= s * F.col("plateau"), F.col("tokens"))).alias(f"at_{round(s * 100)}") for s in shares]
    return p.join(flat, run).groupBy(run).agg(F.first("plateau").alias("plateau"), *at)


def anchor_shift(points: DataFrame, run: str, score: str, lasts: tuple[int, int] = (3, 5), share: float = 0.5) -> DataFrame:
    """How far an anchor moves between two definitions of the plateau."""
    name = f"at_{round(share * 100)}"
    a, b = (plateau_anchors(points, run, score, k, (share,)).select(run, F.col(name).alias(f"a{k}")) for k in lasts)
    return a.join(b, run).withColumn("shift", F.abs(F.col(f"a{lasts[0]}") - F.col(f"a{lasts[1]}")))


def late_divergence(log: DataFrame, run: str, step: str, loss: str, level: float, window: int = 1000) -> DataFrame:
    """The first step at which most of the last ``window`` steps are above the level.

    Steps are cut into blocks of the window, and each block is taken with the one before it, so no window spans a run.
    """
    block = log.withColumn("b", F.floor(F.col(step) / window))
    pair = block.withColumn("g", F.explode(F.array(F.col("b"), F.col("b") + 1)))
    w = Window.partitionBy(run, "g").orderBy(step).rangeBetween(-(window - 1), 0)
    told = pair.withColumn("share", F.avg((F.col(loss) > level).cast("double")).over(w)).filter((F.col("g") == F.col("b")) & (F.col("share") > 0.5))
    return told.groupBy(run).agg(F.min(step).alias("step"))


def poisson_coverage(counts: DataFrame, by: list[str], n: str) -> DataFrame:
    """E5: mean multiplicity and the share that a Poisson draw of that mean would touch."""
    return counts.groupBy(*by).agg(F.avg(n).alias("mean")).withColumn("covered", 1 - F.exp(-F.col("mean")))


def polynomial_hashes(rows: DataFrame, key: str, tokens: str, n: int) -> DataFrame:
    """(key, at, h) for every window of n ids: sum of (id + 1) * BASE^j modulo 2^64, as an unsigned number in text.

    The products wrap, which built-in arithmetic refuses, hence NumPy in Arrow batches.
    """
    powers = np.array([pow(BASE, j, 1 << 64) for j in range(n)], np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, ids in zip(pdf[key], pdf[tokens], strict=True):
                x = np.asarray(ids, np.uint64) + np.uint64(1)
                if len(x) >= n:
                    h = (np.lib.stride_tricks.sliding_window_view(x, n) * powers).sum(1, dtype=np.uint64)
                    yield pd.DataFrame({key: k, "at": np.arange(len(h)), "h": h.astype(str)})

    return rows.select(key, tokens).mapInPandas(run, f"{key} long, at long, h string")


def find_result(tree: Any, domain: str, value: str = "perplexity") -> Any:
    """F8: depth first, the value of the first mapping that has it and names the domain; None without one."""
    if isinstance(tree, dict):
        if tree.get("domain") == domain and value in tree:
            return tree[value]
        tree = list(tree.values())
    for part in tree if isinstance(tree, list) else ():
        if (found := find_result(part, domain, value)) is not None:
            return found
    return None


def found_results(rows: DataFrame, key: str, tree: str, domain: str, value: str = "perplexity") -> DataFrame:
    """F8 over a table of JSON texts: (key, found), null where nothing is found or a text is no JSON."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for text in pdf[tree]:
                try:
                    one = find_result(json.loads(text), domain, value) if text is not None else None
                except json.JSONDecodeError:
                    one = None
                found.append(float(one) if isinstance(one, int | float) and not isinstance(one, bool) else None)
            yield pd.DataFrame({key: pdf[key], "found": pd.array(found, "Float64")})

    return rows.select(key, tree).mapInPandas(run, f"{key} long, found double")


def word_id(word: Column, salt: int) -> Column:
    """A 64-bit number of a word."""
    return F.xxhash64(word, F.lit(salt))


def kneser_ney(train: DataFrame, targets: DataFrame, order: int = 5, discount: float = 0.75, vocabulary: DataFrame | None = None) -> DataFrame:
    """Adds nll, the loss of interpolated Kneser-Ney of that order. Both: w (array of ``order`` tokens, the last is the target).

    The highest order counts grams; a lower one counts in how many different contexts a gram was seen. Each order is two
    grouped tables, joined by gram and by context; an order whose context is unseen passes the lower one on. The lowest
    is uniform over the words seen and one unseen.

    Grams of train are counted once, into a written table; the kinds of each shorter gram are counted from the table of those a
    token longer. Every different gram of the targets, and every different end of one, is scored once, from the shortest on.
    Words are numbered by a salted hash, for which a salt is taken that gives no two words one number. ``vocabulary`` (word)
    holds every word of both, repeated or not, where the caller has them at hand; else they are read off the grams.
    """
    scratch = Scratch(train.sparkSession, "kneser-ney")
    if vocabulary is None:
        vocabulary = train.select("w").unionByName(targets.select("w")).select(F.explode("w").alias("word"))
    vocabulary, salt = scratch.cut(vocabulary.select("word").distinct(), "vocabulary"), 0
    while vocabulary.count() != vocabulary.select(word_id(F.col("word"), salt)).distinct().count():
        salt += 1
    words = [f"_w{i}" for i in range(order)]
    cut = lambda df: df.select("*", *[word_id(F.col("w")[i], salt).alias(c) for i, c in enumerate(words)])
    grams = {order: scratch.cut(cut(train).groupBy(*words).agg(F.count("*").alias("c")), f"grams{order}")}
    asked = {order: scratch.cut(cut(targets).select(*words).distinct(), f"asked{order}")}
    for k in range(order - 1, 0, -1):
        grams[k] = scratch.cut(grams[k + 1].groupBy(*words[-k:]).agg(F.count("*").alias("c")), f"grams{k}")
        asked[k] = scratch.cut(asked[k + 1].select(*words[-k:]).distinct(), f"asked{k}")
    seen = grams[1].agg((F.count("*") + 1.0).alias("v"))
    lower = None
    for k in range(1, order + 1):
        g, h = words[-k:], words[-k:-1]
        out = asked[k].join(grams[k], g, "left")
        context = grams[k].groupBy(*h).agg(F.sum("c").alias("n"), F.count("*").alias("kinds"))
        if lower is None:  # one row each
            out = out.join(F.broadcast(seen)).withColumn("p", 1.0 / F.col("v")).join(F.broadcast(context))
        else:
            out = out.join(context, h, "left").join(lower, g[1:])
        own = F.greatest(F.coalesce("c", F.lit(0)) - discount, F.lit(0.0)) / F.col("n") + discount * F.col("kinds") / F.col("n") * F.col("p")
        lower = scratch.cut(out.select(*g, F.when(F.col("n").isNull(), F.col("p")).otherwise(own).alias("p")), f"scored{k}")
    return cut(targets).join(lower, words).withColumn("nll", -F.log("p")).drop("p", *words)
