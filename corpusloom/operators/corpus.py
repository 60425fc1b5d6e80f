"""Corpus building: prefix budgets, strided samples, shard rolls, holdout assignment, batches, mixtures.

Every operator takes an explicit ordinal column. Running totals over a whole domain are two-level: totals of blocks of
the ordinal first, then inside each block, so no task ever holds a domain.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import draw, uniform
from ..sources.scratch import Scratch

#: Ordinals in a block of a two-level running sum.
BLOCK = 1024
#: Rows of a bin of next-fit packing, about.
BIN_ROWS = 4096


def running_sums(rows: DataFrame, order: str, values: dict[str, Column], by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Adds a column for each of ``values``: its sum over all earlier rows (exclusive) in ``order``, per ``by``.

    The totals of blocks are few enough for a window of their own; each row is then summed in its block only.
    """
    by, names = by or [], list(values)
    rows = rows.select("*", *[v.alias(f"_v{k}") for k, v in enumerate(values.values())], F.floor(F.col(order) / block).alias("_b"))
    per = rows.groupBy(*by, "_b").agg(*[F.sum(f"_v{k}").alias(f"_t{k}") for k in range(len(names))])
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks, inside = Window.partitionBy(*by).orderBy("_b"), Window.partitionBy(*by, "_b").orderBy(order)
    before = per.select(*by, "_b", *[earlier(f"_t{k}", blocks).alias(f"_base{k}") for k in range(len(names))])
    out = rows.select("*", *[earlier(f"_v{k}", inside).alias(f"_in{k}") for k in range(len(names))]).join(before, [*by, "_b"])
    sums = {name: (F.col(f"_base{k}") + F.col(f"_in{k}")).cast("long") for k, name in enumerate(names)}
    return out.withColumns(sums).drop("_b", *[f"{x}{k}" for x in ("_v", "_in", "_base") for k in range(len(names))])


def running(rows: DataFrame, order: str, value: Column, out: str, by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all earlier rows (exclusive) in ``order``, per ``by``."""
    return running_sums(rows, order, {out: value}, by, block)


def prefix_budget(docs: DataFrame, order: str, size: Column, target: int, by: list[str] | None = None) -> DataFrame:
    """S2, T-4: documents up to and with the one that reaches the budget."""
    return running(docs, order, size, "before", by).filter(F.col("before") < target)


def skip_prefix(docs: DataFrame, order: str, size: Column, skip: int, target: int) -> DataFrame:
    """S3: of non-blank documents, skip the first ``skip``, then take until the budget; at least one is taken."""
    ranked = running(docs, order, F.lit(1), "rank").filter(F.col("rank") >= skip)
    return running(ranked, order, size, "before").filter((F.col("before") < target) | (F.col("rank") == skip))


def strided_sample(docs: DataFrame, order: str, size: Column, budgets: dict[str, int], domain: str, offset: int = 0) -> DataFrame:
    """In each domain every stride-th document until its budget; the stride spreads the sample over the domain."""
    rows = running(docs.filter(F.col(domain).isin(list(budgets))), order, F.lit(1), "i", [domain])
    stat = rows.groupBy(domain).agg(F.count("*").alias("docs"), F.avg(size).alias("avg"))
    budget = F.element_at(F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv]), F.col(domain))
    needed = F.greatest(F.floor(budget / F.greatest("avg", F.lit(1.0))), F.lit(1))
    stat = stat.select(domain, budget.alias("budget"), F.greatest(F.floor(F.col("docs") / needed), F.lit(1)).alias("stride"))
    picked = rows.join(F.broadcast(stat), domain).filter(F.col("i") % F.col("stride") == F.lit(offset) % F.col("stride"))  # a row per domain asked for
    return running(picked, order, size, "before", [domain]).filter(F.col("before") < F.col("budget"))


def _jumps(pdf: pd.DataFrame, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bin's rows, sorted: which are its own, and for those the place of the next shard's start (-1: none) if one
    starts there, and where the chain of such starts leaves the bin."""
    i, p, s, w, n = (pdf[c].to_numpy(np.int64) for c in ("i", "p", "s", "w", "n"))
    own = np.flatnonzero(p // w == pdf["bin"].to_numpy(np.int64))
    at = np.searchsorted(p + s, p[own] + cap, "right")  # the first row that would pass the cap
    inside = at < len(i)
    k = np.minimum(at, len(i) - 1)
    # a shard of nothing but empty rows is not full: the row that passes the cap still joins it
    to = np.where(p[k] > p[own], i[k], i[k] + 1)
    to = np.where(inside & (to < n[own]), to, -1)
    leaves, first = to.copy(), i[own[0]] if len(own) else 0
    for x in range(len(own) - 1, -1, -1):
        if to[x] >= 0 and to[x] - first < len(own):
            leaves[x] = leaves[to[x] - first]
    return own, to, leaves


def next_fit(rows: DataFrame, order: str, size: str, cap: int, by: list[str] | None = None, skip_empty: bool = False) -> DataFrame:
    """Shard of each row: a new one when the current is not empty and the row would pass the cap.

    Each row points to the row that would start the next shard if it started one itself; the starts are the chain of
    pointers from row 0. Rows are dealt to bins of their running sum (some thousand rows or a shard long, whatever is
    longer); a bin finds its pointers and where each chain leaves it, pointers out of bins are doubled over written tables
    until row 0's runs out, and every bin that the chain enters marks its starts from there. No row of any table holds a
    domain; the rounds are the logarithm of the number of bins. With ``skip_empty`` empty rows neither roll nor count.
    """
    by = by or []
    if cap < 1:
        raise ValueError("a shard holds something")
    scratch = Scratch(rows.sparkSession, "next-fit")
    kept = rows.filter(F.col(size) > 0) if skip_empty else rows
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    own = kept.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col(order).alias("_o"), key.alias("g"), F.col(size).cast("long").alias("s"))
    own = scratch.cut(running_sums(own, "_o", {"i": F.lit(1), "p": F.col("s")}, ["g"]), "rows")
    width = F.greatest(F.lit(cap), F.floor(F.avg("s") * BIN_ROWS)).cast("long")
    placed = own.select("g", "i", "p", "s").join(own.groupBy("g").agg(width.alias("w"), F.count("*").alias("n")), "g")
    spans = F.sequence(F.greatest(F.ceil((F.col("p") - cap) / F.col("w")) - 1, F.lit(0)), F.floor((F.col("p") + F.col("s")) / F.col("w")))
    binned = placed.withColumn("bin", F.explode(spans))

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        mine, _, leaves = _jumps(pdf, cap)
        return pd.DataFrame({"g": pdf["g"].iloc[mine], "i": pdf["i"].iloc[mine], "j": leaves})[leaves >= 0]

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        mine, to, _ = _jumps(pdf, cap)
        starts = np.zeros(len(mine), np.int64)
        entered = np.flatnonzero(pdf["entered"].to_numpy()[mine])
        at, first = (int(entered[0]) if len(entered) else -1), int(pdf["i"].iloc[mine[0]]) if len(mine) else 0
        while 0 <= at < len(mine):
            starts[at] = 1
            at = int(to[at]) - first
        return pd.DataFrame({"g": pdf["g"].iloc[mine], "bin": pdf["bin"].iloc[mine], "i": pdf["i"].iloc[mine], "started": np.cumsum(starts)})

    levels = [scratch.cut(binned.groupBy("g", "bin").applyInPandas(leave, "g string, i long, j long"), "leave0")]
    first = own.filter("i = 0").select("g", "i")
    while not levels[-1].filter("i = 0").isEmpty():
        last = levels[-1]
        reached = last.select("g", F.col("j").alias("i")).unionByName(first).distinct()
        further = last.select("g", F.col("i").alias("j"), F.col("j").alias("_j"))
        levels.append(scratch.cut(last.join(reached, ["g", "i"], "left_semi").join(further, ["g", "j"]).select("g", "i", F.col("_j").alias("j")), f"leave{len(levels)}"))
    entries = first
    for level in reversed(levels[:-1]):
        entries = entries.join(level, ["g", "i"], "left").select("g", F.explode(F.array_compact(F.array("i", "j"))).alias("i"))
    flagged = binned.join(entries.withColumn("entered", F.lit(True)), ["g", "i"], "left").withColumn("entered", F.coalesce("entered", F.lit(False)))
    marked = scratch.cut(flagged.groupBy("g", "bin").applyInPandas(mark, "g string, bin long, i long, started long"), "marked")
    before = F.coalesce(F.sum("_s").over(Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = marked.groupBy("g", "bin").agg(F.max("started").alias("_s")).select("g", "bin", before.alias("_before"))
    out = own.join(marked.join(base, ["g", "bin"]), ["g", "i"])
    return out.select(*[F.col(f"_by_{c}").alias(c) for c in by], F.col("_o").alias(order), (F.col("_before") + F.col("started") - 1).alias("shard"))


def json_line_bytes(text: Column) -> Column:
    """K1: bytes of the JSON line of a document with its newline."""
    return F.octet_length(F.to_json(F.struct(text.alias("text")))) + 1


def holdout_candidates(docs: DataFrame, key: str, by: str, size: Column, target_tokens: int, seed: int) -> DataFrame:
    """Documents drawn without replacement, n = max(1, min(2.5 target / mean tokens, half of the documents))."""
    stat = docs.groupBy(by).agg(F.count("*").alias("docs"), F.greatest(F.avg(size) / 4, F.lit(1.0)).alias("tokens"))
    n = F.greatest(F.lit(1), F.floor(F.least(F.lit(float(target_tokens)) * 2.5 / F.col("tokens"), F.col("docs") * 0.5)))
    drawn = docs.withColumn("_d", draw(seed, F.col(by), F.col(key)))
    # the n least draws: rank by two-level running count over blocks of the draw's leading bits, as a domain may be large
    drawn = drawn.withColumn("_k", F.shiftright("_d", 40))
    w = Window.partitionBy(by, "_k").orderBy("_d", key)
    per = drawn.groupBy(by, "_k").count().withColumn("_base", F.coalesce(F.sum("count").over(Window.partitionBy(by).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = drawn.withColumn("_r", F.row_number().over(w)).join(per, [by, "_k"]).join(stat.select(by, n.alias("_n")), by)
    return ranked.filter(F.col("_base") + F.col("_r") <= F.col("_n")).drop("_d", "_k", "_base", "_r", "_n")


def sequential_fill(candidates: DataFrame, order: str, tokens: Column, by: str, limit: int, batch: int) -> DataFrame:
    """Candidates in document order, in batches, to val until its tokens reach the limit at the end of a full batch,
    then to test; the rest is released. A pool that runs out leaves what is left in the split being filled."""
    rows = running(candidates, order, F.lit(1), "i", [by]).withColumn("b", F.floor(F.col("i") / batch)).withColumn("_t", tokens)
    per = rows.groupBy(by, "b").agg(F.count("*").alias("n"), F.sum("_t").alias("t"))
    per = per.withColumn("cum", F.sum("t").over(Window.partitionBy(by).orderBy("b")))
    full = F.col("n") == batch
    val = per.groupBy(by).agg(F.min(F.when(full & (F.col("cum") >= limit), F.struct("b", "cum"))).alias("v"))
    per = per.join(val, by)
    test = per.groupBy(by).agg(F.min(F.when(full & (F.col("b") > F.col("v.b")) & (F.col("cum") - F.col("v.cum") >= limit), F.col("b"))).alias("tb"))
    per = per.join(test, by)
    split = F.when(F.col("v").isNull() | (F.col("b") <= F.col("v.b")), "val").when(F.col("tb").isNull() | (F.col("b") <= F.col("tb")), "test")
    return rows.join(per.select(by, "b", split.alias("split")), [by, "b"]).filter(F.col("split").isNotNull()).drop("i", "b", "_t")


def mixture(streams: DataFrame, weights: dict[str, float], ctx: int, rows: int, seed: int) -> DataFrame:
    """For each of ``rows`` rows a domain by weight and a window start, from hashes of the row number.

    ``streams``: domain, tokens (its length). A stream shorter than a window is refused.
    """
    spark, total, edge = streams.sparkSession, float(sum(weights.values())), 0.0
    if total <= 0:
        raise ValueError("the weights must have a positive sum")
    domain = None
    for name in sorted(weights):
        edge += weights[name] / total
        domain = F.when(F.col("u") < edge, name) if domain is None else domain.when(F.col("u") < edge, name)
    picked = spark.range(rows).withColumn("u", uniform(seed, "domain", F.col("id"))).withColumn("domain", domain.otherwise(sorted(weights)[-1]))
    most = (F.col("tokens") - ctx - 1).cast("long")
    start = F.least(F.floor(uniform(seed, "start", F.col("id")) * (most + 1)), most)
    joined = picked.join(F.broadcast(streams.filter(F.col("domain").isin(list(weights)))), "domain")  # a row per weight given
    return joined.withColumn("_ok", F.when(most >= 0, True).otherwise(F.raise_error(F.lit("a stream is shorter than a window")).cast("boolean"))).filter("_ok").select(F.col("id").alias("row"), "domain", start.cast("long").alias("start"))
