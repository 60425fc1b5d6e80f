"""Trajectory analytics over a checkpoint grid. Tables: run, tokens, and readings; windows are over a run's checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import resampled

#: The registered bounds and limits.
LOW, HIGH = 0.1, 0.3
ABRUPT_GAP, ABRUPT_SHARE, GRADUAL_GAP, GRADUAL_SHARE = 3, 0.10, 7, 0.30
BUMP_SIGMA, BUMP_RUN = 3.0, 2


def placed(points: DataFrame, run: str) -> DataFrame:
    """Points with a place on the token axis, numbered in order; controls without one are left out."""
    w = Window.partitionBy(run).orderBy("tokens")
    return points.filter(F.col("tokens").isNotNull()).withColumn("pos", F.row_number().over(w))


def phase_change(points: DataFrame, run: str, score: str, low: float = LOW, high: float = HIGH) -> DataFrame:
    """end = first point above ``high``, start = last one below ``low`` before it, points strictly inside.

    Not crossed: fewer than two points, none above, or none below before the end (which is still returned).
    """
    p = placed(points, run)
    up = p.groupBy(run).agg(F.count("*").alias("n_points"), F.min(F.when(F.col(score) > high, F.col("pos"))).alias("end_pos"))
    told = p.join(up, run)
    out = told.groupBy(run).agg(
        F.first("n_points").alias("n_points"), F.first("end_pos").alias("end_pos"),
        F.max(F.when(F.col("pos") == F.col("end_pos"), F.col("tokens"))).alias("end_tokens"),
        F.max(F.when((F.col(score) < low) & (F.col("pos") < F.col("end_pos")), F.col("pos"))).alias("start_pos"),
        F.max(F.when((F.col(score) < low) & (F.col("pos") < F.col("end_pos")), F.col("tokens"))).alias("start_tokens"),
    )
    enough = F.col("n_points") >= 2
    own = {c: F.when(enough, F.col(c)).alias(c) for c in ("end_pos", "end_tokens", "start_pos", "start_tokens")}
    crossed = enough & F.col("end_pos").isNotNull() & F.col("start_pos").isNotNull()
    return out.select(run, "n_points", *own.values(), crossed.alias("crossed"), F.when(crossed, F.col("end_pos") - F.col("start_pos") - 1).alias("inside"))


def same_grid(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """J6, U-5: how many keys only one side has; 0 means equal key sets."""
    x, y = a.select(*keys).distinct().withColumn("x", F.lit(1)), b.select(*keys).distinct().withColumn("y", F.lit(1))
    return x.join(y, keys, "full_outer").agg(F.count(F.when(F.col("x").isNull() | F.col("y").isNull(), 1)).alias("odd"))


def abruptness(points: DataFrame, run: str, score: str, loss: str) -> DataFrame:
    """V2: grid gap G, decades W, share F of the loss drop inside the crossing, and the verdict."""
    ph = phase_change(points, run, score)
    p = placed(points, run).join(ph, run)
    at = lambda pos: F.max(F.when(F.col("pos") == pos, F.col(loss)))
    one = p.groupBy(run).agg(at(F.col("start_pos")).alias("l0"), at(F.col("end_pos")).alias("l1"), F.min_by(loss, "pos").alias("first"), F.max_by(loss, "pos").alias("last"))
    out = ph.join(one, run)
    total = F.col("first") - F.col("last")
    gap = F.when(F.col("crossed"), F.col("end_pos") - F.col("start_pos"))
    share = F.when(F.col("crossed") & (total > 0), (F.col("l0") - F.col("l1")) / total)
    verdict = (
        F.when(~F.col("crossed"), "NO CROSSING").when(F.col("share").isNull(), "INDETERMINATE")
        .when((F.col("gap") <= ABRUPT_GAP) & (F.col("share") <= ABRUPT_SHARE), "ABRUPT")
        .when((F.col("gap") >= GRADUAL_GAP) | (F.col("share") >= GRADUAL_SHARE), "GRADUAL").otherwise("INDETERMINATE")
    )
    out = out.withColumn("gap", gap).withColumn("share", share).withColumn("decades", F.when(F.col("crossed"), F.log10(F.col("end_tokens") / F.col("start_tokens"))))
    return out.select(run, "start_tokens", "end_tokens", "gap", "decades", "share", verdict.alias("verdict"), (F.coalesce(F.col("gap"), F.lit(0)) == 1).alias("resolution_limited"))


def steepest_step(points: DataFrame, run: str, value: str) -> DataFrame:
    """V5: the least difference between neighbouring points that have the value; the earliest on a tie."""
    w = Window.partitionBy(run).orderBy("tokens")
    step = placed(points.filter(F.col(value).isNotNull()), run).withColumn("from_tokens", F.lag("tokens").over(w)).withColumn("delta", F.col(value) - F.lag(value).over(w)).filter(F.col("delta").isNotNull())
    best = step.groupBy(run).agg(F.min(F.struct("delta", "tokens", "from_tokens")).alias("b"))
    return best.select(run, "b.from_tokens", F.col("b.tokens").alias("to_tokens"), "b.delta")


def head_churn(sets: DataFrame, run: str, heads: str) -> DataFrame:
    """V4: heads that entered and left the set between neighbouring checkpoints."""
    w = Window.partitionBy(run).orderBy("tokens")
    old = F.lag(heads).over(w)
    out = placed(sets, run).withColumn("_old", old).filter(F.col("_old").isNotNull())
    return out.select(run, "tokens", F.array_sort(F.array_except(heads, "_old")).alias("entered"), F.array_sort(F.array_except("_old", heads)).alias("left"))


def first_above(points: DataFrame, run: str, conditions: dict[str, Column]) -> DataFrame:
    """V6: the first tokens at which each condition holds."""
    return placed(points, run).groupBy(run).agg(*[F.min(F.when(c, F.col("tokens"))).alias(n) for n, c in conditions.items()])


def loss_bumps(points: DataFrame, run: str, loss: str, sigma: float = BUMP_SIGMA, shortest: int = BUMP_RUN) -> DataFrame:
    """V7: runs of points above a log-log fit by more than ``sigma`` sample deviations of the residuals (in nats).

    A run of fewer than three points, or with a loss of zero or less, is refused: the query fails.
    """
    p = placed(points, run)
    x = F.log(F.col("tokens").cast("double"))
    y = F.log(F.when(F.col(loss) > 0, F.col(loss)).otherwise(F.raise_error(F.lit("non-positive loss")).cast("double")))
    fit = p.groupBy(run).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    fit = fit.withColumn("slope", F.when(F.col("n") >= 3, F.col("slope")).otherwise(F.raise_error(F.lit("a fit needs at least 3 points")).cast("double")))
    res = p.join(fit, run).withColumn("residual", F.col(loss) - F.exp(F.col("intercept") + F.col("slope") * x))
    res = res.withColumn("sd", F.stddev_samp("residual").over(Window.partitionBy(run))).filter(F.col("residual") > sigma * F.col("sd"))
    island = F.col("pos") - F.row_number().over(Window.partitionBy(run).orderBy("pos"))
    runs = res.withColumn("island", island).groupBy(run, "island").agg(F.count("*").alias("length"), F.min("tokens").alias("from_tokens"), F.max("tokens").alias("to_tokens"), F.max_by("tokens", F.struct("residual", -F.col("pos"))).alias("peak_tokens"), F.max("residual").alias("peak"))
    return runs.filter(F.col("length") >= shortest).drop("island")


def crossing_bootstrap(readings: DataFrame, high: float, resamples: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """When the best head first passes ``high``, over resampled sequences.

    ``readings``: pos (of the checkpoint), seq (from 0), head, value; every checkpoint has the same sequences. Each
    resample draws sequences once for all checkpoints. Never crossing ranks after every checkpoint. Percentiles are the
    nearest ranks, half to even.
    """
    n = readings.select("pos").distinct().agg(F.max("pos").alias("last"))
    seqs = readings.select(F.col("seq").alias("unit")).distinct()
    times = resampled(seqs, resamples, seed)
    means = times.join(readings.withColumnRenamed("seq", "unit"), "unit").groupBy("r", "pos", "head").agg((F.sum(F.col("value") * F.col("times")) / F.sum("times")).alias("m"))
    best = means.groupBy("r", "pos").agg(F.max("m").alias("m"))
    when = best.groupBy("r").agg(F.min(F.when(F.col("m") > high, F.col("pos"))).alias("at")).join(F.broadcast(n)).select(F.coalesce("at", F.col("last") + 1).alias("at"), (F.col("at").isNull()).alias("never"), "last")
    q = lambda p: F.element_at("s", (F.rint((F.size("s") - 1) * F.lit(p)) + 1).cast("int"))
    out = when.agg(F.sort_array(F.collect_list("at")).alias("s"), F.avg(F.col("never").cast("double")).alias("never_share"), F.max("last").alias("last"))
    tidy = lambda c, name: F.when(c <= F.col("last"), c).alias(name)
    return out.select(tidy(q(0.5), "median"), tidy(q(alpha / 2), "low"), tidy(q(1 - alpha / 2), "high"), "never_share", (F.col("never_share") <= 0.5).alias("reported"))


def learning_rates(steps: DataFrame, total: int, peak: float, warmup: int, floor: float = 0.1) -> DataFrame:
    """Cosine with linear warm-up to a tenth of the peak, and the constant schedule. ``steps``: step."""
    s = F.col("step")
    ramp = peak * (s + 1) / warmup
    done = (s - warmup) / F.lit(max(total - 1 - warmup, 1))
    cosine = peak * floor + (peak - peak * floor) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * done))
    return steps.select("step", F.when(s < warmup, ramp).otherwise(cosine).alias("cosine"), F.when(s < warmup, ramp).otherwise(F.lit(peak)).alias("constant"))


def checkpoint_steps(targets: DataFrame, tokens_per_step: int, final_step: int) -> DataFrame:
    """The first step at or past each target; the first target of a step wins; the final step always, with all tokens."""
    step = (F.ceil(F.col("target") / tokens_per_step) - 1).cast("long")
    t = targets.filter(F.col("target") > 0).select(step.alias("step"), "target").filter(F.col("step") <= final_step)
    own = t.filter(F.col("step") < final_step).groupBy("step").agg(F.min("target").alias("target"))
    final = targets.sparkSession.range(1).select(F.lit(final_step).cast("long").alias("step"), F.lit((final_step + 1) * tokens_per_step).cast("long").alias("target"))
    return own.unionByName(final)


def scorecard(points: DataFrame, run: str) -> DataFrame:
    """The eight predictions P1 to P8 of every run, each held or failed (P8: not scored without a control).

    ``points``: run, tokens, target (of the grid), score, prev, icl, clears (copying clears chance), best (the head with the
    score), ov (array by head), heads (count); of the random model control (best score), control_heads (how many reach the
    level) and control_clears. P7 reads the head that is best at the crossing, there and one checkpoint before.
    """
    p = placed(points, run)
    ph = phase_change(points, run, "score")
    steep = steepest_step(points, run, "icl").select(run, F.col("from_tokens").alias("s0"), F.col("to_tokens").alias("s1"))
    t = p.join(ph, run).join(steep, run, "left")
    at = lambda c, pos: F.max(F.when(F.col("pos") == pos, F.col(c)))
    anchor = t.groupBy(run).agg(F.max(F.when(F.col("score") < LOW, F.col("pos"))).alias("anchor"))
    t = t.join(anchor, run)
    one = t.groupBy(run).agg(
        at("target", F.col("end_pos")).alias("end_target"), F.max_by("heads", "pos").alias("final_heads"), F.max(F.when((F.col("pos") <= F.col("anchor")) & (F.col("prev") > HIGH), 1)).alias("early_prev"),
        (at("icl", F.col("end_pos")) - at("icl", F.col("start_pos"))).alias("drop"), F.min(F.when((F.col("tokens") == F.col("s0")) | (F.col("tokens") == F.col("s1")), F.abs(F.col("pos") - F.col("end_pos")))).alias("near"),
        F.min(F.when(F.col("clears"), F.struct("pos", "target"))).alias("copy"), at("best", F.col("end_pos")).alias("best"), at("ov", F.col("end_pos")).alias("ov"), at("ov", F.col("end_pos") - 1).alias("ov_before"),
        F.max("control").alias("control"), F.max("control_heads").alias("control_heads"), F.max("control_clears").alias("control_clears"),
    )
    ov = F.greatest(*[F.get(c, F.col("best")) for c in ("ov", "ov_before")])
    x = one.join(ph.select(run, "crossed", "inside"), run)
    crossed = F.col("crossed")
    held = {
        "P1": crossed & (F.col("end_target") <= 200_000_000), "P2": F.col("final_heads") >= 1, "P3": crossed & (F.col("inside") <= 3), "P4": F.col("early_prev") == 1,
        "P5": crossed & (F.col("drop") <= -0.05) & (F.col("near") <= 1), "P6": F.col("copy.target") <= 200_000_000, "P7": crossed & (ov > 0.5), "P8": (F.col("control") < 0.05) & (F.col("control_heads") == 0) & ~F.col("control_clears"),
    }
    rows = [F.struct(F.lit(k).alias("id"), F.when(F.coalesce(v, F.lit(False)), "held").when(F.lit(k == "P8") & F.col("control").isNull(), "not scored").otherwise("failed").alias("verdict")) for k, v in held.items()]
    return x.select(run, F.explode(F.array(*rows)).alias("v")).select(run, "v.*")


def summary(points: DataFrame, run: str) -> DataFrame:
    """V9: crossing, first previous-token head, first copying, steepest step; ``ran`` is false under two points."""
    first = first_above(points, run, {"first_prev": F.col("prev") > HIGH, "first_copy": F.col("clears")})
    return phase_change(points, run, "score").join(first, run).join(steepest_step(points, run, "icl"), run, "left").withColumn("ran", F.col("n_points") >= 2)


def chance(blocks: DataFrame) -> DataFrame:
    """Adds the analytic chance of prefix matching (mean of 1 / (q + 1) over the second half) and of copying.

    ``blocks``: repeat (2 at least), vocabulary.
    """
    each = F.transform(F.sequence(F.col("repeat").cast("int"), (2 * F.col("repeat") - 2).cast("int")), lambda q: 1.0 / (q + 1))
    return blocks.withColumn("prefix", F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / (F.col("repeat") - 1)).withColumn("copy", 1.0 / (F.col("vocabulary") - 1))


def status(rows: DataFrame) -> DataFrame:
    """Why a recovered fraction is withheld, in order. ``rows``: reading, copy_low, chance, gap, gap_low, gap_high, fraction."""
    s = (
        F.when(~F.col("reading"), "no reading").when(~(F.col("copy_low") > F.col("chance")), "at chance").when(F.abs("gap") < 1e-12, "degenerate gap")
        .when(~((F.col("gap_low") > 0) | (F.col("gap_high") < 0)), "gap includes zero").when(F.col("fraction").isNull() | F.isnan("fraction"), "not computed").otherwise("reported")
    )
    return rows.withColumn("status", s).withColumn("fraction", F.when(F.col("status") == "reported", F.col("fraction")))
