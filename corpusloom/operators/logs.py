"""Training-log operators: last record wins, gates, curve comparison, noise floor, resume rules, throughput cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOL_END, TOL_MEAN = 0.02, 0.015


def last_wins(log: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """The last value of each step; records without step or value are skipped."""
    ok = log.filter(F.col(value).isNotNull())
    for k in keys:
        ok = ok.filter(F.col(k).isNotNull())
    return ok.groupBy(*keys).agg(F.max_by(value, seq).alias(value))


def max_step(log: DataFrame, step: str, by: list[str]) -> DataFrame:
    """The newest step, -1 without one."""
    return log.groupBy(*by).agg(F.coalesce(F.max(step), F.lit(-1)).cast("long").alias("max_step"))


def early_gate(log: DataFrame, run: str, step: str, loss: str, window: int, k: int = 8) -> DataFrame:
    """S10, A26, C9, T-5, T18: means of the first and last k losses before ``window``, and the verdict on each run.

    A record without a loss only tells how far the run is; records that repeat a step count as they are. A non-finite loss
    is divergence at once. Otherwise nothing is decided until the run has reached the window and k losses are there:
    then a rising mean is divergence, and any other passes. ``verdict``: open, diverged or passed.
    """
    far = log.groupBy(run).agg(F.max(step).alias("far"))
    early = log.filter((F.col(step) < window) & F.col(loss).isNotNull())
    up, down = Window.partitionBy(run).orderBy(step, loss), Window.partitionBy(run).orderBy(F.desc(step), F.desc(loss))
    t = early.withColumn("a", F.row_number().over(up)).withColumn("z", F.row_number().over(down))
    bad = F.max((F.isnan(loss) | (F.abs(loss) == float("inf"))).cast("int")) == 1
    out = far.join(t.groupBy(run).agg(F.count("*").alias("n"), F.avg(F.when(F.col("a") <= k, F.col(loss))).alias("head"), F.avg(F.when(F.col("z") <= k, F.col(loss))).alias("tail"), bad.alias("non_finite")), run, "left")
    bad = F.coalesce("non_finite", F.lit(False))
    due = (F.col("far") >= window) & (F.coalesce("n", F.lit(0)) >= k)
    verdict = F.when(bad, "diverged").when(~due, "open").when(F.col("tail") > F.col("head"), "diverged").otherwise("passed")
    shown = [F.when(~bad, F.col(c)).alias(c) for c in ("head", "tail")]
    return out.select(run, *shown, bad.alias("non_finite"), verdict.alias("verdict"))


def curve_delta(a: DataFrame, b: DataFrame, step: str, loss: str, low: int, high: int, by: list[str] | None = None) -> DataFrame:
    """J3, P5, U-2: absolute differences on the common steps in [low, high]: at the last one, and on average."""
    by = by or []
    on = a.filter(F.col(step).between(low, high)).select(*by, step, F.col(loss).alias("x")).join(b.filter(F.col(step).between(low, high)).select(*by, step, F.col(loss).alias("y")), [*by, step])
    d = F.abs(F.col("x") - F.col("y"))
    return on.groupBy(*by).agg(F.count("*").alias("steps"), F.max(step).alias("end_step"), F.max_by(d, step).alias("end_delta"), F.avg(d).alias("mean_delta"))


def gate(delta: DataFrame, end: float = TOL_END, mean: float = TOL_MEAN) -> DataFrame:
    """Passes if both differences are finite and within tolerance."""
    ok = lambda c, t: ~F.isnan(c) & (F.abs(c) != float("inf")) & (F.col(c) <= t)
    return delta.withColumn("passed", ok("end_delta", end) & ok("mean_delta", mean))


def pair_deltas(curves: DataFrame, run: str, step: str, loss: str, low: int, high: int) -> DataFrame:
    """Differences of every unordered pair of runs; the runs are few, the steps are joined by key."""
    c = curves.filter(F.col(step).between(low, high)).select(run, step, loss)
    a, b = c.select(F.col(run).alias("run_a"), step, F.col(loss).alias("x")), c.select(F.col(run).alias("run_b"), step, F.col(loss).alias("y"))
    on = a.join(b, step).filter(F.col("run_a") < F.col("run_b"))
    d = F.abs(F.col("x") - F.col("y"))
    return on.groupBy("run_a", "run_b").agg(F.count("*").alias("steps"), F.max_by(d, step).alias("end_delta"), F.avg(d).alias("mean_delta"))


def noise_reading(within: DataFrame, cross: DataFrame, end: float = TOL_END, mean: float = TOL_MEAN) -> DataFrame:
    """Is the cross spread inside the within spread, above it, or neither? And pairs over either tolerance."""
    over = lambda c, t: F.count(F.when(F.col(c) > t, 1))
    w = within.agg(F.max("end_delta").alias("most"), over("end_delta", end).alias("over"), over("mean_delta", mean).alias("over_mean"), F.count("*").alias("pairs"))
    c = cross.agg(F.min("end_delta").alias("least"), F.percentile("end_delta", F.lit(0.5)).alias("middle"))
    reading = F.when((F.col("least") <= F.col("most")) & (F.col("middle") <= F.col("most")), "inside").when(F.col("least") > F.col("most"), "above").otherwise("ambiguous")
    return w.join(F.broadcast(c)).select("over", "over_mean", "pairs", reading.alias("reading"))  # one row each


def resume_verdict(state: DataFrame, run_name: str, framework: str, seed: int, tokens_per_step: int) -> DataFrame:
    """RESUME 0, FRESH 10 or REFUSE 20, by the first rule that applies.

    ``state``: exists, loads, run_name, framework, seed, step, tokens (null: missing key), newest (grid checkpoint or null).
    """
    keys = ("run_name", "framework", "seed", "step", "tokens")
    missing = F.coalesce(*[F.when(F.col(k).isNull(), F.lit(k)) for k in keys])
    rules: list[tuple[Column, str, int]] = [
        (~F.col("exists") & F.col("newest").isNull(), "fresh", 10), (~F.col("exists"), "no resume state", 20), (~F.col("loads"), "does not load", 20), (missing.isNotNull(), "missing key", 20),
        (F.col("run_name") != run_name, "run name", 20), (F.col("framework") != framework, "framework", 20), (F.col("seed") != seed, "seed", 20), ((F.col("step") < 0) | (F.col("tokens") <= 0), "implausible", 20),
        (F.col("tokens") != (F.col("step") + 1) * tokens_per_step, "tokens do not match the step", 20), (F.col("newest") > F.col("tokens"), "grid is ahead", 20),
    ]
    why, code = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for c, w, k in rules[1:]:
        why, code = why.when(c, w), code.when(c, k)
    return state.withColumn("reason", why.otherwise("resume")).withColumn("exit_code", code.otherwise(0))


def pilot_summary(cells: DataFrame) -> DataFrame:
    """Median speed per configuration and framework; the ratio of the two within a round, then its median.

    ``cells``: framework (a or b), config, round, speed (null when the cell failed).
    """
    ok = cells.filter(F.col("speed").isNotNull())
    med = ok.groupBy("config").agg(*[F.percentile(F.when(F.col("framework") == f, F.col("speed")), F.lit(0.5)).alias(f"median_{f}") for f in ("a", "b")])
    pair = ok.groupBy("config", "round").agg(*[F.max(F.when(F.col("framework") == f, F.col("speed"))).alias(f) for f in ("a", "b")]).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    ratio = pair.groupBy("config").agg(F.percentile(F.col("a") / F.col("b"), F.lit(0.5)).alias("ratio"), F.count("*").alias("rounds"))
    return med.join(ratio, "config", "left")


def pilot_overall(cells: DataFrame) -> DataFrame:
    """The median of the within-round ratios of all cells, their number, and the median load (nulls left out)."""
    each = cells.groupBy("config", "round").agg(*[F.max(F.when(F.col("framework") == f, F.col("speed"))).alias(f) for f in ("a", "b")]).select((F.col("a") / F.col("b")).alias("q"))
    load = cells.agg(F.percentile("load", F.lit(0.5)).alias("load"))
    return each.agg(F.percentile("q", F.lit(0.5)).alias("ratio"), F.count("q").alias("pairs")).join(F.broadcast(load))  # one row each


def finite_only(log: DataFrame, loss: str = "loss", step: str = "step") -> DataFrame:
    """The log as it is; a non-finite loss stops the query and names its step."""
    bad = F.isnan(loss) | (F.abs(loss) == float("inf"))
    stop = F.raise_error(F.concat(F.lit("non-finite loss at step "), F.coalesce(F.col(step).cast("string"), F.lit("?")))).cast("double")
    return log.withColumn(loss, F.when(F.coalesce(bad, F.lit(False)), stop).otherwise(F.col(loss)))


def least(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The key with the least value; the first key on a tie."""
    return rows.agg(F.min(F.struct(value, key)).alias("m")).select(F.col(f"m.{key}").alias(key), F.col(f"m.{value}").alias(value))


def schedule_step(done: dict[str, bool]) -> tuple[str | None, int]:
    """The first step whose artefact is missing, and the exit code: 0 all done, 10 something to run."""
    for name, there in done.items():
        if not there:
            return name, 10
    return None, 0
