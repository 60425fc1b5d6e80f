"""Queries on trajectories and logs. Their tables are derived from ``events``: an event type is a run, days are checkpoints."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import extensions as E
from ..operators import logs as L
from ..operators import trajectory as T
from ..sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


_POINTS = """e AS (SELECT event_type AS run, CAST(date_part('day', ts) AS BIGINT) AS day, count(*) AS n FROM events GROUP BY ALL),
c AS (SELECT run, day, n, round(sum(n) OVER (PARTITION BY run ORDER BY day)::DOUBLE / sum(n) OVER (PARTITION BY run), 6) AS score FROM e),
p AS (SELECT run, day * 10000000 AS tokens, CAST(day * 10000000 AS BIGINT) AS target, day, score, round(score * 1.5, 6) AS prev, round(-score + (n % 7) / 100.0, 6) AS icl, round(3 + 7 * (1 - score) * (1 - score) + (n % 7) / 100.0, 6) AS loss,
  score > 0.5 AS clears, n % 4 AS best, [round(score * 2 * (1 - 0.3 * h), 6) FOR h IN range(4)] AS ov, n % 4 AS heads,
  CASE WHEN run = 'view' THEN NULL ELSE 0.02 END AS control, CASE WHEN run = 'view' THEN NULL WHEN run = 'click' THEN 1 ELSE 0 END AS control_heads, CASE WHEN run <> 'view' THEN run = 'purchase' END AS control_clears FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY tokens) AS pos FROM p)"""
_PHASE = """u AS (SELECT run, count(*) AS n_points, min(pos) FILTER (WHERE score > 0.3) AS end_pos FROM o GROUP BY run),
ph AS (SELECT run, any_value(n_points) AS n_points, any_value(end_pos) AS end_pos, max(tokens) FILTER (WHERE pos = end_pos) AS end_tokens, max(pos) FILTER (WHERE score < 0.1 AND pos < end_pos) AS start_pos, max(tokens) FILTER (WHERE score < 0.1 AND pos < end_pos) AS start_tokens FROM o JOIN u USING (run) GROUP BY run),
pc AS (SELECT *, end_pos IS NOT NULL AND start_pos IS NOT NULL AS crossed FROM ph)"""


def points(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").cast("long").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("run")
    s = F.round(F.sum("n").over(w.orderBy("day")) / F.sum("n").over(w), 6)
    wiggle = (F.col("n") % 7) / 100.0
    c = e.withColumn("score", s)
    return c.select(
        "run", (F.col("day") * 10_000_000).alias("tokens"), (F.col("day") * 10_000_000).alias("target"), "day", "score", F.round(F.col("score") * 1.5, 6).alias("prev"), F.round(-F.col("score") + wiggle, 6).alias("icl"),
        F.round(3 + 7 * (1 - F.col("score")) * (1 - F.col("score")) + wiggle, 6).alias("loss"), (F.col("score") > 0.5).alias("clears"), (F.col("n") % 4).cast("int").alias("best"),
        F.array(*[F.round(F.col("score") * 2 * (1 - F.lit(0.3) * h), 6) for h in range(4)]).alias("ov"), (F.col("n") % 4).alias("heads"), F.when(F.col("run") != "view", 0.02).alias("control"),
        F.when(F.col("run") != "view", (F.col("run") == "click").cast("int")).alias("control_heads"), F.when(F.col("run") != "view", F.col("run") == "purchase").alias("control_clears"),
    )


@query("phase_change", f"WITH {_POINTS}, {_PHASE} SELECT run, n_points, start_tokens, end_tokens, crossed, CASE WHEN crossed THEN end_pos - start_pos - 1 END AS inside FROM pc")
def phase_change(spark, sf):
    """V1, V8, J10, T1, T4."""
    return T.phase_change(points(spark, sf), "run", "score").select("run", "n_points", "start_tokens", "end_tokens", "crossed", "inside")


@query("abruptness", f"""WITH {_POINTS}, {_PHASE}, x AS (SELECT run, max(loss) FILTER (WHERE pos = start_pos) AS l0, max(loss) FILTER (WHERE pos = end_pos) AS l1, arg_min(loss, pos) AS f, arg_max(loss, pos) AS l FROM o JOIN pc USING (run) GROUP BY run),
y AS (SELECT run, start_tokens, end_tokens, crossed, CASE WHEN crossed THEN end_pos - start_pos END AS gap, CASE WHEN crossed AND f - l > 0 THEN (l0 - l1) / (f - l) END AS share, CASE WHEN crossed THEN log10(end_tokens / start_tokens) END AS decades FROM pc JOIN x USING (run))
SELECT run, gap, round(decades, 6) AS decades, round(share, 6) AS share, CASE WHEN NOT crossed THEN 'NO CROSSING' WHEN share IS NULL THEN 'INDETERMINATE' WHEN gap <= 3 AND share <= 0.1 THEN 'ABRUPT' WHEN gap >= 7 OR share >= 0.3 THEN 'GRADUAL' ELSE 'INDETERMINATE' END AS verdict, coalesce(gap, 0) = 1 AS resolution_limited FROM y""")
def abruptness(spark, sf):
    """V2, T1, T3."""
    return T.abruptness(points(spark, sf), "run", "score", "loss").select("run", "gap", F.round("decades", 6).alias("decades"), F.round("share", 6).alias("share"), "verdict", "resolution_limited")


_STEP = "st AS (SELECT run, arg_min(prev_tokens, (delta, tokens)) AS from_tokens, arg_min(tokens, (delta, tokens)) AS to_tokens, min(delta) AS delta FROM (SELECT run, tokens, lag(tokens) OVER w AS prev_tokens, icl - lag(icl) OVER w AS delta FROM o WINDOW w AS (PARTITION BY run ORDER BY tokens)) WHERE delta IS NOT NULL GROUP BY run)"


@query("steepest_step", f"WITH {_POINTS}, {_STEP} SELECT run, from_tokens, to_tokens, round(delta, 6) AS delta FROM st")
def steepest_step(spark, sf):
    """V5."""
    return T.steepest_step(points(spark, sf), "run", "icl").withColumn("delta", F.round("delta", 6))


@query("trajectory_summary", f"""WITH {_POINTS}, {_PHASE}, {_STEP}, fa AS (SELECT run, min(tokens) FILTER (WHERE prev > 0.3) AS first_prev, min(tokens) FILTER (WHERE clears) AS first_copy FROM o GROUP BY run)
SELECT run, n_points, crossed, start_tokens, end_tokens, first_prev, first_copy, from_tokens, to_tokens, n_points >= 2 AS ran FROM pc JOIN fa USING (run) LEFT JOIN st USING (run)""")
def trajectory_summary(spark, sf):
    """V6, V9, P4."""
    return T.summary(points(spark, sf), "run").select("run", "n_points", "crossed", "start_tokens", "end_tokens", "first_prev", "first_copy", "from_tokens", "to_tokens", "ran")


_SETS = """s AS (SELECT run, tokens, list_sort(list(head) FILTER (WHERE k >= 6)) AS heads FROM (SELECT event_type AS run, CAST(date_part('day', ts) AS BIGINT) * 1000000 AS tokens, user_id % 12 AS head, count(*) AS k FROM events GROUP BY ALL) GROUP BY ALL)"""


@query("head_churn", f"""WITH {_SETS}, l AS (SELECT *, lag(heads) OVER w AS old, row_number() OVER w AS i FROM s WINDOW w AS (PARTITION BY run ORDER BY tokens))
SELECT run, tokens, len(list_filter(heads, lambda x: NOT list_contains(old, x))) AS entered, len(list_filter(old, lambda x: NOT list_contains(heads, x))) AS gone FROM (SELECT run, tokens, i, coalesce(heads, []) AS heads, coalesce(old, []) AS old FROM l) WHERE i > 1""")
def head_churn(spark, sf):
    """V4, P11, U-3, D17."""
    k = table(spark, sf, "events").groupBy(F.col("event_type").alias("run"), (F.dayofmonth("ts").cast("long") * 1_000_000).alias("tokens"), (F.col("user_id") % 12).alias("head")).count()
    s = k.groupBy("run", "tokens").agg(F.sort_array(F.collect_list(F.when(F.col("count") >= 6, F.col("head")))).alias("heads"))
    return T.head_churn(s, "run", "heads").select("run", "tokens", F.size("entered").cast("long").alias("entered"), F.size("left").cast("long").alias("gone"))


@query("loss_bump", f"""WITH {_POINTS}, b AS (SELECT run, tokens, pos, exp(3.05 - 0.08 * ln(tokens)) + CASE WHEN day IN (12, 13) AND run <> 'view' THEN 0.3 ELSE 0 END AS loss FROM o),
f AS (SELECT run, regr_slope(ln(loss), ln(tokens)) AS k, regr_intercept(ln(loss), ln(tokens)) AS i FROM b GROUP BY run HAVING count(*) >= 3),
r AS (SELECT b.*, loss - exp(i + k * ln(tokens)) AS residual FROM b JOIN f USING (run)), s AS (SELECT *, stddev_samp(residual) OVER (PARTITION BY run) AS sd FROM r),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY run ORDER BY pos) AS island FROM s WHERE residual > 3 * sd)
SELECT run, count(*) AS length, min(tokens) AS from_tokens, max(tokens) AS to_tokens, arg_max(tokens, residual) AS peak_tokens, round(max(residual), 6) AS peak FROM g GROUP BY run, island HAVING count(*) >= 2""")
def loss_bump(spark, sf):
    """V7, T2, T23."""
    bump = F.when(F.col("day").isin(12, 13) & (F.col("run") != "view"), 0.3).otherwise(0.0)
    p = points(spark, sf).select("run", "tokens", (F.exp(3.05 - 0.08 * F.log(F.col("tokens").cast("double"))) + bump).alias("loss"))
    return T.loss_bumps(p, "run", "loss").withColumn("peak", F.round("peak", 6))


@query("crossing_time", f"""
WITH d AS (SELECT CAST(date_part('day', ts) AS BIGINT) AS pos, event_id % 16 AS seq, event_type AS head, avg(least(1.0, greatest(0.0, (date_part('day', ts) - 8) * 0.02 + value / 1000))) AS value FROM events GROUP BY ALL),
t AS (SELECT r, ('0x' || substr(md5(concat_ws('|', '4', r::VARCHAR, j::VARCHAR)), 1, 15))::BIGINT % 16 AS seq FROM (SELECT range // 16 AS r, range % 16 AS j FROM range(200 * 16))),
m AS (SELECT r, pos, head, avg(value) AS m FROM t JOIN d USING (seq) GROUP BY ALL), b AS (SELECT r, pos, max(m) AS m FROM m GROUP BY ALL), l AS (SELECT max(pos) AS last FROM d),
w AS (SELECT r, coalesce(min(pos) FILTER (WHERE m > 0.3), any_value(last) + 1) AS hit, any_value(last) AS last FROM b, l GROUP BY r), s AS (SELECT list_sort(list(hit)) AS s, avg(CASE WHEN hit > last THEN 1.0 ELSE 0.0 END) AS never, any_value(last) AS last FROM w),
q AS (SELECT s[CAST(round_even(199 * 0.5, 0) AS INT) + 1] AS median, s[CAST(round_even(199 * 0.025, 0) AS INT) + 1] AS low, s[CAST(round_even(199 * 0.975, 0) AS INT) + 1] AS high, never, last FROM s)
SELECT CASE WHEN median <= last THEN median END AS median, CASE WHEN low <= last THEN low END AS low, CASE WHEN high <= last THEN high END AS high, never AS never_share, never <= 0.5 AS reported FROM q""")
def crossing_time(spark, sf):
    """Days are checkpoints, event types heads, and 16 parts of the events the sequences."""
    day = F.dayofmonth("ts").cast("long")
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (day - 8) * 0.02 + F.col("value") / 1000))
    d = table(spark, sf, "events").groupBy(day.alias("pos"), (F.col("event_id") % 16).alias("seq"), F.col("event_type").alias("head")).agg(F.avg(value).alias("value"))
    return T.crossing_bootstrap(d, 0.3, 200, 4)


@query("scorecard", f"""WITH {_POINTS}, {_PHASE}, {_STEP}, an AS (SELECT run, max(pos) FILTER (WHERE score < 0.1) AS anchor FROM o GROUP BY run),
x AS (SELECT run, any_value(crossed) AS crossed, any_value(end_pos - start_pos - 1) AS inside, max(target) FILTER (WHERE pos = end_pos) AS et, arg_max(heads, pos) AS fh, coalesce(max(CASE WHEN pos <= anchor AND prev > 0.3 THEN 1 END), 0) AS ep,
  max(icl) FILTER (WHERE pos = end_pos) - max(icl) FILTER (WHERE pos = start_pos) AS drop_, min(abs(pos - end_pos)) FILTER (WHERE tokens IN (from_tokens, to_tokens)) AS near, arg_min(target, pos) FILTER (WHERE clears) AS ct, max(best) FILTER (WHERE pos = end_pos) AS best, any_value(ov) FILTER (WHERE pos = end_pos) AS ov, any_value(ov) FILTER (WHERE pos = end_pos - 1) AS ovb, max(control) AS control, max(control_heads) AS control_heads, bool_or(control_clears) AS control_clears
  FROM o JOIN pc USING (run) LEFT JOIN st USING (run) JOIN an USING (run) GROUP BY run),
v AS (SELECT run, 'P1' AS id, crossed AND et <= 200000000 AS h, control FROM x UNION ALL SELECT run, 'P2', fh >= 1, control FROM x UNION ALL SELECT run, 'P3', crossed AND inside <= 3, control FROM x UNION ALL SELECT run, 'P4', ep = 1, control FROM x
  UNION ALL SELECT run, 'P5', crossed AND drop_ <= -0.05 AND near <= 1, control FROM x UNION ALL SELECT run, 'P6', ct <= 200000000, control FROM x UNION ALL SELECT run, 'P7', crossed AND greatest(ov[best + 1], ovb[best + 1]) > 0.5, control FROM x UNION ALL SELECT run, 'P8', control < 0.05 AND control_heads = 0 AND NOT control_clears, control FROM x)
SELECT run, id, CASE WHEN coalesce(h, false) THEN 'held' WHEN id = 'P8' AND control IS NULL THEN 'not scored' ELSE 'failed' END AS verdict FROM v""")
def scorecard(spark, sf):
    """V10, J5, J8, T5."""
    return T.scorecard(points(spark, sf), "run")


@query("lr_schedule", "SELECT step, round(CASE WHEN step < 20 THEN 0.0012 * (step + 1) / 20 ELSE 0.00012 + 0.00108 * 0.5 * (1 + cos(pi() * (step - 20) / 99979)) END, 12) AS cosine, round(CASE WHEN step < 20 THEN 0.0012 * (step + 1) / 20 ELSE 0.0012 END, 12) AS constant FROM (SELECT DISTINCT event_id // 50 AS step FROM events)")
def lr_schedule(spark, sf):
    """The rates of the steps that the log has."""
    return T.learning_rates(log(spark, sf).select("step").distinct(), 100_000, 0.0012, 20).select("step", F.round("cosine", 12).alias("cosine"), F.round("constant", 12).alias("constant"))


@query("checkpoint_steps", """WITH t AS (SELECT DISTINCT CAST(user_id * 1000000 AS BIGINT) AS target FROM events), s AS (SELECT CAST(ceil(target / 16384.0) AS BIGINT) - 1 AS step, target FROM t WHERE target > 0),
k AS (SELECT step, min(target) AS target FROM s WHERE step < 6000 GROUP BY step) SELECT * FROM k UNION ALL SELECT 6000, 6001 * 16384""")
def checkpoint_steps(spark, sf):
    """V12, S14, D23."""
    return T.checkpoint_steps(table(spark, sf, "events").select((F.col("user_id") * 1_000_000).alias("target")).distinct(), 16384, 6000)


@query("analytic_chance", "SELECT repeat, round(list_avg(list_transform(range(repeat, 2 * repeat - 1), lambda i: 1.0 / (i + 1))), 9) AS prefix, round(1.0 / vocabulary, 12) AS copy FROM (SELECT p_size + 1 AS repeat, count(*) AS vocabulary FROM part GROUP BY ALL)")
def analytic_chance(spark, sf):
    """Chance for blocks of the sizes that ``part`` has, with as many words as parts."""
    p = table(spark, sf, "part").groupBy((F.col("p_size") + 1).alias("repeat")).agg((F.count("*") + 1).alias("vocabulary"))
    return T.chance(p).select("repeat", F.round("prefix", 9).alias("prefix"), F.round("copy", 12).alias("copy"))


@query("causal_status", """WITH r AS (SELECT event_id AS id, event_id % 11 <> 0 AS reading, event_id % 13 / 100.0 AS copy_low, CASE WHEN event_id % 17 = 0 THEN 0.0 ELSE (event_id % 17 - 8) / 10.0 END AS gap, value AS fraction FROM events),
s AS (SELECT *, CASE WHEN NOT reading THEN 'no reading' WHEN NOT copy_low > 0.02 THEN 'at chance' WHEN abs(gap) < 1e-12 THEN 'degenerate gap' WHEN NOT (gap - 0.25 > 0 OR gap + 0.25 < 0) THEN 'gap includes zero' WHEN fraction IS NULL THEN 'not computed' ELSE 'reported' END AS status FROM r)
SELECT status, count(*) AS n, count(CASE WHEN status = 'reported' THEN fraction END) AS shown FROM s GROUP BY status""")
def causal_status(spark, sf):
    """V16, P13, C7, T25."""
    i = F.col("event_id")
    r = table(spark, sf, "events").select(i.alias("id"), (i % 11 != 0).alias("reading"), (i % 13 / 100.0).alias("copy_low"), F.lit(0.02).alias("chance"), F.when(i % 17 == 0, 0.0).otherwise((i % 17 - 8) / 10.0).alias("gap"), F.col("value").alias("fraction"))
    r = r.withColumn("gap_low", F.col("gap") - 0.25).withColumn("gap_high", F.col("gap") + 0.25)
    return T.status(r).groupBy("status").agg(F.count("*").alias("n"), F.count("fraction").alias("shown"))


_LOG = "g AS (SELECT event_type AS run, event_id // 50 AS step, event_id AS seq, CASE WHEN event_id % 37 = 0 THEN NULL ELSE round(value / 100, 6) END AS loss FROM events), lw AS (SELECT run, step, arg_max(loss, seq) AS loss FROM g WHERE loss IS NOT NULL GROUP BY ALL)"


def log(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select(F.col("event_type").alias("run"), F.floor(i / 50).alias("step"), i.alias("seq"), F.when(i % 37 != 0, F.round(F.col("value") / 100, 6)).alias("loss"))


@query("last_record_wins", f"WITH {_LOG} SELECT run, step, loss FROM lw")
def last_record_wins(spark, sf):
    """S8, D20, T17."""
    return L.last_wins(log(spark, sf), ["run", "step"], "seq", "loss")


@query("max_logged_step", f"WITH {_LOG} SELECT run, coalesce(max(step), -1) AS max_step FROM g GROUP BY run")
def max_logged_step(spark, sf):
    """S9."""
    return L.max_step(log(spark, sf), "step", ["run"])


@query("gate_losses", f"""WITH {_LOG}, x AS (SELECT run, CASE WHEN run = 'signup' THEN step // 3 ELSE step END AS step, CASE WHEN run = 'view' AND seq % 997 = 5 THEN 'inf'::DOUBLE ELSE loss END AS loss FROM g),
w AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step, loss) AS a, row_number() OVER (PARTITION BY run ORDER BY step DESC, loss DESC) AS z FROM x WHERE step < 100 AND loss IS NOT NULL),
m AS (SELECT run, count(*) AS n, list_avg(list(loss) FILTER (WHERE a <= 8 AND isfinite(loss))) AS head, list_avg(list(loss) FILTER (WHERE z <= 8 AND isfinite(loss))) AS tail, bool_or(NOT isfinite(loss)) AS bad FROM w GROUP BY run),
v AS (SELECT run, far, n, head, tail, coalesce(bad, false) AS bad FROM (SELECT run, max(step) AS far FROM x GROUP BY run) LEFT JOIN m USING (run))
SELECT run, CASE WHEN NOT bad THEN round(head, 9) END AS head, CASE WHEN NOT bad THEN round(tail, 9) END AS tail, bad AS non_finite, CASE WHEN bad THEN 'diverged' WHEN NOT (far >= 100 AND coalesce(n, 0) >= 8) THEN 'open' WHEN tail > head THEN 'diverged' ELSE 'passed' END AS verdict FROM v""")
def gate_losses(spark, sf):
    """S10, A26, C9, T18."""
    odd = (F.col("run") == "view") & (F.col("seq") % 997 == 5)
    slow = F.when(F.col("run") == "signup", F.floor(F.col("step") / 3)).otherwise(F.col("step"))
    rows = log(spark, sf).select("run", slow.alias("step"), F.when(odd, float("inf")).otherwise(F.col("loss")).alias("loss"))
    out = L.early_gate(rows, "run", "step", "loss", 100)
    return out.withColumn("head", F.round("head", 9)).withColumn("tail", F.round("tail", 9))


@query("curve_compare", f"""WITH {_LOG}, j AS (SELECT a.step, abs(a.loss - b.loss) AS d FROM lw a JOIN lw b USING (step) WHERE a.run = (SELECT min(run) FROM g) AND b.run = (SELECT max(run) FROM g) AND step BETWEEN 50 AND 150)
SELECT count(*) AS steps, max(step) AS end_step, round(arg_max(d, step), 9) AS end_delta, round(avg(d), 9) AS mean_delta, arg_max(d, step) <= 0.02 AND avg(d) <= 0.015 AS passed FROM j""")
def curve_compare(spark, sf):
    """J3, P5, V14, U-2."""
    c = L.last_wins(log(spark, sf), ["run", "step"], "seq", "loss")
    ends = c.agg(F.min("run").alias("a"), F.max("run").alias("b"))
    a, b = (c.join(F.broadcast(ends.select(F.col(x).alias("run"))), "run") for x in ("a", "b"))  # one row
    out = L.gate(L.curve_delta(a, b, "step", "loss", 50, 150))
    return out.withColumn("end_delta", F.round("end_delta", 9)).withColumn("mean_delta", F.round("mean_delta", 9))


_PAIRS = "pr AS (SELECT a.run AS run_a, b.run AS run_b, count(*) AS steps, arg_max(abs(a.loss - b.loss), a.step) AS e, avg(abs(a.loss - b.loss)) AS m FROM lw a JOIN lw b ON a.step = b.step AND a.run < b.run WHERE a.step BETWEEN 50 AND 150 GROUP BY ALL)"


@query("noise_floor_pairs", f"WITH {_LOG}, {_PAIRS} SELECT run_a, run_b, steps, round(e, 9) AS end_delta, round(m, 9) AS mean_delta FROM pr")
def noise_floor_pairs(spark, sf):
    """J4, S19."""
    out = L.pair_deltas(L.last_wins(log(spark, sf), ["run", "step"], "seq", "loss"), "run", "step", "loss", 50, 150)
    return out.withColumn("end_delta", F.round("end_delta", 9)).withColumn("mean_delta", F.round("mean_delta", 9))


@query("noise_floor", f"""WITH {_LOG}, {_PAIRS}, w AS (SELECT max(e) AS most, count(*) FILTER (WHERE e > 0.02) AS over, count(*) FILTER (WHERE m > 0.015) AS over_mean, count(*) AS pairs FROM pr WHERE run_a <> 'click'), c AS (SELECT min(e) AS low, median(e) AS mid FROM pr WHERE run_a = 'click')
SELECT over, over_mean, pairs, CASE WHEN low <= most AND mid <= most THEN 'inside' WHEN low > most THEN 'above' ELSE 'ambiguous' END AS reading FROM w, c""")
def noise_floor(spark, sf):
    """V15, A21."""
    p = L.pair_deltas(L.last_wins(log(spark, sf), ["run", "step"], "seq", "loss"), "run", "step", "loss", 50, 150)
    return L.noise_reading(p.filter(F.col("run_a") != "click"), p.filter(F.col("run_a") == "click"))


@query("describe_runs", f"WITH {_LOG} SELECT run, count(loss) AS n, min(loss) AS low, round(median(loss), 9) AS median, max(loss) AS high, round(stddev_samp(loss), 9) AS sd FROM lw GROUP BY run")
def describe_runs(spark, sf):
    """A20."""
    from ..operators.stats import describe

    return describe(L.last_wins(log(spark, sf), ["run", "step"], "seq", "loss"), "loss", ["run"]).withColumn("sd", F.round("sd", 9)).withColumn("median", F.round("median", 9))


@query("best_run", f"WITH {_LOG}, a AS (SELECT run, round(avg(loss), 9) AS loss FROM lw GROUP BY run) SELECT run, loss FROM a ORDER BY loss, run LIMIT 1")
def best_run(spark, sf):
    """The run with the least mean loss."""
    c = L.last_wins(log(spark, sf), ["run", "step"], "seq", "loss").groupBy("run").agg(F.round(F.avg("loss"), 9).alias("loss"))
    return L.least(c, "run", "loss")


@query("pilot_summary", """WITH c AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS framework, event_type AS config, CAST(date_part('day', ts) AS BIGINT) AS round, max(value) AS speed FROM events GROUP BY ALL),
r AS (SELECT config, round, max(speed) FILTER (WHERE framework = 'a') / max(speed) FILTER (WHERE framework = 'b') AS q FROM c GROUP BY ALL)
SELECT config, round(median(speed) FILTER (WHERE framework = 'a'), 9) AS median_a, round(median(speed) FILTER (WHERE framework = 'b'), 9) AS median_b, any_value(ratio) AS ratio, any_value(rounds) AS rounds FROM c JOIN (SELECT config, round(median(q), 9) AS ratio, count(q) AS rounds FROM r GROUP BY config) USING (config) GROUP BY config""")
def pilot_summary(spark, sf):
    """A22, D26."""
    c = table(spark, sf, "events").groupBy(F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("framework"), F.col("event_type").alias("config"), F.dayofmonth("ts").cast("long").alias("round")).agg(F.max("value").alias("speed"))
    out = L.pilot_summary(c)
    return out.select("config", *[F.round(x, 9).alias(x) for x in ("median_a", "median_b", "ratio")], "rounds")


@query("pilot_overall", """WITH c AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS framework, event_type AS config, CAST(date_part('day', ts) AS BIGINT) AS round, max(value) AS speed, avg(value) FILTER (WHERE event_type <> 'view') AS load FROM events GROUP BY ALL),
q AS (SELECT max(speed) FILTER (WHERE framework = 'a') / max(speed) FILTER (WHERE framework = 'b') AS q FROM c GROUP BY config, round)
SELECT round(median(q), 9) AS ratio, count(q) AS pairs, (SELECT round(median(load), 9) FROM c) AS load FROM q""")
def pilot_overall(spark, sf):
    """A22."""
    c = table(spark, sf, "events").groupBy(F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("framework"), F.col("event_type").alias("config"), F.dayofmonth("ts").cast("long").alias("round"))
    c = c.agg(F.max("value").alias("speed"), F.avg("value").alias("load")).withColumn("load", F.when(F.col("config") != "view", F.col("load")))
    return L.pilot_overall(c).select(F.round("ratio", 9).alias("ratio"), "pairs", F.round("load", 9).alias("load"))


@query("resume_verdict", """WITH s AS (SELECT user_id AS id, user_id % 9 <> 0 AS ex, user_id % 7 <> 0 AS lo, CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'stage' END AS run_name, user_id % 3 AS seed, user_id - 2 AS step, CASE WHEN user_id % 4 = 0 THEN 5 ELSE (user_id - 1) * 100 END AS tokens, CASE WHEN user_id % 6 = 0 THEN NULL ELSE user_id * 90 END AS newest FROM (SELECT DISTINCT user_id FROM events))
SELECT id, CASE WHEN NOT ex AND newest IS NULL THEN 10 WHEN NOT ex OR NOT lo OR run_name IS NULL OR seed <> 1 OR step < 0 OR tokens <= 0 OR tokens <> (step + 1) * 100 OR coalesce(newest > tokens, false) THEN 20 ELSE 0 END AS exit_code FROM s""")
def resume_verdict(spark, sf):
    """V18, C5, D21."""
    u = F.col("user_id")
    s = table(spark, sf, "events").select("user_id").distinct().select(u.alias("id"), (u % 9 != 0).alias("exists"), (u % 7 != 0).alias("loads"), F.when(u % 5 != 0, "stage").alias("run_name"), F.lit("torch").alias("framework"), (u % 3).alias("seed"), (u - 2).alias("step"), F.when(u % 4 == 0, 5).otherwise((u - 1) * 100).alias("tokens"), F.when(u % 6 != 0, u * 90).alias("newest"))
    return L.resume_verdict(s, "stage", "torch", 1, 100).select("id", "exit_code")


@query("band_trigger", f"""WITH {_POINTS}, b AS (SELECT run, avg(score) + 3 * stddev_samp(score) AS level FROM o WHERE pos <= 6 GROUP BY run),
h AS (SELECT run, tokens, level, sum(CASE WHEN score > level THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS k FROM o JOIN b USING (run) WHERE pos > 6)
SELECT run, round(any_value(level), 6) AS level, min(tokens) FILTER (WHERE k = 3) AS tokens FROM h GROUP BY run""")
def band_trigger(spark, sf):
    """E1."""
    return E.band_trigger(points(spark, sf), "run", "score", 6).withColumn("level", F.round("level", 6))


@query("plateau_anchors", f"""WITH {_POINTS}, f AS (SELECT run, avg(score) AS plateau FROM (SELECT *, max(pos) OVER (PARTITION BY run) AS n FROM o) WHERE pos > n - 3 GROUP BY run)
SELECT run, round(any_value(plateau), 6) AS plateau, min(tokens) FILTER (WHERE score >= 0.1 * plateau) AS at_10, min(tokens) FILTER (WHERE score >= 0.5 * plateau) AS at_50, min(tokens) FILTER (WHERE score >= 0.9 * plateau) AS at_90 FROM o JOIN f USING (run) GROUP BY run""")
def plateau_anchors(spark, sf):
    """E2, E3."""
    return E.plateau_anchors(points(spark, sf), "run", "score").withColumn("plateau", F.round("plateau", 6))


@query("late_divergence", f"""WITH {_LOG}, m AS (SELECT run, step, avg(CASE WHEN loss > 0.5 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY run ORDER BY step RANGE BETWEEN 19 PRECEDING AND CURRENT ROW) AS share FROM lw)
SELECT run, min(step) AS step FROM m WHERE share > 0.5 GROUP BY run""")
def late_divergence(spark, sf):
    """E4."""
    return E.late_divergence(L.last_wins(log(spark, sf), ["run", "step"], "seq", "loss"), "run", "step", "loss", 0.5, 20)


@query("poisson_coverage", "SELECT run, round(avg(n), 9) AS mean, round(1 - exp(-avg(n)), 9) AS covered FROM (SELECT event_type AS run, user_id, count(*) / 20.0 AS n FROM events GROUP BY ALL) GROUP BY run")
def poisson_coverage(spark, sf):
    """E5."""
    c = table(spark, sf, "events").groupBy(F.col("event_type").alias("run"), "user_id").agg((F.count("*") / 20.0).alias("n"))
    return E.poisson_coverage(c, ["run"], "n").select("run", F.round("mean", 9).alias("mean"), F.round("covered", 9).alias("covered"))


_POWERS = [pow(E.BASE, j, 1 << 64) for j in range(4)]


@query("polynomial_hash", f"""WITH c AS (SELECT conv_id, list(length(text) ORDER BY turn) AS ids FROM conversations GROUP BY conv_id), w AS (SELECT conv_id, ids, unnest(range(1, len(ids) - 2)) AS i FROM c WHERE len(ids) >= 4)
SELECT conv_id, i - 1 AS z, CAST(({" + ".join(f"(ids[i + {j}] + 1)::HUGEINT * {p}::HUGEINT" for j, p in enumerate(_POWERS))}) % 18446744073709551616::HUGEINT AS VARCHAR) AS h FROM w""")
def polynomial_hash(spark, sf):
    """Windows of 4 text lengths of each conversation."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda x: x["n"]).alias("ids"))
    return E.polynomial_hashes(c, "conv_id", "ids", 4).select("conv_id", F.col("at").alias("z"), "h")


@query("key_set_difference", "WITH a AS (SELECT DISTINCT user_id, date_part('day', ts) AS day FROM events WHERE event_type = 'view'), b AS (SELECT DISTINCT user_id, date_part('day', ts) AS day FROM events WHERE event_type = 'click') SELECT count(*) - count(CASE WHEN x AND y THEN 1 END) AS odd FROM (SELECT *, true AS x FROM a) FULL JOIN (SELECT *, true AS y FROM b) USING (user_id, day)")
def key_set_difference(spark, sf):
    """J6, U-5: keys that only one of two grids has."""
    e = table(spark, sf, "events").select("user_id", F.dayofmonth("ts").alias("day"), "event_type")
    return T.same_grid(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), ["user_id", "day"])


@query("known_runs", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def known_runs(spark, sf):
    """Rows of known runs only; any other stops the query."""
    from ..sources.readers import known_only

    return known_only(table(spark, sf, "events"), "event_type", ["click", "error", "purchase", "signup", "view"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("shaped_vectors", "SELECT label, count(*) AS n, round(sum(embedding[1]::DOUBLE), 6) AS first FROM embeddings GROUP BY label")
def shaped_vectors(spark, sf):
    """Vectors of one length only."""
    from .control import shape_checked

    return shape_checked(table(spark, sf, "embeddings"), "embedding", 64).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.col("embedding")[0].cast("double")), 6).alias("first"))


@query("registered_readings", "SELECT event_type AS run, count(*) AS n, true AS at_registered_n_sequences FROM events GROUP BY event_type")
def registered_readings(spark, sf):
    """Readings stamped as being at the registered number of sequences."""
    from .control import stamped

    return stamped(table(spark, sf, "events").groupBy(F.col("event_type").alias("run")).agg(F.count("*").alias("n")), 256, 256)


@query("parameter_counts", "WITH c AS (SELECT DISTINCT p_size * 64 AS d, p_size % 12 + 1 AS layers FROM part), m AS (SELECT *, CAST(ceil((8 * d // 3) / 64.0) AS BIGINT) * 64 AS mlp FROM c) SELECT d, layers, mlp, CAST(16384 * d::BIGINT + layers * (4 * d::BIGINT * d + 3 * d * mlp + 2 * d) + d AS BIGINT) AS parameters FROM m")
def parameter_counts(spark, sf):
    """widths and parameters of the configurations that the sizes of ``part`` give."""
    from ..operators.attention import parameter_counts as counted

    c = table(spark, sf, "part").select((F.col("p_size") * 64).alias("d"), (F.col("p_size") % 12 + 1).alias("layers")).distinct()
    return counted(c.withColumn("vocabulary", F.lit(16384))).select("d", "layers", "mlp", "parameters")


@query("portable_paths", "SELECT p_partkey AS id, CASE WHEN starts_with(p, '/bulk/') THEN '$ROOT' || substr(p, 6) ELSE p END AS path FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '/bulk/' WHEN 1 THEN '/bulk2/' ELSE '/other/' END || p_brand AS p FROM part)")
def portable_paths(spark, sf):
    """Paths under a root are told by a variable's name; a root ends at a slash."""
    from ..sources.writers import portable

    k = F.col("p_partkey") % 3
    path = F.concat(F.when(k == 0, "/bulk/").when(k == 1, "/bulk2/").otherwise("/other/"), "p_brand")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), portable(path, "/bulk", "ROOT").alias("path"))


_TREE = """CASE event_id % 4 WHEN 0 THEN '{"a": {"domain": "web", "loss": 1}, "b": [{"domain": "wiki", "perplexity": 1}, {"domain": "web", "perplexity": ' || event_id || '.5}]}'
WHEN 1 THEN '{"domain": "web", "perplexity": ' || event_id || ', "x": {"domain": "web", "perplexity": 0}}' WHEN 2 THEN '{"results": {"domain": "wiki", "perplexity": 3}}' ELSE '{"domain": "web", "perp' END"""


@query("nested_results", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id::DOUBLE + 0.5 WHEN 1 THEN event_id::DOUBLE END AS found FROM events")
def nested_results(spark, sf):
    """F8: the first value of a domain, depth first, in JSON trees of any shape."""
    return E.found_results(table(spark, sf, "events").select("event_id", F.expr(_TREE).alias("tree")), "event_id", "tree", "web")


@query("finite_log", f"WITH {_LOG} SELECT run, count(loss) AS n, round(sum(loss), 6) AS loss FROM g GROUP BY run")
def finite_log(spark, sf):
    """A log that would stop the query at the first non-finite loss."""
    return L.finite_only(log(spark, sf)).groupBy("run").agg(F.count("loss").alias("n"), F.round(F.sum("loss"), 6).alias("loss"))


@query("schedule_rows", "SELECT DISTINCT CAST(date_part('day', ts) * 1000000 AS BIGINT) AS target FROM events")
def schedule_rows(spark, sf):
    """A schedule read from its JSON text, sorted, each target once."""
    from ..sources.readers import schedule

    text = table(spark, sf, "events").agg(F.to_json(F.collect_set(F.dayofmonth("ts") * 1_000_000)).alias("t")).first()["t"]  # a day of the month each
    return spark.createDataFrame([(x,) for x in schedule(text)], "target long")
