"""Operators on fixtures whose answers are known."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import draw, grams, strip, words
from corpusloom.operators import attention as A
from corpusloom.operators import blocks as B
from corpusloom.operators import corpus as C
from corpusloom.operators import decon as D
from corpusloom.operators import extensions as E
from corpusloom.operators import kernel as K
from corpusloom.operators import logs as L
from corpusloom.operators import scoring as S
from corpusloom.operators import trajectory as T


def test_strip_and_words(spark):
    df = spark.createDataFrame([(" \n a  b\t",), ("",), (None,)], "t string").select(strip(F.col("t")).alias("s"), words(F.col("t")).alias("w"))
    assert [tuple(r) for r in df.collect()] == [("a  b", ["a", "b"]), ("", []), (None, [])]


def test_short_text_has_no_gram(spark):
    df = spark.createDataFrame([(1, ["1", "2", "3"]), (2, list("567895678"))], "i long, w array<string>")
    rows = grams(df, "w", 4, ["i"]).collect()
    assert {r["i"] for r in rows} == {2} and len(rows) == 6
    by = {r["at"]: r["h"] for r in rows}
    assert by[0] == by[5] and by[0] != by[1]


def test_prefix_skip(spark):
    rows = [(i, "x" * 50) for i in range(20)]
    df = spark.createDataFrame(rows, "i long, t string")
    assert [r["i"] for r in C.skip_prefix(df, "i", F.length("t"), 5, 1).collect()] == [5]
    assert [r["i"] for r in C.skip_prefix(df, "i", F.length("t"), 5, 0).collect()] == [5]


def test_next_fit(spark):
    df = spark.createDataFrame([(i, 10) for i in range(5)], "i long, n long")
    rows = {r["i"]: r["shard"] for r in C.next_fit(df, "i", "n", 25).collect()}
    assert [rows[i] for i in range(5)] == [0, 0, 1, 1, 2]
    big = spark.createDataFrame([(0, 99), (1, 0), (2, 5)], "i long, n long")
    assert {r["i"]: r["shard"] for r in C.next_fit(big, "i", "n", 25).collect()} == {0: 0, 1: 1, 2: 1}
    assert {r["i"]: r["shard"] for r in C.next_fit(big, "i", "n", 25, skip_empty=True).collect()} == {0: 0, 2: 1}


def folded(sizes, cap):
    out, shard, fill = [], 0, 0
    for n in sizes:
        if fill > 0 and fill + n > cap:
            shard, fill = shard + 1, 0
        fill += n
        out.append(shard)
    return out


@pytest.mark.parametrize("bin_rows", [3, 40, 4096])
def test_next_fit_equals_a_fold(spark, monkeypatch, bin_rows):
    """Bins of any size, empty and oversize rows, groups of one row, a null group."""
    monkeypatch.setattr(C, "BIN_ROWS", bin_rows)
    g = np.random.default_rng(bin_rows)
    groups = {"one": [5], None: g.integers(0, 30, 300), "empty": [0] * 40, "wide": g.choice([0, 0, 0, 40], 200), "same": [10] * 150, "mixed": g.choice([1, 1, 1, 1, 500, 24, 25, 26], 257)}
    rows = [(k, 3 * i, int(n)) for k, l in groups.items() for i, n in enumerate(l)]
    want = {(k, 3 * i): x for k, l in groups.items() for i, x in enumerate(folded(l, 25))}
    df = spark.createDataFrame(rows, "i string, p long, n long").repartition(5)
    assert {(r["i"], r["p"]): r["shard"] for r in C.next_fit(df, "p", "n", 25, ["i"]).collect()} == want
    some = {(k, 3 * i): n for k, l in groups.items() for i, n in enumerate(l) if n}
    want = {(k, i): x for g in groups for (k, i), x in zip([x for x in some if x[0] == g], folded([n for x, n in some.items() if x[0] == g], 25), strict=True)}
    assert {(r["i"], r["p"]): r["shard"] for r in C.next_fit(df, "p", "n", 25, ["i"], skip_empty=True).collect()} == want


def test_next_fit_of_many_batches(spark):
    """300,000 batches: the same shards as a fold, and no plan that gathers a domain."""
    df = spark.range(300_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(50)) + 1).alias("n"))
    out = C.next_fit(df, "id", "n", 700)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    sizes = [r["n"] for r in df.orderBy("id").collect()]
    assert [r["shard"] for r in out.orderBy("id").collect()] == folded(sizes, 700)


def stream(rows, n):
    tokens = [t for _, w in sorted(rows) for t in [*w, "<sep>"]]
    return collections.Counter(" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


@pytest.mark.parametrize("size", [8, 9, 64, 1 << 16])
def test_blocks_hold_every_window_once(spark, monkeypatch, size):
    """Documents longer and shorter than a block and than a window, empty ones, windows over many documents."""
    g = np.random.default_rng(size)
    rows = [(i, [f"t{x}" for x in g.integers(0, 4, int(k))]) for i, k in enumerate(g.choice([0, 0, 1, 2, 30, 100], 60))]
    df = spark.createDataFrame(rows, "k long, w array<string>").repartition(3)
    whole = [t for _, w in rows for t in w]
    got = B.token_blocks(df, "k", "w", size=size, overlap=4).orderBy("block").collect()
    assert all(r["tokens"] == whole[r["at"] : r["at"] + size + 4] and r["at"] == r["block"] * size for r in got) and len(got) == -(-len(whole) // size)
    monkeypatch.setattr(D, "token_blocks", lambda *a, **k: B.token_blocks(*a, **k, size=size))
    found = D.stream_grams(df, "k", "w", 5, [])
    assert collections.Counter(r["gram"] for r in found.collect()) == stream(rows, 5)
    assert sorted(r["at"] for r in found.collect()) == list(range(len(whole) + len(rows) - 4))


def test_residual_sees_across_documents(spark):
    docs = spark.createDataFrame([(0, ["a", "b"]), (1, ["c"]), (2, ["d", "e"]), (3, ["a", "b"])], "k long, w array<string>")
    items = spark.createDataFrame([(0, ["x", "b"]), (1, ["c"]), (2, ["d"])], "item long, w array<string>")
    left = {r["shard"]: r["windows"] for r in D.residual(docs, items, "k", "w", 4, F.floor(F.col("k") / 3), "item").collect()}
    assert left == {0: 2, 1: 0}  # b <sep> c <sep> and <sep> c <sep> d, each over documents of shard 0 and over items


def test_residual_brings_only_ends_together(spark, monkeypatch):
    g, n, asked = np.random.default_rng(5), 3, []
    docs = [(i, g.choice(["a", "b", "<sep>"], int(k)).tolist()) for i, k in enumerate(g.choice([0, 1, 2, 3, 4, 5, 9, 30], 60))]
    held = [(0, ["a", "b"]), (1, ["b", "a", "a"]), (2, []), (3, ["b"])]
    of = lambda rows: [w for _, t in rows for w in [*t, "<sep>"]]
    windows = lambda t: [tuple(t[i : i + n]) for i in range(len(t) - n + 1)]
    want = {s: sum(w in set(windows(of(held))) for w in windows(of(docs[20 * s : 20 * s + 20]))) for s in range(3)}
    plain = D.token_blocks
    monkeypatch.setattr(D, "token_blocks", lambda df, order, tokens, *a, **k: asked.append(df.agg(F.max(F.size(tokens))).first()[0]) or plain(df, order, tokens, *a, **k))
    d, h = spark.createDataFrame(docs, "k long, t array<string>"), spark.createDataFrame(held, "k long, t array<string>")
    got = D.residual(d, h, "k", "t", n, F.floor(F.col("k") / 20), "k").collect()
    assert {r["shard"]: r["windows"] for r in got} == want and max(asked) <= 2 * n - 1


@pytest.mark.parametrize("size", [7, 50])
def test_windows_cross_blocks(spark, size):
    g = np.random.default_rng(1)
    docs = [(s, i, [f"{s}{i}.{j}" for j in range(int(g.integers(0, 25)))]) for s in "ab" for i in range(30)]
    df = spark.createDataFrame(docs, "s string, k long, w array<string>").repartition(4)
    whole = {s: [t for x, _, w in docs if x == s for t in w] for s in "ab"}
    picks = [(r, s, int(g.integers(0, len(whole[s]) - 20))) for r in range(60) for s in "ab"]
    asked = spark.createDataFrame(picks, "row long, s string, start long")
    blocks = B.token_blocks(df, "k", "w", ["s"], size)
    got = B.batch(B.windows(blocks, asked, 20, ["s"], size)).collect()
    assert len(got) == len(picks) and all(r["x"] == whole[r["s"]][r["start"] : r["start"] + 19] and r["y"] == whole[r["s"]][r["start"] + 1 : r["start"] + 20] for r in got)
    loose = blocks.drop("block").filter("at % 3 <> 1").unionByName(blocks.drop("block").filter("at % 3 = 1"))
    assert {(r["row"], r["s"]): r["tokens"] for r in B.windows(loose, asked, 20, ["s"], size).collect()} == {(r, s): whole[s][at : at + 20] for r, s, at in picks}
    with pytest.raises(Exception, match="outside its stream"):
        B.windows(blocks, spark.createDataFrame([(0, "a", len(whole["a"]) - 5)], "row long, s string, start long"), 20, ["s"], size).collect()


def test_bucketed_blocks_are_not_shuffled(spark, tmp_path):
    df = spark.range(200).select("id", F.array_repeat(F.col("id"), 10).alias("w"))
    blocks = B.save_blocks(B.token_blocks(df, "id", "w", size=64), "bucketed_blocks_test", str(tmp_path / "t"), buckets=4)
    plan = B.windows(blocks.hint("merge"), spark.createDataFrame([(0, 70)], "row long, start long"), 8, size=64)._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("SortMergeJoin") :]
    assert side.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 4 out of 4" in side
    spark.sql("DROP TABLE bucketed_blocks_test")


def test_buckets_grow_with_the_text():
    assert B.buckets_of(0) == 8 and all(n / B.buckets_of(n) <= 16 << 20 for n in (1 << 20, 1 << 28, 10 << 30))


def test_bootstrap_of_any_statistic(spark):
    g = np.random.default_rng(2)
    values = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(g.normal(5, 2, 150), g.uniform(1, 3, 150), strict=True))]
    units = spark.createDataFrame(values, "unit long, a double, b double").repartition(3)
    drawn: dict = {}
    for r in S.resampled(units, 60, 5).collect():
        drawn.setdefault(r["r"], []).append((r["unit"], r["times"]))
    assert len(drawn) == 60 and all(sum(n for _, n in d) == 150 for d in drawn.values())
    x = np.array([v[1:] for v in values])
    resamples = [np.repeat(x[[u for u, _ in d]], [n for _, n in d], axis=0) for d in drawn.values()]
    for statistic, plain in ((lambda k: F.percentile("a", F.lit(0.5), k), lambda d: np.median(d[:, 0])), (S.of_values(lambda d: np.quantile(d, 0.9), "a"), lambda d: np.quantile(d[:, 0], 0.9)), (S.of_values(lambda d: d[:, 0].sum() / d[:, 1].sum(), "a", "b"), lambda d: d[:, 0].sum() / d[:, 1].sum())):
        got = S.bootstrap(units, statistic, 60, 5).first()
        want = [plain(d) for d in resamples]
        assert (got["point"], got["ci_low"], got["ci_high"], got["units"]) == (pytest.approx(plain(x)), pytest.approx(np.percentile(want, 2.5)), pytest.approx(np.percentile(want, 97.5)), 150)


def test_draws_are_dealt_over_tasks(spark, monkeypatch):
    units, counts = spark.range(50).select(F.col("id").alias("unit")).coalesce(1), lambda df: {(r["r"], r["unit"]): r["times"] for r in df.collect()}
    whole = counts(S.resampled(units, 20, 3))
    monkeypatch.setattr(S, "DRAWS", 100)
    dealt = S.resampled(units, 20, 3)
    assert "hashpartitioning(j#" in (plan := dealt._jdf.queryExecution().executedPlan().toString()) and ", 11), REPARTITION_BY_NUM" in plan
    assert counts(dealt) == whole and sum(whole.values()) == 1000


def test_sequence_logprob(spark):
    rows = spark.createDataFrame([("a", 0, 9.0), ("a", 1, 1.5), ("a", 2, 2.0), ("b", 0, 1.0), ("b", 1, 0.25)], "item string, pos long, nll double")
    assert {r["item"]: r["logprob"] for r in S.sequence_logprob(rows, ["item"], "pos", "nll", 3).collect()} == {"a": -3.5, "b": -0.25}
    for bad, n in ((rows, 2), (rows.filter("pos = 0"), 3)):
        with pytest.raises(Exception, match="a sequence of"):
            S.sequence_logprob(bad, ["item"], "pos", "nll", n).collect()


def test_non_finite_losses_stop(spark):
    log = spark.createDataFrame([(1, 2.0), (2, None)], "step long, loss double")
    assert L.finite_only(log).count() == 2 and [r["loss"] for r in L.finite_only(log).orderBy("step").collect()] == [2.0, None]
    for bad in (float("nan"), float("-inf")):
        with pytest.raises(Exception, match="non-finite loss at step 7"):
            L.finite_only(log.unionByName(spark.createDataFrame([(7, bad)], "step long, loss double"))).collect()


@pytest.mark.parametrize(("batch", "limit", "want"), [(2, 4, {"val": 4, "test": 4}), (2, 100, {"val": 10}), (3, 6, {"val": 6, "test": 4})])
def test_sequential_fill(spark, batch, limit, want):
    df = spark.createDataFrame([(i, "d") for i in range(10)], "i long, d string")
    got = C.sequential_fill(df, "i", F.lit(1), "d", limit, batch).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == want


def test_mixture_refuses_short_stream(spark):
    with pytest.raises(Exception, match="shorter than a window"):
        C.mixture(spark.createDataFrame([("a", 5)], "domain string, tokens long"), {"a": 1.0}, 8, 4, 1).collect()


def test_planted_leak(spark):
    d = spark.createDataFrame([(1, list("abcdefgh")), (2, ["x", *"cdefg", "y"]), (3, list("zz"))], "i long, w array<string>")
    held = D.holdout_grams(spark.createDataFrame([(0, list("bcdefgh"))], "k long, w array<string>"), "w", 5)
    flags = {r["i"]: r["dropped"] for r in D.split_contaminated(d, "i", "w", held, 5).collect()}
    assert flags == {1: True, 2: True, 3: False}


def test_sampled_grams_are_the_least_and_written_once(spark):
    g = np.random.default_rng(2)
    rows = [(i % 40, "vt"[i % 2], g.choice(list("abc"), int(k)).tolist()) for i, k in enumerate(g.integers(0, 30, 80))]  # each key twice
    df = spark.createDataFrame(rows, "k long, s string, t array<string>")
    every = grams(df, "t", 3, ["s", "k"]).withColumn("d", draw(9, F.col("s"), F.col("k"), F.col("at"))).collect()
    picked = D.sampled_grams(df, "s", "k", "t", 3, 8, 9)
    assert picked.inputFiles()  # it is read several times
    for s in "vt":
        own = sorted((r["d"], r["k"], r["at"], r["gram"]) for r in every if r["s"] == s)
        got = {r["r"]: r["gram"] for r in picked.filter(F.col("s") == s).collect()}
        assert sorted(got) == list(range(1, 9)) and all(got[i] in {x[3] for x in own if x[:3] == own[i - 1][:3]} for i in got)


def test_control_fails_with_broken_search(spark, monkeypatch):
    s = spark.createDataFrame([(1, "val", [str(i) for i in range(40)])], "i long, split string, w array<string>")
    train = spark.createDataFrame([(2, "train", [str(i) for i in range(100, 140)])], "i long, split string, w array<string>")
    ok = D.leak_report(s, train, "split", "i", "w", 8, 16, 1).first()
    assert ok["samples"] == 16 and ok["leaks"] == 0 and ok["control"] and ok["passed"]
    leaked = D.leak_report(s, s.withColumn("split", F.lit("train")), "split", "i", "w", 8, 16, 1).first()
    assert leaked["leaks"] == 16 and not leaked["passed"]


def test_weighted_perplexity(spark):
    df = spark.createDataFrame([("d", 1.0, 100), ("d", 3.0, 300)], "d string, mean_nll double, n long")
    assert S.perplexity(df, ["d"]).first()["perplexity"] == pytest.approx(math.exp(2.5))


def test_bootstrap(spark):
    g = np.random.default_rng(0)
    x = g.normal(5, 2, 400)
    units = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "unit long, v double")
    stat = lambda k: F.sum(F.col("v") * k) / F.sum(k + F.lit(0))
    a = S.bootstrap(units, stat, 200, 7).first()
    assert a["point"] == pytest.approx(x.mean()) and a["ci_low"] < 5 < a["ci_high"]
    assert a["ci_high"] - a["ci_low"] == pytest.approx(2 * 1.96 * x.std(ddof=1) / 20, rel=0.25)
    assert S.bootstrap(units, stat, 200, 7).first() == a != S.bootstrap(units, stat, 200, 8).first()
    with pytest.raises(ValueError, match="alpha"):
        S.bootstrap(units, stat, 10, 1, alpha=1.5)


def path(spark, scores, losses=None):
    rows = [("r", t, float(s), None if losses is None else float(losses[i])) for i, (t, s) in enumerate(scores)]
    return spark.createDataFrame(rows, "run string, tokens long, score double, loss double")


@pytest.mark.parametrize(
    ("scores", "want"),
    [
        ([(1, 0.01), (2, 0.02), (4, 0.05), (8, 0.45), (16, 0.6)], (True, 4, 8, 0)),
        ([(1, 0.05), (2, 0.4), (4, 0.05), (8, 0.9)], (True, 1, 2, 0)),
        ([(1, 0.01), (2, 0.05), (4, 0.2)], (False, None, None, None)),
        ([(1, 0.15), (2, 0.5)], (False, None, 2, None)),
        ([(1, 0.9)], (False, None, None, None)),
        ([(1, 0.05), (2, 0.11), (3, 0.12), (4, 0.13), (5, 0.9)], (True, 1, 5, 3)),
    ],
)
def test_phase_change(spark, scores, want):
    r = T.phase_change(path(spark, scores), "run", "score").first()
    assert (r["crossed"], r["start_tokens"], r["end_tokens"], r["inside"]) == want


GRID = [10**k for k in range(1, 11)]


@pytest.mark.parametrize(
    ("scores", "losses", "gap", "share", "verdict"),
    [
        ([0.01, 0.02, 0.03, 0.05, 0.2] + [0.9] * 5, [11, 10.9, 10.8, 10.7, 10.65, 10.6, 8, 5, 2, 1], 2, 0.01, "ABRUPT"),
        ([0.01, 0.02, 0.03, 0.05] + [0.9] * 6, [11, 10.9, 10.8, 10.7, 7.5, 5, 3, 2, 1.5, 1], 1, 0.32, "GRADUAL"),
        ([0.01, 0.02, 0.05, 0.11, 0.12, 0.13, 0.14, 0.9, 0.9, 0.9], [11, 10.9, 10.8, 10.7, 10, 9, 8.9, 8.8, 5, 1], 5, 0.2, "INDETERMINATE"),
        ([0.01] * 10, [1.0] * 10, None, None, "NO CROSSING"),
        ([0.01, 0.02, 0.03, 0.05, 0.2] + [0.9] * 5, [1.0] * 9 + [1.5], 2, None, "INDETERMINATE"),
    ],
)
def test_abruptness(spark, scores, losses, gap, share, verdict):
    r = T.abruptness(path(spark, list(zip(GRID, scores, strict=True)), losses), "run", "score", "loss").first()
    assert r["gap"] == gap and r["verdict"] == verdict
    assert r["share"] == (None if share is None else pytest.approx(share, abs=1e-9))


@pytest.mark.parametrize(("width", "found"), [(1, 0), (2, 1), (3, 1), (4, 0), (6, 0)])
def test_loss_bump(spark, width, found):
    rows = []
    for k in range(34):
        t = int(1e6 * 1.28**k)
        rows.append(("r", t, math.exp(3.0511 - 0.08 * math.log(t)) + (0.3 if 8 <= k < 8 + width else 0)))
    assert T.loss_bumps(spark.createDataFrame(rows, "run string, tokens long, loss double"), "run", "loss").count() == found


def test_head_churn(spark):
    sets = [("r", 1, []), ("r", 2, [12]), ("r", 3, [12, 34]), ("r", 4, [34, 56])]
    rows = T.head_churn(spark.createDataFrame(sets, "run string, tokens long, heads array<int>"), "run", "heads").orderBy("tokens").collect()
    assert [(len(r["entered"]), len(r["left"])) for r in rows] == [(1, 0), (1, 0), (1, 1)]


@pytest.mark.parametrize(("values", "want"), [([0.01, 0.05, 0.9, 0.95], (3, 3, 3, 0.0, True)), ([0.01] * 4, (None, None, None, 1.0, False))])
def test_crossing_bootstrap(spark, values, want):
    rows = [(i + 1, s, 0, v) for i, v in enumerate(values) for s in range(8)]
    r = T.crossing_bootstrap(spark.createDataFrame(rows, "pos long, seq long, head long, value double"), 0.3, 100, 1).first()
    assert (r["median"], r["low"], r["high"], r["never_share"], r["reported"]) == want


def test_crossing_bootstrap_mixed(spark):
    rows = [(p, s, 0, 1.0 if p >= 3 or (p == 2 and s < 3) else 0.0) for p in (1, 2, 3, 4) for s in range(8)]
    r = T.crossing_bootstrap(spark.createDataFrame(rows, "pos long, seq long, head long, value double"), 0.3, 400, 1).first()
    assert (r["low"], r["high"]) == (2, 3)


def test_same_grid(spark):
    a, b = (spark.createDataFrame([(i,) for i in x], "t long") for x in ([1, 2, 3], [2, 3, 4]))
    assert T.same_grid(a, b, ["t"]).first()["odd"] == 2


def test_checkpoint_steps(spark):
    t = spark.createDataFrame([(x,) for x in (1_000_000, 2_000_000, 10**12, -5)], "target long")
    assert sorted(map(tuple, T.checkpoint_steps(t, 16384, 30517).collect())) == [(61, 1_000_000), (122, 2_000_000), (30517, 30518 * 16384)]
    t = spark.createDataFrame([(x,) for x in (100, 9_950, 10_000, 10_001)], "target long")  # the final step has all tokens
    assert sorted(map(tuple, T.checkpoint_steps(t, 100, 99).collect())) == [(0, 100), (99, 10_000)]


def test_early_gate(spark):
    rising = [("a", s, float(s)) for s in range(9)]  # nine early records say nothing yet
    late = [("b", s, 9.0 - s) for s in range(12)] + [("b", 120, None)]
    up = [("c", s, float(s)) for s in range(12)] + [("c", 100, 1.0)]
    few = [("d", s, float(s)) for s in range(7)] + [("d", 200, 1.0)]
    bad = [("e", 3, float("nan")), ("e", 4, 1.0)]
    twice = [("f", 0, 1.0)] * 8 + [("f", 1, 5.0)] * 4 + [("f", 150, 0.0)]  # repeated steps count as they are
    df = spark.createDataFrame(rising + late + up + few + bad + twice + [("g", 300, float("inf"))], "run string, step long, loss double")
    got = {r["run"]: r["verdict"] for r in L.early_gate(df, "run", "step", "loss", 100).collect()}
    assert got == {"a": "open", "b": "passed", "c": "diverged", "d": "open", "e": "diverged", "f": "diverged", "g": "open"}


def test_refused_bumps(spark):
    for rows in ([("r", 10, 6.0), ("r", 20, 5.0)], [("r", 10 * k, 0.0 if k == 3 else 5.0) for k in range(1, 6)]):
        with pytest.raises(Exception, match="at least 3|non-positive"):
            T.loss_bumps(spark.createDataFrame(rows, "run string, tokens long, loss double"), "run", "loss").collect()


def test_scorecard_reads_the_crossing_head_and_all_of_the_control(spark):
    kind = "run string, tokens long, target long, score double, prev double, icl double, clears boolean, best int, ov array<double>, heads int, control double, control_heads int, control_clears boolean"

    def verdicts(ov, heads=0, clears=False, control=0.01):
        scores, tokens = [0.01, 0.05, 0.2, 0.9, 0.9], [10**k for k in range(1, 6)]
        rows = [("r", t, t, s, 0.5, -s, s > 0.5, 1, o, 2, control, heads, clears) for t, s, o in zip(tokens, scores, ov, strict=True)]
        return {r["id"]: r["verdict"] for r in T.scorecard(spark.createDataFrame(rows, kind), "run").collect()}

    other = [[0.9, 0.1]] * 5  # only a head that is not the best one copies
    assert verdicts(other)["P7"] == "failed" and verdicts([[0.0, 0.1]] * 2 + [[0.0, 0.8]] + [[0.0, 0.1]] * 2)["P7"] == "held"
    assert verdicts([[0.0, 0.9]] * 2 + [[0.0, 0.1]] * 3)["P7"] == "failed"  # too early does not count
    assert [verdicts(other, *x)["P8"] for x in ((0, False), (1, False), (0, True), (0, False, 0.06), (None, None, None))] == ["held", "failed", "failed", "failed", "not scored"]


def test_decay_goes_by_exact_names(spark):
    names = ["embed.weight", "lm_head.weight", "layers.0.attn_norm.weight", "pos_embed.weight", "lm_head.bias", "norm.weight"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(A.decayed(F.col("n")).alias("d")).collect()
    assert [r["d"] for r in got] == [False, False, False, True, True, True]


def curve(spark, end=0.005, mid=0.005):
    return spark.createDataFrame([(s, 2.5 - 0.001 * s + (end if s == 499 else mid)) for s in range(409, 500, 10)], "step long, loss double")


@pytest.mark.parametrize(("end", "mid", "ok"), [(0.005, 0.005, True), (0.05, 0.005, False), (0.01, 0.03, False)])
def test_curve_gate(spark, end, mid, ok):
    r = L.gate(L.curve_delta(curve(spark, 0, 0), curve(spark, end, mid), "step", "loss", 400, 500)).first()
    assert r["passed"] == ok and r["end_step"] == 499 and r["end_delta"] == pytest.approx(end)


def test_last_wins(spark):
    log = spark.createDataFrame([(1, 429, 9.9), (2, 429, 2.0), (3, 439, None)], "seq long, step long, loss double")
    assert [tuple(r) for r in L.last_wins(log, ["step"], "seq", "loss").collect()] == [(429, 2.0)]


def test_resume_verdict(spark):
    good = dict(exists=True, loads=True, run_name="s", framework="torch", seed=1, step=9, tokens=1000, newest=900)
    cases = [good, good | {"run_name": "x"}, good | {"seed": 2}, good | {"tokens": 999}, good | {"loads": False}, good | {"step": None}, good | {"newest": 2000}, good | {"exists": False}, good | {"exists": False, "newest": None}]
    df = spark.createDataFrame(cases, "exists boolean, loads boolean, run_name string, framework string, seed long, step long, tokens long, newest long")
    assert [r["exit_code"] for r in L.resume_verdict(df, "s", "torch", 1, 100).collect()] == [0, 20, 20, 20, 20, 20, 20, 20, 10]


def test_pairs_are_strict(spark):
    p = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0)], "p string, good double, bad double")
    assert A.pair_accuracy(p, ["p"]).first()["accuracy"] == 0.5


def test_unpaired_units_are_refused(spark):
    a, b = (spark.createDataFrame([(i, 1.0) for i in x], "u long, v double") for x in ([1, 2], [1]))
    with pytest.raises(Exception, match="partner"):
        A.paired_deltas(a, b, ["u"], "v").collect()


def test_decoder_is_causal():
    m = K.random_model(20, 16, 2, 2, 0)
    ids = np.arange(10)
    a, maps, _ = K.forward(m, ids)
    b = K.forward(m, np.concatenate([ids[:5], [19] * 5]))[0]
    assert np.allclose(a[:5], b[:5]) and np.allclose(maps.sum(-1), 1) and not np.allclose(a[5:], b[5:])
    same = K.forward(m, ids, lambda i, o: o)[0]
    assert np.array_equal(a, same)


def test_sequences_run_together_as_alone(spark, monkeypatch):
    monkeypatch.setattr(K, "TOKENS", 40)
    m, g = K.random_model(20, 16, 2, 2, 0), np.random.default_rng(1)
    ids = g.integers(1, 20, (9, 8))
    z, maps, outs = K.forward(m, ids)
    for i in range(9):
        a, b, c = K.forward(m, ids[i])
        assert np.allclose(z[i], a, atol=1e-12) and np.allclose(maps[:, i], b) and all(np.allclose(x[i], y) for x, y in zip(outs, c, strict=True))
    rows = [(i, x) for i, x in enumerate(ids.tolist())] + [(9, [1, 2, 1, 2])]
    df = spark.createDataFrame(rows, "seq long, ids array<int>")
    want = {(r["seq"], r["layer"], r["head"]): r for r in A.pair_means(K.attention_rows(df, m), 4).collect()}
    got = {(r["seq"], r["layer"], r["head"]): r for r in K.attention_means(df, m, 4).collect()}
    assert len(got) == 40 and got.keys() == want.keys()
    for at, r in got.items():
        assert all((r[n] is None) == (want[at][n] is None) and (r[n] is None or r[n] == pytest.approx(want[at][n], abs=1e-12)) for n in A.PATTERNS)
    losses = {(r["seq"], r["pos"]): r["nll"] for r in K.token_losses(df, m).collect()}
    a = K.forward(m, ids[3])[0]
    assert len(losses) == 9 * 7 + 3 and losses[3, 2] == pytest.approx(np.log(np.exp(a[2]).sum()) - a[2][ids[3][3]])


def test_patching_every_head_of_one_layer_model(spark):
    m = K.random_model(20, 16, 1, 1, 0)
    clean, other = [1, 2, 3, 4, 1, 2, 3, 4], [5, 6, 7, 8, 1, 2, 3, 4]
    df = spark.createDataFrame([(0, clean, other)], "seq long, clean array<int>, corrupt array<int>")
    r = K.patched_rows(df, m, [(0, 0)], 4).first()
    assert r["patched"] == pytest.approx(r["clean"], rel=1e-6)


def test_ov_score_by_full_matrix():
    m = K.random_model(12, 8, 2, 1, 3)
    w, s = m.layers[0], slice(0, 4)
    full = m.embed @ np.diag(w["n1"]) @ w["v"][:, s] @ w["o"][s] @ np.diag(m.norm) @ m.embed.T
    e = np.linalg.eigvals(full)
    assert K.ov_copying(m)[0][2] == pytest.approx(e.real.sum() / np.abs(e).sum(), rel=1e-6)


def test_widths():
    assert A.mlp_width(512) == 1408 and A.parameter_count(16384, 512, 1) == 16384 * 512 + 4 * 512**2 + 3 * 512 * 1408 + 3 * 512


def test_polynomial_hash_repeats(spark):
    df = spark.createDataFrame([(1, [5, 6, 7, 8, 99, 5, 6, 7, 8]), (2, [1, 2, 3])], "k long, ids array<int>")
    h = {r["at"]: int(r["h"]) for r in E.polynomial_hashes(df, "k", "ids", 4).collect()}
    assert len(h) == 6 and h[0] == h[5] != h[1] and h[0] == sum((t + 1) * E.BASE**j for j, t in enumerate([5, 6, 7, 8])) % 2**64


def test_find_result():
    assert E.find_result({"a": [{"domain": "x"}, {"b": {"domain": "x", "perplexity": 3.0}}]}, "x") == 3.0 and E.find_result([], "x") is None


def test_kneser_ney_equals_brute_force(spark):
    g = np.random.default_rng(0)
    text, order, d = list(g.choice(list("abcd"), 120)), 3, 0.75
    grams_of = lambda k: [tuple(text[i - k : i]) for i in range(order, len(text) + 1)]
    tables = {}
    for k in range(1, order + 1):
        c: dict = {}
        for w in grams_of(k) if k == order else {x for x in grams_of(k + 1)}:
            w = w[-k:]
            c[w] = c.get(w, 0) + 1
        tables[k] = c

    def p(w, k):
        if not k:
            return 1 / (len({x[-1] for x in grams_of(order)}) + 1)
        same = {x: c for x, c in tables[k].items() if x[:-1] == w[-k:][:-1]}
        low = p(w, k - 1)
        return low if not same else max(tables[k].get(w[-k:], 0) - d, 0) / sum(same.values()) + d * len(same) / sum(same.values()) * low

    rows = [(list(x),) for x in grams_of(order)]
    asked = [tuple(x) for x in ("abc", "aaz", "zzz", "bca", "zab")]
    got = E.kneser_ney(spark.createDataFrame(rows, "w array<string>"), spark.createDataFrame([(list(x),) for x in asked], "w array<string>"), order, d)
    assert {tuple(r["w"]): r["nll"] for r in got.collect()} == {x: pytest.approx(-math.log(p(x, order))) for x in asked}
    assert sum(p(("a", "b", x), order) for x in "abcd") < 1


def test_kneser_ney_reads_its_train_rows_twice_at_most(spark, monkeypatch):
    """Once for the words and once for the grams; and words that a hash would put together stay apart."""
    number, read = E.word_id, spark.sparkContext.accumulator(0)
    monkeypatch.setattr(E, "word_id", lambda word, salt: number(word, salt) if salt > 1 else F.pmod(number(word, salt), F.lit(2)))
    seen = F.udf(lambda w: read.add(1) or w, "array<string>").asNondeterministic()
    rows = spark.createDataFrame([(list("abc"),), (list("bca"),), (list("cab"),)], "w array<string>").select(seen("w").alias("w"))
    got = E.kneser_ney(rows, spark.createDataFrame([(list("abc"),), (list("abz"),)], "w array<string>"), 3)
    p1 = (1 - 0.75) / 3 + 0.75 / 4, 0.75 / 4  # each word is seen after one other
    p3 = [0.25 + 0.75 * (0.25 + 0.75 * p1[0]), 0.75 * 0.75 * p1[1]]
    assert {"".join(r["w"]): r["nll"] for r in got.collect()} == {x: pytest.approx(-math.log(p)) for x, p in zip(("abc", "abz"), p3, strict=True)}
    assert read.value <= 6


def test_scan_reads_only_its_columns(spark):
    import os

    from corpusloom import registry

    sf = "/root/testdata/sf0.001"
    if os.path.isdir(sf):
        plan = registry.QUERIES["vocab_domains"](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema: struct<text:string,lang:string>" in plan and "Python" not in plan
