"""The n-gram model's counts: values, and what its plan joins."""

import math

from pyspark.sql import functions as F

from corpusloom.operators import scoring as S


def test_counts_of_both_streams_come_from_one_grouping(spark):
    docs = spark.createDataFrame([("x", ["a", "b", "a"]), ("x", []), ("y", ["b", "c"])], "lang string, tokens array<string>")
    train = S.token_pairs(docs, "tokens", "lang")
    got = sorted((r["lang"], r["prev"], r["tok"]) for r in train.collect())
    assert got == sorted([("x", "<sep>", "a"), ("x", "a", "b"), ("x", "b", "a"), ("x", "a", "<sep>"), ("x", "<sep>", "<sep>"), ("y", "<sep>", "b"), ("y", "b", "c"), ("y", "c", "<sep>")])
    targets = spark.createDataFrame([(0, "a", "b"), (1, "a", "b"), (2, "a", "c"), (3, "new", "a"), (4, "new", "new")], "i int, prev string, tok string")
    scored = S.ngram_nll(targets, train)
    n, v, c1, c0 = 8, 4, {"a": 2, "b": 2, "c": 1, "<sep>": 3}, {"a": 2}
    for r in scored.collect():
        p2 = {("a", "b"): 1}.get((r["prev"], r["tok"]), 0) / c0.get(r["prev"], 1)
        assert math.isclose(r["nll"], -math.log(0.5 * (c1.get(r["tok"], 0) + 1) / (n + v + 1) + 0.5 * p2), rel_tol=1e-12)
    assert scored.count() == 5 and sorted(r["i"] for r in scored.select("i").collect()) == [0, 1, 2, 3, 4]
    # no join with the pairs of the train stream: the targets, the two counts of words and one row of totals are joined
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 4, plan
    assert train.agg(F.count("*")).first()[0] == n
