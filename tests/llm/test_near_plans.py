"""What the rounds of near-duplicates leave in the driver."""

from pyspark.sql import functions as F

from corpusloom.llm import minhash_icws
from corpusloom.llm.common import Scratch


def test_rounds_build_no_tables_in_the_driver(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    words = lambda d: [f"w{d % 40}x{i}" for i in range(60)]
    docs = spark.createDataFrame([(d, " ".join([*words(d), *[f"e{d}y{i}" for i in range(d % 3)]])) for d in range(200)], "doc_id long, text string")
    rows, found = minhash_icws.near_duplicates(docs, Scratch(spark, "plans"))
    assert found.count() == 200 and found.filter("kept").count() == 40
    every = store.executionsList()
    plans = [every.apply(i).physicalPlanDescription() for i in range(before, every.size())]
    assert len(plans) > 10 and sum("SortMergeJoin" in p for p in plans) > 5
    assert not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]


def test_written_tables_are_one_scan(spark):
    scratch = Scratch(spark, "one-scan")
    for k in range(3):
        scratch.cut(spark.range(k, k + 2).select(F.col("id")), f"t{k}")
    every = scratch.all_of([f"t{k}" for k in range(3)], "id long")
    assert sorted(r["id"] for r in every.collect()) == [0, 1, 1, 2, 2, 3] and every._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
