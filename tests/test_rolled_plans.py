"""How often rolled shards read the texts."""

from pyspark.sql import functions as F

from corpusloom.sources import readers as R
from corpusloom.sources import writers as W


def test_rolled_shards_read_texts_twice(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    docs = spark.createDataFrame([(i, None if i == 7 else "é" * (i % 13)) for i in range(60)], "doc_id long, text string").withColumn("text", F.udf(seen, "string")("text"))
    path = str(tmp_path / "shards")
    shards = W.rolled_jsonl(docs, "doc_id", path, 200, batch=4)
    assert read.value == 120  # for the sizes and for the files
    rows = shards.orderBy("shard").collect()
    back = R.jsonl_folder(spark, path).groupBy("shard_no").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).orderBy("shard_no").collect()
    assert [(r["documents"], r["chars"]) for r in rows] == [(r["n"], r["chars"]) for r in back] and sum(r["documents"] for r in rows) == 60
    assert [r["bytes_jsonl"] for r in rows] == [(tmp_path / "shards" / r["file"]).stat().st_size for r in rows]
