"""The stability monitor: restarts, late files, non-finite losses, against the batch gate over the whole log."""

import json

import pytest

from corpusloom.operators.logs import early_gate
from corpusloom.streaming import monitor as M

KIND = "run string, step long, tokens long, loss double"


def put(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps({"run": r, "step": s, "tokens": s, "loss": x}) for r, s, x in rows) + '\n{"run": "a", "st\n')


def told(spark, path):
    return sorted((r["run"], r["verdict"]) for r in spark.read.parquet(path).collect())


def test_each_verdict_once_over_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    parts = [
        [("up", s, 1.0 + s / 10) for s in range(9)] + [("down", s, 5.0 - s / 10) for s in range(0, 9)] + [("bad", 3, float("nan"))],
        [("up", s, 1.0 + s / 10) for s in range(9, 15)] + [("down", s, 5.0 - s / 10) for s in range(9, 15)] + [("bad", 4, 1.0), ("short", 40, 1.0)],
        [("up", 15, 9.0), ("down", 30, 9.0), ("short", 2, 1.0)],
        [("up", 16, 0.0), ("down", 3, 99.0), ("down", 31, 9.0), ("bad", 90, 1.0), ("short", 41, 2.0)],
    ]
    every, seen = [], []
    for i, part in enumerate(parts):
        put(tmp_path / "in", f"{i}.jsonl", part)
        every += part
        M.stability_monitor(M.log_stream(spark, str(tmp_path / "in")), 15, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)  # each a new stream
        seen.append(told(spark, str(tmp_path / "out")))
        gate = early_gate(spark.createDataFrame(every, "run string, step long, loss double"), "run", "step", "loss", 15)
        if i < 3:  # a decided run is released: what comes later changes no verdict
            assert seen[-1] == sorted((r["run"], r["verdict"]) for r in gate.filter("verdict <> 'open'").collect())
    assert seen == [[("bad", "diverged")], [("bad", "diverged")], *[[("bad", "diverged"), ("down", "passed"), ("up", "diverged")]] * 2]
    row = spark.read.parquet(str(tmp_path / "out")).filter("run = 'up'").first()
    assert row["head"] == pytest.approx(sum(1 + s / 10 for s in range(8)) / 8) and row["tail"] == pytest.approx(sum(1 + s / 10 for s in range(7, 15)) / 8) and row["far"] == 15


def test_a_killed_stream_goes_on(spark, tmp_path):
    """Killed between batches: what was read is not read again, what was told is not told again."""
    (tmp_path / "in").mkdir()
    for i in range(6):
        put(tmp_path / "in", f"{i}.jsonl", [(f"r{k}", s, 4.0 - s / 100 * (k % 2)) for k in range(4) for s in range(4 * i, 4 * i + 4)])
    log = lambda: M.log_stream(spark, str(tmp_path / "in"), files_at_once=1)
    q = M.verdicts(log(), 12).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    while not q.recentProgress:
        q.awaitTermination(1)
    q.stop()
    done = q.lastProgress["batchId"]
    M.stability_monitor(log(), 12, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(180)
    assert done < 5 and told(spark, str(tmp_path / "out")) == [("r0", "passed"), ("r1", "passed"), ("r2", "passed"), ("r3", "passed")]


def test_one_halving(spark, tmp_path):
    folder = str(tmp_path)
    assert M.rate_of(spark, folder, "main", 0.4) == 0.4
    assert M.halved_once(spark, folder, "main", 0.4) == (0.2, 0) and M.halved_once(spark, folder, "main", 0.2) == (None, 20)
    assert M.rate_of(spark, folder, "main", 0.4) == 0.2 and M.rate_of(spark, folder, "other", 0.4) == 0.4
