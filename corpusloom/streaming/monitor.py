"""Live-log monitors: files of JSON lines as a stream; torn lines are ignored."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.versioned import get, put

KIND = "run string, step long, tokens long, loss double"


def log_stream(spark: SparkSession, folder: str, files_at_once: int | None = None) -> DataFrame:
    """Records of a growing folder of logs; numbers that JSON writes as NaN or Infinity are read as such."""
    reader = spark.readStream if files_at_once is None else spark.readStream.option("maxFilesPerTrigger", str(files_at_once))
    return reader.text(folder).select(F.from_json("value", KIND, {"allowNonNumericNumbers": "true"}).alias("r")).select("r.*").filter(F.col("step").isNotNull() & F.col("loss").isNotNull())


def running_totals(log: DataFrame) -> DataFrame:
    """Per run the records so far, the newest step and the mean loss."""
    return log.groupBy("run").agg(F.count("*").alias("n"), F.max("step").alias("last"), F.avg("loss").alias("mean_loss"))


class EarlyGate(StatefulProcessor):
    """State of a run: its k least and k greatest records before the window by (step, loss), how far it is, and its verdict.

    What is kept is bounded by k, however long the log is. A decided run keeps its verdict only; later records are ignored.
    """

    def __init__(self, window: int, k: int = 8):
        self.window, self.k = window, k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.early = handle.getValueState("early", "n long, far long, bad boolean, head_step array<long>, head_loss array<double>, tail_step array<long>, tail_loss array<double>")
        self.verdict = handle.getValueState("verdict", "verdict string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.verdict.exists():
            return
        n, far, bad, *ends = self.early.get() if self.early.exists() else (0, -1, False, [], [], [], [])
        head, tail = [list(zip(*ends[i : i + 2], strict=True)) for i in (0, 2)]
        for pdf in rows:
            far = max(far, int(pdf["step"].max()))
            own = pdf[(pdf["step"] < self.window) & pdf["early"]]
            new = list(zip(own["step"].astype(int).tolist(), own["loss"].astype(float).tolist(), strict=True))
            bad = bad or not all(map(math.isfinite, (x for _, x in new)))
            n, head, tail = n + len(new), sorted(head + new)[: self.k], sorted(tail + new)[-self.k :]
        said = None
        if bad:
            said = ("diverged", None, None)
        elif far >= self.window and n >= self.k:
            first, last = (sum(x for _, x in part) / self.k for part in (head, tail))
            said = ("diverged" if last > first else "passed", first, last)
        if said is None:
            self.early.update((n, far, bad, *([x[i] for x in part] for part in (head, tail) for i in (0, 1))))
            return
        self.verdict.update((said[0],))
        self.early.clear()
        yield pd.DataFrame({"run": [key[0]], "verdict": [said[0]], "head": [said[1]], "tail": [said[2]], "far": [far]})

    def close(self) -> None:
        pass


def verdicts(log: DataFrame, window: int, k: int = 8) -> DataFrame:
    """A stream of (run, verdict, head, tail, far): each run once, when it diverges or passes.

    A non-finite loss is divergence at once; otherwise nothing is said until the run has reached the window with k losses. A
    record without a loss tells only how far its run is. State is kept by run in Spark's store under the sink's checkpoint,
    so a stream that was killed goes on where it was, and with a sink that commits each batch once, a run is told once.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own = log.filter(F.col("run").isNotNull() & F.col("step").isNotNull()).select("run", "step", "loss", F.col("loss").isNotNull().alias("early"))
    return own.groupBy("run").transformWithStateInPandas(EarlyGate(window, k), "run string, verdict string, head double, tail double, far long", "append", "None")


def stability_monitor(log: DataFrame, window: int, path: str, checkpoint: str, once: bool = True, k: int = 8):
    """The verdicts appended to a table at ``path``, exactly once each, over restarts."""
    writer = verdicts(log, window, k).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="60 seconds")).start()


def halved_once(spark: SparkSession, folder: str, run: str, rate: float) -> tuple[float | None, int]:
    """The rate of the fresh run after a divergence and the exit code: a marker in ``folder`` allows one halving; a second
    divergence is a hard failure. The marker is put without replacing, so of two callers one halves."""
    try:
        put(spark, f"{folder}/{run}_lr_halved.json", json.dumps({"original_lr": rate, "halved_lr": rate / 2}), replace=False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        return None, 20
    return rate / 2, 0


def rate_of(spark: SparkSession, folder: str, run: str, rate: float) -> float:
    """The rate to start or resume with: the halved one where a marker is."""
    found = get(spark, f"{folder}/{run}_lr_halved.json")
    return json.loads(found)["halved_lr"] if found else rate


def probe_curve(points: DataFrame, path: str, checkpoint: str):
    """A stream of readings appended as JSON lines, exactly once by the checkpoint."""
    line = F.to_json(F.struct(*points.columns), {"ignoreNullFields": "false"})
    return points.select(line.alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
