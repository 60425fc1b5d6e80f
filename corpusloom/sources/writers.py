"""Sinks: rolled shards, 16-bit token files, sidecars, JSON results, reports."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.corpus import json_line_bytes, next_fit, running
from .scratch import Scratch, delete
from .tables import bounded
from .token_source import manifest, write_token_files
from .versioned import get, put


def named_files(lines: DataFrame, path: str, order: str) -> None:
    """text files by their names: ``lines`` has file, value and ``order``; a file is sorted and written by one task.

    Files are written aside and renamed when all are there, so a folder holds whole files only.
    """
    spark = lines.sparkSession
    aside = f"{path}/_aside-{uuid.uuid4().hex}"
    lines.select("file", "value", order).repartition("file").sortWithinPartitions("file", order).select("file", "value").write.partitionBy("file").text(aside)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.listFiles(hadoop.Path(aside), True)
    while files.hasNext():
        at = files.next().getPath()
        if at.getName().startswith("part-") and not fs.rename(at, hadoop.Path(path, unquote(at.getParent().getName().removeprefix("file=")))):
            raise OSError(f"{at} could not be renamed")
    fs.delete(hadoop.Path(aside), True)


def rolled_jsonl(docs: DataFrame, order: str, path: str, cap: int, batch: int = 1000, provenance: dict | None = None) -> DataFrame:
    """``shard_%05d.jsonl`` files of at most ``cap`` bytes each where a batch allows; returns a row per shard.

    Documents are numbered by ``order``; whole batches of it are rolled. ``manifest.json`` is put last and makes the folder
    complete: a complete one is refused, what an interrupted run left is cleared first (K12, K15).
    """
    spark = docs.sparkSession
    if get(spark, f"{path}/manifest.json"):
        raise FileExistsError(f"{path} already exists and is complete")
    delete(spark, path)
    scratch = Scratch(spark, "rolled")
    own = docs.select(order, "text").withColumn("_batch", F.floor(F.col(order) / batch))
    each = own.groupBy("_batch").agg(F.sum(json_line_bytes(F.col("text"))).alias("_size"), F.count("*").alias("_documents"), F.sum(F.length("text")).alias("_chars"))
    each = scratch.cut(each, "batches")  # texts are read for it once, and once more to be written
    shard = scratch.cut(next_fit(each.select("_batch", "_size"), "_batch", "_size", cap), "shards").withColumn("file", F.format_string("shard_%05d.jsonl", "shard"))
    placed = own.join(bounded(shard), "_batch")
    named_files(placed.select("file", F.to_json(F.struct("text")).alias("value"), order), path, order)
    per = each.join(shard, "_batch").groupBy("shard", "file").agg(F.sum("_documents").alias("documents"), F.sum("_size").alias("bytes_jsonl"), F.sum("_chars").alias("chars"))
    shards = [r.asDict() for r in per.orderBy("shard").collect()]  # a row per shard, as the manifest lists them
    told = {k: sum(s[k] or 0 for s in shards) for k in ("documents", "bytes_jsonl", "chars")}
    put(spark, f"{path}/manifest.json", json.dumps(told | {"shards": [s["file"] for s in shards], "provenance": provenance or {}}, indent=1))
    return spark.createDataFrame([(s["shard"], s["file"], s["documents"], s["bytes_jsonl"], s["chars"]) for s in shards], "shard long, file string, documents long, bytes_jsonl long, chars long")


def token_files(docs: DataFrame, order: str, ids: str, separator: int, path: str, cap: int, by: str | None = None, batch: int = 200, skip_empty: bool = True) -> list[dict]:
    """16-bit files ``<by>_train_ext_%03d.bin`` with a separator after each document, rolled by whole batches;
    gives the manifest's entries. Positions in a file are running sums, so a file is put together without sorting a corpus."""
    name = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("corpus")
    own = docs.select(name.alias("_name"), F.col(order).alias("_o"), F.concat(ids, F.array(F.lit(separator))).alias("_ids")).withColumn("_batch", F.floor(F.col("_o") / batch))
    own = Scratch(docs.sparkSession, "token-files").cut(own, "ids")  # texts are encoded once
    sizes = own.groupBy("_name", "_batch").agg(F.sum(F.size("_ids")).alias("_size"))
    placed = own.join(next_fit(sizes, "_batch", "_size", cap, ["_name"], skip_empty=skip_empty), ["_name", "_batch"])
    placed = running(placed, "_o", F.size("_ids"), "_at", ["_name", "shard"])
    write_token_files(placed.select(F.format_string("%s_train_ext_%03d.bin", "_name", "shard").alias("file"), F.col("_at").alias("start"), F.col("_ids").alias("tokens")), path)
    return manifest(path)["files"]


def sidecar(readings: DataFrame, path: str, tokens: str = "tokens") -> None:
    """Readings by checkpoint: ``tokens_%012d``, or ``random_init`` without tokens."""
    key = F.when(F.col(tokens).isNull(), "random_init").otherwise(F.format_string("tokens_%012d", F.col(tokens)))
    readings.withColumn("ckpt", key).write.partitionBy("ckpt").mode("errorifexists").parquet(path)


def finite(value: Column) -> Column:
    """K6: null for what JSON has no number for."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def json_rows(rows: DataFrame) -> DataFrame:
    """K6: each row as JSON; non-finite numbers are null."""
    cols = [finite(F.col(n)).alias(n) if t in ("double", "float") else F.col(n) for n, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def append_log(rows: DataFrame, path: str) -> None:
    """One JSON record a row, appended; files appear whole, by the committer's rename (K8)."""
    json_rows(rows).write.mode("append").text(path)


def guarded(rows: DataFrame, path: str) -> None:
    """Refuses a path that exists."""
    rows.write.mode("errorifexists").parquet(path)


def restarted(rows: DataFrame, path: str) -> None:
    """Replaces what an interrupted run left."""
    rows.write.mode("overwrite").parquet(path)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a written table is whole: the committer's marker is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def portable(path: Column, root: str, name: str) -> Column:
    """A path with its root replaced by a variable's name."""
    root = root.rstrip("/")
    inside = (path == root) | path.startswith(f"{root}/")
    return F.when(inside, F.concat(F.lit("$" + name), F.substr(path, F.lit(len(root) + 1)))).otherwise(path)


def report(totals: DataFrame, title: str) -> str:
    """A Markdown table of a small aggregate; dashes other than the hyphen are refused."""
    rows = totals.collect()
    head = totals.columns
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "| " + " | ".join("---" for _ in head) + " |"]
    lines += ["| " + " | ".join(shown(v) for v in r) + " |" for r in rows]
    text = "\n".join(lines) + "\n"
    if "–" in text or "—" in text:
        raise ValueError("the report holds an en or em dash")
    return text


def shown(v: object) -> str:
    """whole numbers with separators, others to six digits."""
    return "" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else f"{v:.6g}" if isinstance(v, float) else str(v)


def leak_lines(report: DataFrame, n: int, domain: str, shards: int) -> DataFrame:
    """The leak report as (ordinal, line), with PASS or FAIL; a split whose control failed does not pass."""
    control = F.when(F.col("control"), "PASS").otherwise("FAIL (search found nothing)")
    verdict = F.when(F.col("leaks") == 0, "clean").otherwise(F.format_string("LEAK (%d of %d)", "leaks", "samples"))
    each = report.select(F.lit(1).alias("part"), F.col("split").alias("key"), F.format_string("  %s: %d/%d sampled n-grams found in train -> %s; positive control %s", "split", "leaks", "samples", verdict, control).alias("line"))
    last = report.agg(F.concat(F.lit("  verdict: "), F.when(F.min("passed"), "PASS").otherwise("FAIL")).alias("line")).select(F.lit(2).alias("part"), F.lit("").alias("key"), "line")
    head = [(0, "0", f"{n}-gram leakage check for domain '{domain}'"), (0, "1", f"  train shards: {shards}")]
    every = report.sparkSession.createDataFrame(head, "part int, key string, line string").unionByName(each).unionByName(last)
    return every.select(F.row_number().over(Window.orderBy("part", "key")).alias("ordinal"), "line")  # a row per split


def curve_table(points: DataFrame, columns: list[str]) -> DataFrame:
    """K10, T-1: the table a chart of trajectories would plot, in order of the token axis."""
    return points.filter(F.col("tokens").isNotNull()).select("tokens", *columns).orderBy("tokens")


def stamp() -> str:
    """the time in UTC, for metadata."""
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def text_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def codec(path: str) -> Callable[[str], tuple[int, str]]:
    """A function that gives the number of a text's ids in a byte-level BPE file, and what they are decoded to.

    For a file of ``public_tokenizers`` a text without a special token's string goes through the faster of two equal codecs.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)

    def slow(text: str) -> tuple[int, str]:
        ids = whole.encode(text, add_special_tokens=False).ids
        return len(ids), whole.decode(ids, skip_special_tokens=False)

    try:
        own = os.path.samefile(path, public_tokenizers.path(os.path.basename(path)))
    except (KeyError, ValueError, OSError):
        own = False
    if not own:
        return slow
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    # the printable characters that byte-level BPE files write for bytes
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(plain))
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = [t["content"] for t in model["added_tokens"]]
    ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def run(text: str) -> tuple[int, str]:
        if any(s in text for s in special):
            return slow(text)
        ids = fast.encode_ordinary(text)
        return len(ids), fast.decode(ids)

    return run


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Characters, tokens, and texts that decoding does not give back, of a byte-level BPE file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there_and_back = codec(path)
        for pdf in batches:
            text = pdf["text"].fillna("").tolist()
            got = [there_and_back(x) for x in text]
            yield pd.DataFrame({"chars": [len(x) for x in text], "tokens": [n for n, _ in got], "failed": [int(a != b) for a, (_, b) in zip(text, got, strict=True)]})

    per = docs.select("text").mapInPandas(run, "chars long, tokens long, failed long")
    return per.agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"), F.sum("failed").alias("failed"), (F.sum("chars") / F.greatest(F.sum("tokens"), F.lit(1))).alias("chars_per_token"))
