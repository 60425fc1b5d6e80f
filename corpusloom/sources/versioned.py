"""Tables that are replaced as a whole: written aside, described by a manifest, and shown by swapping one pointer.

A root holds folders ``version=<id>`` with the data and a manifest ``_version.json`` each, and the file ``_current`` that names one.
Readers follow the pointer once, so they see the old table or the new one; the swap is a rename over the old pointer, which
the file system does at once or not at all. What an interrupted writer left is named by no pointer and goes with ``tidy``.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import delete

POINTER, MANIFEST = "_current", "_version.json"


class Conflict(RuntimeError):
    """Another writer published since the version that this one started from."""


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """K8: a small file that appears whole, written under another name and renamed; without ``replace`` an old one wins.

    It has no checksum file beside it, which could only be swapped in a second step. A distributed file system replaces in one
    step if asked to; on a local one the system's own rename does, while Hadoop's would remove the old file first.
    """
    jvm, target = spark.sparkContext._jvm, _path(spark, path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.FileSystem.newInstance(target.toUri(), conf)
    fs.setWriteChecksum(False)
    aside = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), "OVERWRITE" if replace else "NONE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), conf)
    try:
        if replace and fs.getUri().getScheme() == "file":
            os.replace(aside.toUri().getPath(), target.toUri().getPath())
        else:
            context.rename(fs.makeQualified(aside), fs.makeQualified(target), options)
    except Exception:
        fs.delete(aside, False)
        raise
    finally:
        fs.close()


def get(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, null where there is none."""
    fs = _fs(spark, path)
    if not fs.exists(_path(spark, path)):
        return None
    stream = fs.open(_path(spark, path))
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def current(spark: SparkSession, root: str) -> str | None:
    """The version that readers see."""
    found = get(spark, f"{root}/{POINTER}")
    return found.strip() if found else None


def publish(df: DataFrame, root: str, facts: dict | None = None, fmt: str = "parquet", options: dict | None = None, expected: str | None = "any") -> dict:
    """K2, K8: writes a version and its manifest, then makes it current; gives the manifest.

    The manifest counts rows and files of what was written and carries ``facts`` (provenance). With ``expected`` (a version or
    None) a table that somebody else published meanwhile is left alone; looking and swapping are two steps, so writers that
    end in the same instant still need a lock of their own. Readers never do.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex[:16]
    before, path = current(spark, root), f"{root}/version={version}"
    if expected not in ("any", before):
        raise Conflict(f"{root} is at {before}, not at {expected}")
    df.write.format(fmt).options(**(options or {})).mode("errorifexists" if fmt == "parquet" else "append").save(path)
    back = spark.read.schema(df.schema).parquet(path) if fmt == "parquet" else None
    told = {"version": version, "before": before, "format": fmt, "columns": dict(df.dtypes)} | (facts or {})
    if back is not None:
        told |= back.select(F.count("*").alias("rows"), F.countDistinct("_metadata.file_path").alias("files")).first().asDict()
    put(spark, f"{path}/{MANIFEST}", json.dumps(told, indent=1), replace=False)
    if expected != "any" and current(spark, root) != before:
        raise Conflict(f"{root} changed while {version} was written")
    put(spark, f"{root}/{POINTER}", version)
    return told


def manifest(spark: SparkSession, root: str, version: str | None = None) -> dict:
    """K2: what a version holds; no manifest, no version."""
    at = version or current(spark, root)
    found = get(spark, f"{root}/version={at}/{MANIFEST}") if at else None
    if found is None:
        raise FileNotFoundError(f"{root} has no complete version {at or ''}".strip())
    return json.loads(found)


def table(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The current version, or a named one."""
    told = manifest(spark, root, version)
    kind = ", ".join(f"`{n}` {t}" for n, t in told["columns"].items())
    reader = spark.read.format(told["format"])
    return (reader.schema(kind) if told["format"] == "parquet" else reader).load(f"{root}/version={told['version']}")


def tidy(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Removes all but the newest ``keep`` versions of the pointer's chain, and leftovers of writers; gives what went."""
    chain, at = [], current(spark, root)
    while at and len(chain) < keep:
        chain.append(at)
        found = get(spark, f"{root}/version={at}/{MANIFEST}")
        at = json.loads(found)["before"] if found else None
    names = [s.getPath().getName() for s in _fs(spark, root).listStatus(_path(spark, root))]
    gone = sorted(n.removeprefix("version=") for n in names if n.startswith("version=") and n.removeprefix("version=") not in chain)
    for version in gone:
        delete(spark, f"{root}/version={version}")
    return gone


def readable(spark: SparkSession, root: str) -> bool:
    """Whether there is a complete version."""
    try:
        return manifest(spark, root) is not None
    except (FileNotFoundError, AnalysisException):
        return False
