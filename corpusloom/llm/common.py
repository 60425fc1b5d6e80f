"""What the training-data operators share: reading, cutting lineage, bounded broadcasts, byte-level hashing.

Scratch tables go to the folder named by ``spark.checkpoint.dir``, which every executor can reach. A session on one machine
that has no such setting (as in tests) gets a temporary folder; a cluster without it is an error.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that a side may hold, as counted row by row, before it is joined by shuffle instead of broadcast.
BROADCAST_BYTES = 32 << 20
#: Rows handed to a Python worker at once; bounds a worker's memory by the longest texts, not by the partition.
ARROW_ROWS = 128
#: Bytes handed to a Python worker at once, unless one row has more.
ARROW_BYTES = 4 << 20
#: Bytes of input, as stored, for each task that writes a table.
TASK_BYTES = 64 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts can be very long. All operators ask for the same size, so their order does not matter."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written tables; it is set only where the session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def plan_bytes(df: DataFrame) -> int:
    """Bytes that a plan reads: the sizes of its tables, after pruning. Rows without a known size count as very many."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def sized(df: DataFrame) -> DataFrame:
    """Partitions by bytes: one for every ``TASK_BYTES`` read and two a core at least; a plan that has fewer keeps its own."""
    return df.coalesce(min(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-plan_bytes(df) // TASK_BYTES)), (1 << 31) - 1))


class Scratch:
    """Written tables that cut lineage. A lost executor costs only the tasks that read them again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"

    def cut(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write and reread."""
        path = f"{self.root}/{name}"
        writer = sized(df).write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def all_of(self, names: list[str], schema) -> DataFrame:
        """Written tables of one schema as one scan: a plan does not grow with their number."""
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}" for name in names])

    def drop(self, *names: str) -> None:
        """Remove tables that no later plan reads; no name at all removes everything."""
        jvm = self.spark.sparkContext._jvm
        for path in [f"{self.root}/{name}" for name in names] or [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _width(c: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes, about."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType | T.StructType):
            return F.coalesce(F.aggregate(c, F.lit(16).cast("long"), lambda n, x: n + _width(x, kind.elementType)), F.lit(16))
        return F.greatest(F.size(c), F.lit(0)) * 8 + 16
    if isinstance(kind, T.StructType):
        return sum((_width(c[f.name], f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a (cut) side is small enough to broadcast, by the bytes of its rows."""
    one = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16)).cast("long")
    return (df.agg(F.sum(one)).first()[0] or 0) <= limit


def bounded(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The side with a broadcast hint if its bytes have been counted and fit, else as it is: then both sides are shuffled."""
    return F.broadcast(df) if fits(df, limit) else df


# ---- hashing of bytes, vectorised -------------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def byte_values(seed: int) -> np.ndarray:
    """A fixed 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * _BASE + np.uint64(seed))


class Rolling:
    """Hashes of any substring of a byte array in constant time, modulo 2^64 with an odd base.

    H[i] = sum over j < i of v(b[j]) * B^j; the substring [i, i + n) hashes to (H[i + n] - H[i]) * B^-i.
    """

    def __init__(self, seed: int = 0, base: int = 0x2545F4914F6CDD1D):
        self.values = byte_values(seed)
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, b: np.ndarray) -> np.ndarray:
        self._powers(len(b) + 1)
        h = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.values[b] * self.up[: len(b)], out=h[1:])
        return h

    def of(self, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((h[end] - h[start]) * self.down[start])


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_words = Rolling(seed=7)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's lower-case words: runs of ASCII letters, digits, underscore and any other non-ASCII."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    inside = np.concatenate(([False], _WORD[b], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    return _words.of(_words.prefix(b), start, end)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words; a shorter, non-empty text is one shingle."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out = out * _BASE + words[j : j + len(out)]
    return mix(out)
