"""Sharding by jump consistent hashing: the key and the number of shards decide, without a table of the ring.

A key is a 64-bit hash; a linear congruential generator seeded with it yields the shards at which the key would jump as
shards are appended, and the last jump below their number is its shard. Adding one shard takes 1 / (n + 1) of the keys, all
of them into the new one. The law of the query is ``key``: rows with equal document ids share a shard, rows with equal texts
need not.

Rows keep a place in their shard, a gapless slot in order of (doc_id, text_crc32, size). No task numbers a whole shard: rows
are dealt out by ranges of that order, with the row's number as the last resort against a key that holds a third of all
rows; ranges are counted per shard, and rows are numbered within their range.

Defined results: a null text has no bytes and the checksum 0; a null id is a key of its own and sorts first; rows that are equal
in all of these take neighbouring slots and may change places; texts are read whole; an empty table gives no rows; columns
other than those named are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, read

SHARDS = 24
#: Rows of a range, about; a range is numbered by one task.
RANGE_ROWS = 1 << 19
_STEP = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key."""
    k, shard, todo = keys.astype(np.uint64), np.zeros(len(keys), np.int64), np.arange(len(keys))
    while len(todo):
        k = k * np.uint64(_STEP) + np.uint64(1)
        ahead = np.floor((shard[todo] + 1) * (2.0**31 / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        on = ahead < shards
        todo, k = todo[on], k[on]
        shard[todo] = ahead[on]
    return shard.astype(np.int32)


def stable_key(key: Column) -> Column:
    """The first 64 bits of the MD5 of the key as text, as a signed number; a null is a key of its own."""
    half = lambda at: F.conv(F.substring(F.md5(F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit(""))), at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key column."""
    if shards < 1:
        raise ValueError("there is one shard at least")

    @F.pandas_udf("int")
    def run(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), shards))

    return run(key)


def slotted(rows: DataFrame, shard: str, order: list[str], scratch: Scratch) -> DataFrame:
    """Adds ``slot``: the row's place in its shard in ``order`` (nulls first), from 0 and without gaps."""
    rows = scratch.cut(rows, "rows")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // RANGE_ROWS))
    by = [F.col(c).asc_nulls_first() for c in order]
    ranged = rows.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(parts, *by, F.xxhash64("_n"))
    ranged = scratch.cut(ranged.withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33)).drop("_n"), "ranged")
    scratch.drop("rows")
    sizes = ranged.groupBy(shard, "_part").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = scratch.cut(sizes.select(shard, "_part", before.alias("_base")), "base")
    place = F.row_number().over(Window.partitionBy(shard, "_part").orderBy(*by)) - 1
    return ranged.withColumn("_place", place).join(bounded(base), [shard, "_part"]).withColumn("slot", (F.col("_base") + F.col("_place")).cast("long")).drop("_part", "_place", "_base")


def sharded(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (with one shard more)."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(whole) + F.lit(8)).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), stable_key(F.col(key)).alias("_key"))
    rows = rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), shard_of(F.col("_key"), shards).alias("shard"), shard_of(F.col("_key"), shards + 1).alias("grown_shard"))
    out = slotted(rows, "shard", ["doc_id", "text_crc32", "size"], Scratch(docs.sparkSession, "shards"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op12_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(read(spark, sf_dir, "documents"))


def sql(shards: int = SHARDS) -> str:
    """The same by a recursion over jumps; checksums are bitwise, over the bytes of each text."""
    found = lambda n: f"""j{n} AS (SELECT uid, k, 0::BIGINT AS b, 0::BIGINT AS j FROM d
    UNION ALL SELECT uid, k2, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / ((k2 // 8589934592)::DOUBLE + 1.0))) AS BIGINT)
      FROM (SELECT uid, j, (k * {_STEP} + 1) % 18446744073709551616 AS k2 FROM j{n} WHERE j < {n})),
s{n} AS (SELECT uid, CAST(max(j) FILTER (WHERE j < {n}) AS INTEGER) AS shard FROM j{n} GROUP BY uid)"""  # noqa: E731
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS uid, doc_id, encode(coalesce(text, '')) AS b, ('0x' || substr(md5(coalesce('k' || doc_id::VARCHAR, '')), 1, 16))::UBIGINT::HUGEINT AS k FROM documents),
ct AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i)),
cl AS (SELECT list(CAST(v AS BIGINT) ORDER BY i) AS l FROM ct),
h AS (SELECT uid, doc_id, octet_length(b) AS n, list_transform(string_split(rtrim(regexp_replace(hex(b), '(..)', '\1 ', 'g')), ' '), lambda x: CASE WHEN x = '' THEN 0 ELSE ('0x' || x)::BIGINT END) AS l FROM d),
c AS (SELECT uid, doc_id, n + 8 AS size, CASE WHEN n = 0 THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, h.l), lambda c, x: xor(c // 256, cl.l[xor(c % 256, x) + 1])), 4294967295) END AS text_crc32 FROM h, cl),
{found(shards)},
{found(shards + 1)}
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, s{shards}.shard,
  row_number() OVER (PARTITION BY s{shards}.shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, s{shards + 1}.shard AS grown_shard
FROM c JOIN s{shards} USING (uid) JOIN s{shards + 1} USING (uid)
"""
