"""Quality rules: cross-document line frequency.

One pass over the texts counts what the base rules need and hashes each normalised line (lower case, white space
collapsed). The lines of each host are counted by distinct document, partial counts first; lines found in more than
``limit`` documents of their host are removed, and a document that loses more than ``most_lost`` of its words is rejected.

The join back from frequent lines broadcasts them only when their number has been checked; otherwise both sides are
shuffled and adaptive execution splits hot lines.

Defined results: a null text has no words and fails the base rules; a null host is a host of its own; rows that repeat
are separate documents; lines without a word are neither counted nor removed; empty tables give no rows; columns other
than those named are ignored. Words are runs of bytes other than space and 0x09 to 0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, read, small_batches

LIMIT = 10
MOST_LOST = 0.5
WINDOW = 8
_BLANK, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "uid long, doc_id long, host string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", lines array<long>, line_words array<int>"


def repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """How many words lie in an n-word window that occurs twice or more."""
    if len(words) <= n:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    if len(ids) > len(words) - n:  # a repeated window repeats n words at least
        return 0
    code, span = x, len(ids)
    m = len(words) - n + 1
    for j in range(1, n):  # exact: codes are renumbered before they could overflow
        if span >= 1 << 31:
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
            span = int(code.max()) + 1
        code, span = code[: len(words) - j] * np.uint64(len(ids)) + x[j:], span * len(ids)
    _, at, count = np.unique(code[:m], return_inverse=True, return_counts=True)
    hit = np.flatnonzero(count[at] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + n, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> tuple:
    """The five counts, and the distinct normalised lines with the words that each holds in all."""
    b = text.encode("utf-8", "replace")
    words = b.split()
    chars = len(text) - (len(b) - len(b.translate(None, _BLANK)))
    dup, seen, lines = 0, set(), {}
    for line in b.split(b"\n"):
        own = line.split()
        if own:
            dup += line in seen
            seen.add(line)
            h = xxhash.xxh3_64_intdigest(b" ".join(own).decode("utf-8").lower()) - (1 << 63)
            lines[h] = lines.get(h, 0) + len(own)
    return len(words), chars, len(b) - len(b.translate(None, _SYMBOLS)), dup, repeated_words(words), list(lines), list(lines.values())


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * len(_COUNTS) + [pa.list_(pa.int64()), pa.list_(pa.int32())]
    for batch in batches:
        found = [measure(t or "") for t in batch.column("text").to_pylist()]
        cols = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), batch.column("host"), *cols], [f.split()[0] for f in SCHEMA.split(", ")])


def judge(docs: DataFrame, host: str = "source", limit: int = LIMIT, most_lost: float = MOST_LOST) -> DataFrame:
    """One row per document with its counts, base_failed, n_lost_words (in lines over the limit) and kept."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "lines")
    each = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), F.col("text"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))
    each = scratch.cut(each.mapInArrow(_measured, SCHEMA), "measured")
    line = each.select("uid", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("uid", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("n"))
    often = scratch.cut(line.groupBy("host", "line").count().filter(F.col("count") > limit).select("host", "line"), "often")
    lost = line.join(bounded(often), ["host", "line"]).groupBy("uid").agg(F.sum("n").alias("n_lost_words"))
    out = each.drop("lines", "line_words").join(lost, "uid", "left").withColumn("n_lost_words", F.coalesce("n_lost_words", F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= most_lost * F.col("n_words"))).drop("uid", "host")


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))


OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT uid, doc_id, host, text, w, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
l AS (SELECT uid, host, i, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n,
    lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm
  FROM (SELECT uid, host, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM d)),
ll AS (SELECT * FROM l WHERE n > 0),
dup AS (SELECT uid, CAST(sum(c - 1) AS BIGINT) AS n_dup_lines FROM (SELECT uid, line, count(*) AS c FROM ll GROUP BY ALL) GROUP BY uid),
often AS (SELECT host, norm FROM ll GROUP BY host, norm HAVING count(DISTINCT uid) > {LIMIT}),
lost AS (SELECT uid, CAST(sum(n) AS BIGINT) AS n_lost_words FROM ll SEMI JOIN often USING (host, norm) GROUP BY uid),
win AS (SELECT uid, i, array_to_string(w[i:i + {WINDOW} - 1], ' ') AS g FROM (SELECT uid, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM b WHERE len(w) >= {WINDOW})),
rep AS (SELECT uid, count(DISTINCT p) AS n_repeat_words FROM (SELECT uid, unnest(range(i, i + {WINDOW})) AS p
    FROM (SELECT *, count(*) OVER (PARTITION BY uid, g) AS c FROM win) WHERE c > 1) GROUP BY uid)
SELECT doc_id, n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lost_words, 0) AS n_lost_words,
  (n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words) AND coalesce(n_lost_words, 0) <= {MOST_LOST} * n_words AS kept
FROM b LEFT JOIN dup USING (uid) LEFT JOIN lost USING (uid) LEFT JOIN rep USING (uid)
"""
