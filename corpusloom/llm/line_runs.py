"""Line dedup: a suffix array over line-id sequences, by distributed prefix doubling.

A text is the sequence of its lines that hold something; a line's id is a hash of it. Prefix doubling names the runs of
2^k lines that start at each position by the pair of names of their halves, so equal runs have equal names. Sorting
suffixes by their names of length 1, 2, 4, ... puts suffixes with a common prefix side by side: this order is the suffix
array, and the suffixes that share the name of length 2^k are its interval of longest common prefix 2^k or more. The
intervals are found by counting names; a suffix whose name is its own has no neighbour with so long a prefix and leaves,
so each round handles only what still repeats, and the rounds end when nothing does: after log2(longest repeat) rounds.

A run of lines is deleted where it repeats a run that came earlier: positions are ordered by (doc_id, text hash, line).
Deleting, for every interval of depth ``MIN_LINES`` or more, the runs after the first removes the same lines as deleting
all later copies of every maximal repeated run. A line of ``LONG_WORDS`` words or more, such as a paragraph without line
breaks, is a run by itself. Maximal runs are then the stretches of deleted lines; their lengths and the deepest interval over
them are reported.

Names are hashes, so unlike lines stand in the order of their hashes, an arbitrary but fixed alphabet, and longest common
prefixes are known as powers of two, which is all that deleting needs.

Names are counted with partial counts, so a line that a third of the rows hold costs its task one row per map task; what
is joined back is split by adaptive execution where one name is hot.

Defined results: null and empty texts have no lines and stay as they are; blank lines take no part and stay; rows with
the same doc_id and text are one document and share their verdict; a null doc_id orders first; an empty table gives an
empty result; columns other than doc_id and text pass through unchanged, but those named like a result column
(n_removed, spans, deepest) or a working one (levels, _doc, _hash) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix, read, small_batches

#: A power of two: the shortest run whose copies are deleted, and the words that make one line such a run.
MIN_LINES = 2
LONG_WORDS = 50
_FAR = np.uint64(0xD6E8FEB86659FD93)


def content_lines(text: str) -> list[tuple[int, str]]:
    """(index among all lines, line) of the lines that hold something."""
    return [(i, line) for i, line in enumerate(text.split("\n")) if line and not line.isspace()]


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(line.split())) - (1 << 63)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The line ids of each text, and the positions of its long lines."""
    for batch in batches:
        lines = [[" ".join(line.split()) for _, line in content_lines(t or "")] for t in batch.column("text").to_pylist()]
        ids = [[line_id(line) for line in own] for own in lines]
        long = [[i for i, line in enumerate(own) if line.count(" ") + 1 >= LONG_WORDS] for own in lines]
        cols = [pa.array(x, pa.list_(pa.int64())) for x in (ids, long)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *cols], ["doc_id", "text_hash", "ids", "long"])


def _doubled(half: int):
    """From names of runs of ``half`` lines (at each of the positions ``at``) to names of runs twice as long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, ats, names = [], [], []
            for k, (at, name) in enumerate(zip(batch.column("at").to_pylist(), batch.column("name").to_pylist(), strict=True)):
                order = np.argsort(at, kind="stable")
                a, n = np.asarray(at, np.int64)[order], np.asarray(name, np.int64)[order].view(np.uint64)
                there = np.searchsorted(a, a + half)
                ok = there < len(a)
                ok[ok] = a[there[ok]] == a[ok] + half
                if ok.any():
                    keep.append(k)
                    ats.append(a[ok])
                    names.append(mix(mix(n[ok]) * _FAR + n[there[ok]] + np.uint64(half)).view(np.int64))
            pick = pa.array(keep, pa.int64())
            cols = [batch.column("doc_id").take(pick), batch.column("text_hash").take(pick)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ats, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.int64()))], ["doc_id", "text_hash", "at", "name"])

    return run


_RUNS = "doc_id long, text_hash long, at array<long>, name array<long>"


def repeated_runs(docs: DataFrame, scratch: Scratch, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, text_hash, at, lines, later): suffixes whose first ``lines`` = 2^k >= ``min_lines`` lines repeat.

    ``later`` tells that an equal run starts earlier.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    seq = scratch.cut(docs.mapInArrow(_sequences, "doc_id long, text_hash long, ids array<long>, long array<long>").filter(F.size("ids") > 0), "sequences")
    place = F.struct("doc_id", "text_hash", "at")
    found = None

    def repeats(suffix: DataFrame, lines: int, name: str) -> DataFrame | None:
        """Of suffixes (doc_id, text_hash, at, name): those whose name is not their own, with ``later``, by text."""
        groups = scratch.cut(suffix.groupBy("name").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter(F.col("n") > 1), f"groups-{name}")
        if groups.isEmpty():
            return None
        told = suffix.join(groups, "name").select("doc_id", "text_hash", "at", "name", (~place.eqNullSafe(F.col("first"))).alias("later"))
        told = told.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("at", "name", "later")).alias("s"))
        told = told.select("doc_id", "text_hash", F.col("s.at").alias("at"), F.col("s.name").alias("name"), F.col("s.later").alias("later"), F.lit(lines).alias("lines"))
        told = scratch.cut(told, f"runs-{name}")
        scratch.drop(f"groups-{name}")
        return told

    if min_lines > 1:
        one = seq.select("doc_id", "text_hash", F.explode(F.transform("long", lambda i: F.struct(i.alias("at"), F.element_at("ids", (i + 1).cast("int")).alias("name")))).alias("s"))
        found = repeats(one.select("doc_id", "text_hash", "s.at", "s.name"), 1, "long")
    state = seq.select("doc_id", "text_hash", F.sequence(F.lit(0).cast("long"), F.size("ids").cast("long") - 1).alias("at"), F.col("ids").alias("name"))
    length, round_no = 1, 0
    while length < min_lines:  # names of the shortest runs of interest need no counting: all their halves are at hand
        state = state.mapInArrow(_doubled(length), _RUNS)
        length *= 2
    while True:
        state = scratch.cut(state, f"state{round_no}")
        suffix = state.select("doc_id", "text_hash", F.explode(F.arrays_zip("at", "name")).alias("s")).select("doc_id", "text_hash", F.col("s.at").alias("at"), F.col("s.name").alias("name"))
        told = repeats(suffix, length, str(round_no))
        scratch.drop(f"state{round_no}")
        if told is None:
            break
        found = told if found is None else found.unionByName(told)
        state = told.select("doc_id", "text_hash", "at", "name").mapInArrow(_doubled(length), _RUNS)
        length, round_no = 2 * length, round_no + 1
    if found is None:
        found = docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, at array<long>, lines int, later array<boolean>")
    return found.select("doc_id", "text_hash", "at", "lines", "later")


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, removed, spans, deepest = [], [], [], []
        for text, levels in zip(batch.column("text").to_pylist(), batch.column("levels").to_pylist(), strict=True):
            if not levels:
                texts.append(text)
                removed.append(0)
                spans.append([])
                deepest.append(0)
                continue
            own = content_lines(text)
            gone = np.zeros(len(own) + 1, np.int64)
            for level in levels:
                starts = np.asarray([a for a, late in zip(level["at"], level["later"], strict=True) if late], np.int64)
                np.add.at(gone, starts, 1)
                np.add.at(gone, starts + level["lines"], -1)
            dead = np.cumsum(gone[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate(([0], dead.astype(np.int8), [0]))))
            drop = {own[i][0] for i in np.flatnonzero(dead)}
            texts.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop) if drop else text)
            removed.append(int(dead.sum()))
            spans.append([{"start": own[a][0], "lines": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            deepest.append(max(x["lines"] for x in levels))
        span = pa.list_(pa.struct([("start", pa.int64()), ("lines", pa.int64())]))
        kept = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] not in ("text", "levels")]
        names = [n for n in batch.schema.names if n not in ("text", "levels")]
        cols = [pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(deepest, pa.int64())]
        yield pa.RecordBatch.from_arrays([*kept, *cols], [*names, "text", "n_removed", "spans", "deepest"])


def dedup_lines(docs: DataFrame, scratch: Scratch, min_lines: int = MIN_LINES) -> DataFrame:
    """The documents without later copies of repeated runs: all columns, and n_removed, spans (maximal runs deleted, in
    lines of the input), deepest (the longest 2^k of lines that repeat from one of its positions)."""
    docs = docs.drop("n_removed", "spans", "deepest", "levels", "_doc", "_hash")
    runs = repeated_runs(docs, scratch, min_lines)
    runs = runs.filter(F.exists("later", lambda x: x)).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("at", "lines", "later")).alias("levels"))
    runs = scratch.cut(runs, "levels").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "levels").hint("merge")
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    joined = docs.join(runs, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (key == F.col("_hash")), "left").drop("_doc", "_hash")
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", text string, n_removed long, spans array<struct<start:long,lines:long>>, deepest long"
    return joined.select(*[f"`{f.name}`" for f in rest], "text", "levels").mapInArrow(_cleaned, schema)


def op5_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "runs"))
    return found.select("doc_id", F.col("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


def blank(text: Column) -> Column:
    """Whether nothing but white space is left."""
    return F.coalesce(F.trim(F.regexp_replace(text, "\\s+", " ")), F.lit("")) == ""


#: Deletion by pairs of neighbouring lines, which equals deletion by runs of two or more, and by long lines.
OP5_SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
a AS (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT doc_id, text, i, row_number() OVER (PARTITION BY doc_id, text ORDER BY i) AS p, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM a WHERE trim(regexp_replace(line, '\s+', ' ', 'g')) <> ''),
g AS (SELECT doc_id, text, p, line || chr(10) || lead(line) OVER (PARTITION BY doc_id, text ORDER BY p) AS g FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM g WHERE g IS NOT NULL),
w AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, p) AS k FROM l WHERE len(string_split(line, ' ')) >= {LONG_WORDS}),
gone AS (SELECT DISTINCT doc_id, text, unnest([p, p + 1]) AS p FROM f WHERE k > 1 UNION SELECT doc_id, text, p FROM w WHERE k > 1),
gi AS (SELECT l.doc_id, l.text, l.i, l.p FROM l JOIN gone USING (doc_id, text, p)),
s AS (SELECT doc_id, text, count(*) AS n_removed, count(DISTINCT p - rn) AS n_spans FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY p) AS rn FROM gi) GROUP BY ALL),
kept AS (SELECT doc_id, text, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS left_over FROM a ANTI JOIN gi USING (doc_id, text, i) GROUP BY ALL)
SELECT o.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, length(coalesce(left_over, CASE WHEN n_removed IS NULL THEN o.text ELSE '' END)) AS n_chars,
  sha256(coalesce(left_over, CASE WHEN n_removed IS NULL THEN o.text ELSE '' END)) AS kept_sha256
FROM documents o LEFT JOIN s USING (doc_id, text) LEFT JOIN kept USING (doc_id, text)
"""
