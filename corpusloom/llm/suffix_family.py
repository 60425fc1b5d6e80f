"""Suffix-array dedup with a logarithmic index family.

A suffix array of every byte would be many times the corpus, so the arrays are sparse: they hold the suffixes that start
at anchors. Of the K-byte strings in each window of LENGTH bytes the one with the least hash is the anchor (the leftmost
if equal), with K + W - 1 = LENGTH; equal windows therefore have equal anchors at equal offsets, so a string of LENGTH
bytes occurs twice only if the suffixes at its anchor share their first K bytes. Suffixes are ordered by the fingerprint
of these bytes, which puts equal prefixes side by side as the order of the bytes would.

``IndexFamily`` takes the documents in batches. A batch gets its suffix array: the suffixes at its anchors, with their text
and position, in the order of their fingerprints. Before it is added, ``scan`` merges it with the levels that exist: the
fingerprints that it shares with an earlier suffix, of a level or of its own, are its matches. Then it becomes a level 0, and
levels of equal size merge geometrically, so each suffix is rewritten log2(batches) times. All candidates are matches of some
scan: suffixes without a match need no further look. A suffix that one text repeats is one entry with its number.

Candidates are then decided exactly. The windows whose anchor is a candidate form, per anchor, one stretch of the text;
equal stretches are counted, as copies share them whole, and equal ones at even steps (as in a run of one character) are one
row. Where a prefix has different stretches, its windows are hashed and counted one by one: in tasks that hold all stretches
of a prefix, or, for the prefixes with more than ``CROWD`` stretches, as rows that are counted by the window's hash. A window
that occurs twice is removed from every document. Windows and stretches are told apart by 128 bits, texts by their row.

Defined results: null texts are empty; texts under LENGTH bytes keep all; rows that repeat are documents of their own,
so each is a copy of the other; a null doc_id is a value; an empty table gives an empty result; other columns are
ignored. Positions are bytes of the UTF-8 text. Very long texts are read in parts, so only their bytes and one number for
each of them are held at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, Scratch, read, small_batches

LENGTH = 200
K = 64
BATCHES = 4
#: Different stretches of one prefix up to which one task holds them: at under 400 bytes each, 13 MB at most.
CROWD = 1 << 15

_grams, _first, _second = Rolling(seed=11), Rolling(seed=21), Rolling(seed=31, base=0x6C8E9CF570932BD5)


def anchors(b: np.ndarray, length: int = LENGTH, k: int = K) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each anchor: its position, the fingerprint of its k bytes, and the first and last window that has it.

    In parts, so memory does not grow with the text; an anchor whose windows lie in two parts comes in both.
    """
    n, w = len(b) - length + 1, length - k + 1
    for s in range(0, n, _PART):
        part = b[s : min(s + _PART, n) + length - 1]
        at = np.arange(len(part) - k + 1)
        h = _grams.of(_grams.prefix(part), at, at + k)
        pos = _leftmost_least(h, w)
        edge = np.flatnonzero(np.concatenate(([True], pos[1:] != pos[:-1])))
        yield pos[edge] + s, h[pos[edge]].view(np.int64), edge + s, np.append(edge[1:], len(pos)) - 1 + s


_PART, _PLACE = (1 << 20) - (1 << 12), np.uint64((1 << 20) - 1)


def _leftmost_least(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the least of every w consecutive hashes, by their upper 44 bits, the leftmost if equal.

    The position is the lower part of the key, so equal hashes are told apart and the least key names its place.
    """
    n = len(h) - w + 1
    key = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max)
    key[: len(h)] = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    block = key.reshape(-1, w)
    left = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].reshape(-1)  # least to the end of the block
    right = np.minimum.accumulate(block, 1).reshape(-1)  # least from its beginning
    return (np.minimum(left[:n], right[w - 1 : w - 1 + n]) & _PLACE).astype(np.int64)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _anchored(length: int, k: int):
    """Rows (gram, row, at, n): the suffixes at the anchors of a text; those with one fingerprint as one, from the first on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for text, row in zip(batch.column("text").to_pylist(), batch.column("row").to_pylist(), strict=True):
                for at, gram, _, _ in anchors(np.frombuffer(_bytes(text), np.uint8), length, k):
                    g, i, n = np.unique(gram, return_index=True, return_counts=True)
                    held.append((g, np.full(len(g), row), at[i], n))
                    size += len(g)
                if size > 1 << 16:
                    yield _suffixes(held)
                    held, size = [], 0
            if held:
                yield _suffixes(held)

    return run


SUFFIX = "gram long, row long, at long, n long"


def _suffixes(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in held]), pa.int64()) for i in range(4)], ["gram", "row", "at", "n"])


_CHUNK = 1 << 14


def _stretched(length: int, k: int):
    """Rows of the candidate stretches: row, start, step, times (it stands at start, start + step, ...), gram, back (of the
    anchor), h1, h2, bytes. Stretches are cut out and handed on a few thousand at a time."""
    kinds = {"back": pa.int32(), "stretch": pa.binary()}

    def rows(raw: bytes, row: int, at: np.ndarray, gram: np.ndarray, first: np.ndarray, last: np.ndarray) -> dict[str, list]:
        e = last + length
        own = [raw[i:j] for i, j in zip(first.tolist(), e.tolist(), strict=True)]
        name = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in own), "<i8").reshape(-1, 2)
        gap = np.diff(first, prepend=first[0])
        like = np.zeros(len(own), bool)  # equal to the one before, as far from it as that from the one before it
        like[1:] = (name[1:] == name[:-1]).all(1) & (gram[1:] == gram[:-1])
        new = ~like
        new[2:] |= like[2:] & like[1:-1] & (gap[2:] != gap[1:-1])
        i = np.flatnonzero(new)
        times = np.diff(np.append(i, len(own)))
        step = np.where(times > 1, gap[np.minimum(i + 1, len(gap) - 1)], 0)
        return {"row": [row] * len(i), "start": first[i].tolist(), "step": step.tolist(), "times": times.tolist(), "gram": gram[i].tolist(), "back": (at - first)[i].tolist(), "h1": name[i, 0].tolist(), "h2": name[i, 1].tolist(), "stretch": [own[j] for j in i]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()], list(out))

        for batch in batches:
            for text, row, cand in zip(*(batch.column(c).to_pylist() for c in ("text", "row", "grams")), strict=True):
                raw = _bytes(text)
                cand = np.asarray(cand, np.int64)
                for part in anchors(np.frombuffer(raw, np.uint8), length, k):
                    pick = np.flatnonzero(np.isin(part[1], cand))
                    for c in range(0, len(pick), _CHUNK):
                        for name, more in rows(raw, row, *(x[pick[c : c + _CHUNK]] for x in part)).items():
                            out.setdefault(name, []).extend(more)
                        if len(out["row"]) >= _CHUNK:
                            yield flush()
                            out.clear()
            if out:
                yield flush()
                out.clear()

    return run


def _windows(stretches: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of every window of the stretches, and how many windows each has."""
    size = np.array([len(s) for s in stretches], np.int64)
    n = size - length + 1
    b = np.frombuffer(b"".join(stretches), np.uint8)
    begin = np.repeat(np.cumsum(size) - size, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return _first.of(_first.prefix(b), begin, begin + length), _second.of(_second.prefix(b), begin, begin + length), n


def _runs(mask: np.ndarray) -> list[int]:
    """[start, end, start, end, ...] of the true runs."""
    return np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))).tolist()


def _decided(length: int):
    """Rows sorted by gram, all stretches of a gram in one task: the windows of each stretch that occur elsewhere."""

    def decide(rows: list[tuple]) -> pa.RecordBatch:
        h1, h2, n = _windows([r[3] for r in rows], length)
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        group = np.cumsum(new) - 1
        often = np.zeros(len(order), bool)
        count = np.bincount(group)
        many = np.repeat(np.array([r[4] for r in rows]) > 1, n)
        some = np.zeros(len(count), bool)
        np.logical_or.at(some, group, many[order])
        often[order] = (count[group] > 1) | some[group]
        ends = np.cumsum(n)
        runs = [_runs(often[e - m : e]) for e, m in zip(ends, n, strict=True)]
        keep = [i for i, r in enumerate(runs) if r]
        return pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i in keep], pa.int64()), pa.array([rows[i][2] for i in keep], pa.int64()), pa.array([runs[i] for i in keep], pa.list_(pa.int32()))], ["h1", "h2", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held.extend(zip(*(batch.column(c).to_pylist() for c in ("gram", "h1", "h2", "stretch", "n")), strict=True))
            cut = len(held)
            while cut and held[cut - 1][0] == held[-1][0]:
                cut -= 1  # the last gram may go on in the next batch
            if cut >= 2048:
                yield decide(held[:cut])
                held = held[cut:]
        if held:
            yield decide(held)

    return run


def _one_by_one(length: int):
    """A row for every window of the stretches of a crowded gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, n = _windows(batch.column("stretch").to_pylist(), length)
            owner = pa.array(np.repeat(np.arange(len(n)), n))
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(owner) for c in ("h1", "h2", "n")] + [pa.array(x.view(np.int64), pa.int64()) for x in (h1, h2)] + [pa.array(at, pa.int32())], ["h1", "h2", "n", "w1", "w2", "at"])

    return run


def _removed(length: int):
    """The digest of what is left of each document: spans removed are the windows' union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
            for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                raw = _bytes(text)
                gone = np.zeros(len(raw) + 1, np.int32)
                for one in found or ():
                    start = one["start"] if one["times"] == 1 else one["start"] + one["step"] * np.arange(one["times"])
                    for s, e in zip(one["runs"][::2], one["runs"][1::2], strict=True):
                        gone[start + s] += 1
                        np.add.at(gone, start + (e - 1 + length), -1)
                dead = np.cumsum(gone[:-1], dtype=np.int32) > 0
                edge = _runs(dead)
                left = np.frombuffer(raw, np.uint8)[~dead].tobytes() if edge else raw
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(len(raw) - len(left))
                out["n_spans"].append(len(edge) // 2)
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["spans"].append(edge)
            kinds = {"kept_sha256": pa.string(), "spans": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()], ["doc_id", *out])

    return run


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"


class IndexFamily:
    """Levels of suffix arrays (``SUFFIX``, in the order of their fingerprints): level i holds 2^i batches, and two of one size
    merge into the next."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.made = scratch, 0
        self.levels: dict[int, tuple[str, DataFrame]] = {}
        self.matches: list[DataFrame] = []

    def _write(self, runs: DataFrame) -> tuple[str, DataFrame]:
        name, self.made = f"level{self.made}", self.made + 1
        return name, self.scratch.cut(runs.repartition("gram").sortWithinPartitions("gram"), name)

    def scan(self, batch: DataFrame) -> DataFrame:
        """Matches of a new batch: fingerprints (gram) of its suffixes that a level holds or that it has twice itself."""
        zero = F.lit(0).cast("long")
        every = batch.select("gram", F.col("n").alias("new"), zero.alias("held"))
        for _, level in self.levels.values():
            every = every.unionByName(level.select("gram", zero.alias("new"), F.col("n").alias("held")))
        merged = every.groupBy("gram").agg(F.sum("new").alias("new"), F.sum("held").alias("held"))
        return merged.filter((F.col("new") > 1) | (F.col("new") > 0) & (F.col("held") > 0)).select("gram")

    def add(self, batch: DataFrame) -> None:
        """Scan a batch against the levels, then index it: a level 0, merged upwards while that size is taken."""
        self.matches.append(self.scratch.cut(self.scan(batch), f"matches{len(self.matches)}"))
        runs, level, old = batch, 0, []
        while level in self.levels:
            name, held = self.levels.pop(level)
            runs, level = runs.unionByName(held), level + 1
            old.append(name)
        self.levels[level] = self._write(runs)
        self.scratch.drop(*old) if old else None

    def matched(self) -> DataFrame:
        """The suffixes of all levels that some scan has matched."""
        hits, held = self.matches[0], [t for _, t in self.levels.values()]
        for t in self.matches[1:]:
            hits = hits.unionByName(t)
        every = held[0]
        for t in held[1:]:
            every = every.unionByName(t)
        return every.join(hits.distinct(), "gram", "left_semi")


def dedup_bytes(docs: DataFrame, scratch: Scratch, length: int = LENGTH, k: int = K, batches: int = BATCHES, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end, ... in bytes)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = scratch.cut(rows, "rows")
    long_rows = rows.filter(F.octet_length("text") >= length)
    batch = F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int")
    anchored = scratch.cut(long_rows.select("text", "row").mapInArrow(_anchored(length, k), SUFFIX).withColumn("batch", batch), "anchors", by="batch")
    family = IndexFamily(scratch)
    for i in range(batches):
        family.add(anchored.filter(F.col("batch") == i).drop("batch"))
    # the documents' candidates; those that no suffix of another place matches have none
    found = scratch.cut(family.matched().groupBy("row").agg(F.collect_set("gram").alias("grams")), "candidates")
    touched = scratch.cut(long_rows.join(found.hint("merge"), "row"), "touched")
    scratch.drop("anchors", *[name for name, _ in family.levels.values()])
    kind = "row long, start long, step long, times long, gram long, back int, h1 long, h2 long, stretch binary"
    place = scratch.cut(touched.select("text", "row", "grams").mapInArrow(_stretched(length, k), kind), "stretches")
    one = scratch.cut(place.groupBy("gram", "back", "h1", "h2", "stretch").agg(F.sum("times").alias("n")), "different")
    kinds = one.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest"))
    # a stretch that is alone with its prefix repeats whole or not at all; others are looked at window by window
    open_ = one.join(scratch.cut(kinds.filter((F.col("kinds") > 1) & (F.col("fewest") == 1)), "open"), "gram")
    small = open_.filter(F.col("kinds") <= crowd).repartition("gram").sortWithinPartitions("gram").select("gram", "h1", "h2", "stretch", "n").mapInArrow(_decided(length), "h1 long, h2 long, runs array<int>")
    windows = open_.filter(F.col("kinds") > crowd).select("stretch", "h1", "h2", "n").mapInArrow(_one_by_one(length), "h1 long, h2 long, n long, w1 long, w2 long, at int")
    often = windows.groupBy("w1", "w2").agg(F.sum("n").alias("times")).filter(F.col("times") > 1)
    large = windows.join(often, ["w1", "w2"]).groupBy("h1", "h2").agg(F.flatten(F.transform(F.array_sort(F.collect_set("at")), lambda a: F.array(a, a + 1))).alias("runs"))
    whole = one.filter(F.col("n") > 1).select("h1", "h2", F.array(F.lit(0), F.octet_length("stretch") - (length - 1)).alias("runs"))
    verdict = scratch.cut(small.unionByName(large).unionByName(whole).groupBy("h1", "h2").agg(F.flatten(F.collect_list("runs")).alias("runs")), "verdicts")
    hit = place.join(verdict, ["h1", "h2"]).groupBy("row").agg(F.collect_set(F.struct("start", "step", "times", "runs")).alias("found"))
    hit = scratch.cut(hit, "hits")
    scratch.drop("stretches", "different", "open")
    known = touched.select("row", "doc_id", "text").join(hit, "row", "left").select("doc_id", "text", "found").mapInArrow(_removed(length), _OUT)
    # digests are taken before the join, so the texts of untouched documents are not shuffled for it
    zero = F.lit(0).cast("long")
    plain = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text"), 256).alias("kept_sha256"), F.array().cast("array<bigint>").alias("spans"), "row")
    return known.unionByName(plain.join(found.select("row"), "row", "left_anti").drop("row"))


def op7_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(read(spark, sf_dir, "documents"), Scratch(spark, "suffixes"))
