"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A document is a weighted set of shingles of ``SHINGLE`` words: weight = occurrences * idf. The document frequency of every
shingle is counted exactly over all documents; frequencies under one document in ``RARE`` count as that many, so what
differs from the rarest weight is a table whose size depends on the documents' length, not on their number (``Weights``).
Copies raise the frequency of what they share, but not of what each changes, so in a group of more than one document in
``RARE`` two near copies can be far apart by weight. Compared documents are therefore linked as well if their Jaccard similarity
without weights reaches the threshold: near copies of a representative share its class however large their group is. Known limit:
two that are similar without weights only, and to no representative that both are compared with, stay apart.
Each of BANDS * ROWS samples picks a shingle with probability in proportion to its weight, so two documents agree in a
sample with probability equal to their weighted Jaccard similarity; samples are grouped into bands and documents that
share a band meet in a bucket.

Equal texts are one node. Buckets of every size are treated alike: each member is compared with the bucket's
representative p only, the member that shares most buckets with others (ties: the smallest). What is similar to p has its
class, so no two of these need be compared. A link between two others leaves a trace that smaller groups show:

* Members at least ``NEAR`` similar to p are described by how they differ from it: occurrences that they add (weight b) and
  that they lack (weight a). With d = a + t b, two members x, y reach the threshold t only if their common differences weigh
  T = (d_x + d_y - (1 - t) |p|) / (1 + t) or more. One that is not similar to p has d > (1 - t) |p|, so two that share no
  difference cannot be linked, and what they share includes one of the first differences of each in a fixed order (added
  before lacking, rarest first) whose rest would weigh less than a bound of T that each knows alone (``_prefix``).
* Members further from p are taken together by the rarest shingles, without which less than t of their weight is left: two
  that have none of these in common cannot be linked. Each such group has a representative of its own, and so on.
* A pair of one member near p and one far from it is only possible where their similarities to p differ by 1 - t or less, as
  weighted Jaccard distance is a metric; these few are joined by the same rarest shingles.

Members near p that are not similar to it and share a name of a difference are compared with a representative of theirs, so a
family inside a bucket becomes one class as well. Where a name still has members of several classes, each turn compares them with
another one of them, for as long as that links enough. What is then still open is joined by the names, between different classes only; a pair is asked for only if its similarities to p allow it and its common differences can weigh T by two bitmaps of 256
bits, bounds that never fail a link. Copies with edits of their own share too little for that, so a group of copies
is not expanded into its pairs; nor is anything capped, and the rule does not depend on sizes. Every link between two texts
that share a band is therefore found: the two are compared, or are in one class before, or a bound rules the link out.

Classes are the connected components of the pairs that reach ``THRESHOLD``, by label propagation with jumps. At the threshold
two documents share one of the bands with probability 1 - (1 - 0.8^3)^12 = 0.9998.

Defined results: null and empty texts have no shingles and link to nothing; texts under five words are one shingle; rows
that repeat an id are one document, so they share a class; rows with a null doc_id are documents of their own; an empty
table gives an empty result. The class id is its least doc_id (null if all are), and the row kept is the first one with it.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix, read, shingle_hashes, small_batches, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3
#: Similarity to a representative from which a member is described by its differences from it.
NEAR = 0.5
#: Names of differences and shingles that one task groups.
NAMES = 1 << 18
#: Bits of each of the two bitmaps of differences, in words of 64.
WORDS = 4
#: Turns, at most, in which members that share a difference are compared with one of them before pairs are formed, and the part of
#: its comparisons that a turn must link for another one to follow. What turns leave is compared pair by pair, so no result depends on either.
TURNS, WORTH = 8, 1 / 16
#: Document frequencies under this part of the documents count as this part.
RARE = 1 << 13
#: Rows that the table of more frequent shingles may have; the part doubles until it fits. At 12 bytes each, 12 MB.
FREQUENT = 1 << 20
#: Shingles of a block of documents that are counted together, and bytes of text for each range of hashes.
_BLOCK, RANGE_BYTES = 1 << 20, 16 << 20
#: Shingles that are sampled at once.
PART = 1 << 18
_SEED = np.uint64(0xA0761D6478BD642F)
_ADDED, _LACKING = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of a text, ascending, and how often each occurs."""
    return np.unique(shingle_hashes(word_hashes(text or ""), SHINGLE), return_counts=True)


class Weights:
    """idf of each shingle: ln((1 + n) / (1 + df)) + 1, with the exact df of the frequent ones and one df for all others."""

    def __init__(self, shingle: np.ndarray, idf: np.ndarray, rest: float):
        self.shingle, self.idf, self.rest = shingle, idf.astype(np.float32), np.float32(rest)

    def of(self, s: np.ndarray) -> np.ndarray:
        out = np.full(len(s), self.rest, np.float32)
        if len(self.shingle) and len(s):
            at = np.minimum(np.searchsorted(self.shingle, s), len(self.shingle) - 1)
            hit = self.shingle[at] == s
            out[hit] = self.idf[at[hit]]
        return out


def _counted(ranges: int):
    """mapInArrow function: (range, s, n): of a block of documents, the shingles of one range of hashes, ascending, and in how many
    documents each is. Blocks are bounded by shingles, so a shingle that very many documents hold is one entry of each block."""
    edge = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        s, n = np.unique(np.concatenate(held), return_counts=True)
        cut = np.concatenate(([0], np.searchsorted(s, edge), [len(s)]))
        own = np.flatnonzero(cut[1:] > cut[:-1])
        n = n.astype("<u4")
        parts = [[x[cut[i] : cut[i + 1]].tobytes() for i in own] for x in (s, n)]
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(parts[0], pa.binary()), pa.array(parts[1], pa.binary())], ["range", "s", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.append(np.unique(shingle_hashes(word_hashes(text or ""), SHINGLE)))
                size += len(held[-1])
                if size >= _BLOCK:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _added_up(least: float):
    """mapInArrow function over rows sorted by range: (shingle, df) of the shingles in more than ``least`` documents."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        s, n = np.concatenate([np.frombuffer(a, np.uint64) for a, _ in held]), np.concatenate([np.frombuffer(b, "<u4") for _, b in held])
        order = np.argsort(s, kind="stable")
        s = s[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        df = np.add.reduceat(n[order].astype(np.int64), first)
        keep = df > least
        return pa.RecordBatch.from_arrays([pa.array(s[first][keep].view(np.int64)), pa.array(df[keep])], ["shingle", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for i, s, n in zip(*(batch.column(c).to_pylist() for c in ("range", "s", "n")), strict=True):
                if held and i != at:
                    yield flush(held)
                    held = []
                at = i
                held.append((s, n))
        if held:
            yield flush(held)

    return run


def idf(docs: DataFrame, rare: int = RARE, frequent: int = FREQUENT) -> Weights:
    """The weights over all documents. The driver gets the shingles whose df is over the rarest that counts, ``frequent`` at most."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    part, ranges = rare, max(64, size // RANGE_BYTES)
    blocks = docs.select("text").mapInArrow(_counted(ranges), "range int, s binary, n binary").repartition("range").sortWithinPartitions("range")
    rows = Scratch(docs.sparkSession, "icws-df")
    often = rows.cut(blocks.mapInArrow(_added_up(max(n / part, 1.0)), "shingle long, df long"), "often")
    while often.filter(F.col("df") > max(n / part, 1.0)).count() > frequent:
        part /= 2
    least = max(n / part, 1.0)
    held = often.filter(F.col("df") > least).toArrow()
    rows.drop()
    s, df = held.column("shingle").to_numpy().view(np.uint64), held.column("df").to_numpy()
    order = np.argsort(s)
    return Weights(s[order], np.log((1.0 + n) / (1.0 + df[order])) + 1.0, np.log((1.0 + n) / (1.0 + least)) + 1.0)


def _uniform(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform numbers in (0, 1) from each 64-bit hash."""
    scale = np.float32(2.0**-24)
    return (((x >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * scale, (((x >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * scale)


def icws(shingle: np.ndarray, weight: np.ndarray, start: np.ndarray, samples: int) -> np.ndarray:
    """Samples of each document: [documents, samples] of 64-bit values. Documents begin at ``start``; none is empty.

    For each element: r, c ~ Gamma(2, 1), b ~ U(0, 1); t = floor(ln w / r + b); the least of ln c - r (t - b) - r wins,
    and the sample is (element, t).
    """
    logw = np.log(weight.astype(np.float32))
    out = np.empty((len(start), samples), np.uint64)
    owner = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(shingle))))
    for s in range(samples):
        x = mix(shingle + np.uint64(int(_SEED) * (2 * s + 1) & 0xFFFFFFFFFFFFFFFF))
        y = mix(x ^ np.uint64(0x5851F42D4C957F2D))
        u1, u2 = _uniform(x)
        u3, u4 = _uniform(y)
        b = ((x ^ (y << np.uint64(3))) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2.0**-16)
        r = -np.log(u1 * u2)
        t = np.floor(logw / r + b)
        a = np.log(-np.log(u3 * u4)) - r * (t - b) - r
        least = np.minimum.reduceat(a, start)
        hit = np.flatnonzero(a == least[owner])
        first = hit[np.unique(owner[hit], return_index=True)[1]]
        out[:, s] = mix(shingle[first] + mix(t[first].astype(np.int64).view(np.uint64) + np.uint64(s)))
    return out


def _signed(shared: Broadcast[Weights], bands: int, rows: int):
    """mapInArrow function: content hash (two words) and band keys of each document; null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            found, same = [], []
            for text in batch.column("text").to_pylist():
                words = word_hashes(text or "")
                found.append(np.unique(shingle_hashes(words, SHINGLE), return_counts=True))
                same.append(_content(words) if len(words) else (None, None))
            keys = [None] * len(found)
            for full in _parts([len(s) for s, _ in found]):
                s = np.concatenate([found[i][0] for i in full])
                w = np.concatenate([found[i][1] for i in full]) * weights.of(s)
                start = np.concatenate(([0], np.cumsum([len(found[i][0]) for i in full])[:-1]))
                sample = icws(s, w, start, bands * rows).reshape(len(full), bands, rows)
                key = np.zeros((len(full), bands), np.uint64)
                for k in range(rows):
                    key = mix(key * _SEED + sample[:, :, k])
                key = (key + np.arange(bands, dtype=np.uint64)).view(np.int64)
                for i, k in zip(full, key, strict=True):
                    keys[i] = k.tolist()
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array([a for a, _ in same], pa.int64()), pa.array([b for _, b in same], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["row", "doc_id", "c1", "c2", "bands"])

    return run


def _parts(sizes: list[int]) -> Iterator[list[int]]:
    """The places of non-empty documents, in runs of about ``PART`` shingles; a longer document is a run of its own."""
    run, held = [], 0
    for i, n in enumerate(sizes):
        if run and held + n > PART:
            yield run
            run, held = [], 0
        if n:
            run.append(i)
            held += n
    if run:
        yield run


def _content(words: np.ndarray) -> tuple[int, int]:
    """128 bits of the sequence of words."""
    at = np.arange(1, len(words) + 1, dtype=np.uint64)
    x = mix(words + mix(at))
    return int(x.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(x ^ _SEED)).view(np.int64))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weights: Weights) -> float:
    """Weighted Jaccard: sum of least over sum of greatest weights."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float((np.minimum(a[1][i], b[1][j]) * weights.of(both)).sum(dtype=np.float64))
    every = float((a[1] * weights.of(a[0])).sum(dtype=np.float64) + (b[1] * weights.of(b[0])).sum(dtype=np.float64)) - least
    return least / every if every > 0 else 0.0


class _Set:
    """A weighted set with its occurrences told apart: the k-th one of a shingle is an element of its own."""

    __slots__ = ("each", "n", "s", "whole")

    def __init__(self, text: str, weights: Weights):
        self.s, self.n = shingles(text)
        self.each = weights.of(self.s)
        self.whole = float((self.n * self.each).sum(dtype=np.float64))


def _elements(s: np.ndarray, each: np.ndarray, low: np.ndarray, high: np.ndarray, sign: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Names and weights of the occurrences low < k <= high of each shingle, rarest first."""
    order = np.lexsort((s, -each))
    many = (high - low)[order]
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[order], many)
    return mix(np.repeat(s[order], many) * _SEED + sign + k.astype(np.uint64)), np.repeat(each[order], many).astype(np.float64)


def _prefix(name: np.ndarray, weight: np.ndarray, least: float) -> np.ndarray:
    """The first elements, up to the last one from which on they weigh ``least`` or more."""
    rest = np.cumsum(weight[::-1])[::-1]
    return name[: int(np.count_nonzero(rest >= least * (1 - 1e-6)))]


#: How a member stands to a representative: similar, near, or far.
SIMILAR, RING, FAR = 2, 1, 0
COMPARED = "doc long, leader long, sim double, plain double, stands int, away double, base double, added double, added_least double, lacking double, lacking_least double, bits array<long>, short array<long>, rest array<long>, prefix array<long>"


def _bitmap(name: np.ndarray) -> np.ndarray:
    on = np.zeros(64 * WORDS, np.uint8)
    on[(name >> np.uint64(20)).astype(np.int64) % len(on)] = 1
    return np.packbits(on).view(np.int64)


def _compared(shared: Broadcast[Weights], t: float, near: float):
    """mapInArrow function over (doc, leader, text, leader_text): similarity with and without weights, and what leads to links with others.

    short: names of the first differences, for pairs of two that are not similar to the representative and for those that
    are; rest: further ones that one which is not similar may share with one that is; prefix: names of the rarest shingles.
    """

    def one(a: _Set, b: _Set) -> tuple:
        at = np.minimum(np.searchsorted(b.s, a.s), len(b.s) - 1)
        hit = b.s[at] == a.s
        of_b, of_a = np.zeros(len(a.s), np.int64), np.zeros(len(b.s), np.int64)
        of_b[hit], of_a[at[hit]] = b.n[at[hit]], a.n[hit]
        least = float((np.minimum(a.n, of_b) * a.each).sum(dtype=np.float64))
        every = a.whole + b.whole - least
        sim = least / every if every > 0 else 0.0
        common = int(np.minimum(a.n, of_b).sum())
        even = common / max(int(a.n.sum() + b.n.sum()) - common, 1)  # all weights alike
        plain = _prefix(*_elements(a.s, a.each, np.zeros_like(a.n), a.n, np.uint64(0)), t * a.whole)
        if sim < near:
            return sim, even, FAR, 0.0, b.whole, 0.0, 0.0, 0.0, 0.0, np.zeros(2 * WORDS, np.int64), plain[:0], plain[:0], plain
        more, less = np.flatnonzero(a.n > of_b), np.flatnonzero(b.n > of_a)
        (x, wx), (y, wy) = _elements(a.s[more], a.each[more], of_b[more], a.n[more], _ADDED), _elements(b.s[less], b.each[less], of_a[less], b.n[less], _LACKING)
        away = float(wy.sum() + t * wx.sum())
        name, weight = np.concatenate([x, y]), np.concatenate([wx, wy])
        short = _prefix(name, weight, max(away / (1 + t), 1e-9))
        rest = short[:0] if sim >= t else _prefix(name, weight, max(away - (1 - t) * b.whole, 1e-9))[len(short) :]
        low = lambda w: float(w.min()) if len(w) else 0.0
        return sim, even, SIMILAR if sim >= t else RING, away, b.whole, float(wx.sum()), low(wx), float(wy.sum()), low(wy), np.concatenate([_bitmap(x), _bitmap(y)]), short, rest, plain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, _Set] = {}
        weights, names = shared.value, [f.split()[0] for f in COMPARED.split(", ")]
        for batch in batches:
            out = []
            for lead, text, other in zip(*(batch.column(c).to_pylist() for c in ("leader", "text", "leader_text")), strict=True):
                if lead not in known:
                    if len(known) >= 32:
                        known.clear()
                    known[lead] = _Set(other, weights)
                out.append(one(_Set(text, weights), known[lead]))
            cols = [pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.int32())] + [pa.array([x[k] for x in out], pa.float64()) for k in range(3, 9)]
            cols += [pa.array([x[k].view(np.int64) for x in out], pa.list_(pa.int64())) for k in range(9, 13)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("leader"), *cols], names)

    return run


def _may_link(x: str, y: str, t: float):
    """Whether the common differences of two members of one bucket can weigh enough for a link."""
    col = lambda side, c: F.col(f"{side}.{c}")

    def alone(a: str, b: str, first: int):  # bits of a that b does not have
        return sum((F.bit_count(col(a, "bits")[i].bitwiseAND(F.bitwise_not(col(b, "bits")[i]))) for i in range(first, first + WORDS)), F.lit(0))

    def most(a: str, b: str):
        return col(a, "added") - col(a, "added_least") * alone(a, b, 0) + col(a, "lacking") - col(a, "lacking_least") * alone(a, b, WORDS)

    need = (col(x, "away") + col(y, "away") - (1 - t) * col(x, "base")) / (1 + t) * (1 - 1e-5)
    return (most(x, y) >= need) & (most(y, x) >= need)


def _met(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by sorting. The rounds join dozens of small tables; broadcast, each of them would be collected and built as a table
    in the driver, which then holds many at a time."""
    return a.join(b.hint("merge"), on, how)


def similar_pairs(node: DataFrame, texts: DataFrame, weights: Weights, scratch: Scratch, threshold: float = THRESHOLD, near: float = NEAR) -> DataFrame:
    """Compared pairs (doc, leader, sim) that link the similar members of every bucket. ``node``: doc, bands; ``texts``: doc, text."""
    sent = scratch.spark.sparkContext.broadcast(weights)  # once, not with the function of every round
    member = node.select("doc", F.explode("bands").alias("key"))
    size = member.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    member = scratch.cut(_met(member, size, "key"), "members")
    # representatives are those that share most buckets with others; a number that tells that, and the document, in one
    rank = F.shiftleft(F.least(F.sum("n"), F.lit(1 << 20)), 42).bitwiseOR(F.xxhash64("doc").bitwiseAND(F.lit((1 << 42) - 1)))
    central = scratch.cut(member.groupBy("doc").agg(rank.alias("rank")), "central")
    # the texts of documents that share a bucket, taken out of the corpus once
    texts = scratch.cut(_met(texts, central.select("doc"), "doc", "left_semi"), "texts")

    def led(rows: DataFrame) -> DataFrame:
        """(chain, doc, leader): every member of a group (chain, key) and its representative. ``rows``: chain, key, doc, rank."""
        lead = rows.groupBy("chain", "key").agg(F.max("rank").alias("top"), F.count("*").alias("n")).filter(F.col("n") > 1).drop("n")
        told = _met(rows, lead, ["chain", "key"]).select("chain", "doc", "top").distinct()
        return _met(told, central.select(F.col("doc").alias("leader"), F.col("rank").alias("top")), "top").filter(F.col("doc") != F.col("leader")).select("chain", "doc", "leader")

    def spread(rows: DataFrame, *names: str) -> DataFrame:
        """Rows dealt out so that no task names more than about ``NAMES`` of their array elements."""
        many = rows.agg(F.sum(sum((F.size(c) for c in names), F.lit(0)))).first()[0] or 0
        return rows.repartition(many // NAMES + 1, "doc")

    def compared(ask: DataFrame, name: str, texts: DataFrame, told: DataFrame | None = None) -> DataFrame:
        if told is not None:
            ask = _met(ask, told.select("doc", "leader"), ["doc", "leader"], "left_anti")
        ask = _met(_met(ask, texts, "doc"), texts.select(F.col("doc").alias("leader"), F.col("text").alias("leader_text")), "leader")
        return scratch.cut(ask.select("doc", "leader", "text", "leader_text").mapInArrow(_compared(sent, threshold, near), COMPARED), name)

    # rounds: members of a group against its representative; those far from it are grouped by their rarest shingles, and each such
    # group goes on with those far from its representative. It does not split again: all that share its shingle are in it. Once the
    # pairs of all groups are no more than the members of the first round, they are compared at once
    group = _met(member, central, "doc").select(F.lit(0).cast("long").alias("chain"), "key", "doc", "rank")
    apart = 1 - threshold + 1e-6
    tried = lambda: scratch.all_of(tables, COMPARED)
    ways = F.array(F.struct("doc", "leader"), F.struct(F.col("leader").alias("doc"), F.col("doc").alias("leader")))
    either = lambda: tried().select(F.inline(ways))
    tables, parts, k, first, open_texts = [], [], 0, 0, texts
    while True:
        # groups of the same members are one
        of_group = [F.max("rank").alias("top"), F.count("*").alias("n"), *[F.bit_xor(F.xxhash64("doc", F.lit(i))).alias(c) for i, c in enumerate("xy")]]
        lead = group.groupBy("chain", "key").agg(*of_group).filter(F.col("n") > 1).groupBy("chain", "top", "n", "x", "y").agg(F.min("key").alias("key")).select("chain", "key", "top", "n")
        leader = central.select(F.col("doc").alias("leader"), F.col("rank").alias("top"))
        held = scratch.cut(_met(_met(group, lead, ["chain", "key"]), leader, "top").filter(F.col("doc") != F.col("leader")).select("chain", "key", "doc", "rank", "leader", "n"), f"told{k}")
        rows, ends = held.agg(F.count("*"), F.sum("n")).first()
        if not rows:
            break
        first = first or rows
        told = held.select("chain", "doc", "leader").distinct()
        if k:  # later rounds compare few documents: only their texts are dealt out
            asked = told.select("doc").unionByName(told.select(F.col("leader").alias("doc"))).distinct()
            open_texts = scratch.cut(_met(open_texts, asked, "doc", "left_semi"), f"texts{k}")
        if k and ends <= 2 * first:
            each = held.select("chain", "key", "doc").unionByName(held.select("chain", "key", F.col("leader").alias("doc")).distinct())
            ask = _met(each, each.withColumnRenamed("doc", "leader"), ["chain", "key"]).filter("doc < leader").select("doc", "leader").distinct()
            compared(ask, "pairs", open_texts, either())
            tables.append("pairs")
            break
        compared(told.select("doc", "leader").distinct(), f"compared{k}", open_texts, tried() if tables else None)
        tables.append(f"compared{k}")
        seen = _met(told, tried(), ["doc", "leader"]).withColumn("chain", F.xxhash64("chain", "leader", F.lit(k)))
        open_ = seen.groupBy("chain").agg(F.min("stands").alias("least"), F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("least") < SIMILAR)).select("chain")
        parts.append(f"seen{k}")
        others = scratch.cut(_met(_met(seen, open_, "chain"), central, "doc"), f"seen{k}")
        kind = others.schema
        if k:
            group = _met(held, tried().filter(F.col("stands") == FAR).select("doc", "leader"), ["doc", "leader"]).select("chain", "key", "doc", "rank")
        else:
            others = others.filter(F.col("stands") == FAR).select("chain", "doc", "rank", "prefix")
            others = _met(others, others.groupBy("chain").count().filter("count > 1").select("chain"), "chain", "left_semi")
            group = spread(others, "prefix").select("chain", "doc", "rank", F.explode("prefix").alias("key"))
        k += 1
    if not tables:
        return node.sparkSession.createDataFrame([], "doc long, leader long, sim double")
    seen = scratch.all_of(parts, kind)
    kin = spread(seen.filter(F.col("stands") == RING).select("chain", "doc", "rank", "short"), "short").select("chain", "doc", "rank", F.explode("short").alias("key"))
    compared(led(kin).select("doc", "leader").distinct(), "families", texts, tried())
    tables.append("families")
    linked = F.greatest("sim", "plain") >= threshold
    links = lambda: tried().filter(linked).select("doc", "leader", "sim")
    classes = lambda of, name: _met(central.select("doc"), components(of, Scratch(scratch.spark, f"icws-{name}")), "doc", "left").select("doc", F.coalesce("class", "doc").alias("class"))

    def merged(of: DataFrame, links: DataFrame) -> DataFrame:
        """Classes after the links of a turn, which are stars: each goes to the least class that it is linked with, and on to the
        least that this one is linked with. Chains may stay apart here; only pairs that need not be compared depend on it."""
        a, b = of.select("doc", F.col("class").alias("a")), of.select(F.col("doc").alias("leader"), F.col("class").alias("b"))
        links = _met(_met(links, a, "doc"), b, "leader").filter("a != b").select("a", "b").distinct()
        links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = links.groupBy("a").agg(F.least("a", F.min("b")).alias("to"))
        to = _met(to, to.select(F.col("a").alias("to"), F.col("to").alias("far")), "to").select(F.col("a").alias("class"), "far")
        return _met(of, to, "class", "left").select("doc", F.coalesce("far", "class").alias("class"))

    of = scratch.cut(classes(links(), "families"), "classes")
    seen = _met(seen, of, "doc").drop("rank")
    # only groups of several classes that hold both sides of a pair are named
    far, ring = F.col("stands") == FAR, F.col("stands") == RING
    to_ring, to_far = far & (F.col("sim") >= near - apart), ring & (F.col("sim") <= near + apart)
    sides = seen.groupBy("chain").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max(ring).alias("has_ring"), (F.max(to_ring) & F.max(to_far)).alias("has_both"))
    sides = sides.filter("low < high and has_ring").drop("low", "high", "has_ring")
    seen = scratch.cut(_met(seen, sides, "chain"), "classes-so-far")
    # joined by shared names, between classes; first only the names, then what the bounds need
    named = lambda c, kind, use: spread(seen.filter(kind).select("chain", "doc", "class", c), c).select("chain", "doc", "class", F.lit(use).alias("use"), F.explode(c).alias("key"))
    rows = named("short", ~far, 0).unionByName(named("rest", ring, 1))
    rows = rows.unionByName(named("prefix", to_ring & F.col("has_both"), 2)).unionByName(named("prefix", to_far & F.col("has_both"), 3))
    shared = rows.groupBy("chain", (F.col("use") >= 2).alias("whole"), "key").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("chain", "whole", "key")
    rows = scratch.cut(_met(rows.withColumn("whole", F.col("use") >= 2), shared, ["chain", "whole", "key"], "left_semi"), "shared")
    wide = seen.select("chain", "doc", "stands", "sim", "away", "base", "added", "added_least", "lacking", "lacking_least", "bits")
    # turns: the members that share a name against one of them, another one in each turn, while classes grow together
    for turn in range(TURNS):
        now = _met(rows.filter(~F.col("whole")).select("chain", "key", "doc"), of, "doc")
        first = F.min(F.struct(F.xxhash64("doc", F.lit(turn)).alias("at"), F.col("doc").alias("leader"), F.col("class").alias("led"))).alias("first")
        lead = now.groupBy("chain", "key").agg(first, F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("chain", "key", "first.leader", "first.led")
        star = _met(now, lead, ["chain", "key"]).filter("class != led").select("chain", "doc", "leader").distinct().alias("s")
        x, y = wide.alias("x"), wide.alias("y")
        star = _met(_met(star, x, (F.col("s.chain") == F.col("x.chain")) & (F.col("s.doc") == F.col("x.doc"))), y, (F.col("s.chain") == F.col("y.chain")) & (F.col("s.leader") == F.col("y.doc")))
        star = star.filter((F.abs(F.col("x.sim") - F.col("y.sim")) <= apart) & _may_link("x", "y", threshold)).select("s.doc", "s.leader").distinct()
        done = compared(star, f"turn{turn}", texts, either())
        link = done.filter(linked).select("doc", "leader", "sim")
        n, hits = done.agg(F.count("*"), F.count_if(linked)).first()
        tables.append(f"turn{turn}")
        if hits:
            of = scratch.cut(merged(of, link), f"classes{turn}")
        if hits <= n * WORTH:
            break
    rows = _met(_met(rows.drop("class"), of, "doc"), wide, ["chain", "doc"])
    x, y = rows.alias("x"), rows.alias("y")
    other = (F.col("x.chain") == F.col("y.chain")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.class") != F.col("y.class")) & (F.abs(F.col("x.sim") - F.col("y.sim")) <= apart)
    of_ring = (F.col("y.stands") == SIMILAR) | (F.col("x.use") == 0) & (F.col("x.doc") < F.col("y.doc"))
    near_pair = _met(x.filter((F.col("stands") == RING) & (F.col("use") <= 1)), y.filter(F.col("use") == 0), other & of_ring & _may_link("x", "y", threshold))
    far_pair = _met(x.filter(F.col("use") == 2), y.filter(F.col("use") == 3), other)
    pair = [F.col("x.doc").alias("doc"), F.col("y.doc").alias("leader")]
    ask = scratch.cut(near_pair.select(*pair).unionByName(far_pair.select(*pair)).distinct(), "ask")
    compared(ask, "last", texts, either())
    tables.append("last")
    return links()


def components(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, class): the least node of each connected component of the pairs, by label propagation with jumps."""
    edge = pairs.select(F.col("doc").alias("a"), F.col("leader").alias("b"))
    edge = scratch.cut(edge.unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = scratch.cut(edge.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")), "label0")
    k = 0
    while True:
        to = label.select(F.col("a").alias("b"), F.col("label").alias("seen"))
        near = _met(edge, to, "b").groupBy("a").agg(F.min("seen").alias("seen"))
        step = _met(label, near, "a").select("a", "label", F.least("label", "seen").alias("next"))
        jump = label.select(F.col("a").alias("next"), F.col("label").alias("far"))
        step = scratch.cut(_met(step, jump, "next").select("a", "label", F.least("next", "far").alias("next")), f"label{k + 1}")
        if step.filter(F.col("label") != F.col("next")).isEmpty():
            break
        label = step.select("a", F.col("next").alias("label"))
        k += 1
    return step.select(F.col("a").alias("doc"), F.col("next").alias("class"))


def near_duplicates(docs: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(the documents with a ``_row``, a verdict for each row): _row, doc_id, class_id, class_size (its documents), kept (one row
    of each class)."""
    small_batches(docs.sparkSession)
    docs = scratch.cut(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    text = docs.select(F.col("_row").alias("row"), F.col("doc_id").cast("long"), "text")
    weights = idf(text)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    each = scratch.cut(text.mapInArrow(_signed(shared, bands, rows), "row long, doc_id long, c1 long, c2 long, bands array<long>"), "signed")
    # a node for each different text, named by its first row; a text without words is a node of its own
    node = scratch.cut(each.filter(F.col("c1").isNotNull()).groupBy("c1", "c2", "bands").agg(F.min("row").alias("doc")), "nodes")
    pairs = similar_pairs(node.select("doc", "bands"), text.select(F.col("row").alias("doc"), "text"), weights, scratch, threshold)
    of = _met(each.select("row", "doc_id", "c1", "c2"), node.select("c1", "c2", "doc"), ["c1", "c2"], "left").select("row", "doc_id", F.coalesce("doc", "row").alias("doc"))
    of = scratch.cut(of, "of")
    one_id = of.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("doc").alias("leader"), F.max("doc").alias("last")).filter("leader < last")
    same_id = _met(of, one_id, "doc_id").filter(F.col("doc") != F.col("leader")).select("doc", "leader").distinct()
    found = components(pairs.select("doc", "leader").unionByName(same_id), scratch)
    of = scratch.cut(_met(of, found, "doc", "left").select("row", "doc_id", F.coalesce("class", "doc").alias("class")), "classes")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row")))
    # rows of one id count once: the first of its rows stands for it
    first = of.groupBy("class", F.coalesce(F.col("doc_id"), -1 - F.col("row")).alias("id"), F.col("doc_id").isNull().alias("none")).agg(F.min("row").alias("row"), F.min("doc_id").alias("doc_id"))
    head = first.groupBy("class").agg(F.count("*").alias("class_size"), head.alias("head"))
    out = _met(of, head, "class").select(F.col("row").alias("_row"), "doc_id", F.col("head.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("head.row")).alias("kept"))
    return docs, out


def op9_icws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "icws"))[1].drop("_row")
