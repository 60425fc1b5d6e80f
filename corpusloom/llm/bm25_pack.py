"""Packing by lexical retrieval: a sharded BM25 inverted index fills each seed document's window with its neighbours.

Terms are token ids, so the vocabulary and the table of document frequencies have a fixed size however large the corpus
is. Frequencies are counted over all documents. The index is sharded by content: a tree of halving hyperplanes, fitted on a
sample of about ``SAMPLE`` documents (projected to ``DIMS`` numbers), gives every document a key, the documents are
range-partitioned and sorted by it, and a shard is a run of at most ``SHARD_DOCS`` documents and ``SHARD_TOKENS`` tokens (or
one document) of that order. Documents of one language and subject, and copies, so meet in a shard wherever they stood in the
table; a key that very many documents share is split by what follows it in the order. Each task indexes one shard at a time,
so memory is bounded by a shard. In a shard every unused document in turn is a seed: all its terms query the postings of all
the shard's documents, with exact BM25 scores, and the unused neighbours with the best scores follow it
until the window of ``WINDOW`` tokens is full. What does not fit is cut and opens the next window, whose neighbours are
sought for the document that was cut. Once nothing scores, the next unused document of the shard follows. All windows but
a shard's last are therefore full; the last is cut into sequences whose lengths are powers of two, so there is no padding.

Tokens are those of the byte-level BPE file; a special token's string in a text is that token, as the file says. Each
document ends in id 1. Tokens, keys and counts are computed in one pass, tokens kept as two bytes each in a written table. The index is exact over its
shard: every document is in it.

Defined results: a null or empty text is its one end token; rows that repeat are documents of their own; a null doc_id is
a value; a text longer than a window spans several; an empty table gives an empty result; columns other than doc_id and
text are ignored; equal scores go to the earlier document of the order.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read, small_batches

WINDOW = 2048
END_ID = 1
IDS = 1 << 16
SHARD_DOCS = 4096
SHARD_TOKENS = 4_000_000
#: Tokens of a partition where there are enough for two partitions a core.
PART_TOKENS = 8 * SHARD_TOKENS
#: Documents, as expected, that the tree of hyperplanes is fitted on, its depth, numbers of a projection, sign bits after a leaf.
SAMPLE = 4096
DEPTH = 8
DIMS = 128
BITS = 24
#: Terms in this share of a shard's documents or more are scored by matrix products, the others by postings.
DENSE = 1 / 16
K1, B = 1.2, 0.75
NAME = "byte_bpe_50k.json"


def tokenizer_path(name: str = NAME) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """The ids of a byte-level BPE file. Texts without a special token's string go through the faster of two equal codecs."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        # the printable characters that byte-level BPE files write for bytes
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.special = [t["content"] for t in model["added_tokens"]]
        ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in self.special}
        import public_tokenizers

        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text)

    def document(self, text: str | None) -> np.ndarray:
        """Two bytes an id, with the end id."""
        ids = self(text or "")
        out = np.empty(len(ids) + 1, "<u2")
        out[:-1], out[-1] = ids, END_ID
        return out


def _encoded(path: str):
    """Rows (ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or Encoder(path)
            yield pa.RecordBatch.from_arrays([pa.array([encode.document(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], ["ids"])

    return run


class Counts:
    """In how many documents each id is, how many documents and tokens there are."""

    def __init__(self):
        self.df, self.n, self.size = np.zeros(IDS, np.int64), 0, 0

    def add(self, term: np.ndarray, size: int) -> None:
        self.df[term] += 1
        self.n, self.size = self.n + 1, self.size + size

    def row(self) -> list[pa.Array]:
        return [pa.array([self.df.astype("<i8").tobytes()], pa.binary()), pa.array([self.n], pa.int64()), pa.array([self.size], pa.int64())]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of one task."""
    counts = Counts()
    for batch in batches:
        for raw in batch.column("ids").to_pylist():
            x = np.frombuffer(raw, "<u2")
            counts.add(np.unique(x), len(x))
    yield pa.RecordBatch.from_arrays(counts.row(), ["df", "n", "size"])


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n, size = np.zeros(IDS, np.int64), 0, 0
    for batch in batches:
        for raw in batch.column("df").to_pylist():
            total = total + np.frombuffer(raw, "<i8")
        n += sum(batch.column("n").to_pylist())
        size += sum(batch.column("size").to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["df", "n", "size"])


_COUNTS = "df binary, n long, size long"


def statistics(counts: DataFrame) -> tuple[np.ndarray, float, int]:
    """BM25 idf of each id, the mean length and the number of tokens, from the tasks' counts; the driver adds up a fixed number of fixed-size rows."""
    part = counts.repartition(16).mapInArrow(_total, _COUNTS).collect()
    df, n, size = sum(np.frombuffer(r["df"], "<i8") for r in part), sum(r["n"] for r in part), sum(r["size"] for r in part)
    return np.log(1.0 + (n - df + 0.5) / (df + 0.5)).astype(np.float32), max(size / max(n, 1), 1.0), size


def weights(x: np.ndarray, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a document and their BM25 weights."""
    term, tf = np.unique(x, return_counts=True)
    return term, (idf[term] * (tf * np.float32(K1 + 1) / (tf + np.float32(K1 * (1 - B + B * len(x) / mean))))).astype(np.float32)


# ---- routing by content ----------------------------------------------------------------------------------------


def _vectors(idf: np.ndarray, mean: float):
    """A function from ids to their terms and the unit vector of their projected weights."""
    signs = (np.random.default_rng(3).integers(0, 2, (IDS, DIMS), np.int8) * 2 - 1).astype(np.float32)

    def of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        term, w = weights(x, idf, mean)
        v = w @ signs[term]
        return term, v / max(float(np.sqrt(v @ v)), 1e-9)

    return of


def fit_tree(sample: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions and thresholds of a complete binary tree's nodes, in heap order, and the means of its leaves.

    Each node halves its part of the sample at the median along the direction of its greatest variance.
    """
    nodes, leaves = (1 << depth) - 1, 1 << depth
    way, cut, mean = np.zeros((nodes, DIMS), np.float32), np.zeros(nodes, np.float32), np.zeros((leaves, DIMS), np.float32)
    held = {0: sample}
    for node in range(nodes):
        x = held.pop(node)
        if len(x) > 1:
            away = x - x.mean(axis=0)
            way[node] = np.linalg.eigh(away.T @ away)[1][:, -1]
            cut[node] = np.median(x @ way[node])
        right = x @ way[node] > cut[node]
        held[2 * node + 1], held[2 * node + 2] = x[~right], x[right]
    for leaf in range(leaves):
        x = held[nodes + leaf]
        if len(x):
            mean[leaf] = x.mean(axis=0)
    return way, cut, mean


def keys_of(v: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """For each vector the leaf that it falls into, then the signs of its differences from the leaf's mean."""
    way, cut, mean = tree
    right = v @ way.T > cut
    node, rows = np.zeros(len(v), np.int64), np.arange(len(v))
    for _ in range(len(mean).bit_length() - 1):
        node = 2 * node + 1 + right[rows, node]
    leaf = node - len(way)
    return leaf << BITS | (v[:, :BITS] > mean[leaf, :BITS]) @ (1 << np.arange(BITS)[::-1])


def _sampled(idf: np.ndarray, mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = None
        for batch in batches:
            of = of or _vectors(idf, mean)
            yield pa.RecordBatch.from_arrays([pa.array([of(np.frombuffer(raw, "<u2"))[1].tobytes() for raw in batch.column("ids").to_pylist()], pa.binary())], ["v"])

    return run


def fitted(docs: DataFrame, scratch: Scratch, path: str) -> tuple[np.ndarray, float, tuple]:
    """What routes documents, from about ``SAMPLE`` of them: idf and mean length of the sample, and its tree."""
    share = int(min(1.0, SAMPLE / max(docs.count(), 1)) * (1 << 62))
    rows = docs.select("text", F.xxhash64(F.monotonically_increasing_id()).bitwiseAND((1 << 62) - 1).alias("draw")).filter(F.col("draw") <= share)
    sample = scratch.cut(rows.select("text").mapInArrow(_encoded(path), "ids binary"), "sample")
    idf, mean, _ = statistics(sample.mapInArrow(_frequencies, _COUNTS))
    found = sample.mapInArrow(_sampled(idf, mean), "v binary").collect()
    return idf, mean, fit_tree(np.stack([np.frombuffer(r["v"], np.float32) for r in found]) if found else np.zeros((0, DIMS), np.float32))


_TOKENS = "doc_id long, ids binary, route long, df binary, n long, size long"


def _routed(path: str, idf: np.ndarray, mean: float, tree: tuple):
    """Documents as (doc_id, ids, route), then one row (df, n, size) of what the task has counted."""
    blank = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    names = ["doc_id", "ids", "route", "df", "n", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, of, counts = None, None, Counts()
        for batch in batches:
            if not batch.num_rows:
                continue
            encode, of = encode or Encoder(path), of or _vectors(idf, mean)
            ids, v = [], np.zeros((batch.num_rows, DIMS), np.float32)
            for i, text in enumerate(batch.column("text").to_pylist()):
                x = encode.document(text)
                term, v[i] = of(x)
                counts.add(term, len(x))
                ids.append(x.tobytes())
            rows = [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(keys_of(v, tree), pa.int64())]
            yield pa.RecordBatch.from_arrays([*rows, *[pa.nulls(len(ids), t) for t in blank[3:]]], names)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in blank[:3]], *counts.row()], names)

    return run


def by_content(tokens: DataFrame, size: int) -> DataFrame:
    """The documents in the order of their keys (equal ones by text and id), over partitions by tokens."""
    rows = tokens.filter(F.col("route").isNotNull()).select("doc_id", "ids", "route", F.monotonically_increasing_id().alias("row"))
    parts = max(1, min(-(-size // SHARD_TOKENS), max(2 * tokens.sparkSession.sparkContext.defaultParallelism, -(-size // PART_TOKENS))))
    order = ["route", F.xxhash64("ids"), "doc_id", "row"]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids")


# ---- one shard -------------------------------------------------------------------------------------------------


class Shard:
    """The inverted index of a shard: postings of all terms of all its documents, with BM25 weights.

    A document's score for a seed is the sum of its weights of the seed's terms. Terms in many of the shard's documents are
    added up for all seeds at once, as products of blocks of matrices; the others by the seed's postings.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = len(docs)
        found = [weights(x, idf, mean) for x in docs]
        count = np.array([len(t) for t, _ in found])
        owner, term, weight = np.repeat(np.arange(self.n, dtype=np.int32), count), np.concatenate([t for t, _ in found]), np.concatenate([w for _, w in found])
        del found
        df = np.bincount(term, minlength=IDS)
        common = df >= max(DENSE * self.n, 2)
        self.base = np.zeros((self.n, self.n), np.float32)
        place = np.cumsum(common) - 1
        inside = common[term]
        column = place[term[inside]]
        order = np.argsort(column, kind="stable")
        column, row, value = column[order], owner[inside][order], weight[inside][order]
        for a in range(0, int(common.sum()), 512):
            s, e = np.searchsorted(column, (a, a + 512))
            w = np.zeros((self.n, 512), np.float32)
            w[row[s:e], column[s:e] - a] = value[s:e]
            self.base += (w > 0).astype(np.float32) @ w.T
        keep = ~inside & (df[term] > 1)  # a term of one document finds no other
        owner, term, weight = owner[keep], term[keep], weight[keep]
        self.terms, self.own = term, np.searchsorted(owner, np.arange(self.n + 1))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = owner[order], weight[order]
        self.at = np.searchsorted(term[order], np.arange(IDS + 1))
        self.free = np.ones(self.n, bool)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all documents for a seed's terms."""
        t = self.terms[self.own[seed] : self.own[seed + 1]]
        a = self.at[t]
        n = self.at[t.astype(np.int64) + 1] - a
        at = np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)
        return self.base[seed] + np.bincount(self.doc[at], self.weight[at], self.n).astype(np.float32)

    def ranked(self, seed: int) -> Iterator[int]:
        """Unused neighbours of a seed, best score first (ties: the earlier document)."""
        score = self.scores(seed)
        score[~self.free] = 0
        k = 8
        while k:  # the best few are enough as a rule
            hit = np.flatnonzero(score > 0)
            if not len(hit):
                return
            top = hit[np.argpartition(-score[hit], k)[:k]] if len(hit) > k else hit
            for d in top[np.lexsort((top, -score[top]))]:
                if self.free[d]:
                    yield int(d)
            score[top] = 0
            k *= 4


def pack(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset): all windows full but for the last, cut into powers of two."""
    shard, out = Shard(docs, idf, mean), []
    seq, room, following, cursor = 0, window, None, 0
    left = shard.n
    seed, at = None, 0
    while left or seed is not None:
        if seed is None:  # the next document: the best neighbour of the window's seed, or else the first unused one
            d = next(following, None) if following is not None and room < window else None
            if d is None:
                while not shard.free[cursor]:
                    cursor += 1
                d = cursor
                following = shard.ranked(d)
            shard.free[d] = False
            left -= 1
            seed, at = d, 0
        take = min(room, len(docs[seed]) - at)
        out.append((seed, at, take, seq, window - room))
        at, room = at + take, room - take
        if not room:
            seq, room = seq + 1, window
            if at < len(docs[seed]):
                following = shard.ranked(seed)  # the rest of a cut document is the seed of the next window
        if at == len(docs[seed]):
            seed = None
    if room == window or not out:
        return out
    tail = [p for p in out if p[3] == seq]
    out, size = out[: -len(tail)], window - room
    for d, start, n, _, _ in tail:  # the last window as powers of two, largest first
        while n:
            block = 1 << (size.bit_length() - 1)
            used = tail_used(out, seq)
            take = min(n, block - used)
            out.append((d, start, take, seq, used))
            start, n = start + take, n - take
            if used + take == block:
                seq, size = seq + 1, size - block
    return out


def tail_used(out: list[tuple], seq: int) -> int:
    return out[-1][4] + out[-1][2] if out and out[-1][3] == seq else 0


def _packed(idf: np.ndarray, mean: float, window: int, shard_docs: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, ids, size = None, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal base, held, ids, size
            pieces = pack(held, idf, mean, window)
            wide = [x.astype("<u4") for x in held]
            cols = [
                pa.array([ids[p[0]] for p in pieces], pa.int64()), pa.array([p[1] for p in pieces], pa.int64()), pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([zlib.crc32(wide[p[0]][p[1] : p[1] + p[2]]) for p in pieces], pa.int64()), pa.array([len(held[p[0]]) for p in pieces], pa.int64()),
                pa.array([base + p[3] for p in pieces], pa.int64()), pa.array([p[4] for p in pieces], pa.int64()),
            ]
            base += pieces[-1][3] + 1
            held, ids, size = [], [], 0
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            if base is None and batch.num_rows:  # the partition's number; the task's own would repeat where partitions are chained
                base = batch.column("uid")[0].as_py() >> 33 << 36
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                x = np.frombuffer(raw, "<u2")
                if held and (len(held) >= shard_docs or size + len(x) > shard_tokens):
                    yield flush()
                held.append(x)
                ids.append(doc)
                size += len(x)
        if held:
            yield flush()

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, scratch: Scratch, path: str | None = None, window: int = WINDOW, shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece (``PIECES``): sequences of at most ``window`` tokens, each token of each document once."""
    small_batches(docs.sparkSession)
    path = path or tokenizer_path()
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    tokens = scratch.cut(docs.mapInArrow(_routed(path, *fitted(docs, scratch, path)), _TOKENS), "tokens")
    idf, mean, size = statistics(tokens.filter(F.col("df").isNotNull()).select("df", "n", "size"))
    rows = by_content(tokens, size).withColumn("uid", F.monotonically_increasing_id())
    return rows.mapInArrow(_packed(idf, mean, window, shard_docs, shard_tokens), PIECES)


def op3_bm25_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), Scratch(spark, "pack"))
