"""Files of 16-bit tokens as Spark data sources.

``token_files`` scans flat little-endian files by byte ranges, so one file of any size is read by many tasks, a block of
tokens a row: file, start (in the file), at (in the stream of all files in order of their names, shards by number), tokens. The options
``from`` and ``to`` are positions of the stream that reach the scan: ranges without one of its blocks are no partitions, and
blocks outside are not read. (They are not pushed as filters, as Spark 4.1 shares what was pushed among all scans of a
relation, so a frame that is filtered twice would lose rows.) The source writes such files as well: rows (file, start,
tokens) in order, each file by one task under a temporary name; the commit moves whole files to their places and then puts
the manifest, which is what makes them count.

``file_parts`` gives digests of byte ranges, or of whole files as a stream (option ``whole``); ``tree_digest`` joins the
digests of ordered parts.

Files are reached with ``pyarrow.fs``, which knows local files and the usual stores.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Tokens of a block, which is a row.
BLOCK = 1 << 16
#: Bytes of a range, which is a task.
RANGE_BYTES = 64 << 20
_CHUNK_BLOCKS = 16
_MANIFEST = "_manifest.json"
_EVERY = 1 << 62


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def stream_order(name: str) -> str:
    """What file names sort by: the number after ``_ext_`` counts as a number, as shard 1000 comes after 999 and not after 100."""
    return re.sub(r"_ext_(\d+)", lambda m: f"_ext_{m[1]:0>20}", name)


def listed(path: str, pattern: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    """Data files of a folder (or the file itself) in order of their names, shards by number; a manifest decides what counts."""
    fs, root = located(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return fs, [info]
    found = [i for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.File and i.base_name[0] not in "_."]
    if fs.get_file_info(f"{root}/{_MANIFEST}").type == pafs.FileType.File:
        known = {f["file"] for f in manifest(path)["files"]}
        found = [i for i in found if i.base_name in known]
    return fs, sorted((i for i in found if any(fnmatch(i.base_name, p) for p in pattern.split(","))), key=lambda i: stream_order(i.base_name))


def manifest(path: str) -> dict:
    """What a folder of token files holds: files with tokens, bytes and SHA-256."""
    fs, root = located(path)
    with fs.open_input_stream(f"{root}/{_MANIFEST}") as f:
        return json.loads(f.read())


class _Range(InputPartition):
    def __init__(self, path: str, file: str, base: int, start: int, end: int):
        self.path, self.file, self.base, self.start, self.end = path, file, base, start, end


class TokenReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.pattern = options["path"], options.get("files", "*.bin")
        self.range = max(1, int(options.get("rangeBytes", RANGE_BYTES)) // (2 * BLOCK)) * BLOCK
        self.low, self.high = int(options.get("from", 0)), int(options.get("to", _EVERY))

    def partitions(self) -> Sequence[_Range]:
        _, infos = listed(self.folder, self.pattern)
        out, base = [], 0
        for info in infos:
            if info.size % 2:
                raise ValueError(f"{info.path}: not a whole number of tokens")
            size = info.size // 2
            low, high = max(self.low - base, 0), min(self.high - base, size)
            for start in range(0, size, self.range):
                first, end = max(start, low // BLOCK * BLOCK), min(start + self.range, -(-high // BLOCK) * BLOCK, size)
                if first < end:
                    out.append(_Range(info.path, info.base_name, base, first, end))
            base += size
        return out

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        fs, _ = located(self.folder)
        with fs.open_input_file(part.path) as f:
            for at in range(part.start, part.end, _CHUNK_BLOCKS * BLOCK):
                n = min(part.end, at + _CHUNK_BLOCKS * BLOCK) - at
                ids = np.frombuffer(f.read_at(2 * n, 2 * at), "<u2").astype(np.int32)
                if len(ids) != n:
                    raise ValueError(f"{part.path} is shorter than it was")
                edge = np.append(np.arange(0, n, BLOCK), n)
                start = at + edge[:-1]
                tokens = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array([part.file] * len(start)), pa.array(start, pa.int64()), pa.array(part.base + start, pa.int64()), tokens], ["file", "start", "at", "tokens"])


@dataclass
class _Written(WriterCommitMessage):
    files: list


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        fs, root = located(self.folder)
        fs.create_dir(f"{root}/_temporary/{self.job}")

    def _old(self) -> list[dict]:
        fs, root = located(self.folder)
        return manifest(self.folder)["files"] if fs.get_file_info(f"{root}/{_MANIFEST}").type == pafs.FileType.File else []

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = located(self.folder)
        out, name, made = None, None, []
        try:
            for batch in batches:
                col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                for k in range(batch.num_rows):
                    file, start = col["file"][k].as_py(), col["start"][k].as_py()
                    ids = col["tokens"][k].values.to_numpy(zero_copy_only=False)
                    if file != name:
                        if file is None or "/" in file or file in {m["file"] for m in made}:
                            raise ValueError(f"rows of {file} must be together, and its name plain")
                        if out:
                            out.close()
                        name, digest = file, hashlib.sha256()
                        made.append({"file": name, "tokens": 0, "temporary": f"{root}/_temporary/{self.job}/{uuid.uuid4().hex}"})
                        out = fs.open_output_stream(made[-1]["temporary"])
                    if start != made[-1]["tokens"]:
                        raise ValueError(f"{file}: a row starts at {start}, the file has {made[-1]['tokens']} tokens")
                    if len(ids) and (ids.min() < 0 or ids.max() > 0xFFFF):
                        raise ValueError(f"{file}: a token does not fit 16 bits")
                    content = ids.astype("<u2").tobytes()
                    out.write(content)
                    digest.update(content)
                    made[-1] |= {"tokens": start + len(ids), "bytes": 2 * (start + len(ids)), "sha256": digest.hexdigest()}
        finally:
            if out:
                out.close()
        return _Written(made)

    def commit(self, messages: list) -> None:
        fs, root = located(self.folder)
        new = [f for m in messages if m for f in m.files]
        names, old = [f["file"] for f in new], [] if self.overwrite else self._old()
        twice = {n for n in names if names.count(n) > 1} | ({f["file"] for f in old} & set(names))
        if twice:
            raise ValueError(f"written twice: {', '.join(sorted(twice))}")
        gone = {f["file"] for f in self._old()} - set(names) if self.overwrite else set()
        for f in new:
            fs.move(f.pop("temporary"), f"{root}/{f['file']}")
        text = json.dumps({"files": sorted([*old, *new], key=lambda f: stream_order(f["file"]))}, indent=1)
        with fs.open_output_stream(f"{root}/_temporary/{self.job}/{_MANIFEST}") as out:
            out.write(text.encode())
        fs.move(f"{root}/_temporary/{self.job}/{_MANIFEST}", f"{root}/{_MANIFEST}")
        for name in gone:
            fs.delete_file(f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, root = located(self.folder)
        if fs.get_file_info(f"{root}/_temporary/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_temporary/{self.job}")


class TokenFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "file string, start long, at long, tokens array<int>"

    def reader(self, schema) -> TokenReader:
        return TokenReader(self.options)

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options, overwrite)


class PartReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.pattern = options["path"], options.get("files", "*")
        self.size = _EVERY if options.get("whole", "false") == "true" else int(options.get("partBytes", RANGE_BYTES))

    def partitions(self) -> Sequence[_Range]:
        _, infos = listed(self.folder, self.pattern)
        return [_Range(i.path, i.base_name, k, at, min(at + self.size, i.size)) for i in infos for k, at in enumerate(range(0, max(i.size, 1), self.size))]

    def read(self, part: _Range) -> Iterator[tuple]:
        if part is None:
            return
        fs, _ = located(self.folder)
        digest = hashlib.sha256()
        with fs.open_input_file(part.path) as f:
            for at in range(part.start, part.end, 1 << 20):
                digest.update(f.read_at(min(part.end, at + (1 << 20)) - at, at))
        yield part.file, part.base, part.start, part.end - part.start, digest.hexdigest()


class FileParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_parts"

    def schema(self) -> str:
        return "file string, part long, start long, length long, sha256 string"

    def reader(self, schema) -> PartReader:
        return PartReader(self.options)


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(TokenFiles)
    spark.dataSource.register(FileParts)
    return spark


def token_stream_files(spark: SparkSession, path: str, files: str = "*.bin", start: int = 0, end: int = _EVERY, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Blocks (file, start, at, tokens) of a folder's files that hold a position from start to end.

    A train stream is its base and its ``_ext_`` files, which are ordered by number as they were written.
    """
    asked = {"files": files, "from": str(start), "to": str(end), "rangeBytes": str(range_bytes)}
    return _registered(spark).read.format("token_files").options(**asked).load(path)


def token_range(spark: SparkSession, path: str, start: int, end: int, files: str = "*.bin") -> DataFrame:
    """The pieces (file, at, tokens) of positions start to end; only the blocks that hold them are read."""
    stream = token_stream_files(spark, path, files, max(start, 0), end)
    low, high = F.greatest("at", F.lit(start)), F.least(F.col("at") + F.size("tokens"), F.lit(end))
    cut = stream.filter(high > low)
    return cut.select("file", low.alias("at"), F.slice("tokens", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("tokens"))


def write_token_files(pieces: DataFrame, path: str, mode: str = "append", tasks: int | None = None) -> None:
    """K3, K4: rows (file, start, tokens) as 16-bit files; a file that counts already is refused, unless all are replaced."""
    spark = _registered(pieces.sparkSession)
    own = pieces.select("file", "start", "tokens").repartition(tasks or spark.sparkContext.defaultParallelism, "file").sortWithinPartitions("file", "start")
    own.write.format("token_files").mode(mode).save(path)


def file_digests(spark: SparkSession, path: str, files: str = "*") -> DataFrame:
    """(file, bytes, sha256) of whole files, read as a stream by one task each."""
    return _registered(spark).read.format("file_parts").option("files", files).option("whole", "true").load(path).select("file", F.col("length").alias("bytes"), "sha256")


def tree_digest(spark: SparkSession, path: str, files: str = "*", part_bytes: int = RANGE_BYTES) -> DataFrame:
    """K14 in parallel: the SHA-256 of the SHA-256 of a file's ordered parts."""
    parts = _registered(spark).read.format("file_parts").option("files", files).option("partBytes", str(part_bytes)).load(path)
    ordered = F.array_sort(F.collect_list(F.struct("part", "sha256")))
    return parts.groupBy("file").agg(F.sum("length").alias("bytes"), F.count("*").alias("parts"), F.sha2(F.array_join(F.transform(ordered, lambda p: p["sha256"]), ""), 256).alias("tree_sha256"))
