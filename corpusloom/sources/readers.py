"""Scans of files: marked text, JSON lines, token streams, logs, checkpoints, results. Explicit schemas everywhere."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import non_blank, strip
from .versioned import get

MARKER = "<|endoftext|>"


def marked_documents(spark: SparkSession, path: str, marker: str = MARKER) -> DataFrame:
    """Documents that end at a line holding only the marker; stripped, blank ones dropped, the tail kept.

    The marker with its line ends is the record separator, so a file is split over tasks; markers padded with white
    space are cut out of the record that holds them.
    """
    lines = spark.read.option("lineSep", f"\n{marker}\n").text(path)
    quoted = "".join(f"[{c}]" if c in "|^$.()[]{}*+?<>" else c for c in marker)
    parts = F.split("value", f"(?m)^[ \\t]*{quoted}[ \\t]*$")
    return lines.select(F.explode(parts).alias("text")).select(strip(F.col("text")).alias("text")).filter(F.col("text") != "")


def jsonl_documents(spark: SparkSession, shards: list[str]) -> DataFrame:
    """Documents of JSON-line shards in the manifest's order: shard_no, line_no and text; line numbers are file offsets' order."""
    tidy = "^(file:)?/+"
    names = spark.createDataFrame(list(enumerate(shards)), "shard_no int, file string").withColumn("file", F.regexp_replace("file", tidy, "/"))
    rows = spark.read.text(shards).select("value", F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), tidy, "/").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    doc = F.from_json("value", "text string")["text"]
    return rows.join(F.broadcast(names), "file").select("shard_no", F.struct("block", "seq").alias("line_no"), doc.alias("text"))  # a row per shard named


def budget_documents(docs: DataFrame, order: str, target: int) -> DataFrame:
    """Non-blank documents of a stream until the character budget, with the one that reaches it."""
    from ..operators.corpus import prefix_budget

    return prefix_budget(docs.filter(non_blank(F.col("text"))), order, F.length("text"), target)


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON-line logs with their order; torn or blank lines give null fields and are dropped.

    ``run`` is the second part of the file name. ``seq`` orders a run's records by file, place in the file and line, however
    Spark deals out the parts of files.
    """
    kind = "step long, tokens long, loss double, lr double, grad_norm double, tokens_per_sec double, elapsed double, peak_mem_gb double, val_loss double"
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    seq = F.struct(name.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("seq")
    rows = spark.read.text(path).select(seq, F.split_part(name, F.lit("_"), F.lit(2)).alias("run"), F.from_json("value", kind, {"allowNonNumericNumbers": "true"}).alias("r"))
    return rows.select("run", "seq", "r.*").filter(F.col("step").isNotNull())


def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """Checkpoint files of a folder with their token counts, by name; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "tokens_*.pt").load(folder).select("path", "length")
    return files.withColumn("tokens", F.regexp_extract("path", r"tokens_(\d+)\.pt$", 1).cast("long")).orderBy("path")


def file_tokens(spark: SparkSession, folder: str, recorded: int | None = None) -> DataFrame:
    """Tokens of each 16-bit file from its size, or the recorded number where there is no file."""
    files = spark.read.format("binaryFile").load(folder).select("path", (F.col("length") / 2).cast("long").alias("tokens"))
    return files if recorded is None or not files.isEmpty() else spark.createDataFrame([(None, recorded)], "path string, tokens long")


#: Where a checkpoint keeps its weights and its token count, most preferred first.
STATE_KEYS = ("model", "model_state_dict", "state_dict", "weights")
TOKEN_KEYS = ("tokens", "tokens_seen", "token_count", "n_tokens", "total_tokens")


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _key(row: Column, name: str) -> Column:
    return F.try_variant_get(row, f"$['{name}']", "variant")


def first_of(row: Column, names: list[str] | tuple[str, ...] = TOKEN_KEYS) -> Column:
    """The first key of a JSON object that holds a whole number, as long.

    Values keep their types: booleans, strings and 3.5 are passed over, 3.0 and 3e0 are 3. A text that is no JSON object
    and a number beyond 64 bits give null.
    """
    obj = F.try_parse_json(row)
    whole = []
    for name in names:
        v = _key(obj, name)
        exact, rough = F.try_variant_get(obj, f"$['{name}']", "decimal(38,18)"), F.try_variant_get(obj, f"$['{name}']", "double")
        number = F.when(_kind(v) == "BIGINT", F.try_variant_get(obj, f"$['{name}']", "long"))
        number = number.when((_kind(v) == "DECIMAL") & (exact == F.floor(exact)), F.try_variant_get(obj, f"$['{name}']", "long"))
        whole.append(number.when((_kind(v) == "DOUBLE") & (rough == F.floor(rough)) & (F.abs(rough) < 2.0**63), rough.cast("long")))
    return F.coalesce(*whole)


def state_entries(row: Column, names: list[str] | tuple[str, ...] = STATE_KEYS, wrapper: str = "_orig_mod.") -> Column:
    """Name to value of the first key that holds an object, or of the object itself, without a compiler's prefix."""
    obj = F.try_parse_json(row)
    inner = F.coalesce(*[F.when(_kind(_key(obj, n)) == "OBJECT", _key(obj, n)) for n in names], F.when(_kind(obj) == "OBJECT", obj))
    plain = lambda k, v: F.when(F.startswith(k, F.lit(wrapper)), F.substr(k, F.lit(len(wrapper) + 1))).otherwise(k)
    return F.transform_keys(inner.cast("map<string,variant>"), plain)


def result_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of a result file; those without tokens are dropped, per-domain losses become rows."""
    kind = "points array<struct<tokens:long,max_score:double,losses:map<string,double>>>"
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")
    p = spark.read.schema(kind).option("multiLine", True).json(path).select(name, F.explode("points").alias("p")).select("file", "p.*")
    return p.filter(F.col("tokens").isNotNull()).select("file", "tokens", "max_score", F.explode_outer("losses").alias("domain", "loss"))


def schedule(text: str) -> tuple[int, ...]:
    """A JSON list of positive numbers, sorted, each once; anything else is refused."""
    values = json.loads(text)
    if not isinstance(values, list) or not values or any(isinstance(v, bool) or not isinstance(v, int | float) or v <= 0 for v in values):
        raise ValueError("a schedule is a non-empty list of positive numbers")
    return tuple(sorted({int(v) for v in values}))


def jsonl_folder(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a complete folder of shards, in the order that its manifest gives; without one it is refused."""
    found = get(spark, f"{path}/manifest.json")
    if found is None:
        raise FileNotFoundError(f"{path} has no manifest")
    return jsonl_documents(spark, [f"{path}/{name}" for name in json.loads(found)["shards"]])


#: Characters a token, headroom, and the target of a smoke run, for extensions of a corpus.
CHARS_PER_TOKEN, HEADROOM, SMOKE_CHARS = 4.21, 1.05, 4 << 20


def extension_plan(spark: SparkSession, base: str, extra_tokens: int, smoke: bool = False) -> tuple[int, int]:
    """Documents to skip, which the base's manifest counts, and the characters to take."""
    found = get(spark, f"{base}/manifest.json")
    if found is None:
        raise FileNotFoundError(f"{base} has no manifest; a base comes before its extension")
    return int(json.loads(found)["documents"]), SMOKE_CHARS if smoke else int(extra_tokens * CHARS_PER_TOKEN * HEADROOM)


def extension(docs: DataFrame, order: str, base: str, extra_tokens: int, smoke: bool = False) -> DataFrame:
    """What follows the documents of the base in the stream of non-blank documents, up to the target."""
    from ..operators.corpus import skip_prefix

    skip, target = extension_plan(docs.sparkSession, base, extra_tokens, smoke)
    return skip_prefix(docs.filter(non_blank(F.col("text"))), order, F.length("text"), skip, target)


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """Minimal pairs of JSON lines (paradigm, item, good, bad); a pair without both sentences is refused."""
    rows = spark.read.schema("paradigm string, item long, good string, bad string").json(path)
    whole = F.when(F.col("good").isNotNull() & F.col("bad").isNotNull(), True).otherwise(F.raise_error(F.lit("a pair lacks a sentence")).cast("boolean"))
    return rows.filter(whole)


def mix(spark: SparkSession, text: str) -> DataFrame:
    """``a=0.7,b=0.3`` as rows (domain, weight)."""
    one = spark.createDataFrame([(text,)], "t string").select(F.explode(F.expr("str_to_map(t, ',', '=')")).alias("domain", "weight"))
    return one.select(F.trim("domain").alias("domain"), F.col("weight").cast("double").alias("weight"))


def known_only(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value is allowed; any other value stops the query."""
    ok = F.when(F.col(column).isin(allowed), True).otherwise(F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.coalesce(column, F.lit("null")))).cast("boolean"))
    return rows.filter(ok)


def with_fallback(read, other, note: str) -> DataFrame:
    """The first source, or the other one where it cannot be read; ``source`` tells which."""
    from pyspark.errors import AnalysisException

    try:
        return read().withColumn("source", F.lit("first"))
    except AnalysisException:
        return other().withColumn("source", F.lit(note))
