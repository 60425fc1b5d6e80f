"""Chat formatting: reply trees.

Messages with parent links are a forest. Iterative self-joins double the ancestor links, then expand every leaf into
its root-to-leaf path in as many joins again, so a path of depth d takes log2(d) rounds each way and the rows written
are those of the paths themselves. Branches of a tree are ranked by score and each chosen path is formatted as one
conversation, with the spans that carry loss.

Defined results: a null text or role is the empty string; a null score counts as 0; messages whose parent is missing
are roots; rows of a linear table that share a turn are ordered by role, then text; links that form a cycle have no
leaf and give no path; a null tree id is a value, so messages without one are a tree; a null turn comes last; an empty
table gives an empty result. Columns other than those named are ignored.

The template writes each message as ``<|role|>\\n`` text ``<|end|>\\n``. In texts ``\\`` becomes ``\\\\`` and ``<|``
becomes ``<\\|``, so no text can hold a control string; in roles ``\\`` is doubled and ``|>`` becomes ``|\\>``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read, small_batches

END = "<|end|>\n"


def _swap(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_text(c: Column) -> Column:
    return _swap(c, ("\\", "\\\\"), ("<|", "<\\|"))


def unescape_text(text: str) -> str:
    return text.replace("<\\|", "<|").replace("\\\\", "\\")


def escape_role(c: Column) -> Column:
    return _swap(c, ("\\", "\\\\"), ("|>", "|\\>"))


def unescape_role(role: str) -> str:
    return role.replace("|\\>", "|>").replace("\\\\", "\\")


def linear_nodes(conversations: DataFrame) -> DataFrame:
    """Messages of a linear table as a forest: each turn replies to the one before it."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), role, text)
    return conversations.select(
        F.col("conv_id").alias("tree"), F.row_number().over(w).cast("long").alias("node"), role.alias("role"), text.alias("text")
    ).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def root_to_leaf(spark: SparkSession, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (tree, leaf, node, up): every node on the path from each leaf, ``up`` replies above the leaf."""
    link = nodes.select("tree", "node", "parent")
    known = link.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    link = link.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("parent"))
    total = None
    jumps = [scratch.cut(link, "jump0")]
    while True:  # the ancestor 2^k replies above, for as long as any node has one
        now = jumps[-1].filter(F.col("parent").isNotNull())
        if now.isEmpty():
            break
        total = total or nodes.count()
        if 1 << (len(jumps) - 1) > total:
            break  # only a cycle goes on for longer than there are messages
        above = now.select("tree", F.col("node").alias("parent"), F.col("parent").alias("next"))
        jumps.append(scratch.cut(now.join(above, ["tree", "parent"]).select("tree", "node", F.col("next").alias("parent")), f"jump{len(jumps)}"))
    parents = jumps[0].filter(F.col("parent").isNotNull()).select("tree", F.col("parent").alias("node"))
    path = jumps[0].join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in range(len(jumps) - 1, -1, -1):  # each known node adds the one 2^k above it
        step = jumps[k].filter(F.col("parent").isNotNull())
        path = scratch.cut(path.unionByName(path.join(step, ["tree", "node"]).select("tree", "leaf", F.col("parent").alias("node"), (F.col("up") + (1 << k)).alias("up"))), f"path{k}")
    return path


def format_trees(spark: SparkSession, nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """One row per chosen path: tree, leaf, rank, score, formatted, loss_spans (start and length in code points).

    ``nodes``: tree, node, parent, role, text, score. ``branches``: how many paths of each tree, best mean score first
    (ties: deeper, then the smaller leaf); None takes all.
    """
    scratch = Scratch(spark, "trees")
    nodes = scratch.cut(nodes.withColumn("tree", F.struct("tree")), "nodes")  # a struct is equal to another with null as well
    path = root_to_leaf(spark, nodes, scratch)
    head, body = F.concat(F.lit("<|"), escape_role(F.coalesce("role", F.lit(""))), F.lit("|>\n")), escape_text(F.coalesce("text", F.lit("")))
    own = nodes.select("tree", "node", "role", "score", F.length(head).alias("lead"), F.length(body).alias("n"), F.concat(head, body, F.lit(END)).alias("piece"))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    told = path.join(own, ["tree", "node"]).withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    one = F.struct((-F.col("up")).alias("at"), "piece", F.when(F.col("role") == "assistant", F.struct((F.col("start") + F.col("lead")).alias("start"), F.col("n").cast("long").alias("length"))).alias("span"))
    paths = told.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(one)).alias("turns"), F.avg(F.coalesce("score", F.lit(0.0))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), F.desc(F.size("turns")), "leaf"))
    paths = paths.withColumn("rank", rank)
    if branches is not None:
        paths = paths.filter(F.col("rank") <= branches)
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda x: x.isNotNull())
    return paths.select(F.col("tree.tree").alias("tree"), "leaf", "rank", "score", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: str) -> list[dict]:
    """The messages of a formatted conversation."""
    out = []
    for part in formatted.split(END)[:-1]:
        role, text = part[2:].split("|>\n", 1)
        out.append({"role": unescape_role(role), "text": unescape_text(text)})
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for batch in batches:
        formatted, spans = batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()
        loss = ["".join(unescape_text(f[s["start"] : s["start"] + s["length"]]) for s in own) for f, own in zip(formatted, spans, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("leaf"), batch.column("rank"), batch.column("formatted"), pa.array([parse(f) for f in formatted], turn), pa.array(loss, pa.string())], ["tree", "leaf", "rank", "formatted", "turns", "loss"])


def read_back(formatted: DataFrame) -> DataFrame:
    """tree, leaf, rank, formatted, and the messages and the text under the loss mask, taken from ``formatted`` and its spans alone."""
    small_batches(formatted.sparkSession)
    return formatted.select("tree", "leaf", "rank", "formatted", "loss_spans").mapInArrow(_read, "tree long, leaf long, rank int, formatted string, turns array<struct<role:string,text:string>>, loss string")


def op4_chat_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    done = read_back(format_trees(spark, linear_nodes(rows.unionByName(extra)), branches=1))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(13 + length(replace(replace(role, '\', '\\'), '|>', '|\>')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM t
"""
