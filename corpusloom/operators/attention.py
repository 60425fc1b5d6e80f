"""Readings of attention and of per-sequence metrics: long tables (seq, layer, head, q, k, w) and what is averaged from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import draw

#: Index patterns of a block of r tokens repeated twice: which (q, k) pairs each reading averages.
PATTERNS = {
    "prefix_matching": lambda q, k, r: (q >= r) & (k == q - r + 1),
    "prev_token": lambda q, k, r: (q >= 1) & (k == q - 1),
    "duplicate_token": lambda q, k, r: (q >= r) & (k == q - r),
    "current_token": lambda q, k, r: k == q,
    "first_token": lambda q, k, r: (q >= 1) & (k == 0),
    "prefix_matching_first_half": lambda q, k, r: (q < r) & (q >= 1) & (k == q - 1),
}


def pair_means(attn: DataFrame, repeat: int) -> DataFrame:
    """The mean weight over each pattern's pairs, per sequence, layer and head; all patterns in one pass."""
    q, k = F.col("q"), F.col("k")
    return attn.groupBy("seq", "layer", "head").agg(*[F.avg(F.when(p(q, k, repeat), F.col("w"))).alias(n) for n, p in PATTERNS.items()])


def row_entropy(attn: DataFrame) -> DataFrame:
    """Mean over rows after the first of the row's entropy over the log of its length; a zero weight adds nothing."""
    row = attn.filter(F.col("q") >= 1).groupBy("seq", "layer", "head", "q").agg((F.sum(F.when(F.col("w") > 0, -F.col("w") * F.log("w")).otherwise(0.0)) / F.log(F.col("q") + 1.0)).alias("h"))
    return row.groupBy("seq", "layer", "head").agg(F.avg("h").alias("entropy"))


def best_head(scores: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """The greatest score and its head, the first in (layer, head) order on a tie."""
    m = scores.groupBy(*(by or [])).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col("layer")).alias("l"), (-F.col("head")).alias("h"))).alias("m"))
    return m.select(*(by or []), (-F.col("m.l")).alias("layer"), (-F.col("m.h")).alias("head"), F.col("m.v").alias(value))


def matched_controls(scores: DataFrame, value: str, level: float, seed: int, short: bool = False) -> DataFrame:
    """Per layer as many heads at or below the level, drawn by hash, as lie strictly above it.

    A layer with too few others is refused, or with ``short`` gives all that it has.
    """
    member = F.col(value) > level
    want = scores.groupBy("layer").agg(F.count(F.when(member, 1)).alias("want"), F.count(F.when(~member, 1)).alias("others"))
    w = Window.partitionBy("layer").orderBy(draw(seed, F.col("layer"), F.col("head")), "head")
    drawn = scores.filter(~member).withColumn("rank", F.row_number().over(w)).join(F.broadcast(want), "layer")  # a row per layer
    if short:
        return drawn.filter(F.col("rank") <= F.col("want")).select("layer", "head")
    ok = F.when(F.col("others") < F.col("want"), F.raise_error(F.lit("too few heads to match")).cast("boolean")).otherwise(True)
    return drawn.filter(ok & (F.col("rank") <= F.col("want"))).select("layer", "head")


def median_rank(matrix: DataFrame) -> DataFrame:
    """Per head the median over rows of how many entries of a row exceed its diagonal. ``matrix``: layer, head, i, j, v."""
    diag = matrix.filter(F.col("i") == F.col("j")).select("layer", "head", "i", F.col("v").alias("d"))
    rank = matrix.join(diag, ["layer", "head", "i"]).groupBy("layer", "head", "i").agg(F.count(F.when(F.col("v") > F.col("d"), 1)).alias("rank"))
    return rank.groupBy("layer", "head").agg(F.percentile("rank", F.lit(0.5)).alias("median_rank"))


def repeated_blocks(rows: DataFrame, repeat: int, vocabulary: int, seed: int) -> DataFrame:
    """Per sequence ``repeat`` ids in [1, vocabulary), then the same again. ``rows``: seq."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(repeat - 1)), lambda i: 1 + F.pmod(draw(seed, F.col("seq"), i), F.lit(vocabulary - 1)))
    return rows.select("seq", ids.alias("a")).select("seq", F.concat("a", "a").alias("ids"))


def copying(scored: DataFrame, repeat: int) -> DataFrame:
    """Per sequence the share of exact predictions and mean losses of the second and first halves, then means.

    ``scored``: seq, pos (of the input, from 0), nll, exact. First half: positions 0 to r - 2, second: r to 2 r - 2.
    """
    first, second = F.col("pos") <= repeat - 2, F.col("pos").between(repeat, 2 * repeat - 2)
    per = scored.groupBy("seq").agg(F.avg(F.when(second, F.col("exact").cast("double"))).alias("match"), F.avg(F.when(second, F.col("nll"))).alias("second"), F.avg(F.when(first, F.col("nll"))).alias("first"))
    return per.agg(F.count("*").alias("sequences"), F.avg("match").alias("exact_match"), (F.avg("second") - F.avg("first")).alias("copying"))


def corrupted(blocks: DataFrame, other: DataFrame, repeat: int) -> DataFrame:
    """P10: of the sequence [A', A] the positions that are read, with the right and the corrupt next ids. Both: seq, ids."""
    j = blocks.join(other.select("seq", F.slice("ids", 1, repeat).alias("x")), "seq").withColumn("clean", F.slice("ids", 1, repeat))
    told = F.transform(F.sequence(F.lit(1), F.lit(repeat - 1)), lambda i: F.struct((i + repeat - 1).alias("pos"), F.element_at("clean", i + 1).alias("right"), F.element_at("x", i + 1).alias("wrong")))
    return j.select("seq", F.explode(told).alias("t")).select("seq", "t.*")


def pair_accuracy(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The share of pairs whose good one scores strictly more; a tie is wrong."""
    return pairs.groupBy(*by).agg(F.count("*").alias("pairs"), F.avg((F.col("good") > F.col("bad")).cast("double")).alias("accuracy"))


def paired_deltas(base: DataFrame, treated: DataFrame, unit: list[str], value: str) -> DataFrame:
    """Treated minus baseline of each unit; units that only one side has are refused."""
    j = base.select(*unit, F.col(value).alias("b")).join(treated.select(*unit, F.col(value).alias("t")), unit, "full_outer")
    odd = F.when(F.col("b").isNull() | F.col("t").isNull(), F.raise_error(F.lit("a unit has no partner")).cast("double"))
    return j.select(*unit, F.coalesce(odd, F.col("t") - F.col("b")).alias("delta"))


def recovered(patched: Column, corrupt: Column, clean: Column) -> Column:
    """(patched - corrupt) / (clean - corrupt), null where the gap is under 1e-12."""
    gap = clean - corrupt
    return F.when(F.abs(gap) >= 1e-12, (patched - corrupt) / gap)


def position_means(outputs: DataFrame) -> DataFrame:
    """The mean output of each position over sequences. ``outputs``: seq, layer, pos, head, dim, value."""
    return outputs.groupBy("layer", "pos", "head", "dim").agg(F.avg("value").alias("mean"))


def decayed(name: Column) -> Column:
    """Whether weight decay applies to a parameter: not to embeddings, the output head and norm weights."""
    return ~(name.isin("embed.weight", "lm_head.weight") | name.endswith("_norm.weight"))


def drawn_ids(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """N different ids, the least by hash; a top-n by task, then one of the few left. ``ids``: id."""
    return ids.withColumn("d", draw(seed, F.col("id"))).orderBy("d", "id").limit(n).select("id")


def mlp_width(d: int) -> int:
    """8/3 of the width, rounded up to a multiple of 64."""
    return -(-(8 * d // 3) // 64) * 64


def parameter_count(vocabulary: int, d: int, layers: int) -> int:
    """embeddings (tied), four square projections, three of the MLP, two norms a layer and a last one."""
    return vocabulary * d + layers * (4 * d * d + 3 * d * mlp_width(d) + 2 * d) + d


def parameter_counts(rows: DataFrame) -> DataFrame:
    """F5 for a table of configurations (vocabulary, d, layers): adds mlp and parameters."""
    d, mlp = F.col("d").cast("long"), F.ceil(F.floor(8 * F.col("d") / 3) / 64) * 64
    rows = rows.withColumn("mlp", mlp.cast("long"))
    each = 4 * d * d + 3 * d * F.col("mlp") + 2 * d
    return rows.withColumn("parameters", (F.col("vocabulary") * d + F.col("layers") * each + d).cast("long"))
