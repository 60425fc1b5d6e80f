"""Benchmark decontamination [native]: spaced-seed hashing.

Tokens are lower-case runs of letters and digits. Each fixed mask names the token positions that count; the others may
differ. Every position of every document is hashed under every mask and joined with the hashes of the benchmark items. A
hit puts item and document side by side on one diagonal, and the overlap around it is verified: some ``WINDOW`` aligned
tokens in a row (the whole item, if it is shorter) may differ in ``window // SLACK`` places at most.

The two masks are lossless for that rule: a search over all placements showed that any 2 substitutions among 12 or 13
tokens, and any one among 8 to 11, leave one placement of a mask untouched. So no overlap that the rule accepts is missed.

Main path: DataFrame functions only. The benchmark's seeds (24 bytes each) and, joined after the hit, its items' tokens are
broadcast only if their counted bytes fit, else both sides are shuffled by hash; a passage that very many documents share has its hits reduced to one row per document,
item and diagonal before the first shuffle.

Defined results: null or empty texts and items match nothing; items under ``LEAST`` tokens are not searched; rows of
documents that repeat an id are told apart by their text, so a result has one row per (doc_id, item_id), the best overlap
(most matching tokens, then the longest, then the earliest); a null doc_id is a value of its own; empty tables give no
rows; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, read

MASKS = ("111101", "1100111")
WINDOW = 13
SLACK = 6
LEAST = 8


def tokens(text: Column) -> Column:
    """Hashes of the text's tokens, in order."""
    return F.transform(F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), ""), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, at (0-based position of the mask) and seed, for every position of ``hashes`` and every mask.

    One pass over the positions: shifted copies of the token array are zipped, so the hashes, the join after them and
    whatever is cut from the array for a hit stay in one compiled stage, which copies no array for a position without hit.
    The generators are outer ones as their inner form would evaluate the tokens a second time, to filter empty arrays.
    """
    span = max(map(len, MASKS))
    shifted = [F.slice("hashes", F.lit(i + 1), F.greatest(F.size("hashes") - i, F.lit(0))).alias(f"t{i}") for i in range(span)]
    at = rows.select(*keep, F.posexplode_outer(F.arrays_zip(*shifted)).alias("at", "t"))
    own = [F.when(F.col(f"t.t{len(m) - 1}").isNotNull(), F.xxhash64(F.lit(m), *[F.col(f"t.t{i}") for i, c in enumerate(m) if c == "1"])) for m in MASKS]
    return at.select(*keep, "at", F.explode_outer(F.array(*own)).alias("seed"))


def item_table(benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """item_id and hashes of every item that is long enough, one row per different item."""
    return benchmark.select("item_id", tokens(F.col("text")).alias("hashes")).filter(F.size("hashes") >= least).distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """One row per (doc_id, item_id) of a contaminated document.

    start: the document token under the item's first token (negative if the document begins inside the item);
    n_aligned, n_matched: aligned and equal tokens on that diagonal.
    """
    items = scratch.cut(item_table(benchmark), "items").withColumn("item_key", F.xxhash64("item_id", "hashes"))
    item_seeds = bounded(scratch.cut(seeds(items, ["item_key", "hashes"]).select("item_key", F.col("at").alias("item_at"), "seed").filter(F.col("seed").isNotNull()), "seeds"))
    rows = docs.select("doc_id", tokens(F.col("text")).alias("hashes"))
    hits = seeds(rows, ["doc_id", "hashes"]).join(item_seeds, "seed").join(bounded(items.select("item_key", "item_id", F.col("hashes").alias("item"))), "item_key")
    start = F.col("at") - F.col("item_at")
    cut = F.greatest(-start, F.lit(0))  # item tokens before the document's first
    n = F.least(F.size("item") - cut, F.size("hashes") - F.greatest(start, F.lit(0)))
    beside = hits.select("doc_id", "item_id", start.alias("start"), F.slice("hashes", F.greatest(start, F.lit(0)) + 1, n).alias("a"), F.slice("item", cut + 1, n).alias("b"), F.least(F.lit(window), F.size("item")).alias("need"))
    beside = beside.groupBy("doc_id", "item_id", "start", "a", "b", "need").agg(F.count("*").alias("hits"))
    same = F.zip_with("a", "b", lambda x, y: F.when(x == y, 1).otherwise(0))
    told = beside.withColumn("same", same)
    ok = F.exists(F.sequence(F.lit(1), F.size("same") - F.col("need") + 1), lambda i: F.aggregate(F.slice("same", i, F.col("need")), F.lit(0), lambda s, x: s + x) >= F.col("need") - F.floor(F.col("need") / slack))
    # tied to the count, or the lambdas would be pushed into the join, which then could not be compiled with the generators
    ok = F.when(F.col("hits") > 0, F.when(F.size("same") >= F.col("need"), ok).otherwise(F.lit(False)))
    told = told.filter(ok).select("doc_id", "item_id", F.col("start").cast("long"), F.size("same").cast("long").alias("n_aligned"), F.aggregate("same", F.lit(0), lambda s, x: s + x).cast("long").alias("n_matched"))
    best = F.min(F.struct((-F.col("n_matched")).alias("m"), (-F.col("n_aligned")).alias("a"), "start"))
    return told.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.start", (-F.col("b.a")).alias("n_aligned"), (-F.col("b.m")).alias("n_matched"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), Scratch(spark, "decontaminate"))


def sql(window: int = WINDOW, slack: int = SLACK, least: int = LEAST) -> str:
    """Brute force: every diagonal with enough equal tokens, no seeds."""
    return f"""
WITH d0 AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT row_number() OVER () AS uid, doc_id, w FROM d0),
i AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) >= {least}),
dt AS (SELECT uid, generate_subscripts(w, 1) AS p, unnest(w) AS t FROM d),
it AS (SELECT item_id, generate_subscripts(w, 1) AS q, unnest(w) AS t, len(w) AS n FROM i),
c AS (SELECT uid, item_id, p - q AS start FROM dt JOIN it USING (t) GROUP BY ALL HAVING count(*) >= {least} - {least} // {slack}),
z AS (SELECT c.uid, d.doc_id, c.item_id, c.start, least({window}, len(i.w)) AS need,
    list_transform(range(greatest(-c.start, 0) + 1, least(len(i.w), len(d.w) - c.start) + 1), lambda k: CASE WHEN i.w[k] = d.w[k + c.start] THEN 1 ELSE 0 END) AS same
  FROM c JOIN d USING (uid) JOIN i USING (item_id)),
v AS (SELECT * FROM z WHERE len(same) >= need AND
    list_max(list_transform(range(1, len(same) - need + 2), lambda s: list_sum(same[s:s + need - 1]))) >= need - need // {slack}),
r AS (SELECT doc_id, item_id, start, len(same) AS n_aligned, CAST(list_sum(same) AS BIGINT) AS n_matched,
    row_number() OVER (PARTITION BY doc_id, item_id ORDER BY list_sum(same) DESC, len(same) DESC, start) AS k FROM v)
SELECT doc_id, item_id, start, n_aligned, n_matched FROM r WHERE k = 1
"""
