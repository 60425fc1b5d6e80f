"""Filter interaction audit: what each of five filters removes at each place of every order of them.

Direct relational replay: each document has the set of filters that it fails as a bit mask; the masks are crossed with the
120 orders, which are broadcast and of fixed number, the place of the first failure is computed, the five steps are
exploded, and conditions are counted per (part, order, step) with map-side combining. So a task sends 600 rows a part,
whatever it read.

A filter that asks for earlier texts (``copies``) is decided by the least id of each text, found by grouping on its SHA-256:
a document is the first if its (id, digest) is the group's. That pair is also the key of the join, so a text with copies in a
third of all rows does not land in one task.

Defined results: a null text is '', a null language is the part ''; a null id is neither before nor after others, so such a row
is never a copy and does not make others copies; rows that repeat an id are documents of their own, and equal texts of one id
are no copies of each other; of several labels of an id a 1 counts, labels without an id are ignored; texts are read whole; an
empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read

LETTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = "[#$%&*|]"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 3
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _bit(letter: str, failed: Column) -> Column:
    return F.when(failed, 1 << LETTERS.index(letter)).otherwise(0)


def text_flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and the mask of the filters that look at one text (A to D)."""
    own = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.select("doc_id", "part", "text", F.array_remove(F.split("text", SPACE), "").alias("words"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    upper = F.char_length(F.regexp_replace("text", "[^A-Z]+", ""))
    mask = _bit("A", n < LEAST_WORDS) + _bit("B", 100 * distinct.cast("long") < LEAST_DISTINCT * n.cast("long"))
    mask = mask + _bit("C", 100 * upper.cast("long") > MOST_UPPER * F.char_length("text").cast("long")) + _bit("D", F.col("text").rlike(SYMBOL))
    return own.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def copies(flags: DataFrame) -> DataFrame:
    """Adds filter E to the mask: the text is that of a smaller id."""
    first = flags.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter(F.col("doc_id").isNotNull()).withColumn("_first", F.lit(True))
    return flags.join(first, ["doc_id", "digest"], "left").withColumn("mask", F.col("mask") + _bit("E", F.col("doc_id").isNotNull() & F.col("_first").isNull())).drop("_first")


def labelled(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``good`` and ``toxic``; documents without a label are neither."""
    one = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return flags.join(one, "doc_id", "left").select("part", "mask", *[(F.coalesce(c, F.lit(0)) == 1).alias(c) for c in ("good", "toxic")])


def replay(flags: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Per part, order and step the counts of its filter, from (part, mask, good, toxic)."""
    spark, places = flags.sparkSession, len(letters)
    orders = spark.createDataFrame([(i, "".join(p), [1 << letters.index(x) for x in p]) for i, p in enumerate(permutations(letters))], "o int, filter_order string, bits array<int>")
    failed = lambda bit: F.col("mask").bitwiseAND(bit) > 0
    first = F.coalesce(*[F.when(failed(F.col("bits")[i]), i + 1) for i in range(places)], F.lit(places + 1))
    each = flags.crossJoin(F.broadcast(orders.select("o", "bits"))).select("part", "mask", "good", "toxic", "o", first.alias("first"), F.posexplode("bits").alias("at", "bit"))
    step = F.col("at") + 1
    here, earlier = F.col("first") == step, F.col("first") < step
    conditions = (F.col("first") > step, here, failed(F.col("bit")) & earlier, F.col("mask") == F.col("bit"), here & F.col("good"), here & F.col("toxic"))
    told = each.groupBy("part", "o", step.alias("step")).agg(*[F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(name) for name, c in zip(_COUNTS, conditions, strict=True)])
    named = told.join(F.broadcast(orders.select("o", "filter_order")), "o").withColumn("_letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    every = F.sum("removed").over(Window.partitionBy("part", "_letter"))
    return named.withColumn("shapley", every).select("part", "filter_order", "step", *_COUNTS, "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step."""
    flags = Scratch(docs.sparkSession, "audit").cut(text_flags(docs), "flags")
    return replay(labelled(copies(flags), labels))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP13_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
m AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS first, part, len(l) AS n, len(list_distinct(l)) AS u, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS up, length(text) AS cp FROM w),
q AS (SELECT doc_id, bool_or(coalesce(quality, 0) = 1) AS good, bool_or(coalesce(toxic, 0) = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [n < {LEAST_WORDS}, 100 * u < {LEAST_DISTINCT} * n, 100 * up > {MOST_UPPER} * cp, regexp_matches(text, '{SYMBOL}'), coalesce(doc_id > first, false)] AS fails FROM m LEFT JOIN q USING (doc_id)),
g AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT a.i AS a, b.i AS b, c.i AS c, d.i AS d, e.i AS e FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
p AS (SELECT array_to_string(list_transform([a, b, c, d, e], lambda i: substr('{LETTERS}', i, 1)), '') AS filter_order, [a, b, c, d, e] AS l FROM o),
r AS (SELECT part, good, toxic, fails, n, filter_order, l, coalesce(list_position(list_transform(l, lambda i: fails[i]), true), 6) AS first FROM g, p),
s AS (SELECT part, filter_order, x.i AS step, l[x.i] AS letter, sum(n * (first > x.i)::INT) AS kept, sum(n * (first = x.i)::INT) AS removed,
    sum(n * (fails[l[x.i]] AND first < x.i)::INT) AS redundant, sum(n * (fails[l[x.i]] AND len(list_filter(fails, lambda y: y)) = 1)::INT) AS unique_fails,
    sum(n * (first = x.i AND good)::INT) AS good_lost, sum(n * (first = x.i AND toxic)::INT) AS toxic_lost FROM r, x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM s
"""
