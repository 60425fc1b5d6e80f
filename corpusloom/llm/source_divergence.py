"""Source divergence audit: how unlike the sources of a language are, and which terms set a source apart.

Plain relational: matches of a pattern are exploded and counted per (lang, source, term), counting each document once as
well; terms in enough documents of their language are its kept vocabulary; the groups of a language are crossed with it, so
that terms that a source lacks count as zero; the dense table is joined with itself on (lang, term), and absolute
differences of smoothed shares are summed per pair of sources and ranked in windows.

Shares are whole numbers, p = 1 + floor(10^9 (n + 5) / (N + 5 V)), computed on decimals without rounding.

Scale: counts combine on the map side, so what is shuffled is the vocabulary of each task, not its words. No join has the
language as its only key: what is crossed on it is broadcast if its bytes have been counted and fit, or else dealt out by a
salt. The pairs of sources that are returned are as many as the contract asks for, S (S - 1) a language.

Defined results: null text, language and source are ''; a group without a kept term has zero counts; a language without a
kept term has pairs of value 0 and no terms; equal values rank by item in order of bytes; repeated rows are documents of
their own; texts are read whole; an empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fits, read

#: Runs of ASCII letters and of anything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST = 30
TOP = 50
SMOOTH = 5
UNIT = 1_000_000_000
#: Parts of a language where its groups are too many to broadcast.
SALTS = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Only A-Z in lower case; a text of ASCII takes the faster way, which is the same there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences, and documents with the term, from (lang, source, text)."""
    found = docs.select("lang", "source", F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0)).alias("m"))
    kinds = F.array(F.struct(F.lit(1).alias("n"), F.lit(0).alias("d"), F.col("m").alias("t")), F.struct(F.lit(0).alias("n"), F.lit(1).alias("d"), F.array_distinct("m").alias("t")))
    each = found.select("lang", "source", F.inline(kinds)).select("lang", "source", "n", "d", F.explode("t").alias("term"))
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def crossed(left: DataFrame, part: str, groups: DataFrame) -> DataFrame:
    """Rows of a language with its groups: joined on the language, which may hold a third of all rows or more."""
    if fits(groups):
        return left.join(F.broadcast(groups), "lang")
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(part), F.lit(SALTS)).cast("int")).join(salted, ["lang", "_salt"]).drop("_salt")


def share(n: str, total: str, vocabulary: str) -> Column:
    """1 + floor(10^9 (n + 5) / (N + 5 V)), exact."""
    return F.expr(f"1 + (CAST({UNIT} AS DECIMAL(10, 0)) * CAST({n} + {SMOOTH} AS DECIMAL(19, 0))) div CAST({total} + {SMOOTH} * {vocabulary} AS DECIMAL(19, 0))").cast("long")


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` for each other source, ``term`` for the terms above the language's share."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "divergence")
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to) for c, to in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = scratch.cut(term_counts(own), "counts")
    kept = scratch.cut(counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("d").alias("d")).filter(F.col("d") >= least).drop("d"), "kept")
    found = scratch.cut(counts.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n"), "found")
    scratch.drop("counts")
    langs = kept.groupBy("lang").agg(F.sum("n_lang").alias("total_lang"), F.count("*").alias("v"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = scratch.cut(own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0))), "groups")
    of_lang = scratch.cut(langs, "langs")
    terms = crossed(kept, "term", of_lang).select("lang", "term", "v", share("n_lang", "total_lang", "v").alias("q"))
    dense = crossed(terms, "term", groups).join(found, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    dense = scratch.cut(dense.select("lang", "source", "term", "n", share("n", "total", "v").alias("p"), "q"), "dense")
    scratch.drop("found", "kept")

    a, b = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("po"))
    half = a.join(b, ["lang", "term"]).filter(F.col("source") < F.col("other")).groupBy("lang", "source", "other").agg(F.sum(F.abs(F.col("p") - F.col("po"))).alias("value"))
    half = scratch.cut(half, "half")
    both = half.unionByName(half.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    pairs = crossed(groups.select("lang", "source"), "source", groups.select("lang", F.col("source").alias("other"))).filter(F.col("source") != F.col("other"))
    pairs = pairs.join(both, ["lang", "source", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    over = dense.filter((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(w))
    return ranked(pairs).unionByName(ranked(over).filter(F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}') AS m FROM documents),
t AS (SELECT uid, lang, source, unnest(m) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT uid) >= {LEAST}),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(total), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + ({UNIT} * (coalesce(c.n, 0) + {SMOOTH})::HUGEINT) // (g.total + {SMOOTH} * v.v)::HUGEINT AS p,
    1 + ({UNIT} * (k.n + {SMOOTH})::HUGEINT) // (v.total + {SMOOTH} * v.v)::HUGEINT AS q
  FROM k JOIN v USING (lang) JOIN g USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS other, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= {TOP}
"""
