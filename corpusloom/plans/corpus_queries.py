"""Corpus queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SQL_WS, non_blank, sql_draw, sql_uniform, strip, words
from ..operators import corpus as C
from ..sources.tables import table

_STRIP = rf"regexp_replace(text, '^{SQL_WS}|{SQL_WS}$', '', 'g')"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{SQL_WS}'), lambda w: w <> '')"
QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


@query("nonempty_prefix_budget", f"""
WITH d AS (SELECT doc_id, length({_STRIP}) AS n FROM documents WHERE {_STRIP} <> ''),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, n, CAST(before AS BIGINT) AS before FROM r WHERE before < 1000000""")
def nonempty_prefix_budget(spark, sf):
    """P1, P2, S2, T-4."""
    d = docs(spark, sf).filter(non_blank(F.col("text"))).select("doc_id", F.length(strip(F.col("text"))).cast("long").alias("n"))
    return C.prefix_budget(d, "doc_id", F.col("n"), 1_000_000)


@query("extension_skip_prefix", f"""
WITH d AS (SELECT doc_id, length(text) AS n, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM documents WHERE {_STRIP} <> ''),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d WHERE rank >= 300)
SELECT doc_id, n, CAST(before AS BIGINT) AS before FROM r WHERE before < 200000 OR rank = 300""")
def extension_skip_prefix(spark, sf):
    """S3, S3b."""
    d = docs(spark, sf).filter(non_blank(F.col("text"))).select("doc_id", F.length("text").cast("long").alias("n"))
    return C.skip_prefix(d, "doc_id", F.col("n"), 300, 200_000).select("doc_id", "n", "before")


@query("strided_sample", """
WITH d AS (SELECT doc_id, lang, length(text) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents WHERE lang IN ('en', 'de')),
s AS (SELECT lang, CASE lang WHEN 'en' THEN 228571 ELSE 71428 END AS budget, greatest(count(*) // greatest(CAST(floor(CASE lang WHEN 'en' THEN 228571 ELSE 71428 END / greatest(avg(n), 1)) AS BIGINT), 1), 1) AS stride FROM d GROUP BY lang),
p AS (SELECT d.*, budget FROM d JOIN s USING (lang) WHERE i % stride = 0),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT lang, doc_id, n FROM r WHERE before < budget""")
def strided_sample(spark, sf):
    """A budget of 300,000 characters shared 480 to 150 over two domains."""
    total, share = 300_000, {"en": 480, "de": 150}
    budgets = {k: int(total * v / 630) for k, v in share.items()}
    d = docs(spark, sf).select("doc_id", "lang", F.length("text").cast("long").alias("n"))
    return C.strided_sample(d, "doc_id", F.col("n"), budgets, "lang").select("lang", "doc_id", "n")


_LINE = "strlen(CAST(to_json({'text': text}) AS VARCHAR)) + 1"


@query("shard_rollover", f"""
WITH RECURSIVE b AS (SELECT CAST(row_number() OVER (PARTITION BY lang ORDER BY batch) - 1 AS BIGINT) AS i, * FROM (SELECT lang, doc_id // 50 AS batch, CAST(sum({_LINE}) AS BIGINT) AS bytes FROM documents GROUP BY ALL)),
f AS (SELECT lang, i, batch, bytes, CAST(0 AS BIGINT) AS shard, bytes AS fill FROM b WHERE i = 0
  UNION ALL SELECT b.lang, b.i, b.batch, b.bytes, CASE WHEN f.fill > 0 AND f.fill + b.bytes > 100000 THEN f.shard + 1 ELSE f.shard END,
    CASE WHEN f.fill > 0 AND f.fill + b.bytes > 100000 THEN b.bytes ELSE f.fill + b.bytes END FROM f JOIN b ON b.lang = f.lang AND b.i = f.i + 1)
SELECT lang, shard, count(*) AS batches, CAST(sum(bytes) AS BIGINT) AS bytes FROM f GROUP BY ALL""")
def shard_rollover(spark, sf):
    """Batches of 50 document numbers rolled into shards of 100,000 bytes of JSON lines."""
    b = docs(spark, sf).groupBy("lang", F.floor(F.col("doc_id") / 50).cast("long").alias("batch")).agg(F.sum(C.json_line_bytes(F.col("text"))).cast("long").alias("bytes"))
    shards = C.next_fit(b, "batch", "bytes", 100_000, ["lang"])
    return shards.join(b, ["lang", "batch"]).groupBy("lang", "shard").agg(F.count("*").alias("batches"), F.sum("bytes").alias("bytes"))


_HOLDOUT = f"""
d AS (SELECT doc_id, lang, len({_WORDS}) + 1 AS tokens, length(text) AS chars FROM documents),
s AS (SELECT lang, greatest(1, CAST(floor(least(20000 * 2.5 / greatest(avg(chars) / 4, 1), count(*) * 0.5)) AS BIGINT)) AS n FROM d GROUP BY lang),
k AS (SELECT d.*, row_number() OVER (PARTITION BY lang ORDER BY {sql_draw("'20260717'", "lang", "doc_id::VARCHAR")}, doc_id) AS r FROM d),
c AS (SELECT k.*, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 5 AS b FROM k JOIN s USING (lang) WHERE r <= n),
p AS (SELECT lang, b, count(*) AS m, sum(sum(tokens)) OVER (PARTITION BY lang ORDER BY b) AS cum FROM c GROUP BY lang, b),
v AS (SELECT lang, min(b) FILTER (WHERE m = 5 AND cum >= 4000) AS vb, min(cum) FILTER (WHERE m = 5 AND cum >= 4000) AS vc FROM p GROUP BY lang),
t AS (SELECT lang, any_value(vb) AS vb, min(b) FILTER (WHERE m = 5 AND b > vb AND cum - vc >= 4000) AS tb FROM p JOIN v USING (lang) GROUP BY lang),
h AS (SELECT c.doc_id, c.lang, c.tokens, c.chars, CASE WHEN vb IS NULL OR b <= vb THEN 'val' WHEN tb IS NULL OR b <= tb THEN 'test' END AS split FROM c JOIN t USING (lang)),
a AS (SELECT d.doc_id, d.lang, d.tokens, d.chars, coalesce(h.split, 'train') AS split FROM d LEFT JOIN h USING (doc_id))"""


def assigned(spark, sf):
    """R1, X1, X2, P3, U-3: every document with its split; holdout documents are consumed, the rest is train."""
    d = docs(spark, sf).select("doc_id", "lang", (F.size(words(F.col("text"))) + 1).cast("long").alias("tokens"), F.length("text").cast("long").alias("chars"))
    drawn = C.holdout_candidates(d, "doc_id", "lang", F.col("chars"), 20_000, 20260717)
    held = C.sequential_fill(drawn, "doc_id", F.col("tokens"), "lang", 4000, 5).select("doc_id", "split")
    return d.join(held, "doc_id", "left").withColumn("split", F.coalesce("split", F.lit("train")))


@query("holdout_assignment", f"WITH {_HOLDOUT} SELECT doc_id, lang, split FROM a")
def holdout_assignment(spark, sf):
    return assigned(spark, sf).select("doc_id", "lang", "split")


@query("split_token_counts", f"""WITH {_HOLDOUT}
SELECT lang, CAST(coalesce(sum(tokens) FILTER (WHERE split = 'train'), 0) AS BIGINT) AS train, CAST(coalesce(sum(tokens) FILTER (WHERE split = 'val'), 0) AS BIGINT) AS val,
  CAST(coalesce(sum(tokens) FILTER (WHERE split = 'test'), 0) AS BIGINT) AS test, count(*) AS docs, round(sum(chars) / greatest(sum(tokens), 1), 9) AS chars_per_token,
  count(*) FILTER (WHERE split <> 'train') AS docs_held_out FROM a GROUP BY lang""")
def split_token_counts(spark, sf):
    """X3, D7."""
    a = assigned(spark, sf)
    per = [F.coalesce(F.sum(F.when(F.col("split") == s, F.col("tokens"))), F.lit(0)).cast("long").alias(s) for s in ("train", "val", "test")]
    return a.groupBy("lang").agg(*per, F.count("*").alias("docs"), F.round(F.sum("chars") / F.greatest(F.sum("tokens"), F.lit(1)), 9).alias("chars_per_token"), F.count(F.when(F.col("split") != "train", 1)).alias("docs_held_out"))


@query("corpus_totals", f"""WITH {_HOLDOUT}
SELECT coalesce(lang, 'all') AS lang, coalesce(split, 'all') AS split, count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens,
  round(100.0 * sum(tokens) / (SELECT sum(tokens) FROM a), 9) AS percent FROM a GROUP BY ROLLUP (lang, split)""")
def corpus_totals(spark, sf):
    """Totals and percentage shares, with grand totals."""
    a = assigned(spark, sf)
    rolled = a.rollup("lang", "split").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    every = a.agg(F.sum("tokens").alias("every"))
    out = rolled.join(F.broadcast(every))  # one row
    return out.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("split", F.lit("all")).alias("split"), "docs", "tokens", F.round(100.0 * F.col("tokens") / F.col("every"), 9).alias("percent"))


_MIX = {"de": 0.2, "en": 0.7, "fr": 0.1}


@query("mixture_counts", f"""
WITH s AS (SELECT lang AS domain, sum(len({_WORDS}) + 1) AS tokens FROM documents GROUP BY lang),
u AS (SELECT range AS row, {sql_uniform("'7'", "'domain'", "range::VARCHAR")} AS u, {sql_uniform("'7'", "'start'", "range::VARCHAR")} AS w FROM range(20000)),
p AS (SELECT *, CASE WHEN u < 0.2 THEN 'de' WHEN u < 0.8999999999999999 THEN 'en' ELSE 'fr' END AS domain FROM u),
q AS (SELECT domain, least(CAST(floor(w * (tokens - 129 + 1)) AS BIGINT), tokens - 129) AS start FROM p JOIN s USING (domain))
SELECT domain, count(*) AS n, CAST(min(start) AS BIGINT) AS first, CAST(max(start) AS BIGINT) AS last FROM q GROUP BY domain""")
def mixture_counts(spark, sf):
    """R3, R3b, R3c, R9."""
    s = docs(spark, sf).groupBy(F.col("lang").alias("domain")).agg(F.sum(F.size(words(F.col("text"))) + 1).alias("tokens"))
    return C.mixture(s, _MIX, 128, 20_000, 7).groupBy("domain").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("start").alias("last"))


@query("fixed_batches", """
WITH r AS (SELECT lang, length(text) AS n, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 100 AS batch FROM documents)
SELECT lang, batch, count(*) AS docs, CAST(sum(n) AS BIGINT) AS chars FROM r GROUP BY ALL""")
def fixed_batches(spark, sf):
    """W4."""
    d = C.running(docs(spark, sf).select("doc_id", "lang", F.length("text").alias("n")), "doc_id", F.lit(1), "i", ["lang"])
    return d.groupBy("lang", F.floor(F.col("i") / 100).cast("long").alias("batch")).agg(F.count("*").alias("docs"), F.sum("n").cast("long").alias("chars"))
