"""Queries on contamination, vocabulary, windows and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import SQL_WS, sql_draw, words
from ..operators import decon as D
from ..operators import scoring as S
from ..operators import stats as A
from ..operators.corpus import running
from ..sources.scratch import Scratch
from ..sources.tables import spread, table

_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{SQL_WS}'), lambda w: w <> '')"
QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", words(F.col("text")).alias("tokens"))


def items(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", words(F.col("text")).alias("tokens"))


def _grams(table_sql: str, keep: str, n: int) -> str:
    return f"SELECT {keep}, i AS at, array_to_string(w[i:i + {n} - 1], ' ') AS gram FROM (SELECT {keep}, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM {table_sql} WHERE len(w) >= {n})"


_D = f"d AS (SELECT doc_id, lang, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark)"


@query("contamination_ngram", f"""
WITH {_D}, g AS ({_grams('d', 'doc_id', 13)}), h AS (SELECT DISTINCT gram FROM ({_grams('b', 'item_id', 13)}))
SELECT doc_id, count(*) AS windows, count(DISTINCT gram) AS grams FROM g SEMI JOIN h USING (gram) GROUP BY doc_id""")
def contamination_ngram(spark, sf):
    """Documents with a 13-gram of a benchmark item."""
    hits = D.gram_hits(docs(spark, sf), "tokens", ["doc_id"], D.holdout_grams(items(spark, sf), "tokens", 13), 13)
    return hits.groupBy("doc_id").agg(F.count("*").alias("windows"), F.countDistinct("gram").alias("grams"))


_STREAM = "array_concat(w, ['<sep>'])"


@query("decon_report", f"""
WITH {_D}, h AS (SELECT DISTINCT gram FROM ({_grams('b', 'item_id', 13)})),
bad AS (SELECT DISTINCT doc_id FROM ({_grams('d', 'doc_id', 13)}) SEMI JOIN h USING (gram)),
f AS (SELECT d.doc_id, w, bad.doc_id IS NOT NULL AS dropped FROM d LEFT JOIN bad USING (doc_id)),
ks AS (SELECT doc_id // 256 AS shard, doc_id AS o, unnest(list_concat(w, ['<sep>'])) AS tok, generate_subscripts(list_concat(w, ['<sep>']), 1) AS i FROM f WHERE NOT dropped),
bs AS (SELECT 0 AS shard, item_id AS o, unnest(list_concat(w, ['<sep>'])) AS tok, generate_subscripts(list_concat(w, ['<sep>']), 1) AS i FROM b),
kg AS (SELECT string_agg(tok, ' ') OVER x AS gram, count(*) OVER x AS m FROM ks WINDOW x AS (PARTITION BY shard ORDER BY o, i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
bg AS (SELECT string_agg(tok, ' ') OVER x AS gram, count(*) OVER x AS m FROM bs WINDOW x AS (PARTITION BY shard ORDER BY o, i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
r AS (SELECT count(*) AS residual FROM kg SEMI JOIN (SELECT DISTINCT gram FROM bg WHERE m = 13) USING (gram) WHERE m = 13)
SELECT count(*) AS docs_in, count(*) FILTER (WHERE dropped) AS docs_dropped, CAST(coalesce(sum(len(w) + 1) FILTER (WHERE NOT dropped), 0) AS BIGINT) AS tokens_kept,
  CAST(coalesce(sum(len(w) + 1) FILTER (WHERE dropped), 0) AS BIGINT) AS tokens_dropped, (SELECT residual FROM r) AS residual FROM f""")
def decon_report(spark, sf):
    """Counters of the filter, and what is left across documents."""
    d, b = docs(spark, sf), items(spark, sf)
    flagged = D.split_contaminated(d, "doc_id", "tokens", D.holdout_grams(b, "tokens", 13), 13)
    left = D.residual(flagged.filter(~F.col("dropped")), b, "doc_id", "tokens", 13, F.floor(F.col("doc_id") / 256), "item_id")
    return D.counters(flagged, "tokens").join(left.agg(F.sum("windows").cast("long").alias("residual")))  # one row each


_SPLIT = f"CASE WHEN {sql_draw(chr(39) + '3' + chr(39), 'doc_id::VARCHAR')} % 20 = 0 THEN 'val' WHEN {sql_draw(chr(39) + '3' + chr(39), 'doc_id::VARCHAR')} % 20 = 1 THEN 'test' ELSE 'train' END"


@query("leakage_gate", f"""
WITH {_D}, s AS (SELECT doc_id, w, {_SPLIT} AS split FROM d),
g AS ({_grams('s', 'split, doc_id', 13)}), gz AS (SELECT *, (g.at) - 1 AS z FROM g),
p AS (SELECT split, gram FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {sql_draw("'9'", "split", "doc_id::VARCHAR", "z::VARCHAR")}, doc_id, z) AS r FROM gz WHERE split <> 'train') WHERE r <= 64),
t AS (SELECT DISTINCT gram FROM g WHERE split = 'train')
SELECT p.split, count(*) AS samples, count(t.gram) AS leaks, true AS control, count(t.gram) = 0 AS passed FROM p LEFT JOIN t USING (gram) GROUP BY p.split""")
def leakage_gate(spark, sf):
    """R4, J2, A17, T-4."""
    from ..functions.text import draw

    k = F.pmod(draw(3, F.col("doc_id")), F.lit(20))
    s = docs(spark, sf).withColumn("split", F.when(k == 0, "val").when(k == 1, "test").otherwise("train"))
    return D.leak_report(s.filter(F.col("split") != "train"), s.filter(F.col("split") == "train"), "split", "doc_id", "tokens", 13, 64, 9)


_H = f"""{_D}, t AS (SELECT lang, unnest(list_concat(w, ['<sep>'])) AS tok FROM d), h AS (SELECT tok, count(*) AS n FROM t GROUP BY tok)"""


def _tokens(spark, sf):
    return docs(spark, sf).select("lang", F.explode(F.concat("tokens", F.array(F.lit("<sep>")))).alias("tok"))


def _sep():
    return F.col("tok") == "<sep>"


@query("vocab_thresholds", f"WITH {_H} SELECT CAST(t AS BIGINT) AS at_least, (SELECT count(*) FROM h WHERE n >= t) AS tokens FROM (SELECT unnest([1, 10, 100, 1000, 10000]) AS t)")
def vocab_thresholds(spark, sf):
    """A2, A3."""
    return A.thresholds(A.histogram(_tokens(spark, sf), "tok"))


@query("vocab_rare_share", f"WITH {_H} SELECT CAST(t AS BIGINT) AS below, round((SELECT count(*) FROM h WHERE n < t AND tok <> '<sep>') / (SELECT count(*) FROM h WHERE tok <> '<sep>'), 9) AS share FROM (SELECT unnest([10, 100]) AS t)")
def vocab_rare_share(spark, sf):
    """A4, T10."""
    return A.rare_share(A.histogram(_tokens(spark, sf), "tok"), _sep()).withColumn("share", F.round("share", 9))


@query("vocab_coverage", f"""WITH {_H}, r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS k FROM h WHERE tok <> '<sep>')
SELECT CAST(t AS BIGINT) AS k, round((SELECT sum(n) FROM r WHERE r.k <= t) / (SELECT sum(n) FROM r), 9) AS share FROM (SELECT unnest([100, 500, 1000, 4000, 8000]) AS t)""")
def vocab_coverage(spark, sf):
    """A5, T-3."""
    return A.top_mass(A.histogram(_tokens(spark, sf), "tok"), _sep()).withColumn("share", F.round("share", 9))


@query("vocab_domains", f"WITH {_H} SELECT lang, count(*) AS tokens, count(DISTINCT tok) AS different FROM t GROUP BY lang")
def vocab_domains(spark, sf):
    """A32, U-1, U-4."""
    return A.histogram(_tokens(spark, sf), "tok", ["lang"]).groupBy("lang").agg(F.sum("n").alias("tokens"), F.count("*").alias("different"))


@query("top_tokens", f"WITH {_H} SELECT tok, n FROM h WHERE tok <> '<sep>' ORDER BY n DESC, tok LIMIT 50")
def top_tokens(spark, sf):
    """A6, T-2, T11: a report of the 50 most frequent tokens."""
    return A.top_tokens(A.histogram(_tokens(spark, sf), "tok"), "tok", _sep(), 50)


_CTX, _EARLY, _LATE = 64, (8, 16), (48, 56)
_V = f"{sql_draw(chr(39) + '5' + chr(39), 'doc_id::VARCHAR')} % 10 = 0"
_STREAMS = f"""{_D}, e AS (SELECT doc_id, lang, {_V} AS held, unnest(list_concat(w, ['<sep>'])) AS tok, generate_subscripts(list_concat(w, ['<sep>']), 1) AS i FROM d),
st AS (SELECT lang, held, tok, row_number() OVER (PARTITION BY lang, held ORDER BY doc_id, i) - 1 AS pos, CASE WHEN i = 1 THEN '<sep>' ELSE lag(tok) OVER (PARTITION BY lang, held ORDER BY doc_id, i) END AS prev FROM e),
wn AS (SELECT lang, greatest((count(*) - 1) // {_CTX}, 0) AS nw FROM st WHERE held GROUP BY lang),
tg AS (SELECT lang, tok, prev, (pos - 1) // {_CTX} AS w, (pos - 1) % {_CTX} AS off FROM st JOIN wn USING (lang) WHERE held AND pos > 0 AND (pos - 1) // {_CTX} < nw)"""
_SCORED = f"""{_STREAMS}, u1 AS (SELECT tok, count(*) AS c1 FROM st WHERE NOT held GROUP BY tok), u2 AS (SELECT prev, tok, count(*) AS c2 FROM st WHERE NOT held GROUP BY ALL),
u0 AS (SELECT prev, count(*) AS c0 FROM st WHERE NOT held GROUP BY prev), tt AS (SELECT sum(c1)::DOUBLE AS n, count(*) AS v FROM u1),
sc AS (SELECT tg.*, -ln(0.5 * (coalesce(c1, 0) + 1.0) / (n + v + 1.0) + 0.5 * coalesce(c2 / c0, 0.0)) AS nll FROM tg LEFT JOIN u1 USING (tok) LEFT JOIN u2 ON u2.prev = tg.prev AND u2.tok = tg.tok LEFT JOIN u0 ON u0.prev = tg.prev CROSS JOIN tt),
wl AS (SELECT lang, w, avg(nll) AS m, count(*) AS n, avg(nll) FILTER (WHERE off >= {_LATE[0]} AND off < {_LATE[1]}) AS late, avg(nll) FILTER (WHERE off >= {_EARLY[0]} AND off < {_EARLY[1]}) AS early FROM sc GROUP BY ALL)"""


def _streams(spark, sf):
    from ..functions.text import draw

    d = docs(spark, sf).withColumn("held", F.pmod(draw(5, F.col("doc_id")), F.lit(10)) == 0)
    return S.token_stream(d.filter("held"), "doc_id", "tokens", "lang"), S.token_pairs(d.filter(~F.col("held")), "tokens", "lang")


@query("eval_windows", f"WITH {_STREAMS} SELECT lang, count(DISTINCT w) AS windows, count(*) AS targets, CAST(max(w) AS BIGINT) AS last FROM tg GROUP BY lang")
def eval_windows(spark, sf):
    """W1, W2, P6, D12, T8."""
    t = S.window_of_target(_streams(spark, sf)[0], "lang", _CTX)
    return t.groupBy("lang").agg(F.countDistinct("w").alias("windows"), F.count("*").alias("targets"), F.max("w").alias("last"))


def _losses(spark, sf):
    held, train = _streams(spark, sf)
    held = Scratch(spark, "losses").cut(held, "held")  # read for sizes, for pairs and for losses
    scored = S.ngram_nll(S.window_of_target(held, "lang", _CTX), train)
    return S.window_losses(scored, ["lang"], _EARLY, _LATE)


@query("perplexity_by_domain", f"WITH {_SCORED} SELECT lang, count(*) AS windows, CAST(sum(n) AS BIGINT) AS tokens, round(exp(sum(m * n) / sum(n)), 6) AS perplexity FROM wl GROUP BY lang")
def perplexity_by_domain(spark, sf):
    """A7, M3, D13."""
    return S.perplexity(_losses(spark, sf), ["lang"]).withColumn("perplexity", F.round("perplexity", 6))


@query("icl_score", f"WITH {_SCORED} SELECT lang, round(avg(late) - avg(early), 6) AS icl FROM wl GROUP BY lang")
def icl_score(spark, sf):
    """A8, T9."""
    return S.icl_score(_losses(spark, sf), ["lang"]).withColumn("icl", F.round("icl", 6))


@query("val_curve", f"""WITH {_SCORED}, un AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY w) - 1 AS unit, m, n FROM wl),
sz AS (SELECT lang, count(*) AS k FROM un GROUP BY lang),
dr AS (SELECT lang, r, {sql_draw("'11'", "r::VARCHAR", "j::VARCHAR")} % k AS unit FROM (SELECT lang, k, unnest(range(k)) AS j FROM sz) CROSS JOIN (SELECT unnest(range(100)) AS r)),
bs AS (SELECT lang, r, exp(sum(m * n) / sum(n)) AS s FROM dr JOIN un USING (lang, unit) GROUP BY ALL)
SELECT p.lang, windows, round(point, 6) AS point, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, windows >= 512 AS capped
FROM (SELECT lang, count(*) AS windows, exp(sum(m * n) / sum(n)) AS point FROM wl GROUP BY lang) p JOIN (SELECT lang, quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi FROM bs GROUP BY lang) c USING (lang)""")
def val_curve(spark, sf):
    """Perplexity with a bootstrap interval per domain."""
    units = Scratch(spark, "val-curve").cut(running(_losses(spark, sf), "w", F.lit(1), "unit", ["lang"]).select("lang", "unit", "mean_nll", "n"), "units")
    stat = lambda k: F.exp(F.sum(F.col("mean_nll") * F.col("n") * k) / F.sum(F.col("n") * k))
    out = S.bootstrap(units, stat, 100, 11, by=["lang"])
    return out.select("lang", F.col("units").alias("windows"), *[F.round(c, 6).alias(c) for c in ("point", "ci_low", "ci_high")], (F.col("units") >= 512).alias("capped"))


def kneser_ney_null(spark, sf):
    """Mean loss per language of an interpolated trigram model of the train documents on the held-out ones."""
    from ..functions.text import draw
    from ..operators.extensions import kneser_ney

    d = docs(spark, sf).withColumn("held", F.pmod(draw(5, F.col("doc_id")), F.lit(10)) == 0)
    own = d.select("lang", "held", F.concat(F.array(F.lit("<sep>"), F.lit("<sep>")), "tokens", F.array(F.lit("<sep>"))).alias("t"))
    later = lambda i: F.slice("t", F.lit(i + 1), F.size("t") - 2)
    grams = own.select("lang", "held", F.explode_outer(F.arrays_zip(*[later(i).alias(f"t{i}") for i in range(3)])).alias("z")).select("lang", "held", F.array("z.t0", "z.t1", "z.t2").alias("w"))
    asked = Scratch(spark, "asked").cut(grams.filter("held").groupBy("lang", "w").agg(F.count("*").alias("n")), "grams")  # each different one once
    vocabulary = d.select(F.explode_outer(F.concat("tokens", F.array(F.lit("<sep>")))).alias("word"))
    scored = kneser_ney(grams.filter(~F.col("held")).select("w"), asked, 3, vocabulary=vocabulary)
    return scored.groupBy("lang").agg(F.sum("n").alias("tokens"), (F.sum(F.col("nll") * F.col("n")) / F.sum("n")).alias("nll"))


QUERIES["kneser_ney_null"] = kneser_ney_null
