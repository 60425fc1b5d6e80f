"""Queries on attention readings and model outputs. Readings are built from ``events`` (a reading is an event, its value the
weight or score), sequences for a small NumPy decoder from ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import draw, sql_draw
from ..operators import attention as A
from ..operators import kernel as K
from ..operators import scoring as S
from ..sources.scratch import Scratch
from ..sources.tables import spread, table
from .text_queries import _D, _V, docs

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_R, _N = 4, 8
_WHOLE = "(SELECT (max(event_id) + 1) // 384 FROM events)"
_ATTN = f"""g AS (SELECT event_id // 384 AS seq, event_id // 192 % 2 AS layer, event_id // 64 % 3 AS head, event_id // 8 % 8 AS q, event_id % 8 AS k, value AS u FROM events WHERE event_id // 384 < {_WHOLE}),
a AS (SELECT seq, layer, head, q, k, u / sum(u) OVER (PARTITION BY seq, layer, head, q) AS w FROM g WHERE k <= q)"""


def cells(spark, sf):
    """Events as numbered readings: id, value."""
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), "value")


def attn(spark, sf):
    """Attention of whole sequences of 384 events: 2 layers, 3 heads, 8 positions; values are weights before normalising."""
    from pyspark.sql import Window

    i, e = F.col("id"), cells(spark, sf)
    whole = e.agg(F.floor((F.max("id") + 1) / 384).alias("_n"))
    e = e.join(F.broadcast(whole)).filter(F.floor(i / 384) < F.col("_n"))  # one row
    g = e.select(F.floor(i / 384).alias("seq"), (F.floor(i / 192) % 2).alias("layer"), (F.floor(i / 64) % 3).alias("head"), (F.floor(i / 8) % 8).alias("q"), (i % 8).alias("k"), F.col("value").alias("u"))
    u, total = F.col("u"), F.col("_total")
    # a row without any weight gives what division of doubles gives, as in SQL, and no error
    none = F.when(u > 0, float("inf")).when(u < 0, float("-inf")).otherwise(F.when(u == 0, float("nan")))
    g = g.filter("k <= q").withColumn("_total", F.sum("u").over(Window.partitionBy("seq", "layer", "head", "q")))
    return g.withColumn("w", F.when(total == 0, none).otherwise(u / total)).drop("u", "_total")


@query("attention_pairs", f"""WITH {_ATTN} SELECT seq, layer, head, round(avg(w) FILTER (WHERE q >= 4 AND k = q - 3), 9) AS prefix_matching, round(avg(w) FILTER (WHERE q >= 1 AND k = q - 1), 9) AS prev_token, round(avg(w) FILTER (WHERE q >= 4 AND k = q - 4), 9) AS duplicate_token,
round(avg(w) FILTER (WHERE k = q), 9) AS current_token, round(avg(w) FILTER (WHERE q >= 1 AND k = 0), 9) AS first_token, round(avg(w) FILTER (WHERE q < 4 AND q >= 1 AND k = q - 1), 9) AS prefix_matching_first_half FROM a GROUP BY ALL""")
def attention_pairs(spark, sf):
    """A13, M8, D16."""
    return A.pair_means(attn(spark, sf), _R).select("seq", "layer", "head", *[F.round(c, 9).alias(c) for c in A.PATTERNS])


@query("attention_entropy", f"WITH {_ATTN}, r AS (SELECT seq, layer, head, q, sum(CASE WHEN w > 0 THEN -w * ln(w) ELSE 0 END) / ln(any_value(q) + 1.0) AS h FROM a WHERE q >= 1 GROUP BY ALL) SELECT seq, layer, head, round(avg(h), 9) AS entropy FROM r GROUP BY ALL")
def attention_entropy(spark, sf):
    """A14."""
    return A.row_entropy(attn(spark, sf)).withColumn("entropy", F.round("entropy", 9))


@query("best_heads", f"WITH {_ATTN}, s AS (SELECT seq, layer, head, round(avg(w) FILTER (WHERE q >= 1 AND k = q - 1), 9) AS prev_token FROM a GROUP BY ALL) SELECT seq, layer, head, prev_token FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY prev_token DESC, layer, head) AS r FROM s) WHERE r = 1")
def best_heads(spark, sf):
    """A19."""
    s = A.pair_means(attn(spark, sf), _R).withColumn("prev_token", F.round("prev_token", 9))
    return A.best_head(s, "prev_token", ["seq"])


_SCORES = "s AS (SELECT event_id // 2000 AS layer, event_id % 16 AS head, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS score FROM events GROUP BY ALL)"


@query("matched_controls", f"WITH {_SCORES}, n AS (SELECT layer, count(*) FILTER (WHERE score > 0.23) AS want FROM s GROUP BY layer), d AS (SELECT layer, head, row_number() OVER (PARTITION BY layer ORDER BY {sql_draw(chr(39) + '8' + chr(39), 'layer::VARCHAR', 'head::VARCHAR')}, head) AS r FROM s WHERE NOT score > 0.23) SELECT d.layer, head FROM d JOIN n USING (layer) WHERE r <= want")
def matched_controls(spark, sf):
    """R7, P11, U-3, T1: heads are 16 parts of 2,000 events, scored by their share of purchases."""
    i = F.col("event_id")
    s = table(spark, sf, "events").groupBy(F.floor(i / 2000).alias("layer"), (i % 16).alias("head")).agg(F.avg((F.col("event_type") == "purchase").cast("double")).alias("score"))
    return A.matched_controls(s, "score", 0.23, 8, short=True)


@query("median_rank", "WITH m AS (SELECT event_id // 256 AS layer, event_id // 64 % 4 AS head, event_id // 8 % 8 AS i, event_id % 8 AS j, value AS v FROM events), r AS (SELECT layer, head, i, count(*) FILTER (WHERE v > d) AS rank FROM m JOIN (SELECT layer, head, i, v AS d FROM m WHERE i = j) USING (layer, head, i) GROUP BY ALL) SELECT layer, head, quantile_cont(rank::DOUBLE, 0.5) AS median_rank FROM r GROUP BY ALL")
def median_rank(spark, sf):
    """8 by 8 matrices of 64 events each."""
    i = F.col("id")
    m = cells(spark, sf).select(F.floor(i / 256).alias("layer"), (F.floor(i / 64) % 4).alias("head"), (F.floor(i / 8) % 8).alias("i"), (i % 8).alias("j"), F.col("value").alias("v"))
    return A.median_rank(m)


_BLOCK = f"b AS (SELECT seq, list_concat(x, x) AS ids FROM (SELECT doc_id AS seq, list_transform(range(5), lambda i: 1 + {sql_draw(chr(39) + 'SEED' + chr(39), 'doc_id::VARCHAR', 'i::VARCHAR')} % 99) AS x FROM documents))"


def seqs(spark, sf):
    """A sequence for each document."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("seq"))


@query("repeated_blocks", f"WITH {_BLOCK.replace('SEED', '1')} SELECT seq, p AS pos, ids[p] AS id FROM (SELECT seq, ids, unnest(range(1, 11)) AS p FROM b)")
def repeated_blocks(spark, sf):
    """R5, D14."""
    b = A.repeated_blocks(seqs(spark, sf), 5, 100, 1)
    return b.select("seq", F.posexplode("ids").alias("p", "id")).select("seq", (F.col("p") + 1).cast("long").alias("pos"), "id")


@query("corrupted_targets", f"WITH {_BLOCK.replace('SEED', '1')}, {_BLOCK.replace('SEED', '2').replace('b AS', 'c AS')} SELECT seq, p + 4 AS pos, b.ids[p + 1] AS right, c.ids[p + 1] AS wrong FROM b JOIN c USING (seq), (SELECT unnest(range(1, 5)) AS p)")
def corrupted_targets(spark, sf):
    """P10."""
    make = lambda seed: A.repeated_blocks(seqs(spark, sf), 5, 100, seed)
    return A.corrupted(make(1), make(2), 5).withColumn("pos", F.col("pos").cast("long"))


_COPY = "s AS (SELECT event_id // 8 AS seq, event_id % 8 AS pos, value / 100 AS nll FROM events)"


@query("copying_metrics", f"WITH {_COPY}, p AS (SELECT seq, avg(CASE WHEN nll < 0.3 THEN 1.0 ELSE 0.0 END) FILTER (WHERE pos BETWEEN 4 AND 6) AS m, avg(nll) FILTER (WHERE pos BETWEEN 4 AND 6) AS s2, avg(nll) FILTER (WHERE pos <= 2) AS s1 FROM s GROUP BY seq) SELECT count(*) AS sequences, round(avg(m), 9) AS exact_match, round(avg(s2) - avg(s1), 9) AS copying FROM p")
def copying_metrics(spark, sf):
    """A9, P9, D15."""
    i = F.col("id")
    s = cells(spark, sf).select(F.floor(i / 8).alias("seq"), (i % 8).alias("pos"), (F.col("value") / 100).alias("nll")).withColumn("exact", F.col("nll") < 0.3)
    return A.copying(s, 4).select("sequences", F.round("exact_match", 9).alias("exact_match"), F.round("copying", 9).alias("copying"))


@query("paired_accuracy", "WITH p AS (SELECT lang AS paradigm, doc_id // 2 AS item, max(n_chars) FILTER (WHERE doc_id % 2 = 0) AS good, max(n_chars) FILTER (WHERE doc_id % 2 = 1) AS bad FROM documents GROUP BY ALL) SELECT paradigm, count(*) AS pairs, round(avg(CASE WHEN good > bad THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM p WHERE good IS NOT NULL AND bad IS NOT NULL GROUP BY paradigm")
def paired_accuracy(spark, sf):
    """Pairs of neighbouring documents of one language, scored by length."""
    side = lambda k: F.max(F.when(F.col("doc_id") % 2 == k, F.col("n_chars")))
    p = table(spark, sf, "documents").groupBy(F.col("lang").alias("paradigm"), F.floor(F.col("doc_id") / 2)).agg(side(0).alias("good"), side(1).alias("bad")).filter("good is not null and bad is not null")
    return A.pair_accuracy(p, ["paradigm"]).withColumn("accuracy", F.round("accuracy", 9))


_UNITS = "u AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS unit, m, n FROM (SELECT user_id, round(avg(value), 6) AS m, count(*) AS n FROM events GROUP BY user_id))"


@query("bootstrap_ci", f"""WITH {_UNITS}, k AS (SELECT count(*) AS k FROM u), d AS (SELECT r, {sql_draw("'12'", "r::VARCHAR", "j::VARCHAR")} % k AS unit FROM (SELECT id // k AS r, id % k AS j, k FROM k, (SELECT range AS id FROM range(200 * (SELECT k FROM k))))),
b AS (SELECT r, sum(m * n) / sum(n) AS s FROM d JOIN u USING (unit) GROUP BY r) SELECT (SELECT k FROM k) AS units, round((SELECT sum(m * n) / sum(n) FROM u), 6) AS point, round(quantile_cont(s, 0.025), 6) AS ci_low, round(quantile_cont(s, 0.975), 6) AS ci_high FROM b""")
def bootstrap_ci(spark, sf):
    """R6, A11, T6."""
    from ..operators.corpus import running

    u = table(spark, sf, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("m"), F.count("*").alias("n"))
    u = Scratch(spark, "units").cut(running(u, "user_id", F.lit(1), "unit").select("unit", "m", "n"), "units")
    out = S.bootstrap(u, lambda k: F.sum(F.col("m") * F.col("n") * k) / F.sum(F.col("n") * k), 200, 12)
    return out.select("units", *[F.round(c, 6).alias(c) for c in ("point", "ci_low", "ci_high")])


@query("head_intervals", f"""WITH {_ATTN}, u AS (SELECT layer, head, seq AS unit, avg(w) FILTER (WHERE q >= 1 AND k = q - 1) AS v FROM a GROUP BY ALL), n AS (SELECT {_WHOLE} AS n),
d AS (SELECT r, {sql_draw("'13'", "r::VARCHAR", "j::VARCHAR")} % n AS unit FROM n, (SELECT range AS r FROM range(100)), (SELECT DISTINCT unit AS j FROM u)), b AS (SELECT layer, head, r, avg(v) AS s FROM d JOIN u USING (unit) GROUP BY ALL)
SELECT layer, head, round(any_value(p), 6) AS point, round(quantile_cont(s, 0.025), 6) AS ci_low, round(quantile_cont(s, 0.975), 6) AS ci_high FROM b JOIN (SELECT layer, head, avg(v) AS p FROM u GROUP BY ALL) USING (layer, head) GROUP BY ALL""")
def head_intervals(spark, sf):
    """An interval for every head, from the same draws of sequences."""
    u = A.pair_means(attn(spark, sf), _R).select("layer", "head", F.col("seq").alias("unit"), F.col("prev_token").alias("v"))
    u = Scratch(spark, "units").cut(u, "units")
    out = S.bootstrap(u, lambda k: F.sum(F.col("v") * k) / F.sum(k + F.lit(0)), 100, 13, by=["layer", "head"])
    return out.select("layer", "head", *[F.round(c, 6).alias(c) for c in ("point", "ci_low", "ci_high")])


@query("paired_deltas", "WITH p AS (SELECT user_id AS unit, sum(value) FILTER (WHERE event_type = 'view') AS b, sum(value) FILTER (WHERE event_type = 'click') AS t FROM events GROUP BY user_id) SELECT count(*) AS units, round(avg(coalesce(t, 0) - coalesce(b, 0)), 6) AS delta FROM p")
def paired_deltas(spark, sf):
    """Sums of two conditions for the same units."""
    e = table(spark, sf, "events")
    side = lambda x: e.groupBy(F.col("user_id").alias("unit")).agg(F.coalesce(F.sum(F.when(F.col("event_type") == x, F.col("value"))), F.lit(0.0)).alias("v"))
    return A.paired_deltas(side("view"), side("click"), ["unit"], "v").agg(F.count("*").alias("units"), F.round(F.avg("delta"), 6).alias("delta"))


@query("recovered_fraction", "SELECT event_id AS id, CASE WHEN abs((event_id % 5) / 10.0) >= 1e-12 THEN round((value - 1.0) / ((event_id % 5) / 10.0), 6) END AS fraction FROM events")
def recovered_fraction(spark, sf):
    """A30."""
    i = F.col("event_id")
    return table(spark, sf, "events").select(i.alias("id"), F.round(A.recovered(F.col("value"), F.lit(1.0), 1.0 + i % 5 / 10.0), 6).alias("fraction"))


@query("position_means", "WITH o AS (SELECT event_id // 48 % 2 AS layer, event_id // 12 % 4 AS pos, event_id // 4 % 3 AS head, event_id % 4 AS dim, value FROM events) SELECT layer, pos, head, dim, round(avg(value), 9) AS mean FROM o GROUP BY ALL")
def position_means(spark, sf):
    """Sequences of 96 events."""
    i = F.col("id")
    o = cells(spark, sf).select(F.floor(i / 96).alias("seq"), (F.floor(i / 48) % 2).alias("layer"), (F.floor(i / 12) % 4).alias("pos"), (F.floor(i / 4) % 3).alias("head"), (i % 4).alias("dim"), "value")
    return A.position_means(o).withColumn("mean", F.round("mean", 9))


@query("drawn_ids", f"SELECT id FROM (SELECT p_partkey AS id, {sql_draw(chr(39) + '14' + chr(39), 'p_partkey::VARCHAR')} AS d FROM part) ORDER BY d, id LIMIT 256")
def drawn_ids(spark, sf):
    """A sampling operator."""
    return A.drawn_ids(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), 256, 14)


_NAMES = ("embed.weight", "lm_head.weight", "layers.3.attn_norm.weight", "final_norm.weight", "layers.3.attn.q.weight", "pos_embed.weight", "lm_head.bias", "layers.0.embed.proj")


@query("decayed_parameters", f"SELECT p_partkey AS id, x NOT IN ('embed.weight', 'lm_head.weight') AND NOT ends_with(x, '_norm.weight') AS decayed FROM (SELECT p_partkey, {list(_NAMES)}[CAST(p_partkey % {len(_NAMES)} AS INT) + 1] AS x FROM part)")
def decayed_parameters(spark, sf):
    """P8."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), A.decayed(F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES)).cast("int") + 1)).alias("decayed"))


def decoder():
    """An untrained decoder with a vocabulary of 64."""
    return K.random_model(64, 32, 4, 2, 0)


@query("kernel_copying")
def kernel_copying(spark, sf):
    """The copying reading of an untrained decoder over a sequence for each document."""
    m = decoder()
    return A.copying(K.token_losses(A.repeated_blocks(spread(seqs(spark, sf)), 8, len(m.embed), 1), m), 8)


@query("kernel_attention")
def kernel_attention(spark, sf):
    """M2, M8: attention readings of an untrained decoder over a sequence for each document."""
    m = decoder()
    once = seqs(spark, sf).distinct()  # equal numbers have equal sequences
    dealt = once.repartition(4 * spark.sparkContext.defaultParallelism)  # numbers alone are too few bytes for more than a task or two
    return K.attention_means(A.repeated_blocks(dealt, 8, len(m.embed), 1), m, 8)


@query("kernel_patching")
def kernel_patching(spark, sf):
    """Recovered fractions of each head of an untrained decoder over a pair for each document."""
    m = decoder()
    make = lambda seed: A.repeated_blocks(dealt, 8, len(m.embed), seed)
    # more tasks than the few bytes of the ids would give; joined where they lie, as both sides are dealt by seq
    dealt = seqs(spark, sf).repartition(4 * spark.sparkContext.defaultParallelism, "seq")
    clean, other = make(1), make(2)
    pairs = clean.withColumnRenamed("ids", "clean").join(other.select("seq", F.col("ids").alias("x")).hint("merge"), "seq").select("seq", "clean", F.concat(F.slice("x", 1, 8), F.slice("clean", 9, 8)).alias("corrupt"))
    rows = K.patched_rows(pairs, m, [(i, h) for i in range(2) for h in range(4)], 8)
    return rows.groupBy("layer", "head").agg(F.avg("patched").alias("patched"), A.recovered(F.avg("patched"), F.avg("corrupt"), F.avg("clean")).alias("fraction"))


@query("kernel_ov")
def kernel_ov(spark, sf):
    """M4: OV copying scores of a decoder that has every vector of ``embeddings`` as a token: products are summed by Spark."""
    e = table(spark, sf, "embeddings").select("embedding")
    size = len(e.first()["embedding"])
    return K.ov_scores(K.gram(e, "embedding"), K.random_model(2, size, 4, 2, 0))


@query("sequence_scores", f"""WITH {_D}, h AS (SELECT *, {_V} AS held FROM d), e AS (SELECT doc_id, held, unnest(list_concat(w, ['<sep>'])) AS tok, generate_subscripts(list_concat(w, ['<sep>']), 1) - 1 AS pos FROM h),
p AS (SELECT *, CASE WHEN pos = 0 THEN '<sep>' ELSE lag(tok) OVER (PARTITION BY doc_id ORDER BY pos) END AS prev FROM e),
u1 AS (SELECT tok, count(*) AS c1 FROM p WHERE NOT held GROUP BY tok), u2 AS (SELECT prev, tok, count(*) AS c2 FROM p WHERE NOT held GROUP BY ALL), u0 AS (SELECT prev, count(*) AS c0 FROM p WHERE NOT held GROUP BY prev), tt AS (SELECT sum(c1)::DOUBLE AS n, count(*) AS v FROM u1)
SELECT p.doc_id, count(*) AS tokens, round(sum(ln(0.5 * (coalesce(c1, 0) + 1.0) / (n + v + 1.0) + 0.5 * coalesce(c2 / c0, 0.0))) FILTER (WHERE pos > 0), 6) AS logprob
FROM p LEFT JOIN u1 USING (tok) LEFT JOIN u2 ON u2.prev = p.prev AND u2.tok = p.tok LEFT JOIN u0 ON u0.prev = p.prev CROSS JOIN tt WHERE held GROUP BY p.doc_id HAVING count(*) >= 2""")
def sequence_scores(spark, sf):
    """The summed log probability of each held-out document under the n-gram model of the others."""
    d = docs(spark, sf).withColumn("held", F.pmod(draw(5, F.col("doc_id")), F.lit(10)) == 0)
    own = d.filter("held").filter(F.size("tokens") > 0).withColumn("_t", F.concat("tokens", F.array(F.lit("<sep>"))))
    each = own.select("doc_id", F.posexplode_outer(F.arrays_zip(F.concat(F.array(F.lit("<sep>")), "tokens").alias("p"), F.col("_t").alias("t"))).alias("pos", "z")).select("doc_id", "pos", F.col("z.p").alias("prev"), F.col("z.t").alias("tok"))
    scored = S.ngram_nll(each, S.token_pairs(d.filter(~F.col("held")), "tokens", "lang"))
    return S.sequence_logprob(scored, ["doc_id"], "pos", "nll", 1 << 30).withColumn("logprob", F.round("logprob", 6))
