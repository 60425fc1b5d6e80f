"""Queries over files: each writes files from the given tables and reads them back with the library's own sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import SQL_WS, hashed_ids, non_blank, sql_draw, sql_uniform, strip, uniform, words
from ..operators import blocks as B
from ..operators import corpus as C
from ..operators import logs as L
from ..operators import scoring as S
from ..operators.corpus import running
from ..sources import readers as R
from ..sources import token_source as TS
from ..sources import versioned as V
from ..sources import writers as W
from ..sources.scratch import Scratch
from ..sources.tables import spread, table
from ..streaming import monitor as M
from .control import chosen
from .corpus_queries import _MIX
from .curve_queries import _LOG, _POINTS, log, points
from .text_queries import SQL as TEXT_SQL
from .text_queries import leakage_gate

QUERIES, SQL = {}, {}
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{SQL_WS}'), lambda w: w <> '')"
_STRIP = rf"regexp_replace(text, '^{SQL_WS}|{SQL_WS}$', '', 'g')"
_CTX = 32


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _ids(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "lang", "text"))
    return d.select("doc_id", "lang", hashed_ids(words(F.col("text"))).alias("ids"))


_TOKENS = f"t AS (SELECT doc_id, lang, unnest(list_concat({_WORDS}, ['<sep>'])) AS tok, generate_subscripts(list_concat({_WORDS}, ['<sep>']), 1) AS i FROM documents)"
_PICKED = f"""u AS (SELECT range AS row, {sql_uniform("'7'", "'domain'", "range::VARCHAR")} AS u, {sql_uniform("'7'", "'start'", "range::VARCHAR")} AS w FROM range(2000)),
z AS (SELECT lang AS domain, count(*) AS tokens FROM t GROUP BY lang),
p AS (SELECT *, CASE WHEN u < 0.2 THEN 'de' WHEN u < 0.8999999999999999 THEN 'en' ELSE 'fr' END AS domain FROM u),
q AS (SELECT row, domain, least(CAST(floor(w * (tokens - {_CTX + 1} + 1)) AS BIGINT), tokens - {_CTX + 1}) AS start FROM p JOIN z USING (domain))"""


@query("mixture_windows", f"""WITH {_TOKENS}, {_PICKED},
st AS (SELECT lang AS domain, tok, row_number() OVER (PARTITION BY lang ORDER BY doc_id, i) - 1 AS pos FROM t),
e AS (SELECT row, domain, start, unnest(range({_CTX + 1})) AS k FROM q)
SELECT row, e.domain, start, string_agg(tok, ' ' ORDER BY k) FILTER (WHERE k < {_CTX}) AS x, string_agg(tok, ' ' ORDER BY k) FILTER (WHERE k > 0) AS y FROM e JOIN st ON st.domain = e.domain AND st.pos = e.start + e.k GROUP BY ALL""")
def mixture_windows(spark, sf):
    """The batches of a mixture with their tokens, read from a table bucketed by block."""
    d = spread(table(spark, sf, "documents").select("doc_id", "lang", "text"))
    d = d.select("doc_id", F.col("lang").alias("domain"), F.concat(words(F.col("text")), F.array(F.lit("<sep>"))).alias("t"))
    scratch = Scratch(spark, "blocks")
    name = "corpusloom_" + scratch.root.rsplit("-", 1)[-1]
    size = table(spark, sf, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = B.save_blocks(B.token_blocks(d, "doc_id", "t", ["domain"], 4096), name, scratch.path("table"), ["domain"], B.buckets_of(size))
    sizes = blocks.groupBy("domain").agg(F.sum(F.size("tokens")).alias("tokens"))
    picks = C.mixture(sizes, _MIX, _CTX, 2000, 7)
    read = B.batch(B.windows(blocks, picks, _CTX + 1, ["domain"], 4096))
    return read.select("row", "domain", "start", *[F.array_join(c, " ").alias(c) for c in "xy"])


_SHARDS = f"""b AS (SELECT CAST(row_number() OVER (PARTITION BY lang ORDER BY batch) - 1 AS BIGINT) AS i, * FROM (SELECT lang, doc_id // 50 AS batch, CAST(sum(len({_WORDS}) + 1) AS BIGINT) AS n FROM documents GROUP BY ALL)),
f AS (SELECT lang, i, batch, CAST(0 AS BIGINT) AS shard, n AS fill FROM b WHERE i = 0
  UNION ALL SELECT b.lang, b.i, b.batch, CASE WHEN f.fill > 0 AND f.fill + b.n > 20000 THEN f.shard + 1 ELSE f.shard END, CASE WHEN f.fill > 0 AND f.fill + b.n > 20000 THEN b.n ELSE f.fill + b.n END FROM f JOIN b ON b.lang = f.lang AND b.i = f.i + 1),
x AS (SELECT t.*, shard, CASE WHEN tok = '<sep>' THEN 0 ELSE {sql_draw("tok")} % 65535 + 1 END AS id FROM t JOIN f ON f.lang = t.lang AND f.batch = t.doc_id // 50)"""


@query("token_files", f"""WITH RECURSIVE {_TOKENS}, {_SHARDS}
SELECT lang || '_train_ext_' || lpad(shard::VARCHAR, 3, '0') || '.bin' AS file, count(*) AS tokens, 2 * count(*) AS bytes, CAST(sum(id) AS BIGINT) AS id_sum, sha256(unhex(string_agg(printf('%02x%02x', id % 256, id // 256), '' ORDER BY doc_id, i))) AS sha256 FROM x GROUP BY ALL""")
def token_files(spark, sf):
    """16-bit shards of at most 20,000 tokens where a batch of 50 document numbers allows."""
    path = Scratch(spark, "tokens").path("files")
    W.token_files(_ids(spark, sf), "doc_id", "ids", 0, path, 20_000, by="lang", batch=50)
    read = TS.token_stream_files(spark, path).groupBy("file").agg(F.sum(F.size("tokens")).alias("tokens"), F.sum(F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("id_sum"))
    return read.join(TS.file_digests(spark, path, "*.bin"), "file").select("file", "tokens", "bytes", "id_sum", "sha256")


@query("token_file_windows", f"""WITH RECURSIVE {_TOKENS}, {_SHARDS}, s AS (SELECT id, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos FROM x WHERE lang = 'en'),
p AS (SELECT range AS row, least(CAST(floor({sql_uniform("'8'", "range::VARCHAR")} * ((SELECT count(*) FROM s) - {_CTX})) AS BIGINT), (SELECT count(*) FROM s) - {_CTX + 1}) AS start FROM range(500)),
e AS (SELECT row, start, unnest(range({_CTX + 1})) AS k FROM p)
SELECT row, start, string_agg(id::VARCHAR, ' ' ORDER BY k) FILTER (WHERE k < {_CTX}) AS x, string_agg(id::VARCHAR, ' ' ORDER BY k) FILTER (WHERE k > 0) AS y FROM e JOIN s ON s.pos = e.start + e.k GROUP BY ALL""")
def token_file_windows(spark, sf):
    """S6, S7, D6, J11, R3, U-1: windows of the stream that the shards of a domain make, across the ends of files."""
    path = Scratch(spark, "tokens").path("files")
    W.token_files(_ids(spark, sf).filter("lang = 'en'"), "doc_id", "ids", 0, path, 20_000, by="lang", batch=50)
    stream = TS.token_stream_files(spark, path, "en_train*.bin")
    size = F.col("n") - (_CTX + 1)
    picks = spark.range(500).withColumnRenamed("id", "row").join(F.broadcast(stream.agg(F.sum(F.size("tokens")).alias("n"))))  # one row
    picks = picks.select("row", F.least(F.floor(uniform(8, F.col("row")) * (size + 1)), size).cast("long").alias("start"))
    return B.batch(B.windows(stream, picks, _CTX + 1, size=TS.BLOCK)).select("row", "start", *[F.array_join(c, " ").alias(c) for c in "xy"])


@query("token_file_ranges", f"""WITH RECURSIVE {_TOKENS}, {_SHARDS}, s AS (SELECT id, shard, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos FROM x WHERE lang = 'en')
SELECT 'en_train_ext_' || lpad(shard::VARCHAR, 3, '0') || '.bin' AS file, min(pos) AS at, count(*) AS tokens, md5(string_agg(id::VARCHAR, ' ' ORDER BY pos)) AS md5 FROM s WHERE pos >= 15000 AND pos < 48000 GROUP BY ALL""")
def token_file_ranges(spark, sf):
    """One contiguous range of positions; only the blocks that hold it are read."""
    path = Scratch(spark, "tokens").path("files")
    W.token_files(_ids(spark, sf).filter("lang = 'en'"), "doc_id", "ids", 0, path, 20_000, by="lang", batch=50)
    part = TS.token_range(spark, path, 15_000, 48_000)
    return part.groupBy("file").agg(F.min("at").alias("at"), F.sum(F.size("tokens")).alias("tokens"), F.md5(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "tokens"))), lambda x: x["tokens"])), " ")).alias("md5"))


_LINE = "strlen(CAST(to_json({'text': text}) AS VARCHAR)) + 1"


@query("jsonl_shards", f"""WITH RECURSIVE b AS (SELECT CAST(row_number() OVER (ORDER BY batch) - 1 AS BIGINT) AS i, * FROM (SELECT doc_id // 20 AS batch, CAST(sum({_LINE}) AS BIGINT) AS n FROM documents GROUP BY ALL)),
f AS (SELECT i, batch, CAST(0 AS BIGINT) AS shard, n AS fill FROM b WHERE i = 0
  UNION ALL SELECT b.i, b.batch, CASE WHEN f.fill > 0 AND f.fill + b.n > 150000 THEN f.shard + 1 ELSE f.shard END, CASE WHEN f.fill > 0 AND f.fill + b.n > 150000 THEN b.n ELSE f.fill + b.n END FROM f JOIN b ON b.i = f.i + 1)
SELECT shard, count(*) AS documents, CAST(sum({_LINE}) AS BIGINT) AS bytes_jsonl, CAST(sum(length(text)) AS BIGINT) AS chars, md5(string_agg(md5(text), '' ORDER BY doc_id)) AS content FROM documents d JOIN f ON f.batch = d.doc_id // 20 GROUP BY shard""")
def jsonl_shards(spark, sf):
    """Shards of JSON lines rolled at 150,000 bytes, read in the manifest's order."""
    path = Scratch(spark, "jsonl").path("corpus")
    shards = W.rolled_jsonl(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", path, 150_000, batch=20)
    in_order = F.array_sort(F.collect_list(F.struct("line_no", F.md5("text").alias("h"))))
    read = R.jsonl_folder(spark, path).groupBy(F.col("shard_no").cast("long").alias("shard")).agg(F.count("*").alias("read"), F.md5(F.array_join(F.transform(in_order, lambda x: x["h"]), "")).alias("content"))
    return shards.join(read, "shard").filter("documents = read").select("shard", "documents", "bytes_jsonl", "chars", "content")


@query("extension_of_manifest", f"""WITH d AS (SELECT doc_id, length(text) AS n, row_number() OVER (ORDER BY doc_id) - 1 AS rank, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM documents WHERE {_STRIP} <> ''),
s AS (SELECT count(*) AS skip FROM d WHERE c < 100000), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d, s WHERE rank >= skip)
SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(before AS BIGINT) AS before FROM r WHERE before < CAST(floor(20000 * 4.21 * 1.05) AS BIGINT) OR rank = skip""")
def extension_of_manifest(spark, sf):
    """A base is written, and its extension goes on where the base's manifest says that it ended."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    path = Scratch(spark, "base").path("base")
    W.rolled_jsonl(R.budget_documents(d, "doc_id", 100_000), "doc_id", path, 150_000, batch=20)
    return R.extension(d, "doc_id", path, 20_000).select("doc_id", F.length("text").cast("long").alias("n"), "before")


@query("marked_documents", f"SELECT md5({_STRIP}) AS content, count(*) AS n FROM documents WHERE {_STRIP} <> '' AND NOT contains(text, '<|endoftext|>') GROUP BY ALL")
def marked_documents(spark, sf):
    """Documents written one after the other with marker lines between, and read by the marker."""
    path = Scratch(spark, "marked").path("text")
    d = table(spark, sf, "documents").filter(non_blank(F.col("text")) & ~F.contains("text", F.lit(R.MARKER))).select("text")
    d.write.option("lineSep", f"\n{R.MARKER}\n").text(path)
    return R.marked_documents(spark, path).groupBy(F.md5(strip(F.col("text"))).alias("content")).agg(F.count("*").alias("n"))


@query("log_files", f"WITH {_LOG}, w AS (SELECT run, count(*) AS steps, round(sum(loss), 6) AS loss FROM lw GROUP BY run) SELECT run, steps, loss, far AS max_step FROM w JOIN (SELECT run, max(step) AS far FROM g GROUP BY run) USING (run)")
def log_files(spark, sf):
    """A log a run, with a torn last line, read by the pattern of its name; the last record of a step wins."""
    path = Scratch(spark, "logs").path("logs")
    line = F.to_json(F.struct("step", (F.col("step") * 16384).alias("tokens"), "loss"))
    rows = log(spark, sf).select(F.concat(F.lit("seedctl_"), "run", F.lit("_train_log.jsonl")).alias("file"), line.alias("value"), "seq")
    torn = rows.select("file").distinct().select("file", F.lit('{"step": 99999, "lo').alias("value"), F.lit(1 << 60).alias("seq"))
    W.named_files(rows.unionByName(torn), path, "seq")
    read = R.training_log(spark, f"{path}/seedctl_*_train_log.jsonl")
    won = L.last_wins(read, ["run", "step"], "seq", "loss").groupBy("run").agg(F.count("*").alias("steps"), F.round(F.sum("loss"), 6).alias("loss"))
    return won.join(L.max_step(read, "step", ["run"]), "run")


@query("result_files", f"""WITH {_POINTS}, j AS (SELECT run || '.json' AS file, tokens, score AS max_score, UNNEST(['web', 'wiki']) AS domain, UNNEST([CASE WHEN n % 5 <> 0 THEN loss END, round(loss * 2, 6)]) AS loss FROM c JOIN p USING (run, day, score) WHERE n % 11 <> 0) SELECT file, CAST(tokens AS BIGINT) AS tokens, max_score, domain, loss FROM j""")
def result_files(spark, sf):
    """A result a run as one JSON object, non-finite losses as null; points without tokens are dropped."""
    path = Scratch(spark, "results").path("results")
    p = points(spark, sf)
    losses = F.create_map(F.lit("web"), W.finite(F.when(F.col("n") % 5 != 0, F.col("loss")).otherwise(float("nan"))), F.lit("wiki"), F.round(F.col("loss") * 2, 6))
    one = F.struct(F.when(F.col("n") % 11 != 0, F.col("tokens")).alias("tokens"), F.col("score").alias("max_score"), losses.alias("losses"))
    n = table(spark, sf, "events").groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").cast("long").alias("day")).agg(F.count("*").alias("n"))
    rows = p.join(n, ["run", "day"]).groupBy("run").agg(F.collect_list(one).alias("points"))  # a point per day
    W.named_files(rows.select(F.concat("run", F.lit(".json")).alias("file"), F.to_json(F.struct("points"), {"ignoreNullFields": "false"}).alias("value"), "run"), path, "run")
    return R.result_points(spark, f"{path}/*.json")


@query("checkpoint_files", f"""WITH {_TOKENS}, b AS (SELECT doc_id // 100 AS batch, count(*) AS n FROM t GROUP BY ALL), c AS (SELECT n, sum(n) OVER (ORDER BY batch) AS tokens FROM b)
SELECT CAST(tokens AS BIGINT) AS tokens, CAST(2 * n AS BIGINT) AS length, n AS held, tokens = (SELECT max(tokens) FROM c) AS final FROM c""")
def checkpoint_files(spark, sf):
    """Files named by the tokens so far, found by name, sized by their bytes, the last one chosen."""
    path = Scratch(spark, "checkpoints").path("run")
    d = _ids(spark, sf).select("doc_id", F.concat("ids", F.array(F.lit(0))).alias("tokens"), F.floor(F.col("doc_id") / 100).alias("batch"))
    d = running(d, "doc_id", F.size("tokens"), "at")
    ends = d.groupBy("batch").agg(F.min("at").alias("first"), F.max(F.col("at") + F.size("tokens")).alias("end"))
    TS.write_token_files(d.join(ends, "batch").select(F.format_string("tokens_%012d.pt", "end").alias("file"), (F.col("at") - F.col("first")).alias("start"), "tokens"), path)
    found = R.checkpoints(spark, path)
    sizes = R.file_tokens(spark, path).select("path", F.col("tokens").alias("held"))
    last = chosen(found).select("path", F.lit(True).alias("final"))
    return found.join(sizes, "path").join(last, "path", "left").select("tokens", "length", "held", F.coalesce("final", F.lit(False)).alias("final"))


_KEYS = """CASE event_id % 8 WHEN 0 THEN '{"tokens": true, "n_tokens": ' || user_id || '.0}' WHEN 1 THEN '{"tokens": "' || user_id || '", "total_tokens": ' || event_id || '}' WHEN 2 THEN '{"tokens": ' || user_id || '.5, "tokens_seen": ' || event_id || '}'
WHEN 3 THEN '{"token_count": null, "tokens_seen": ' || user_id || '}' WHEN 4 THEN '{"loss": 1}' WHEN 5 THEN '{"tokens": ' || user_id WHEN 6 THEN '{"tokens": ' || user_id || 'e3}' ELSE '{"tokens": [1], "n_tokens": -' || user_id || '}' END"""
_TYPED = ", ".join(f"CASE WHEN json_type(j, '$.{k}') IN ('BIGINT', 'UBIGINT') THEN (j->>'$.{k}')::BIGINT WHEN json_type(j, '$.{k}') = 'DOUBLE' AND (j->>'$.{k}')::DOUBLE = floor((j->>'$.{k}')::DOUBLE) THEN (j->>'$.{k}')::DOUBLE::BIGINT END" for k in R.TOKEN_KEYS)


@query("key_precedence", f"WITH e AS (SELECT event_id, {_KEYS} AS t FROM events), o AS (SELECT event_id, CASE WHEN json_valid(t) THEN t END AS j FROM e) SELECT event_id, coalesce({_TYPED}) AS tokens FROM o")
def key_precedence(spark, sf):
    """The first key with a whole number, by the types that JSON gives."""
    return table(spark, sf, "events").select("event_id", F.expr(_KEYS).alias("j")).select("event_id", R.first_of(F.col("j")).alias("tokens"))


_UNITS = "u AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS unit, m, n FROM (SELECT user_id, round(avg(value), 6) AS m, count(*) AS n FROM events GROUP BY user_id))"


@query("bootstrap_statistics", f"""WITH {_UNITS}, k AS (SELECT count(*) AS k FROM u), d AS (SELECT r, {sql_draw("'21'", "r::VARCHAR", "unit::VARCHAR")} % k AS unit FROM u, k, (SELECT range AS r FROM range(200))),
b AS (SELECT r, median(m) AS s1, sum(m * n) / sum(n) AS s2, avg(m) FILTER (WHERE m <= q) AS s3 FROM (SELECT r, m, n, quantile_cont(m, 0.75) OVER (PARTITION BY r) AS q FROM d JOIN u USING (unit)) GROUP BY r),
o AS (SELECT median(m) AS s1, sum(m * n) / sum(n) AS s2, avg(m) FILTER (WHERE m <= q) AS s3 FROM (SELECT m, n, quantile_cont(m, 0.75) OVER () AS q FROM u)),
l AS (SELECT 'median' AS statistic, s1 AS s FROM b UNION ALL SELECT 'ratio', s2 FROM b UNION ALL SELECT 'trimmed', s3 FROM b), f AS (SELECT 'median' AS statistic, s1 AS point FROM o UNION ALL SELECT 'ratio', s2 FROM o UNION ALL SELECT 'trimmed', s3 FROM o)
SELECT statistic, (SELECT k FROM k) AS units, round(any_value(point), 6) AS point, round(quantile_cont(s, 0.025), 6) AS ci_low, round(quantile_cont(s, 0.975), 6) AS ci_high FROM l JOIN f USING (statistic) GROUP BY statistic""")
def bootstrap_statistics(spark, sf):
    """Intervals of a median and a ratio as columns, and of a mean under a quantile as any function of the drawn rows."""
    u = table(spark, sf, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("m"), F.count("*").alias("n"))
    u = Scratch(spark, "units").cut(running(u, "user_id", F.lit(1), "unit").select("unit", "m", "n"), "units")

    def low_mean(x):
        import numpy as np

        return x[x <= np.quantile(x, 0.75)].mean()

    statistics = {"median": lambda k: F.percentile("m", F.lit(0.5), k), "ratio": lambda k: F.sum(F.col("m") * F.col("n") * k) / F.sum(F.col("n") * k), "trimmed": S.of_values(low_mean, "m")}
    out = None
    for name, s in statistics.items():
        one = S.bootstrap(u, s, 200, 21).select(F.lit(name).alias("statistic"), "units", *[F.round(c, 6).alias(c) for c in ("point", "ci_low", "ci_high")])
        out = one if out is None else out.unionByName(one)
    return out


@query("replaced_table", """WITH a AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY ALL), b AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY ALL)
SELECT 'old' AS seen, count(*) AS rows, CAST(sum(n) AS BIGINT) AS total FROM a UNION ALL SELECT 'new', count(*), CAST(sum(n) AS BIGINT) FROM b UNION ALL SELECT 'held', count(*), CAST(sum(n) AS BIGINT) FROM a""")
def replaced_table(spark, sf):
    """A table is replaced as a whole; who opened it before goes on reading the old version."""
    root = Scratch(spark, "versions").path("counts")
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    first = V.publish(a, root)
    held = V.table(spark, root)
    V.publish(b, root, expected=first["version"])
    out = None
    for name, df in (("old", V.table(spark, root, first["version"])), ("new", V.table(spark, root)), ("held", held)):
        one = df.agg(F.count("*").alias("rows"), F.sum("n").alias("total")).select(F.lit(name).alias("seen"), "rows", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query("sidecar_readings", "SELECT CASE WHEN event_id % 5 = 0 THEN 'random_init' ELSE 'tokens_' || lpad((event_id % 5 * 1000000)::VARCHAR, 12, '0') END AS ckpt, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def sidecar_readings(spark, sf):
    """Readings written by checkpoint and read back by its name."""
    path = Scratch(spark, "sidecar").path("readings")
    i = F.col("event_id") % 5
    W.sidecar(table(spark, sf, "events").select(F.when(i != 0, i * 1_000_000).alias("tokens"), "value"), path)
    return spark.read.schema("tokens long, value double, ckpt string").parquet(path).groupBy("ckpt").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("stability_verdicts", f"""WITH {_LOG}, x AS (SELECT run, step, CASE WHEN run = 'view' AND seq % 997 = 5 THEN 'inf'::DOUBLE ELSE loss END AS loss FROM g WHERE loss IS NOT NULL),
w AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step, loss) AS a, row_number() OVER (PARTITION BY run ORDER BY step DESC, loss DESC) AS z FROM x WHERE step < 100),
m AS (SELECT run, count(*) AS n, avg(loss) FILTER (WHERE a <= 8 AND isfinite(loss)) AS head, avg(loss) FILTER (WHERE z <= 8 AND isfinite(loss)) AS tail, bool_or(NOT isfinite(loss)) AS bad FROM w GROUP BY run),
v AS (SELECT run, far, n, head, tail, coalesce(bad, false) AS bad FROM (SELECT run, max(step) AS far FROM x GROUP BY run) LEFT JOIN m USING (run))
SELECT run, CASE WHEN bad OR tail > head THEN 'diverged' ELSE 'passed' END AS verdict, CASE WHEN NOT bad THEN round(head, 9) END AS head, CASE WHEN NOT bad THEN round(tail, 9) END AS tail FROM v WHERE bad OR (far >= 100 AND coalesce(n, 0) >= 8)""")
def stability_verdicts(spark, sf):
    """The logs as a stream of files, state by run, each verdict once."""
    scratch = Scratch(spark, "monitor")
    odd = (F.col("run") == "view") & (F.col("seq") % 997 == 5)
    rows = log(spark, sf).filter("loss is not null").select("run", "step", F.lit(0).cast("long").alias("tokens"), F.when(odd, float("inf")).otherwise(F.col("loss")).alias("loss"))
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(scratch.path("logs"))
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), spark.sparkContext.defaultParallelism)))  # a store for each partition of a few runs
    try:
        M.stability_monitor(M.log_stream(spark, scratch.path("logs")), 100, scratch.path("verdicts"), scratch.path("state")).awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema("run string, verdict string, head double, tail double, far long").parquet(scratch.path("verdicts")).select("run", "verdict", F.round("head", 9).alias("head"), F.round("tail", 9).alias("tail"))


@query("probe_curve_lines", f"WITH {_LOG} SELECT run, count(*) AS n, max(step) AS last, round(sum(loss), 6) AS loss FROM g WHERE loss IS NOT NULL GROUP BY run")
def probe_curve_lines(spark, sf):
    """A stream of readings appended as JSON lines and read again."""
    scratch = Scratch(spark, "probe")
    rows = log(spark, sf).select("run", "step", F.lit(0).cast("long").alias("tokens"), "loss")
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(scratch.path("in"))
    M.probe_curve(M.log_stream(spark, scratch.path("in")), scratch.path("out"), scratch.path("state")).awaitTermination()
    back = spark.read.schema(M.KIND).json(scratch.path("out"))
    return back.groupBy("run").agg(F.count("*").alias("n"), F.max("step").alias("last"), F.round(F.sum("loss"), 6).alias("loss"))


@query("round_trip", "SELECT count(*) AS docs, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, 0::BIGINT AS failed FROM documents")
def round_trip(spark, sf):
    """Every text is encoded with a public vocabulary and decoded; none may differ."""
    import public_tokenizers

    d = spread(table(spark, sf, "documents").select("text"))
    return W.round_trip(d, str(public_tokenizers.path("byte_bpe_50k.json"))).select("docs", "chars", "failed")


@query("leak_report_lines", f"""WITH r AS ({TEXT_SQL["leakage_gate"]})
SELECT row_number() OVER (ORDER BY part, key) AS ordinal, line FROM (SELECT 0 AS part, '0' AS key, '13-gram leakage check for domain ''documents''' AS line UNION ALL SELECT 0, '1', '  train shards: 1'
  UNION ALL SELECT 1, split, '  ' || split || ': ' || leaks || '/' || samples || ' sampled n-grams found in train -> ' || CASE WHEN leaks = 0 THEN 'clean' ELSE 'LEAK (' || leaks || ' of ' || samples || ')' END || '; positive control ' || CASE WHEN control THEN 'PASS' ELSE 'FAIL (search found nothing)' END FROM r
  UNION ALL SELECT 2, '', '  verdict: ' || CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'FAIL' END FROM r)""")
def leak_report_lines(spark, sf):
    """The leak report as lines with PASS or FAIL."""
    return W.leak_lines(Scratch(spark, "leaks").cut(leakage_gate(spark, sf), "report"), 13, "documents", 1).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("fallback_rows", "SELECT 'customer' AS source, count(*) AS n FROM customer")
def fallback_rows(spark, sf):
    """A source that cannot be read gives way to another, and the rows say so."""
    rows = R.with_fallback(lambda: table(spark, sf, "no_such_table"), lambda: table(spark, sf, "customer"), "customer")
    return rows.groupBy("source").agg(F.count("*").alias("n"))
