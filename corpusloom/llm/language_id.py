"""Language identification by Bayesian evidence fusion.

log P(lang | row) = log P(lang | host) + weight * log P(text | lang) + log P(declared | lang)

* P(text | lang): hashed byte n-grams (3 and 4 bytes, lower case) with half a count added to each, over the whole text; the
  weight tempers it, as overlapping n-grams are far from independent.
* P(declared | lang): a table of what the text alone says against what the markup declares, by grouped aggregation over all
  rows, with one added to each count.
* P(lang | host): counts per host, smoothed towards its registered domain, that towards its suffix, that towards all; so the
  suffix of an address is evidence through the prior, and a host of many pages outweighs it.

The n-gram model is fitted on a bounded sample of labelled rows (``SAMPLE``, chosen by a hash of the text); everything
else counts every row. Grouped counts are made of partial counts, so a hot host costs its task no more rows than a small
one; priors are joined back by shuffle unless their checked number is small.

A row is kept if its text has at least ``MIN_LETTERS`` letters, fits the best language nearly as well as that language's
own training text (else it is "und"), and the fused posterior reaches ``MIN_POSTERIOR``.

Defined results: a null or empty text has no evidence, gets "und" and is rejected; a null declaration says
nothing; null hosts, domains and suffixes are one value '' each, with a prior of its own like any other; repeated rows each get a row; a table without labelled rows leaves
all "und"; columns other than those named are ignored. Ties go to the language that is first in the alphabet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, mix, read, small_batches

SAMPLE = 4_000
BUCKETS = 1 << 16
WEIGHT = 0.1
MIN_LETTERS = 10
MIN_POSTERIOR = 0.5
STRENGTH = 20.0
#: Nats per n-gram by which a text may fit worse than training text before it counts as no known language.
SLACK = 2.5


def buckets(text: str) -> np.ndarray:
    """Bucket of each n-gram of 3 and 4 bytes, digits and punctuation as a space."""
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8)
    b = np.where((b >= 97) & (b <= 122) | (b >= 128), b, 32).astype(np.uint64)
    three = b[:-2] | b[1:-1] << np.uint64(8) | b[2:] << np.uint64(16)
    four = three[:-1] | b[3:] << np.uint64(24)
    return (mix(np.concatenate([three, four | np.uint64(1 << 40)])) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per label: bucket counts and how many n-grams, of this task's sampled rows."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
            total[label] = total.get(label, 0) + np.bincount(buckets(text), minlength=BUCKETS)
    rows = sorted(total)
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array([total[r].astype("<i8").tobytes() for r in rows], pa.binary())], ["label", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the count vectors of each label in this task."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for label, counts in zip(batch.column("label").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            total[label] = total.get(label, 0) + np.frombuffer(counts, "<i8")
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.astype("<i8").tobytes() for v in total.values()], pa.binary())], ["label", "counts"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log P(bucket | language), and the mean log-likelihood of each language's own n-grams.

    ``labelled``: text, label. The sample is the ``sample`` different texts of least hash: first the bound is found among
    the hashes alone, then the texts within it are counted where they lie. The driver gets one vector per language.
    """
    rows = labelled.filter(F.col("label").isNotNull() & (F.col("label") != "") & F.col("text").isNotNull()).withColumn("h", F.xxhash64("text"))
    edge = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if edge is None:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0)
    kind = "label string, counts binary"
    picked = rows.filter(F.col("h") <= edge).groupBy("h", "label").agg(F.min("text").alias("text"))
    total = {r["label"]: np.frombuffer(r["counts"], "<i8") for r in picked.mapInArrow(_counted, kind).repartition(8, "label").mapInArrow(_added, kind).collect()}
    langs = sorted(total)
    counts = np.stack([total[x] for x in langs], 1).astype(np.float64)
    logs = np.log((counts + 0.5) / (counts + 0.5).sum(0))
    own = (counts * logs).sum(0) / np.maximum(counts.sum(0), 1)
    return langs, logs.astype(np.float32), own


def scorer(langs: list[str], logs: np.ndarray, own: np.ndarray):
    """mapInArrow function: log-likelihoods of the whole text, letters, and whether the text fits its best language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, best, n_letters = [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                k = buckets(text)
                n_letters.append(sum(map(str.isalpha, text[:200])) if len(text) <= 200 else MIN_LETTERS if sum(map(str.isalpha, text)) >= MIN_LETTERS else 0)
                s = logs[k].sum(0, dtype=np.float64) if len(k) and langs else np.zeros(len(langs))
                score.append((s - s.max() if len(s) else s).tolist())
                fits = bool(len(s)) and len(k) > 0 and s.max() / len(k) >= own[int(s.argmax())] - SLACK
                best.append(langs[int(s.argmax())] if fits and n_letters[-1] >= MIN_LETTERS else "und")
            keep = [batch.column(c) for c in ("kind", "id", "declared", "host", "domain", "suffix")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(score, pa.list_(pa.float64())), pa.array(best, pa.string())], ["kind", "id", "declared", "host", "domain", "suffix", "score", "text_lang"])

    return run


def _table(rows: DataFrame, by: str, langs: list[str]) -> DataFrame:
    """(by, counts array<double> in the order of langs) of rows whose text alone names a language."""
    known = rows.filter(F.col("text_lang") != "und")
    return known.groupBy(by).agg(F.array(*[F.sum(F.when(F.col("text_lang") == x, 1.0).otherwise(0.0)) for x in langs]).alias(f"{by}_n"))


def _smooth(counts: Column, parent: Column, strength: float) -> Column:
    """(n + strength * parent) / (sum n + strength), or the parent where there are no counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(counts.isNull(), parent).otherwise(F.zip_with(counts, parent, lambda n, p: (n + strength * p) / (total + strength)))


def identify(rows: DataFrame, labelled: DataFrame, scratch: Scratch, sample: int = SAMPLE, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """``rows``: kind, id, text, declared, host, domain, suffix. Adds text_lang, lang, posterior, kept.

    One row per input row, keyed by (kind, id).
    """
    spark = rows.sparkSession
    small_batches(spark)
    langs, logs, own = fit(labelled, sample)
    tidy = F.lower(F.trim(F.regexp_extract(F.coalesce("declared", F.lit("")), r"^\s*([A-Za-z]+)", 1)))
    rows = rows.withColumn("declared", F.when(tidy.isin(langs) if langs else F.lit(False), tidy).otherwise(""))
    for c in ("host", "domain", "suffix"):
        rows = rows.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("")))
    out = "kind string, id long, declared string, host string, domain string, suffix string, score array<double>, text_lang string"
    told = scratch.cut(rows.select("kind", F.col("id").cast("long"), "text", "declared", "host", "domain", "suffix").mapInArrow(scorer(langs, logs, own), out), "scored")
    if not langs:
        return told.select("kind", "id", "text_lang", F.col("text_lang").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(False).alias("kept"))
    # evidence whose tables are bounded by the languages: what is declared, against what the text says
    known = told.filter(F.col("text_lang") != "und")
    pairs = {(r["text_lang"], r["declared"]): r["count"] for r in known.groupBy("text_lang", "declared").count().collect()}
    per = {x: sum(n for (a, _), n in pairs.items() if a == x) for x in langs}
    everything = max(sum(per.values()), 1)
    overall = F.array(*[F.lit((per[x] + 1.0) / (everything + len(langs))) for x in langs])
    said = F.lit(None)
    for d in langs:
        said = F.when(F.col("declared") == d, F.array(*[F.lit(float(np.log((pairs.get((x, d), 0) + 1.0) / (per[x] + len(langs) + 1)))) for x in langs])).otherwise(said)
    said = F.coalesce(said, F.array(*[F.lit(0.0)] * len(langs)))
    # host priors, smoothed towards domain, suffix, all; the suffix is evidence through this chain as well
    tables = {by: scratch.cut(_table(told, by, langs), by) for by in ("suffix", "domain", "host")}
    chain = overall
    for by, t in tables.items():
        told = told.join(bounded(t), by, "left")
        chain = _smooth(F.col(f"{by}_n"), chain, STRENGTH)
    logp = F.zip_with(F.zip_with("score", "prior", lambda s, p: WEIGHT * s + F.log(p)), "said", lambda a, b: a + b)
    told = told.withColumn("prior", chain).withColumn("said", said).withColumn("logp", logp)
    top = F.array_max("logp")
    best = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("logp", top).cast("int"))
    weight = F.aggregate("logp", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    und = F.col("text_lang") == "und"
    return told.select(
        "kind", "id", "text_lang", F.when(und, "und").otherwise(best).alias("lang"), F.when(und, 0.0).otherwise(1.0 / weight).alias("posterior")
    ).withColumn("kept", ~und & (F.col("posterior") >= min_posterior))


def host_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, registered domain (its last two labels) and suffix (its last label) of an address."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return host, F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents: the lang column is what is declared, the source is the host; they have no address."""
    return docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit("").alias("domain"), F.lit("").alias("suffix"))


_TAG = re.compile("<(script|style|nav|footer)\\b", re.IGNORECASE)
_CLOSING = {name: re.compile(f"</{name}>", re.IGNORECASE) for name in ("script", "style", "nav", "footer")}
_REFERENCE = re.compile(r"&#?\w+;")


def bare(html: str) -> str:
    """The text of a page without tags, character references and what stands in scripts, styles, menus and footers.

    One pass: a closing tag that was not found is not looked for again, and a last tag without an end is text, so the time is
    linear however broken the markup is. An element that is never closed loses its tag only.
    """
    out, at, open_ended = [], 0, set()
    while (start := html.find("<", at)) >= 0:
        tag = _TAG.match(html, start)
        name = tag and tag[1].lower()
        close = _CLOSING[name].search(html, tag.end()) if name and name not in open_ended else None
        if name and close is None:
            open_ended.add(name)
        end = close.end() if close else html.find(">", start) + 1
        if not end:
            break
        out.append(html[at:start])
        at = end
    out.append(html[at:])
    return _REFERENCE.sub(" ", " ".join(out))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages: the html tag declares; host, domain and suffix come from the address; tags are cut from the text."""

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return html.map(bare, na_action="ignore")

    host, domain, suffix = host_parts(F.col("url"))
    declared = F.regexp_extract("html", r'(?i)<html\b[^<>]{0,4096}?\blang=["\']?([A-Za-z-]+)', 1)
    return pages.select(F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("id"), text(F.col("html")).alias("text"), declared.alias("declared"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"))


def labels_of(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.lower(F.trim("lang")).alias("label"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages")
    found = identify(document_rows(docs).unionByName(page_rows(pages)), labels_of(docs), Scratch(spark, "language"))
    key = lambda kind: F.when(F.col("kind") == kind, F.col("id"))
    return found.select(key("document").alias("doc_id"), key("page").alias("page_id"), "text_lang", "lang", F.round("posterior", 6).alias("posterior"), "kept")
