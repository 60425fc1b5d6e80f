"""Source divergence, sharding and the filter audit against plain Python, on edge cases and crowded keys."""

import collections
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import filter_audit, jump_shards, source_divergence
from corpusloom.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, part string, shard int, mask string, _key long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def rows():
    g = np.random.default_rng(3)
    words = ["Ärger", "the", "The", "a", "naïve", "x1y", "Σ", "straße", "日本語", "b_c", "end.", "$5", "UPPER", "\U0001f600"]
    out = [(None, "null id", "en", "s0"), (None, "null id", "en", "s0"), (1, None, None, None), (2, "", "", ""), (3, " \n\t ", "fr", "s1"), (4, LONG, "en", "s2"), (5, LONG, "de", "s2"), (6, "a\x00b \x7f", "xx", "s9")]
    for i in range(10, 400):
        text = " ".join(g.choice(words, int(g.integers(0, 40)), p=g.dirichlet(np.ones(len(words)))))
        out.append((i // 2 if i % 7 == 0 else i, text, ["en", "de", None, "fr"][i % 4] if i % 3 else "en", f"s{i % 5}" if i % 4 else "s0"))
    out += [(1000 + i, "one text of many copies " * 60, "en", "s0") for i in range(200)] + [(77, "A hot id", "en", "s0")] * 150
    return [(d, t, lang, s, 1, "x", "y", 1, "z", 2) for d, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(7)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def divergence(found, least, top):
    """The contract, word by word."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, n, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for _, t, lang, source, *_ in found:
        lang, source, terms = lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
        groups[lang].add(source)
        df.update((lang, x) for x in set(terms))
        n.update((lang, source, x) for x in terms)
    out = set()
    for lang, sources in groups.items():
        kept = [x for (own, x), k in df.items() if own == lang and k >= least]
        share = lambda c: {x: 1 + 10**9 * (c[x] + 5) // (sum(c.values()) + 5 * len(kept)) for x in kept}  # noqa: B023, E731
        count = {s: {x: n[lang, s, x] for x in kept} for s in sources}
        q, p = share({x: sum(count[s][x] for s in sources) for x in kept}), {s: share(count[s]) for s in sources}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][x] - p[o][x]) for x in kept), o.encode()) for o in sources - {s})
            terms = sorted((q[x] - p[s][x], x.encode()) for x in kept if count[s][x] and p[s][x] > q[x])[:top]
            out |= {(lang, s, part, item.decode(), -v, r) for part, l in (("pair", pairs), ("term", terms)) for r, (v, item) in enumerate(l, 1)}
    return out


@pytest.mark.parametrize("least,top", [(30, 50), (1, 3), (10_000, 50)])
def test_divergence_equals_brute_force(docs, least, top):
    got = [tuple(r) for r in source_divergence.divergence(docs, least=least, top=top).collect()]
    assert len(got) == len(set(got)) and set(got) == divergence(rows(), least, top)


def test_divergence_without_broadcasts(docs, monkeypatch):
    monkeypatch.setattr(source_divergence, "fits", lambda df: False)
    out = source_divergence.divergence(docs)
    assert {tuple(r) for r in out.collect()} == divergence(rows(), 30, 50)


def test_shares_do_not_overflow(spark):
    one = spark.createDataFrame([(10**15, 3 * 10**15, 7)], "n long, total long, v long")
    assert one.select(source_divergence.share("n", "total", "v")).first()[0] == 1 + 10**9 * (10**15 + 5) // (3 * 10**15 + 35)


def test_divergence_of_nothing(none):
    assert source_divergence.divergence(none).columns == ["lang", "source", "part", "item", "value", "rank"] and source_divergence.divergence(none).count() == 0


def jumps(key, shards):
    """The published loop, one key at a time."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jumps_equal_the_published_loop():
    keys = np.concatenate([np.random.default_rng(0).integers(0, 2**64, 3000, np.uint64), np.array([0, 1, 2**63, 2**64 - 1], np.uint64)])
    for shards in (1, 2, 24, 25, 1000):
        assert jump_shards.jump(keys, shards).tolist() == [jumps(int(k), shards) for k in keys]


def test_a_new_shard_takes_its_part_only():
    keys = np.random.default_rng(1).integers(0, 2**64, 50_000, np.uint64)
    for shards in (1, 7, 24):
        old, new = jump_shards.jump(keys, shards), jump_shards.jump(keys, shards + 1)
        moved = old != new
        assert (new[moved] == shards).all() and abs(moved.mean() - 1 / (shards + 1)) < 0.01
        assert np.bincount(old, minlength=shards).min() > 0.9 * len(keys) / shards


def test_shards_of_any_rows(docs, monkeypatch):
    monkeypatch.setattr(jump_shards, "RANGE_ROWS", 60)  # many ranges, one of them full of one id
    got = [r.asDict() for r in jump_shards.sharded(docs).collect()]
    want = collections.Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    at = collections.defaultdict(set)
    for r in got:
        at[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["law"] == "key" and 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
    assert all(len(x) == 1 for x in at.values())
    last = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"])
    for shard in {r["shard"] for r in got}:
        own = sorted((r for r in got if r["shard"] == shard), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own))) and own == sorted(own, key=last)


def test_ranges_split_a_crowded_id(spark, docs, monkeypatch):
    monkeypatch.setattr(jump_shards, "RANGE_ROWS", 60)
    seen = []
    cut = Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df, name, by=None: seen.append((name, out := cut(self, df, name, by))) or out)
    jump_shards.sharded(docs).count()
    ranged = dict(seen)["ranged"]
    assert max(r["count"] for r in ranged.groupBy("_part").count().collect()) < 160 and ranged.filter("doc_id = 77").select("_part").distinct().count() > 1


def test_shards_follow_the_sql(docs):
    con = duckdb.connect()
    documents = docs.select("doc_id", "text").toPandas().convert_dtypes()  # noqa: F841
    assert sorted(map(str, con.execute(jump_shards.sql()).fetchall())) == sorted(str(tuple(r)) for r in jump_shards.sharded(docs).collect())


def test_shards_of_nothing(none):
    assert jump_shards.sharded(none).count() == 0
    with pytest.raises(ValueError):
        jump_shards.shard_of(F.col("x"), 0)


def replayed(found, labels):
    """Every order, step by step."""
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, x in labels if x == 1} - {None}
    first, docs, out, shapley = {}, [], {}, collections.Counter()
    for d, t, *_ in found:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    for d, t, lang, *_ in found:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        docs.append((lang or "", {x for x, y in fails.items() if y}, d in good, d in toxic))
    for part, order in itertools.product({x[0] for x in docs}, itertools.permutations("ABCDE")):
        left = [x for x in docs if x[0] == part]
        for step, letter in enumerate(order, 1):
            gone = [x for x in left if letter in x[1]]
            redundant = sum(x[0] == part and letter in x[1] for x in docs) - len(gone)
            left = [x for x in left if letter not in x[1]]
            unique = sum(x[0] == part and x[1] == {letter} for x in docs)
            out[part, "".join(order), step] = (len(left), len(gone), redundant, unique, sum(x[2] for x in gone), sum(x[3] for x in gone))
            shapley[part, letter] += len(gone)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LABELS = [(1, 1, 0), (4, 1, 1), (4, 0, 0), (5, None, 1), (None, 1, 1), (77, 1, 0), (1003, 0, 1), (1004, 1, None), (9999, 1, 1), *((i, i % 2, i % 3 == 0) for i in range(10, 300, 2))]


def test_audit_equals_brute_force(spark, docs):
    labels = [(d, q, None if x is None else int(x)) for d, q, x in LABELS]
    table = spark.createDataFrame([(*x, "extra") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = [tuple(r) for r in filter_audit.audit(docs, table).collect()]
    want = replayed(rows(), labels)
    assert len(got) == len(want) and set(got) == want
    assert {tuple(r) for r in filter_audit.audit(docs, table.limit(0)).collect()} == replayed(rows(), [])


def test_copies_are_joined_on_ids_too(docs):
    plan = filter_audit.copies(filter_audit.text_flags(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftOuter, \(\(doc_id#\d+L <=?>? doc_id#\d+L\) AND \(digest#\d+ = digest#\d+\)\)|Join LeftOuter, \(\(doc_id#\d+L = doc_id#\d+L\) AND", plan)


def test_replay_combines_before_it_shuffles(spark, docs):
    flags = filter_audit.labelled(filter_audit.copies(filter_audit.text_flags(docs)), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    plan = filter_audit.replay(flags)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "BroadcastNestedLoopJoin" in plan and "Python" not in plan.split("BroadcastNestedLoopJoin")[0]


def test_audit_of_nothing(spark, none):
    out = filter_audit.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert out.count() == 0 and out.columns[:3] == ["part", "filter_order", "step"]
