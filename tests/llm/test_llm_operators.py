"""The training-data operators: edge cases, brute force, round trips and held-out accuracy."""

import collections
import glob
import hashlib
import html
import html.parser
import itertools
import os
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bm25_pack, chat_trees, common, decontaminate, html_wrapper, language_id, license_scan, line_quality, line_runs, minhash_icws, suffix_family
from corpusloom.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid long, host string, key string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
EDGE = [
    (1, None, None, None, None, 1, "h", "k"), (2, "", "en", "s", 0, 1, "h", "k"), (3, "one", "en", "s", 3, 1, "h", "k"), (3, "one", "en", "s", 3, 1, "h", "k"),
    (4, LONG, "en", "s", len(LONG), 2, "h", "k"), (5, LONG, "en", "s", len(LONG), 2, "h", "k"), (None, "two words", "de", None, 9, 3, "h", "k"), (6, " \n\t\n ", "fr", "s", 5, 3, "h", "k"), (7, "a\x00b ✓ \U0001f600\nx", "xx", "s", 9, 3, "h", "k"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def scratch(spark):
    return Scratch(spark, "test")


def test_partitions_follow_bytes(spark, tmp_path, monkeypatch):
    spark.range(200_000).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("x")).repartition(40).write.parquet(f"{tmp_path}/t")
    df, read = spark.read.parquet(f"{tmp_path}/t").repartition(64), common.plan_bytes
    own = read(df)
    assert 1_000_000 < own < 20_000_000 and read(df.join(df.withColumnRenamed("x", "y"), "id")) < 3 * own
    tasks = []
    for task in (own, own // 20, own // 50, own // 1000):
        monkeypatch.setattr(common, "TASK_BYTES", task)
        tasks.append(common.sized(df).rdd.getNumPartitions())
    assert tasks == [8, 21, 51, 64]  # two a core, by bytes, and never more than the plan has


def test_wide_sides_are_shuffled(spark):
    narrow, wide = spark.range(1000).withColumn("x", F.lit(1)), spark.range(1000).withColumn("x", F.array_repeat(F.repeat(F.lit("w"), 1000), 100))
    assert common.fits(narrow) and not common.fits(wide) and not common.fits(wide.select("id", F.struct("x").alias("s")))
    assert "broadcast" in common.bounded(narrow)._jdf.queryExecution().logical().toString().lower()
    docs = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(30)))], "doc_id long, text string")
    whole = decontaminate.overlaps(docs, docs.withColumnRenamed("doc_id", "item_id"), scratch(spark)).collect()
    limit, common.bounded.__defaults__ = common.bounded.__defaults__, (0,)
    try:
        shuffled = decontaminate.overlaps(docs, docs.withColumnRenamed("doc_id", "item_id"), scratch(spark))
        assert shuffled.collect() == whole and len(whole) == 1
    finally:
        common.bounded.__defaults__ = limit


# ---- chat formatting


def nodes(spark, rows):
    return spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")


def test_trees_rank_branches(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 3, "user", None, None), (2, 9, 77, None, "x", None)]
    got = chat_trees.read_back(chat_trees.format_trees(spark, nodes(spark, rows), None)).orderBy("tree", "rank").collect()
    assert [(r["tree"], r["leaf"], r["rank"], [t["text"] for t in r["turns"]], r["loss"]) for r in got] == [(1, 4, 1, ["q", "b", ""], "b"), (1, 2, 2, ["q", "a"], "a"), (2, 9, 1, ["x"], "")]
    assert chat_trees.format_trees(spark, nodes(spark, rows), 1).count() == 2
    assert chat_trees.format_trees(spark, nodes(spark, [])).count() == 0


def test_trees_survive_deep_chains_and_cycles(spark):
    chain = [(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(70)]
    cycle = [(2, 1, 2, "user", "a", 0.0), (2, 2, 1, "user", "b", 0.0)]
    got = chat_trees.read_back(chat_trees.format_trees(spark, nodes(spark, chain + cycle))).collect()
    assert [(r["tree"], [t["text"] for t in r["turns"]]) for r in got] == [(1, [str(i) for i in range(70)])]


@pytest.mark.parametrize("text", ["", "\\", "<|end|>\n", "<|user|>\n", "<\\|end|>", "\\\\<|", "a<", "|>", "\\### Assistant: </turn> ok", "<|assistant|>\nno<|end|>\n"])
def test_template_is_reversible(spark, text):
    rows = [(1, 1, None, "user", text, 0.0), (1, 2, 1, "assistant", text, 0.0), (1, 3, 2, "we|>ird\\", text, 0.0)]
    r = chat_trees.read_back(chat_trees.format_trees(spark, nodes(spark, rows))).first()
    assert [(t["role"], t["text"]) for t in r["turns"]] == [("user", text), ("assistant", text), ("we|>ird\\", text)] and r["loss"] == text


def test_conversations_of_any_shape(spark, tmp_path):
    rows = [(1, 2, "user", "b"), (1, None, "user", "last"), (1, 1, "system", "a"), (None, 1, "assistant", "lone"), (None, 0, "user", None), (2, 1, None, "x"), (2, 1, "assistant", "tie z"), (2, 1, "assistant", "tie a"), (2, 1, "assistant", "tie a")]
    rows += [(3, i, "assistant" if i % 2 else "user", f"turn {i} \\ <|") for i in range(100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("tree", F.lit("clash")).withColumn("node", F.lit(1))
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat_trees.op4_chat_reply_trees(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(chat_trees.OP4_SQL)
    cols = [c[0] for c in want.description]
    assert sorted(map(str, map(tuple, got.select(cols).collect()))) == sorted(map(str, want.fetchall())) and got.count() == 5
    df.limit(0).write.parquet(f"{tmp_path}/empty/conversations.parquet")
    assert [r["conv_id"] for r in chat_trees.op4_chat_reply_trees(spark, f"{tmp_path}/empty").collect()] == [-7]


# ---- decontamination


def test_seeds_miss_no_allowed_overlap(spark):
    rng = np.random.default_rng(0)
    item = [f"t{i}" for i in range(20)]
    docs = []
    for i in range(60):
        part = item[3:16]
        for j in rng.choice(13, 2, replace=False):
            part[j] = "other"
        docs.append((i, " ".join(["pad", "pad2", *part, "tail"]), None, None, None, 0, "", ""))
    docs.append((999, " ".join(["x"] * 5 + item[:6] + ["y"] * 9), None, None, None, 0, "", ""))
    got = decontaminate.overlaps(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short")], "item_id long, text string"), scratch(spark))
    assert {r["doc_id"] for r in got.collect()} == set(range(60))


def test_decontamination_edges(spark, edge, none):
    bench = spark.createDataFrame([(1, LONG[:300]), (2, "")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.overlaps(edge, bench, scratch(spark)).collect()} == {4, 5}
    assert decontaminate.overlaps(none, bench, scratch(spark)).count() == 0
    assert decontaminate.overlaps(edge, bench.limit(0), scratch(spark)).count() == 0


# ---- html

PAGE = "<html><head><title>t</title><style>p{{}}</style></head><body><header><h2>Site</h2></header><nav><a href=x>home</a></nav><div class='cookie-notice'>ok?</div>{body}<aside>more</aside><form>mail <input></form><div id=comments><p>nice</p></div><script>if (a < b) '</p>';</script><footer>&copy; us</footer></body></html>"


def test_extracts_articles(spark):
    body = "<article><h1>A &amp; B</h1><p>one <b>two</b>\n three<br>four<p>five <a href=y>six</a></p><ul><li>x<li>y</ul></article>"
    rows = [(i, f"http://h.example.com/{i}", PAGE.format(body=body.replace("one", f"one{i}").replace("B<", f"B{i}<").replace("<li>y", f"<li>y{i}").replace("six", f"six{i}"))) for i in range(6)]
    rows += [(10, None, None), (11, "x", ""), (12, "http://h.example.com/c", "<article><p>cut off &lt;x <a hr"), (13, "http://q.example.com", "plain text")]
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch(spark)).collect()}
    assert got[3] == "A & B3\none3 two three four\nfive six3\nx\ny3"
    assert got[10] == "" and got[11] == "" and got[12] == "cut off <x" and got[13] == "plain text"


def test_template_slots_go(spark):
    rows = [(i, f"http://h.example.com/{i}", f"<body><div><div class=top><p>Same top line</p></div><div class=text><p>story {i} begins</p><p>and ends {i * 7}</p></div><div class=low>Same low line</div></div></body>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch(spark)).collect()}
    assert got[4] == "story 4 begins\nand ends 28"


def test_tree_matching_counts_pairs():
    tree = lambda h: html_wrapper.fold(html_wrapper.parse(h))
    a, b = tree("<div><h1>x</h1><p>1</p><p>2</p></div>"), tree("<div><h1>x</h1><table></table><p>1</p></div>")
    assert html_wrapper.match(html_wrapper.plain(a), a, {}) == 4 and html_wrapper.match(html_wrapper.plain(a), b, {}) == 4


def test_deep_markup():
    assert html_wrapper.extract(html_wrapper.parse("<div>" * 5000 + "deep" + "</div>" * 5000), set()) == "deep"


def test_deep_markup_closes_as_it_opens():
    deep = "<div>" * 250
    page = f"<div><article><p>first</p>{deep}deep<nav>menu<div>more menu</div></nav>{'</div>' * 250}<p>last</p></article>outside</div>"
    assert html_wrapper.extract(html_wrapper.parse(page), None) == "first\ndeep\nlast"

def best_pairing(a, b):
    """Simple tree matching by its definition: all order-keeping pairings of children."""
    if a[0] != b[0]:
        return 0
    if not a[1] or not b[1]:
        return 1
    return 1 + max(sum(best_pairing(x, y) for x, y in zip(xs, ys, strict=True)) for k in range(min(len(a[1]), len(b[1])) + 1) for xs in itertools.combinations(a[1], k) for ys in itertools.combinations(b[1], k))


def test_matching_equals_brute_force():
    g = np.random.default_rng(14)

    def tree(depth):
        return [str(g.choice(list("pq"))), [tree(depth - 1) for _ in range(g.integers(0, 4))] if depth else []]

    as_page = lambda t: (t[0], [as_page(k) for k in t[1]], [])
    for _ in range(60):
        a, b = tree(2), tree(2)
        a[0] = b[0] = "body"
        want = 1 + max(sum(max(best_pairing(x, y), 0) for x, y in zip(xs, ys, strict=True) if x[0] == y[0]) for k in range(min(len(a[1]), len(b[1])) + 1) for xs in itertools.combinations(a[1], k) for ys in itertools.combinations(b[1], k))
        assert html_wrapper.match(a, as_page(b), {}) == want


def test_the_wrapper_decides(spark):
    g = np.random.default_rng(15)
    words = lambda n: " ".join("".join(g.choice(list("abcdefgh"), 6)) for _ in range(n))
    rows, want, tips = [], {}, [words(5) for _ in range(3)]
    for i in range(24):  # no element or name tells template from content
        body = [words(30) for _ in range(3)]
        page = f"<div class=x1><p>Always the same line</p></div><div class=x2><h2>{words(4)}</h2>" + "".join(f"<p>{b}</p>" for b in body) + f"</div><div class=x3><p>{tips[i % 3]}</p></div>"
        rows.append((i, "http://a.example/" + str(i), f"<html><body>{page}</body></html>"))
        want[i] = body
    rows.append((99, "http://b.example/1", rows[0][2]))  # too few pages for a wrapper
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch(spark)).collect()}
    assert all(got[i].split("\n")[1:] == want[i] for i in want)
    assert got[99].split("\n")[0] == "Always the same line" and len(got[99].split("\n")) == 6


def test_tags_are_read_as_html_reads_them():
    text = lambda h: html_wrapper.extract(html_wrapper.parse(h), None)
    assert text("<article><div class='related-work'>aa</div><section id=search>bb</section><p class=notice>cc</p><div class='share price'>dd</div><div class='side effects'>ee</div></article>") == "aa\nbb\ncc\ndd\nee"
    assert text("<article><div class='ad box'>no</div><p title='x class=ad y'>yes</p><div id=comments>no</div></article>") == "yes"
    assert text("<p title=it's>hello one</p><p>it's two</p>") == "hello one\nit's two"
    assert text("<p>a <math><mi>x</mi><mo>+</mo><mi>y</mi></math> b <svg><text>q</text></svg> c<script>1 < 2</script> d</p>") == "a x+y b c d"
    assert text("<h1>t</h1><article>x</article>") == "x" and text("a < b <p>1 <2</p>") == "a < b\n1 <2" and text("<p>yes <a href=\"x") == "yes"
    for long in ('<a href="x ' * 400_000, "<a " * 1_400_000, "<!x " * 1_000_000, "<p title='" * 400_000, "< " * 2_000_000):
        start = time.perf_counter()
        html_wrapper.parse(long)
        assert time.perf_counter() - start < 5


def test_empty_and_repeated_pages(spark):
    kind = "page_id long, url string, html string, host string, text string, n int"
    same = (1, "http://a.example/1", "<article><p>x</p></article>", "clash", "clash", 1)
    df = spark.createDataFrame([same, same, (2, None, "<p>y</p>", None, None, 1), (3, "http://a.example/2", None, None, None, None), (None, "http://a.example/3", "", "", "", 0)], kind)
    got = sorted(((r["page_id"], r["text"]) for r in html_wrapper.extract_pages(df, scratch(spark)).collect()), key=str)
    assert got == [(1, "x"), (1, "x"), (2, "y"), (3, ""), (None, "")]
    assert html_wrapper.extract_pages(df.limit(0), scratch(spark)).count() == 0


class Plain(html.parser.HTMLParser):
    """The driver's pages by another parser: the blocks of their article."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag in ("p", "h1"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_pages_of_the_driver(spark):
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no driver tables")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_wrapper.op2_html_wrapper(spark, path).collect()}
    for r in spark.read.parquet(f"{path}/pages.parquet").collect():
        parser = Plain()
        parser.feed(r["html"] or "")
        parser.close()
        want = "\n".join(b for b in (" ".join(x.split()) for x in parser.blocks) if b)
        assert got[r["page_id"]] == (want, len(want))



# ---- packing


@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("public_tokenizers")
    return bm25_pack.tokenizer_path()


def test_ids_are_the_files_own(vocabulary):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(vocabulary), bm25_pack.Encoder(vocabulary)
    for text in ["", "Hello  world\n\n x", "ünïcode ✓ \U0001f600", "a <|endoftext|> b", "  lead", "don't 123 $$$", LONG[:5000], "\r\n\t"]:
        assert e(text).tolist() == t.encode(text, add_special_tokens=False).ids


def check_pieces(rows, window):
    by, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append(r)
        by[r["doc_id"], r["doc_tokens"]].append(r)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == window or at & (at - 1) == 0 and at < window
    return by


def test_packing_edges(spark, edge, none, vocabulary):
    rows = bm25_pack.pack_documents(edge, scratch(spark), window=64).collect()
    by = check_pieces(rows, 64)
    assert sum(r["length"] for r in rows if r["doc_id"] == 3) == 4 and by[1, 1][0]["ids_crc32"] == zlib.crc32(np.array([1], "<u4").tobytes())
    assert bm25_pack.pack_documents(none, scratch(spark)).count() == 0


def test_sequences_are_told_apart_where_partitions_are_chained(spark, vocabulary):
    docs = spark.createDataFrame([(i, f"text number {i} " * 20) for i in range(60)], "doc_id long, text string")
    rows = bm25_pack.pack_documents(docs.repartition(12), scratch(spark), window=64).coalesce(1).collect()
    check_pieces(rows, 64)
    assert len({r["doc_id"] for r in rows}) == 60


def test_neighbours_share_windows():
    g = np.random.default_rng(1)
    topics = [np.arange(k * 50, k * 50 + 50) for k in range(4)]
    docs = [np.append(g.choice(topics[i % 4], 30), 1).astype("<u2") for i in range(80)]
    idf = np.ones(bm25_pack.IDS, np.float32)
    idf[1] = 0
    pieces = bm25_pack.pack(docs, idf, 31.0, 128)
    windows = collections.defaultdict(list)
    for d, _, _, s, _ in pieces:
        windows[s].append(d % 4)
    alike = np.mean([collections.Counter(w).most_common(1)[0][1] / len(w) for w in windows.values()])
    assert alike > 0.8 and sum(p[2] for p in pieces) == sum(map(len, docs))


def test_scores_are_bm25_of_all_terms_by_brute_force():
    g = np.random.default_rng(5)
    docs = [np.append(g.zipf(1.3, int(g.integers(0, 400))) % 3000 + 2, 1).astype("<u2") for _ in range(120)]
    docs[7] = docs[50].copy()  # copies tie
    n, mean = len(docs), np.mean([len(x) for x in docs])
    df = collections.Counter(int(t) for x in docs for t in set(x.tolist()))
    idf = np.array([np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in range(bm25_pack.IDS)], np.float32)
    shard = bm25_pack.Shard(docs, idf, mean)
    tf = [collections.Counter(x.tolist()) for x in docs]
    for seed in range(n):
        want = [sum(float(idf[t]) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean)) for t, f in tf[d].items() if t in tf[seed]) for d in range(n)]
        others = np.arange(n) != seed  # its own score is never asked for
        assert np.allclose(shard.scores(seed)[others], np.array(want)[others], rtol=1e-4)
    shard.free[[0, 3]] = False
    got = list(shard.ranked(0))
    assert set(got) == {d for d in range(n) if d not in (0, 3)} and all(shard.scores(0)[a] >= shard.scores(0)[b] for a, b in itertools.pairwise(got))
    assert got.index(7) + 1 == got.index(50)  # the earlier one first


def test_subjects_meet_in_shards_wherever_they_stand(spark, vocabulary):
    g = np.random.default_rng(2)
    words = [[f"{chr(97 + k)}{a}{b}" for a in "aeiou" for b in "lmnrst"] for k in range(6)]
    docs = [(i, " ".join(g.choice(words[i % 6], 60))) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    shards = collections.defaultdict(list)
    for r in bm25_pack.pack_documents(df, scratch(spark), window=256, shard_docs=50).collect():
        shards[r["sequence_id"]].append(r["doc_id"] % 6)
    alike = np.mean([collections.Counter(x).most_common(1)[0][1] / len(x) for x in shards.values() if len(x) > 1])
    assert alike > 0.9


def test_pieces_of_long_documents_hold_their_ids_and_are_gapless(spark, vocabulary):
    docs = [(i, (f"text {i} of some words " * (7 * i)) + LONG[: 997 * i]) for i in range(12)] + [(4, "a tie"), (5, "a tie"), (5, "a tie")]
    df = spark.createDataFrame([(*d, 1, "u") for d in docs], "doc_id long, text string, row long, route string")
    encode = bm25_pack.Encoder(vocabulary)
    want = collections.defaultdict(list)
    for d, t in docs:
        x = np.array([*encode(t), 1], "<u4")
        want[d, len(x)].append(x)
    for (doc, n), pieces in check_pieces(bm25_pack.pack_documents(df, scratch(spark), window=128).collect(), 128).items():
        same = want.pop((doc, n))
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(same[0][r["start"] : r["start"] + r["length"]].tobytes())
        if len(same) == 1:
            at = 0
            for r in sorted(pieces, key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
            assert at == n
        else:
            assert sum(r["length"] for r in pieces) == n * len(same)
    assert not want


# ---- line dedup


def brute_lines(docs, least=2):
    seqs = {d: line_runs.content_lines(t or "") for d, t in docs}
    seen, out = set(), {}
    for d in sorted(seqs):
        norm = [" ".join(x.split()) for _, x in seqs[d]]
        dead = set()
        for i in range(len(norm) - least + 1):
            g = tuple(norm[i : i + least])
            if g in seen:
                dead |= set(range(i, i + least))
            seen.add(g)
        out[d] = len(dead)
    return out


def test_line_runs(spark):
    g = np.random.default_rng(2)
    docs = [(i, "\n".join(f"line {x}" for x in g.integers(0, 12, 14))) for i in range(40)]
    docs += [(100, docs[3][1]), (101, docs[3][1] + "\nnew tail\n\n")]
    rows = line_runs.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), scratch(spark)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in rows} == brute_lines(docs)
    copy = next(r for r in rows if r["doc_id"] == 100)
    assert copy["text"] == "" and copy["spans"] == [(0, 14)] and copy["deepest"] == 8


def test_long_lines_are_runs_by_themselves(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    docs = [(1, f"a\n{passage}\nb"), (2, f"c\n {passage} \nd"), (3, passage), (4, f"e\n{passage[4:]}\nf"), (5, f"g\n{passage[4:]}\nh")]  # the last two have 49 words
    rows = {r["doc_id"]: r["text"] for r in line_runs.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), scratch(spark)).collect()}
    assert rows == {1: docs[0][1], 2: "c\nd", 3: "", 4: docs[3][1], 5: docs[4][1]}


def test_line_runs_edges(spark, edge, none):
    rows = line_runs.dedup_lines(edge.withColumn("spans", F.lit(1)).withColumn("levels", F.lit(1)), scratch(spark)).collect()
    assert len(rows) == len(EDGE) and all(r["n_removed"] == (r["doc_id"] == 5) for r in rows) and rows[0]["host"] == "h"
    assert line_runs.dedup_lines(none, scratch(spark)).count() == 0


# ---- quality rules


@pytest.mark.parametrize("text", ["", "a", "a b c d e f g h a b c d e f g h", "x " * 30, "a b c d e f g h i " * 3 + "z", " ".join(map(str, range(50)))])
def test_repeated_words(text):
    w = text.encode().split()
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    assert line_quality.repeated_words(w) == len(hit)


def test_frequent_lines_deplete(spark):
    own = lambda i: " ".join(f"word{i}n{j}" for j in range(25))
    menu = " ".join(f"menu{j}" for j in range(40))
    docs = [(i, own(i) + "\n" + menu, "h") for i in range(12)] + [(100 + i, own(100 + i) + "\n" + menu, "other") for i in range(5)] + [(200, own(200), None)]
    got = {r["doc_id"]: r for r in line_quality.judge(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert not got[0]["kept"] and got[0]["n_lost_words"] == 40 and not got[0]["base_failed"] and got[100]["kept"] and got[200]["kept"]


def test_counts_do_not_depend_on_partitions(spark):
    docs = [(i, f"alpha beta {i}\nshared line of words\n" * 3, "h") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    one, many = (sorted(map(str, line_quality.judge(df.repartition(n)).collect())) for n in (1, 24))
    assert one == many and len(one) == 40


def test_quality_edges(spark, edge, none):
    rows = line_quality.judge(edge).collect()
    assert len(rows) == len(EDGE) and {r["doc_id"] for r in rows if r["base_failed"]} >= {1, 2, 3, 6}
    assert line_quality.judge(none).count() == 0


# ---- suffix-array dedup


def brute_bytes(docs, n):
    count = collections.Counter(b[i : i + n] for _, t in docs for b in [(t or "").encode()] for i in range(len(b) - n + 1))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((d, len(b), len(b) - len(left), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [1 << 15, 1])
def test_suffix_family_equals_brute_force(spark, crowd):
    g = np.random.default_rng(3)
    text = lambda n: "".join(g.choice(list("abcd"), n))
    seed = text(300)
    docs = [(i, text(200)) for i in range(20)]
    docs += [(100 + i, text(int(g.integers(0, 60))) + seed[int(g.integers(0, 100)) : int(g.integers(120, 300))] + text(30)) for i in range(25)]
    near = list(seed)
    for j in g.integers(0, 300, 6):
        near[j] = "é"
    docs += [(200, seed), (200, seed), (201, "".join(near)), (202, "ab" * 100), (203, "a" * 150), (204, None), (205, ""), (None, text(90) * 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = suffix_family.dedup_bytes(df, scratch(spark), length=40, k=12, crowd=crowd).drop("spans").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_bytes(docs, 40)


def test_anchors_are_local():
    g = np.random.default_rng(4)
    b = g.integers(97, 101, 500).astype(np.uint8)
    ((at, gram, first, last),) = suffix_family.anchors(b, 40, 12)
    assert first[0] == 0 and last[-1] == 460 and (first[1:] == last[:-1] + 1).all() and (at >= first).all() and (at + 12 <= last + 40).all() and (at <= first + 28).all()
    (shifted,) = suffix_family.anchors(b[100:300], 40, 12)
    inner = {(a + 100, x) for a, x in zip(shifted[0], shifted[1], strict=True)}
    assert inner <= set(zip(at, gram, strict=True))


def test_family_levels(spark):
    f = suffix_family.IndexFamily(scratch(spark))
    batch = lambda *x: spark.createDataFrame([(g, 10 * g + i, i, 1) for i, g in enumerate(x)], suffix_family.SUFFIX)
    f.add(batch(1, 2))
    assert [r["gram"] for r in f.scan(batch(2, 3)).collect()] == [2]
    f.add(batch(2, 3))
    f.add(batch(7, 7, 1))
    assert sorted(f.levels) == [0, 1]
    assert sorted((r["gram"], r["row"], r["at"]) for r in f.matched().collect()) == [(1, 10, 0), (1, 12, 2), (2, 20, 0), (2, 21, 1), (7, 70, 0), (7, 71, 1)]


def test_without_scans_nothing_is_found(spark, monkeypatch):
    g = np.random.default_rng(13)
    text = "".join(g.choice(list("abcdefgh"), 500))
    df = spark.createDataFrame([(1, text), (2, "x" + text)], "doc_id long, text string")
    removed = lambda: sum(r["n_removed"] for r in suffix_family.dedup_bytes(df, scratch(spark)).collect())
    assert removed() == 1000
    monkeypatch.setattr(suffix_family.IndexFamily, "scan", lambda self, batch: batch.select("gram").limit(0))
    assert removed() == 0


def test_long_repetitive_texts(spark):
    pair = "ab" * 120_000
    docs = [(1, "a" * 1_500_000), (2, pair), (3, "no repeat here" + "".join(chr(97 + i % 26) + str(i) for i in range(60)))]
    cut = scratch(spark)
    rows = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_family.dedup_bytes(spark.createDataFrame(docs, "doc_id long, text string"), cut).collect()}
    assert rows == {1: (1_500_000, 1), 2: (240_000, 1), 3: (0, 0)}
    b = np.frombuffer(docs[0][1].encode(), np.uint8)
    batch = pa.RecordBatch.from_pylist([{"text": docs[0][1], "row": 1, "grams": [int(next(suffix_family.anchors(b))[1][0])]}])
    assert sum(x.num_rows for x in suffix_family._stretched(200, 64)(iter([batch]))) < 1000  # of 1.5 million equal stretches


def test_suffix_edges(spark, edge, none):
    rows = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix_family.dedup_bytes(edge, scratch(spark)).collect()}
    assert rows[4, len(LONG)] == rows[5, len(LONG)] == len(LONG) and rows[1, 0] == 0
    assert suffix_family.dedup_bytes(none, scratch(spark)).count() == 0


# ---- licences


def test_bounds_lose_no_licence(spark):
    text = license_scan.TEMPLATES["MIT"][2]
    words = text.split()
    docs = [(1, "Intro.\n" + text), (2, " ".join(words[:8] + ["changed"] + words[9:])), (3, "Released under the MIT License. More text here."), (4, "permission is hereby granted to no one"), (5, None), (6, ""), (6, "Licensed under CC BY-NC 4.0.")]
    got = {(r["doc_id"], r["license"]): r for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT"), (3, "MIT"), (6, "CC-BY-NC-4.0"), (6, "CC-BY-4.0")} or set(got) == {(1, "MIT"), (2, "MIT"), (3, "MIT"), (6, "CC-BY-NC-4.0")}
    assert got[1, "MIT"]["dice"] == 1.0 and 0.9 < got[2, "MIT"]["dice"] < 1.0


def test_license_edges(spark, edge, none):
    assert license_scan.scan(edge).count() == 0 and license_scan.scan(none).count() == 0


# ---- near-duplicates


def near_docs():
    g = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    make = lambda n: list(g.choice(vocabulary, n))
    docs = [(i, " ".join(make(120))) for i in range(60)]
    for c in range(8):
        seed = make(200)
        docs.append((1000 + 100 * c, " ".join(seed)))
        for k in range(1, 6):
            other = list(seed)
            for j in g.integers(0, 200, 2):
                other[j] = "changed"
            docs.append((1000 + 100 * c + k, " ".join(other)))
    hot = make(300)
    for k in range(90):  # a group over SMALL, each copy with its own changes
        other = list(hot)
        for j in g.integers(0, 300, 3):
            other[j] = f"new{k}"
        docs.append((5000 + k, " ".join(other)))
    return [*docs, (4999, " ".join(hot)), (6000, " ".join(hot)), (6000, " ".join(hot)), (7001, "short"), (7002, "short"), (7003, ""), (7004, None)]


def test_near_duplicates_lose_no_link(spark):
    docs = near_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = minhash_icws.near_duplicates(df, scratch(spark))[1].collect()
    w = minhash_icws.idf(df)
    cls = {r["doc_id"]: r["class_id"] for r in rows}
    sets = {d: minhash_icws.shingles(t) for d, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a][0]) and minhash_icws.similarity(sets[a], sets[b], w) >= 0.8]
    assert len(rows) == len(docs) and len(links) > 100 and all(cls[a] == cls[b] for a, b in links)
    linked = {x for p in links for x in p}
    assert all(cls[d] == d for d in sets if d not in linked) and cls[7002] == 7001 and cls[7003] == 7003
    assert sum(r["kept"] for r in rows) == len({r["class_id"] for r in rows})


def test_large_bucket_links_left_over_to_placed(spark):
    g = np.random.default_rng(8)
    words = lambda k: [f"d{k}w{i}" for i in g.permutation(300)]
    lead = words(0)
    placed = lead[:265] + [f"p{i}" for i in range(35)]  # similar to the leader
    over = placed[35:] + [f"o{i}" for i in range(35)]  # similar to the placed one only
    docs = [(0, lead), (1, placed), (2, over), *[(k, words(k)) for k in range(3, 45)]]
    texts = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc long, text string")
    weights = minhash_icws.Weights(np.zeros(0, np.uint64), np.zeros(0), 1.0)
    sim = lambda a, b: minhash_icws.similarity(minhash_icws.shingles(" ".join(a)), minhash_icws.shingles(" ".join(b)), weights)
    assert sim(lead, placed) >= 0.75 > sim(lead, over) and sim(placed, over) >= 0.75
    node = texts.select("doc", F.array(F.lit(7).cast("long")).alias("bands"))  # one bucket holds all
    found = minhash_icws.similar_pairs(node, texts, weights, scratch(spark), 0.75).collect()
    assert {frozenset((r["doc"], r["leader"])) for r in found} == {frozenset((0, 1)), frozenset((1, 2))}


def test_samples_estimate_weighted_jaccard():
    g = np.random.default_rng(6)
    s = np.sort(g.integers(0, 1 << 63, 400).astype(np.uint64))
    a, b = g.uniform(0.5, 3, 300), g.uniform(0.5, 3, 300)
    x = minhash_icws.icws(np.concatenate([s[:300], s[100:]]), np.concatenate([a, b]), np.array([0, 300]), 600)
    wa, wb = np.zeros(400), np.zeros(400)
    wa[:300], wb[100:] = a, b
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((x[0] == x[1]).mean() - true) < 0.07


def test_group_of_edited_copies_is_not_expanded(spark):
    g = np.random.default_rng(11)
    base, passage = [f"b{i}" for i in range(150)], [f"s{i}" for i in range(60)]
    docs = []
    for d in range(5000):  # copies with up to twelve edits of their own: some similar to the original, some to nothing
        w = list(base)
        for k in g.integers(0, 150, g.integers(0, 13)):
            w[k] = f"e{d}x{k}"
        docs.append((d, " ".join(w)))
    family = [f"f{i}" for i in range(60)]  # and copies of the original with one addition that is the same in all
    docs += [(10_000 + d, " ".join([*base, *family, f"own{d}"])) for d in range(300)]
    docs += [(20_000 + d, " ".join([*passage, *[f"u{d}x{i}" for i in range(50)]])) for d in range(1000)]
    df, cut = spark.createDataFrame(docs, "doc_id long, text string"), scratch(spark)
    got = {r["doc_id"]: r["class_id"] for r in minhash_icws.near_duplicates(df, cut)[1].collect()}
    w = minhash_icws.idf(df)
    sets = {d: minhash_icws.shingles(t) for d, t in docs}
    sim = lambda a, b: minhash_icws.similarity(sets[a], sets[b], w)
    links = [(a, b) for a, b in g.integers(0, 5000, (30_000, 2)).tolist() if a != b and sim(a, b) >= 0.8]
    assert len(links) > 100 and all(got[a] == got[b] for a, b in links)
    assert len({got[10_000 + d] for d in range(300)}) == 1 and all(got[20_000 + d] == 20_000 + d for d in range(1000))
    compared = sum(spark.read.parquet(path).count() for kind in ("compared*", "turn*") for path in glob.glob(f"{cut.root.removeprefix('file:')}/{kind}")) + sum(spark.read.parquet(path).count() for path in [f"{cut.root}/families", f"{cut.root}/last"])
    assert compared < 4 * len(docs)  # of 12 million pairs


def test_near_copies_in_a_large_group_share_a_class(spark):
    g = np.random.default_rng(13)
    base = [f"b{i}" for i in range(150)]
    docs = [(0, " ".join(base))]
    for d in range(1, 400):  # each has three edits of its own: Jaccard 0.81 with the original, but much of the weight lies in the edits
        w = list(base)
        for k in g.choice(range(1, 29), 3, replace=False):
            w[5 * k + 2] = f"e{d}x{k}"
        docs.append((d, " ".join(w)))
    docs += [(1000 + d, " ".join(f"o{d}x{i}" for i in range(60))) for d in range(1000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    w, sets = minhash_icws.idf(df), {d: minhash_icws.shingles(t) for d, t in docs}
    even = minhash_icws.Weights(np.zeros(0, np.uint64), np.zeros(0), 1.0)
    assert min(minhash_icws.similarity(sets[0], sets[d], even) for d in range(1, 400)) >= 0.8 > max(minhash_icws.similarity(sets[0], sets[d], w) for d in range(1, 400))
    got = {r["doc_id"]: r["class_id"] for r in minhash_icws.near_duplicates(df, scratch(spark))[1].collect()}
    # at a weighted similarity of 0.67 about 1 of 70 shares no band with the original
    assert sum(got[d] == 0 for d in range(400)) >= 380 and all(got[1000 + d] == 1000 + d for d in range(1000))


def test_bounds_on_differences_never_fail_a_link(spark, monkeypatch):
    monkeypatch.setattr(minhash_icws, "TURNS", 2)
    monkeypatch.setattr(minhash_icws, "WORTH", 0)
    g = np.random.default_rng(12)
    base = [f"b{i}" for i in range(80)]
    docs, texts = {}, []
    for d in range(160):  # edits drawn from few places and words, so many share some
        w = list(base)
        for k in g.integers(0, 16, g.integers(0, 9)):
            w[5 * k] = f"e{k % 3}"
        docs[d] = " ".join(w + [f"t{i}" for i in range(g.integers(0, 3) * 8)])
    texts = spark.createDataFrame(list(docs.items()), "doc long, text string")
    weights = minhash_icws.Weights(np.zeros(0, np.uint64), np.zeros(0), 1.0)
    found = minhash_icws.similar_pairs(texts.select("doc", F.array(F.lit(7).cast("long")).alias("bands")), texts, weights, scratch(spark), 0.8).collect()
    cls = {d: d for d in docs}

    def root(d):
        while cls[d] != d:
            d = cls[d]
        return d

    for r in found:
        a, b = sorted((root(r["doc"]), root(r["leader"])))
        cls[b] = a
    sets = {d: minhash_icws.shingles(t) for d, t in docs.items()}
    links = [(a, b) for a in docs for b in docs if a < b and minhash_icws.similarity(sets[a], sets[b], weights) >= 0.8]
    assert len(links) > 50 and all(root(a) == root(b) for a, b in links)
    assert all(minhash_icws.similarity(sets[r["doc"]], sets[r["leader"]], weights) >= 0.8 for r in found)


def test_near_edges(spark, edge, none):
    rows = minhash_icws.near_duplicates(edge, scratch(spark))[1].collect()
    assert len(rows) == len(EDGE) and {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"]}[5] == 4
    assert sum(r["kept"] for r in rows if r["doc_id"] == 3) == 1  # rows of one id are one document
    assert minhash_icws.near_duplicates(none, scratch(spark))[1].count() == 0
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [(1, text("a")), (2, text("a") + " more"), (2, text("b")), (3, text("b")), (None, text("c")), (None, text("c")), (None, text("d")), (4, text("d"))]
    got = minhash_icws.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scratch(spark))[1].collect()
    told = collections.Counter((r["doc_id"], r["class_id"]) for r in got)
    assert told == {(1, 1): 1, (2, 1): 2, (3, 1): 1, (None, None): 2, (None, 4): 1, (4, 4): 1} and sum(r["kept"] for r in got) == 3
    assert {r["class_size"] for r in got if r["class_id"] == 1} == {3}


# ---- language

SOUNDS = {"aa": "na ti ko ru sa mi", "bb": "sch ung ber tz hof", "cc": "ción ado ñe lla que", "dd": "eau oux ère ille ment"}


def corpus(n, seed):
    g = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = sorted(SOUNDS)[i % 4]
        text = " ".join("".join(g.choice(SOUNDS[lang].split(), g.integers(2, 5))) for _ in range(40))
        rows.append((i, text, lang, f"site{i % 4}"))
    return rows


def test_language_accuracy_on_held_out_rows(spark):
    kind = "doc_id long, text string, lang string, source string"
    train, held = spark.createDataFrame(corpus(200, 1), kind), spark.createDataFrame([(d, t, None, s) for d, t, _, s in corpus(200, 2)], kind)
    got = {r["id"]: r for r in language_id.identify(language_id.document_rows(held), language_id.labels_of(train), scratch(spark)).collect()}
    right = sum(got[d]["lang"] == lang for d, _, lang, _ in corpus(200, 2))
    assert right >= 196 and sum(r["kept"] for r in got.values()) >= 196


def test_evidence_decides_short_texts(spark):
    kind = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame([*corpus(200, 1), (900, "nati", "aa", "site0"), (901, "zzzzqqqq jjjj xxxx wwww", "bb", "site1"), (902, None, "aa", "site0")], kind)
    got = {r["id"]: r for r in language_id.identify(language_id.document_rows(docs), language_id.labels_of(docs), scratch(spark)).collect()}
    assert not got[902]["kept"] and got[902]["lang"] == "und" and got[0]["posterior"] > 0.9 and len(got) == 203


def test_addresses(spark):
    df = spark.createDataFrame([("https://a.b.example.org:80/x",), ("nonsense",), (None,)], "u string")
    assert [tuple(r) for r in df.select(*language_id.host_parts(F.col("u"))).collect()] == [("a.b.example.org", "example.org", "org"), ("", "", ""), ("", "", "")]


def test_language_edges(spark, edge, none):
    rows = language_id.identify(language_id.document_rows(edge), language_id.labels_of(edge), scratch(spark)).collect()
    assert len(rows) == len(EDGE) and not any(r["kept"] for r in rows if r["id"] in (1, 2, 6))
    assert language_id.identify(language_id.document_rows(none), language_id.labels_of(none), scratch(spark)).count() == 0


# ---- plans


@pytest.mark.parametrize("native", ["decontaminate", "license"])
def test_native_operators_run_no_python(spark, edge, native):
    bench = spark.createDataFrame([(1, LONG[:300])], "item_id long, text string")
    df = decontaminate.overlaps(edge, bench, scratch(spark)) if native == "decontaminate" else license_scan.scan(edge)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))
