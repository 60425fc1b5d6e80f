"""Readers, writers, streams and control rules on small files."""

import hashlib
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import logs as L
from corpusloom.plans import control
from corpusloom.sources import readers as R
from corpusloom.sources import token_source as TS
from corpusloom.sources import versioned as V
from corpusloom.sources import writers as W
from corpusloom.streaming import monitor as M


def test_marked_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n<|endoftext|>\n  \n<|endoftext|>\nthree\n  <|endoftext|>  \ntail")
    assert sorted(r["text"] for r in R.marked_documents(spark, str(tmp_path / "a.txt")).collect()) == ["one\ntwo", "tail", "three"]


def test_jsonl_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text é {i}") for i in range(50)], "i long, text string")
    out = str(tmp_path / "out")
    made = W.rolled_jsonl(docs, "i", out, 300, batch=5, provenance={"from": "here"}).collect()
    names = sorted(p.name for p in (tmp_path / "out").glob("*.jsonl"))
    assert names == [r["file"] for r in made] == [f"shard_{k:05d}.jsonl" for k in range(len(made))] and len(made) > 3 and not list((tmp_path / "out").glob("_aside*"))
    told = json.loads((tmp_path / "out/manifest.json").read_text())
    assert told["documents"] == 50 and told["shards"] == names and told["provenance"] == {"from": "here"}
    assert told["bytes_jsonl"] == sum((tmp_path / "out" / n).stat().st_size for n in names) and told["chars"] == sum(len(f"text é {i}") for i in range(50))
    back = R.jsonl_folder(spark, out).orderBy("shard_no", "line_no").collect()
    assert [r["text"] for r in back] == [f"text é {i}" for i in range(50)]
    with pytest.raises(FileExistsError, match="already exists"):
        W.rolled_jsonl(docs, "i", out, 300)
    (tmp_path / "out/manifest.json").unlink()  # an interrupted run: no manifest, so it is cleared and starts again
    with pytest.raises(FileNotFoundError, match="no manifest"):
        R.jsonl_folder(spark, out)
    W.rolled_jsonl(docs.limit(5), "i", out, 300, batch=5)
    assert [p.name for p in (tmp_path / "out").glob("*.jsonl")] == ["shard_00000.jsonl"]


def test_extension_goes_on_from_the_manifest(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 100 if i % 7 else "  ") for i in range(400)], "i long, text string")
    with pytest.raises(FileNotFoundError, match="base"):
        R.extension_plan(spark, str(tmp_path / "base"), 10)
    W.rolled_jsonl(R.budget_documents(docs, "i", 2000), "i", str(tmp_path / "base"), 1000, batch=5)
    assert R.extension_plan(spark, str(tmp_path / "base"), 1000) == (20, int(1000 * 4.21 * 1.05)) and R.extension_plan(spark, str(tmp_path / "base"), 1, smoke=True) == (20, 4 << 20)
    base = {r["text"] for r in R.jsonl_folder(spark, str(tmp_path / "base")).collect()}
    more = sorted(r["i"] for r in R.extension(docs, "i", str(tmp_path / "base"), 1000).collect())
    full = [i for i in range(400) if i % 7]
    assert len(base) == 1 and more == full[20 : 20 + -(-int(1000 * 4.21 * 1.05) // 100)]


@pytest.fixture
def stream(tmp_path):
    g = np.random.default_rng(0)
    parts = {"w_train.bin": g.integers(0, 65536, 300_000), "w_train_ext_000.bin": np.arange(70_001) % 65536, "w_train_ext_001.bin": g.integers(0, 9, 5), "w_val.bin": g.integers(0, 9, 80)}
    for name, ids in parts.items():
        ids.astype("<u2").tofile(tmp_path / name)
    (tmp_path / "w_train_ext_002.bin").write_bytes(b"")
    return str(tmp_path), np.concatenate([v for k, v in parts.items() if "train" in k]), parts


def test_byte_ranges(spark, stream):
    """One file in many tasks; base and extension are one stream; a range reads its blocks only."""
    path, whole, parts = stream
    s = TS.token_stream_files(spark, path, "w_train*.bin", range_bytes=1 << 17)
    assert s.rdd.getNumPartitions() == 8 and s.agg(F.sum(F.size("tokens"))).first()[0] == len(whole)
    rows = s.orderBy("at").collect()
    assert np.array_equal(np.concatenate([r["tokens"] for r in rows]), whole) and all(r["start"] % TS.BLOCK == 0 for r in rows)
    edges = [0, 1, 65_535, 65_536, 65_537, 299_999, 300_000, 300_001, 370_000, 370_001, 370_005, 370_006, 10**9]
    for a in edges[::2]:
        for b in edges[1::3]:
            got = TS.token_range(spark, path, a, b, "w_train*.bin").orderBy("at").collect()
            assert [t for r in got for t in r["tokens"]] == whole[a:b].tolist() and all(r["at"] >= a for r in got)
    near = TS.token_stream_files(spark, path, "w_train*.bin", 299_990, 300_010, range_bytes=1 << 17)
    assert near.count() == 2 and near.rdd.getNumPartitions() == 2
    assert s.count() == rows.__len__() == s.filter("at > 300000").unionByName(s.filter("at <= 300000")).count()  # scans of one frame do not share bounds
    assert TS.token_stream_files(spark, path, "w_val.bin").first()["tokens"] == parts["w_val.bin"].tolist()


def test_odd_and_missing_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="not a whole number of tokens"):
        TS.token_stream_files(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="FileNotFoundError|nothing"):
        TS.token_stream_files(spark, str(tmp_path / "nothing")).collect()


def test_a_file_over_two_gigabytes(spark, tmp_path):
    """More bytes than an array of the JVM may have, in many tasks (the file is sparse: zeros take no disk)."""
    size, mark = (2 << 30) + (6 << 20), np.array([7, 8, 9], "<u2")
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(size)
        f.seek(size - 6)
        f.write(mark.tobytes())
    parts = TS.tree_digest(spark, str(tmp_path), part_bytes=1 << 28).first()
    each = [hashlib.sha256(bytes(1 << 28)).hexdigest()] * 8 + [hashlib.sha256(bytes((6 << 20) - 6) + mark.tobytes()).hexdigest()]
    assert parts["bytes"] == size and parts["parts"] == 9 and parts["tree_sha256"] == hashlib.sha256("".join(each).encode()).hexdigest()
    assert TS.token_stream_files(spark, str(tmp_path)).rdd.getNumPartitions() == 33
    assert TS.token_range(spark, str(tmp_path), size // 2 - 4, size).first()["tokens"] == [0, 7, 8, 9]


def test_digests(spark, stream):
    path, _, parts = stream
    want = {n: hashlib.sha256(v.astype("<u2").tobytes()).hexdigest() for n, v in parts.items()} | {"w_train_ext_002.bin": hashlib.sha256(b"").hexdigest()}
    assert {r["file"]: r["sha256"] for r in TS.file_digests(spark, path, "*.bin").collect()} == want


def test_token_writer(spark, stream, tmp_path):
    path, whole, parts = stream
    out = str(tmp_path / "out")
    s = TS.token_stream_files(spark, path, "w_train.bin,w_val.bin")
    TS.write_token_files(s, out)
    assert all(np.array_equal(np.fromfile(f"{out}/{n}", "<u2"), parts[n]) for n in ("w_train.bin", "w_val.bin"))
    told = {f["file"]: f for f in TS.manifest(out)["files"]}
    assert told["w_val.bin"] == {"file": "w_val.bin", "tokens": 80, "bytes": 160, "sha256": hashlib.sha256(parts["w_val.bin"].astype("<u2").tobytes()).hexdigest()}
    with pytest.raises(Exception, match="Writing job failed|written twice"):
        TS.write_token_files(s, out)
    TS.write_token_files(TS.token_stream_files(spark, path, "w_train_ext_00*.bin"), out)  # shards are appended, the base is not touched
    assert sorted(f["file"] for f in TS.manifest(out)["files"]) == ["w_train.bin", "w_train_ext_000.bin", "w_train_ext_001.bin", "w_val.bin"]
    (tmp_path / "out/stray.bin").write_bytes(b"\x01\x00")  # as an interrupted commit leaves it
    assert TS.token_stream_files(spark, out).select("file").distinct().count() == 4
    TS.write_token_files(s.filter("file = 'w_val.bin'"), out, "overwrite")
    assert [f["file"] for f in TS.manifest(out)["files"]] == ["w_val.bin"] and TS.token_stream_files(spark, out).count() == 1
    bad = [([("a.bin", 0, [1, 65536])], "16 bits"), ([("a.bin", 0, [-1])], "16 bits"), ([("a.bin", 0, [1]), ("a.bin", 2, [1])], "starts at 2"), ([("x/a.bin", 0, [1])], "plain")]
    for rows, why in bad:
        with pytest.raises(Exception, match=why):
            TS.write_token_files(spark.createDataFrame(rows, "file string, start long, tokens array<int>"), str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").glob("*.bin")) and not list((tmp_path / "bad/_temporary").glob("*"))


def test_token_files(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a", [5, 6]), (1, "a", [7]), (2, "b", []), (3, None, [65535])], "i long, d string, ids array<int>")
    made = W.token_files(docs, "i", "ids", 0, str(tmp_path / "t"), 4, by="d", batch=1)
    assert {m["file"]: np.fromfile(tmp_path / "t" / m["file"], "<u2").tolist() for m in made} == {"_train_ext_000.bin": [65535, 0], "a_train_ext_000.bin": [5, 6, 0], "a_train_ext_001.bin": [7, 0], "b_train_ext_000.bin": [0]}


def test_real_ids_fit(spark, tmp_path):
    """a public byte-level vocabulary of 50,000 entries, written, read and decoded."""
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = ["Hello world, ünï \U0001f600", "", "x" * 3000]
    docs = spark.createDataFrame([(i, t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)], "i long, ids array<int>")
    W.token_files(docs, "i", "ids", 1, str(tmp_path / "t"), 10**6)
    ids = TS.token_stream_files(spark, str(tmp_path / "t")).first()["tokens"]
    cut = [i for i, x in enumerate(ids) if x == 1]
    assert [t.decode(ids[a + 1 : b], skip_special_tokens=False) for a, b in zip([-1, *cut], cut)] == texts


def test_logs(spark, tmp_path):
    good = [json.dumps({"step": i, "tokens": i * 10, "loss": 2.0}) for i in range(5)]
    (tmp_path / "seedctl_s7_train_log.jsonl").write_text("\n".join([*good, "", '{"step": 9, "los']) + "\n")
    rows = R.training_log(spark, str(tmp_path)).collect()
    assert len(rows) == 5 and {r["run"] for r in rows} == {"s7"} and rows[0]["val_loss"] is None
    # a long file is read in many parts, the largest first; order is by place all the same
    with open(tmp_path / "seedctl_s8_train_log.jsonl", "w") as f:
        f.writelines(json.dumps({"step": i % 50, "loss": float(i)}) + "\n" for i in range(20_000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        log = R.training_log(spark, str(tmp_path)).filter("run = 's8'")
        won = {r["step"]: r["loss"] for r in L.last_wins(log, ["step"], "seq", "loss").collect()}
        tasks = log.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tasks > 5 and won == {k: 19_950.0 + k for k in range(50)}


def test_checkpoints(spark, tmp_path):
    for n in ("tokens_000000000100.pt", "tokens_000000000020.pt", "resume_state.pt"):
        (tmp_path / n).write_bytes(b"x")
    c = R.checkpoints(spark, str(tmp_path))
    assert [r["tokens"] for r in c.collect()] == [20, 100]
    assert [r["tokens"] for r in control.chosen(c).collect()] == [100] and control.chosen(c, tokens=[20]).count() == 1
    with pytest.raises(ValueError, match="does not exist"):
        control.chosen(c, tokens=[21])


def test_configuration(spark):
    assert R.schedule("[4e6, 1e6, 2e6, 1e6]") == (1_000_000, 2_000_000, 4_000_000)
    for bad in ('{"a": 1}', "[]", '["x"]', "[-1]", "[true]"):
        with pytest.raises(ValueError):
            R.schedule(bad)
    assert {r["domain"]: r["weight"] for r in R.mix(spark, "a=0.7,b=0.3").collect()} == {"a": 0.7, "b": 0.3}
    cases = {'{"tokens": true, "n_tokens": 3.0}': 3, '{"tokens": 5}': 5, "{}": None, '{"tokens": "7", "total_tokens": 9}': 9, '{"tokens": 3e0}': 3, '{"tokens": 3.5, "tokens_seen": 4}': 4, "torn{": None, "[1]": None}
    cases |= {'{"tokens": null, "tokens_seen": -2}': -2, '{"tokens": 1e30, "token_count": 12.000}': 12, '{"tokens": {"tokens": 1}, "n_tokens": 0}': 0, "null": None, '{"tokens": 9223372036854775807}': 2**63 - 1}
    j = spark.createDataFrame([(x,) for x in [*cases, None]], "j string")
    assert {r["j"]: r["t"] for r in j.select("j", R.first_of(F.col("j")).alias("t")).collect()} == cases | {None: None}
    states = {'{"model": 3, "state_dict": {"_orig_mod.a": [1], "b._orig_mod.c": 2}, "tokens": 1}': {"a": "[1]", "b._orig_mod.c": "2"}, '{"weights": {"w": 1}, "model": {"x": true}}': {"x": "true"}, '{"_orig_mod.x": null}': {"x": "null"}, "[]": None}
    j = spark.createDataFrame([(x,) for x in states], "j string")
    assert {r["j"]: r["m"] for r in j.select("j", F.transform_values(R.state_entries(F.col("j")), lambda k, v: F.to_json(v)).alias("m")).collect()} == states
    with pytest.raises(Exception, match="unknown d"):
        R.known_only(spark.createDataFrame([("x",)], "d string"), "d", ["a"]).collect()


def test_results(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"points": [{"tokens": None, "max_score": 1}, {"tokens": 5, "max_score": 0.5, "losses": {"a": 1.5, "b": 2.5}}]}))
    assert {(r["tokens"], r["domain"], r["loss"]) for r in R.result_points(spark, str(tmp_path / "r.json")).collect()} == {(5, "a", 1.5), (5, "b", 2.5)}
    rows = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 0.5)], "i int, x double")
    assert [json.loads(r["value"])["x"] for r in W.json_rows(rows).collect()] == [None, None, 0.5]
    W.append_log(rows, str(tmp_path / "log"))
    W.append_log(rows, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 6
    W.sidecar(spark.createDataFrame([(None, 1.0), (12, 2.0)], "tokens long, v double"), str(tmp_path / "side"))
    assert sorted(p.name for p in (tmp_path / "side").glob("ckpt=*")) == ["ckpt=random_init", "ckpt=tokens_000000000012"]


def test_reports(spark):
    text = W.report(spark.createDataFrame([("a", 1234567)], "name string, n long"), "Totals")
    assert "| a | 1,234,567 |" in text
    with pytest.raises(ValueError, match="dash"):
        W.report(spark.createDataFrame([("—",)], "name string"), "x")
    p = spark.createDataFrame([("/bulk/a",), ("/other",), ("/bulk2/a",), ("/bulk",)], "p string")
    assert [r[0] for r in p.select(W.portable(F.col("p"), "/bulk", "ROOT")).collect()] == ["$ROOT/a", "/other", "/bulk2/a", "$ROOT"]
    leaks = spark.createDataFrame([("val", 64, 0, True, True), ("test", 64, 3, True, False), ("odd", 8, 0, False, False)], "split string, samples long, leaks long, control boolean, passed boolean")
    lines = [r["line"] for r in W.leak_lines(leaks, 13, "web", 4).orderBy("ordinal").collect()]
    assert lines[:2] == ["13-gram leakage check for domain 'web'", "  train shards: 4"] and lines[-1] == "  verdict: FAIL"
    assert lines[2:5] == [
        "  odd: 0/8 sampled n-grams found in train -> clean; positive control FAIL (search found nothing)", "  test: 3/64 sampled n-grams found in train -> LEAK (3 of 64); positive control PASS", "  val: 0/64 sampled n-grams found in train -> clean; positive control PASS",
    ]
    assert W.leak_lines(leaks.filter("passed"), 13, "web", 4).orderBy(F.desc("ordinal")).first()["line"] == "  verdict: PASS"


def test_pairs(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"paradigm": "a", "item": 1, "good": "x", "bad": "y"}\n')
    assert R.pairs(spark, str(tmp_path)).count() == 1
    (tmp_path / "q.jsonl").write_text('{"paradigm": "a", "item": 2, "good": "x"}\n')
    with pytest.raises(Exception, match="lacks a sentence"):
        R.pairs(spark, str(tmp_path)).collect()


def test_versions_are_swapped_whole(spark, tmp_path):
    root = str(tmp_path / "t")
    assert not V.readable(spark, root)
    with pytest.raises(FileNotFoundError, match="no complete version"):
        V.table(spark, root)
    first = V.publish(spark.range(10).toDF("x"), root, {"source": "a"})
    assert first["rows"] == 10 and V.manifest(spark, root)["source"] == "a" and V.readable(spark, root)
    held = V.table(spark, root)
    stop, seen = threading.Event(), []

    def read():
        while not stop.is_set():
            seen.append(V.table(spark, root).agg(F.count("*"), F.sum("x")).first())

    reader = threading.Thread(target=read, daemon=True)
    reader.start()
    for n in (20, 30, 40):
        last = V.publish(spark.range(n).toDF("x"), root)
    stop.set()
    reader.join()
    assert seen and {tuple(r) for r in seen} <= {(n, n * (n - 1) // 2) for n in (10, 20, 30, 40)}  # old or new, never half
    assert held.count() == 10 and V.table(spark, root, first["version"]).count() == 10 and V.table(spark, root).count() == 40
    with pytest.raises(V.Conflict):
        V.publish(spark.range(5).toDF("x"), root, expected=first["version"])
    spark.range(3).write.parquet(f"{root}/version=dead")  # a writer that never came to its manifest
    assert V.table(spark, root).count() == 40
    assert set(V.tidy(spark, root)) >= {"dead", first["version"]} and V.table(spark, root, last["before"]).count() == 30
    with pytest.raises(FileNotFoundError):
        V.table(spark, root, first["version"])


def test_small_files_are_swapped_at_once(spark, tmp_path):
    """A reader never misses the file or sees part of it, while it is replaced some hundred times."""
    path, odd, stop = str(tmp_path / "pointer"), [], threading.Event()
    V.put(spark, path, "0" * 500)

    def read():
        while not stop.is_set():
            try:
                text = V.get(spark, path)
                if text is None or len(text) != 500 or len(set(text)) != 1:
                    odd.append(text)
            except Exception as e:
                odd.append(str(e))

    readers = [threading.Thread(target=read, daemon=True) for _ in range(3)]
    for r in readers:
        r.start()
    try:
        for i in range(300):
            V.put(spark, path, str(i % 10) * 500)
    finally:
        stop.set()
    for r in readers:
        r.join(30)
    assert odd == [] and [p.name for p in tmp_path.iterdir()] == ["pointer"]


def test_shards_past_999_stay_in_order(spark, tmp_path):
    shards = [0, 1, 100, 101, 999, 1000, 1001]
    rows = [(f"w_train_ext_{k:03d}.bin", 0, [k]) for k in shards] + [("w_train.bin", 0, [7])]
    TS.write_token_files(spark.createDataFrame(rows, "file string, start long, tokens array<int>"), str(tmp_path / "t"))
    got = TS.token_stream_files(spark, str(tmp_path / "t")).orderBy("at").collect()
    assert [r["tokens"][0] for r in got] == [7, *shards] and [f["file"] for f in TS.manifest(str(tmp_path / "t"))["files"]] == [r["file"] for r in got]


def test_token_files_can_be_versioned(spark, tmp_path):
    pieces = spark.createDataFrame([("a.bin", 0, [1, 2, 3])], "file string, start long, tokens array<int>")
    TS.token_stream_files(spark, str(tmp_path))  # registers the source
    V.publish(pieces, str(tmp_path / "v"), fmt="token_files")
    assert V.table(spark, str(tmp_path / "v")).first()["tokens"] == [1, 2, 3]


def test_round_trip(spark):
    public = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([("Hello world",), ("ünï",), (None,)], "text string")
    r = W.round_trip(docs, public.path("byte_bpe_50k.json")).first()
    assert r["docs"] == 3 and r["failed"] == 0 and r["tokens"] > 2


def test_codec_gives_the_files_own_ids_both_ways():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public.path("byte_bpe_50k.json"))
    t, both = Tokenizer.from_file(path), W.codec(path)
    for text in ["", "Hello  world\n\n x", "ünïcode ✓ \U0001f600", "a <|endoftext|> b", "  lead", "don't 123 $$$", "\r\n\t", "a\x00b" * 300]:
        assert both(text) == (len(t.encode(text, add_special_tokens=False).ids), text)


def test_stream_totals_and_probe(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [json.dumps({"run": "a", "step": i, "tokens": i, "loss": 1.0 + i / 10}) for i in range(20)]
    (tmp_path / "in/x.jsonl").write_text("\n".join([*rows, '{"run": "a", "st']) + "\n")
    q = M.running_totals(M.log_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["run"], r["n"], r["last"]) for r in spark.table("totals").collect()] == [("a", 20, 19)]
    M.probe_curve(M.log_stream(spark, str(tmp_path / "in")), str(tmp_path / "probe"), str(tmp_path / "cp2")).awaitTermination(60)
    assert spark.read.text(str(tmp_path / "probe")).count() == 20


def test_control(spark, tmp_path):
    assert control.next_step({"a": True, "b": False}) == ("b", 10) and control.next_step({"a": True}) == (None, 0) and control.next_step({"a": False}, hold="a") == ("a", 20)
    assert control.smoke_passed({"c": True}, "c", False) and not control.smoke_passed({"c": True}, "c", True)
    assert control.hold_of(spark, str(tmp_path)) is None and control.smoke_cache(spark, str(tmp_path)) == {}
    (tmp_path / "HOLD").write_text("b\n")
    assert control.next_step({"a": True, "b": False}, control.hold_of(spark, str(tmp_path))) == ("b", 20)
    control.smoke_told(spark, str(tmp_path), "c1", True)
    control.smoke_told(spark, str(tmp_path), "c2", False)
    cache = control.smoke_cache(spark, str(tmp_path))
    assert cache == {"c1": True, "c2": False} and control.smoke_passed(cache, "c1", False) and not control.smoke_passed(cache, "c2", False)
    (tmp_path / "smoke.json").write_text('{"c1": tr')
    (tmp_path / ".smoke.json.crc").unlink(missing_ok=True)
    assert control.smoke_cache(spark, str(tmp_path)) == {}
    assert control.after_divergence(0.4, False) == (0.2, 0) and control.after_divergence(0.2, True) == (None, 20)
    assert control.may_escalate(0.2, 0.1) and not control.may_escalate(0.1, 0.1)
    df = spark.createDataFrame([([1, 2],)], "a array<int>")
    with pytest.raises(ValueError, match="registered"):
        control.stamped(df, 8, 256)
    with pytest.raises(Exception, match="another length"):
        control.shape_checked(df, "a", 3).collect()
