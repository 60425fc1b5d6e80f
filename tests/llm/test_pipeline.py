"""The pipeline on a small corpus with planted cases, each stage against a brute-force expectation."""

import numpy as np
import pytest

import corpus_pipeline as pipeline

KIND = "doc_id long, text string, lang string, source string, n_chars long"
SOUNDS = {"aa": "na ti ko ru sa mi", "bb": "sch ung ber tz hof", "cc": "ción ado ñe lla que", "dd": "eau oux ère ille ment"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    pytest.importorskip("public_tokenizers")
    g = np.random.default_rng(0)
    word = lambda lang: "".join(g.choice(SOUNDS[lang].split(), g.integers(2, 6)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    langs = sorted(SOUNDS)
    docs = {i: (text(langs[i % 4], 80), langs[i % 4]) for i in range(60)}
    lines = "\n".join(text("aa", 12) for _ in range(6))
    docs[100] = docs[101] = (lines, "aa")  # a copy of which no line is left
    docs[102] = (text("aa", 30) + "\n" + "\n".join(lines.split("\n")[2:5]) + "\n" + text("aa", 30), "aa")  # repeats three lines
    near = docs[8][0].split()
    near[40] = "changed"
    docs[110] = (" ".join(near), "aa")
    item = text("bb", 25).split()
    docs[120] = (text("bb", 40) + " " + " ".join(item[:9] + ["other"] + item[10:]) + " " + text("bb", 20), "bb")
    docs[130], docs[131] = ("1234 5678 !!!", "cc"), (None, "dd")
    path = tmp_path_factory.mktemp("sf")
    rows = [(d, t, lang, f"src{d % 3}", len(t or "")) for d, (t, lang) in docs.items()]
    spark.createDataFrame(rows, KIND).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, lines


def test_stages(spark, folder, tmp_path):
    path, docs, lines = folder
    now, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        stage(spark, now, path).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert now.columns == list(pipeline.COLUMNS)
        seen[name] = {r["doc_id"]: r["text"] for r in now.collect()} if "text" in now.columns else now.collect()
    every = set(docs)
    assert set(seen["language_id"]) == every - {130, 131}
    assert set(seen["line_dedup"]) == every - {130, 131, 101}
    kept = docs[102][0].split("\n")
    assert seen["line_dedup"][102] == kept[0] + "\n" + kept[-1] and seen["line_dedup"][100] == lines
    assert set(seen["near_dedup"]) == every - {130, 131, 101, 110}
    last = every - {130, 131, 101, 110, 120}
    assert set(seen["decontamination"]) == last
    from tokenizers import Tokenizer

    from corpusloom.llm.bm25_pack import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path())
    size = {d: len(t.encode(seen["decontamination"][d], add_special_tokens=False).ids) + 1 for d in last}
    got: dict = {}
    for r in seen["packing"]:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == size


def test_run_equals_stages(spark, folder):
    path, docs, _ = folder
    assert {r["doc_id"] for r in pipeline.run(spark, path).select("doc_id").distinct().collect()} == set(docs) - {130, 131, 101, 110, 120}
