"""Rounds of near-duplicates over documents that are far from each other and share rare shingles."""

import random
from pathlib import Path

from corpusloom.llm import minhash_icws
from corpusloom.llm.common import Scratch


def test_groups_of_far_members_do_not_multiply(spark):
    r = random.Random(3)
    blocks = [[f"b{b}w{i}" for i in range(30)] for b in range(30)]
    texts = [" ".join(w for b in sorted(r.sample(range(30), 10)) for w in blocks[b]) for _ in range(40)]
    texts += [t + " and more" for t in texts[:4]]  # these are near copies
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    node = spark.createDataFrame([(d, [7]) for d in range(len(texts))], "doc long, bands array<long>")  # all meet in one bucket
    scratch = Scratch(spark, "far")
    weights = minhash_icws.idf(docs)
    links = minhash_icws.similar_pairs(node, docs, weights, scratch)
    found = {x: x for x in range(len(texts))} | {x["doc"]: x["class"] for x in minhash_icws.components(links, Scratch(spark, "far-classes")).collect()}
    sets = [minhash_icws.shingles(t) for t in texts]
    want = {(x, y) for x in range(len(texts)) for y in range(x) if minhash_icws.similarity(sets[x], sets[y], weights) >= minhash_icws.THRESHOLD}
    assert len(want) >= 4 and all(found[x] == found[y] for x, y in want)
    rounds = [spark.read.parquet(str(p)).count() for p in sorted(Path(scratch.root.removeprefix("file://")).glob("told*"), key=lambda p: int(p.name[4:]))]
    assert max(rounds[2:], default=0) <= rounds[1] and len(rounds) <= 8, rounds
