"""What a Python worker holds at once: blocks, tables of powers, Arrow batches."""

import random
import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.llm import textscan as S, toxicity
from sparkloom.llm.tokenize import encoder, vocabulary
from tests.llm.test_operators import SCHEMA, prose


def test_encoding_holds_little_at_once_and_gives_it_back():
    rng = random.Random(5)
    batch = pa.RecordBatch.from_pydict({"text": [prose(rng, 300, 5000) for _ in range(3000)]})
    enc = encoder(vocabulary("word_bpe_49k.json"))
    want = enc.encode(batch.column("text").to_pylist()[:50])
    got = []
    tracemalloc.start()
    try:
        for part in S.blocks([batch], "text"):
            ids, starts = enc.column(part.column("text"))
            if len(got) < 50:
                got += [ids[a:z].tolist() for a, z in zip(starts[:-1], starts[1:], strict=True)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got[:50] == want
    print(f"peak {peak >> 20} MB")
    assert peak < 80 << 20
    assert not S._powers  # a worker that waits holds no table that is soon made again


def test_stages_bound_arrow_batches(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    try:
        corpus_pipeline.tokens(spark, spark.createDataFrame([(1, "one text", "en", "web", 8)], SCHEMA), str(tmp_path))

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

        wide = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
        rows = wide.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in rows) == 2000
        assert max(r["size"] for r in rows) < 6 << 20
    finally:
        spark.conf.unset(key)


def bags_of(rng, n, size, pool):
    """Documents of distinct words; every fourth is toxic and says so."""
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 15))) for _ in range(pool)]
    rows = [sorted(set(rng.choices(words, k=size))) + ["stupidest"] * (k % 4 == 0) for k in range(n)]
    return rows, pa.table({"toxic": pa.array([int(k % 4 == 0) for k in range(n)], pa.int32()), "words": pa.array([" ".join(r).encode() for r in rows], pa.binary())})


def test_training_holds_little_at_once_in_the_driver():
    rows, table = bags_of(random.Random(9), 1500, 400, 100_000)
    tracemalloc.start()
    try:
        model = toxicity.train(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    got = model.column(pa.array([" ".join(r) for r in rows])) >= 0
    assert got.tolist() == [k % 4 == 0 for k in range(len(rows))]
    print(f"peak {peak >> 20} MB")
    assert peak < 70 << 20


def test_strongest_bags_are_brute_force(monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_WORDS", 7, raising=False)
    monkeypatch.setattr(toxicity, "TRAIN_DOCS", 3, raising=False)
    rows, _ = bags_of(random.Random(10), 40, 12, 60)
    rows[5:7] = [[], []]
    table = pa.table({"words": pa.array([" ".join(r).encode() for r in rows], pa.binary())})
    bags = toxicity.Bags(table)
    weights = np.random.Generator(np.random.PCG64(3)).normal(0, 1, 1 << toxicity.BITS).astype(np.float32)
    top, picked = bags.strongest(weights)
    model = toxicity.Model(weights, 0.0)
    assert bags.have.tolist() == [k for k in range(40) if rows[k]]
    for k, t, w in zip(bags.have.tolist(), top, picked, strict=True):
        scores = [model.column(pa.array([x]))[0] for x in rows[k]]
        assert t == max(scores)
        buf = np.frombuffer(rows[k][int(np.argmax(scores))].encode(), np.uint8)
        assert bags.grams[bags.begin[w] : bags.begin[w + 1]].tolist() == S.ngrams(buf, np.array([0]), np.array([len(buf)]), toxicity.LEAST, toxicity.MOST, toxicity.BITS)[0].tolist()
    seen, toxic = bags.documents(np.arange(40) % 2)
    assert seen.sum() == sum(map(len, rows)) and toxic.sum() == sum(map(len, rows[1::2]))
    only_empty = pa.table({"toxic": pa.array([0, 1], pa.int32()), "words": pa.array([b"", b""], pa.binary())})
    assert toxicity.train(only_empty).bias == -4.0
