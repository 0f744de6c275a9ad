"""The pipeline's stages, each held against brute force on its own input, and the guard of the entry."""

import random
import struct
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import corpus_pipeline
from sparkloom.llm import queries, tokenize, toxicity
from tests.llm.test_operators import SCHEMA, WORD, brute_targets, classes, edited, prose

ROOT = Path(__file__).resolve().parents[2]


def corpus(spark, path):
    rng = random.Random(11)
    passages = [prose(rng, 30, 10**6) for _ in range(3)]
    rows, toxic = [], {}
    for k in range(240):
        t = prose(rng, rng.randrange(20, 120), 10**5)
        if k % 6 == 0:
            w = t.split()
            w.insert(rng.randrange(len(w)), rng.choice(["stupidest", "idiotic"]))
            t, toxic[k] = " ".join(w), 1
        elif k % 10 == 1:
            t = f"{t} {passages[k % 3]} {prose(rng, 9, 10**5)}"
        elif k % 10 == 3 and rows:
            t = edited(rng, rows[-1][1], 1)
        rows.append((k, t, "en", "abc"[k % 3 if k % 2 else 2], len(t)))
    rows += [(900, None, "en", None, None), (901, "", "en", "a", 0), (902, rows[2][1], "en", "b", 5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, toxic.get(k, 0)) for k in range(240)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return passages


def test_stages(spark, tmp_path):
    sf = f"file://{tmp_path}/sf"
    passages = corpus(spark, sf)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_output"]

    def step(name, docs):
        out = stages[name](spark, docs, sf)
        if name != "token_output":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mild = step("toxicity", docs)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}
    assert {r.doc_id for r in mild.collect()} == {i for i, s in score.items() if s < 0.5} and {900, 901} <= {r.doc_id for r in mild.collect()}
    single = step("ngram_jaccard_join", mild)
    ordered = sorted((r.doc_id, r.text) for r in mild.collect())
    _, root = classes([t for _, t in ordered])
    assert sorted(r.doc_id for r in single.collect()) == [i for k, (i, _) in enumerate(ordered) if root[k] == k]
    clean = step("benchmark_decontamination", single)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect() if not any(p in (r.text or "") for p in passages)}
    mixed = step("source_mixing", clean)
    rows = clean.collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    by = Counter()
    for r in rows:
        by[r.source] += size[r.doc_id]
    want, taken = brute_targets(dict(by)), Counter()
    for r in mixed.collect():
        taken[r.source] += size[r.doc_id]
    assert all(abs(taken[s] - want[s]) <= 60 for s in by) and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    last = sorted(step("token_output", mixed).collect(), key=lambda r: r.start)
    enc, at = tokenize.encoder(tokenize.vocabulary(corpus_pipeline.TOKENIZER)), 0
    for r, (i, t) in zip(last, sorted((r.doc_id, r.text) for r in mixed.collect()), strict=True):
        ids = [*enc.encode([t])[0], 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def test_entry_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules.pop('x', None); import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"
    for p in ROOT.iterdir():
        if p.name not in ("corpus_pipeline.py", "sparkloom", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "sparkloom").mkdir()
    for p in (ROOT / "sparkloom").iterdir():
        if p.name != "llm":
            (tmp_path / "sparkloom" / p.name).symlink_to(p)
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
    n, ops, ok = said.stdout.split()
    assert int(n) > 60 and ops == "0" and ok == "True"
    assert len(queries.queries()) == 13 and all(f"op{k}_" in " ".join(queries.queries()) for k in range(1, 14))
