"""Prefix trie, language ID and filter audit against plain Python: nulls, ties, hot groups, empty tables, clashing names."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.llm import audit, langid, prefix_trie
from tests.llm.test_operators import WORD, frame

TURNS = "conv_id bigint, turn int, role string, text string"


# trie


def brute_trie(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = turns.get(base, [])[:h] + mine[h:]
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    kids = {}
    for key in members:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    out = set()

    def totals(key):
        below = [totals(k) for k in kids.get(key, [])]
        own = (len(members[key]) - 1) * (len(key[-1][1]) if key else 0)
        leaves, saved = sum(x[0] for x in below) or 1, own + sum(x[1] for x in below)
        ends = ",".join(map(str, sorted(c for c in members[key] if len(built[c]) == len(key))))
        up = min(members[key[:-1]]) if key else None
        out.add((min(members[key]), len(key), up, len(members[key]), len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        totals(())
    return out


def trie(spark, rows, parts=None):
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in ("depth", "k1", "part", "up")})
    got = prefix_trie.conversation_trie(df if parts is None else df.repartition(parts)).collect()
    return [tuple(r) for r in got]


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    rng = random.Random(3)
    rows = []
    for c in range(-130, 420, 3):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["hi", "héllo 😀", "", None, "a\nb", "ab"])))
    for c in range(0, 400, 100):
        rows += [(c, t, "user", f"{t}{c}") for t in range(4)]
    rows += [(7, 1, "user", "tie"), (7, 1, "user", "tie"), (7, 1, "assistant", "tie"), (None, 1, "user", "nobody"), (None, None, None, None)]
    # a third of all rows: one conversation; a third of the others: copies of one
    rows += [(5001, k // 2, "user", f"long {k % 3}") for k in range(40)]
    rows += [(c, t, "user", f"copy {t}") for c in range(6000, 6060) for t in range(6, 12)]
    got = trie(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute_trie(rows)
    assert prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS).limit(0)).count() == 0


def test_trie_of_one_hot_conversation(spark):
    """One conversation over many ranges of the sort, equal rows among them; a round for each branching, not for each turn."""
    rows = [(200, 1, "user", "same")] * 300 + [(200, 2, "user", f"x{k}") for k in range(300)] + [(201, k, "a", "b") for k in range(10)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert set(trie(spark, rows, 7)) == brute_deep(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def brute_deep(rows):
    import sys

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(10_000)
    try:
        return brute_trie(rows)
    finally:
        sys.setrecursionlimit(limit)


# languages


ALPHABETS = {"aa": "the and of with quick house river stone", "bb": "ñandú jalapeño corazón señal mañana niño", "cc": "straße über können schön größe fünf", "dd": "дом река камень быстрый вода", "ee": "子供水山川日本語"}


def speak(rng, lang, n):
    words = ALPHABETS[lang].split()
    return ("" if lang == "ee" else " ").join(rng.choice(words) for _ in range(n))


def test_codewords():
    for n in (2, 3, 5, 6, 9, 40, 300):
        code = langid.codewords(n)
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert code.shape[0] == n and apart >= (1 if n < 3 else 2 if n < 5 else 3) and set(np.unique(code)) == {-1, 1}
        assert all(0 < (column == 1).sum() < n for column in code.T)
    assert langid.codewords(1).shape == (1, 0) and langid.codewords(0).shape == (0, 0)


def test_language_id(spark):
    rng = random.Random(5)
    langs = [rng.choice(["aa"] * 6 + list(ALPHABETS)) for _ in range(600)]
    texts = [speak(rng, x, rng.randrange(3, 80)) for x in langs]
    ids = list(range(600))
    extra = [None, "", "123 !! 45", "…", "THE QUICK", "x" * 5000, speak(rng, "dd", 4000), "the and of straße über können", texts[0]]
    docs = spark.createDataFrame([*zip(ids, texts, langs, strict=True), *((1000 + k, t, None) for k, t in enumerate(extra)), (None, "the river", "aa"), (3, texts[3], langs[3])], "doc_id bigint, text string, lang string").withColumns({"score": F.lit(7), "has_letter": F.lit("x")})
    model = langid.fit(docs)
    out = langid.predict(docs, model)
    assert out.columns == [*docs.columns, "lang_pred", "score_", "ambiguous"]
    got = {}
    for r in out.collect():
        assert got.setdefault(r.doc_id, r) == r and 0 <= r.score_ <= 1
    held = [i for i in ids if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].lang_pred == langs[i] for i in held]) > 0.98
    assert [got[1000 + k].lang_pred for k in range(5)] == ["und"] * 4 + ["aa"] and got[1000].score_ == 0 and not got[1003].ambiguous
    assert got[1006].lang_pred == "dd" and got[1008].lang_pred == langs[0] and got[None].lang_pred == "aa" and got[1007].score_ < got[1006].score_
    # nothing, one language
    none = langid.fit(docs.where("lang is null"))
    assert {(r.lang_pred, r.score_) for r in langid.predict(docs, none).collect()} == {("und", 0.0)}
    one = langid.fit(docs.where("lang = 'bb'"))
    assert {r.lang_pred for r in langid.predict(docs, one).collect()} == {"bb", "und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_language_sample(spark):
    """As many of each language, none of the held-out fold, one row of each id, bounded."""
    rows = [(k, "word other", "aa" if k % 10 else "bb") for k in range(2000)] + [(1, "word other", "aa")] * 500 + [(None, "x", "aa")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.sample(docs, 60, 512).collect()
    assert len({r.doc_id for r in got}) == len(got) and not any(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert {x: sum(r.lang == x for r in got) for x in ("aa", "bb")} == {"aa": 30, "bb": 30}
    assert {r.lang for r in langid.sample(docs, 60, 1).collect()} == {"aa"}


def test_language_outputs_are_brute_force():
    rng = np.random.Generator(np.random.PCG64(9))
    code = langid.codewords(4)
    model = langid.Model(list("abcd"), code, rng.normal(0, 2, (1 << langid.BITS, code.shape[1])), rng.normal(0, 1, code.shape[1]), rng.uniform(0.5, 2, code.shape[1]))
    texts = ["", "Plain words, here!", "naïve中文 x1y", "a", "same", "same", "w" * 3000]
    f = model.outputs(pa.array(texts))
    best, score, unsure = model.decode(f)
    for i, t in enumerate(texts):
        ids = []
        for w in re.findall(rb"[A-Za-z\x80-\xff]+", t.encode()):
            for a in range(0, len(w), langid.LONGEST):
                data = b"<" + w[a : a + langid.LONGEST].lower() + b">"
                for n in range(langid.LEAST, langid.MOST + 1):
                    for k in range(len(data) - n + 1):
                        h = 0
                        for c in data[k : k + n]:
                            h = (h + int(langid.S.BYTE_KEYS[c])) * int(langid.S.BASE) % 2**64
                        ids.append(int(langid.S.mix(np.array([h], np.uint64))[0] >> np.uint64(64 - langid.BITS)))
        want = model.bias + (model.weights[ids].astype(float).mean(0) if ids else 0)
        assert np.allclose(want, f[i], atol=1e-3)
        cost = [sum(model.trust[b] * np.log1p(np.exp(-code[c, b] * want[b])) for b in range(len(want))) for c in range(4)]
        belief = np.exp(min(cost) - np.array(cost))
        assert best[i] == int(np.argmin(cost)) and abs(score[i] - 1 / belief.sum()) < 1e-2 and unsure[i] == (score[i] < langid.SURE)


# audit


def brute_audit(docs, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    first, fails = {}, []
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, text, lang in docs:
        t = text or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        fails.append((lang or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out = {}
    for part in {x[0] for x in fails}:
        mine = [x[1:] for x in fails if x[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [x for x in mine if f in x[0] and not x[0] & before]
                total[f] += len(here)
                out[part, order, step] = [sum(not x[0] & (before | {f}) for x in mine), len(here), sum(f in x[0] and bool(x[0] & before) for x in mine), sum(x[0] == {f} for x in mine), sum(x[1] for x in here), sum(x[2] for x in here)]
        for order, step in [k[1:] for k in out if k[0] == part]:
            out[part, order, step].append(total[order[step - 1]])
    return out


def test_filter_audit(spark):
    rng = random.Random(2)
    docs = []
    for k in range(150):
        n = rng.choice([0, 5, 99, 100, 120, 125])
        w = [f"w{rng.randrange(rng.choice([90, 100_000]))}" for _ in range(n)]
        if rng.random() < 0.3:
            w = [x.upper() + "ABCD" for x in w]
        if rng.random() < 0.3:
            w.append(rng.choice("#$%&*|"))
        docs.append((k, rng.choice([" ", "\n", "\x0b "]).join(w), rng.choice(["en", "de", None, ""])))
    docs += [(k, docs[0][1], "en") for k in range(500, 600)] + [(3, docs[3][1], "de"), (3, docs[3][1], "de"), (None, docs[0][1], "de"), (None, None, None), (700, None, "fr"), (701, "", "fr"), (702, "é" * 9 + "A", "fr"), (703, "é" * 8 + "AA", "fr")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(140)] + [(None, 1, 1), (5, 1, 1), (5, 0, 0)]
    frame_ = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumns({c: F.lit(1) for c in ("part", "mask", "digest", "good")})
    said = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit("clash"))
    got = audit.filter_audit(frame_, said).collect()
    want = brute_audit(docs, labels)
    assert len(got) == len(want) == 600 * 4
    assert {(r.part, r.filter_order, r.step): [r[c] for c in audit.COUNTS] for r in got} == want
    assert audit.filter_audit(frame_.limit(0), said).count() == 0 and audit.filter_audit(frame(spark, ["a"]), said.limit(0)).count() == 600


def test_outcomes_add_up():
    by = audit.outcomes()
    assert all(m.shape == (32, 600) and m.dtype == np.int64 for m in by.values())
    kept, removed = by["kept"].reshape(32, 120, 5), by["removed"].reshape(32, 120, 5)
    assert (kept + removed.cumsum(2) == 1).all() and (removed.sum(2) == (np.arange(32) > 0)[:, None]).all()
