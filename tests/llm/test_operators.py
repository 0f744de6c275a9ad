"""Small cases with defined results, against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import chat, components, decontaminate, jaccard, linededup, mixing, quality, shared, token_count, token_output, tokenize, toxicity, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCAB = tokenize.vocabulary("word_bpe_49k.json")


def frame(spark, texts, ids=None, sources=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources or ["s"] * len(texts), strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# tokens


ODD = ["", None, "it's 'tis don't'll x'S", "a<|endoftext|>b", "naïve ÀÉ ×÷", "Σας", "12 345.6 km!! '' 's's", "x" * 3000, "'", "'re've 'r", "tab\tnew\r\n", "\x1f a", "İstanbul", "a''s", "中文 text", "é́"]


def test_encoder_is_the_library():
    import pyarrow as pa

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        enc = tokenize.encoder(tokenize.vocabulary(name))
        ids, starts = enc.column(pa.array(ODD))
        want = enc.encode(["" if x is None else x for x in ODD])
        assert [ids[a:z].tolist() for a, z in zip(starts[:-1], starts[1:], strict=True)] == [list(x) for x in want]
    assert tokenize.encoder(VOCAB).pieces is not None


def test_token_files(spark, tmp_path):
    rng = random.Random(1)
    texts = ODD + [prose(rng, 30) for _ in range(40)] + ["same", "same"]
    ids = [None, *range(100, 100 + len(texts) - 3), 7, 7]
    docs = frame(spark, texts, ids).withColumn("token_ids", F.lit("clash"))
    token_output.write_tokens(docs, f"file://{tmp_path}/t", VOCAB, 1, ("lang", "token_ids"), partitions=3)
    got = token_output.digest(spark, f"file://{tmp_path}/t").collect()
    enc, at = tokenize.encoder(VOCAB), 0
    order = sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0))
    assert len(got) == len(texts)
    for r, (i, t) in zip(sorted(got, key=lambda r: r.start), order, strict=True):
        want = [*enc.encode([t or ""])[0], 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(want), zlib.crc32(struct.pack(f"<{len(want)}I", *want)))
        at += len(want)
    part = token_output.read_tokens(spark, f"file://{tmp_path}/t", ("doc_id", "meta_token_ids"), (100, 102))
    assert [tuple(r) for r in part.orderBy("doc_id").collect()] == [(i, "clash") for i in (100, 101, 102)]
    assert "token_ids:" not in part._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].replace("meta_token_ids:", "")
    token_output.write_tokens(docs.limit(0), f"file://{tmp_path}/e", VOCAB)
    assert token_output.digest(spark, f"file://{tmp_path}/e").count() == 0


def test_token_counts(spark):
    rng = random.Random(2)
    huge = "  ".join(prose(rng, 40) + ".\n" for _ in range(30))
    texts = [*ODD, huge, huge, "x" * 9000, ("ab " * 700) + "y" * 1500 + (" cd" * 900)]
    got = token_count.count_tokens(frame(spark, texts).withColumn("n_tokens", F.lit(0)), VOCAB, limit=50, chunk=1000, overlap=60).collect()
    enc = tokenize.encoder(VOCAB)
    for r in got:
        t = texts[r.doc_id] or ""
        n = len(enc.encode([t])[0])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 50)
    assert len(got) == len(texts) and token_count.count_tokens(frame(spark, texts).limit(0), VOCAB).count() == 0


def test_counts_of_huge_texts_with_every_file(spark):
    """Chunks spliced at boundaries give what the library gives for the whole text, for each kind of tokenizer file."""
    rng = random.Random(20)
    odd = " ".join(rng.choice(["naïve", "x  y", "ΑΒγ", "中文字", "it's", "12 345", "\n\n", "a\tb", "😀", "<|endoftext|>", "</s>", "don't", "e\u0301", "\u00a0", "..."]) for _ in range(900))
    texts = [prose(rng, 900), odd, "no" * 2000 + " spaces " + "中" * 1500, (" " * 700 + "a b" + " " * 900) * 2, "\n".join(prose(rng, 9) for _ in range(150))]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        path = tokenize.vocabulary(name)
        enc = tokenize.encoder(path)
        assert enc.cuttable
        got = token_count.count_tokens(frame(spark, texts), path, chunk=1500, overlap=100).collect()
        assert {r.doc_id: r.n_tokens for r in got} == {i: len(enc.encode([t])[0]) for i, t in enumerate(texts)}


def test_boundaries_lie_in_the_overlap_only():
    import pyarrow as pa

    text = "one two  three four-five six seven eight nine ten"
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        (ids, begins), = tokenize.encoder(tokenize.vocabulary(name)).marked(pa.array([text]))
        at = [x["at"] for x in token_count.boundaries(np.frombuffer(text.encode(), np.uint8), ids, begins, 0, len(text), 1)]
        assert at == [3, 14, 24, 28, 34, 40, 45]
        assert [x["at"] for x in token_count.boundaries(np.frombuffer(text.encode(), np.uint8), ids, begins, 20, 30, 1)] == [4, 8]


# near duplicates


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and sets[b]:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return [len(s) for s in sets], root


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("heavy", [64, 3])
def test_jaccard_classes(spark, heavy):
    rng = random.Random(3)
    texts = [None, "", "  \n", "One two", "one  TWO", "one two three", "a b c d e", "A b c d e"]
    base = prose(rng, 120)
    texts += [base] * 3 + [edited(rng, base, k % 7) for k in range(30)]
    for k in range(12):
        t = prose(rng, 60, 10**6)
        texts += [t, edited(rng, t, k % 5), t + " " + prose(rng, 3 * k, 10**6)]
    passage = prose(rng, 60, 10**6)
    texts += [f"{prose(rng, 25, 10**6)} {passage} {prose(rng, 25, 10**6)}" for _ in range(15)] + [prose(rng, 3000, 10**6), "é ß " * 9]
    ids = rng.sample(range(10**6), len(texts))
    want_n, want = classes([t for _, t in sorted(zip(ids, texts, strict=True))])
    ordered = sorted(ids)
    got = jaccard.jaccard_classes(frame(spark, texts, ids).withColumn("component_id", F.lit(1)), heavy_least=heavy).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (n, ordered[c]) for i, n, c in zip(ordered, want_n, want, strict=True)}
    assert len(got) == len(texts)


def hard_texts(rng):
    """Groups whose copies are a few to many words from their text, from two texts like each other, and from one another."""
    texts = []
    for words, copies, most in ((120, 60, 12), (70, 40, 9), (12, 12, 2)):
        base = prose(rng, words, 10**6)
        twin = edited(rng, base, max(1, words // 14))  # a text of its own that the copies of base don't link with as a rule
        texts += [edited(rng, base, rng.randrange(most)) for _ in range(copies)] + [edited(rng, twin, rng.randrange(most)) for _ in range(copies // 2)]
        chain = base
        for _ in range(6):
            chain = edited(rng, chain, max(1, words // 40))
            texts.append(chain)
        texts += [base + " " + prose(rng, k, 10**6) for k in range(0, words // 3, 4)] + [" ".join(base.split()[k:]) for k in range(0, words // 3, 4)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("how", [{}, {"heavy_least": 2, "heavy_most": 50, "per_task": 7, "together": 5}])
def test_jaccard_of_hard_groups(spark, how):
    """Families with classes beside their leader's, lists dealt out in parts and as grids: the classes of brute force."""
    texts = hard_texts(random.Random(13))
    want_n, want = classes(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(frame(spark, texts), **how).collect()}
    assert got == {i: (n, c) for i, (n, c) in enumerate(zip(want_n, want, strict=True))} and 5 < len(set(want)) < len(texts) - 50


def test_jaccard_pairs_grow_with_a_group(spark, monkeypatch):
    """A group of near copies, some linked through the text alone and some not at all, takes pairs in proportion to its size."""
    made = {}
    real = shared.Scratch.written

    def counted(self, df, name, **options):
        out = real(self, df, name, **options)
        if name in ("pairs", "family-pairs", "difference-lists"):
            made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(shared.Scratch, "written", counted)
    rng = random.Random(14)
    base = prose(rng, 150, 10**6)
    size = 800
    docs = frame(spark, [base] + [edited(rng, base, rng.randrange(1, 9)) for _ in range(size)])
    assert jaccard.jaccard_classes(docs).where("component_id = 0").count() > size / 2
    assert made["pairs"] + made["family-pairs"] < 4 * size and made["difference-lists"] < 20 * size


def test_jaccard_ids(spark):
    rng = random.Random(4)
    t, u = prose(rng, 50), prose(rng, 50, 10**6)
    docs = frame(spark, [t, t, u, edited(rng, t, 1), u + " end", "lone " * 9], [5, 5, None, 3, None, None])
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_classes(docs).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (3, 3), (None, None), (None, None), (None, None)], key=str)
    kept = jaccard.keep_one(docs)
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id) == [(False, 3)] and kept.columns == docs.columns and kept.count() == 4
    assert jaccard.jaccard_classes(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(200, k) for k in range(201, 260)] + [(7, 7)]
    root = {}
    for a, b in edges:
        if a != b:
            x, y = root.setdefault(a, a), root.setdefault(b, b)
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    got = components.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r.node: r.component for r in got.collect()} == root
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# lines


def near(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 5:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s, g = sorted((a, b), key=len)
    return any(g[:i] + g[i + 1 :] == s for i in range(len(g)))


def test_line_dedup(spark):
    rng = random.Random(6)
    base = [prose(rng, n, 50).split() for n in (5, 6, 9, 12, 4, 1)]
    texts = [None, "", "\n\n", "a\n\na"]
    for _ in range(40):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            w = list(rng.choice(base))
            kind = rng.randrange(5)
            at = rng.randrange(len(w))
            if kind == 1:
                w[at] = f"q{rng.randrange(3)}"
            elif kind == 2:
                w.insert(at, "ins")
            elif kind == 3:
                del w[at]
            lines.append(rng.choice([" ", "  "]).join(w) if w else "")
        texts.append("\n".join(lines))
    texts += ["long " * 3000, "long " * 3001]
    dropped, earlier = {}, []
    for i, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            w = WORD.findall(line)
            if w:
                if any(near(w, e) for e in earlier):
                    dropped.setdefault(i, set()).add(n)
                earlier.append(w)
    docs = frame(spark, texts).withColumn("line_no", F.lit("clash"))
    out = linededup.apply_line_dedup(docs, linededup.duplicate_lines(docs))
    assert out.columns == [*docs.columns, "n_dropped"]
    for r in out.collect():
        t = texts[r.doc_id]
        gone = dropped.get(r.doc_id, set())
        assert r.n_dropped == len(gone)
        assert r.text == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone))
    assert linededup.duplicate_lines(docs.limit(0)).count() == 0
    clash = docs.limit(9).withColumn("n_dropped", F.lit("mine")).withColumn("__row", F.lit("mine too"))
    both = linededup.apply_line_dedup(clash, linededup.duplicate_lines(clash))
    assert both.columns == [*clash.columns, "n_dropped_"] and {(r.n_dropped, r["__row"]) for r in both.collect()} == {("mine", "mine too")}
    assert {r.doc_id for r in linededup.duplicate_lines(docs, edits=0).collect()} <= {i for i, g in dropped.items() if g}
    odd = frame(spark, ["x y", "x y", "x y", "x y"], [None, 1, 1, 2])
    assert sorted((r.doc_id or 0, r.n_dropped) for r in linededup.apply_line_dedup(odd, linededup.duplicate_lines(odd)).collect()) == [(0, 0), (1, 0), (1, 0), (2, 1)]


# quality


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    cover = {k + j for k, x in enumerate(wins) if wins.count(x) > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_quality(spark):
    rng = random.Random(7)
    texts = [None, "", " \n\t", "a b", "\x0b x \x0c y\r\nz", "# $ | <> é中", "a\na\n\na\nb", ("a b c d e f " * 3).strip(), "r r r r r r r", prose(rng, 500, 12), "the cat of the house is in the garden and it is good"]
    docs = frame(spark, texts).withColumn("m", F.lit(1))
    got = quality.judged(docs).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        want = brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    assert got[-1].kept
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}
    assert quality.judged(docs.limit(0)).count() == 0


# toxicity


def test_toxicity(spark):
    rng = random.Random(8)
    bad = ["stupidest", "idiotic", "loserly"]
    texts, toxic = [], []
    for k in range(400):
        w = prose(rng, rng.randrange(5, 200), 300).split()
        toxic.append(k % 4 == 0)
        if toxic[-1]:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
    docs = frame(spark, [*texts, None, "", "stupidst", "STUPIDEST!", prose(rng, 5000, 300)], [*range(400), 1000, 1001, 1002, 1003, 1004]).withColumn("score", F.lit(9))
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score_texts(docs, model)
    got = {r.doc_id: r.score_ for r in out.collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == toxic[i] for i in held]) > 0.97
    assert got[1000] == got[1001] < 0.5 and got[1002] >= 0.5 and got[1003] >= 0.5 and got[1004] < 0.5
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score_texts(docs.limit(0), none).count() == 0
    assert {r.held for r in docs.select(toxicity.held_out(F.col("doc_id")).alias("held"), "doc_id").where("doc_id < 400").collect()} == {True, False}


def brute_score(model, text):
    """The largest bag's logit by plain Python, squashed."""
    words = [w for w in re.split(r"[\s.,;:!?\"()\[\]{}|]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    best = None
    for w in words:
        data = b"<" + w.encode() + b">"
        ids = []
        for n in range(toxicity.LEAST, toxicity.MOST + 1):
            for k in range(len(data) - n + 1):
                h = 0
                for c in data[k : k + n]:
                    h = (h + int(toxicity.S.BYTE_KEYS[c])) * int(toxicity.S.BASE) % 2**64
                ids.append(int(toxicity.S.mix(np.array([h], np.uint64))[0] >> np.uint64(64 - toxicity.BITS)))
        logit = model.bias + (np.mean([float(model.weights[i]) for i in ids]) if ids else 0)
        best = logit if best is None else max(best, logit)
    return 1 / (1 + np.exp(-(model.bias if best is None else best)))


def test_toxicity_scores_are_brute_force(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    model = toxicity.Model(rng.normal(0, 3, 1 << toxicity.BITS), -1.5)
    texts = ["", "Plain words, here!", "É naïve (中文) x", "a", "  ", "one|two|three", "same", "same", "w" * 5000 + " end"]
    got = {r.doc_id: r.score for r in toxicity.score_texts(frame(spark, texts), model).collect()}
    assert all(abs(got[i] - brute_score(model, t)) < 1e-5 for i, t in enumerate(texts)) and len(got) == len(texts)


def test_toxicity_sample_is_bounded(spark):
    docs = frame(spark, ["bad word here", "bad word here", "fine text there", "good text too"], [1, 1, 2, 3])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id bigint, toxic int")
    assert toxicity.training_rows(docs, labels, 10, 10**6).num_rows == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in (1, 2, 3))
    assert toxicity.training_rows(docs, labels, 10, 14).num_rows <= 1 and toxicity.training_rows(docs, labels, 1, 10**6).num_rows <= 1


# benchmark passages


def test_decontamination(spark):
    rng = random.Random(9)
    item = "Tom has 12 apples and he gives 5 of the apples away to his sister. How many apples are left with Tom at the end of the day?"
    other = item.replace("12", "31").replace("5", "9")
    clash = "Tom has 12 apples and he gives 12 of the apples away to his sister. How many apples are left with Tom at the end of the day?"
    plain = prose(rng, 40, 10**6)
    bench = spark.createDataFrame([(0, item), (1, plain), (2, None), (3, ""), (4, "only four common words"), (None, plain)], "item_id bigint, text string")
    lead = prose(rng, 30, 10**6)
    texts = [None, "", lead, f"{lead} {plain} {lead}", f"{lead}. {plain.upper()}!", f"{lead} {other}", f"{lead} {clash}", f"{lead} only FOUR common words. {lead}", " ".join(plain.split()[:9]), " ".join(plain.split()[:20]), f"{plain} {item}"]
    docs = frame(spark, texts).withColumn("item_id", F.lit("clash"))
    for most in (10**6, 0):  # with and without the broadcast filter
        got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.contaminated(docs, bench, broadcast_windows=most).collect()}
        assert got == {(3, 1): False, (4, 1): False, (5, 0): True, (6, 0): False, (7, 4): False, (9, 1): False, (10, 0): False, (10, 1): False}  # of 6, what stands as it is beside the clash
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 8}
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_judges_runs(spark):
    tell = "Ann sold 40 pears and then she sold 25 plums to the man next door"
    ask = "how much money did the seller take home after both of these sales were paid in full"
    trip = "they packed 14 red cups for the trip, indeed they lost 14 of them on the way back home"
    bench = spark.createDataFrame([(0, f"{tell} now {ask}"), (1, trip)], "item_id bigint, text string")
    clash = tell.replace("25", "40")
    texts = [f"{clash} then {ask}", f"{clash} now {ask}", clash, f"{tell.replace('25', '26')} then {ask}", trip.replace("indeed they lost 14", "sadly they lost 15")]
    got = {(r.doc_id, r.item_id): (r.n_tokens, r.reparameterised) for r in decontaminate.contaminated(frame(spark, texts), bench).collect()}
    assert got == {(0, 0): (25, False), (1, 0): (32, False), (3, 0): (32, True), (4, 1): (10, True)}


def test_decontamination_of_other_case_and_line_breaks(spark):
    item = "when the train from Köln stops in Ulm the guard calls Jörg and then Petra walks up with tea for Marta or Éva"
    bench = spark.createDataFrame([(0, item), (1, "we met Anna Maria Lopez twice")], "item_id bigint, text string")
    other = item.replace("Ulm", "Bonn").replace("Petra", "Heike")
    texts = [item, item.upper(), item.lower(), item.title(), item.replace(" Ulm", "\nUlm").replace(" Petra", ".\nPetra"), other, other.upper(), "So WE MET ANNA MARIA LOPEZ TWICE there", "tea for Marta or Éva"]
    got = {(r.doc_id, r.item_id): (r.n_tokens, r.reparameterised) for r in decontaminate.contaminated(frame(spark, texts), bench).collect()}
    n = len(item.split())
    assert got == {**{(k, 0): (n, False) for k in range(5)}, (5, 0): (n, True), (7, 1): (6, False)}


def test_decontamination_by_phrases_that_many_items_share(spark):
    """A phrase of 60 items brings no document together with them; it confirms, and copies of an item are one."""
    rng = random.Random(21)
    phrase = "choose the one best answer to the question from the options given below"
    items = [f"{phrase} {prose(rng, 12, 10**6)}" for _ in range(60)] + [phrase] * 30 + [f"a farmer has {k} sheep and then buys {k + 7} more of them at the fair" for k in range(50)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    lead = prose(rng, 20, 10**6)
    texts = [f"{lead} {phrase} {prose(rng, 20, 10**6)}" for _ in range(60)] + [f"{lead} {items[5]} {lead}", f"{lead} {items[95]}", f"{lead} {items[95].replace('5', '81')}", f"{items[95].replace('12', '5')}"]
    got = [tuple(r) for r in decontaminate.contaminated(frame(spark, texts), bench).select("doc_id", "item_id", "n_tokens", "reparameterised", "n_items").collect()]
    assert sorted(x for x in got if x[1] != 60) == [(60, 5, 25, False, 1), (61, 95, 15, False, 50), (62, 95, 15, True, 50)]
    assert {x[0] for x in got if x[1] == 60} == set(range(61)) and len(got) == 64  # the phrase is an item, too


@pytest.mark.parametrize("many", [1, 15, 25, 70])
def test_decontamination_of_passages_that_many_items_share(spark, many):
    """A copied passage is found however many items have it, whole or in two parts with other words between; one row for the
    passage, and with ``every_item`` one for each item."""
    rng = random.Random(25)
    word = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(n))
    passage, gap = word(18), word(5)
    items = [f"{word(rng.randrange(9, 30))} {passage} {word(rng.randrange(9, 30))}" for _ in range(many)] + [f"{passage[:89]} {gap} {passage[90:]} {word(12)}" for _ in range(many)]
    texts = [f"{word(20)} {passage} {word(20)}", f"{word(9)} {passage[:89]} {word(5)} {passage[90:]} {word(3)}", f"{word(9)} {' '.join(passage.split()[:9])} {word(9)}", items[0], word(60)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, texts), bench, every_item=True).collect()}
    assert got == {(i, k) for i, t in enumerate(texts) for k, x in enumerate(items) if brute_contaminated(t, x)} and {i for i, _ in got} == {0, 1, 3}
    few = [r.doc_id for r in decontaminate.contaminated(frame(spark, texts), bench).collect()]
    assert set(few) == {0, 1, 3} and len(few) <= 8


def test_decontamination_of_numbers_and_short_items(spark):
    rng = random.Random(22)
    row = "3 14 15 92 65 35 89 79 32 38 46 26"
    bench = spark.createDataFrame([(0, f"continue {row}"), (1, "seven times six"), (2, "Paris")], "item_id bigint, text string")
    lead = prose(rng, 20, 10**6)
    texts = [f"{lead} {row} {lead}", f"{lead} {row.replace('65', '66')} {lead}", "Seven times six?", f"{lead} seven times six {lead}", "paris", f"{lead} Paris"]
    for most in (10**6, 0):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, texts), bench, broadcast_windows=most).collect()}
        assert got == {(0, 0), (2, 1), (4, 2)}


def brute_contaminated(text, item, size=8, cover=10):
    """Whether ``cover`` tokens of the item stand in the text in one row of windows; for texts without names or numbers."""
    a, b = (re.findall("[a-z0-9]+", x.lower()) for x in (text, item))
    best = 0
    for d in range(-len(b), len(a)):
        hit = {k + j for k in range(len(b) - size + 1) if 0 <= d + k and a[d + k : d + k + size] == b[k : k + size] for j in range(size)}
        best = max(best, len(hit))
    return best >= cover or (best == len(b) >= size)


def test_decontamination_is_brute_force(spark):
    """Texts of few words with copied stretches of many lengths, very long ones and repeated rows among them."""
    rng = random.Random(23)
    word = lambda n, k: " ".join(f"w{chr(97 + rng.randrange(k))}x" for _ in range(n))
    items = [word(rng.randrange(8, 40), 26) for _ in range(25)]
    texts = []
    for _ in range(150):
        w = rng.choice(items).split()
        a = rng.randrange(len(w))
        texts.append(f"{word(rng.randrange(30), 26)} {' '.join(w[a : a + rng.randrange(6, 16)])} {word(rng.randrange(30), 26)}")
    texts += [word(20_000, 26) + " " + items[3] + " " + word(300, 26), texts[0], texts[0]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, texts), bench, every_item=True).collect()}
    want = {(i, k) for i, t in enumerate(texts) for k, x in enumerate(items) if brute_contaminated(t, x)}
    assert got == want and len(want) > 30


def test_small_letters():
    texts = ["AÄÖÜ ÉÈ ß ẞ ŁŃ", "ЖЮЯ ЁЂ", "ΑΒΓΩ", "Ếễ ༀ 中文 😀 x", "İI Kelvin \u212a"]
    for x in texts:
        want = "".join(c.lower() if len(c.lower().encode()) == len(c.encode()) else c for c in x)
        assert bytes(decontaminate.lower(np.frombuffer(x.encode(), np.uint8))).decode() == want


# mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


def test_mixing(spark):
    rng = random.Random(10)
    sources = ["a", "b", "c", None, "É", "z"]
    rows = [(rng.choices(sources, [1, 9, 60, 4, 2, 1])[0], prose(rng, rng.randrange(0, 40))) for _ in range(600)] + [("b", None)]
    docs = frame(spark, [t for _, t in rows], sources=[s for s, _ in rows])
    got = mixing.mixed(docs, per_bucket=20).collect()
    assert len(got) == len(rows)
    sizes = {s: sum(len(WORD.findall(t or "")) for x, t in rows if x == s) for s in sources}
    want = brute_targets(sizes)
    for s in sources:
        mine = [r for r in got if r.source == s]
        assert all(r["__source_size"] == sizes[s] and abs(r["__target"] - want[s]) < 1e-6 for r in mine)
        taken = sum(r["__copies"] * r["__size"] for r in mine)
        assert abs(taken - want[s]) <= 3 and all(0 <= r["__copies"] <= 3 for r in mine)
    again = {(r.doc_id, r["__copies"], r["__position"]) for r in mixing.mixed(docs, per_bucket=20).collect()}
    assert again == {(r.doc_id, r["__copies"], r["__position"]) for r in got}
    order = mixing.training_order(docs, per_bucket=20)
    seen = [r["__position"] for r in order.collect()]
    assert seen == sorted(seen) and len(seen) == sum(r["__copies"] for r in got) and 0 <= seen[0] and seen[-1] <= 1
    early = sum(r.source == "a" for r in order.collect()[: len(seen) // 2])  # falling weight
    assert early > 0.5 * sum(r["__copies"] for r in got if r.source == "a")
    assert mixing.mixed(docs.limit(0)).count() == 0
    twice = frame(spark, ["one two", "one two", "three", None], [1, 1, 1, None], ["s", "s", None, None])
    assert mixing.mixed(twice).count() == 4
    clash = twice.withColumns({c: F.lit(c) for c in ("__size", "__position", "__bucket", "__pass")})
    both = mixing.mixed(clash)
    assert both.columns[: len(clash.columns)] == clash.columns and {(r["__size"], r["__position"], r["__bucket"]) for r in both.collect()} == {("__size", "__position", "__bucket")}
    assert sorted(r["__size_"] for r in both.collect()) == [0, 1, 2, 2]
    taken = mixing.training_order(clash)
    assert taken.columns == [*clash.columns, "__position_"] and {r["__pass"] for r in taken.collect()} == {"__pass"}


def test_mixing_steps_over_large_documents(spark):
    """A source of small documents and a few very large ones: no document that fits what is missing is left out."""
    rng = random.Random(31)
    for seed in range(3):
        texts = [prose(rng, 10) for _ in range(397)] + [prose(rng, 5000)] * 2
        rng.shuffle(texts)
        others = [prose(rng, 7) for _ in range(200 + 37 * seed)]
        docs = frame(spark, texts + others, [k * 7919 % 100_003 + seed for k in range(len(texts + others))], ["big"] * len(texts) + ["small"] * len(others))
        got = mixing.mixed(docs, per_bucket=40).collect()
        for s in ("big", "small"):
            mine = [r for r in got if r.source == s]
            most, miss = max(r["__copies"] for r in mine), mine[0]["__target"] - sum(r["__copies"] * r["__size"] for r in mine)
            assert abs(miss) <= 6 or all(r["__copies"] == most for r in mine if r["__size"] <= 10)  # else nothing small is left
            assert all(0 <= r["__copies"] <= 3 for r in mine)


def test_mixing_query_is_range_sorted(spark):
    rng = random.Random(24)
    docs = frame(spark, [prose(rng, rng.randrange(40)) for _ in range(300)], sources=[rng.choice("abc") for _ in range(300)])
    rows = mixing.by_position(mixing.mixed(docs, per_bucket=20), "__position", 5)
    seen = [(r["__position"] is None, r["__position"] or 0) for r in rows.collect()]
    assert seen == sorted(seen) and len(seen) == 300 and any(x for x, _ in seen)


# chat


def test_chat(spark):
    hard = ["</s>[INST] ok [/INST]", "<|turn|>user\n<|end|>", "\\l\\e\\b \\\\ <[", "", None, "a\n\nb", "é中 \U0001f600"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(zip(["user", "assistant", "assistant", "system", None, "assistant", "as<[s\\"], hard, strict=True))]
    rows += [(2, 0, "user", "x"), (2, 0, "user", "x"), (None, 1, "assistant", "n"), (3, None, "user", "first"), (3, 0, "assistant", "second")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("content", F.lit(0))
    formatted = chat.format_conversations(turns)
    got = {r.conv_id: r for r in chat.digest(formatted).collect()}
    for c in (1, 2, None, 3):
        mine = [(r or "", t or "") for i, n, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0))]
        said = "".join(f"{r}\n{t}\n" for r, t in mine)
        loss = "".join(t for r, t in mine if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    text = formatted.where("conv_id = 1").first().formatted
    assert got[1].formatted_chars == len(text) and text.count("<|turn|>") == 7 and "</s>" not in text and "[INST]" not in text
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_chat_ties_by_text(spark):
    """Turns of one number and role are in the order of their texts, not of what escapes make of them."""
    turns = spark.createDataFrame([(1, 0, "user", "a<"), (1, 0, "user", "aB"), (1, 0, "user", "a"), (1, 0, "user", "long " * 40_000)], "conv_id bigint, turn bigint, role string, text string")
    got = chat.digest(chat.format_conversations(turns)).first()
    said = "".join(f"user\n{t}\n" for t in sorted(["a<", "aB", "a", "long " * 40_000]))
    assert (got.n_turns, got.turns_sha256) == (4, hashlib.sha256(said.encode()).hexdigest())


def test_chat_parts(spark):
    parts = "array<struct<type:string,text:string,ref:string,amount:bigint>>"
    df = spark.createDataFrame([(1, 0, "user", [("text", "see <", None, None), ("image", None, "a.png", None), ("audio", None, "b.wav", 3), None, ("odd", None, None, None)]), (1, 1, "assistant", None)], f"conv_id bigint, turn bigint, role string, parts {parts}").withColumn("text", F.lit("unused"))
    r = chat.format_conversations(df, F.col("parts")).first()
    assert r.formatted == "<|turn|>user\nsee \\l<|image:1|><|audio:2|><|end|><|turn|>assistant\n<|end|>"
    assert [tuple(a) for a in r.attachments] == [(0, 1, "image", "a.png", 576), (0, 2, "audio", "b.wav", 75)] and r.expanded_tokens == 651


# urls


def brute_rule(host, path):
    best = None
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


def test_urls(spark):
    cases = [None, "", "no scheme", "http://A.Example.NET/en/x?y", "https://example.net/en", "https://badexample.net/en/1", "http://x.net", "http://x.net/", "ftp://example.com/de/#a", "http://example.com/DE/", "http://sub.org/fr/", "http://org/fr/1", "http://h?q://z/", "a://b://c/d", "http://casino-bonus.win/free/bonus/win", "http://www.library.example.org/en/1"]
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id bigint, url string").withColumn("host", F.lit("clash"))
    got = urls.judged(pages).orderBy("page_id").collect()
    for r, u in zip(got, cases, strict=True):
        host, path = urls.split_url(u)
        rule = brute_rule(host, path)
        assert (r["__host"], r["__path"], r["__rule"]) == (host, path, rule and rule[1]) and (rule is None or r["__verdict"] == rule[0])
    assert [got[k]["__verdict"] for k in (0, 14, 15)] == ["allow", "block", "allow"]
    kept = urls.drop_blocked(pages)
    assert kept.columns == pages.columns and {r.page_id for r in kept.collect()} == {r.page_id for r in got if r["__verdict"] == "allow"}
    assert urls.judged(pages.limit(0)).count() == 0


def test_url_model_decides(spark):
    """Held-out rows of the table by hand; unheard-of hosts of either kind, harmless ones with words of the other kind in them."""
    model = urls.fit()
    precision, recall = urls.measure(folds=(0, 1, 2, 3, 4))
    assert precision >= 0.9 and recall >= 0.9 and len(urls.LABELLED) > 500
    hard = "https://alphabet-soup.org/letters https://bread-and-butter.com/loaves http://betterhomes-magazine.com/kitchen https://crossroads-church.org/choir http://windsurf-school.com/lessons https://steamtrack-railway.org/times http://freedomtrail.org/boston https://farmhouse-holidays.com/rooms".split()
    assert (model.logits(*urls.columns(hard)) > 0).sum() <= 1
    bad = [f"https://{h}/en/1" for h in ("m.casino-win.example.com", "free-bets.example.com", "www.spam-farm.example.com", "cheap-pills.example.org", "blog.adult-x.example.com")]
    good = ["http://university.edu/research/paper", "http://www.thther.example.org/de/9", "http://city-library.info/casino/history"]
    pages = spark.createDataFrame([(k % 9, u) for k, u in enumerate([*bad, *good, *bad])], "page_id bigint, url string").withColumns({c: F.lit(c) for c in ("__host", "__url", "__verdict", "__score")})
    out = urls.judged(pages)
    assert out.columns == [*pages.columns, "__host_", "__path", "__rule", "__verdict_"]
    for r in out.collect():
        assert (r["__verdict_"] == "block") == (r.url in bad) and r["__verdict"] == "__verdict" and r["__host"] == "__host"
    assert urls.drop_blocked(pages).columns == pages.columns and urls.drop_blocked(pages).count() == len(good)


def test_url_scores_are_brute_force():
    rng = np.random.Generator(np.random.PCG64(4))
    model = urls.Model(rng.normal(0, 1, 1 << urls.BITS), -0.2)
    cases = ["", "http://a.b/c", "https://É.example/ß?x", "http://" + "long." * 2000 + "org/" + "p/" * 3000, "x://y"]
    for u, got in zip(cases, model.logits(*urls.columns(cases)), strict=True):
        want = model.bias
        for side, text in enumerate(urls.split_url(u)):
            ids = []
            for word in re.findall(rb"[A-Za-z0-9\x80-\xff]+", text.encode()):
                data = b"<" + word.lower() + b">"
                for n in range(urls.LEAST, urls.MOST + 1):
                    for k in range(len(data) - n + 1):
                        h = 0
                        for c in data[k : k + n]:
                            h = (h + int(toxicity.S.BYTE_KEYS[c])) * int(toxicity.S.BASE) % 2**64
                        ids.append((int(toxicity.S.mix(np.array([h], np.uint64))[0]) >> (64 - urls.BITS + 1)) + (side << (urls.BITS - 1)))
            want += sum(float(model.weights[i]) for i in ids) / max(1, len(ids)) ** 0.5 * (urls.PATH_SHARE if side else 1)
        assert abs(want - got) < 1e-3


def test_shared_folder(spark):
    df = shared.written(spark.range(3).toDF("a"), "x")
    assert df.count() == 3 and shared.shared_dir(spark) in df.inputFiles()[0].replace("file:///", "file:///")
