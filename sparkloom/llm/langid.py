"""Language ID by error-correcting output codes over character n-grams.

Every language has a codeword of bits; for each bit one binary classifier (logistic regression on hashed n-grams of 1 to 4 bytes
of the text's words, trained in numpy) says whether the text's language has it set.  A text gets the language whose
codeword costs least: each bit's logistic loss, weighted by how well that bit's classifier did on training texts it hadn't seen.  Up to 6 languages have
all different ways to split them in two as bits, more have the most separated of many random codes.

A classifier's output is a mean over the text's n-grams, so scoring adds one short vector for each word, and vectors of distinct words
are kept by each task (a bounded cache).

Learnt from: text and lang of rows whose crc32(doc_id as text) mod 5 is not 0, at most ``sample_rows`` of them, the same number for
each of at most ``most_langs`` languages (the most frequent ones), chosen by a hash of the id; besides the whole texts, short stretches
of theirs, so that texts of a few words are judged too.  Every text is scored whole and alike.

Defined results: null texts and texts without a letter are ``und`` with score 0, not ambiguous; without anything to learn from all are ``und``; with one
language all with letters are that one, score 1; texts of n-grams never seen get the nearest codeword all the same; rows with a
null doc_id are predicted, not held out and not learnt from; repeated rows are predicted alike, one of each id is learnt
from; :func:`predict` keeps extra columns and takes other names where its own clash; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import textscan as S
from .shared import free_names, written
from .toxicity import held_out

U = np.uint64
LEAST, MOST, BITS = 1, 4, 16
#: What isn't a letter in ASCII parts words; all bytes beyond ASCII belong to words.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
UNKNOWN = "und"
#: Numbers in a task's table of words; it is emptied beyond, as it is a cache only.
MOST_CELLS = 4_000_000
#: A longer run of letters (texts without spaces) is taken as words of so many bytes.
LONGEST = 1024
#: Belief below which a text is ambiguous: another codeword is about as near.
SURE = 0.75


def codewords(n: int, seed: int = 11, tries: int = 200) -> np.ndarray:
    """A row of -1 and 1 for each of n classes; all rows differ, and each column has both."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 6:
        splits = np.arange(1, 1 << (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1, -1).astype(np.int8)
    rng = np.random.Generator(np.random.PCG64(seed))
    length, best, apart = int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(tries):
        code = rng.choice(np.array([-1, 1], np.int8), (n, length))
        agree = code.astype(np.int32) @ code.T.astype(np.int32)
        np.fill_diagonal(agree, -length)
        least = (length - agree.max()) // 2
        if least > apart and np.all(np.abs(code.astype(np.int32).sum(0)) < n):
            best, apart = code, least
    if best is None or apart < 1:
        raise ValueError(f"no code separates {n} classes")
    return best


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts."""
    starts, ends = S.runs(LETTER[buf], offs)
    parts = -(-(ends - starts) // LONGEST)
    if not len(parts) or parts.max() == 1:
        return starts, ends
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    cut = np.repeat(starts, parts) + nth * LONGEST
    return cut, np.minimum(cut + LONGEST, np.repeat(ends, parts))


class Model:
    """langs, their codewords, one weight for each n-gram bucket and bit, biases and weights of the bits."""

    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.langs, self.code, self.weights, self.bias, self.trust = langs, code, weights.astype(np.float32), bias, trust
        self._empty()

    def __reduce__(self):
        return Model, (self.langs, self.code, self.weights, self.bias, self.trust)

    def _empty(self) -> None:
        self.keys, self.sums, self.counts = np.zeros(0, U), np.zeros((0, self.code.shape[1]), np.float32), np.zeros(0, np.int64)

    def outputs(self, col: pa.Array) -> np.ndarray:
        """Each classifier's output for each text."""
        buf, offs = S.raw(col)
        buf = S.LOWER[buf]
        out = np.tile(self.bias, (len(offs) - 1, 1))
        starts, ends = word_spans(buf, offs)
        if not len(starts):
            return out
        keys, first, back = np.unique(S.hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            if (len(self.keys) + (~known).sum()) * (len(self.bias) + 2) > MOST_CELLS:
                self._empty()
                known = np.zeros(len(keys), bool)
            new = first[~known]
            sums, counts = word_sums(buf, starts[new], ends[new], self.weights)
            order = np.argsort(np.concatenate([self.keys, keys[~known]]))
            self.keys = np.concatenate([self.keys, keys[~known]])[order]
            self.sums, self.counts = np.concatenate([self.sums, sums])[order], np.concatenate([self.counts, counts])[order]
            at = np.searchsorted(self.keys, keys)
        owner = S.owners(starts, offs)
        edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        n = np.add.reduceat(self.counts[at][back], edge)
        word = self.sums[at]
        for bit in range(out.shape[1]):  # a column at a time, so a block of many words and bits stays small
            out[owner[edge], bit] += np.add.reduceat(word[:, bit][back], edge, dtype=np.float64) / n
        return out

    def costs(self, outputs: np.ndarray) -> np.ndarray:
        """Loss of each language's codeword for each text."""
        wrong, right = np.logaddexp(0, outputs) * self.trust, np.logaddexp(0, -outputs) * self.trust
        return wrong @ (self.code < 0).T.astype(float) + right @ (self.code > 0).T.astype(float)

    def decode(self, outputs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest codeword's language, its share of the belief, and whether another is about as near."""
        if len(self.langs) < 2:
            return np.zeros(len(outputs), np.int64), np.ones(len(outputs)), np.zeros(len(outputs), bool)
        cost = self.costs(outputs)
        belief = np.exp(-(cost - cost.min(1, keepdims=True)))
        belief /= belief.sum(1, keepdims=True)
        best = cost.argmin(1)
        score = belief[np.arange(len(best)), best]
        return best, score, score < SURE


def word_sums(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the weights of each word's n-grams, and how many these are."""
    lens = ends - starts
    cuts = [0]
    while cuts[-1] < len(lens):  # words of about ``most`` bytes at a time; their n-grams take some fifty times as much
        total = np.cumsum(lens[cuts[-1] : cuts[-1] + most])
        cuts.append(cuts[-1] + max(1, int(np.searchsorted(total, most, "right"))))
    sums, counts = np.zeros((len(lens), weights.shape[1]), np.float32), np.zeros(len(lens), np.int64)
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        z = min(z, len(lens))
        grams, begin = S.ngrams(buf, starts[a:z], ends[a:z], LEAST, MOST, BITS)
        for bit in range(weights.shape[1]):
            sums[a:z, bit] = np.add.reduceat(weights[:, bit][grams], begin[:-1])  # a word has a letter between two marks at least, so no part is empty
        counts[a:z] = np.diff(begin)
    return sums, counts


def sample(docs: DataFrame, sample_rows: int, most_langs: int) -> DataFrame:
    """doc_id, lang of the rows to learn from: as many of each language, those least by a hash of the id."""
    known = docs.where("lang is not null and doc_id is not null and text is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "lang")
    langs = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).toArrow().to_pylist()  # at most most_langs rows
    if not langs:
        return known.limit(0)
    each = max(1, sample_rows // len(langs))
    sizes = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in langs], "lang string, n bigint"))
    turn = F.xxhash64(F.lit(5), F.col("doc_id"))
    # about twice as many as wanted by the hash's size, so that the exact choice is among a bounded number of rows
    thin = known.join(sizes, "lang").where(F.pmod(turn, F.lit(1 << 40)) <= F.least(F.lit(1.0), (2 * each + 100) / F.col("n")) * float(1 << 40))
    thin = thin.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    w = Window.partitionBy("lang").orderBy(F.pmod(turn, F.lit(1 << 40)), "doc_id")
    return thin.withColumn("k", F.row_number().over(w)).where(F.col("k") <= each).select("doc_id", "lang")


def training_rows(docs: DataFrame, sample_rows: int, most_langs: int) -> pa.Table:
    """lang, and n-gram buckets with their counts, of the sampled texts and of short stretches of them: at most four rows for each text,
    each of at most 2**BITS entries."""

    def counted(batches):
        for part in S.blocks(batches, "text", 1 << 18):
            ids, langs, kinds, buckets, counts = [], [], [], [], []
            for row in range(part.num_rows):
                buf, offs = S.raw(part.column("text").slice(row, 1))
                buf = S.LOWER[buf]
                starts, ends = word_spans(buf, offs)
                if not len(starts):
                    continue
                doc = part.column("doc_id")[row].as_py()
                rng = np.random.Generator(np.random.PCG64(doc & (2**63 - 1)))
                spans = [(0, len(starts))]
                for size in (3, 8, 25):
                    if len(starts) > size:
                        a = int(rng.integers(0, len(starts) - size + 1))
                        spans.append((a, a + size))
                for kind, (a, z) in enumerate(spans):
                    total = np.zeros(1 << BITS, np.int32)
                    for k in range(a, z, 5_000):
                        grams, _ = S.ngrams(buf, starts[k : min(z, k + 5_000)], ends[k : min(z, k + 5_000)], LEAST, MOST, BITS)
                        total += np.bincount(grams, minlength=1 << BITS).astype(np.int32)
                    has = np.flatnonzero(total).astype(np.int32)
                    ids.append(doc)
                    langs.append(part.column("lang")[row].as_py())
                    kinds.append(kind)
                    buckets.append(has.tobytes())
                    counts.append(total[has].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(kinds, pa.int32()), pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "lang", "kind", "buckets", "counts"])

    # the sample has at most sample_rows rows of an id and a language, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null").join(F.broadcast(sample(docs, sample_rows, most_langs)), "doc_id").select("doc_id", "lang", "text")
    made = rows.mapInArrow(counted, "doc_id bigint, lang string, kind int, buckets binary, counts binary")
    one = made.groupBy("doc_id", "kind").agg(F.min(F.struct("lang", "buckets", "counts")).alias("m")).select("doc_id", "kind", "m.*")  # one text of each id
    return written(one, "language-grams").orderBy("doc_id", "kind").select("lang", "buckets", "counts").toArrow()


def train(table: pa.Table, epochs: int = 12, rate: float = 0.5, batch: int = 256, seed: int = 3) -> Model:
    """All classifiers by Adagrad on mini-batches; every tenth row is kept back first, to weigh the bits by."""
    langs = sorted(set(table.column("lang").to_pylist()))
    code = codewords(len(langs))
    if code.shape[1] == 0:
        return Model(langs, code, np.zeros((1 << BITS, 0)), np.zeros(0), np.zeros(0))
    label = np.searchsorted(np.array(langs, object), np.array(table.column("lang").to_pylist(), object))
    x = [np.frombuffer(b, np.int32) for c in table.column("buckets").chunks for b in c.to_pylist()]
    n = [np.frombuffer(b, np.int32).astype(np.float32) for c in table.column("counts").chunks for b in c.to_pylist()]
    n = [v / v.sum() for v in n]
    rng = np.random.Generator(np.random.PCG64(seed))
    back = np.arange(len(x)) % 10 == 9
    weight = 1 / np.bincount(label, minlength=len(langs))[label]
    weight *= len(label) / weight.sum()
    bits = code.shape[1]
    w, bias = np.zeros((1 << BITS, bits), np.float32), np.zeros(bits)
    seen, seen_bias = np.full((1 << BITS, bits), 1e-8, np.float32), np.full(bits, 1e-8)

    def outputs(rows):
        flat, share = np.concatenate([x[r] for r in rows]), np.concatenate([n[r] for r in rows])
        edge = S.segments(np.array([len(x[r]) for r in rows]))
        return flat, share, edge, np.stack([np.add.reduceat(w[:, b][flat] * share, edge[:-1]) for b in range(bits)], 1) + bias

    use = np.flatnonzero(~back)
    for _ in range(epochs):
        rng.shuffle(use)
        for a in range(0, len(use), batch):
            rows = use[a : a + batch]
            flat, share, edge, f = outputs(rows)
            y = code[label[rows]]
            err = -y / (1 + np.exp(np.clip(y * f, -30, 30))) * weight[rows, None] / len(rows)
            live, where = np.unique(flat, return_inverse=True)
            for b in range(bits):
                g = np.bincount(where, weights=np.repeat(err[:, b], np.diff(edge)) * share, minlength=len(live)).astype(np.float32)
                seen[live, b] += g * g
                w[live, b] -= rate * g / np.sqrt(seen[live, b])
            g = err.sum(0)
            seen_bias += g * g
            bias -= 0.05 * rate * g / np.sqrt(seen_bias)
    trust = np.ones(bits)
    kept = np.flatnonzero(back)
    if len(kept):
        f = np.concatenate([outputs(kept[a : a + batch])[3] for a in range(0, len(kept), batch)])
        wrong = (np.sign(f) != code[label[kept]]).astype(float)
        rate_wrong = ((wrong * weight[kept, None]).sum(0) + 0.5) / (weight[kept].sum() + 1)
        trust = np.maximum(0.05, np.log((1 - rate_wrong) / rate_wrong))
        trust *= bits / trust.sum()
    return Model(langs, code, w, bias, trust)


def fit(docs: DataFrame, sample_rows: int = 6_000, most_langs: int = 512) -> Model:
    return train(training_rows(docs, sample_rows, most_langs))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, and ``lang_pred``, ``score``, ``ambiguous``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers for each bit, of which there are 10 times the logarithm of most_langs at most
    lang, score, unsure, letter = free_names(docs.columns, "lang_pred", "score", "ambiguous", "has_letter")

    def scan(batches):
        m = sent.value
        names = pa.array([*m.langs, UNKNOWN])
        for part in S.blocks(batches, "text"):
            best, s, flag = m.decode(m.outputs(part.column("text")))
            ok = part.column(letter).to_numpy(zero_copy_only=False).astype(bool) & bool(m.langs)
            found = names.take(pa.array(np.where(ok, best, len(m.langs))))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], found, pa.array(np.where(ok, s, 0.0)), pa.array(flag & ok)], [*part.schema.names[:-1], lang, score, unsure])

    marked = docs.withColumn(letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInArrow(scan, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, `{lang}` string, `{score}` double, `{unsure}` boolean")


def op12_language_id(spark: SparkSession, sf_dir: str, sample_rows: int = 6_000) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = predict(docs.select("doc_id", "text"), fit(docs, sample_rows))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
