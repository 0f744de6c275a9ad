"""Toxicity: bags of subwords, embedded, averaged and sent through a linear softmax, trained jointly in numpy.

A bag is one word: its character n-grams (3 to 6 bytes, with marks for the word's ends) index a table of embeddings, the
embeddings are averaged, and a linear softmax gives the bag's class.  A word never seen, such as a misspelling, has most of
its n-grams in common with words seen.  A document is as toxic as its most toxic bag, so a few words in a very long text
count as much as in a short one; embeddings and softmax are trained together on documents through that maximum.

Only labelled rows whose crc32(doc_id as text) mod 5 is not 0 are learnt from, at most ``sample_rows`` of them (those least
by md5 of the id) and no more than have ``sample_bytes`` of distinct words together.  Scoring is the same for every row and every size.  A linear softmax of an average is an average of one
number for each n-gram, so scoring looks up one number for each.

Defined results: null and empty texts and texts without words get the score of an empty bag, which is below 0.5; rows with a
null doc_id are scored and not held out; repeated rows are scored alike, and one of each id is learnt from; without labels of both kinds every score is that of
an empty bag; extra columns pass through :func:`drop_toxic`; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import textscan as S
from .shared import written

U = np.uint64
LEAST, MOST = 3, 6
BITS = 18
GAP = S.SPACE.copy()
GAP[list(b'.,;:!?"()[]{}|')] = True
#: A worker's table of scored words is emptied beyond so many; it is a cache only.
MOST_WORDS = 500_000
#: Training runs in the driver, so it works on so many words and documents at a time.
TRAIN_WORDS, TRAIN_DOCS = 1 << 12, 128


def means(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean of each segment; 0 for an empty one."""
    out = np.zeros(len(starts) - 1)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        out[full] = np.add.reduceat(values, starts[:-1][full], dtype=np.float64) / np.diff(starts)[full]
    return out


class Model:
    """weights: one number for each n-gram bucket (embeddings times the softmax's difference); bias; floor."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)
        self.keys, self.scores = np.zeros(0, U), np.zeros(0)

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def column(self, col: pa.Array) -> np.ndarray:
        """The largest bag's logit of each text."""
        buf, offs = S.raw(col)
        buf = S.LOWER[buf]
        starts, ends = S.runs(~GAP[buf], offs)
        out = np.full(len(offs) - 1, self.bias)
        if not len(starts):
            return out
        h = S.hash_spans(buf, starts, ends)
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            if len(self.keys) + (~known).sum() > MOST_WORDS:
                self.keys, self.scores, known = np.zeros(0, U), np.zeros(0), np.zeros(len(keys), bool)
            new = first[~known]
            grams, begin = S.ngrams(buf, starts[new], ends[new], LEAST, MOST, BITS)
            self.keys = np.concatenate([self.keys, keys[~known]])
            self.scores = np.concatenate([self.scores, self.bias + means(self.weights[grams], begin)])
            order = np.argsort(self.keys)
            self.keys, self.scores = self.keys[order], self.scores[order]
            at = np.searchsorted(self.keys, keys)
        logit = self.scores[at][back]
        owner = S.owners(starts, offs)
        begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out[owner[begin]] = np.maximum.reduceat(logit, begin)
        return out


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int, sample_bytes: int) -> pa.Table:
    """toxic and the distinct words of at most ``sample_rows`` labelled documents outside the held-out fold; of these the first, by
    md5 of the id, whose words take ``sample_bytes`` bytes together."""
    by = F.md5(F.col("doc_id").cast("string"))
    sample = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = sample.where(~held_out(F.col("doc_id"))).orderBy(by, "doc_id").limit(sample_rows)

    def distinct(batches):
        for part in S.blocks(batches, "text"):
            buf, offs = S.raw(part.column("text"))
            buf = S.LOWER[buf]
            starts, ends = S.runs(~GAP[buf], offs)
            owner = S.owners(starts, offs)
            h = S.hash_spans(buf, starts, ends)
            order = np.lexsort((h, owner))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
            rows = [[] for _ in range(len(offs) - 1)]
            data = buf.tobytes()
            for k in order[fresh].tolist():
                rows[owner[k]].append(data[starts[k] : ends[k]])
            yield pa.RecordBatch.from_arrays([part.column("turn"), part.column("toxic"), pa.array([b" ".join(r) for r in rows], pa.binary())], ["turn", "toxic", "words"])

    # the sample has at most sample_rows rows of two numbers, so it may be broadcast
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").select(by.alias("turn"), F.col("toxic").cast("int").alias("toxic"), "text")
    made = rows.mapInArrow(distinct, "turn string, toxic int, words binary").groupBy("turn").agg(F.min(F.struct("words", "toxic")).alias("m"))  # one row of each id
    made = written(made.select("turn", "m.toxic", "m.words"), "training-words")
    sizes = made.select("turn", F.octet_length("words").cast("bigint").alias("n")).toArrow()  # at most sample_rows ids of documents
    turns, n = np.array(sizes.column("turn").to_pylist(), object), sizes.column("n").to_numpy()
    order = np.argsort(turns, kind="stable")
    within = np.cumsum(n[order]) <= sample_bytes
    last = turns[order][within][-1] if within.any() else ""
    return made.where(F.col("turn") <= last).orderBy("turn").select("toxic", "words").toArrow()  # at most sample_bytes


class Bags:
    """The words of the training documents, for the driver's memory in few and narrow numbers.

    ``grams`` and ``begin``: the buckets of each distinct word, end to end.  ``word`` and ``edges``: the words of each document that has
    any, end to end; ``have``: which documents these are.  All that is worked out over them is worked out slice by slice.
    """

    def __init__(self, table: pa.Table):
        keys, ids = np.zeros(0, U), np.zeros(0, np.int32)  # hashes of the words so far, in order, and their numbers
        grams, lens, word, counts = [], [], [], []
        for batch in table.to_batches(max_chunksize=200):
            buf, offs = S.raw(batch.column("words"))
            starts, ends = S.runs(~GAP[buf], offs)
            counts.append(np.bincount(S.owners(starts, offs), minlength=batch.num_rows))
            for i in range(0, len(starts), TRAIN_WORDS):
                part = slice(starts[i], ends[min(len(ends), i + TRAIN_WORDS) - 1])
                begin, end = starts[i : i + TRAIN_WORDS] - part.start, ends[i : i + TRAIN_WORDS] - part.start
                h = S.hash_spans(buf[part], begin, end)
                new, first = np.unique(h, return_index=True)
                at = np.searchsorted(keys, new)
                fresh = keys[np.minimum(at, len(keys) - 1)] != new if len(keys) else np.ones(len(new), bool)
                g, b = S.ngrams(buf[part], begin[first[fresh]], end[first[fresh]], LEAST, MOST, BITS)
                numbers = np.arange(len(ids), len(ids) + fresh.sum(), dtype=np.int32)
                keys, ids = np.insert(keys, at[fresh], new[fresh]), np.insert(ids, at[fresh], numbers)
                grams.append(g)
                lens.append(np.diff(b))
                word.append(ids[np.searchsorted(keys, h)])
        counts = np.concatenate(counts)
        self.have = np.flatnonzero(counts)
        self.edges = S.segments(counts[self.have])
        if not len(self.have):
            return
        self.begin, self.word = S.segments(np.concatenate(lens)), np.concatenate(word)
        self.grams = np.empty(self.begin[-1], np.int32)
        del lens, word, keys, ids
        at = len(self.grams)
        while grams:  # each piece goes as soon as it is in its place
            g = grams.pop()
            self.grams[at - len(g) : at] = g
            at -= len(g)
        S.give_back()

    def word_slices(self):
        n = len(self.begin) - 1
        return [(a, min(n, a + TRAIN_WORDS)) for a in range(0, n, TRAIN_WORDS)]

    def documents(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents, and toxic documents, that each word is in."""
        n = len(self.begin) - 1
        toxic = np.repeat(y[self.have] == 1, np.diff(self.edges))
        return np.bincount(self.word, minlength=n), np.bincount(self.word[toxic], minlength=n).astype(float)

    def strongest(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each document's largest mean of a word's weights, and the first word that has it."""
        score = np.concatenate([means(weights[self.grams[self.begin[a] : self.begin[z]]], self.begin[a : z + 1] - self.begin[a]) for a, z in self.word_slices()])
        top, picked = np.zeros(len(self.have)), np.zeros(len(self.have), np.int64)
        for a in range(0, len(self.have), TRAIN_DOCS):
            z = min(len(self.have), a + TRAIN_DOCS)
            word = self.word[self.edges[a] : self.edges[z]]
            logit, begin = score[word], self.edges[a:z] - self.edges[a]
            top[a:z] = np.maximum.reduceat(logit, begin)
            at = np.flatnonzero(logit == np.repeat(top[a:z], np.diff(self.edges[a : z + 1])))
            picked[a:z] = word[at[np.searchsorted(at, begin)]]
        return top, picked


def train(table: pa.Table, dims: int = 8, epochs: int = 40, rate: float = 0.3, prior: float = 5.0) -> Model:
    """Embeddings and softmax, jointly, through each document's strongest bag.

    The first embedding coordinate starts as the shrunken log-odds of an n-gram's documents, the others at random small
    values, which tells the maximum where to look first.
    """
    y = table.column("toxic").to_numpy().astype(np.int64)
    none = Model(np.zeros(1 << BITS), -4.0)
    if not len(y) or not 0 < y.sum() < len(y):
        return none
    bags = Bags(table)
    if not len(bags.have):
        return none
    del table
    seen_in, toxic_in = bags.documents(y)
    # documents of an n-gram, counted by its words
    n, t = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for a, z in bags.word_slices():
        part, lens = bags.grams[bags.begin[a] : bags.begin[z]], np.diff(bags.begin[a : z + 1])
        n += np.bincount(part, weights=np.repeat(seen_in[a:z], lens), minlength=1 << BITS)
        t += np.bincount(part, weights=np.repeat(toxic_in[a:z], lens), minlength=1 << BITS)
    share = toxic_in.sum() / max(1, seen_in.sum())
    odds = np.log((t + prior * share) / (prior * share)) - np.log((n - t + prior * (1 - share)) / (prior * (1 - share)))
    rng = np.random.Generator(np.random.PCG64(7))
    emb = rng.normal(0, 0.01, (1 << BITS, dims))
    emb[:, 0] = odds
    del n, t, odds, seen_in, toxic_in
    soft = rng.normal(0, 0.01, (dims, 2))
    soft[0] = (-0.5, 0.5)
    bias = np.zeros(2)
    weight = np.where(y == 1, 0.5 * len(y) / max(1, y.sum()), 0.5 * len(y) / max(1, len(y) - y.sum()))
    weight /= weight.sum()
    have, grams, begin = bags.have, bags.grams, bags.begin
    squares = [np.full_like(x, 1e-6) for x in (soft, bias)]
    # an n-gram's squares are kept from its first pull on: few are ever in a strongest bag
    slot, emb_squares = np.full(1 << BITS, -1, np.int32), np.zeros((0, dims))
    top, _ = bags.strongest((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32))
    bias[1] = -_best_cut(top, y[have], weight[have])  # where the first maxima split best
    for _ in range(epochs):
        diff = soft[:, 1] - soft[:, 0]
        top, picked = bags.strongest((emb @ diff).astype(np.float32))
        p = 1 / (1 + np.exp(-(top + bias[1] - bias[0])))
        err = (p - y[have]) * weight[have]
        err[np.abs(p - y[have]) < 0.02] = 0
        lens = begin[picked + 1] - begin[picked]
        flat = grams[np.arange(lens.sum()) + np.repeat(begin[picked] - (np.cumsum(lens) - lens), lens)]
        per = np.repeat(err / np.maximum(1, lens), lens)
        who = np.repeat(np.arange(len(picked)), lens)
        means_of = np.zeros((len(picked), dims))
        np.add.at(means_of, who, emb[flat] / np.maximum(1, lens)[who, None])
        g_soft = np.stack([-(err @ means_of), err @ means_of], 1)
        g_bias = np.array([-err.sum(), err.sum()])
        pull = np.bincount(flat, weights=per, minlength=1 << BITS)
        live = np.flatnonzero(pull)
        g_emb = pull[live, None] * diff
        new = live[slot[live] < 0]
        slot[new] = np.arange(len(emb_squares), len(emb_squares) + len(new))
        emb_squares = np.concatenate([emb_squares, np.full((len(new), dims), 1e-6)])
        emb_squares[slot[live]] += g_emb**2
        emb[live] -= rate * g_emb / np.sqrt(emb_squares[slot[live]])
        for x, g, s in ((soft, g_soft, squares[0]), (bias, g_bias, squares[1])):
            s += g**2
            x -= 0.1 * rate * g / np.sqrt(s)
    weights = (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
    top, _ = bags.strongest(weights)
    return Model(weights, min(-_best_cut(top, y[have], weight[have]), -0.1))


def _best_cut(top: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the widest-margin threshold that loses least weight."""
    order = np.argsort(top)
    t, w = top[order], np.where(y[order] == 1, weight[order], -weight[order])
    loss = np.concatenate([[0.0], np.cumsum(w)])  # lost if the first k are called clean, up to a constant
    k = np.flatnonzero(loss <= loss.min() + 1e-12)
    lo, hi = k.min(), k.max()
    low = t[max(0, lo - 1)]
    high = t[min(len(t) - 1, hi)]
    return float((low + high) / 2)


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold that is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers
    name = "score"
    while name in docs.columns:
        name += "_"

    def scan(batches):
        m = sent.value
        for part in S.blocks(batches, "text"):
            s = 1 / (1 + np.exp(-m.column(part.column("text"))))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], [*part.schema.names, name])

    return docs.mapInArrow(scan, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, `{name}` double")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 5_000, sample_bytes: int = 16 << 20) -> Model:
    try:
        return train(training_rows(docs, labels, sample_rows, sample_bytes))
    finally:
        S.give_back()  # the driver has other stages to run


def drop_toxic(docs: DataFrame, model: Model, cut: float = 0.5) -> DataFrame:
    """The rows that score below ``cut``, with their own columns."""
    scored = score_texts(docs, model)
    return scored.where(F.col(scored.columns[-1]) < cut).select(*docs.columns)


def op5_toxicity(spark: SparkSession, sf_dir: str, sample_rows: int = 5_000) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), sample_rows)
    out = score_texts(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
