"""N-gram Jaccard join with set-relation skipping.

A document's set holds its distinct 5-word shingles as 64-bit hashes.  Two sets link when intersection/union >= 3/4; the
result is every document's set size and its class of linked documents.  The join is exact: no sampling, no caps on lists.

1. *Equal sets* are one set from then on (its id is a hash of size and members; the members of a class meet only as counts).
   Every text is shingled once; later steps read the sets.
2. *Order.*  A pair that links shares a shingle among the first ``n - ceil(3n/4) + 1`` of each set, in any one order of
   shingles.  The order here is by hash, but the most frequent shingles (of a count over all sets, a table of at most
   ``heavy_most`` rows) come last, the more frequent the later, so a passage that many documents share is in no prefix unless
   it makes up the text.
3. *Index lists.*  Prefix entries (shingle, set, size, position) are dealt out by shingle, those of a very frequent shingle by
   the set, too.  Each block of like sizes in a list has a leader, the set with the foremost position, with which the sets of
   its block and of the next larger one are paired (a list of k sets gives fewer than 2k pairs) where sizes and positions leave
   room for the overlap needed.  Pairs that share a good part of the prefix shingles that a link takes are compared.
4. *Families.*  A compared pair's exact difference is kept.  Each set belongs to the family of one leader that it is similar to;
   a set whose lists mostly answer to another family's leader is compared with that one, too, so families grow together.
5. *Answers from a similar set's answers.*  Within a family no pair is compared on whole sets.  For sets S and T of leader M,
   ``|S & T| = |M| - lost(S) - lost(T) + |diff(S) & diff(T)|``, with diff(S) the symmetric difference of S and M and lost(S)
   what S lacks of M.  So a link takes ``r = need - |M| + lost(S) + lost(T)`` common differences.  Pairs with r <= 0 link for
   sure, and all of them with the family's set of least ``3n + 7 lost``, which alone is emitted.  The others are found by a
   prefix join of the differences, the family's rarest first; differences that one set or one class alone has are in no list.
   The copies of a text differ from it in places of their own, so these lists are short however large the family.
6. *Skipping in lists.*  What families don't cover are pairs of sets of different families and classes in one list.  The
   list's entries lie in blocks by size, class and family, sorted by position; a set skips the blocks of its class and
   family, and of every other block takes only the run of positions that leaves room for the overlap needed.  A list longer
   than ``per_task`` is dealt out as a grid of parts.  A pair is compared if it shares ``ceil(3(n+m)/7) - max(n - prefix, m -
   prefix)`` prefix shingles at least.
7. Classes are the connected components of all links.

Defined results: null and empty texts, and texts without words, have size 0 and are linked with nothing; fewer than 5 words
are one shingle; equal texts under different ids are one class; a repeated doc_id keeps all its rows; the class of rows with a
null doc_id is the least id of the others in it, or null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import textscan as S
from .components import components
from .shared import Scratch, partitions_for, written

U = np.uint64
#: J >= NUM / DEN.
NUM, DEN = 3, 4
#: A pair of a leader and another set is compared early if it shares so many times less prefix shingles than a link takes; what
#: isn't compared early stays open for the last, exact round.
LIKELY = 3
#: Links and answers (a row for each set that takes part) are broadcast up to so many, and joined by a shuffle beyond.
BROADCAST_SETS = 200_000
#: Most parts into which the entries of one shingle are dealt by the set while lists are made.
MOST_SALTS = 4096
#: Least sizes of the blocks of like sizes: sets that can link lie in one block or in two neighbours.
BLOCKS = [1]
while BLOCKS[-1] < 1 << 40:
    BLOCKS.append(BLOCKS[-1] * DEN // NUM + 1)
BLOCKS = np.array(BLOCKS, np.int64)

#: How tables of hashes are written: in small row groups, for their bytes neither repeat nor shrink.
HASHES = {"parquet.block.size": 16 << 20, "parquet.enable.dictionary": "false", "compression": "uncompressed"}

Keep = Callable[..., DataFrame]


def shingle_sets(part: pa.RecordBatch, column: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where each text's begin."""
    buf, offs = S.raw(part.column(column))
    buf = S.LOWER[buf]
    starts, ends, owner = S.words(buf, offs)
    h = S.hash_spans(buf, starts, ends)
    n = len(offs) - 1
    grams, first = S.windows(h, owner, size)
    who = owner[first]
    count = np.bincount(owner, minlength=n)
    for i in np.flatnonzero((count > 0) & (count < size)):  # the whole sequence as one
        a, z = np.searchsorted(owner, [i, i + 1])
        x = np.full(1, int(z - a) * 0xD1B54A32D192ED03 % 2**64, U)
        for k in range(a, z):
            x = S.mix(x + h[k : k + 1] * U(0x8CB92BA72F3D8DD7))
        grams, who = np.append(grams, x), np.append(who, i)
    if len(who) and (np.diff(who) < 0).any():
        order = np.argsort(who, kind="stable")
        grams, who = grams[order], who[order]
    cuts = np.searchsorted(who, np.arange(n + 1)).tolist()
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        grams[a:z].sort()
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (who[1:] != who[:-1])
    grams, who = grams[fresh], who[fresh]
    return grams, np.searchsorted(who, np.arange(n + 1))


def set_ids(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One 64-bit id for each set: the same for equal sets, whatever document they come from."""
    sums = np.zeros(len(grams) + 1, U)
    np.cumsum(S.mix(grams ^ U(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
    more = np.zeros(len(grams) + 1, U)
    np.cumsum(S.mix(grams + U(0x5851F42D4C957F2D)) | U(1), out=more[1:])
    a, z = starts[:-1], starts[1:]
    return S.mix(sums[z] - sums[a] + S.mix(more[z] - more[a] + (z - a).astype(U)))


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (NUM * n + DEN - 1) // DEN + 1


def overlap_needed(n, m):
    """Least intersection for which n and m sized sets link."""
    return -(-NUM * (n + m) // (NUM + DEN))


def size_block(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(BLOCKS, n, "right") - 1


class Seen:
    """Ids met lately in this task, so that copies aren't sent again and again; bounded, for it only saves work."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.ids = most, set()

    def fresh(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), bool)
        for k, i in enumerate(ids.tolist()):
            if i not in self.ids:
                out[k] = True
                self.ids.add(i)
        if len(self.ids) > self.most:
            self.ids.clear()
        return out


def document_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_id, members (sorted 64-bit hashes, little-endian) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        for part in S.blocks(batches, "text"):
            grams, starts = shingle_sets(part, "text", size)
            data, cuts = grams.astype("<u8").tobytes(), (8 * starts).tolist()
            members = pa.array([data[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(starts)), pa.array(S.signed(set_ids(grams, starts))), members], ["doc_id", "n_shingles", "set_id", "members"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(scan, f"doc_id {kind}, n_shingles bigint, set_id bigint, members binary")


def fresh_sets(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the sets not met lately, block by block: members end to end, where each set's begin, ids.  batches: set_id, members."""
    seen = Seen()
    for part in S.blocks(batches, "members", 2 << 20):
        data, offs = S.raw(part.column("members"))
        grams, starts = np.frombuffer(data.tobytes(), "<u8"), offs // 8
        ids = part.column("set_id").to_numpy().view(U)
        fresh = seen.fresh(ids)
        yield grams[np.repeat(fresh, np.diff(starts))], S.segments(np.diff(starts)[fresh]), ids[fresh]


def by_bucket(batches, names: list[str]) -> Iterator[tuple[int, list]]:
    """From rows sorted by bucket, each bucket with the lists of its rows' values."""
    now, held = None, []
    for b in batches:
        cols = [b.column(n).to_pylist() for n in names]
        for k, bucket in enumerate(b.column("bucket").to_pylist()):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append([c[k] for c in cols])
    if held:
        yield now, held
        del held
    S.give_back()


class Heavy:
    """The most frequent shingles: sorted hashes cut to ``64 - shift + 32`` bits, and the level (eighths of a doubling) of each."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray, shift: int):
        self.keys, self.levels, self.shift = keys, levels, shift

    def level(self, grams: np.ndarray) -> np.ndarray:
        """Level of each shingle; 0 for those that aren't frequent."""
        if not len(self.keys):
            return np.zeros(len(grams), np.int64)
        key = grams >> U(self.shift - 32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.levels[at], 0)


def short_key(grams: np.ndarray, shift: int) -> np.ndarray:
    """The 32 bits below the bucket's."""
    return ((grams >> U(shift - 32)) & U(0xFFFFFFFF)).astype("<u4")


def heavy_shingles(sets: DataFrame, total: int, least: int, most: int, keep: Keep) -> Heavy:
    """The ``most`` most frequent shingles that at least ``least`` sets have, by a count over all sets (32 bits of each hash
    within its bucket are compared: what they merge by chance only changes the order).  At most ``most`` of them."""
    n_buckets = 1 << max(3, (total // 2_000_000).bit_length())
    shift = 64 - n_buckets.bit_length() + 1

    def gathered(batches, most: int = 1_000_000):
        held, n = [], 0
        for grams, _, _ in fresh_sets(batches):
            held.append(grams)
            n += len(grams)
            if n >= most:
                yield np.concatenate(held)
                held, n = [], 0
        if n:
            yield np.concatenate(held)

    def scan(batches):
        for grams in gathered(batches):
            grams, count = np.unique(grams, return_counts=True)
            edges = np.searchsorted(grams >> U(shift), np.arange(n_buckets + 1, dtype=U))
            rows = {"bucket": [], "keys": [], "many": [], "count": []}
            for b in np.flatnonzero(np.diff(edges)):
                g, c = grams[edges[b] : edges[b + 1]], count[edges[b] : edges[b + 1]]
                many = np.flatnonzero(c > 1)
                rows["bucket"].append(int(b))
                rows["keys"].append(short_key(g, shift).tobytes())
                rows["many"].append(many.astype("<u4").tobytes())
                rows["count"].append(c[many].astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("many", pa.binary()), ("count", pa.binary())]))

    def count(batches):
        for bucket, rows in by_bucket(batches, ["keys", "many", "count"]):
            keys, counts = [], []
            for k, m, c in rows:
                k, m, c = (np.frombuffer(x, "<u4") for x in (k, m, c))
                n = np.ones(len(k), np.int64)
                n[m] = c
                keys.append(k)
                counts.append(n)
            keys, counts = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sums = np.add.reduceat(counts, at)
            wanted = sums >= least
            full = (U(bucket) << U(32)) | keys[at][wanted].astype(U)
            yield pa.RecordBatch.from_arrays([pa.array(S.signed(full)), pa.array(sums[wanted])], ["shingle", "sets"])

    sent = sets.select("set_id", "members").mapInArrow(scan, "bucket bigint, keys binary, many binary, count binary")
    met = sent.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "shingle bigint, sets bigint")
    met = keep(met.withColumn("level", F.floor(8 * F.log2("sets")).cast("int")), "frequent")
    cut, held = 0, 0
    for r in met.groupBy("level").count().orderBy(F.col("level").desc()).collect():  # a row for each eighth of a doubling
        held += r["count"]
        cut = r.level if held <= most else cut
        if held > most:
            break
    top = met.where(F.col("level") >= cut) if held <= most or cut else met.limit(0)
    top = top.select("shingle", "level").toArrow()  # at most ``most`` rows
    keys = top.column("shingle").to_numpy().view(U)
    order = np.argsort(keys)
    return Heavy(keys[order], top.column("level").to_numpy().astype(np.uint16)[order], shift)


def salts_of(level: np.ndarray, together: int) -> np.ndarray:
    """Into how many parts the entries of a shingle of this level are dealt, so that about ``together`` of them meet."""
    return np.clip(np.ceil(2 ** ((level + 1) / 8) / together), 1, MOST_SALTS - 1).astype(np.int64)


def index_lists(sets: DataFrame, total: int, heavy: Heavy, together: int) -> DataFrame:
    """Entries of the index lists (own true): list, set_id, n, pos, rest (what the prefix leaves out), with the leader of the
    entry's block of sizes: leader, leader_n, leader_pos, leader_rest; and (own false) entries with the leader of the next
    smaller block.  A leader is the set with the fewest rarer shingles before the list's, so the one in the middle of a group of
    near copies; of several the one with the least hash.  Sets that are alone in their list give no rows.  A list dealt out in parts
    has leaders in each part."""
    n_buckets = 1 << max(3, (total // 1_000_000).bit_length())
    own = 64 - n_buckets.bit_length() + 1
    sent_heavy = sets.sparkSession.sparkContext.broadcast(heavy)  # at most heavy_most numbers and levels

    def prefixes(batches, most: int = 300_000):
        """Prefix entries of many sets: shingle, its level, number of the set, position; ids, sizes, prefixes of the sets."""
        heavy = sent_heavy.value
        held, count, m = [], 0, 0
        for grams, starts, ids in fresh_sets(batches):
            n = np.diff(starts)
            who = np.repeat(np.arange(len(n)), n)
            level = heavy.level(grams)
            if level.any():  # within a level by hash
                order = np.argsort(who * (1 << 12) + level, kind="stable")
                grams, who, level = grams[order], who[order], level[order]
            pos = np.arange(len(who)) - starts[who]
            taken = prefix_length(n)
            inside = pos < taken[who]
            held.append((grams[inside], level[inside], who[inside] + count, pos[inside], ids, n, taken))
            count, m = count + len(n), m + int(inside.sum())
            if m >= most:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, count, m = [], 0, 0
        if m:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    def scan(batches):
        for grams, level, who, pos, ids, n, taken in prefixes(batches):
            bucket = (grams >> U(own)).astype(np.int64) * MOST_SALTS
            salts = salts_of(level, together)
            if (salts > 1).any():  # part 0 of a bucket has the lists that are whole
                bucket += np.where(salts > 1, 1 + (ids[who] % salts.astype(U)).astype(np.int64), 0)
            order = np.argsort(bucket, kind="stable")
            grams, who, pos, bucket = grams[order], who[order], pos[order], bucket[order]
            edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            rows = {k: [] for k in ("bucket", "keys", "who", "pos", "ids", "sizes", "taken")}
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                local, back = np.unique(who[a:z], return_inverse=True)
                rows["bucket"].append(int(bucket[a]))
                rows["keys"].append(short_key(grams[a:z], own).tobytes())
                rows["who"].append(back.astype("<u2" if len(local) < 65536 else "<u4").tobytes())
                rows["pos"].append(pos[a:z].astype("<u4").tobytes())
                rows["ids"].append(ids[local].tobytes())
                rows["sizes"].append(n[local].astype("<u4").tobytes())
                rows["taken"].append(taken[local].astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("bucket", pa.int64()), *[(k, pa.binary()) for k in ("keys", "who", "pos", "ids", "sizes", "taken")]]))

    def lists(batches):
        for bucket, rows in by_bucket(batches, ["keys", "who", "pos", "ids", "sizes", "taken"]):
            keys, ids, n, pos, taken = [], [], [], [], []
            for k, w, p, i, s, t in rows:
                k, i, s, t = np.frombuffer(k, "<u4"), np.frombuffer(i, "<u8"), np.frombuffer(s, "<u4"), np.frombuffer(t, "<u4")
                w = np.frombuffer(w, "<u2" if len(w) == 2 * len(k) else "<u4")
                keys.append(k)
                ids.append(i[w])
                n.append(s[w])
                taken.append(t[w])
                pos.append(np.frombuffer(p, "<u4"))
            keys, ids, n, pos, taken = (np.concatenate(x) for x in (keys, ids, n, pos, taken))
            least = 2 if bucket % MOST_SALTS == 0 else 1  # a set alone in a part has others in other parts
            order = np.argsort(keys, kind="stable")
            sorted_keys = keys[order]
            same = np.full(len(keys), least == 1)
            same[1:] |= sorted_keys[1:] == sorted_keys[:-1]
            same[:-1] |= same[1:]
            order = order[same]
            order = order[np.lexsort((ids[order], keys[order]))]
            fresh = np.ones(len(order), bool)  # one set sent by several tasks
            fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (ids[order][1:] != ids[order][:-1])
            order = order[fresh]
            yield from led(bucket // MOST_SALTS, least, keys[order], ids[order], n[order].astype(np.int64), pos[order].astype(np.int64), (n - taken)[order].astype(np.int64))

    def led(bucket, least, keys, ids, n, pos, rest, step: int = 100_000):
        block = size_block(n)
        order = np.lexsort((S.mix(ids), pos, block, keys))
        keys, ids, n, pos, rest, block = (x[order] for x in (keys, ids, n, pos, rest, block))
        group = keys.astype(np.int64) * 256 + block
        at = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        lead = np.repeat(at, np.diff(np.append(at, len(group))))
        _, back, in_list = np.unique(keys, return_inverse=True, return_counts=True)
        kept = np.flatnonzero(in_list[back] >= least) if len(keys) else at
        below = np.searchsorted(group[at], group[kept] - 1)  # the group of the block before, if the list has it
        there = np.flatnonzero((below < len(at)) & (group[at][np.minimum(below, len(at) - 1)] == group[kept] - 1)) if len(kept) else kept
        for rows, leaders, mine in ((kept, lead[kept], True), (kept[there], at[below[there]] if len(there) else there, False)):
            name = (U(bucket) << U(32)) | keys[rows].astype(U)
            for a in range(0, len(rows), step):
                i, j = rows[a : a + step], leaders[a : a + step]
                cols = [S.signed(name[a : a + step]), S.signed(ids[i]), n[i], pos[i], rest[i], S.signed(ids[j]), n[j], pos[j], rest[j], np.full(len(i), mine)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["list", "set_id", "n", "pos", "rest", "leader", "leader_n", "leader_pos", "leader_rest", "own"])

    sent = sets.select("set_id", "members").mapInArrow(scan, "bucket bigint, keys binary, who binary, pos binary, ids binary, sizes binary, taken binary")
    met = sent.repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(lists, "list bigint, set_id bigint, n bigint, pos bigint, rest bigint, leader bigint, leader_n bigint, leader_pos bigint, leader_rest bigint, own boolean")


def reachable(n, m, i, j):
    """Whether sizes n, m and positions i, j of a shared shingle leave room for the overlap needed."""
    return F.least(i, j) + F.least(n - i, m - j) >= F.ceil((n + m) * F.lit(NUM) / F.lit(NUM + DEN))


def shared_needed(n, m, rest):
    """Least number of shingles in both prefixes for which sizes n and m can link: a shared shingle beyond the prefix that
    ends first lies beyond it in that set, too.  rest: the larger number of shingles that either prefix leaves out."""
    return F.greatest(F.lit(1), F.ceil((n + m) * F.lit(NUM) / F.lit(NUM + DEN)) - rest)


def small(df: DataFrame) -> DataFrame:
    """A written table as one side of a join: broadcast if its size, counted here, is within BROADCAST_SETS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_SETS else df


def compared(pairs: DataFrame, sets: DataFrame, reps: DataFrame, keep: Keep) -> DataFrame:
    """a, b, a_n, b_n, shared of each pair (a, b: set ids), by intersecting whole sets, read from one document of each; and
    ``diff``, the members that only one of them has, where they share half of the larger one at least."""
    pairs = keep(pairs.select("a", "b"), "pairs")
    wanted = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    owners = small(keep(reps.join(wanted, "set_id").select(F.col("set_id").alias("w"), F.col("doc_id").alias("d")), "owners"))
    made = sets.select("doc_id", "set_id", "members").join(owners, (F.col("set_id") == F.col("w")) & F.col("doc_id").eqNullSafe(F.col("d")))
    made = keep(made.select("set_id", "members").dropDuplicates(["set_id"]), "sets", **HASHES)
    both = pairs.join(made.select(F.col("set_id").alias("a"), F.col("members").alias("x")), "a").join(made.select(F.col("set_id").alias("b"), F.col("members").alias("y")), "b")

    def meet(batches):
        for part in batches:
            shared, n, m, diff = [], [], [], []
            for x, y in zip(part.column("x"), part.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                in_y = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
                k = int(in_y.sum())
                shared.append(k)
                n.append(len(x))
                m.append(len(y))
                diff.append(np.setxor1d(x, y, assume_unique=True).view(np.int64) if 2 * k >= max(len(x), len(y)) else None)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), *[pa.array(c, pa.int64()) for c in (n, m, shared)], pa.array(diff, pa.list_(pa.int64()))], ["a", "b", "a_n", "b_n", "shared", "diff"])

    return keep(both.select("a", "b", "x", "y").mapInArrow(meet, "a bigint, b bigint, a_n bigint, b_n bigint, shared bigint, diff array<bigint>"), "compared")


def linked(pairs: DataFrame) -> DataFrame:
    return pairs.where((F.lit(NUM + DEN) * F.col("shared") >= F.lit(NUM) * (F.col("a_n") + F.col("b_n"))))


def merged(comps: DataFrame | None, links: DataFrame, keep: Keep) -> DataFrame:
    """node, component by earlier components and further links (a, b)."""
    links = links.select("a", "b")
    if comps is not None:
        links = links.unionByName(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b"))
    return keep(components(links, keep), "components")


def families(known: DataFrame, keep: Keep) -> DataFrame:
    """The one leader whose family each compared set belongs to: set_id, leader, leader_n, n, lost (what the set lacks of the
    leader), diff.  A leader is in its own, too; of several leaders the one with most sets is taken, for then most pairs of sets
    have one in common."""
    like = known.where("diff is not null").select("a", "b", "a_n", "b_n", "shared", "diff")
    own = like.select("a", "a_n").distinct().select("a", F.col("a").alias("b"), "a_n", F.col("a_n").alias("b_n"), F.col("a_n").alias("shared"), F.array().cast("array<bigint>").alias("diff"))
    members = small(keep(like.groupBy("a").agg(F.count("*").alias("members")), "members"))
    both = like.unionByName(own)
    best = both.select("a", "b").join(members, "a").groupBy("b").agg(F.max(F.struct("members", "a")).alias("m")).select("b", F.col("m.a").alias("a"))
    return keep(both.join(best, ["a", "b"]).select(F.col("b").alias("set_id"), F.col("a").alias("leader"), F.col("a_n").alias("leader_n"), F.col("b_n").alias("n"), (F.col("a_n") - F.col("shared")).alias("lost"), "diff"), "families")


def hub_pairs(entries: DataFrame, known: DataFrame) -> DataFrame:
    """a, b: each set (b) with the leader (a) to whose family most sets of most of its lists belong, where that is another
    family than its own, the two weren't compared, and they may share enough of their lists."""
    few = F.greatest(F.lit(1), F.ceil(2 * F.col("n") * F.lit(NUM) / F.lit(NUM + DEN)) - F.col("rest"))
    led = entries.where(F.col("leader").isNotNull()).groupBy("list", "leader").agg(F.count("*").alias("k"))
    hubs = led.groupBy("list").agg(F.max(F.struct("k", "leader")).alias("m")).where("m.k > 1").select("list", F.col("m.leader").alias("hub"))
    other = entries.where(F.col("listed") >= few).select("list", "set_id", "leader", few.alias("few"))
    met = other.join(hubs, "list").where(~F.col("hub").eqNullSafe(F.col("leader")) & (F.col("hub") != F.col("set_id")))
    met = met.groupBy("set_id", "hub").agg(F.count("*").alias("k"), F.min("few").alias("few")).where(2 * F.col("k") >= F.col("few"))
    found = met.groupBy("set_id").agg(F.max(F.struct("k", "hub")).alias("m")).select(F.col("m.hub").alias("a"), F.col("set_id").alias("b"))
    return found.join(known.select("a", "b"), ["a", "b"], "left_anti").join(known.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")


def sevenths(x: Column) -> Column:
    """x / (NUM + DEN), rounded up."""
    return F.ceil(x / F.lit(NUM + DEN)).cast("bigint")


def family_links(family: DataFrame, comps: DataFrame, keep: Keep) -> DataFrame:
    """a, b: links that join classes within families, from the sets' differences to their leaders alone (see the module's step
    5).  Every two sets of one family that link are in one class by comps and these links."""
    c = small(keep(comps.select(F.col("node").alias("set_id"), "component"), "family-components"))
    f = family.join(c, "set_id", "left").withColumn("comp", F.coalesce("component", "set_id"))
    f = f.select("leader", "leader_n", "set_id", "comp", (NUM * F.col("n") + (NUM + DEN) * F.col("lost")).alias("w"), F.size("diff").cast("bigint").alias("d"), "diff")
    f = keep(f, "family-sets")
    least = keep(f.groupBy("leader", "comp").agg(F.min(F.struct("w", "set_id")).alias("m")), "least-of-class")
    first = least.groupBy("leader").agg(F.min(F.struct("m.w", "comp", "m.set_id")).alias("x"))
    # families of more than one class, with their set of least w and the least w of the other classes
    two = least.join(first, "leader").where(F.col("comp") != F.col("x.comp")).groupBy("leader").agg(F.min("m.w").alias("w2"), F.first("x").alias("x"))
    tops = small(keep(two.select("leader", F.col("x.w").alias("w1"), F.col("x.comp").alias("comp1"), F.col("x.set_id").alias("set1"), "w2"), "open-families"))
    f = keep(f.join(tops, "leader"), "open-sets")
    sure = f.where((sevenths(F.col("w") + F.col("w1")) <= F.col("leader_n")) & (F.col("comp") != F.col("comp1"))).select(F.col("set1").alias("a"), F.col("set_id").alias("b"))
    # fewest common differences that a link with a set of another class takes: with any, and with one of no less w
    other = F.when(F.col("comp") != F.col("comp1"), F.col("w1")).otherwise(F.col("w2"))
    any_, more = (F.greatest(F.lit(1), sevenths(F.col("w") + x) - F.col("leader_n")) for x in (other, F.greatest(other, F.col("w"))))
    e = f.withColumns({"long": F.col("d") - any_ + 1, "short": F.col("d") - more + 1}).where("long > 0")
    e = keep(e.select("leader", "leader_n", "set_id", "comp", "w", "d", "long", "short", F.explode("diff").alias("x")), "differences")
    # what one class alone has can't be common to two; it comes first in the order, then the family's rarest
    useful = e.groupBy("leader", "x").agg(F.count("*").alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("leader", "x", "k")
    e = e.join(useful, ["leader", "x"])
    mine = Window.partitionBy("set_id")
    e = e.withColumn("pos", F.col("d") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("k", "x")) - 1).where(F.col("pos") < F.col("long"))
    e = keep(e.select("leader", "x", "set_id", "comp", "w", "leader_n", (F.col("d") - F.col("pos")).alias("left"), (F.col("pos") < F.col("short")).alias("short")), "difference-lists")
    p, q = e.where("short").alias("p"), e.alias("q")
    r = F.greatest(F.lit(1), sevenths(F.col("p.w") + F.col("q.w")) - F.col("p.leader_n"))
    on = (F.col("p.leader") == F.col("q.leader")) & (F.col("p.x") == F.col("q.x")) & (F.col("p.comp") != F.col("q.comp")) & (F.struct("p.w", "p.set_id") < F.struct("q.w", "q.set_id"))
    pairs = p.join(q, on & (F.least("p.left", "q.left") >= r)).select(F.col("p.set_id").alias("a"), F.col("q.set_id").alias("b")).distinct()
    pairs = keep(pairs, "family-pairs")
    a, b = (f.select(F.col("set_id").alias(s), F.col("w").alias(f"{s}_w"), F.col("diff").alias(f"{s}_diff"), *([F.col("leader_n")] if s == "a" else [])) for s in "ab")
    checked = pairs.join(a, "a").join(b, "b").where(F.size(F.array_intersect("a_diff", "b_diff")) >= sevenths(F.col("a_w") + F.col("b_w")) - F.col("leader_n"))
    return keep(sure.unionByName(checked.select("a", "b")), "family-links")


def open_entries(lists: DataFrame, comps: DataFrame, family: DataFrame, listed: DataFrame, keep: Keep) -> DataFrame:
    """Entries of the lists with each set's class, its family's leader (null where it has none) and in how many lists it is."""
    entries = lists.where("own").select("list", "set_id", "n", "pos", "rest")
    sides = (comps.select(F.col("node").alias("set_id"), "component"), family.select("set_id", "leader"), listed)
    for side in sides:
        entries = entries.join(small(keep(side, "side")), "set_id", "left")
    return entries.withColumn("component", F.coalesce("component", "set_id"))


#: Columns of an entry, as the scans of whole lists read them.
ENTRY = ("list", "p", "q", "side", "grid", "guest", "set_id", "n", "pos", "rest", "component", "family", "listed")


def dealt(entries: DataFrame, per_task: int) -> DataFrame:
    """Entries of the lists in which sets of several classes and families meet, as parts of lists (list, p, q; see ENTRY).

    A list of up to ``per_task`` entries is one part.  Of a longer one, most entries are of one class and family as a rule; these
    pair with others only.  All entries are dealt out to rows of a grid (side 0) and the others (guests) to its columns, too
    (side 1); a cell pairs its side 0 with its side 1.
    """
    entries = entries.withColumn("family", F.coalesce("leader", "set_id"))
    kinds = entries.groupBy("list").agg(F.count("*").alias("len"), *[f(c).alias(f"{c}_{k}") for c in ("component", "family") for k, f in (("lo", F.min), ("hi", F.max))])
    kinds = kinds.where("component_lo <> component_hi and family_lo <> family_hi").select("list", "len")
    rows = entries.join(kinds, "list")
    most = rows.where(F.col("len") > per_task).groupBy("list", "component", "family").agg(F.count("*").alias("k"))
    most = most.groupBy("list").agg(F.max(F.struct("k", "component", "family")).alias("m"))
    rows = rows.join(most, "list", "left").withColumn("grid", F.col("len") > per_task)
    home = F.col("grid") & (F.col("component") == F.col("m.component")) & (F.col("family") == F.col("m.family"))
    deal = lambda k, salt: F.pmod(F.xxhash64(F.lit(salt), "set_id"), k)
    tall, wide = F.ceil(F.col("len") / per_task), F.ceil((F.col("len") - F.col("m.k")) / per_task)
    cell = lambda p, q, side: F.struct(p.cast("bigint").alias("p"), q.cast("bigint").alias("q"), F.lit(side).cast("bigint").alias("side"))
    zero = F.lit(0).cast("bigint")
    down = F.transform(F.sequence(zero, wide - 1), lambda q: cell(deal(tall, 1), q, 0))
    across = F.transform(F.sequence(zero, tall - 1), lambda p: cell(p, deal(wide, 2), 1))
    cells = F.when(~F.col("grid"), F.array(cell(zero, zero, 0))).when(home, down).otherwise(F.concat(down, across))
    return rows.withColumn("cell", F.explode(cells)).select("list", "cell.*", F.col("grid").cast("bigint").alias("grid"), (~home).cast("bigint").alias("guest"), *ENTRY[6:])


def whole_parts(batches):
    """Whole parts of lists, many at a time, as columns with a running number of the part; from rows sorted by part."""
    held = None
    for b in batches:
        rows = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ENTRY}
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in ENTRY}
        if not len(rows["list"]):
            continue
        turn = np.append(True, np.any([rows[c][1:] != rows[c][:-1] for c in ("list", "p", "q")], axis=0))
        cut = int(np.flatnonzero(turn)[-1])  # the last part may go on
        held = {c: x[cut:] for c, x in rows.items()}
        if cut:
            yield {c: x[:cut] for c, x in rows.items()} | {"part": np.cumsum(turn[:cut])}
    if held is not None and len(held["list"]):
        yield held | {"part": np.zeros(len(held["list"]), np.int64)}


def pairs_in_parts(rows: dict[str, np.ndarray], most: int = 500_000) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """The sorted rows, and numbers of those that pair up, up to about ``most`` at a time: sets of other classes and families
    whose sizes and positions leave room for the overlap needed."""
    block = size_block(rows["n"])
    order = np.lexsort((rows["set_id"], rows["pos"], rows["side"], rows["family"], rows["component"], block, rows["part"]))
    rows, block = {c: x[order] for c, x in rows.items()}, block[order]
    part, n, pos, ids = rows["part"], rows["n"], rows["pos"], rows["set_id"]
    keys = (part, block, rows["component"], rows["family"], rows["side"])
    at = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))  # runs: one block, class, family, side
    run = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(n))))
    n_lo, n_hi = np.minimum.reduceat(n, at), np.maximum.reduceat(n, at)
    comp, fam, side, grid, guest = (rows[c][at] for c in ("component", "family", "side", "grid", "guest"))
    place = part[at] * 256 + block[at]
    end = np.searchsorted(place, place + 1, "right")  # behind the runs of the next larger block
    wide = int(pos.max()) + 2
    flat = run * wide + pos
    ahead = (end - np.arange(len(at)) - 1)[run]
    sums = np.concatenate([[0], np.cumsum(ahead)])
    a = 0
    while a < len(n):
        z = max(a + 1, int(np.searchsorted(sums, sums[a] + most, "right")) - 1)
        i = np.repeat(np.arange(a, z), ahead[a:z])
        h = run[i] + 1 + np.arange(sums[a], sums[z]) - sums[i]
        g = run[i]
        ok = (comp[g] != comp[h]) & (fam[g] != fam[h]) & ((grid[g] == 0) | ((side[g] != side[h]) & (guest[g] + guest[h] > 0)))
        ok &= (n_lo[h] * NUM <= n[i] * DEN) & (n_hi[h] * DEN >= n[i] * NUM)
        i, h = i[ok], h[ok]
        need = overlap_needed(n[i], np.maximum(n_lo[h], -(-NUM * n[i] // DEN)))
        lo = np.searchsorted(flat, h * wide + np.clip(pos[i] - n[i] + need, 0, wide - 1))
        hi = np.searchsorted(flat, h * wide + np.clip(pos[i] + n_hi[h] - need, -1, wide - 1), "right")
        count = np.maximum(hi - lo, 0)
        done = np.concatenate([[0], np.cumsum(count)])
        b = 0
        while b < len(i):
            y = max(b + 1, int(np.searchsorted(done, done[b] + most, "right")) - 1)
            x = np.repeat(i[b:y], count[b:y])
            j = np.repeat(lo[b:y] - done[b:y], count[b:y]) + np.arange(done[b], done[y])
            need = overlap_needed(n[x], n[j])
            ok = np.minimum(pos[x], pos[j]) + np.minimum(n[x] - pos[x], n[j] - pos[j]) >= need
            # two sets share no more prefix shingles than either has in lists
            ok &= np.minimum(rows["listed"][x], rows["listed"][j]) >= need - np.maximum(rows["rest"][x], rows["rest"][j])
            # each two guests meet in two cells of a grid
            ok &= (rows["grid"][x] == 0) | (rows["guest"][x] + rows["guest"][j] < 2) | ((rows["side"][x] < rows["side"][j]) == (ids[x] < ids[j]))
            if ok.any():
                yield rows, x[ok], j[ok]
            b = y
        a = z


def remaining_pairs(entries: DataFrame, known: DataFrame, parts: int, per_task: int) -> DataFrame:
    """a, b of pairs that links and families leave open and that share enough prefix shingles."""

    def scan(batches):
        for whole in whole_parts(batches):
            for rows, i, j in pairs_in_parts(whole):
                ids, n, rest = rows["set_id"], rows["n"], rows["rest"]
                i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[i], ids[j], n[i], n[j], np.maximum(rest[i], rest[j]))], ["a", "b", "a_n", "b_n", "rest"])

    found = dealt(entries, per_task).repartition(parts, "list", "p", "q").sortWithinPartitions("list", "p", "q").select(*ENTRY)
    found = found.mapInArrow(scan, "a bigint, b bigint, a_n bigint, b_n bigint, rest bigint")
    counted = found.groupBy("a", "b", "a_n", "b_n", "rest").agg(F.count("*").alias("met"))
    open_ = counted.where(F.col("met") >= shared_needed(F.col("a_n"), F.col("b_n"), F.col("rest"))).select("a", "b")
    done = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return open_.join(done, ["a", "b"], "left_anti")


def jaccard_classes(docs: DataFrame, size: int = 5, heavy_least: int = 12, heavy_most: int = 1_000_000, per_task: int = 100_000, together: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    ``together``: entries of one shingle that meet in a task while lists are made; ``per_task``: entries of a list that do when its
    sets are paired.  More are dealt out further.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    keep = scratch.written
    sets = keep(document_sets(docs, size), "document-sets", **HASHES)
    real = sets.where("n_shingles > 0")
    reps = keep(real.groupBy("set_id").agg(F.min("doc_id").alias("doc_id")), "reps")
    total = real.agg(F.sum("n_shingles")).first()[0] or 0
    lists = keep(index_lists(real, total, heavy_shingles(real, total, heavy_least, heavy_most, keep), together), "lists")
    parts = partitions_for(spark, lists.count(), 500_000, int(spark.conf.get("spark.sql.shuffle.partitions")))

    led = lists.where("set_id <> leader").where(reachable(F.col("n"), F.col("leader_n"), F.col("pos"), F.col("leader_pos")))
    stars = led.select(F.col("leader").alias("a"), F.col("set_id").alias("b"), F.col("n").alias("m"), F.col("leader_n").alias("k"), F.greatest("rest", "leader_rest").alias("rest"))
    stars = stars.groupBy("a", "b", "m", "k", "rest").agg(F.count("*").alias("met"))
    stars = stars.where(LIKELY * F.col("met") >= shared_needed(F.col("m"), F.col("k"), F.col("rest")))  # the others are left open
    known = compared(stars, real, reps, keep)
    comps = merged(None, linked(known), keep)
    listed = keep(lists.where("own").groupBy("set_id").agg(F.count("*").alias("listed")), "listed")
    first = open_entries(lists, comps, families(known, keep), listed, keep)
    adopted = compared(hub_pairs(first, known), real, reps, keep)
    known = known.unionByName(adopted)
    comps = merged(comps, linked(adopted), keep)
    family = families(known, keep)
    comps = merged(comps, family_links(family, comps, keep), keep)
    rest = keep(remaining_pairs(open_entries(lists, comps, family, listed, keep), known, parts, per_task), "rest")
    if not rest.isEmpty():
        comps = merged(comps, linked(compared(rest, real, reps, keep)), keep)
    # classes of several sets; a set by itself keeps its least document
    several = keep(comps.select(F.col("node").alias("set_id"), "component").join(reps, "set_id"), "classes")
    least = small(keep(several.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least"))
    several = small(keep(several.join(least, "component").select("set_id", "component_id"), "class-ids"))
    ids = reps.join(several, "set_id", "left").select("set_id", F.coalesce("component_id", "doc_id").alias("component_id"))
    full = real.select("doc_id", "n_shingles", "set_id").join(ids, "set_id").select("doc_id", "n_shingles", "component_id")
    out = written(full.unionByName(sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))), "jaccard-classes")
    scratch.drop()
    return out


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its class; rows without a doc_id stay."""
    classes = jaccard_classes(docs, **how)
    gone = classes.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
