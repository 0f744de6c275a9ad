"""Benchmark decontamination by template canonicalisation.

Texts become sequences of template tokens.  Runs of letters and digits are tokens; case and punctuation don't count.  Three
types become placeholders whose values are slots: numbers (a token that begins with a digit), units (a unit word after a
number) and names (a capitalised word that doesn't begin a sentence or a line).  As capitals and line breaks say which words are
names, each text has a second form, in which names are words like others, and a match of either form counts: a copy in other
case or with other line breaks is found by its words.  Windows of ``size`` template tokens are hashed and hash-joined with the
windows of the benchmark.  A window with fewer than ``literal`` words says too little as a template; it stands for its tokens
as they are, numbers and all, so a passage of numbers is found where it is copied.

*Items.*  Items with the same windows and the same pattern of equal slots are one class, so copies of an item, and one question
asked with many numbers, count once.  Windows that one class alone has bring documents and that class together.  Windows that several
classes have are no class's own: all such windows of a class, with their distances, tokens and pattern of slots, are its *common part*, and
classes with the same common part share one row for it, with the membership beside it.  A document is held against common parts
as it is against classes, and a class that a window of its own has met is held against the common windows too.  So a phrase of many
items meets a document once, not once for each item, and whatever a document has of an item is seen, however many others have it.

*Matches.*  Windows of one document and class that lie on one diagonal (same distance between the places in the document and in
the item) belong together.  Such a match counts when its slots are consistent: equal values of the item always stand for equal
values of the document, and different ones for different ones.  A question with other numbers or names is caught; two texts that
merely share sentence patterns with clashing slots are not.  Where the slots of a diagonal clash, it falls into its runs, the
longest rows of windows that overlap or touch (a token that differs ends a run), and each run with changed values counts by itself if it
is consistent.  Windows that are verbatim those of some item of the class count together in any case, whatever clashes beside
them.  A document is contaminated when windows that count together cover at least ``cover`` template tokens of an item or all of
an item's windows.

The benchmark's windows are a side table.  Its hashes go to every task as a filter, so only windows that will join leave the
scan: as a sorted list up to ``broadcast_windows`` of them, beyond as a Bloom filter of ``bloom_bits`` bits at most, which lets
some others pass; those don't join.

Defined results: null and empty texts have no windows and match nothing; an item with fewer tokens than a window is one window
of its own length, and with fewer than ``literal`` tokens it is matched by documents that consist of it alone; repeated rows are
found each alike (result rows are by doc_id, so equal ids share a row); rows with a null doc_id or item_id can't be named and are
neither found nor dropped; extra columns pass through :func:`drop_contaminated`; an empty table on either side finds nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import textscan as S
from .shared import Scratch, written

U = np.uint64
#: Fixed word list: units of measure.
UNITS = "km m cm mm mi mile miles ft feet foot inch inches yd yard yards kg g mg lb lbs pound pounds oz ounce ounces ton tons l ml litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur mph kmh kph hz khz mhz ghz kb mb gb tb w kw mw v volt volts amp amps c f k degree degrees"
NUMBER, UNIT, NAME, WORD = range(4)
MARKS = S.mix(np.array([11, 12, 13], U))
#: Sets hashes of windows taken as they are apart from those of templates.
AS_IS = U(0x6A09E667F3BCC909)
#: Forms of a text: with names as placeholders, and with names as words; a window without names is the same in both.
TYPED, PLAIN = 1, 2

ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
STOP = np.zeros(256, bool)
STOP[[*b".!?:\n\r"]] = True


#: Small letters of the code points below 65536, where they take as many bytes as the capitals.
SMALL = np.arange(1 << 16)
for _c in range(128, 1 << 16):
    _l = chr(_c).lower()
    if not 0xD800 <= _c < 0xE000 and len(_l) == 1 and len(_l.encode()) == len(chr(_c).encode()):
        SMALL[_c] = ord(_l)
SMALL[ord("ς")] = ord("σ")


def lower(buf: np.ndarray) -> np.ndarray:
    """UTF-8 in small letters, of the same length."""
    out = S.LOWER[buf]
    for least, most, n in ((0xC2, 0xDF, 2), (0xE0, 0xEF, 3)):
        at = np.flatnonzero((buf[: max(len(buf) - n + 1, 0)] >= least) & (buf[: max(len(buf) - n + 1, 0)] <= most))
        for k in range(1, n):  # bytes that aren't UTF-8 stay
            at = at[(buf[at + k] & 0xC0) == 0x80]
        code = (buf[at] & (0x1F if n == 2 else 0x0F)).astype(np.int64)
        for k in range(1, n):
            code = code << 6 | (buf[at + k] & 0x3F)
        turn = SMALL[code] != code
        at, code = at[turn], SMALL[code[turn]]
        for k in range(n - 1, 0, -1):
            out[at + k] = 0x80 | (code & 0x3F)
            code = code >> 6
        out[at] = (0xC0 if n == 2 else 0xE0) | code
    return out


def _unit_hashes() -> np.ndarray:
    w = [x.encode() for x in UNITS.split()]
    buf = np.frombuffer(b"".join(w), np.uint8)
    offs = S.segments(np.array([len(x) for x in w]))
    return np.sort(S.hash_spans(buf, offs[:-1], offs[1:]))


UNIT_HASHES = _unit_hashes()


def template(buf: np.ndarray, offs: np.ndarray):
    """Of each token: its owner, its type, its type where names are words, the hash of its value."""
    starts, ends = S.runs(ALNUM[buf], offs)
    owner = S.owners(starts, offs)
    value = S.hash_spans(lower(buf), starts, ends)
    kind = np.full(len(starts), WORD)
    if not len(starts):
        return owner, kind, kind, value
    first = buf[starts]
    kind[(first >= 48) & (first <= 57)] = NUMBER
    # a capital letter, then small ones: neither I nor SHOUTED; C3 80-9E are the Latin-1 capitals
    ups = np.concatenate([[0], np.cumsum(UPPER[buf])])
    second = buf[np.minimum(starts + 1, len(buf) - 1)]
    small = ((second >= 97) & (second <= 122)) | (second >= 128)
    capital = (UPPER[first] & small & (ends - starts > 1) & (ups[ends] - ups[starts] == 1)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (ups[ends] == ups[starts]))
    breaks = np.concatenate([[0], np.cumsum(STOP[buf])])
    begins = np.ones(len(starts), bool)  # of a sentence or line, or of the text
    begins[1:] = (owner[1:] != owner[:-1]) | (breaks[starts[1:]] > breaks[ends[:-1]])
    unit = np.isin(value, UNIT_HASHES)
    unit[0] = False
    unit[1:] &= (kind[:-1] == NUMBER) & (owner[1:] == owner[:-1])
    kind[unit & (kind == WORD)] = UNIT
    typed = kind.copy()
    typed[capital & ~begins] = NAME
    return owner, typed, kind, value


def windows(part: pa.RecordBatch, column: str, size: int, literal: int, lengths: tuple[int, ...], whole: bool):
    """hash, owner, place, tokens, forms (of the window), hash of its values, the token that each window begins at; and of the
    texts' tokens the kinds by form and the values.  lengths: of shorter windows; with ``whole``, these are whole texts only."""
    buf, offs = S.raw(part.column(column))
    owner, typed, plain, value = template(buf, offs)
    begin = np.searchsorted(owner, np.arange(len(offs) - 1))
    count = np.bincount(owner, minlength=len(offs) - 1)
    names = np.concatenate([[0], np.cumsum(typed == NAME)])
    found = []
    for n in (size, *lengths):
        exact, f = S.windows(value, owner, n)
        exact = S.mix(exact + U(n))
        named = names[f + n] > names[f]
        fits = np.ones(len(f), bool)
        if n < size and (whole or n < literal):
            fits = count[owner[f]] == n
        for which, kind in ((TYPED, typed), (PLAIN, plain)):
            form = value.copy()
            slot = kind != WORD
            form[slot] = MARKS[kind[slot]]
            words = np.concatenate([[0], np.cumsum(kind == WORD)])
            h, _ = S.windows(form, owner, n)
            h = np.where(words[f + n] - words[f] >= literal, S.mix(h + U(n)) if n < size else h, S.mix(exact ^ AS_IS))
            ok = fits & named if which == PLAIN else fits
            found.append((h[ok], f[ok], np.full(int(ok.sum()), n), np.where(named[ok], which, TYPED | PLAIN), exact[ok]))
    h, first, length, forms, exact = (np.concatenate(x) for x in zip(*found, strict=True))
    return h, owner[first], first - begin[owner[first]], length, forms, exact, first, {TYPED: typed, PLAIN: plain, TYPED | PLAIN: plain}, value


def _digest(*arrays: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(b"|".join(x.tobytes() for x in arrays), digest_size=8).digest(), "little", signed=True)


def window_rows(df: DataFrame, key: str, size: int, literal: int, lengths: tuple[int, ...], items: bool = False, only=None) -> DataFrame:
    """<key>, hash, exact (of the values), place, tokens, forms, slots of the windows of a table; slots are (offset in the text,
    value) of placeholders.  Of items also ``class`` (same windows, same pattern of slots) and ``said`` (same values)."""
    shape = f"`{key}` {df.schema[key].dataType.simpleString()}, hash bigint, exact bigint, place bigint, tokens bigint, forms bigint, slots array<struct<place:bigint,kind:int,value:bigint>>" + ", class bigint, said bigint" * items
    slot = pa.list_(pa.struct([("place", pa.int64()), ("kind", pa.int32()), ("value", pa.int64())]))

    def classes(h, who, place, length, forms, first, kinds, value):
        """class and said of each window's item."""
        order = np.lexsort((forms, place, length, who))
        edges = np.append(np.flatnonzero(np.append(True, who[order][1:] != who[order][:-1])), len(order))
        out = np.zeros((2, len(h)), np.int64)
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            rows = order[a:z]
            begin = int((first[rows] - place[rows]).min())
            end = int((first[rows] + length[rows]).max())
            at = np.flatnonzero(kinds[TYPED][begin:end] != WORD) + begin
            _, seen, same = np.unique(value[at] ^ MARKS[kinds[TYPED][at]], return_index=True, return_inverse=True)
            out[:, rows] = np.array([[_digest(h[rows], place[rows], seen[same])], [_digest(value[begin:end])]])
        return out

    def scan(batches):
        for part in S.blocks(batches, "text"):
            h, who, place, length, forms, exact, first, kinds, value = windows(part, "text", size, literal, lengths, items)
            if only is not None and len(h):
                keep = only.value.has(h)
                h, who, place, length, forms, exact, first = (x[keep] for x in (h, who, place, length, forms, exact, first))
            slots = []
            for p, n, f, which in zip(place.tolist(), length.tolist(), first.tolist(), forms.tolist(), strict=True):
                kind = kinds[which]
                at = np.flatnonzero(kind[f : f + n] != WORD)
                slots.append([{"place": int(p + k), "kind": int(kind[f + k]), "value": int(value[f + k].view(np.int64))} for k in at.tolist()])
            cols = [part.column(key).take(pa.array(who)), pa.array(S.signed(h)), pa.array(S.signed(exact)), pa.array(place), pa.array(length), pa.array(forms), pa.array(slots, slot)]
            if items:
                cols += [pa.array(x) for x in (classes(h, who, place, length, forms, first, kinds, value) if len(h) else np.zeros((2, 0), np.int64))]
            yield pa.RecordBatch.from_arrays(cols, [key, "hash", "exact", "place", "tokens", "forms", "slots", *["class", "said"] * items])

    return df.where(F.col(key).isNotNull()).select(key, F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(scan, shape)


class Listed:
    """A filter for hashes: those of a sorted list."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes

    def has(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)] == h


class Bloom:
    """A filter for hashes: all those put in, and a few others."""

    SEGMENT = 20  # bits of a place within a segment

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    @staticmethod
    def places(h: np.ndarray, size: int) -> np.ndarray:
        return np.concatenate([x >> U(64 - size) for x in (S.mix(h ^ U(0x1F83D9ABFB41BD6B)), S.mix(h ^ U(0x5BE0CD19137E2179)))])

    def has(self, h: np.ndarray) -> np.ndarray:
        at = self.places(h, self.size)
        ok = (self.bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1
        return ok.reshape(2, -1).all(axis=0)

    @classmethod
    def of(cls, hashes: DataFrame, n: int, most: int) -> Bloom:
        """The filter of a column ``hash`` of n numbers, its segments made in tasks of their own; at most ``most`` bits."""
        size = max(cls.SEGMENT, min(most.bit_length() - 1, (16 * n).bit_length()))
        low = U((1 << cls.SEGMENT) - 1)

        def put(batches):
            for b in batches:
                at = cls.places(b.column("hash").to_numpy().view(U), size)
                yield pa.RecordBatch.from_arrays([pa.array((at >> U(cls.SEGMENT)).astype(np.int64)), pa.array((at & low).astype(np.int64))], ["segment", "bit"])

        def build(batches):
            found: dict[int, np.ndarray] = {}
            for b in batches:
                seg, bit = b.column("segment").to_numpy(), b.column("bit").to_numpy()
                for s in np.unique(seg).tolist():
                    mine = found.setdefault(s, np.zeros(1 << cls.SEGMENT, np.uint8))
                    mine[bit[seg == s]] = 1
                    if len(found) > 64:  # a segment may come in several rows
                        yield rows(found)
                        found = {}
            yield rows(found)

        def rows(found):
            return pa.RecordBatch.from_pydict({"segment": list(found), "bits": [np.packbits(x, bitorder="little").tobytes() for x in found.values()]}, pa.schema([("segment", pa.int64()), ("bits", pa.binary())]))

        made = hashes.mapInArrow(put, "segment bigint, bit bigint").repartition(1 << (size - cls.SEGMENT), "segment").mapInArrow(build, "segment bigint, bits binary").toArrow()  # at most ``most`` bits
        bits = np.zeros(1 << (size - 3), np.uint8)
        each = 1 << (cls.SEGMENT - 3)
        for s, x in zip(made.column("segment").to_pylist(), made.column("bits").to_pylist(), strict=True):
            bits[s * each : (s + 1) * each] |= np.frombuffer(x, np.uint8)
        return cls(bits, size)


def _consistent(pairs: Column) -> Column:
    values = lambda *names: F.size(F.array_distinct(F.transform(pairs, lambda p: F.struct(p["kind"], *[p[x] for x in names]))))
    both = values("item", "doc")
    return (both == values("item")) & (both == values("doc"))


def _runs(at: Column) -> Column:
    """Sorted windows, in arrays of those that overlap or touch."""
    begins = lambda w, k: F.coalesce(w["item_place"] > F.get(at, k - 1)["item_place"] + F.get(at, k - 1)["tokens"], F.lit(True))
    starts = F.transform(F.filter(at, begins), lambda w: w["item_place"])
    return F.transform(starts, lambda s, k: F.filter(at, lambda w: (w["item_place"] >= s) & F.coalesce(w["item_place"] < F.get(starts, k + 1), F.lit(True))))


def item_classes(benchmark: DataFrame, size: int, literal: int, keep) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of classes and of common parts, both known by a number in ``class``:

    windows (class, hash, place, tokens, forms, slots, begins: whether they bring documents together with the class); names (class,
    item: the shortest one as (n_windows, item_id), n_items, and by form how many windows are all of an item's); the values that windows
    have in any item (class, place, tokens, exact, said_by: the shortest such item); and membership (class, item_id).
    """
    rows = keep(window_rows(benchmark, "item_id", size, literal, tuple(range(1, size)), items=True), "item-windows")
    classes = keep(rows.groupBy("class").agg(F.min(F.struct("item_id", "said")).alias("m"), F.countDistinct("item_id").alias("n_items")), "classes")
    one = rows.join(classes.select("class", "m.*"), ["class", "item_id", "said"]).dropDuplicates(["class", "hash", "place", "tokens", "forms"])
    one = one.join(one.groupBy("hash").agg(F.countDistinct("class").alias("k")), "hash")
    one = keep(one.select("class", "item_id", "hash", "place", "tokens", "forms", "slots", (F.col("k") == 1).alias("begins")), "class-windows")
    has = lambda x: F.count(F.when(F.col("forms").bitwiseAND(x) != 0, 1))
    sizes = one.groupBy("class").agg(F.count("*").alias("n_windows"), has(TYPED).alias("typed"), has(PLAIN).alias("plain"), F.min(F.when(~F.col("begins"), F.col("place"))).alias("offset"), F.bool_or("begins").alias("own"))
    names = classes.select("class", "m.item_id", "n_items").join(sizes, "class")
    said = rows.join(sizes.select("class", "n_windows"), "class").groupBy("class", "place", "tokens", "exact").agg(F.min(F.struct("n_windows", "item_id")).alias("said_by"))

    # common parts: an item's windows are one list, no longer than the item
    common = one.where("not begins").join(sizes.select("class", "offset"), "class").withColumn("place", F.col("place") - F.col("offset"))
    moved = F.transform("slots", lambda x: F.struct((x["place"] - F.col("offset")).alias("place"), x["kind"].alias("kind"), x["value"].alias("value")))
    common = common.withColumn("slots", moved)
    parts = common.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("place", "tokens", "forms", "hash"))).alias("w"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("slots")))).alias("s"))
    values = F.transform("s", lambda x: F.struct(x["kind"], x["value"]))
    pattern = F.transform("s", lambda x: F.struct(x["place"], F.array_position(values, F.struct(x["kind"], x["value"]))))
    member = keep(parts.select("class", F.xxhash64(F.lit(17), "w", pattern).alias("part")), "members")
    first = member.groupBy("part").agg(F.min("class").alias("class"))
    windows = common.join(first, "class").select(F.col("part").alias("class"), "hash", "place", "tokens", "forms", "slots", F.lit(True).alias("begins"))
    of = member.join(names, "class")
    whole = lambda c: F.min(F.when(~F.col("own"), F.col(c))).alias(c)  # noqa: E731  all of an item is common
    part_names = of.groupBy("part").agg(F.min(F.struct("n_windows", "item_id")).alias("item"), F.sum("n_items").alias("n_items"), whole("typed"), whole("plain")).withColumnRenamed("part", "class")
    part_said = said.join(of.select("class", "part", "offset"), "class").groupBy(F.col("part").alias("class"), (F.col("place") - F.col("offset")).alias("place"), "tokens", "exact").agg(F.min("said_by").alias("said_by"))

    windows = keep(one.select(*windows.columns).unionByName(windows), "windows")
    names = names.select("class", F.struct("n_windows", "item_id").alias("item"), "n_items", "typed", "plain")
    items = rows.select("class", "item_id").distinct()
    items = items.unionByName(items.join(member, "class").select(F.col("part").alias("class"), "item_id"))
    return windows, keep(names.unionByName(part_names), "names"), keep(said.unionByName(part_said), "values"), items


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 8, literal: int = 4, cover: int = 10, broadcast_windows: int = 1_000_000, bloom_bits: int = 1 << 30, every_item: bool = False) -> DataFrame:
    """doc_id, item_id (of a class or common part: the shortest one whose own words stand there, else the shortest), first_token,
    n_tokens (covered), n_slots, reparameterised, n_items (that share the class or part): one row for each document and class or part of a
    match that counts; or, with ``every_item``, for each document and item."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    keep = scratch.written
    items, names, said, members = item_classes(benchmark, size, literal, keep)
    lengths = tuple(sorted(r.tokens for r in items.where(F.col("tokens") < size).select("tokens").distinct().collect()))  # below size
    hashes = items.select("hash").distinct()
    n = hashes.count()
    # at most broadcast_windows numbers, or bloom_bits bits
    only = Listed(np.sort(hashes.toArrow().column("hash").to_numpy().view(U))) if n <= broadcast_windows else Bloom.of(hashes, n, bloom_bits)
    there = keep(window_rows(docs, "doc_id", size, literal, lengths, only=docs.sparkSession.sparkContext.broadcast(only)), "document-windows")
    i = items.select("hash", "class", "tokens", F.col("place").alias("item_place"), F.col("forms").alias("item_forms"), F.col("slots").alias("item_slots"), "begins")
    met = keep(there.join(i.where("begins"), ["hash", "tokens"]), "begun")
    rest = i.where("not begins")
    pairs = met.join(rest.select("class").distinct(), "class", "left_semi").select("doc_id", "class").distinct()
    met = met.unionByName(there.join(rest.select("hash", "tokens").distinct(), ["hash", "tokens"], "left_semi").join(pairs, "doc_id").join(rest, ["class", "hash", "tokens"]))
    met = met.join(said.withColumnRenamed("place", "item_place"), ["class", "item_place", "tokens", "exact"], "left")
    # of each window: pairs of slot values, in order
    pairs = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a["place"].alias("place"), a["kind"].alias("kind"), a["value"].alias("item"), b["value"].alias("doc")))
    form = F.explode(F.filter(F.array(F.lit(TYPED), F.lit(PLAIN)), lambda x: F.col("forms").bitwiseAND(F.col("item_forms")).bitwiseAND(x) != 0))
    met = met.select("doc_id", "class", form.alias("form"), (F.col("place") - F.col("item_place")).alias("diagonal"), "item_place", "tokens", pairs.alias("pairs"), "said_by")
    # a diagonal has at most one window for each place of the item, so its lists are no longer than the item
    by = met.groupBy("doc_id", "class", "form", "diagonal").agg(F.collect_set(F.struct("item_place", "tokens", "pairs", "said_by")).alias("at"))
    pairs_of = lambda at: F.array_distinct(F.flatten(F.transform(at, lambda w: w["pairs"])))
    changed = lambda at: F.exists(at, lambda w: w["said_by"].isNull())
    exact = F.filter("at", lambda w: w["said_by"].isNotNull())
    others = F.when(_consistent(pairs_of(F.col("at"))), F.array("at")).otherwise(F.filter(_runs(F.array_sort("at")), lambda r: _consistent(pairs_of(r))))
    parts = F.concat(F.array(exact), F.filter(others, changed))
    by = by.select("doc_id", "class", "form", "diagonal", F.explode(parts).alias("at")).withColumn("pairs", pairs_of(F.col("at")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda w: F.sequence(w["item_place"], w["item_place"] + w["tokens"] - 1)))))
    n_windows = F.size(F.array_distinct(F.transform("at", lambda w: w["item_place"])))
    first = F.array_min(F.transform("at", lambda w: w["item_place"] + F.col("diagonal")))
    by = by.where(F.size("at") > 0).select("doc_id", "class", "form", first.alias("first_token"), covered.cast("long").alias("n_tokens"), n_windows.cast("long").alias("n_windows"), F.size("pairs").cast("long").alias("n_slots"), changed(F.col("at")).alias("reparameterised"), F.array_min(F.transform("at", lambda w: w["said_by"])).alias("said_by"))
    whole = F.when(F.col("form") == TYPED, F.col("typed")).otherwise(F.col("plain"))
    best = by.join(names, "class").where((F.col("n_tokens") >= cover) | (F.col("n_windows") >= whole))
    measure = F.struct("n_tokens", (-F.col("first_token")).alias("f"), "n_slots", (~F.col("reparameterised")).alias("verbatim"))
    found = best.groupBy("doc_id", "class").agg(F.max(measure).alias("m"), F.min("said_by").alias("said_by"), F.first("item").alias("item"), F.first("n_items").alias("n_items"))
    if every_item:
        found = found.join(members, "class").select("doc_id", "item_id", "m", "n_items")
    else:
        found = found.select("doc_id", F.coalesce("said_by.item_id", "item.item_id").alias("item_id"), "m", "n_items")
    found = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("m", "n_items")).alias("x")).select("doc_id", "item_id", "x.m", "x.n_items")
    out = written(found.select("doc_id", "item_id", (-F.col("m.f")).alias("first_token"), "m.n_tokens", "m.n_slots", (~F.col("m.verbatim")).alias("reparameterised"), "n_items"), "contaminated")
    scratch.drop()
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs that match no item, with all their columns."""
    found = contaminated(docs, benchmark, **how).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
