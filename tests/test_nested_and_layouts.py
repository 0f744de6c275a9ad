"""Nested JSON, layouts of bytes, sections in ranges, framed streams, wrapped text, scans by block: against plain Python."""

import json
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import binary, text
from sparkloom.operators import groups, nested, scan
from sparkloom.operators.segments import Lines
from sparkloom.sources import records, sections
from sparkloom.sources.records import Choice, Field, Group
from sparkloom.streaming import lines


def brute_cells(x, names=(), places=()):
    if isinstance(x, dict) and x:
        return [c for k, v in x.items() for c in brute_cells(v, (*names, k), places)]
    if isinstance(x, list) and x:
        return [c for i, v in enumerate(x) for c in brute_cells(v, names, (*places, i))]
    return [] if x in ({}, []) and not isinstance(x, (bool, int)) else [(names, places, x)]


def random_json(rng, depth=0):
    kind = rng.random()
    if depth < 7 and kind < 0.35:
        return {rng.choice(["a", "b", "a.b", "é", "[0]"]): random_json(rng, depth + 1) for _ in range(rng.randrange(4))}
    if depth < 7 and kind < 0.6:
        return [random_json(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([1, "x", "{}", "[1]", None, True, ""])


def test_cells_and_leaves(spark):
    rng = random.Random(4)
    values = [random_json(rng) for _ in range(120)]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, "not json"), (901, None)]
    df = spark.createDataFrame(rows, "path int, value string")
    shown = lambda x: None if x is None else "true" if x is True else str(x)
    got = [(r.path, tuple(r.column_path), tuple(r.row_path), r.value) for r in nested.cells(df, ["path"], "value").collect()]
    want = [(i, n, p, shown(x)) for i, v in enumerate(values) for n, p, x in brute_cells(v)]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 100
    out = nested.leaves(df, ["path"], "value")
    assert out.columns == ["path", "path_", "value"] and out.count() == len(want)
    tree = {tuple(r.path): (r.level, r.n) for r in nested.column_tree_of(df, "value", 20).collect()}
    counts = {}

    def walk(x, names):
        if isinstance(x, list):
            [walk(v, names) for v in x]
        elif isinstance(x, dict):
            for k, v in x.items():
                counts[*names, k] = counts.get((*names, k), 0) + 1
                walk(v, (*names, k))

    [walk(v, ()) for v in values]
    assert tree == {k: (len(k) - 1, n) for k, n in counts.items()}
    assert nested.cells(df.limit(0), ["path"], "value").count() == 0


LINE = [Field("size", "uint_b", 1), Field("name", "char", "size"), Field("m", "uint_b", 1), Group("items", "item", repeat="m"), Field("kind", "uint_b", 1), Choice("more", "kind", {1: [Field("x", "uint", 2)], 2: "item"})]
ITEM = [Field("length", "uint_b", 1), Field("body", "byte", "length", less=1), Field("nothing", "none", 1)]
LAYOUT = [Field("n", "uint_b", 2), Group("lines", "line", repeat="n"), Group("one", [Field("a", "int_b", 1)]), Field("pad", "uint_nz", lambda seen: records.nz(seen["n"], F.lit(1))), Field("rest", "char", None)]


def test_groups_of_several_lengths(spark, tmp_path):
    rng = random.Random(6)
    item = lambda: bytes(rng.randrange(256) for _ in range(rng.randrange(5)))
    files, want = {}, {}
    for k in range(40):
        data, told = b"", []
        count = rng.choice([0, 1, 2, 30])
        for _ in range(count):
            name, items, kind = rng.choice(["", "é", "word"]), [item() for _ in range(rng.randrange(4))], rng.randrange(4)
            pack = lambda b: bytes([len(b) + 1]) + b + b"\0"
            extra = {1: struct.pack("<H", 513), 2: pack(b"in")}.get(kind, b"")
            data += bytes([len(name.encode())]) + name.encode() + bytes([len(items)]) + b"".join(map(pack, items)) + bytes([kind]) + extra
            told.append((name, [(len(b) + 1, b) for b in items], (513,) if kind == 1 else None, (3, b"in") if kind == 2 else None))
        want[k] = (told, -5, 7 if count else 0)
        files[k] = struct.pack(">H", count) + data + struct.pack("b", -5) + (b"\7" if count else b"") + f"end{k}".encode()
        (tmp_path / f"{k}.bin").write_bytes(files[k])
    df = spark.read.format("binaryFile").load(f"file://{tmp_path}").select(records.decode(F.col("content"), LAYOUT, {"line": LINE, "item": ITEM}).alias("r")).select("r.*")
    got = {int(r.rest[3:]): ([(x.name, [(y.length, bytes(y.body)) for y in x["items"]], x.more.b1 and tuple(x.more.b1), x.more.b2 and (x.more.b2.length, bytes(x.more.b2.body))) for x in r.lines], r.one.a, r.pad) for r in df.collect()}
    assert got == want
    with pytest.raises(ValueError):
        records.decode(F.lit(b""), [Group("a", "a")], {"a": [Group("a", "a")]})
    a = F.array(F.lit(3), F.lit(4))
    none = F.array().cast("array<int>")
    r = spark.range(1).select(records.add_nz(F.lit(0), F.lit(5)), records.sub_nz(F.lit(7), F.lit(5)), records.first(a), records.last(a), records.last_default(none, F.lit(8)), records.last(none)).first()
    assert list(r) == [0, 2, 3, 4, 8, None]


def brute_sections(doc, sep=1):
    ls = doc.split("\n")
    title = [x.strip().startswith("##!#") and all(not y.strip() for y in ls[max(0, i - sep) : i]) for i, x in enumerate(ls)]
    at = [i for i, t in enumerate(title) if t]
    out = []
    for i, z in zip(at, [*at[1:], len(ls)], strict=True):
        indent, body = ls[i].index("##!#"), ls[i + 1 : z]
        n = int((re.search(r"\sends\s+E([123])", ls[i]) or [0, "1"])[1])
        for k in range(len(body)):
            if all(not x.strip() for x in body[k : k + n]):
                body = body[:k]
                break
        out.append((ls[i].split("##!#")[1].split(".")[0].strip(), "\n".join(x[indent:] for x in body)))
    return out


def test_sections_in_ranges(spark, tmp_path):
    rng = random.Random(8)
    docs = []
    for f in range(3):
        ls = []
        for k in range(300):
            ls.append(rng.choice(["", "", "  ", "word here", "    deep: x", "\ttab", f"##!# n{k} .value", f"   ##!# two words{k} .object as q{k} ends E2", f"  ##!# t{k} .table(a=(1, f(2))) ends E3 as z", "x ##!# no .value"]))
        docs.append("\n".join(ls))
        (tmp_path / f"f{f}.txt").write_text(docs[-1])
    want = sorted(x for d in docs for x in brute_sections(d))
    one = sections.sections(spark.createDataFrame(list(enumerate(docs)), "id int, text string"), "id")
    assert sorted((r.name, r.body) for r in one.collect()) == want and len(want) > 60
    args = {r.args for r in one.where("type = 'table'").collect()}
    assert args == {"a=(1, f(2))"} and {r.alias for r in one.where("type = 'object'").collect()} == {f"q{r.name[9:]}" for r in one.where("type = 'object'").collect()}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        many = sections.read_sections(spark, f"file://{tmp_path}")
        got = many.collect()
        assert spark.read.text(f"file://{tmp_path}").select("_metadata.file_block_start").distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.name, r.body) for r in got) == want
    assert sorted((r.ordinal, r.name, r.type, r.args or "", r.body) for r in got) == sorted((r.ordinal, r.name, r.type, r.args or "", r.body) for r in one.collect())


def test_framed_streams_go_on(spark, tmp_path):
    """Chunks in files, a query stopped and started again from its checkpoint: each record once."""
    said = {"a": "one;;two;;;;three;;half", "b": "x;;y"}
    chunks = [(c, 10 * i, t[i : i + 3]) for c, t in said.items() for i in range(0, len(t), 3)]
    schema = "ch string, at int, data string"

    def run():
        rows = lines.framed(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), "ch", "at", "data", ";;")
        rows.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    chunks.sort(key=lambda x: x[1])
    for part in (chunks[:4], [*chunks[4:], ("c", 1, None)], [("a", 999, " end;;"), ("b", 999, ";")]):
        spark.createDataFrame(part[::-1], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        run()
    got = sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == [("a", 0, "one"), ("a", 1, "two"), ("a", 2, ""), ("a", 3, "three"), ("a", 4, "half end"), ("b", 0, "x")]


def test_wrap_is_the_state_machine(spark):
    rng = random.Random(12)
    marks = "ab ,(中。「\t　é）国!x\n"
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", " ", "a" * 40, "（" * 9, "中" * 30, "x" * 7 + "中" * 5, "😀😀 a"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for width in (1, 2, 5, 11, 40):
        got = {r.id: r.w for r in df.select("id", text.wrap(F.col("t"), width).alias("w")).collect()}
        assert all(got[i] == text.wrap_text(t, width) for i, t in enumerate(texts)), width


def test_checksums_of_parts(spark):
    data = bytes(range(256)) * 3 + b"end"
    rng = random.Random(1)
    cuts = sorted({0, len(data), *(rng.randrange(len(data)) for _ in range(20))})
    parts = spark.createDataFrame([(a, data[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)], "at bigint, b binary")
    whole = spark.createDataFrame([(data,)], "b binary").select(binary.checksum32(F.col("b"))).first()[0]
    assert parts.select(binary.checksum_total(binary.checksum_part(F.col("b"), F.col("at")))).first()[0] == whole
    assert parts.limit(0).select(binary.checksum_total(binary.checksum_part(F.col("b"), F.col("at")))).first()[0] == 0


def brute_function(rows):
    """Breakpoints by key as merged segments."""
    out = []
    for key in {r[0] for r in rows}:
        last = {}
        for _, at, v, t in sorted((r for r in rows if r[0] == key), key=lambda r: r[3]):
            last[at] = v
        order = sorted(last, key=lambda a: (a is not None, a or 0))
        kept = [a for i, a in enumerate(order) if i == 0 or last[order[i - 1]] != last[a]]
        out += [(key, a, kept[i + 1] if i + 1 < len(kept) else None, last[a]) for i, a in enumerate(kept) if last[a] is not None]
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [1, 7, 1000, None])
def test_segments_by_block(spark, width):
    """One key with most rows, a NULL key, a NULL place, undefined stretches over many blocks: as without blocks."""
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(60)] if rng.random() < 0.1 else range(60)), rng.choice([None, 5, 5, 5, 6]), k) for k in range(300)]
    rows += [(9, 0, 4, 0), (9, 55, 4, 1), (9, 59, 3, 2)]
    df = spark.createDataFrame(rows, "k int, at int, v int, t int")
    one = Lines.of_breaks(df, "at", "v", ("k",), ("t",), width=width)
    assert sorted((tuple(r) for r in one.df.collect()), key=str) == brute_function(rows)
    two = Lines.of_breaks(df.where("t % 3 = 0"), "at", "v", ("k",), ("t",), width=width)

    def value(segments, key, at):
        return next((v for k, a, z, v in segments if k == key and (a is None or a <= at) and (z is None or at < z)), None)

    s1, s2 = brute_function(rows), brute_function([r for r in rows if r[3] % 3 == 0])
    total = [tuple(r) for r in (one + two).df.collect()]
    points = spark.createDataFrame([(k, p) for k in (1, 2, 9, None, 77) for p in (None, 0, 13, 59, 99)], "k int, p int")
    for r in one.at(points, "p").collect():
        assert r.value == (None if r.p is None else value(s1, r.k, r.p))
    for k in (1, 2, 9, None):
        for p in range(60):
            a, b = value(s1, k, p), value(s2, k, p)
            assert value(total, k, p) == (None if a is None else a + (b or 0))
    assert all(x[3] != y[3] or x[2] != y[1] for k in (1, 2, 9, None) for x, y in zip(*(lambda z: (z, z[1:]))(sorted((t for t in total if t[0] == k), key=lambda t: (t[1] is not None, t[1] or 0))), strict=False))
    n = {r.k: r.n for r in one.split().groupBy("k").agg((F.max("segment") + 1).alias("n")).collect()}
    assert n == {k: sum(s[0] == k for s in s1) for k in n}
    edges = {k: sorted({x for s in s1 if s[0] == k for x in s[1:3] if x is not None}) for k in (1, 2, 9, None, 77)}
    for r in one.around(points, "p").collect():
        if r.p is not None:
            assert (r.left, r.right) == (max((e for e in edges[r.k] if e <= r.p), default=None), min((e for e in edges[r.k] if e > r.p), default=None))
    assert one.df.limit(0).count() == 0 and Lines.of_breaks(df.limit(0), "at", "v", ("k",), ("t",), width=width).df.count() == 0


def test_no_window_by_key_alone(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "k int, at int, v int, t int")
    one = Lines.of_breaks(df, "at", "v", ("k",), ("t",), width=5)
    for out in (one.df, (one + one).df, one.at(df.select("k", "at"), "at"), one.split()):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert all(scan.BLOCK in w for w in re.findall(r"windowspecdefinition\(([^)]*)", plan))


def test_runs_over_blocks(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", None]), x) for x in [*range(-50, 130), *range(200, 203), 400] if rng.random() < 0.97] * 2 + [("b", None)]
    got = groups.int_ranges(spark.createDataFrame(rows, "g string, x int"), "x", ("g",), width=8)
    want = []
    for g in ("a", None):
        xs = sorted({x for k, x in rows if k == g and x is not None})
        starts = [x for x in xs if x - 1 not in xs]
        want += [(g, s, next(x for x in range(s, 500) if x + 1 not in xs)) for s in starts]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
