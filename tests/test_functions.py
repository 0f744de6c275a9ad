import struct

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sparkloom import catalogue
from sparkloom.functions import binary, codecs, text
from sparkloom.functions.text import wrap_text
from sparkloom.operators import groups
from sparkloom.plans.prepared import Prepared, template
from sparkloom.sources import blocks, images, records, sections, xml
from sparkloom.sources.records import Field


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def b(hexed):
    return F.unhex(F.lit(hexed))


def test_binary(spark):
    r = one(spark, binary.uint_be(b("0102")), binary.uint_le(b("010203")), binary.int_be(b("FF")), binary.int_be(b("7F")), binary.bits(b("05")), binary.checksum32(b("0000000100000002FF")), F.hex(binary.pack_le(F.lit(258), 4)), binary.round_up(F.lit(9), 4), binary.delta_decode(F.array(F.lit(1), F.lit(2), F.lit(-5))), *binary.power_below(F.lit(37)))
    assert list(r) == [258, 197121, -1, 127, [1, 0, 1, 0, 0, 0, 0, 0], (3 + 0xFF000000) % 2**32, "02010000", 12, [1, 3, -2], 32, 5, 5]


def test_records(spark):
    data = lambda s, h="": F.concat(b(h), F.lit(s).cast("binary")) if h else F.lit(s).cast("binary")
    r = one(
        spark,
        records.decode(data("abcdefghij"), [Field("name", "char", 5), Field("type", "char", None)]),
        records.decode(data("abcdefghij", "03"), [Field("length", "uint", 1), Field("name", "char", "length", 1)]),
        records.decode(data("abcdefghij", "03"), [Field("length", "uint", 1), Field("name", "char", "length")]),
        records.decode(b("010203"), [Field("i", "uint", 3)]),
        records.union(F.lit(1), {0: F.lit("x"), 1: F.lit("y")}),
    )
    assert [tuple(x) for x in r] == [("abcde", "fghij"), (3, "ab"), (3, "abc"), (197121,), (None, "y")]


def test_codecs(spark):
    bits = codecs.bit_set(["a", "b", "c"])
    r = one(spark, bits.en(F.array(F.lit("a"), F.lit("c"), F.lit("c"))), bits.de(F.lit(5)), codecs.enum_int(["x", "y"]).en(F.lit("y")), codecs.enum_int(["x", "y"]).de(F.lit(9)), codecs.BOOL_BIN.de(b("07")), codecs.DATETIME_SQL.en(F.lit("2020-01-02 03:04:05.9").cast("timestamp_ntz")))
    assert list(r) == [5, ["a", "c"], 1, None, False, "2020-01-02 03:04:05"]


def test_text(spark):
    r = one(spark, text.display_width(F.lit("a中\tb")), text.coarse_width(F.lit("aé中")), text.human_number(F.lit(1536), iec=True), text.human_number(F.lit(-1500)), text.xml_escape(F.lit("<a&'\">")), text.missing_chars(F.lit("abca"), "ab"), text.dedent(F.lit("  a\n   b")), text.fill(F.lit("aa bb cc"), 5))
    assert list(r) == [4, 4, "1.50Ki", "-1.50k", "&lt;a&amp;&apos;&quot;&gt;", ["c"], "a\n b", "aa bb\ncc"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab ,(中。「", max_size=40), st.integers(4, 12))
def test_wrap_keeps_all_and_fits(s, width):
    lines = wrap_text(s, width)
    assert "".join(lines).replace(" ", "") == s.replace(" ", "")
    assert all(x and x == x.rstrip() for x in lines)


DOC = """##!# info .object as i
# note
name: x
size: 3:4

##!# grid .table ends E1 as
!id  !name  !greek letter
1    a      alpha
2    b      beta
!           more

left out

##!# deep .object_ex
a: 1
  b: 2
    c: 3
d: 4
"""


def test_sections(spark):
    s = sections.sections(spark.createDataFrame([(1, DOC)], "id int, text string"), "id").cache()
    assert [(r.ordinal, r.name, r.type, r.alias) for r in s.orderBy("ordinal").collect()] == [(0, "info", "object", "i"), (1, "grid", "table", None), (2, "deep", "object_ex", None)]
    assert sections.object_pairs(s.where("name = 'info'")).first().pairs == {"name": "x", "size": "3:4"}
    cells = sections.table_cells(s.where("name = 'grid'"))
    assert {(r.row, r.column): r.value for r in cells.collect()} == {(0, "id"): "1", (0, "name"): "a", (0, "greek letter"): "alpha", (1, "id"): "2\r\n", (1, "name"): "b\r\n", (1, "greek letter"): "beta\r\nmore"}
    assert sections.nested_json(s.where("name = 'deep'")).first().json == '{"a": {"": "1", "b": {"": "2", "c": "3"}}, "d": "4"}'


def test_a_condition_on_sections_is_asked_once_for_each(spark):
    """No condition that Spark moves down works a section's lines out again line by line, nor for sections of other types."""
    long = "##!# a .value ends E2\n" + "x: y\n\n" * 500 + "\nleft out: z\n\n##!# b .object ends E3\n" + "k: 1\n\n\nm: 2\n" * 2 + "\n\n\n\nn: 3"
    found = sections.sections(spark.createDataFrame([(1, long)], "id int, text string"), "id")
    pairs = sections.object_pairs(found.where("type = 'object'")).select(F.explode("pairs").alias("key", "value"))
    assert sorted(map(tuple, pairs.collect())) == [("k", "1"), ("m", "2")]
    bodies = found.where("body like '%y'").select("body")
    assert bodies.first().body == "x: y\n\n" * 499 + "x: y" and bodies.count() == 1
    conditions = lambda df: [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("+- ") if x.startswith("Filter")]
    assert conditions(pairs) and not any("lines" in x for x in conditions(pairs))
    assert sum(x.count("transform(") for x in conditions(bodies)) == 2  # marks of lines and lines of the body, side by side


def test_table_columns_begin_at_marks():
    assert sections.column_starts(["!id !name   !city"]) == [(0, "id"), (4, "name"), (12, "city")]
    assert sections.parse_table("!a !b\n1  2 3\n! x 4") == [{"row": 0, "col": 0, "name": "a", "value": "1\r\nx"}, {"row": 0, "col": 1, "name": "b", "value": "2 3\r\n4"}]


def test_repeated_fields(spark):
    r = one(spark, records.decode(F.concat(b("0203"), F.lit("abcdef!").cast("binary")), [Field("n", "uint", 1), Field("size", "uint", 1), Field("names", "char", "size", repeat="n"), Field("end", "char", None)]), records.decode(b("00FF"), [Field("n", "uint", 1), Field("x", "uint", 1, repeat="n"), Field("y", "uint", 1)]))
    assert [r[0].asDict(), r[1].asDict()] == [{"n": 2, "size": 3, "names": ["abc", "def"], "end": "!"}, {"n": 0, "x": [], "y": 255}]


def test_words_indents_and_units(spark):
    texts = ["word rest", "'a b' c", '"open', "", "12 x", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: None if r.w is None else tuple(r.w) for r in df.select("id", text.split_word(F.col("t")).alias("w")).collect()}
    assert got == {0: ("", "word", " rest"), 1: ("'", "a b", " c"), 2: ('"', "open", ""), 3: ("", "", ""), 4: ("", "", "12 x"), 5: None}
    import textwrap

    cases = ["  a\n   b\n\n  c", "\t x\n\ty", "a\n  b", "   ", " \n  z\n", "", "\t a\n  b"]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, t string")
    assert {r.id: r.d for r in df.select("id", text.dedent(F.col("t")).alias("d")).collect()} == {i: textwrap.dedent(t) for i, t in enumerate(cases)}
    r = one(spark, text.human_number(F.lit(2.5e24)), text.human_number(F.lit(3.0e21)), text.human_number(F.lit(2.0**80), iec=True))
    assert list(r) == ["2.50Y", "3.00Z", "1.00Yi"]


def test_delta_decode_is_linear(spark):
    df = spark.createDataFrame([(1, [1] * 50_000), (2, []), (3, None), (4, [5, None, 7])], "id int, a array<bigint>")
    got = {r.id: r.d for r in df.select("id", binary.delta_decode(F.col("a")).alias("d")).collect()}
    assert got[1] == list(range(1, 50_001)) and got[2] == [] and got[3] is None and got[4] == [5, None, None]


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    gif = b"GIF89a" + struct.pack("<HH", 3, 5)
    bmp = b"BM" + bytes(16) + struct.pack("<II", 7, 9)
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 20, 10) + bytes(9)
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate([png, gif, bmp, jpg, b"", b"\x89PNG\r\n\x1a\n"])], "id int, content binary")
    got = [(r.kind, r.width, r.height) for r in images.image_headers(df).orderBy("id").collect()]
    assert got == [("png", 640, 480), ("gif", 3, 5), ("bmp", 7, 9), ("jpeg", 10, 20), (None, None, None), ("png", None, None)]


def test_wrapped_lines_of_all_documents(spark, tmp_path):
    texts = {1: "one two " * 30, 2: "x" * 95 + " y", 3: "", 4: "中文" * 25, 5: "a\n\tb  c", 6: "no-break " + "w" * 40}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in catalogue.queries()["wrapped_lines"](spark, str(tmp_path)).collect()}
    assert got.keys() == texts.keys()
    width = lambda line: sum(1 if ord(c) < 256 else 2 for c in line)
    for i, text_ in texts.items():
        lines = got[i].filled.split("\n") if got[i].filled else []
        assert len(lines) == got[i].lines and "".join(got[i].filled.split()) == "".join(text_.split())
        assert all(0 < width(x) <= 40 for x in lines)
        # no line has room for the next one's first unit: a word, or a wide character
        for x, y in zip(lines, lines[1:]):
            unit = y[0] if ord(y[0]) > 255 else y.split()[0]
            assert width(x) + width(unit) + (ord(y[0]) < 256 and len(x) < 40) > 40
    assert [got[k].lines for k in (1, 2, 3, 4, 5, 6)] == [6, 3, 0, 3, 1, 2]


def test_jpeg_segments(spark):
    frame = lambda mark, h, w: bytes([0xFF, mark, 0, 17, 8]) + struct.pack(">HH", h, w) + bytes(10)
    part = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    thumb = b"Exif\0\0\xff\xd8" + frame(0xC0, 1, 2) + b"\xff\xd9"
    soi, scan = b"\xff\xd8", part(0xDA, bytes(6)) + bytes(50) + b"\xff\xd9"
    texts = [
        soi + part(0xE2, bytes(65000)) * 3 + frame(0xC0, 30, 40) + scan,  # behind the first 65,536 bytes
        soi + part(0xE1, thumb) + frame(0xC2, 50, 60) + scan,  # behind a thumbnail
        soi + part(0xC4, thumb) + b"\xff\xff\xff" + frame(0xC9, 70, 80) + scan,
        soi + part(0xFE, b"x") * 3000 + frame(0xC1, 9, 8),
        soi + part(0xE1, thumb) + scan + frame(0xC0, 1, 2),  # none before the scan
        soi + part(0xE1, thumb)[:-1],
        soi + frame(0xC0, 1, 2)[:8],
        soi + b"\xff\xe0\0\0" + frame(0xC0, 1, 2),
        soi + b"\xff",
    ]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(texts)], "id int, content binary")
    got = [(r.kind, r.width, r.height) for r in images.image_headers(df).orderBy("id").collect()]
    assert got[:4] == [("jpeg", 40, 30), ("jpeg", 60, 50), ("jpeg", 80, 70), ("jpeg", 8, 9)]
    assert got[4:] == [("jpeg", None, None)] * 5


def test_blocks_and_groups(spark):
    lines = spark.createDataFrame([("0000..007F; Basic",), ("# no",), ("0100..017F; More",)], "value string")
    known = blocks.parse_blocks(lines)
    assert blocks.block_of(spark.createDataFrame([("a",), ("é",), ("ā",), ("中",)], "c string"), "c", known).orderBy("c").select("name").collect() == [("Basic",), ("No_Block",), ("More",), ("No_Block",)]
    ints = spark.createDataFrame([(x,) for x in [1, 2, 3, 7, 8, 10, 15, 16, 17, 18, 40]], "x int")
    for width in (4, 8, 100):
        assert sorted(tuple(r) for r in groups.int_ranges(ints, "x", width=width).collect()) == [(1, 3), (7, 8), (10, 10), (15, 18), (40, 40)]
    edges = spark.createDataFrame([(1, None), (2, 1), (5, 1), (3, 2), (4, 2), (6, 5)], "child int, parent int")
    t = groups.tree_levels(edges, F.col("parent").isNull())
    assert [r.node for r in t.orderBy("depth", "path").collect()] == [1, 2, 5, 3, 4, 6] and [r.node for r in t.orderBy("path").collect()] == [1, 2, 3, 4, 5, 6]
    chain = spark.createDataFrame([(f"{'x' * 30}{k}", f"{'x' * 30}{k - 1}" if k else None) for k in range(130)], "child string, parent string")
    deep = groups.tree_levels(chain, F.col("parent").isNull())
    assert deep.agg(F.max("depth")).first()[0] == 129 and deep.select("path").distinct().count() == 130
    ring = spark.createDataFrame([(1, None), (2, 1), (3, 2), (2, 3)], "child int, parent int")
    with pytest.raises(ValueError):
        groups.tree_levels(ring, F.col("parent").isNull(), most=5)
    spans = spark.createDataFrame([(-50, -11, "low"), (-10, -1, "minus"), (0, 10**9, "wide"), (10**9 + 1, 10**9 + 2, "end")], "s long, e long, n string")
    spots = spark.createDataFrame([(x,) for x in (-51, -50, -11, -10, -1, 0, 5, 10**9, 10**9 + 1, 10**9 + 3, None)], "x long")
    for most in (500_000, 0):
        got = {r.x: r.n for r in groups.range_lookup(spots, "x", spans, "s", "e", "n", "-", most).collect()}
        assert got == {-51: "-", -50: "low", -11: "low", -10: "minus", -1: "minus", 0: "wide", 5: "wide", 10**9: "wide", 10**9 + 1: "end", 10**9 + 3: "-", None: "-"}
    assert groups.nice_step(97) == 20 and groups.bars([0, 1, 2], 1) == [" ▄█"]


def test_xml(spark):
    df = spark.createDataFrame([(1, 1, "a<"), (1, 2, None)], "g int, n int, t string")
    rows = xml.children(df, ["g"], xml.element("x", xml.text(F.col("t")), {"n": F.col("n")}), ["n"])
    assert rows.select(xml.element("g", F.col("xml"))).first()[0] == '<g><x n="1">a&lt;</x><x n="2"/></g>'


def test_xml_templates(spark):
    part = xml.read_template("""
    !doc      !shop         !day
    list
      (on)                  when
      [note]                remark
      item    %
        (no)  id
        price cents|whole
        [tag] tag
    """)
    assert [p.name for p in part.within] == ["on", "note", "item"] and part.elements[1].many
    df = spark.createDataFrame([([(1, 250, "a<b"), (2, 99, None)], ("mon", None)), ([], ("tue", "late"))], "shop array<struct<id:int,cents:int,tag:string>>, day struct<when:string,remark:string>")
    out = df.select(xml.rendered(part, {"shop": F.col("shop"), "day": F.col("day")}, {"whole": lambda c: F.ceil(c / 100)}).alias("x"))
    assert [r.x for r in out.collect()] == [
        '<list on="mon"><item no="1"><price>3</price><tag>a&lt;b</tag></item><item no="2"><price>1</price></item></list>',
        '<list on="tue"><note>late</note></list>',
    ]
    plain = xml.read_template("!t   !a\nxs\n x   %\n all @|size")
    assert one(spark, xml.rendered(plain, {"a": F.array(F.lit(1), F.lit(2))}, {"size": F.size}))[0] == "<xs><x>1</x><x>2</x><all>2</all></xs>"
    for bad in ("!t !a !b\nx k j", "!t !a\nx\ny", "!t !a"):
        with pytest.raises(ValueError):
            xml.read_template(bad.replace("x k j", "x  k  j"))


def test_prepared(spark):
    sql, defaults = template("select {columns} from {table} where id > /*%(low)s*/3 and 'it''s' <> /*%(w)s*/'it''s'")
    assert defaults == {"low": 3, "w": "it's"}
    q = Prepared(spark, sql, spark.range(10).toDF("id"), ["id"], defaults)
    assert q(low=7, w="x").count() == 2 and q().count() == 0
