"""Headers of image files, read as ``binaryFile`` rows and decoded by built-in binary functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.binary import uint_be, uint_le

#: The first bytes of each format, in hex.
MAGIC = (("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("gif", "47494638"), ("bmp", "424D"))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def image_kind(content: Column) -> Column:
    out = None
    for name, magic in MAGIC:
        hit = F.hex(F.substring(content, 1, len(magic) // 2)) == magic
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def _jpeg_size(content: Column) -> tuple[Column, Column]:
    """From the first frame header (SOF) of the segments, which are walked by their lengths as far as the first scan; what lies
    inside a segment, such as a thumbnail, isn't looked at.  NULL where the segments break off or lead to no frame header."""
    state = "struct<at:int,width:bigint,height:bigint,done:boolean>"
    end = F.octet_length(content)

    def step(s: Column) -> Column:
        h = F.hex(F.substring(content, s["at"], F.lit(9)))
        mark = F.substring(h, 3, 2)
        number = lambda at: F.conv(F.substring(h, at, 4), 16, 10).cast("bigint")
        to = lambda at: F.struct(at.cast("int"), F.lit(None), F.lit(None), F.lit(False)).cast(state)
        stop = F.struct(s["at"], F.lit(None), F.lit(None), F.lit(True)).cast(state)
        frame = F.struct(s["at"], number(15), number(11), F.lit(True)).cast(state)
        return (
            F.when((F.length(h) < 4) | (F.substring(h, 1, 2) != "FF"), stop)
            .when(mark == "FF", to(s["at"] + 1))  # a fill byte
            .when(mark.rlike("^(?:01|D[0-8])$"), to(s["at"] + 2))  # marks without a segment
            .when(mark.rlike("^C[0-35-79A-BD-F]$"), F.when(F.length(h) == 18, frame).otherwise(stop))
            .when(mark.isin("D9", "DA") | (F.length(h) < 8) | (number(5) < 2) | (s["at"] + number(5) > end), stop)
            .otherwise(to(s["at"] + 2 + number(5)))
        )

    # each step goes on by a byte at least, so these are enough, in rounds of which those after the end do nothing
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.sqrt(end)).cast("int")))
    walk = lambda s: F.aggregate(steps, s, lambda t, _: F.when(t["done"], t).otherwise(step(t)))
    start = F.struct(F.lit(1), F.lit(None), F.lit(None), F.lit(False)).cast(state)
    found = F.aggregate(steps, start, lambda s, _: F.when(s["done"], s).otherwise(walk(s)))
    return found["width"], found["height"]


def image_headers(files: DataFrame, content: str = "content") -> DataFrame:
    """files with kind, width and height; NULL where the bytes are none of the formats, too short, or a JPEG
    without a frame header."""
    c = F.col(content)
    part = lambda a, n: F.when(F.octet_length(c) >= a + n - 1, F.substring(c, a, n))
    kind = image_kind(c)
    jw, jh = _jpeg_size(c)
    width = F.when(kind == "png", uint_be(part(17, 4))).when(kind == "gif", uint_le(part(7, 2))).when(kind == "bmp", uint_le(part(19, 4))).when(kind == "jpeg", jw)
    height = F.when(kind == "png", uint_be(part(21, 4))).when(kind == "gif", uint_le(part(9, 2))).when(kind == "bmp", uint_le(part(23, 4))).when(kind == "jpeg", jh)
    return files.withColumns({"kind": kind, "width": width, "height": height})
