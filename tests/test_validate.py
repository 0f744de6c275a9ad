import json

import pytest

from sparkloom.functions.validate import CheckError, Checker, errors, replacer
from pyspark.sql import functions as F

CASES = [
    ("number(>17)", 18, True), ("number(>17)", 3, False), ("number(>17)", 17, False), ("number(-60)", 60, True), ("number(-60)", 61, False),
    ("number(+3)", 3, True), ("number", 1.5, False), ("number", "1", False), ("number(7)", 7, True), ("number(<7)", 7, False),
    ("string(+5)", "four", False), ("string(+5)", "fives", True), ("string(+5)", "longer", True), ("string", 1, False), (".a", "a", True), ('"a b"', "a b", True), (".a", "b", False),
    ("hex", "0aF", True), ("hex", "xyz", False), ("ascii", "abc", True), ("ascii", "é", False), ("alnum", "a1", True), ("alnum", "a-1", False),
    ("bool", True, True), ("bool", 0, False), ("null", None, True), ("null", 1, False), ("any", [1], True),
    ("array(3, string(1))", ["x", "y", "z"], True), ("array(3, string(1))", ["x", "y", "zz"], False), ("array(2)", [1, 2, 3], False),
    ("array(.red, #.green)", ["red", "green"], True), ("array(.red, #.green)", [], False), ("array(.red, #.green)", ["green", "green"], True), ("array(.red, #.green)", ["red"], False),
    ("object(.on:bool, #.who:string, string:number)", {"on": 1, "who": "me"}, False), ("object(.on:bool, #.who:string, string:number)", {"who": "me"}, True),
    ("object(.on:bool, #.who:string, string:number)", {"who": 5}, False), ("object(.on:bool, #.who:string, string:number)", {"who": "me", "left": 12}, True),
    ("object(.a:bool)", {"z": True}, False), ("set(number)", [1, 2], True), ("set(number)", [1, 1], False), ("number | null", None, True), ("number | .x", "x", True),
    ("array(object(#.k: array(number)))", [{"k": [1, 2]}, {"k": []}], True), ("array(object(#.k: array(number)))", [{"k": [1, "2"]}], False),
]


def test_truth_table(spark):
    row = spark.createDataFrame([tuple(json.dumps(v) for _, v, _ in CASES)], [f"c{i}" for i in range(len(CASES))])
    got = row.select(*[Checker(code).json(F.col(f"c{i}")).alias(f"c{i}") for i, (code, _, _) in enumerate(CASES)]).first()
    wrong = [(c, v, got[i]) for i, (c, v, want) in enumerate(CASES) if got[i] is not want]
    assert not wrong


def test_typed_and_own(spark):
    df = spark.createDataFrame([(1, "ab", [1, 2], {"x": 1}), (None, None, None, None)], "n int, s string, a array<int>, m map<string,int>")
    cols = [Checker("number(>0)")(F.col("n"), "int"), Checker("string(2)")(F.col("s"), "string"), Checker("array(2, number)")(F.col("a"), "array<int>"), Checker("object(#.x: number)")(F.col("m"), "map<string,int>"), Checker("even", {"even": lambda c: c % 2 == 0})(F.col("n"), "int"), Checker("null")(F.col("n"), "int")]
    assert [list(r) for r in df.select(*[c.alias(str(i)) for i, c in enumerate(cols)]).collect()] == [[True, True, True, True, False, False], [False, False, False, False, False, True]]
    out = df.select(errors({"n": cols[0], "s": F.col("s") == "zz"}).alias("e"), replacer(cols[0], F.col("n"), -1).alias("r")).collect()
    assert [(r.e, r.r) for r in out] == [(["s"], 1), (["n", "s"], -1)]


def test_failures(spark):
    code = "object(#.who: string(+2), .tags: array(string | number(>5)), .in: object(#.x: bool))"
    cases = {
        '{"who": "me", "tags": ["a", 6]}': [],
        '{"who": "m", "tags": ["a", 3, true]}': ["$.who: \"m\" is not string(+2)", "$.tags[1]: 3 is not string or number(>5)", "$.tags[2]: true is not string or number(>5)"],
        '{"tags": 7, "zz": 1}': ["$.tags: 7 is not array", "$.zz: no such key", "$: 'who' is missing"],
        '{"who": "ab", "in": {"x": "a long one"}}': ["$.in.x: \"a long... is not bool"],
        "[1]": ["$: [1] is not object"],
        "no json": ["$: no json is not JSON"],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*cases, None])], "id int, t string")
    got = [r.w for r in df.select("id", Checker(code).failures(F.col("t")).alias("w")).orderBy("id").collect()]
    assert [sorted(x) for x in got] == [sorted(x) for x in [*cases.values(), ["$: NULL is not JSON"]]]


@pytest.mark.parametrize("code", ["number(", "object(.a:)", "number)", "%", "array(,)"])
def test_errors(code):
    with pytest.raises(CheckError):
        Checker(code)


def test_unknown_type(spark):
    with pytest.raises(CheckError):
        Checker("wat").json(F.lit("1"))
