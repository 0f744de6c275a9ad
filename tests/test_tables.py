import pytest
from pyspark.sql import functions as F

from sparkloom.functions.expr import COUNT, SUM, func, null, this
from sparkloom.operators import dml, move, nested
from sparkloom.operators.dml import NotFoundError
from sparkloom.operators.table import Table
from sparkloom.plans.spec import group


@pytest.fixture(scope="module")
def abc(spark):
    return Table(spark.createDataFrame([(1, 2, None, "x"), (2, 2, 5, "y"), (3, 7, 5, None)], "a int, b int, c int, _h string"), ["a"], {"b": 9})


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_reads(abc):
    assert abc[::].columns == ["a", "b", "c"]
    assert values(abc["a", ("b",), {"c": 5}, ::]) == [(2, 2), (3, 7)]
    assert values(abc["a", {"c": null()}, ::]) == [(1,)]
    assert values(abc["a", this("c") != null(), this("b") > 2, ::]) == [(3,)]
    assert [r.a for r in abc["a", :2:("~a",)].collect()] == [3, 2]
    assert [r.a for r in abc["a", 1:1:("a",)].collect()] == [2]
    assert abc["a", :0:].count() == 0
    assert values(abc["b", COUNT("*").rename("n"), :: group("b")]) == [(2, 2), (7, 1)]
    assert values(abc[SUM((this("b") > 2) % (1, 0)).rename("n"), ::]) == [(1,)]
    assert values(abc[(this("b") / 0).rename("x"), {"a": 1}, ::]) == [(None,)]
    assert abc[{"a": 2}].b == 2
    for bad in ({"a": 9}, {"b": 2}):
        with pytest.raises(NotFoundError):
            abc[bad]
    assert abc.get({"a": 9}, "none") == "none"
    asked = {"a": 2}
    assert (abc >> asked).b == 2 and asked == {"a": 2, "b": 2, "c": 5}
    with pytest.raises(NotFoundError):
        abc >> {"a": 9}
    with pytest.raises(KeyError):
        abc[{"zz": 1}, ::]
    with pytest.raises(ValueError):
        func("x; drop")


def test_writes(abc, spark):
    more = abc << [{"a": 3, "c": 1}, {"a": 4, "c": 1}]
    assert values(more["a", "b", "c", ::]) == [(1, 2, None), (2, 2, 5), (3, 7, 5), (4, 9, 1)]
    up = abc.upsert({"a": 1, "c": 8}, {"c": dml.new("c"), "b": this("b") + 1})
    assert values(up["a", "b", "c", {"a": 1}, ::]) == [(1, 3, 8)]
    assert values(abc.replace({"a": 1})["a", "b", "c", {"a": 1}, ::]) == [(1, 9, None)]
    table, counts = abc.update({"b": this("b") + this("a")}, {"c": 5})
    assert values(table["a", "b", ::]) == [(1, 2), (2, 4), (3, 10)] and tuple(counts.first()) == (2, 2)
    table, counts = abc.delete(this("c") == 5, limit=1)
    assert values(table["a", ::]) == [(1,), (3,)] and counts.first().matched == 1
    with pytest.raises(KeyError):
        abc.delete({"zz": 1})


def test_shards_agree_with_one(spark):
    df = spark.range(100).select(F.col("id").cast("int").alias("a"), (F.col("id") % 3).cast("int").alias("b"))
    one = Table(df, ["a"])
    many = Table({str(k): df.where(F.col("b") == k) for k in range(3)}, ["a"], splitter=lambda r: [str(r["b"])] if "b" in r else ["0", "1", "2"])
    for index in (("a", {"b": 1}, slice(None)), ("b", COUNT("*").rename("n"), slice(None, None, group("b"))), ("a", slice(5, 10, ("~a",)))):
        assert values(many[index]) == values(one[index])
    plan = many.select(__import__("sparkloom.plans.spec", fromlist=["parse"]).parse(("a", {"b": 1}, slice(None))))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    with pytest.raises(dml.PlacementError):
        many.insert({"a": 500, "b": 7}, F.col("b").cast("string"))
    assert many.insert({"a": 500, "b": 2}, F.col("b").cast("string"))["a", {"b": 2}, ::].count() == 34


def test_aggregates_are_told_by_marks(abc):
    assert values(abc["a", (this("b").rename("h")), (func("concat")("sum(", this("b"))).rename("t"), ::]) == [(1, 2, "sum(2"), (2, 2, "sum(2"), (3, 7, "sum(7")]
    assert values(abc["a", (func("concat")(this("b"), "x") == "sum(x").expr().rename("h"), ::]) == [(1, 0), (2, 0), (3, 0)]
    assert values(abc[func("median")(this("b")).rename("m"), (func("max_by")(this("a"), this("b")) + 1).rename("n"), ::]) == [(2.0, 4)]
    assert values(abc[SUM(this("b")).running(("c",), ("a",)).rename("r"), "a", ::]) == [(2, 1), (2, 2), (9, 3)]
    for name in ("reflect", "java_method", "no_such_function_at_all"):
        with pytest.raises(ValueError):
            func(name)("a")


def test_conditions_over_other_tables(abc, spark):
    other = Table(spark.createDataFrame([(2, "u"), (2, "v"), (9, "w"), (None, "x")], "k int, n string"))
    assert values(abc["a", this("b").isin(other["k", ::]), ::]) == [(1,), (2,)]
    assert values(abc["a", this("b").isin(other["k", {"n": "w"}, ::]), ::]) == []
    assert abc.update({"c": 0}, {"a": 1})[1].first().matched == 1


def test_insert_contract(abc):
    after, n = abc.extend([{"a": 3}, {"a": 4}, {"a": 5}])
    assert n == 2 and after[::].count() == 5
    for bad in (lambda: abc << {"a": 1}, lambda: abc.__iadd__([{"a": 1}, {"a": 8}])):
        with pytest.raises(dml.NotInsertedError):
            bad()
    t = abc
    t += [{"a": 8}, {"a": 9}]
    assert t[::].count() == 5 and abc[::].count() == 3
    after, last = abc.append({"b": 1}, id_column="a")
    assert last == 4 and after[{"a": 4}].b == 1
    assert abc.append({"a": 2, "b": 1})[1] is None and abc.append({"a": 7})[1] == 7
    assert values(abc.set({"b": 0}, {"a": 2})["b", {"a": 2}, ::]) == [(0,)] and abc.remove({"a": 1})[::].count() == 2
    for bad in (lambda: abc.set({"b": 0}, {"a": 99}), lambda: abc.remove({"a": 99})):
        with pytest.raises(NotFoundError):
            bad()


def test_limits_over_shards(spark):
    df = spark.range(30).select(F.col("id").cast("int").alias("a"), (F.col("id") % 3).cast("int").alias("b"), F.lit(1).alias("v"))
    many = Table({str(k): df.where(F.col("b") == k) for k in range(3)}, ["a"])
    table, counts = many.delete(this("a") >= 3, limit=12)
    left = [r.a for r in table["a", ::].collect()]
    assert sorted(left) == sorted(x for x in range(30) if not (x >= 3 and x % 3 == 0 or x in (4, 7, 10))) and counts.first().matched == 12
    table, counts = many.update({"v": 2}, limit=11)
    assert sorted(r.a for r in table["a", {"v": 2}, ::].collect()) == sorted([*range(0, 30, 3), 1]) and tuple(counts.first()) == (11, 11)


def test_partitioned_shards(spark, tmp_path):
    from sparkloom.operators.table import hashed

    df = spark.range(50).select(F.col("id").cast("int").alias("a"), (F.col("id") % 5).cast("int").alias("b"))
    t = Table.by_column(df, hashed("a", 3), ["0", "1", "2"], key=["a"])
    t.save(f"file://{tmp_path}/t")
    back = Table.load(spark, f"file://{tmp_path}/t", key=["a"], splitter=lambda r: ["1"] if r.get("b") == 1 else ["0", "1", "2"])
    assert list(back.shards) == ["0", "1", "2"] and values(back["a", "b", ::]) == values(t["a", "b", ::]) == [(k, k % 5) for k in range(50)]
    one = back.select(__import__("sparkloom.plans.spec", fromlist=["parse"]).parse(("a", {"b": 1}, slice(None))))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_shard" in plan and plan.count("FileScan") == 1
    kept = Table.by_column(df, F.col("b"), [str(k) for k in range(5)], splitter=lambda r: [("2", this("a") > 20), "3"])
    assert values(kept["a", ::]) == sorted([(a,) for a in range(50) if a % 5 == 3 or (a % 5 == 2 and a > 20)])


def test_group_codec(spark):
    from sparkloom.functions.codecs import GroupCodec

    pair = GroupCodec(("x", "y"), ("_p",), lambda x, y: (x * 100 + y,), lambda p: (F.floor(p / 100).cast("int"), (p % 100).cast("int")))
    t = Table(spark.createDataFrame([(1, 203), (2, 304)], "k int, _p int"), ["k"], groups=[pair])
    assert t[::].columns == ["k", "x", "y"] and values(t[::]) == [(1, 2, 3), (2, 3, 4)] and t[{"x": 3, "y": 4}].k == 2
    assert values((t << {"k": 5, "x": 7, "y": 8})[::]) == [(1, 2, 3), (2, 3, 4), (5, 7, 8)]
    assert values(t.update({"x": 9, "y": 9}, {"k": 1})[0][::]) == [(1, 9, 9), (2, 3, 4)]
    with pytest.raises(ValueError):
        t.update({"x": 9}, {"k": 1})


def test_snapshots(spark, tmp_path):
    s = dml.Snapshots(spark, f"file://{tmp_path}/t")
    with pytest.raises(NotFoundError):
        s.read()
    first = s.publish(spark.range(3).toDF("a"))
    s.publish(dml.delete(s.read(), F.col("a") == 1).table)
    assert values(s.read()) == [(0,), (2,)] and values(s.read(first)) == [(0,), (1,), (2,)]


def test_ids(spark):
    base = spark.createDataFrame([(5,)], "id bigint")
    got = dml.with_ids(base, spark.range(20).repartition(3).toDF("x"), "id")
    assert sorted(r.id for r in got.collect()) == list(range(6, 26))


def test_move(spark):
    source = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (2, "b", 6)], "k int, n string, v int")
    target = spark.createDataFrame([(1, None, "z")], "key int, w double, n string")
    assert values(move.datamove(source, target, {"key": "k"}, "v > 0", key=("key",))) == [(2, None, "b")]
    with pytest.raises(KeyError):
        move.align(source, target, {"w": "nope"})


def test_nested(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], ["x"])], "id int, a array<int>, b array<string>")
    assert [tuple(r) for r in nested.grid(df, ["a", "b"]).orderBy("row").collect()] == [(0, "1", "1", "x"), (1, "", "2", ""), (2, "", "3", "")]
    assert nested.column_tree(df.schema) == ["id", "a", "b"]
    assert nested.smart_order(["url", "x", "user_id", "time", "id", "last-seen", "#", "b", "file_type", "name"]) == ["#", "id", "user_id", "name", "file_type", "b", "x", "url", "time", "last-seen"]
    deep = spark.createDataFrame([(1, '{"a": [{"b": {"c": [[1, {"d": null}]]}}], "e": {}}'), (2, "7"), (3, "no json"), (4, None)], "id int, j string")
    assert values(nested.leaves(deep, ["id"], "j")) == [(1, "a.[0].b.c.[0].[0]", "1"), (1, "a.[0].b.c.[0].[1].d", None), (2, "", "7")]
    assert values(nested.leaves(deep, ["id"], "j", depth=2).where("id = 1")) == [(1, "a.[0]", '{"b":{"c":[[1,{"d":null}]]}}')]
    js = spark.createDataFrame([(1, '{"a": {"b": 1}, "c": [2, 3], "d": "t"}')], "id int, j string")
    assert values(nested.leaves(js, ["id"], "j")) == [(1, "a.b", "1"), (1, "c.[0]", "2"), (1, "c.[1]", "3"), (1, "d", "t")]
    mine, other = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert values(nested.merge_keyed(mine, other, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert values(nested.merge_keyed(mine, other, ["k"], covered=False)) == [(2, "c"), (3, "d")]
    only = spark.createDataFrame([(1,), (3,)], "k int")
    assert values(nested.merge_keyed(mine, other, ["k"], only)) == [(1, "a"), (2, "b"), (3, "d")]
    assert values(nested.merge_keyed(mine, other, ["k"], only, covered=False)) == [(2, "b"), (3, "d")]
