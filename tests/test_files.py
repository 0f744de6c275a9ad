"""Tables of files, writers at the same time, interrupted changes and copies; rows that no shard and no key tells apart."""

import threading

import pytest
from pyspark.sql import functions as F

from sparkloom import catalogue
from sparkloom.functions.expr import this
from sparkloom.operators import dml, move
from sparkloom.operators.files import ConflictError, FileTable
from sparkloom.operators.table import Table


def values(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).cast("int").alias("v"))
    yield FileTable.create(spark, f"file://{tmp_path}/t", rows, ["k"], defaults={"v": 9})
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_key_rewrites_one_file(spark, table):
    before = {r.file for r in table.files().collect()}
    assert len(before) > 2 and values(table.read()) == [(k, k % 7) for k in range(100)]
    assert table.update({"v": this("v") + 50}, {"k": 41}) == {"matched": 1, "changed": 1}
    after = {r.file for r in table.files().collect()}
    assert len(before - after) == len(after - before) == 1
    assert values(table.read()) == [(k, k % 7 + 50 * (k == 41)) for k in range(100)] and values(table.read(0)) == [(k, k % 7) for k in range(100)]
    assert table.update({"v": 1}, {"k": 1000}) == {"matched": 0, "changed": 0} and table.update({"v": 41 % 7 + 50}, {"k": 41}) == {"matched": 1, "changed": 0}
    assert table.delete(this("k") < 90) == {"matched": 90, "changed": 90} and table.read().count() == 10
    assert table.delete() == {"matched": 10, "changed": 10} and values(table.read()) == [] and table.read().columns == ["k", "v"]
    assert table.extend(spark.range(2).toDF("k")) == {"inserted": 2} and values(table.read()) == [(0, 9), (1, 9)]


def test_keys_that_are_there_and_new_ones(spark, table):
    rows = spark.createDataFrame([(3, 30), (3, 31), (200, 1), (None, 5)], "k bigint, v int")
    files = {r.file for r in table.files().collect()}
    assert table.extend(rows)["inserted"] == 2 and files <= {r.file for r in table.files().collect()}
    table.upsert(rows.where("k is not null"), {"v": dml.new("v")})
    got = dict((k, v) for k, v in values(table.read().where("k is not null")))
    assert got[3] == 30 and got[200] == 1 and len(got) == 101 and table.read().where("k is null").count() == 1
    table.replace(spark.createDataFrame([(4,)], "k bigint"))
    assert values(table.read().where("k = 4")) == [(4, 9)]
    with pytest.raises(ConflictError):
        FileTable.create(spark, table.path, table.read(), ["k"])


def test_an_upsert_of_keys_whose_negatives_are_there(spark, tmp_path):
    """Keys 0, of both signs, NULL and equal ones, and rows of no segment: as in the query's SQL."""
    rows = [(0, "a", 1, 1.0, "BUILDING"), (1, "b", 1, 2.0, "BUILDING"), (-1, "c", 2, 3.0, "FURNITURE"), (-2, "d", 2, 4.0, "BUILDING"), (2, "e", 2, 5.0, "BUILDING"), (None, "f", 3, 6.0, "BUILDING")]
    rows += [(None, "g", 3, None, "BUILDING"), (7, "h", 4, 7.0, "BUILDING"), (7, "h", 4, 7.0, "BUILDING"), (7, None, 4, 8.0, "FURNITURE"), (8, "i", 5, 9.0, None)]
    customer = spark.createDataFrame(rows, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    customer.write.parquet(f"{tmp_path}/customer.parquet")
    want = spark.sql(catalogue.oracle_sql()["file_upsert"].replace("from customer", "from {customer}"), customer=customer)
    got = catalogue.queries()["file_upsert"](spark, str(tmp_path))
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 18


def test_two_writers_lose_nothing(spark, table):
    """Both begin at one version; the one that comes late goes on from the other's."""
    meet, first = threading.Barrier(2, timeout=60), {}
    publish = FileTable._publish

    def late(self, n, files, schema):
        if threading.get_ident() not in first:  # both have read and written before either publishes
            first[threading.get_ident()] = n
            meet.wait()
        return publish(self, n, files, schema)

    errors = []

    def run(lo):
        try:
            mine = FileTable(spark, table.path, ["k"])
            mine.upsert(spark.range(lo, lo + 20).select(F.col("id").alias("k"), F.lit(lo).alias("v")), {"v": dml.new("v")})
        except Exception as e:
            errors.append(e)

    FileTable._publish = late
    try:
        threads = [threading.Thread(target=run, args=(lo,)) for lo in (90, 95)]
        [t.start() for t in threads]
        [t.join() for t in threads]
    finally:
        FileTable._publish = publish
    assert not errors and set(first.values()) == {1} and table.versions() == [0, 1, 2]
    got = dict(values(table.read()))
    assert sorted(got) == list(range(115)) and got[90] == 90 and got[114] == 95 and all(got[k] == k % 7 for k in range(90))


def test_an_interrupted_change_leaves_the_version_before(spark, table, monkeypatch):
    monkeypatch.setattr(FileTable, "_publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        table.delete({"k": 5})
    monkeypatch.undo()
    assert table.read().count() == 100 and table.versions() == [0] and table.delete({"k": 5})["matched"] == 1
    monkeypatch.setattr(FileTable, "_publish", lambda *a: False)
    with pytest.raises(ConflictError):
        FileTable(spark, table.path, ["k"], tries=2).delete({"k": 6})


def test_a_stopped_copy_goes_on(spark, tmp_path):
    rows = spark.range(200).select(F.when(F.col("id") % 20 > 0, F.col("id")).alias("k"), F.lit("x").alias("v"))
    copy = move.Copy(spark, f"file://{tmp_path}/c")
    assert copy.rows().count() == 0
    n = copy.run(rows, "k", 5, most=2)
    assert n == 5 and copy.progress().count() == 2 and 0 < copy.rows().count() < 200
    again = move.Copy(spark, f"file://{tmp_path}/c")
    assert again.run(rows, "k", 9) == 5 and values(again.rows().fillna(-1)) == values(rows.fillna(-1))
    assert sum(r.rows for r in again.progress().collect()) == 200 and again.run(rows, "k") == 5


def test_rows_of_no_shard_stay(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, None, 1), (4, "z", 1)], "k int, s string, v int")
    t = Table.by_column(df, F.col("s"), ["a", "b"], key=["k"])
    for after, want in ((t.update({"v": 2}, {"k": 1})[0], 4), (t.delete({"k": 3})[0], 3), (t.insert({"k": 9, "s": "a", "v": 1}, F.col("s")), 5), (t.replace({"k": 1, "s": "a", "v": 7}, F.col("s")), 4), (t.upsert({"k": 1, "s": "a"}, {"v": 8}, F.col("s")), 4)):
        assert after[::].count() == want and list(after.shards) == ["a", "b", None] and after.whole is not None
        assert after.df()._jdf.queryExecution().optimizedPlan().toString().count("Union") <= 1
    after, counts = t.update({"v": 5}, limit=3)
    assert values(after["k", "v", ::]) == [(1, 5), (2, 5), (3, 5), (4, 1)] and tuple(counts.first()) == (3, 3)
    with pytest.raises(dml.PlacementError):
        t.insert({"k": 9, "s": "z", "v": 1}, F.col("s"))
    t.save(f"file://{tmp_path}/t")
    back = Table.load(spark, f"file://{tmp_path}/t", key=["k"])
    assert values(back.delete({"k": 1})[0]["k", ::]) == [(2,), (3,), (4,)]
    more, n = t.extend([{"k": 1, "s": "a", "v": 0}, {"k": 8, "s": "b", "v": 0}], F.col("s"))
    assert n == 1 and more[::].count() == 5


def test_limits_with_equal_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "d")], "k int, v string")
    after = dml.update(df, {"v": "x"}, F.lit(True), 3, ("k",))
    assert values(after.table.fillna(-1)) == [(-1, "x"), (-1, "x"), (1, "a"), (1, "b"), (1, "x"), (2, "c")] and after.counts.first().matched == 3
    after = dml.delete(df, F.col("k") == 1, 1, ("k",))
    assert values(after.table.fillna(-1)) == [(-1, "d"), (-1, "d"), (1, "a"), (1, "b"), (2, "c")] and after.counts.first().matched == 1
    assert dml.delete(df, F.lit(True), 0, ("k",)).table.count() == 6
    two = Table({"x": df, "y": df}, ["k"])
    assert two.delete({"v": "a"}, limit=3)[0][::].count() == 9
