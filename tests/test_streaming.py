from pyspark.sql import functions as F

from sparkloom.operators import dml
from sparkloom.streaming import lines


def test_upsert_and_counts(spark, tmp_path):
    src, at = tmp_path / "in", f"file://{tmp_path}"
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(str(src))
    table = dml.Snapshots(spark, f"{at}/t")

    def run():
        rows = lines.read_files(spark, str(src), "k int, v string")
        lines.upsert_into(rows, table, ["k"], {"v": dml.new("v")}, f"{at}/cp").awaitTermination()

    run()
    spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string").write.mode("append").parquet(str(src))
    run()
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_event_time(spark, tmp_path):
    spark.sql("select timestamp'2020-01-01 00:00:01' + make_dt_interval(0, 0, id) as at, id % 2 as k from range(6)").write.parquet(str(tmp_path / "e"))
    got = lines.counted(lines.read_files(spark, str(tmp_path / "e"), "at timestamp, k bigint"), "at", ["k"], "3 minutes", "1 minute")
    q = got.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.table("counted").collect()) == 6
    a = lines.answered(spark.createDataFrame([("x",)], "value string"), lambda c: F.upper(c))
    assert a.first().answer == "X"
