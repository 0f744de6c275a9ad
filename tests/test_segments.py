from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from sparkloom.operators.segments import Lines


def line(spark, breaks, kind="double"):
    return Lines.of_breaks(spark.createDataFrame([(1, float(k), v) for k, v in breaks.items()], f"g int, k double, v {kind}"), "k", "v", ("g",))


def rows(lines):
    return [(r.start, r.end, r.value) for r in lines.df.orderBy("start").collect()]


def at(breaks, x):
    below = [k for k in breaks if k <= x]
    return breaks[max(below)] if below else None


def test_lookup_clip_delete(spark):
    letters = line(spark, {0: "A", 20: "B", 25: "C"}, "string")
    points = spark.createDataFrame([(1, -1.0), (1, 1.0), (1, 22.0)], "g int, x double")
    assert [(r.x, r.value, r.segment) for r in letters.at(points, "x").orderBy("x").collect()] == [(-1, None, None), (1, "A", 0), (22, "B", 1)]
    assert rows(letters.clip(7.0, 22.0)) == [(7, 20, "A"), (20, 22, "B")]
    assert rows(letters.clip(7.0)) == [(7, 20, "A"), (20, 25, "B"), (25, None, "C")]
    assert rows(letters.delete(15.0, 27.0)) == [(0, 15, "A"), (27, None, "C")]
    assert rows(letters.set(15.0, 22.0, "D")) == [(0, 15, "A"), (15, 22, "D"), (22, 25, "B"), (25, None, "C")]


def test_around(spark):
    a = line(spark, {0: 5.0, 10: 15.0, 20: 10.0}).clip(None, 30.0)
    points = spark.createDataFrame([(1, -1.0), (1, 0.0), (1, 9.0), (1, 10.0), (1, 30.0), (1, None), (2, 3.0)], "g int, x double")
    assert {(r.g, r.x): (r.left, r.right) for r in a.around(points, "x").collect()} == {(1, -1): (None, 0), (1, 0): (0, 10), (1, 9): (0, 10), (1, 10): (10, 20), (1, 30): (30, None), (1, None): (None, None), (2, 3): (None, None)}


def test_breaks_with_ties_and_nulls(spark):
    """An overlay takes breakpoints as they are: of one place the last counts, NULL is undefined."""
    rows_ = [(1, 0.0, 1.0, 1), (1, 0.0, 2.0, 2), (1, 5.0, None, 3), (1, 5.0, 9.0, 2), (1, 7.0, 2.0, 4)]
    a = Lines.of_breaks(spark.createDataFrame(rows_, "g int, k double, v double, t int"), "k", "v", ("g",), ("t",))
    b = line(spark, {2: 1.0})
    assert rows(a) == [(0, 5, 2), (7, None, 2)]
    assert rows(a + b) == [(0, 2, 2), (2, 5, 3), (7, None, 3)] == rows(Lines(a.df, a.by) + Lines(b.df, b.by))


def test_overlays(spark):
    a, b = line(spark, {0: 5.0, 10: 15.0, 20: 10.0}), line(spark, {5: 10.0, 15: 20.0, 25: 15.0})
    assert rows(a + b) == [(0, 5, 5), (5, 10, 15), (10, 15, 25), (15, 20, 35), (20, 25, 30), (25, None, 25)]
    assert rows(a - b) == [(0, 5, 5), (5, 10, -5), (10, 15, 5), (15, 20, -5), (20, 25, -10), (25, None, -5)]
    assert rows(a.stripby(b)) == [(5, 10, 5), (10, 20, 15), (20, None, 10)]
    assert rows(a.diff(a + b)) == [(5, 10, 5), (10, 20, 15), (20, None, 10)]
    assert rows(b.merge(a)) == [(0, 5, 5), (5, 15, 10), (15, 25, 20), (25, None, 15)]
    assert a.count().first().segments == 3
    assert a.clip(0.0, 25.0).integral().first().integral == 250
    assert a.clip(0.0, 25.0).measure().first().measure == 25
    assert rows(a + 1) == [(0, 10, 6), (10, 20, 16), (20, None, 11)]
    assert (a.bounds().first().left, a.bounds().first().right) == (0, None)
    assert a.continuity().first().continuous and not a.delete(3.0, 4.0).continuity().first().continuous
    assert a.complete(0.0, 30.0).first().complete and not a.complete(-1.0, 30.0).first().complete
    assert a.same(a.sharded([4.0, 12.0]).joined())


def test_zip_pairs(spark):
    a, b = line(spark, {0: 1.0}), line(spark, {2: 2.0})
    assert [(s, tuple(v)) for s, _, v in rows(a.zip(b))] == [(2, (1, 2))]
    assert [(s, tuple(v)) for s, _, v in rows(a.xzip(b))] == [(0, (1, None)), (2, (1, 2))]


def test_quadrature(spark):
    got = line(spark, {0: 1.0, 2: 3.0}).clip(0.0, 4.0).quadrature(lambda x, v: x * v, 0.5).first().integral
    want = sum(0.5 * (k * 0.5) * (1 if k < 4 else 3) for k in range(8))
    assert abs(got - want) < 1e-9


breaks = st.dictionaries(st.integers(0, 12), st.integers(0, 3).map(float), min_size=1, max_size=5)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(breaks, breaks)
def test_overlay_is_pointwise(spark, a, b):
    both = line(spark, a).overlay(line(spark, b), lambda x, y: F.coalesce(x, F.lit(-1.0)) * 10 + F.coalesce(y, F.lit(-1.0)))
    points = spark.createDataFrame([(1, x / 2) for x in range(-2, 28)], "g int, x double")
    for r in both.at(points, "x").collect():
        x, y = at(a, r.x), at(b, r.x)
        want = None if r.x < min([*a, *b]) else (-1 if x is None else x) * 10 + (-1 if y is None else y)
        assert r.value == want
    values = [v for _, _, v in rows(both)]
    assert all(p != q for p, q in zip(values, values[1:]))
