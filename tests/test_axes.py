"""Stacks (axis 0) and rows (axis -1) against NumPy."""

import numpy as np
import pytest

import foldspark as fs
from foldspark import Policy, sources
from foldspark.operators.eager import value

NAN, INF = float("nan"), float("inf")


def along(spark, op, a, axis, policy=Policy.ALL, weights=None, **options):
    a = np.asarray(a)
    table = sources.stack(spark, a, axis, weights)
    found = value(table, op, "a", axis=axis, policy=policy, order_by="row", **({"weights": "w"} if weights is not None else {}), **options)
    rest = a.shape[1:] if axis == 0 else a.shape[:-1]
    shape = lambda x: x.reshape(*x.shape[:-1], *rest)
    return tuple(map(shape, found)) if isinstance(found, tuple) else shape(found)


def cube(dtype):
    a = np.random.default_rng(20250311).normal(0, 1, (7, 5, 4)).astype(dtype)
    a[0, 1, 2] = a[3, 0, 1] = np.nan
    return a


@pytest.mark.parametrize("axis", [0, -1])
@pytest.mark.parametrize("dtype", ["float64", "float32"])
def test_nan_aware(spark, axis, dtype):
    a = cube(dtype)
    for op, of in (("mean", np.nanmean), ("sum", np.nansum), ("min", np.nanmin), ("max", np.nanmax), ("median", np.nanmedian), ("std", np.nanstd)):
        assert along(spark, op, a, axis, Policy.SKIP_NAN) == pytest.approx(of(a, axis=axis), rel=1e-4, abs=1e-5), op
    found = along(spark, "percentile", a, axis, Policy.SKIP_NAN, q=[25, 50, 75])
    assert found == pytest.approx(np.nanpercentile(a.astype(float), [25, 50, 75], axis=axis), rel=1e-4, abs=1e-5)
    assert along(spark, "quantile", a, axis, Policy.SKIP_NAN, q=0.25) == pytest.approx(np.nanquantile(a.astype(float), 0.25, axis=axis), rel=1e-4, abs=1e-5)
    kind, table = "float" if dtype == "float32" else "double", sources.stack(spark, a, axis, np.ones(a.shape))
    types = {op: dict(fs.reduce(table, op, "a", axis=axis, **o).dtypes)["value"] for op, o in {"mean": {}, "minmax": {}, "var": {"return_mean": True}, "quantile": {"q": 0.5}, "average": {"weights": "w"}, "sum": {"weights": "w"}, "count_finite": {}}.items()}
    assert types == {"mean": kind, "minmax": f"struct<min:{kind},max:{kind}>", "var": f"struct<var:{kind},mean:{kind}>", "quantile": "double", "average": "double", "sum": "double", "count_finite": "bigint"}


@pytest.mark.parametrize("axis", [0, -1])
def test_plain(spark, axis):
    a = np.random.default_rng(20250311).normal(size=(6, 8))
    for op, of in (("mean", np.mean), ("sum", np.sum), ("min", np.min), ("max", np.max), ("median", np.median), ("var", np.var)):
        assert along(spark, op, a, axis) == pytest.approx(of(a, axis=axis)), op
    low, high = along(spark, "minmax", a, axis)
    assert (low == a.min(axis=axis)).all() and (high == a.max(axis=axis)).all()
    assert np.isnan(along(spark, "median", cube("float64"), axis)).sum() == 2


@pytest.mark.parametrize("axis", [0, -1])
def test_integer_moments(spark, axis):
    a = np.arange(24, dtype="int16").reshape(6, 4)
    var, mean = along(spark, "var", a, axis, ddof=1, return_mean=True)
    assert var == pytest.approx(a.var(axis=axis, ddof=1)) and mean == pytest.approx(a.mean(axis=axis))
    std, _ = along(spark, "std", a, axis, ddof=1, return_mean=True)
    assert std == pytest.approx(a.std(axis=axis, ddof=1))


def test_moments_at_the_edge(spark):
    var, mean = along(spark, "var", [[1, NAN], [3, NAN]], 0, Policy.SKIP_NAN, ddof=2, return_mean=True)
    assert np.isnan(var).all() and mean[0] == 2 and np.isnan(mean[1])
    a = 1e16 + np.array([[0.0, 4], [2, 6], [4, 8]])
    assert along(spark, "var", a, 0) == pytest.approx(a.var(axis=0), rel=1e-12)
    assert along(spark, "var", a.T.copy(), -1) == pytest.approx(a.var(axis=0), rel=1e-12)


def test_policies_by_position(spark):
    a = [[NAN, 3, INF, -INF], [1, NAN, 4, -5], [2, 0, -INF, NAN]]
    assert along(spark, "min", a, 0, Policy.FINITE).tolist() == [1, 0, 4, -5]
    assert along(spark, "max", a, 0, Policy.FINITE).tolist() == [2, 3, 4, -5]
    b = [[NAN, 3, INF, -INF], [1, NAN, 4, -5], [2, NAN, -INF, NAN]]
    assert along(spark, "mean", b, 0, Policy.FINITE).tolist() == [1.5, 3, 4, -5]
    assert along(spark, "sum", b, 0, Policy.FINITE).tolist() == [3, 3, 4, -5]
    low, high = along(spark, "minmax", [[NAN, 2.0], [NAN, 1.0]], 0, Policy.FINITE)
    assert np.isnan(low[0]) and low[1] == 1 and np.isnan(high[0]) and high[1] == 2
    c = np.array([[1, NAN, INF], [3, 5, 7], [INF, 9, 11]])
    assert along(spark, "mean", c, 0, Policy.FINITE).tolist() == [2, 7, 9]


@pytest.mark.parametrize("dtype", ["bool", "int8", "int16", "int32", "int64", "uint16", "uint64"])
@pytest.mark.parametrize("axis", [0, -1])
def test_exact_types(spark, dtype, axis):
    a = np.array([[[5, 1], [2, 7]], [[3, 4], [6, 0]], [[8, 9], [1, 2]]]).astype(dtype)
    for op, of in (("min", np.min), ("max", np.max)):
        assert (along(spark, op, a, axis).astype(dtype) == of(a, axis=axis)).all()
    middle = np.take(np.sort(a, axis=axis), (a.shape[axis] - 1) // 2, axis=axis)
    assert (along(spark, "lmedian", a, axis).astype(dtype) == middle).all()
    assert along(spark, "median", a, axis) == pytest.approx(np.median(a.astype(float), axis=axis))
    table = sources.stack(spark, a, axis)
    assert fs.lmedian(table, "a", axis).schema["value"].dataType == table.schema["a"].dataType.elementType


def test_weights(spark):
    a = np.arange(40, dtype=float).reshape(2, 5, 4)
    w = np.linspace(1, 2, 40).reshape(a.shape)
    for axis in (0, -1):
        assert along(spark, "average", a, axis, weights=w) == pytest.approx(np.average(a, axis=axis, weights=w))
        u = np.arange(1, a.shape[axis] + 1, dtype="int16")
        assert along(spark, "average", a.astype("uint16"), axis, weights=u) == pytest.approx(np.average(a, axis=axis, weights=u))
    found = along(spark, "average", [[1, NAN, INF], [3, 4, 6]], 0, Policy.FINITE, [1.0, 2])
    assert found == pytest.approx([7 / 3, 4, 6])
    both = {"return_sum_weights": True, "return_unweighted_sum": True}
    ws, sw, us = along(spark, "sum", [[1, NAN, 3], [4, 5, INF]], 0, Policy.FINITE, [2.0, 3], **both)
    assert (ws.tolist(), sw.tolist(), us.tolist()) == ([14, 15, 6], [5, 3, 2], [5, 5, 3])
    ws, sw, us = along(spark, "sum", np.array([[1, NAN, 3], [4, 5, INF]]).T, -1, Policy.FINITE, [2.0, 3], **both)
    assert (ws.tolist(), sw.tolist(), us.tolist()) == ([14, 15, 6], [5, 3, 2], [5, 5, 3])


def test_weight_errors(spark):
    with pytest.raises(ValueError, match="reduction axis"):
        sources.stack(spark, np.ones((2, 3)), 0, np.ones(4))
    for axis, w in ((0, np.zeros(2)), (-1, np.zeros(3))):
        with pytest.raises(ZeroDivisionError):
            along(spark, "average", np.ones((2, 3)), axis, weights=w)
    uneven = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<double>, w array<double>")
    for axis in (0, -1):
        with pytest.raises(Exception, match="same shape"):
            fs.average(uneven, "a", axis, weights="w").collect()


def test_other_axes(spark):
    table = sources.stack(spark, np.ones((2, 3)))
    with pytest.raises(NotImplementedError):
        fs.mean(table, "a", 1)
    with pytest.raises(ValueError):
        fs.mean(sources.vector(spark, [1.0]), "x", 0)
    with pytest.raises(ValueError):
        sources.stack(spark, 1.0)
    with pytest.raises(NotImplementedError):
        sources.stack(spark, np.ones((2, 3, 4)), 1)


def test_null_and_empty_rows(spark):
    table = spark.createDataFrame([(0, [1.0, None, 3.0]), (1, []), (2, None)], "row int, a array<double>")
    found = {r["row"]: r["value"] for r in fs.mean(table, "a", -1).collect()}
    assert found[0] == 2 and np.isnan(found[1]) and found[2] is None
    assert [r["value"] for r in fs.sum(table, "a", 0).orderBy("pos").collect()] == [1, 0, 3]


def test_whole_array_column(spark):
    a = cube("float64")
    assert value(sources.stack(spark, a), "mean", "a", policy=Policy.SKIP_NAN) == pytest.approx(np.nanmean(a))


def test_several_q_at_infinity(spark):
    a = [[1.0, 2.0, INF]]
    assert along(spark, "percentile", a, -1, q=100)[0] == INF
    assert np.isnan(along(spark, "percentile", a, -1, q=[50, 100])[1, 0])
