"""Whole columns against NumPy: policies, types, weights, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import foldspark as fs
from foldspark import Policy, sources
from foldspark.operators.eager import value

NAN, INF = float("nan"), float("inf")
PLAIN = {"mean": np.mean, "sum": np.sum, "min": np.min, "max": np.max, "median": np.median}
SKIPPING = {"mean": np.nanmean, "sum": np.nansum, "min": np.nanmin, "max": np.nanmax, "median": np.nanmedian}
INTEGERS = ["int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64"]


def reduced(spark, op, a, policy=Policy.ALL, weights=None, **options):
    table = sources.vector(spark, a, weights)
    return value(table, op, "x", policy=policy, **({"weights": "w"} if weights is not None else {}), **options)


def noisy(dtype="float64"):
    a = np.random.default_rng(20250311).normal(1000, 30, 2000).astype(dtype)
    a[::97] = np.nan
    a[3], a[7] = np.inf, -np.inf
    return a


@pytest.mark.parametrize("dtype", ["float64", "float32"])
def test_clean_and_noisy(spark, dtype):
    rng = np.random.default_rng(20250311)
    a = rng.normal(size=257).astype(dtype)
    w = rng.uniform(0.5, 1.5, 257).astype(dtype)
    table = sources.vector(spark, a, w).persist()
    for op, of in PLAIN.items():
        assert value(table, op, "x") == pytest.approx(float(of(a.astype("float64"))), rel=1e-5), op
    for op, of in (("var", np.var), ("std", np.std)):
        assert value(table, op, "x", ddof=1) == pytest.approx(of(a.astype("float64"), ddof=1), rel=1e-5)
    assert value(table, "average", "x", weights="w") == pytest.approx(np.average(a.astype("float64"), weights=w), rel=1e-5)
    b = noisy(dtype)
    finite = b[np.isfinite(b)].astype("float64")
    table = sources.vector(spark, b).persist()
    for op, of in PLAIN.items():
        assert value(table, op, "x", policy=Policy.FINITE) == pytest.approx(float(of(finite)), rel=1e-5), op
    assert value(table, "percentile", "x", q=[16, 50, 84], policy=Policy.FINITE) == pytest.approx(np.percentile(finite, [16, 50, 84]), rel=1e-5)
    assert value(table, "count_finite", "x") == len(finite)


@pytest.mark.parametrize("values", [[1, NAN, 2], [NAN, 1, 2], [2, 1, NAN]])
def test_nan_propagates_wherever_it_stands(spark, values):
    for op in ("min", "max", "median", "mean", "sum"):
        assert np.isnan(reduced(spark, op, values)), op
    assert np.isnan(reduced(spark, "minmax", values)).all()
    assert np.isnan(reduced(spark, "percentile", values, q=[10, 90])).all()
    assert reduced(spark, "minmax", values, Policy.SKIP_NAN) == (1, 2)


def test_infinity(spark):
    a = [1.0, 2.0, INF]
    assert reduced(spark, "mean", a, Policy.SKIP_NAN) == INF
    assert reduced(spark, "mean", a, Policy.FINITE) == 1.5
    assert reduced(spark, "median", a, Policy.SKIP_NAN) == 2
    assert reduced(spark, "min", [-INF, 1.0]) == -INF
    assert reduced(spark, "max", [1.0, -INF]) == 1
    assert reduced(spark, "minmax", [1.0, INF, -2.0], Policy.FINITE) == (-2, 1)
    assert np.isnan(reduced(spark, "sum", [INF, -INF]))
    var, mean = reduced(spark, "var", [1.0, INF], return_mean=True)
    assert np.isnan(var) and mean == INF
    assert reduced(spark, "count_finite", [1.0, NAN, INF, 2.0, -INF]) == 2


def test_empty_and_all_skipped(spark):
    for a, policy in (([], Policy.ALL), ([NAN, NAN], Policy.SKIP_NAN), ([INF, INF], Policy.FINITE)):
        a = np.array(a, dtype=float)
        for op in ("mean", "min", "max", "median", "var", "std", "lmedian"):
            assert np.isnan(reduced(spark, op, a, policy)), (op, policy)
        assert reduced(spark, "sum", a, policy) == 0
        assert np.isnan(reduced(spark, "percentile", a, policy, q=50))
    assert reduced(spark, "min", [INF, INF], Policy.SKIP_NAN) == INF
    assert reduced(spark, "count_finite", [NAN, NAN]) == 0


@pytest.mark.parametrize("dtype", [*INTEGERS, "bool"])
def test_exact_types(spark, dtype):
    a = np.array([1, 5, 2, 8, 3, 13, 21]).astype(dtype)
    table = sources.vector(spark, a)
    assert value(table, "min", "x") == a.min().item() and value(table, "max", "x") == a.max().item()
    assert value(table, "lmedian", "x") == sorted(a.tolist())[3]
    assert type(value(table, "lmedian", "x")) is type(table.first()["x"])
    assert value(table, "mean", "x") == pytest.approx(a.astype(float).mean(), rel=1e-12)
    assert value(table, "median", "x") == np.median(a.astype(float))
    assert value(table, "sum", "x") == a.astype(float).sum()
    assert value(table, "std", "x", ddof=1) == pytest.approx(a.astype(float).std(ddof=1), rel=1e-12)
    assert value(table, "count_finite", "x") == 7


def test_lower_median_keeps_64_bits(spark):
    a = np.array([2**62 + 1, 2**62 + 3, 2**62 + 5, 2**62 + 7])
    assert reduced(spark, "lmedian", a) == 2**62 + 3
    assert reduced(spark, "lmedian", np.array([2**64 - 1, 2**64 - 2], dtype="uint64")) == 2**64 - 2


def test_far_from_zero(spark):
    assert reduced(spark, "var", [1e16, 1e16 + 2, 1e16 + 4]) == pytest.approx(8 / 3, rel=1e-9)
    for offset in (0, 1e3, 1e6, 1e8):
        a = np.array([0, 2, 4, 6, 8]) + offset
        assert reduced(spark, "var", a) == pytest.approx(a.var(), rel=1e-9)
        assert reduced(spark, "var", a.astype("float32")) == pytest.approx(a.astype("float32").astype("float64").var(), rel=1e-4)
    table = sources.vector(spark, [1e16, 1e16 + 2, 1e16 + 4]).withColumn("g", F.lit(None).cast("string"))
    assert fs.var(table, "x", by="g", ddof=1).collect()[0]["value"] == pytest.approx(4.0)


def test_ddof(spark):
    var, mean = reduced(spark, "var", [1.0, 3.0], ddof=2, return_mean=True)
    assert np.isnan(var) and mean == 2
    with pytest.raises(ValueError):
        reduced(spark, "var", [1.0], ddof=-1)
    assert reduced(spark, "var", np.arange(10.0), ddof=3, one_pass=True) == pytest.approx(np.var(np.arange(10), ddof=3))


def test_weights(spark):
    x, w = [1.0, 2, 5, 9], [1.0, 0.5, 2, 3]
    both = {"return_sum_weights": True, "return_unweighted_sum": True}
    assert reduced(spark, "sum", x, weights=w) == 39
    assert reduced(spark, "sum", x, weights=w, **both) == (39, 6.5, 17)
    assert reduced(spark, "sum", x, weights=w, return_sum_weights=True) == (39, 6.5)
    assert reduced(spark, "sum", x, weights=w, return_unweighted_sum=True) == (39, 17)
    y, v = [1.0, NAN, 3.0, INF], [2.0, 100, 5, 7]
    assert reduced(spark, "sum", y, Policy.SKIP_NAN, v, **both) == (INF, 14, INF)
    assert reduced(spark, "sum", y, Policy.FINITE, v, **both) == (17, 7, 4)
    assert reduced(spark, "average", y, Policy.FINITE, [1.0, 100, 3, 2]) == 2.5
    assert np.isnan(reduced(spark, "average", [NAN], Policy.SKIP_NAN, [1.0]))
    assert np.isnan(reduced(spark, "average", [1.0], weights=[NAN]))
    assert reduced(spark, "average", np.array([1, 2, 5, 9], "uint16"), weights=np.array([1, 2, 3, 4], "int16")) == 5.6
    for a, b in (([1.0], [0.0]), ([], [])):
        with pytest.raises(ZeroDivisionError, match="weights sum to zero"):
            reduced(spark, "average", np.array(a, float), weights=np.array(b, float))
    with pytest.raises(ValueError, match="require weights"):
        reduced(spark, "sum", x, return_sum_weights=True)
    with pytest.raises(ValueError, match="same shape"):
        sources.vector(spark, x, [1.0])


def test_ranks(spark):
    assert reduced(spark, "quantile", np.arange(11.0), q=0.25) == 2.5
    assert reduced(spark, "quantile", np.arange(11.0), q=0.75) == 7.5
    for a in (np.array([0.0, 10, 20, 30, 40]), np.array([0, 10, 20, 30, 40], "int16")):
        assert reduced(spark, "percentile", a, q=12.5) == 5
        assert reduced(spark, "percentile", a, q=[0, 12.5, 100]).tolist() == [0, 5, 40]
    u = np.array([9, 1, 5, 3], "uint16")
    assert reduced(spark, "lmedian", u) == 3 and reduced(spark, "median", u) == 4
    assert reduced(spark, "percentile", u, q=[25, 50, 75]).tolist() == [2.5, 4, 6]
    for q in (-1, 101, NAN, [50, INF], [[1]]):
        with pytest.raises(ValueError):
            reduced(spark, "percentile", u, q=q)
    with pytest.raises(ValueError):
        reduced(spark, "quantile", u, q=1.5)
    inf = np.array([1.0, 2.0, INF])
    assert reduced(spark, "percentile", inf, q=100) == INF
    assert np.isnan(reduced(spark, "percentile", [-INF, 1.0, 2.0], q=25, strict=True))


def test_types_are_checked(spark):
    with pytest.raises(TypeError):
        sources.vector(spark, np.array([1 + 2j]))
    with pytest.raises(TypeError):
        sources.vector(spark, np.array([1, 2], object))
    for bad in (F.lit("a"), F.lit(True).cast("string"), F.current_date(), F.lit(1).cast("decimal(5,2)")):
        with pytest.raises(TypeError):
            fs.mean(spark.range(1).select(bad.alias("x")), "x")


def test_null_is_no_element(spark):
    table = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert value(table, "mean", "x") == 2 and value(table, "count_finite", "x") == 2
    assert value(table, "lmedian", "x") == 1 and value(table, "min", "x") == 1


def test_partitions_do_not_matter(spark):
    table = sources.vector(spark, noisy())
    for op in ("mean", "std", "median", "minmax"):
        one, many = value(table.repartition(1), op, "x", policy=Policy.FINITE), value(table.repartition(8), op, "x", policy=Policy.FINITE)
        assert one == pytest.approx(many, rel=1e-12)
