"""Reductions inside array rows, by higher-order functions: one result a row, no shuffle.

``a`` is an array Column; NULL elements are no elements, and a NULL array gives NULL.  Variance takes two passes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .policy import INF, NAN, Policy, as_double, checked_ddof, keeps


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, even where a lambda refers to it for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def kept_array(a: Column, kind: str, policy: Policy) -> Column:
    return F.filter(a, lambda v: keeps(v, kind, policy))


def doubles(a: Column, kind: str, policy: Policy) -> Column:
    """The elements that take part, as doubles: a compiled cast and one pass of a lambda."""
    cast = (a.cast("array<int>") if kind == "bool" else a).cast("array<double>")
    return kept_array(cast, kind, policy)


def _has_nan(a: Column, kind: str, policy: Policy) -> Column | None:
    return F.exists(a, lambda v: F.coalesce(F.isnan(v), F.lit(False))) if kind == "float" and policy is Policy.ALL else None


def _guarded(a: Column, kind: str, policy: Policy, value: Column, missing: Column) -> Column:
    nan = _has_nan(a, kind, policy)
    value = F.coalesce(value, missing)
    value = value if nan is None else F.when(nan, missing).otherwise(value)
    return F.when(a.isNotNull(), value)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def sum_of(a: Column, policy: Policy = Policy.ALL, kind: str = "float") -> Column:
    return F.when(a.isNotNull(), _total(doubles(a, kind, policy)))


def mean_of(a: Column, policy: Policy = Policy.ALL, kind: str = "float") -> Column:
    mean = let(doubles(a, kind, policy), lambda d: F.when(F.size(d) == 0, F.lit(NAN)).otherwise(_total(d) / F.size(d)))
    return F.when(a.isNotNull(), mean)


def min_of(a: Column, policy: Policy = Policy.ALL, kind: str = "float") -> Column:
    value = F.array_min(kept_array(a, kind, policy) if kind == "float" and policy.skips else a)
    return _guarded(a, kind, policy, value, F.lit(NAN)) if kind == "float" else value


def max_of(a: Column, policy: Policy = Policy.ALL, kind: str = "float") -> Column:
    value = F.array_max(kept_array(a, kind, policy) if kind == "float" and policy.skips else a)
    return F.when(a.isNotNull(), F.coalesce(value, F.lit(NAN))) if kind == "float" else value


def minmax_of(a: Column, policy: Policy = Policy.ALL, kind: str = "float") -> Column:
    return F.when(a.isNotNull(), F.struct(min_of(a, policy, kind).alias("min"), max_of(a, policy, kind).alias("max")))


def var_of(a: Column, policy: Policy = Policy.ALL, kind: str = "float", ddof: int = 0, return_mean: bool = False, root: bool = False) -> Column:
    ddof = checked_ddof(ddof)

    def of(d: Column) -> Column:
        def about(mean: Column) -> Column:
            squares = F.aggregate(d, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
            var = F.when(F.size(d) <= ddof, F.lit(NAN)).otherwise(squares / (F.size(d) - ddof))
            var = F.sqrt(var) if root else var
            return F.struct(var.alias("std" if root else "var"), mean.alias("mean"))

        return let(F.when(F.size(d) == 0, F.lit(NAN)).otherwise(_total(d) / F.size(d)), about)

    both = let(doubles(a, kind, policy), of)
    return F.when(a.isNotNull(), both if return_mean else both["std" if root else "var"])


def std_of(a: Column, policy: Policy = Policy.ALL, kind: str = "float", ddof: int = 0, return_mean: bool = False) -> Column:
    return var_of(a, policy, kind, ddof, return_mean, root=True)


def median_of(a: Column, policy: Policy = Policy.ALL, kind: str = "float") -> Column:
    def middle(s: Column) -> Column:
        n = F.size(s)
        low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
        # Equal middle values need no sum, which could overflow to infinity.
        return F.when(n == 0, F.lit(NAN)).when(low == high, low).otherwise((low + high) / 2)

    return _guarded(a, kind, policy, let(F.sort_array(doubles(a, kind, policy)), middle), F.lit(NAN))


def lmedian_of(a: Column, policy: Policy = Policy.SKIP_NAN, kind: str = "float") -> Column:
    value = let(F.sort_array(kept_array(a, kind, policy)), lambda s: F.when(F.size(s) > 0, F.get(s, F.floor((F.size(s) - 1) / 2).cast("int"))))
    return F.when(a.isNotNull(), F.coalesce(value, F.lit(NAN))) if kind == "float" else value


def percentiles_of(a: Column, fractions: Sequence[float], scalar: bool, policy: Policy = Policy.ALL, kind: str = "float", strict: bool = True) -> Column:
    def at(s: Column, q: float) -> Column:
        rank = F.lit(q) * (F.size(s) - 1)
        low = F.get(s, F.floor(rank).cast("int"))
        high = F.get(s, F.ceil(rank).cast("int"))
        step = rank - F.floor(rank)
        value = low + (high - low) * step
        # One q at an exact rank is that value; several q go through the same arithmetic at every rank.
        return F.when(step == 0, low).otherwise(value) if scalar or not strict else value

    def of(s: Column) -> Column:
        values = [F.when(F.size(s) == 0, F.lit(NAN)).otherwise(at(s, q)) for q in fractions]
        return values[0] if scalar else F.array(*values)

    missing = F.lit(NAN) if scalar else F.array(*[F.lit(NAN)] * len(fractions))
    return _guarded(a, kind, policy, let(F.sort_array(doubles(a, kind, policy)), of), missing)


def _pairs(a: Column, w: Column, kind: str, weight_kind: str, policy: Policy) -> Column:
    """(x, w) as doubles, of the values that take part; unequal lengths are an error."""
    zipped = F.zip_with(a, w, lambda x, y: F.struct(x.alias("v"), y.alias("w")))
    kept = F.filter(zipped, lambda p: keeps(p["v"], kind, policy) & p["w"].isNotNull())
    pairs = F.transform(kept, lambda p: F.struct(as_double(p["v"], kind).alias("x"), as_double(p["w"], weight_kind).alias("w")))
    return F.when(F.size(a) == F.size(w), pairs).otherwise(F.raise_error(F.lit("weights must have the same shape as the values")).cast("array<struct<x:double,w:double>>"))


def weighted_parts(a: Column, w: Column, policy: Policy = Policy.ALL, kind: str = "float", weight_kind: str = "float") -> Column:
    """struct of ws, sw, us, n."""
    start = F.struct(F.lit(0.0).alias("ws"), F.lit(0.0).alias("sw"), F.lit(0.0).alias("us"), F.lit(0).alias("n"))

    def add(s: Column, p: Column) -> Column:
        return F.struct((s["ws"] + p["x"] * p["w"]).alias("ws"), (s["sw"] + p["w"]).alias("sw"), (s["us"] + p["x"]).alias("us"), (s["n"] + 1).alias("n"))

    return F.aggregate(_pairs(a, w, kind, weight_kind, policy), start, add)


def weighted_sum_of(a: Column, w: Column, policy: Policy = Policy.ALL, kind: str = "float", weight_kind: str = "float", sum_weights: bool = True, unweighted: bool = True) -> Column:
    def packed(s: Column) -> Column:
        if not (sum_weights or unweighted):
            return s["ws"]
        return F.struct(s["ws"].alias("weighted_sum"), *[s["sw"].alias("sum_weights")] * sum_weights, *[s["us"].alias("unweighted_sum")] * unweighted)

    return F.when(a.isNotNull(), let(weighted_parts(a, w, policy, kind, weight_kind), packed))


def average_of(a: Column, w: Column | None = None, policy: Policy = Policy.ALL, kind: str = "float", weight_kind: str = "float") -> Column:
    if w is None:
        return mean_of(a, policy, kind)
    from .columns import finished_average

    return F.when(a.isNotNull(), let(weighted_parts(a, w, policy, kind, weight_kind), lambda s: finished_average(s["ws"], s["sw"], s["n"], policy)))


def count_finite_of(a: Column, kind: str = "float") -> Column:
    keep = (lambda v: F.abs(v) < F.lit(INF)) if kind == "float" else (lambda v: v.isNotNull())
    return F.when(a.isNotNull(), F.size(F.filter(a, keep)).cast("long"))
