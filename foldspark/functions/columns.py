"""Reductions of a column as aggregate expressions, for ``agg``, ``groupBy``, ``cube``, ``rollup`` and windows.

All are built-in aggregates in one Aggregate node, combined before the shuffle.  ``x`` is a column name or Column of
element kind ``kind`` (see ``policy.kind_of``; "float" if not said).  Empty input gives NaN (sum: 0, exact types: NULL).
``var`` here is from running moments, rescaled; ``operators.frame`` has the form that is exact for large offsets too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays
from .policy import INF, NAN, Policy, as_double, checked_ddof, checked_q, kept, keeps

ZERO_WEIGHT = "weights sum to zero, can't be normalized"


def _column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _has_nan(x: Column, kind: str, policy: Policy) -> Column | None:
    """Whether a NaN propagates; None where it cannot."""
    return F.coalesce(F.bool_or(F.isnan(x)), F.lit(False)) if kind == "float" and policy is Policy.ALL else None


def _guarded(x: Column, kind: str, policy: Policy, value: Column, missing: Column) -> Column:
    nan = _has_nan(x, kind, policy)
    value = F.coalesce(value, missing)
    return value if nan is None else F.when(nan, missing).otherwise(value)


def _or_nan(value: Column, kind: str) -> Column:
    return F.coalesce(value, F.lit(NAN)) if kind == "float" else value


def mean_of(x: str | Column, policy: Policy = Policy.ALL, kind: str = "float") -> Column:
    return F.coalesce(F.avg(as_double(kept(_column(x), kind, policy), kind)), F.lit(NAN))


def sum_of(x: str | Column, policy: Policy = Policy.ALL, kind: str = "float") -> Column:
    return F.coalesce(F.sum(as_double(kept(_column(x), kind, policy), kind)), F.lit(0.0))


def min_of(x: str | Column, policy: Policy = Policy.ALL, kind: str = "float") -> Column:
    x = _column(x)
    # NaN is the greatest double here, so a plain minimum skips it by itself unless all are NaN.
    value = F.min(kept(x, kind, policy))
    return _guarded(x, kind, policy, value, F.lit(NAN)) if kind == "float" else value


def max_of(x: str | Column, policy: Policy = Policy.ALL, kind: str = "float") -> Column:
    return _or_nan(F.max(kept(_column(x), kind, policy)), kind)


def minmax_of(x: str | Column, policy: Policy = Policy.ALL, kind: str = "float") -> Column:
    return F.struct(min_of(x, policy, kind).alias("min"), max_of(x, policy, kind).alias("max"))


def var_of(x: str | Column, policy: Policy = Policy.ALL, kind: str = "float", ddof: int = 0, return_mean: bool = False, root: bool = False) -> Column:
    ddof = checked_ddof(ddof)
    value = as_double(kept(_column(x), kind, policy), kind)
    n = F.count(value)
    var = F.when(n <= ddof, F.lit(NAN)).otherwise(F.var_pop(value) * n / (n - ddof))
    var = F.sqrt(var) if root else var
    return F.struct(var.alias("std" if root else "var"), F.coalesce(F.avg(value), F.lit(NAN)).alias("mean")) if return_mean else var


def std_of(x: str | Column, policy: Policy = Policy.ALL, kind: str = "float", ddof: int = 0, return_mean: bool = False) -> Column:
    return var_of(x, policy, kind, ddof, return_mean, root=True)


def median_of(x: str | Column, policy: Policy = Policy.ALL, kind: str = "float") -> Column:
    x = _column(x)
    return _guarded(x, kind, policy, F.median(as_double(kept(x, kind, policy), kind)), F.lit(NAN))


def lmedian_of(x: str | Column, policy: Policy = Policy.SKIP_NAN, kind: str = "float", dtype: str | None = None) -> Column:
    """The lower median, of the column's own type.  Named columns that are exact as doubles go through a map of counts;
    others through the group's sorted list (``operators.frame`` has a form for large groups)."""
    if isinstance(x, str) and kind in ("float", "int"):
        name = f"`{x}`"
        keep = {Policy.SKIP_NAN: f"CASE WHEN NOT isnan({name}) THEN {name} END", Policy.FINITE: f"CASE WHEN abs({name}) < double('Infinity') THEN {name} END"}
        value = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {keep.get(policy, name) if kind == 'float' else name})")
        return _or_nan(value.cast(dtype) if dtype else value, kind)
    return arrays.lmedian_of(F.collect_list(kept(_column(x), kind, policy)), Policy.TRUSTED, kind)


def percentiles_of(x: str | Column, fractions: Sequence[float], scalar: bool, policy: Policy = Policy.ALL, kind: str = "float", strict: bool = False) -> Column:
    """Linear interpolation at fractions.  strict: IEEE arithmetic at infinite neighbours (inf - inf is NaN), from the sorted list."""
    x = _column(x)
    if strict:
        return arrays.percentiles_of(F.collect_list(as_double(x, kind)), fractions, scalar, policy, kind)
    value = F.percentile(as_double(kept(x, kind, policy), kind), F.lit(fractions[0]) if scalar else F.array(*map(F.lit, fractions)))
    missing = F.lit(NAN) if scalar else F.array(*[F.lit(NAN)] * len(fractions))
    return _guarded(x, kind, policy, value, missing)


def weighted_parts(x: str | Column, w: str | Column, policy: Policy = Policy.ALL, kind: str = "float", weight_kind: str = "float") -> tuple[Column, Column, Column, Column]:
    """Weighted sum, sum of weights, plain sum and count over the values that take part; the policy looks at values alone."""
    x, w = _column(x), _column(w)
    keep = keeps(x, kind, policy) & w.isNotNull()
    value, weight = as_double(x, kind), as_double(w, weight_kind)
    sums = [F.coalesce(F.sum(F.when(keep, part)), F.lit(0.0)) for part in (value * weight, weight, value)]
    return sums[0], sums[1], sums[2], F.count_if(keep)


def weighted_sum_of(x: str | Column, w: str | Column, policy: Policy = Policy.ALL, kind: str = "float", weight_kind: str = "float", sum_weights: bool = True, unweighted: bool = True) -> Column:
    ws, sw, us, _ = weighted_parts(x, w, policy, kind, weight_kind)
    if not (sum_weights or unweighted):
        return ws
    return F.struct(ws.alias("weighted_sum"), *[sw.alias("sum_weights")] * sum_weights, *[us.alias("unweighted_sum")] * unweighted)


def finished_average(ws: Column, sw: Column, n: Column, policy: Policy) -> Column:
    error = F.raise_error(F.lit(ZERO_WEIGHT)).cast("double")
    return F.when(n == 0, F.lit(NAN) if policy.skips else error).when(sw == 0, error).otherwise(ws / sw)


def average_of(x: str | Column, w: str | Column | None = None, policy: Policy = Policy.ALL, kind: str = "float", weight_kind: str = "float") -> Column:
    if w is None:
        return mean_of(x, policy, kind)
    ws, sw, _, n = weighted_parts(x, w, policy, kind, weight_kind)
    return finished_average(ws, sw, n, policy)


def count_finite_of(x: str | Column, kind: str = "float") -> Column:
    x = _column(x)
    return F.count_if(F.abs(x) < F.lit(INF)) if kind == "float" else F.count(x)


# The 24 reductions under their public names.


def mean(x: str | Column, *, kind: str = "float") -> Column:
    return mean_of(x, Policy.ALL, kind)


def nanmean(x: str | Column, *, ignore_inf: bool = False, kind: str = "float") -> Column:
    return mean_of(x, Policy.nan_aware(ignore_inf), kind)


def average(x: str | Column, weights: str | Column | None = None, *, kind: str = "float", weight_kind: str = "float") -> Column:
    return average_of(x, weights, Policy.ALL, kind, weight_kind)


def nanaverage(x: str | Column, weights: str | Column | None = None, *, ignore_inf: bool = False, kind: str = "float", weight_kind: str = "float") -> Column:
    return average_of(x, weights, Policy.nan_aware(ignore_inf), kind, weight_kind)


def checked_flags(weights: object, return_sum_weights: bool, return_unweighted_sum: bool) -> None:
    if weights is None and (return_sum_weights or return_unweighted_sum):
        raise ValueError("return_sum_weights and return_unweighted_sum require weights")


def _sum(x, policy, kind, weights, weight_kind, return_sum_weights, return_unweighted_sum) -> Column:
    checked_flags(weights, return_sum_weights, return_unweighted_sum)
    if weights is None:
        return sum_of(x, policy, kind)
    return weighted_sum_of(x, weights, policy, kind, weight_kind, return_sum_weights, return_unweighted_sum)


def sum(x: str | Column, *, weights: str | Column | None = None, return_sum_weights: bool = False, return_unweighted_sum: bool = False, kind: str = "float", weight_kind: str = "float") -> Column:
    return _sum(x, Policy.ALL, kind, weights, weight_kind, return_sum_weights, return_unweighted_sum)


def nansum(x: str | Column, *, weights: str | Column | None = None, return_sum_weights: bool = False, return_unweighted_sum: bool = False, ignore_inf: bool = False, kind: str = "float", weight_kind: str = "float") -> Column:
    return _sum(x, Policy.nan_aware(ignore_inf), kind, weights, weight_kind, return_sum_weights, return_unweighted_sum)


def min(x: str | Column, *, kind: str = "float") -> Column:
    return min_of(x, Policy.ALL, kind)


def nanmin(x: str | Column, *, ignore_inf: bool = False, kind: str = "float") -> Column:
    return min_of(x, Policy.nan_aware(ignore_inf), kind)


def max(x: str | Column, *, kind: str = "float") -> Column:
    return max_of(x, Policy.ALL, kind)


def nanmax(x: str | Column, *, ignore_inf: bool = False, kind: str = "float") -> Column:
    return max_of(x, Policy.nan_aware(ignore_inf), kind)


def minmax(x: str | Column, *, kind: str = "float") -> Column:
    low = min_of(x, Policy.ALL, kind)
    high = max_of(x, Policy.ALL, kind)
    return F.struct(low.alias("min"), high.alias("max"))


def nanminmax(x: str | Column, *, ignore_inf: bool = False, kind: str = "float") -> Column:
    return minmax_of(x, Policy.nan_aware(ignore_inf), kind)


def var(x: str | Column, ddof: int = 0, *, return_mean: bool = False, kind: str = "float") -> Column:
    return var_of(x, Policy.ALL, kind, ddof, return_mean)


def nanvar(x: str | Column, ddof: int = 0, *, return_mean: bool = False, ignore_inf: bool = False, kind: str = "float") -> Column:
    return var_of(x, Policy.nan_aware(ignore_inf), kind, ddof, return_mean)


def std(x: str | Column, ddof: int = 0, *, return_mean: bool = False, kind: str = "float") -> Column:
    return std_of(x, Policy.ALL, kind, ddof, return_mean)


def nanstd(x: str | Column, ddof: int = 0, *, return_mean: bool = False, ignore_inf: bool = False, kind: str = "float") -> Column:
    return std_of(x, Policy.nan_aware(ignore_inf), kind, ddof, return_mean)


def median(x: str | Column, *, kind: str = "float") -> Column:
    return median_of(x, Policy.ALL, kind)


def nanmedian(x: str | Column, *, ignore_inf: bool = False, kind: str = "float") -> Column:
    return median_of(x, Policy.nan_aware(ignore_inf), kind)


def lmedian(x: str | Column, *, ignore_inf: bool = False, kind: str = "float", dtype: str | None = None) -> Column:
    return lmedian_of(x, Policy.nan_aware(ignore_inf), kind, dtype)


def percentile(x: str | Column, q: float | Sequence[float], *, kind: str = "float", strict: bool = False) -> Column:
    return percentiles_of(x, *checked_q(q, True), Policy.ALL, kind, strict)


def nanpercentile(x: str | Column, q: float | Sequence[float], *, ignore_inf: bool = False, kind: str = "float", strict: bool = False) -> Column:
    return percentiles_of(x, *checked_q(q, True), Policy.nan_aware(ignore_inf), kind, strict)


def quantile(x: str | Column, q: float | Sequence[float], *, kind: str = "float", strict: bool = False) -> Column:
    return percentiles_of(x, *checked_q(q, False), Policy.ALL, kind, strict)


def nanquantile(x: str | Column, q: float | Sequence[float], *, ignore_inf: bool = False, kind: str = "float", strict: bool = False) -> Column:
    return percentiles_of(x, *checked_q(q, False), Policy.nan_aware(ignore_inf), kind, strict)


def count_finite(x: str | Column, *, kind: str = "float") -> Column:
    return count_finite_of(x, kind)
