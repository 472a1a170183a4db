"""Reductions whose names carry the NaN policy: ``_valid`` (the caller promises none), ``_skip_nan``, ``_skip_nonfinite``.

One-dimensional names take a column (name or Column) and return an aggregate Column; nothing is checked, and element
kinds other than floating ones are given as ``kind=``.  Axis names take (df, column, ...) and return a DataFrame.
``copy`` is accepted and means nothing here; ``_in_place`` names give the same values and change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from ..functions import columns
from ..functions.policy import Policy, checked_q
from . import frame

AXIS_OPS = ("mean", "sum", "min", "max", "median", "lmedian", "var", "std", "count_finite")
_POLICIES = {"valid": Policy.TRUSTED, "skip_nan": Policy.SKIP_NAN, "skip_nonfinite": Policy.FINITE}


def _scan(of, policy: Policy):
    return lambda a, *, copy=False, kind="float": of(a, policy, kind)


def _moment(policy: Policy, root: bool, return_mean: bool):
    return lambda a, ddof=0, *, copy=False, kind="float": columns.var_of(a, policy, kind, ddof, return_mean, root)


def _weighted(policy: Policy, sum_weights: bool, unweighted: bool):
    return lambda a, weights, *, kind="float", weight_kind="float": columns.weighted_sum_of(a, weights, policy, kind, weight_kind, sum_weights, unweighted)


def _average(policy: Policy):
    return lambda a, weights, *, kind="float", weight_kind="float": columns.average_of(a, weights, policy, kind, weight_kind)


def _rank(policy: Policy, percent: bool, many: bool = False):
    def call(a: str | Column, q: float | Sequence[float], *, copy: bool = False, kind: str = "float") -> Column:
        fractions, scalar = checked_q(q, percent)
        return columns.percentiles_of(a, fractions, scalar and not many, policy, kind)

    return call


def _axis(axis: int, policy: Policy):
    def call(df: DataFrame, column: str, op: str, ddof: int = 0, *, copy: bool = False, **options) -> DataFrame:
        if op not in AXIS_OPS:
            raise ValueError(f"unknown op {op!r}; expected one of {', '.join(sorted(AXIS_OPS))}")
        return frame.reduce(df, op, column, axis=axis, policy=policy, ddof=ddof, validate=False, **options)

    return call


def _axis_rank(axis: int, policy: Policy, percent: bool):
    def call(df: DataFrame, column: str, q: float | Sequence[float], *, copy: bool = False, **options) -> DataFrame:
        return frame.reduce(df, "percentile" if percent else "quantile", column, axis=axis, policy=policy, q=q, validate=False, **options)

    return call


def _names() -> dict[str, object]:
    out: dict[str, object] = {"count_finite": lambda a, *, copy=False, kind="float": columns.count_finite_of(a, kind)}
    scans = {"sum": columns.sum_of, "mean": columns.mean_of, "min": columns.min_of, "max": columns.max_of, "minmax": columns.minmax_of, "median": columns.median_of, "lmedian": columns.lmedian_of}
    for suffix, policy in _POLICIES.items():
        for name, of in scans.items():
            out[f"{name}_{suffix}"] = _scan(of, policy)
        for name, root in (("var", False), ("std", True)):
            out[f"{name}_{suffix}"] = _moment(policy, root, False)
            out[f"{name}_mean_{suffix}"] = _moment(policy, root, True)
        out[f"weighted_sum_{suffix}"] = _weighted(policy, True, True)
        out[f"weighted_sum_only_{suffix}"] = _weighted(policy, False, False)
        out[f"weighted_sum_and_weights_{suffix}"] = _weighted(policy, True, False)
        out[f"weighted_sum_and_unweighted_{suffix}"] = _weighted(policy, False, True)
        out[f"weighted_average_{suffix}"] = _average(policy)
        out[f"percentile_{suffix}"], out[f"quantile_{suffix}"] = _rank(policy, True), _rank(policy, False)
        for axis, where in ((0, "axis0"), (-1, "axis_last")):
            out[f"reduce_{where}_{suffix}"] = _axis(axis, policy)
            if suffix != "skip_nan":
                out[f"percentile_{where}_{suffix}"] = _axis_rank(axis, policy, True)
            if suffix == "valid":
                out[f"quantile_{where}_{suffix}"] = _axis_rank(axis, policy, False)
    out["percentiles_valid"] = _rank(Policy.TRUSTED, True, many=True)
    for name in ("median", "lmedian", "percentile", "quantile", "percentiles"):
        out[f"{name}_valid_in_place"] = out[f"{name}_valid"]
    return out


NAMES = sorted(_names())
globals().update(_names())
__all__ = NAMES
