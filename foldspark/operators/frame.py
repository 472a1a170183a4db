"""Reductions of a DataFrame's column: whole, grouped, position-wise over stacked arrays, or inside each array.

``axis=None`` reduces a column over all rows, or over the rows of each group of ``by``; an array column gives all its
elements.  ``axis=0`` reduces arrays position by position over rows (the key ``pos`` joins ``by``).  ``axis=-1`` reduces
each row's array and keeps the row.  Any other axis is not supported.

Plans: one Aggregate for everything but what follows; only the column, the weights and the keys are read, and no job runs
while a plan is built.

* Variance: one pass with the engine's running moments, which lose digits where a group's mean is far beyond its spread.
  Groups whose mean is more than ``FAR`` standard deviations from zero are done again about their mean.  That part of the
  plan hangs on a broadcast of one row, "there is such a group": without one, adaptive execution drops it, and the input
  is read once.
* Median, percentile and quantile of inputs known to be beyond ``LARGE_BYTES`` (by the optimizer's statistics), or on request: a
  sketch of each group brackets the elements of the wanted ranks, and only these elements are counted and ordered.  The
  input is read twice, and a group's values never come together.  Smaller inputs keep counts of values by group.
* Lower median of 64-bit and boolean columns: by the bracketed ranks if the input is large, else by counts of values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays, columns
from ..functions.policy import NAN, Policy, as_double, checked_ddof, checked_q, kept, kind_of
from ..plans.config import ELEMENT_BYTES, bounded, estimated_elements, grain_of

OPS = ("mean", "sum", "min", "max", "minmax", "var", "std", "median", "lmedian", "percentile", "quantile", "average", "count_finite")
#: Standard deviations from zero beyond which running moments of a group are not trusted.
FAR = 1e3
LARGE_BYTES = 1 << 36
#: The optimizer's figure where it does not know a size (local data, say) is beyond this.
UNKNOWN_BYTES = 1 << 55
#: The sketches' accuracy, how far (as a share of ranks) their brackets reach, and rows of a group that needs no bracket.
SKETCH, REACH, FEW = 10_000, 4e-4, 50_000
_X, _W = "_fold_x", "_fold_w"


def _checked(op: str, axis: int | None) -> None:
    if op not in OPS:
        raise ValueError(f"unknown op {op!r}; expected one of {', '.join(sorted(OPS))}")
    if axis not in (None, 0, -1):
        raise NotImplementedError(f"axis must be None, 0 or -1, not {axis!r}: other axes need a transposed layout")


def _element(kind: T.DataType) -> T.DataType:
    return kind.elementType if isinstance(kind, T.ArrayType) else kind


def _narrowed(op: str, value: Column, kind: T.DataType, axis: int | None, return_mean: bool = False) -> Column:
    """The result type along an axis: float for float input; exact ops keep the input's type; percentiles stay double."""
    if axis is None or not isinstance(kind, T.FloatType) or op in ("percentile", "quantile", "average", "count_finite"):
        return value
    if op == "minmax":
        return value.cast("struct<min:float,max:float>")
    return value.cast(f"struct<{op}:float,mean:float>" if return_mean else "float")


def reduce(
    df: DataFrame,
    op: str,
    column: str,
    *,
    axis: int | None = None,
    by: str | Sequence[str] = (),
    policy: Policy = Policy.ALL,
    weights: str | Sequence[float] | None = None,
    q: float | Sequence[float] | None = None,
    ddof: int = 0,
    return_mean: bool = False,
    return_sum_weights: bool = False,
    return_unweighted_sum: bool = False,
    strict: bool = False,
    one_pass: bool = False,
    bracketed: bool | None = None,
    approx: int | None = None,
    validate: bool = True,
    alias: str = "value",
) -> DataFrame:
    """The reduction ``op`` of a column as a DataFrame: keys (or the rows, for axis=-1) and ``alias``.

    weights: a column of the same shape; along axis 0 also one weight a row; along axis -1 also a list of numbers.
    one_pass: variance from running moments alone (also used for streams, which cannot be read twice).
    bracketed: whether exact ranks go by brackets; None decides by the size of the input.
    approx: medians, percentiles and quantiles from sketches alone, in one scan: elements whose rank is off by one in so many.
    validate=False skips the type checks.
    """
    _checked(op, axis)
    by = [by] if isinstance(by, str) else list(by)
    kind = df.schema[column].dataType
    is_array = isinstance(kind, T.ArrayType)
    element = _element(kind)
    if axis is not None and not is_array:
        raise ValueError("axis 0 and -1 need an array column: a scalar has no axis")
    kinds = kind_of(element) if validate else ("float" if isinstance(element, (T.FloatType, T.DoubleType)) else kind_of(element))
    columns.checked_flags(weights, return_sum_weights, return_unweighted_sum)
    ddof = checked_ddof(ddof)
    fractions, scalar = checked_q(q, op == "percentile") if op in ("percentile", "quantile") else ([], True)
    if op in ("percentile", "quantile") and q is None:
        raise ValueError("q is required")
    if op == "lmedian" and policy is Policy.ALL:
        policy = Policy.SKIP_NAN
    weight_kind = "float"
    if isinstance(weights, str):
        weight_type = df.schema[weights].dataType
        weight_kind = kind_of(_element(weight_type)) if validate else "float"
        if isinstance(weight_type, T.ArrayType) and not is_array:
            raise ValueError("weights must have the same shape as the values")
        if axis in (None, -1) and is_array and not isinstance(weight_type, T.ArrayType):
            raise ValueError("weights must have the same shape as the values, or the length of the reduction axis")
    elif weights is not None and axis != -1:
        raise ValueError("a list of weights belongs to the last axis; give one weight a row as a column along axis 0")

    if axis == -1:
        w = F.array(*[F.lit(float(x)) for x in weights]) if weights is not None and not isinstance(weights, str) else F.col(weights) if weights else None
        value = _in_row(op, F.col(column), w, policy, kinds, weight_kind, fractions, scalar, ddof, return_mean, return_sum_weights, return_unweighted_sum)
        return df.withColumn(alias, value if op == "sum" and weights is not None else _narrowed(op, value, element, axis, return_mean))

    keys = [F.col(k) for k in by]
    if is_array:
        full = isinstance(weights, str) and isinstance(df.schema[weights].dataType, T.ArrayType)
        if full:
            same = F.size(column) == F.size(weights)
            zipped = F.when(same | F.col(column).isNull(), F.arrays_zip(F.col(column).alias("x"), F.col(weights).alias("w")))
            zipped = zipped.otherwise(F.raise_error(F.lit("weights must have the same shape as the values")))
            rows = df.select(*keys, F.posexplode(zipped).alias("pos", "_fold_p"))
            names = rows.schema["_fold_p"].dataType.fieldNames()
            rows = rows.select(*by, "pos", F.col("_fold_p")[names[0]].alias(_X), F.col("_fold_p")[names[1]].alias(_W))
        else:
            extra = [F.col(weights).alias(_W)] if weights else []
            rows = df.select(*keys, *extra, F.posexplode(column).alias("pos", _X))
        by = [*by, "pos"] if axis == 0 else by
    else:
        rows = df.select(*keys, F.col(column).alias(_X), *([F.col(weights).alias(_W)] if weights else []))

    grain = grain_of(op, axis, policy.skips, weights is not None)
    if op in ("var", "std") and not one_pass and not df.isStreaming:
        return bounded(_moments(rows, by, op, policy, kinds, ddof, return_mean, element, axis, alias), df, grain)
    if approx is not None:
        return bounded(_sketched(rows, by, op, policy, kinds, fractions, scalar, approx, element, axis, alias), df, grain)
    if op in ("median", "lmedian", "percentile", "quantile") and not strict and not df.isStreaming:
        if bracketed is None:
            bracketed = LARGE_BYTES < estimated_elements(df) * ELEMENT_BYTES < UNKNOWN_BYTES
        if bracketed:
            found = _bracketed(rows, by, op, policy, kinds, [0.5] if op == "median" else fractions, scalar, element, axis, alias)
            return bounded(found, df, grain)
    if op == "lmedian" and kinds in ("wide", "bool") and not df.isStreaming:
        return bounded(_exact_lower_median(rows, by, alias), df, grain)
    value = _aggregate(op, policy, kinds, weights is not None, weight_kind, fractions, scalar, ddof, return_mean, return_sum_weights, return_unweighted_sum, strict, element)
    value = value if op == "sum" and weights is not None else _narrowed(op, value, element, axis, return_mean)
    return bounded(rows.groupBy(*by).agg(value.alias(alias)), df, grain) if by else rows.agg(value.alias(alias))


def _aggregate(op, policy, kind, weighted, weight_kind, fractions, scalar, ddof, return_mean, sum_weights, unweighted, strict, element) -> Column:
    if op == "sum":
        return columns.weighted_sum_of(_X, _W, policy, kind, weight_kind, sum_weights, unweighted) if weighted else columns.sum_of(_X, policy, kind)
    if op == "average":
        return columns.average_of(_X, _W if weighted else None, policy, kind, weight_kind)
    if op in ("percentile", "quantile"):
        return columns.percentiles_of(_X, fractions, scalar, policy, kind, strict)
    if op in ("var", "std"):
        return columns.var_of(_X, policy, kind, ddof, return_mean, root=op == "std")
    if op == "lmedian":
        return columns.lmedian_of(_X, policy, kind, element.simpleString())
    if op == "count_finite":
        return columns.count_finite_of(_X, kind)
    return {"mean": columns.mean_of, "min": columns.min_of, "max": columns.max_of, "minmax": columns.minmax_of, "median": columns.median_of}[op](_X, policy, kind)


def _in_row(op, a, w, policy, kind, weight_kind, fractions, scalar, ddof, return_mean, sum_weights, unweighted) -> Column:
    if op == "sum":
        return arrays.weighted_sum_of(a, w, policy, kind, weight_kind, sum_weights, unweighted) if w is not None else arrays.sum_of(a, policy, kind)
    if op == "average":
        return arrays.average_of(a, w, policy, kind, weight_kind)
    if op in ("percentile", "quantile"):
        return arrays.percentiles_of(a, fractions, scalar, policy, kind)
    if op in ("var", "std"):
        return arrays.var_of(a, policy, kind, ddof, return_mean, root=op == "std")
    if op == "count_finite":
        return arrays.count_finite_of(a, kind)
    return {"mean": arrays.mean_of, "min": arrays.min_of, "max": arrays.max_of, "minmax": arrays.minmax_of, "median": arrays.median_of, "lmedian": arrays.lmedian_of}[op](a, policy, kind)


def _on(by: list[str], names: list[str]) -> Column:
    """Equal keys, null ones too; true without any."""
    out = F.lit(True)
    for k, m in zip(by, names, strict=True):
        out = out & F.col(k).eqNullSafe(F.col(m))
    return out


def _moments(rows: DataFrame, by: list[str], op: str, policy: Policy, kind: str, ddof: int, return_mean: bool, element: T.DataType, axis: int | None, alias: str) -> DataFrame:
    """Running moments of all groups, and squares about the mean of those that are far from zero."""
    value = as_double(kept(F.col(_X), kind, policy), kind)
    rows = rows.select(*by, value.alias(_X))
    n, mean, var = (f"_fold_{x}" for x in ("n", "mean", "var"))
    first = rows.groupBy(*by).agg(F.count(_X).alias(n), F.avg(_X).alias(mean), F.var_pop(_X).alias(var))
    far = (F.col(var) > 0) & (F.abs(mean) > FAR * F.sqrt(var)) & (F.abs(mean) < F.lit(float("inf")))
    is_far = F.coalesce(far & ~F.isnan(var), F.lit(False))

    names = [f"_fold_k{i}" for i in range(len(by))]
    groups = first.filter(is_far).select(*[F.col(k).alias(m) for k, m in zip(by, names, strict=True)], F.col(n).alias(f"{n}2"), F.col(mean).alias("_fold_centre"))
    any_far = F.broadcast(groups.limit(1).select(F.lit(1).alias("_fold_any")))
    again = rows.join(any_far, F.lit(True), "left_semi")
    again = again.join(groups, _on(by, names)) if by else again.crossJoin(F.broadcast(groups))
    # The sum of the differences is zero but for the mean's own rounding, and takes that out again.
    off = F.col(_X) - F.col("_fold_centre")
    squares = (F.sum(off * off) - F.sum(off) * F.sum(off) / F.count(_X)) / F.count(_X)
    again = again.groupBy(*by, f"{n}2", "_fold_centre").agg(F.greatest(squares, F.lit(0.0)).alias(var))
    both = first.filter(~is_far).unionAll(again.select(*by, f"{n}2", "_fold_centre", var))

    whole = F.when(F.col(n) <= ddof, F.lit(NAN)).otherwise(F.col(var) * F.col(n) / (F.col(n) - ddof))
    whole = _narrowed(op, F.sqrt(whole) if op == "std" else whole, element, axis)
    centre = _narrowed("mean", F.coalesce(mean, F.lit(NAN)), element, axis)
    return both.select(*by, (F.struct(whole.alias(op), centre.alias("mean")) if return_mean else whole).alias(alias))


def _sketched(rows: DataFrame, by: list[str], op: str, policy: Policy, kind: str, fractions: list[float], scalar: bool, accuracy: int, element: T.DataType, axis: int | None, alias: str) -> DataFrame:
    """Ranks off by one in ``accuracy`` of the elements at most."""
    if op not in ("median", "percentile", "quantile"):
        raise ValueError("approx belongs to median, percentile and quantile")
    fractions, scalar = ([0.5], True) if op == "median" else (fractions, scalar)
    sketch = F.percentile_approx(as_double(kept(F.col(_X), kind, policy), kind), F.array(*map(F.lit, fractions)), accuracy)
    missing = F.array(*[F.lit(NAN)] * len(fractions))
    nan = F.bool_or(F.isnan(_X)) if kind == "float" and policy is Policy.ALL else F.lit(False)
    value = F.when(F.coalesce(nan, F.lit(False)), missing).otherwise(F.coalesce(sketch, missing))
    value = _narrowed(op, value[0] if scalar else value, element, axis)
    return rows.groupBy(*by).agg(value.alias(alias))


def _bracketed(rows: DataFrame, by: list[str], op: str, policy: Policy, kind: str, fractions: list[float], scalar: bool, element: T.DataType, axis: int | None, alias: str) -> DataFrame:
    """Exact ranks of groups of any size: brackets from sketches, then the ordered values inside the brackets alone."""
    exact = op == "lmedian"  # keeps the type, and has one rank
    value = F.col(_X) if kind != "bool" else F.col(_X).cast("int")
    nan = F.coalesce(F.bool_or(F.isnan(_X)), F.lit(False)) if kind == "float" and policy is Policy.ALL else F.lit(False)
    value = kept(value, kind, policy)
    value = value if exact else as_double(F.col(_X), kind) if kind != "float" else value.cast("double")
    every = rows.select(*by, F.col(_X), value.alias("_fold_v"))
    fractions = [0.5] if exact else fractions
    ends = [sorted((0.0, q + d, 1.0))[1] for q in fractions for d in (-REACH, REACH)]
    sketch = F.percentile_approx("_fold_v", F.array(*map(F.lit, ends)), SKETCH)
    groups = every.groupBy(*by).agg(F.count("_fold_v").alias("_fold_n"), F.min("_fold_v").alias("_fold_least"), F.max("_fold_v").alias("_fold_most"), sketch.alias("_fold_ends"), nan.alias("_fold_nan"))
    few, n = F.col("_fold_n") <= FEW, F.col("_fold_n")

    def wanted(i: int, q: float) -> Column:
        """Of one fraction: the two ranks, and the bracket that holds their elements."""
        at = F.floor((n - 1) / 2).cast("double") if exact else F.lit(q) * (n - 1)
        low = F.when(few, F.col("_fold_least")).otherwise(F.col("_fold_ends")[2 * i])
        high = F.when(few, F.col("_fold_most")).otherwise(F.col("_fold_ends")[2 * i + 1])
        # Sketches hold doubles, and rounding to doubles keeps the order: so brackets are compared as doubles.
        return F.struct(F.lit(i).alias("i"), at.alias("at"), low.cast("double").alias("low"), high.cast("double").alias("high"))

    names = [f"_fold_k{i}" for i in range(len(by))]
    keys = [F.col(k).alias(m) for k, m in zip(by, names, strict=True)]
    brackets = groups.filter("_fold_n > 0 AND NOT _fold_nan").select(*keys, F.array(*[wanted(i, q) for i, q in enumerate(fractions)]).alias("_fold_w"))
    # Hangs on a broadcast of one row, so that the brackets' size is known before the rows are joined to them.
    started = every.filter("_fold_v IS NOT NULL").select(*by, "_fold_v").join(F.broadcast(brackets.limit(1).select(F.lit(1).alias("_fold_any"))), F.lit(True), "left_semi")
    inside = started.join(brackets, _on(by, names)) if by else started.crossJoin(F.broadcast(brackets))
    inside = inside.select(*names, "_fold_v", F.explode("_fold_w").alias("w")).filter("double(_fold_v) <= w.high")
    below = F.col("_fold_v").cast("double") < F.col("w.low")
    # Values below a bracket are one row of its counts.
    counts = inside.groupBy(*names, F.col("w.i").alias("i"), F.col("w.at").alias("at"), F.when(~below, F.col("_fold_v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(*names, "i").orderBy(F.col("v").asc_nulls_first())
    ranked = counts.withColumn("upto", F.sum("c").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    # The element of a rank is the first value that so many elements do not pass.
    lower = F.min(F.when(F.col("upto") > F.floor("at"), F.col("v")))
    upper = F.min(F.when(F.col("upto") > F.ceil("at"), F.col("v")))
    missed = F.bool_or((F.col("v").isNull()) & (F.col("upto") > F.floor("at")))
    ranked = ranked.groupBy(*names, "i").agg(F.first("at").alias("at"), lower.alias("lower"), upper.alias("upper"), missed.alias("missed"))
    step = F.col("at") - F.floor("at")
    between = F.col("lower") if exact else F.when((step == 0) | (F.col("lower") == F.col("upper")), F.col("lower")).otherwise((1 - step) * F.col("lower") + step * F.col("upper"))
    lost = F.raise_error(F.lit("a sketch's bracket does not hold a rank")).cast("double" if not exact else groups.schema["_fold_least"].dataType)
    between = F.when(F.coalesce("missed", F.lit(False)) | F.col("upper").isNull(), lost).otherwise(between)
    found = ranked.groupBy(*names).agg(*[F.max(F.when(F.col("i") == i, between)).alias(f"_fold_q{i}") for i in range(len(fractions))])
    joined = groups.select(*by, "_fold_nan").join(found, _on(by, names), "left") if by else groups.select("_fold_nan").join(F.broadcast(found), F.lit(True), "left")
    values = [F.col(f"_fold_q{i}") for i in range(len(fractions))]
    if exact:
        value = values[0].cast(element) if kind != "float" else _narrowed(op, F.coalesce(values[0].cast("double"), F.lit(NAN)), element, axis)
    else:
        values = [F.when(F.col("_fold_nan"), F.lit(NAN)).otherwise(F.coalesce(v, F.lit(NAN))) for v in values]
        value = _narrowed(op, values[0] if scalar else F.array(*values), element, axis)
    return joined.select(*by, value.alias(alias))


def _exact_lower_median(rows: DataFrame, by: list[str], alias: str) -> DataFrame:
    """The lower median of types that doubles or aggregates do not keep: counts of values, summed in order."""
    counts = rows.filter(F.col(_X).isNotNull()).groupBy(*by, _X).agg(F.count(F.lit(1)).alias("n"))
    keys = [F.col(k) for k in by]
    place = F.sum("n").over(Window.partitionBy(*keys).orderBy(_X).rowsBetween(Window.unboundedPreceding, 0))
    half = F.sum("n").over(Window.partitionBy(*keys))
    ranked = counts.withColumns({"up_to": place, "total": half}).filter(F.col("up_to") * 2 >= F.col("total"))
    found = ranked.groupBy(*by).agg(F.min(_X).alias(alias))
    if not by:
        return found
    return rows.select(*by).distinct().join(found.select(*[F.col(k).alias(f"_fold_k{i}") for i, k in enumerate(by)], alias), [F.col(k).eqNullSafe(F.col(f"_fold_k{i}")) for i, k in enumerate(by)], "left").select(*by, alias)


# The 24 reductions under their public names: (df, column, axis=None, ...) -> DataFrame.


def _named(op: str, nan_aware: bool, doc: str):
    def call(df: DataFrame, column: str, axis: int | None = None, *, ignore_inf: bool = False, **options) -> DataFrame:
        if ignore_inf and not nan_aware:
            raise TypeError("ignore_inf belongs to the NaN-aware forms")
        return reduce(df, op, column, axis=axis, policy=Policy.nan_aware(ignore_inf) if nan_aware else Policy.ALL, **options)

    call.__doc__ = doc
    return call


_DOCS = {
    "mean": "arithmetic mean in double precision; NaN if empty",
    "average": "weighted mean sum(x*w)/sum(w); the mean without weights; zero total weight is an error",
    "sum": "sum; with weights the weighted sum, and on request the sum of weights and the plain sum; 0 if empty",
    "min": "least value",
    "max": "greatest value",
    "minmax": "struct of least and greatest value",
    "var": "variance with ddof, exact far from zero too, on request with the mean",
    "std": "square root of the variance",
    "median": "exact median",
    "percentile": "linear interpolation at q in [0, 100], one number or several",
    "quantile": "linear interpolation at q in [0, 1], one number or several",
}
for _op, _doc in _DOCS.items():
    globals()[_op] = _named(_op, False, f"The {_doc}. NaN propagates.")
    globals()[f"nan{_op}"] = _named(_op, True, f"The {_doc}. NaN is skipped, with ignore_inf=True infinity too.")
    globals()[_op].__name__, globals()[f"nan{_op}"].__name__ = _op, f"nan{_op}"
lmedian = _named("lmedian", True, "The lower median, of the column's own type. NaN is skipped, with ignore_inf=True infinity too.")
count_finite = _named("count_finite", False, "The number of finite values.")
lmedian.__name__, count_finite.__name__ = "lmedian", "count_finite"
NAMES = [*_DOCS, *(f"nan{x}" for x in _DOCS), "lmedian", "count_finite"]
