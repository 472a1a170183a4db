"""Reductions of streams in event-time windows.

Sums, means, extremes, counts and weighted sums merge, and keep a few numbers a window and group.  Variance is one-pass
here, as a stream cannot be read twice.  Exact order statistics would keep every value of a window, and are refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MERGEABLE = ("mean", "sum", "min", "max", "minmax", "var", "std", "average", "count_finite")


def windowed(events: DataFrame, time: str, values: dict[str, Column], *, length: str, slide: str | None = None, session: bool = False, late: str = "10 minutes", by: Sequence[str] = ()) -> DataFrame:
    """Aggregate columns (of ``functions.columns``) in tumbling, sliding or session windows; rows later than ``late`` go.

    Returns start, end, the keys, and one column for each entry of ``values``.
    """
    if session and slide:
        raise ValueError("session windows do not slide")
    window = F.session_window(time, length) if session else F.window(time, length, slide) if slide else F.window(time, length)
    name = "session_window" if session else "window"
    found = events.withWatermark(time, late).groupBy(window, *by).agg(*[c.alias(n) for n, c in values.items()])
    return found.select(F.col(name)["start"].alias("start"), F.col(name)["end"].alias("end"), *by, *values)


def reduced(events: DataFrame, time: str, op: str, column: str, *, length: str, ignore_inf: bool | None = None, weights: str | None = None, ddof: int = 0, alias: str = "value", **options) -> DataFrame:
    """One reduction in windows; ignore_inf None is the plain form, False and True are the NaN-aware ones."""
    from ..functions import columns
    from ..functions.policy import Policy, kind_of

    if op not in MERGEABLE:
        raise ValueError(f"{op} keeps every value of a window; on streams use one of {', '.join(MERGEABLE)}")
    policy = Policy.ALL if ignore_inf is None else Policy.nan_aware(ignore_inf)
    kind = kind_of(events.schema[column].dataType)
    if op in ("var", "std"):
        value = columns.var_of(column, policy, kind, ddof, root=op == "std")
    elif op == "average":
        value = columns.average_of(column, weights, policy, kind)
    elif op == "sum" and weights:
        value = columns.weighted_sum_of(column, weights, policy, kind)
    elif op == "count_finite":
        value = columns.count_finite_of(column, kind)
    else:
        value = getattr(columns, f"{op}_of")(column, policy, kind)
    return windowed(events, time, {alias: value}, length=length, **options)
