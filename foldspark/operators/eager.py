"""Python values of reductions: numbers for whole columns, NumPy arrays along an axis.

``value(df, op, column, ...)`` takes the options of ``frame.reduce``.  Only results come to the driver: one number, or one
a position.  Zero total weight raises ZeroDivisionError, as the plan's own error would only name the query.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row

from ..functions.columns import ZERO_WEIGHT
from .frame import reduce


def _plain(x: object) -> object:
    if isinstance(x, Row):
        return tuple(_plain(v) for v in x)
    return np.array(x) if isinstance(x, list) else x


def value(df: DataFrame, op: str, column: str, *, axis: int | None = None, order_by: str | Sequence[str] | None = None, **options) -> object:
    """axis=None: a number, a tuple (fused results) or an array (several q).  axis=0: an array by position; several
    results or q lead.  axis=-1: the same by row, in the order of ``order_by``, which is required."""
    if options.get("by"):
        raise ValueError("grouped reductions are DataFrames: use frame.reduce")
    if axis == -1 and order_by is None:
        raise ValueError("rows have no order of their own: say order_by")
    try:
        found = reduce(df, op, column, axis=axis, alias="_fold_value", **options)
        if axis is None:
            return _plain(found.first()[0])
        keys = ["pos"] if axis == 0 else [order_by] if isinstance(order_by, str) else list(order_by)
        rows = [_plain(r["_fold_value"]) for r in found.select(*keys, "_fold_value").orderBy(*keys).collect()]
    except PySparkException as error:
        if ZERO_WEIGHT in str(error):
            raise ZeroDivisionError(ZERO_WEIGHT) from error
        raise
    if rows and isinstance(rows[0], tuple):
        return tuple(np.array(x) for x in zip(*rows, strict=True))
    return np.stack(rows, 1) if rows and isinstance(rows[0], np.ndarray) else np.array(rows)
