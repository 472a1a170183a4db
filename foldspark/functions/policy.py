"""What counts as an element: NaN policies, element kinds, and the types of results.

NULL is never an element.  NaN and infinity are values of floating columns, and the policy says which of them take part.
"""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAN = float("nan")
INF = float("inf")


class Policy(Enum):
    ALL = "all"  # NaN propagates
    TRUSTED = "trusted"  # the caller promises that there is no NaN
    SKIP_NAN = "skip_nan"
    FINITE = "finite"  # neither NaN nor infinity

    @staticmethod
    def nan_aware(ignore_inf: bool) -> Policy:
        return Policy.FINITE if ignore_inf else Policy.SKIP_NAN

    @property
    def skips(self) -> bool:
        return self in (Policy.SKIP_NAN, Policy.FINITE)


_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def kind_of(kind: T.DataType) -> str:
    """"float", "int", "wide" (64 bits and more, not exact as a double) or "bool"; TypeError for anything else."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.LongType) or (isinstance(kind, T.DecimalType) and kind.scale == 0):
        return "wide"
    if isinstance(kind, _INTEGERS):
        return "int"
    raise TypeError(f"real numeric types only: boolean, integers, float, double, decimal(p, 0); not {kind.simpleString()}")


def keeps(x: Column, kind: str, policy: Policy) -> Column:
    """Whether a value takes part; NULL or false if not."""
    if kind != "float" or not policy.skips:
        return x.isNotNull()
    return ~F.isnan(x) if policy is Policy.SKIP_NAN else F.abs(x) < F.lit(INF)


def kept(x: Column, kind: str, policy: Policy) -> Column:
    """The value if it takes part, else NULL."""
    return F.when(keeps(x, kind, policy), x) if kind == "float" and policy.skips else x


def as_double(x: Column, kind: str) -> Column:
    return (x.cast("int") if kind == "bool" else x).cast("double")


def checked_q(q: float | Sequence[float], percent: bool) -> tuple[list[float], bool]:
    """Fractions in [0, 1] by way of percent, and whether q was one number.  ValueError outside the range."""
    scalar = isinstance(q, (int, float)) and not isinstance(q, bool)
    values = [q] if scalar else list(q)
    top = 100.0 if percent else 1.0
    out = []
    for value in values:
        if isinstance(value, (list, tuple)):
            raise ValueError("q must be a number or one-dimensional")
        value = float(value)
        if not 0.0 <= value <= top:
            raise ValueError(f"q must be in [0, {top:g}]")
        out.append((value if percent else value * 100.0) / 100.0)
    if not out:
        raise ValueError("q must not be empty")
    return out, scalar


def checked_ddof(ddof: int) -> int:
    if isinstance(ddof, bool) or int(ddof) != ddof or ddof < 0:
        raise ValueError("ddof must be a non-negative integer")
    return int(ddof)
