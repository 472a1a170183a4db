"""Tables in and out, and arrays as tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "csv", "json")
_TYPES = {
    "float64": T.DoubleType(), "float32": T.FloatType(), "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(),
    "int32": T.IntegerType(), "int64": T.LongType(), "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
}


def read(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """A table; options are the reader's.  Text formats need a schema for exact types."""
    if format not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    schema = options.pop("schema", None)
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options) -> None:
    if format not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    df.write.format(format).mode(mode).options(**options).partitionBy(*partition_by).save(path)


def element_type(kind: np.dtype) -> T.DataType:
    """The column type that holds a NumPy type; unsigned types widen.  TypeError for what is not real and numeric."""
    if kind.name not in _TYPES:
        raise TypeError(f"real numeric types only, not {kind.name}")
    return _TYPES[kind.name]


def _items(a: np.ndarray) -> list:
    if a.dtype.name == "uint64":
        from decimal import Decimal

        return [Decimal(int(x)) for x in a]
    return a.tolist()


def vector(spark: SparkSession, a: object, weights: object = None) -> DataFrame:
    """A whole array, flattened: pos, x and, with weights, w."""
    a = np.asarray(a)
    fields = [T.StructField("pos", T.LongType()), T.StructField("x", element_type(a.dtype))]
    parts = [range(a.size), _items(a.ravel())]
    if weights is not None:
        w = np.asarray(weights)
        if w.shape != a.shape:
            raise ValueError("weights must have the same shape as the values")
        fields.append(T.StructField("w", element_type(w.dtype)))
        parts.append(_items(w.ravel()))
    return spark.createDataFrame(list(zip(*parts, strict=True)), T.StructType(fields))


def stack(spark: SparkSession, a: object, axis: int = 0, weights: object = None) -> DataFrame:
    """An array of two dimensions and more as rows (row, a): axis 0 flattens what follows the first dimension, axis -1 what
    precedes the last.  weights: of the same shape, or one for each place along the reduced axis (w a row, or w arrays)."""
    a = np.asarray(a)
    if a.ndim == 0:
        raise ValueError("a scalar has no axis")
    if axis not in (0, -1, a.ndim - 1):
        raise NotImplementedError("axis must be the first or the last")
    flat = a.reshape(a.shape[0], -1) if axis == 0 else a.reshape(-1, a.shape[-1])
    fields = [T.StructField("row", T.LongType()), T.StructField("a", T.ArrayType(element_type(a.dtype)))]
    parts: list = [range(len(flat)), [_items(r) for r in flat]]
    if weights is not None:
        w = np.asarray(weights)
        if w.shape == a.shape:
            parts.append([_items(r) for r in w.reshape(flat.shape)])
            fields.append(T.StructField("w", T.ArrayType(element_type(w.dtype))))
        elif w.ndim == 1 and axis == 0 and len(w) == len(flat):
            parts.append(_items(w))
            fields.append(T.StructField("w", element_type(w.dtype)))
        elif w.ndim == 1 and axis != 0 and len(w) == flat.shape[1]:
            parts.append([_items(w)] * len(flat))
            fields.append(T.StructField("w", T.ArrayType(element_type(w.dtype))))
        else:
            raise ValueError("weights must have the same shape as the values, or the length of the reduction axis")
    return spark.createDataFrame(list(zip(*parts, strict=True)), T.StructType(fields))
