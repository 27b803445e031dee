"""Column functions on vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pad_vector(c: Column, dims: int) -> Column:
    """To exactly max(8, dims): zeros to the right, or cut."""
    n = max(8, dims)
    return F.slice(F.concat(c.cast("array<float>"), F.array_repeat(F.lit(0.0).cast("float"), n)), 1, n)


def rounded(c: Column, digits: int) -> Column:
    """Rounded as doubles are: what is below zero keeps its sign where it becomes zero."""
    return F.signum(c) * F.abs(F.round(c, digits))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(data: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to an array; a length that is no multiple of 4 is an error."""

    def one(b):
        if len(b) % 4:
            raise ValueError(f"{len(b)} bytes are no float32 vector")
        return np.frombuffer(b, "<f4")

    return data.map(one, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def encode_vector(v: pd.Series) -> pd.Series:
    return v.map(lambda x: np.asarray(x, "<f4").tobytes(), na_action="ignore")


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 if a norm is 0. Products in float32, sums in double."""

    def total(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: (p.cast("float") * q.cast("float")).cast("double")), F.lit(0.0), lambda s, v: s + v)

    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    norm = F.sqrt(total(x, x)) * F.sqrt(total(y, y))
    return F.when(norm > 0, total(x, y) / norm).otherwise(0.0)
