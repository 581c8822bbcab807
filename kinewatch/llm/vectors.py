"""What the two vector operators share: usable vectors as bytes, and numpy views of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and all of its components are numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def matrix(blobs, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), size)


def packed(df: DataFrame, columns: list[str], vector: str = "embedding") -> DataFrame:
    """columns, dim and blob: the components as double precision bytes."""
    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x, np.float64).tobytes())

    return df.select(*columns, F.size(vector).alias("dim"), pack(F.col(vector)).alias("blob"))
