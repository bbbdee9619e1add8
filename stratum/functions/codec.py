"""zstd for chunk data, in Arrow batches; Spark has no such expression."""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

LEVEL = 5


@F.pandas_udf(BinaryType())
def compress(data: pd.Series) -> pd.Series:
    press = zstandard.ZstdCompressor(level=LEVEL)
    return data.map(lambda x: None if x is None else press.compress(bytes(x)))


@F.pandas_udf(BinaryType())
def decompress(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else zstandard.ZstdDecompressor().decompress(bytes(x)))
