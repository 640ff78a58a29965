"""The functions of this package that Spark has no expression for, as columns, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rank_between, slug


def between(low: Column, high: Column) -> Column:
    """rank_between() of two ranks; null is an open end. Null where the lower rank doesn't sort first."""

    @F.pandas_udf("string")
    def run(lows: pd.Series, highs: pd.Series) -> pd.Series:
        pairs = ((None if pd.isna(a) else a, None if pd.isna(b) else b) for a, b in zip(lows, highs, strict=True))
        return pd.Series([None if a is not None and b is not None and a >= b else rank_between(a, b) for a, b in pairs], dtype=object)

    return run(low, high)


def slugged(text: Column) -> Column:
    """slug() of each text; null is as empty."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([slug(None if pd.isna(t) else t) for t in texts], dtype=object)

    return run(text)
