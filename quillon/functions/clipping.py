"""Nested JSON with long texts cut. Python over Arrow batches, as built-in functions can't walk JSON of any shape."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD, WHOLE = 2000, 16_384


def clipped(value, each: int = FIELD):
    """A JSON value with every text cut to `each` characters."""
    if isinstance(value, str):
        return cut(value, each)
    if isinstance(value, list):
        return [clipped(x, each) for x in value]
    if isinstance(value, dict):
        return {k: clipped(x, each) for k, x in value.items()}
    return value


def cut(text: str, n: int) -> str:
    return text if len(text) <= n else f"{text[:n]}…(+{len(text) - n} characters)"


@F.pandas_udf(T.StringType())
def clipped_json(text: pd.Series) -> pd.Series:
    """Nested JSON with long texts cut, and cut as a whole, too; what isn't JSON is null."""

    def one(x):
        try:
            return cut(json.dumps(clipped(json.loads(x)), ensure_ascii=False, separators=(",", ":")), WHOLE)
        except (TypeError, ValueError):
            return None

    return text.map(one)
