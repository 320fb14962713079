"""Detectors of the caller: any function from a text column to a span array."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.spans import SPAN_ARRAY


def arrow_detector(
    find: Callable[[pd.Series], pd.Series],
) -> Callable[[Column], Column]:
    """Wrap a vectorized model: a Series of texts in, a Series of span-dict lists out.

    Each dict has start, end, entity_type, score and text.  Texts travel to Python in Arrow
    batches; everything after detection stays in the JVM.
    """

    def run(texts: pd.Series) -> pd.Series:
        return find(texts)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, SPAN_ARRAY)
