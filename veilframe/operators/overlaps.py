"""Overlaps in long chains: the same choice as the expression in ``functions.spans``, in n log n steps.

The expression compares a span with all spans kept so far in its chain.  That is the fast way for the few spans that
texts have as a rule; for chains of many (a caller's detector that reports sliding windows) each span is looked up
among the kept ones by its place instead.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.spans import SPAN_ARRAY, best_of_run, resolve_overlaps

#: From this number of spans on the place is looked up.
MANY = 256


def best_of(spans: list[dict]) -> list[dict]:
    """The spans that stay, by start: a span stays if no better one that stays overlaps it.

    Higher score, then longer, then earlier, then type name.  Spans that stay are disjoint, so only the last one
    that starts before a span's end can overlap it.
    """
    starts: list[int] = []
    kept: list[dict] = []
    for s in sorted(spans, key=lambda s: (-s["score"], s["start"] - s["end"], s["start"], s["entity_type"])):
        at = bisect_right(starts, s["end"] - 1)
        if at and kept[at - 1]["end"] > s["start"]:
            continue
        starts.insert(at, s["start"])
        kept.insert(at, s)
    return kept


def _best_of_many(runs: pd.Series) -> pd.Series:
    return runs.map(lambda run: None if run is None else best_of(list(run)))


def settled(spans: str) -> Column:
    """The span-array column with overlaps settled, however many spans are chained in a row."""
    return _by_size(spans, resolve_overlaps(spans))


def settled_run(run: str) -> Column:
    """The same for an array that is one run of chained overlaps, in any order: it need not be cut into runs."""
    return _by_size(run, f"if(size({run}) > 1, {best_of_run(run)}, {run})")


def _by_size(spans: str, few: str) -> Column:
    many = f"size({spans}) > {MANY}"
    of_many = F.pandas_udf(_best_of_many, SPAN_ARRAY)
    return F.coalesce(F.expr(f"if({many}, null, {few})"), of_many(F.expr(f"if({many}, {spans}, null)")))
