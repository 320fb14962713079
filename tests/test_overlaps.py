"""Overlaps in long chains against the expression and a plain version."""

import random
import time

from conftest import texts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe import RecognizerRegistry, with_spans
from veilframe.functions.spans import SPAN_ARRAY, resolve_overlaps
from veilframe.operators import overlaps
from veilframe.plans.span_tables import resolve_table

_span = st.builds(lambda s, n, t, p: {"start": s, "end": s + n, "entity_type": t, "score": p, "text": "x"},
                  st.integers(0, 30), st.integers(1, 8), st.sampled_from("ABC"), st.sampled_from([0.4, 0.5, 1.0]))


def plain_version(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (-s["score"], s["start"] - s["end"], s["start"], s["entity_type"])):
        if all(s["end"] <= k["start"] or k["end"] <= s["start"] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s["start"])


@settings(max_examples=300, deadline=None)
@given(st.lists(_span, max_size=25))
def test_plain_version(spans):
    assert overlaps.best_of(spans) == plain_version(spans)


def test_equal_to_the_expression(spark, monkeypatch):
    draw = random.Random(4)
    sets = [[(s := draw.randrange(60), s + draw.randrange(1, 9), draw.choice("ABC"), draw.choice([0.4, 0.5, 1.0]), "x")
             for _ in range(draw.randrange(40))] for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(sets)), f"id int, spans {SPAN_ARRAY}")
    monkeypatch.setattr(overlaps, "MANY", 3)
    rows = frame.select(F.expr(resolve_overlaps("spans")).alias("a"), overlaps.settled("spans").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)


def windows(n, width, step=1):
    return f"transform(sequence(0, {n - 1}), i -> struct(int(i * {step}) as start, int(i * {step} + {width}) as end, 'W' as entity_type, " \
           f"double(i % 7) / 10 + 0.4 as score, 'x' as text))"


def test_a_hundred_thousand_in_one_chain(spark):
    """All overlapping one point, and a chain of which very many stay."""
    for spans, expected in ((windows(100_000, 100_001), 1), (windows(100_000, 5, 2), None)):
        frame = spark.range(1).select("id", F.expr(f"explode({spans.replace('sequence(0,', 'sequence(int(id),')})").alias("s")).select("id", "s.*")
        start = time.time()
        kept = resolve_table(frame, ["id"]).orderBy("start").collect()
        assert time.time() - start < 60
        if expected:
            assert len(kept) == expected
        else:
            assert len(kept) > 25_000 and all(a["end"] <= b["start"] for a, b in zip(kept, kept[1:]))


def test_detectors_with_many_spans(spark):
    value = F.expr(f"if(id = 0, {windows(20_000, 5, 2)}, cast(null as {SPAN_ARRAY}))")
    out = with_spans(texts(spark, "a" * 40_010, "b@c.de").withColumn("mine", value), registry=RecognizerRegistry(()),
                     detectors=[lambda text: F.col("mine")]).orderBy("id").select("spans").collect()
    first = [s.asDict() for s in out[0]["spans"]]
    assert first == overlaps.best_of([{"start": 2 * i, "end": 2 * i + 5, "entity_type": "W", "score": round(i % 7 / 10 + 0.4, 4), "text": "x"} for i in range(20_000)])
    assert out[1]["spans"] == []
