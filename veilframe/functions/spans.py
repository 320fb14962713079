"""Span arrays as SQL expression text: find matches, read facts from spans, settle overlaps.

A span is ``struct<start, end, entity_type, score, text>``; offsets are 0-based, end-exclusive and
count code points, as ``substring`` and ``char_length`` do.
"""

from __future__ import annotations

from collections.abc import Callable

from veilframe.functions.sqltext import let, lit

SPAN_TYPE = "struct<start:int,end:int,entity_type:string,score:double,text:string>"
SPAN_ARRAY = f"array<{SPAN_TYPE}>"
NO_SPANS = f"cast(array() as {SPAN_ARRAY})"
_MARK = "'\\u0001'"
_NO_HITS = "cast(array() as array<struct<start:int,end:int,text:string>>)"


BLOCK = 64
HIT_TYPE = "struct<start:int,end:int,text:string>"


def gathered(values: str, kind: str, make: str, advance: Callable[[str], str]) -> str:
    """A fold over ``values`` that carries a whole number ``acc.at`` from 0 on and gathers ``make`` for each value ``v``.

    ``advance`` gives the next number from the present one.  More than a block of values go in two levels, blocks and values
    within them: what a fold carries is copied at every step, so one fold that gathers all values would take
    time in proportion to the square of their number.
    """
    def fold(over: str, start: str, kind: str = kind, make: str = make, step: str = advance("acc.at")) -> str:
        return (
            f"aggregate({over}, struct({start} as at, cast(array() as array<{kind}>) as done), (acc, v) -> "
            f"struct({step} as at, array_append(acc.done, {make}) as done), acc -> acc.done)"
        )

    def joined(blocks: str) -> str:
        # Both kinds of carried number (sums, maxima) are carried on from block to block like from value to value.
        starts = (
            f"aggregate({blocks}, struct(0 as at, cast(array() as array<int>) as done), (acc, blk) -> struct("
            f"aggregate(blk, acc.at, (t, v) -> {advance('t')}) as at, array_append(acc.done, acc.at) as done), acc -> acc.done)"
        )
        return f"flatten(zip_with({blocks}, {starts}, (blk, from_) -> {fold('blk', 'from_')}))"

    def cut(v: str) -> str:
        blocks = f"transform(sequence(1, size({v}), {BLOCK}), b -> slice({v}, b, {BLOCK}))"
        return f"if(size({v}) <= {BLOCK}, {fold(v, '0')}, {let('blocks', blocks, joined)})"

    return let("vals", values, cut)


def prefixes(values: str, larger: bool = False) -> str:
    """For each value the sum (or with ``larger`` the maximum) of those before it, 0 for the first."""
    return gathered(values, "int", "acc.at", lambda at: f"greatest({at}, v)" if larger else f"{at} + v")


def gaps(text: str, pattern: str) -> str:
    """The text between the matches of ``pattern``, for a text that has some.

    ``split`` compiles its pattern anew for every row, so the matches are first replaced by one control character
    (that pattern is compiled once) and the text is cut there; a text that holds the character itself is split by
    the pattern.
    """
    return (
        f"if(contains({text}, {_MARK}), split({text}, {lit(pattern)}, -1), "
        f"split(regexp_replace({text}, {lit(pattern)}, {_MARK}), {_MARK}, -1))"
    )


def matches(text: str, pattern: str) -> str:
    """Every match of ``pattern`` and the text between matches: ``struct<hits, gaps>``.  Only rows with a match are split."""
    return let(
        "found", f"regexp_extract_all({text}, {lit(pattern)}, 0)",
        lambda f: f"struct({f} as hits, if(size({f}) > 0, {gaps(text, pattern)}, cast(null as array<string>)) as gaps)",
    )


#: Up to this many matches are looked up in the text one by one.
FEW = 4


def looked_up(text: str, hits: str, else_: str, facts: str = "", base: str = "0") -> str:
    """The same as ``placed`` for a few matches, without the text between them.

    Where the text of each occurs once in ``text`` it stands there; otherwise ``else_`` tells.
    """
    def where(at: str) -> str:
        once = f"forall(zip_with({hits}, {at}, (hit, p) -> p > 0 and locate(hit, {text}, p + 1) = 0), x -> x)"
        spans = (
            f"zip_with({hits}, {at}, (hit, p) -> struct({facts}{base} + p - 1 as start, "
            f"{base} + p - 1 + char_length(hit) as end, hit as text))"
        )
        return f"if({at} is not null and {once}, {spans}, {else_})"

    return let("at", f"if(size({hits}) <= {FEW}, transform({hits}, hit -> instr({text}, hit)), null)", where)


def placed(hits: str, gaps: str, kind: str = HIT_TYPE, facts: str = "", base: str = "0") -> str:
    """``array<struct<..facts, start, end, text>>`` of matches; empty ones have ``end = start``.

    The text between matches and the matches alternate, so a running sum of their lengths gives the offsets.
    """
    pairs = f"zip_with(slice({gaps}, 1, size({hits})), {hits}, (gap, hit) -> struct(char_length(gap) as gap, hit as hit))"
    make = (
        f"struct({facts}{base} + acc.at + v.gap as start, {base} + acc.at + v.gap + char_length(v.hit) as end, v.hit as text)"
    )
    return gathered(pairs, kind, make, lambda at: f"{at} + v.gap + char_length(v.hit)")


def match_offsets(text: str, pattern: str) -> str:
    """Every match of ``pattern`` that is not empty, with its offsets."""
    return let("m", matches(text, pattern), lambda m: (
        f"if(size({m}.hits) > 0, filter({placed(f'{m}.hits', f'{m}.gaps')}, h -> h.end > h.start), {_NO_HITS})"))


def entity_types(spans: str) -> str:
    """Distinct entity types, ascending."""
    return f"array_sort(array_distinct(transform({spans}, s -> s.entity_type)))"


def without_values(spans: str) -> str:
    """The spans without the matched personal data."""
    return (
        f"transform({spans}, s -> struct(s.start as start, s.end as end, "
        "s.entity_type as entity_type, s.score as score))"
    )


def shifted(spans: str, by: str) -> str:
    """The spans moved right by ``by`` code points."""
    return (
        f"transform({spans}, s -> struct(s.start + {by} as start, s.end + {by} as end, "
        "s.entity_type as entity_type, s.score as score, s.text as text))"
    )


def resolve_overlaps(spans: str, in_order: bool = False) -> str:
    """Keep the best spans so that none overlap, ordered by start.

    Priority: higher score, then longer, then earlier, then type name.  Spans are first cut into
    runs of chained overlaps; only spans of one run are compared pairwise, so a text with many
    spread-out spans costs one pass.  ``in_order`` says that they are sorted already.
    """

    def settle(ordered: str) -> str:
        clash = f"""aggregate({ordered}, struct(0 as reach, false as clash),
            (acc, s) -> struct(greatest(acc.reach, s.end) as reach,
                               acc.clash or s.start < acc.reach as clash),
            acc -> acc.clash)"""
        best = f"flatten(transform({_runs(ordered)}, run -> if(size(run) > 1, {best_of_run('run')}, run)))"
        return f"if(size({ordered}) > 1, if({clash}, {best}, {ordered}), {ordered})"

    return settle(spans) if in_order else let("ordered", f"array_sort({spans})", settle)


def _runs(ordered: str) -> str:
    """Start-ordered spans cut into maximal runs of chained overlaps.

    A run opens where a span starts at or after the farthest end so far.
    """
    reach = prefixes(f"transform({ordered}, s -> s.end)", larger=True)
    opens = (
        f"filter(zip_with(sequence(1, size({ordered})), zip_with({ordered}, {reach}, (s, r) -> "
        "s.start >= r), (i, o) -> if(o, i, null)), i -> i is not null)"
    )
    return let("opens", opens, lambda o: (
        f"zip_with({o}, concat(slice({o}, 2, size({o})), array(size({ordered}) + 1)), "
        f"(a, b) -> slice({ordered}, a, b - a))"
    ))


def best_of_run(run: str) -> str:
    """Greedy choice inside one run, by priority, returned in start order."""
    ranked = f"""array_sort(transform({run}, s -> struct(
        -s.score as by_score, s.start - s.end as by_length, s.start as by_start,
        s.entity_type as by_type, s as span)))"""
    return f"""array_sort(aggregate({ranked}, {NO_SPANS}, (kept, r) ->
        if(exists(kept, k -> k.start < r.span.end and r.span.start < k.end),
           kept, array_append(kept, r.span))))"""


def rewritten(text: str, spans: str, replacement: Callable[[str], str]) -> str:
    """``text`` with every span replaced; ``spans`` must be start-ordered and disjoint."""
    return f"""if(size({spans}) > 0,
      array_join(zip_with({spans}, concat(array(0), transform({spans}, s -> s.end)),
        (s, prev) -> if(s is null,
          substring({text}, prev + 1),
          concat(substring({text}, prev + 1, s.start - prev), {replacement('s')}))), ''),
      {text})"""
