"""Detection: a registry and settings become one span-array expression."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.spans import NO_SPANS, gaps, gathered, looked_up, placed, resolve_overlaps
from veilframe.functions.sqltext import ident, let, lit, lits
from veilframe.operators.recognizers import (
    CONTEXT_CHARS,
    GATES,
    Recognizer,
    RecognizerRegistry,
    any_of,
)

# Up to this length a text is searched as a whole: cutting it into lines would cost more.
WHOLE_CHARS = 600


def _context(text: str, start: str, lead: str | None) -> str:
    """The characters just before a span; ``lead`` is what came before ``text`` itself."""
    if lead is None:
        first = f"greatest({start} - {CONTEXT_CHARS}, 0)"
        return f"substring({text}, {first} + 1, {start} - {first})"
    head = f"concat({lead}, substring({text}, 1, {start}))"
    return (
        f"if({start} >= {CONTEXT_CHARS}, "
        f"substring({text}, {start} - {CONTEXT_CHARS} + 1, {CONTEXT_CHARS}), "
        f"right({head}, {CONTEXT_CHARS}))"
    )


_FOUND = "array<struct<k:int,q:int,base:int,line:string,hits:array<string>>>"
# In a larger group so many recognizers share a test of their own.
TESTED_TOGETHER = 4


def _numbered(chosen: Sequence[Recognizer]) -> dict[tuple[int, str], int]:
    """A number for every pattern of every recognizer."""
    return {key: q for q, key in enumerate(dict.fromkeys((k, p) for k, r in enumerate(chosen) for p in r.regexes))}


def _matches_in(
    members: Sequence[tuple[int, Recognizer]], text: str, base: str, gated: bool, numbers: dict[tuple[int, str], int]
) -> str:
    """What each recognizer's patterns match in ``text``, which starts at ``base``; offsets are worked out later."""
    def one(k: int, r: Recognizer, pattern: str) -> str:
        hits = f"regexp_extract_all({text}, {lit(pattern)}, 0)"
        found = f"struct({k} as k, {numbers[k, pattern]} as q, {base} as base, {text} as line, {hits} as hits)"
        return f"if({r.needs(text)}, {found}, null)" if r.needs and gated else found

    def listed(some: Sequence[tuple[int, Recognizer]]) -> str:
        return f"filter(array({', '.join(one(k, r, p) for k, r in some for p in r.regexes)}), x -> size(x.hits) > 0)"

    if not _tested_apart(members, gated):
        return listed(members)
    parts = []
    for some in _alike(members):
        test = f"{text} rlike {lit(any_of(p for _, r in some for p in r.patterns))}"
        if len(some) > 1 and len({r.needs for _, r in some}) == 1 and some[0][1].needs:
            test, some = some[0][1].needs(text), [(k, replace(r, needs=None)) for k, r in some]
        parts.append(listed(some) if len(some) < 3 else f"if({test}, {listed(some)}, cast(array() as {_FOUND}))")
    return f"concat({', '.join(parts)})"


def _tested_apart(members: Sequence[tuple[int, Recognizer]], gated: bool) -> bool:
    return gated and len(members) > TESTED_TOGETHER and all(r.headed for _, r in members)


def _alike(members: Sequence[tuple[int, Recognizer]]) -> list[list[tuple[int, Recognizer]]]:
    """The recognizers in small sets that tend to match the same texts: those with one cheap test in common, those whose
    matches begin with a letter, and the others."""
    needs = Counter(r.needs for _, r in members if r.needs)
    sets: dict[object, list[tuple[int, Recognizer]]] = {}
    for k, r in members:
        key = r.needs if needs[r.needs] > 2 else any(c.isalpha() for p in r.patterns for c in p.first)
        sets.setdefault(key, []).append((k, r))
    return [s[i : i + TESTED_TOGETHER] for s in sets.values() for i in range(0, len(s), TESTED_TOGETHER)]


def _spans_of(
    found: str, chosen: Sequence[Recognizer], threshold: float, lead: str | None, whole: str,
    numbers: dict[tuple[int, str], int],
) -> str:
    """Matches of all recognizers as spans.  Every step is written once for all of them: the number ``k`` of a
    match's recognizer picks its type, score, checks and context words."""
    between = " ".join(f"when {q} then {gaps('x.line', pattern)}" for (_, pattern), q in numbers.items())
    kind = "struct<k:int,start:int,end:int,text:string>"
    where = looked_up("x.line", "x.hits", placed("x.hits", f"case x.q {between} end", kind, "x.k as k, ", "x.base"), "x.k as k, ", "x.base")
    hits = f"flatten(transform({found}, x -> {where}))"
    refined = {k: r.refine for k, r in enumerate(chosen) if r.refine}
    if refined:
        cases = " ".join(f"when {k} then {f('h.text')}" for k, f in refined.items())
        hits = (
            f"flatten(transform({hits}, h -> if(h.k in ({', '.join(map(str, refined))}), transform(case h.k {cases} end, r -> "
            "struct(h.k as k, h.start + r.at as start, h.start + r.at + char_length(r.text) as end, r.text as text)), array(h))))"
        )
    checks = {k: r.check for k, r in enumerate(chosen) if r.check}
    cases = " ".join(f"when {k} then {f('h.text')}" for k, f in checks.items())
    valid = f" and case h.k {cases} else true end" if checks else ""
    hits = f"filter({hits}, h -> h.end > h.start{valid})"
    if any(len(r.patterns) > 1 for r in chosen):
        hits = f"array_distinct({hits})"
    score = _by_number(f"{round(r.score, 4)}D" for r in chosen)
    context = {k: r for k, r in enumerate(chosen) if r.context_words}
    if context:
        words = " ".join(f"when {k} then array({lits(w.lower() for w in r.context_words)})" for k, r in context.items())
        near = let(
            "before", f"lower({_context(whole, 'h.start', lead)})",
            lambda b: f"exists(case h.k {words} end, w -> contains({b}, w))",
        )
        high = " ".join(f"when {k} then {round(r.max_score, 4)}D" for k, r in context.items())
        listed = ", ".join(map(str, context))
        score = f"if(if(h.k in ({listed}), {near}, false), case h.k {high} end, {score})"
    kind = _by_number(lit(r.entity_type) for r in chosen)
    spans = (
        f"transform({hits}, h -> struct(h.start as start, h.end as end, {kind} as entity_type, "
        f"{score} as score, h.text as text))"
    )
    if any(r.score < threshold for r in chosen):
        spans = f"filter({spans}, s -> s.score >= {threshold}D)"
    return f"if(size({found}) = 0, {NO_SPANS}, {spans})"


def _by_number(values: Iterable[str]) -> str:
    listed = list(values)
    return listed[0] if len(set(listed)) == 1 else f"array({', '.join(listed)})[h.k]"


def _lines(text: str) -> str:
    """The lines of a text with their starts."""
    return gathered(
        f"split({text}, '\\n', -1)", "struct<base:int,line:string>", "struct(acc.at as base, v as line)",
        lambda at: f"{at} + char_length(v) + 1")


def spans_sql(
    text: str,
    registry: RecognizerRegistry | None = None,
    *,
    entities: Iterable[str] | None = None,
    language: str | None = "en",
    language_col: str | None = None,
    score_threshold: float = 0.4,
    gated: bool = True,
    resolve: bool = True,
    extra_span_cols: Sequence[str] = (),
    lead: str | None = None,
) -> str:
    """SQL text for all spans of ``text`` that reach ``score_threshold``, start-ordered.

    ``language`` selects recognizers when the plan is built; ``language_col`` selects them per row
    instead.  ``gated`` skips whole groups of recognizers on texts without a character they need,
    or, by one shared scan, without a match of any of them; in long texts the same test then picks
    the lines to look at.  It changes the cost, never the result.  ``extra_span_cols`` names span
    columns of the caller's own detectors.  ``resolve=False`` keeps overlapping spans.
    """
    registry = registry or RecognizerRegistry()
    wanted = None if entities is None else sorted(set(entities))
    per_row = language_col is not None
    chosen = registry.select(wanted, None if per_row else language, score_threshold)

    numbers = _numbered(chosen)
    groups: dict[tuple, list[tuple[int, Recognizer]]] = {}
    for k, r in enumerate(chosen):
        key = (r.gate if gated else None, r.languages if per_row else (), r.headed)
        groups.setdefault(key, []).append((k, r))

    def build(t: str) -> str:
        tests, parts, by_line = [], [], []
        for i, ((gate, languages, headed), members) in enumerate(groups.items()):
            wants = [f"{ident(language_col)} in ({lits(languages)})"] if languages else []
            if gate:
                wants.append(GATES[gate](t))
            narrow = GATES[gate] if gate else None
            if gated and headed and len(members) > 1:
                shared = lit(any_of(p for _, r in members for p in r.patterns))
                narrow = lambda text, shared=shared: f"{text} rlike {shared}"
                short = f"char_length({t}) <= {WHOLE_CHARS} or " if _tested_apart(members, gated) else ""
                wants.append(f"({short}{narrow(t)})")
            tests.append(" and ".join(wants) or "true")
            if narrow and headed and all(r.line_bounded for _, r in members):
                by_line.append(i)
                part = (
                    f"flatten(transform(filter(lns, ln -> size(lns) = 1 or {narrow('ln.line')}), ln -> "
                    f"{_matches_in(members, 'ln.line', 'ln.base', gated, numbers)}))"
                )
            else:
                part = _matches_in(members, t, "0", gated, numbers)
            parts.append(f"if(on[{i}], {part}, cast(array() as {_FOUND}))")
        spans = []
        if parts:
            # A short text is searched as a whole, a long one only in lines that pass the group's test.
            cut = f"char_length({t}) > {WHOLE_CHARS} and ({' or '.join(f'on[{i}]' for i in by_line)})"
            whole = f"array(struct(0 as base, {t} as line))"
            lines = f"if({cut}, {_lines(t)}, {whole})" if by_line else whole
            every = parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"
            found = let("on", f"array({', '.join(tests)})", lambda on: (
                f"if(exists({on}, o -> o), {let('lns', lines, lambda _: every)}, cast(array() as {_FOUND}))"))
            spans.append(let("all", found, lambda f: _spans_of(f, chosen, score_threshold, lead, t, numbers)))
        for name in extra_span_cols:
            named = "" if wanted is None else f" and s.entity_type in ({lits(wanted)})"
            spans.append(
                f"transform(filter(coalesce({ident(name)}, {NO_SPANS}), "
                f"s -> s.score >= {score_threshold}D{named}), s -> struct(s.start as start, "
                "s.end as end, s.entity_type as entity_type, round(s.score, 4) as score, "
                "s.text as text))"
            )
        if not spans:
            return NO_SPANS
        found = spans[0] if len(spans) == 1 else f"concat({', '.join(spans)})"
        return resolve_overlaps(found) if resolve else f"sort_array({found})"

    return let("body", text, build)


def detect(text_col: str, registry: RecognizerRegistry | None = None, **settings) -> Column:
    """The span-array column of a text column; see ``spans_sql`` for the settings."""
    return F.expr(spans_sql(ident(text_col), registry, **settings))
