"""Recognizers: what to look for, how sure a match is, and how it is checked.

A registry is an immutable list of recognizers that lives on the driver.  The detector turns it
into one Catalyst expression, so a recognizer that an entity filter, a language or the score
threshold rules out costs nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from veilframe.functions import checksums
from veilframe.functions.spans import prefixes
from veilframe.functions.sqltext import let, lit
from veilframe.operators import word_lists

CONTEXT_CHARS = 50
CONTEXT_BOOST = 0.35


def _chars(ranges: str) -> str:
    """The characters of a class body such as ``A-F0-9``, listed one by one.

    The regex engine looks listed characters up in one table; ranges cost a chain of calls.
    """
    return re.sub(
        r"(\w)-(\w)",
        lambda m: "".join(map(chr, range(ord(m.group(1)), ord(m.group(2)) + 1))),
        ranges,
    )


# ASCII word characters; Java's \b would also count accented letters.
_W = f"[{_chars('A-Za-z0-9_')}]"
_E = f"(?!{_W})"


@dataclass(frozen=True)
class HeadedPattern:
    """A pattern split into its first character, what may not precede it, and the rest.

    ``first`` is a class of listed characters (no ranges).

    Taking the first character and then looking back is several times faster than trying a
    lookbehind at every position.  The split also lets many patterns share one scan that finds out
    whether a text holds a match of any of them.
    """

    first: str
    rest: str
    not_after: str | None = _W

    @property
    def guard(self) -> str:
        return f"(?<!{self.not_after}{self.first})" if self.not_after else ""

    @property
    def regex(self) -> str:
        return f"{self.first}{self.guard}{self.rest}"


def any_of(patterns: Iterable[HeadedPattern]) -> str:
    """A pattern that is found in a text exactly when one of ``patterns`` is.

    What may not precede the first character is tested before any alternative, so most positions
    inside words are left at once.
    """
    by_guard: dict[str | None, list[HeadedPattern]] = {}
    for p in patterns:
        by_guard.setdefault(p.not_after, []).append(p)
    branches = []
    for not_after, listed in by_guard.items():
        guard = f"(?<!{not_after}[{_first_chars(listed)}])" if not_after else ""
        branches.append(f"{guard}(?:{'|'.join(f'(?<={p.first}){p.rest}' for p in listed)})")
    every = [p for listed in by_guard.values() for p in listed]
    return f"[{_first_chars(every)}](?:{'|'.join(branches)})"


def _first_chars(patterns: Iterable[HeadedPattern]) -> str:
    return "".join(sorted({c for p in patterns for c in p.first[1:-1]}))


# A gate is a cheap test every text with a match must pass.
GATES: dict[str, Callable[[str], str]] = {
    "digit": lambda t: f"{t} rlike '[0123456789]'",
    "at": lambda t: f"contains({t}, '@')",
    "scheme": lambda t: f"contains({t}, '://')",
    "hex_group": lambda t: f"contains({t}, ':') and {t} rlike ':[0123456789ABCDEFabcdef]{{1,4}}:'",
}


@dataclass(frozen=True)
class Recognizer:
    """One entity type's patterns with a base score."""

    name: str
    entity_type: str
    patterns: tuple[str | HeadedPattern, ...]
    score: float
    check: Callable[[str], str] | None = None  # SQL text over the match
    # SQL text over the match: the exact matches in it, array<struct<at int, text string>>
    refine: Callable[[str], str] | None = None
    context_words: tuple[str, ...] = ()
    gate: str | None = None
    needs: Callable[[str], str] | None = None  # a cheap test that every text with a match passes
    languages: tuple[str, ...] = ()  # empty: every language
    line_bounded: bool = False  # no match holds a line feed; no anchors
    custom: bool = False

    def __post_init__(self) -> None:
        if not self.patterns:
            raise ValueError(f"recognizer {self.name!r} has no pattern")
        if not 0.0 <= self.score <= 1.0:
            raise ValueError(f"recognizer {self.name!r}: score must be within 0..1")
        if self.gate is not None and self.gate not in GATES:
            raise ValueError(f"recognizer {self.name!r}: unknown gate {self.gate!r}")

    @property
    def max_score(self) -> float:
        return min(1.0, self.score + CONTEXT_BOOST) if self.context_words else self.score

    @property
    def regexes(self) -> tuple[str, ...]:
        return tuple(p.regex if isinstance(p, HeadedPattern) else p for p in self.patterns)

    @property
    def headed(self) -> bool:
        return all(isinstance(p, HeadedPattern) for p in self.patterns)

    def speaks(self, language: str | None) -> bool:
        return language is None or not self.languages or language in self.languages


def term_pattern(terms: Iterable[str], tail: str = _E) -> HeadedPattern:
    """Pattern for the words or phrases of a list, longest first; ``tail`` ends the match.

    The terms form a tree of letters, so a place in the text costs the letters it shares with the
    list, not the length of the list.
    """
    listed = sorted(set(terms) - {""})
    if not listed:
        raise ValueError("a term list needs a term")
    tree: dict = {}
    for term in listed:
        node = tree
        for c in term:
            node = node.setdefault(c, {})
        node[""] = {}
    words = "|".join(f"(?<={re.escape(c)}){_branches(below)}" for c, below in tree.items())
    return HeadedPattern(f"[{''.join(re.escape(c) for c in tree)}]", f"(?:{words}){tail}")


def _branches(node: dict) -> str:
    """What may follow a place in the tree; longer terms are tried first."""
    optional, letters = "" in node, [c for c in node if c]
    run = ""
    while not optional and len(letters) == 1:  # a stretch without branches
        run += re.escape(letters[0])
        node = node[letters[0]]
        optional, letters = "" in node, [c for c in node if c]
    if not letters:
        return run
    inner = "|".join(re.escape(c) + _branches(node[c]) for c in letters)
    return f"{run}(?:{inner}){'?' if optional else ''}"


def _whole_address(match: str) -> str:
    """The e-mail address at the head of a run of address characters.

    The pattern takes the whole run after the sign, which the engine does in a loop; nested groups, one
    turn per label, would overflow its stack on long junk.  Labels are not empty, so the host ends
    before two dots, and the last label has two letters or more.
    """
    host = f"substring_index(substring_index({match}, '@', -1), '..', 1)"
    exact = f"regexp_extract({host}, {lit(r'^[A-Za-z0-9-][A-Za-z0-9.-]*[.][A-Za-z]{2,}')}, 0)"
    return (
        f"transform(filter(array({exact}), host -> host <> ''), host -> "
        f"struct(0 as at, concat(substring_index({match}, '@', 1), '@', host) as text))"
    )


def _whole_ibans(match: str) -> str:
    """The account numbers in a candidate: from each group that may open one, the longest end on the border
    of a group that passes the checksum.

    A candidate runs on over following groups, which may be words in capitals or the next number.
    """
    valid = f"n -> char_length(n) >= 14 and {checksums.iban_mod97('n')}"

    def in_groups(g: str) -> str:
        ends = f"reverse(sequence(3, least(9, size({g}) - i)))"
        longest = f"get(filter(transform({ends}, k -> array_join(slice({g}, i + 1, k), ' ')), {valid}), 0)"
        starts = f"filter(sequence(0, size({g}) - 3), i -> rlike({g}[i], '^[A-Z]{{2}}[0-9]{{2}}$'))"
        at = prefixes(f"transform({g}, w -> char_length(w) + 1)")
        hits = let("places", at, lambda p: f"transform({starts}, i -> struct({p}[i] as at, {longest} as text))")
        return (
            f"if(size({g}) < 3, transform(filter({g}, {valid}), n -> struct(0 as at, n as text)), "
            f"filter({hits}, x -> x.text is not null))"
        )

    return let("groups", f"split({match}, ' ')", in_groups)


_FIRST_OCTET = r"(?:(?<=2)(?:5[0-5]|[0-4][0-9])|(?<=1)[0-9]{2}|(?<=[1-9])[0-9])?"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_TIME = r"(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?"
_MONTH, _DAY = r"(?:1[0-2]|0?[1-9])", r"(?:3[01]|[12][0-9]|0?[1-9])"
_MONTH_REST = r"(?:(?<=1)[0-2]|(?<=0)[1-9]|(?<=[1-9]))"
_DAY_REST = r"(?:(?<=3)[01]|(?<=[12])[0-9]|(?<=0)[1-9]|(?<=[1-9]))"
_LOCAL_PHONE = r"[0-9]{3}[ .-][0-9]{4}"
_HEX = f"[{_chars('0-9A-Fa-f')}]"
_MAILBOX = f"[{_chars('A-Za-z0-9._%+')}-]"
_URL_CHAR = r"[^ \t\r\n<>\"']"
_URL_LAST = r"[^ \t\r\n<>\"'.,;:!?)]"


def builtin_recognizers() -> tuple[Recognizer, ...]:
    """The 18 entity types of the default policy."""
    en = ("en",)

    def rec(
        entity_type: str, first: str | HeadedPattern, rest: str, score: float,
        not_after: str | None = _W, **kw,
    ) -> Recognizer:
        pattern = first if isinstance(first, HeadedPattern) else HeadedPattern(
            first, rest, not_after
        )
        return Recognizer(
            entity_type.lower(), entity_type, (pattern,), score, line_bounded=True, **kw
        )

    def has(*parts: str) -> Callable[[str], str]:
        return lambda t: " or ".join(f"contains({t}, {lit(p)})" for p in parts)

    def digits_in_a_row(t: str) -> str:
        return f"{t} rlike '[0-9]{{7}}'"

    digit, upper = f"[{_chars('0-9')}]", f"[{_chars('A-Z')}]"
    return (
        rec("US_SSN", digit, rf"[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}{_E}", 0.85,
            check=checksums.ssn_issued, gate="digit", needs=has("-"), languages=en),
        rec("CREDIT_CARD", "[123456789]", rf"(?:[0-9]{{3}}[ -](?:[0-9]{{4}}[ -]){{2}}[0-9]{{1,4}}"
            rf"|[0-9]{{3}}[ -][0-9]{{6}}[ -][0-9]{{4,5}}|[0-9]{{12,18}}){_E}",
            1.0, check=checksums.luhn, gate="digit"),
        rec("US_BANK_NUMBER", digit, rf"[0-9]{{7,16}}{_E}", 0.1, gate="digit", needs=digits_in_a_row, languages=en,
            context_words=("account", "acct", "bank", "check", "debit", "save")),
        rec("IBAN_CODE",
            upper, rf"[A-Z][0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,}}"
            rf"(?: [A-Z0-9]{{1,3}})?){_E}",
            1.0, refine=_whole_ibans, gate="digit"),
        rec("CRYPTO", "[13b]", rf"(?:(?<=[13])[1-9A-HJ-NP-Za-km-z]{{25,34}}"
            rf"|(?<=b)c1[02-9ac-hj-np-z]{{11,71}}){_E}",
            0.5, gate="digit", needs=lambda t: f"char_length({t}) > 13"),
        rec("US_PASSPORT", f"[{_chars('0-9A-Z')}]", rf"[0-9]{{8}}{_E}", 0.1, gate="digit", needs=digits_in_a_row,
            languages=en, context_words=("passport", "travel document")),
        rec("UK_NHS", digit, rf"[0-9]{{2}} ?[0-9]{{3}} ?[0-9]{{4}}{_E}", 1.0,
            check=checksums.nhs_mod11, gate="digit", languages=en),
        rec("MEDICAL_LICENSE", upper, rf"[A-Z][0-9]{{7}}{_E}", 1.0,
            check=checksums.dea_check, gate="digit", needs=digits_in_a_row, languages=en),
        rec("EMAIL_ADDRESS",
            _MAILBOX, rf"{_MAILBOX}*@[A-Za-z0-9-][A-Za-z0-9.-]*",
            1.0, _MAILBOX, refine=_whole_address, gate="at"),
        rec("PHONE_NUMBER",
            f"[+({_chars('0-9')}]", rf"(?:(?<=\+)(?:[0-9]{{1,3}}[ .-]?(?:\([0-9]{{3}}\) ?"
            rf"|(?<!{_W})[0-9]{{3}}[ .-]){_LOCAL_PHONE}|[0-9]{{8,15}})"
            rf"|(?<=\()[0-9]{{3}}\) ?{_LOCAL_PHONE}"
            rf"|(?<=[0-9])(?<!{_W}[0-9])[0-9]{{2}}[ .-]{_LOCAL_PHONE}){_E}",
            0.6, None, gate="digit"),
        rec("PERSON", term_pattern(word_lists.GIVEN_NAMES, rf"(?: [A-Z][a-z]+){{0,2}}{_E}"), "", 0.6,
            languages=en),
        rec("US_DRIVER_LICENSE", upper, rf"[0-9]{{5,12}}{_E}", 0.1, gate="digit",
            languages=en, context_words=("driver", "driving", "licence", "license", "permit")),
        rec("IP_ADDRESS", digit, rf"{_FIRST_OCTET}(?:\.{_OCTET}){{3}}{_E}", 0.6, gate="digit", needs=has(".")),
        replace(
            rec("IP_ADDRESS",
                _HEX, rf"{_HEX}{{0,3}}:(?:{_HEX}{{1,4}}:){{6}}{_HEX}{{1,4}}{_E}", 0.6,
                gate="hex_group"),
            name="ip_address_v6"),
        rec("LOCATION", term_pattern(word_lists.LOCATIONS), "", 0.6, languages=en),
        rec("URL", "[h]", rf"ttps?://{_URL_CHAR}*{_URL_LAST}", 0.6, gate="scheme"),
        rec("DATE_TIME",
            digit, rf"(?:[0-9]{{3}}-[0-9]{{2}}-[0-9]{{2}}"
            rf"|{_MONTH_REST}/{_DAY}/(?:[0-9]{{4}}|[0-9]{{2}})"
            rf"|{_DAY_REST}\.{_MONTH}\.[0-9]{{4}}){_TIME}{_E}",
            0.6, gate="digit", needs=has("-", "/", ".")),
        rec("NRP", term_pattern(word_lists.NATIONAL_RELIGIOUS_POLITICAL), "", 0.6, languages=en),
        rec("TITLE", term_pattern(word_lists.TITLES, r"\."), "", 0.5, needs=has("."), languages=en),
    )


@dataclass(frozen=True)
class RecognizerRegistry:
    """Immutable set of recognizers; every change returns a new registry."""

    recognizers: tuple[Recognizer, ...] = field(default_factory=builtin_recognizers)

    def with_pattern(
        self,
        name: str,
        entity_type: str,
        patterns: Iterable[str],
        *,
        score: float = 0.85,
        context_words: Iterable[str] | None = None,
        gate: str | None = None,
        languages: Iterable[str] = (),
        line_bounded: bool = False,
    ) -> RecognizerRegistry:
        """Add (or replace) a custom recognizer for the given regexes (Java syntax)."""
        listed = tuple(patterns)
        for p in listed:
            try:
                empty = any(not m.group() for m in re.finditer(p, "ab cd-1\n@.")) or re.match(p, "")
            except re.error:  # valid in Java only: cannot be tried here, empty matches are dropped
                empty = False
            if not p or empty:
                raise ValueError(f"pattern {p!r} matches the empty string")
        custom = Recognizer(
            name, entity_type, listed, score, context_words=tuple(context_words or ()),
            gate=gate, languages=tuple(languages), line_bounded=line_bounded, custom=True,
        )
        kept = tuple(r for r in self.recognizers if not (r.custom and r.name == name))
        return RecognizerRegistry((*kept, custom))

    def has(self, name: str) -> bool:
        return any(r.custom and r.name == name for r in self.recognizers)

    def without(self, name: str) -> RecognizerRegistry:
        """Drop a custom recognizer; built-in ones and unknown names stay as they are."""
        return RecognizerRegistry(
            tuple(r for r in self.recognizers if not (r.custom and r.name == name))
        )

    def without_types(self, types: Iterable[str]) -> RecognizerRegistry:
        """Without the recognizers of some entity types, for types that are found otherwise."""
        gone = set(types)
        return RecognizerRegistry(tuple(r for r in self.recognizers if r.entity_type not in gone))

    def remove(self, name: str) -> tuple[RecognizerRegistry, bool]:
        """The registry without a custom recognizer, and whether there was one."""
        return self.without(name), self.has(name)

    def select(
        self,
        entities: Iterable[str] | None = None,
        language: str | None = "en",
        score_threshold: float = 0.0,
    ) -> tuple[Recognizer, ...]:
        """The recognizers that can still yield a span under these settings."""
        wanted = None if entities is None else set(entities)
        return tuple(
            r
            for r in self.recognizers
            if (wanted is None or r.entity_type in wanted)
            and r.speaks(language)
            and r.max_score >= score_threshold
        )

    def supported_entities(self, language: str | None = "en") -> list[str]:
        """Detectable entity types, ascending."""
        return sorted({r.entity_type for r in self.recognizers if r.speaks(language)})

    def supported_df(self, spark: SparkSession, language: str | None = "en") -> DataFrame:
        rows = [(e,) for e in self.supported_entities(language)]
        return spark.createDataFrame(rows, "entity_type string")

    def custom_df(self, spark: SparkSession) -> DataFrame:
        """Custom recognizers: name, entity type, number of patterns."""
        rows = [(r.name, r.entity_type, len(r.patterns)) for r in self.recognizers if r.custom]
        return spark.createDataFrame(rows, "name string, entity_type string, pattern_count int")
