"""Where a text can be cut so that no match of a set of patterns is cut, read off the patterns themselves.

For every pattern the sets of characters are worked out that may stand first, last and next to each other in a match,
and those its lookarounds ask for.  After a character that no match ends with and no lookaround asks for, a text may
be cut before every character that cannot follow it inside a match: no match crosses the cut, and beside it a
lookaround sees what it sees at the edge of a text.  So both parts, searched alone, hold exactly the matches of the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from re import _constants as op
from re import _parser as parser

# A set of characters is a number with a bit per ASCII character and one for all others.
_OTHERS = 1 << 128
_ALL = (1 << 129) - 1
_DIGITS = sum(1 << c for c in range(48, 58))
_WORD = _DIGITS | sum(1 << ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")
_BLANKS = sum(1 << c for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32))
#: A class may hold more in one engine than in another, so each stands for all it may hold.
_CLASSES = {
    op.CATEGORY_DIGIT: _DIGITS | _OTHERS, op.CATEGORY_NOT_DIGIT: _ALL & ~_DIGITS,
    op.CATEGORY_WORD: _WORD | _OTHERS, op.CATEGORY_NOT_WORD: _ALL & ~_WORD,
    op.CATEGORY_SPACE: _BLANKS | _OTHERS, op.CATEGORY_NOT_SPACE: _ALL & ~(_BLANKS & ~(0b1111 << 28)),
}


class _Unread(Exception):
    """A pattern that cannot be read: then nothing is known about where a text can be cut."""


@dataclass
class _Shape:
    empty: bool = True
    first: int = 0
    last: int = 0
    pairs: list[tuple[int, int]] = field(default_factory=list)  # (may stand before, may stand after)
    asked: int = 0

    def then(self, after: _Shape) -> _Shape:
        pairs = self.pairs + after.pairs
        if self.last and after.first:
            pairs.append((self.last, after.first))
        return _Shape(
            self.empty and after.empty, self.first | (after.first if self.empty else 0),
            after.last | (self.last if after.empty else 0), pairs, self.asked | after.asked)

    def or_(self, other: _Shape) -> _Shape:
        return _Shape(self.empty or other.empty, self.first | other.first, self.last | other.last,
                      self.pairs + other.pairs, self.asked | other.asked)


def _one(code: int) -> int:
    return 1 << code if code < 128 else _OTHERS


def _listed(items) -> int:
    chars, negated = 0, False
    for kind, value in items:
        if kind is op.NEGATE:
            negated = True
        elif kind is op.LITERAL:
            chars |= _one(value)
        elif kind is op.RANGE:
            low, high = value
            chars |= sum(1 << c for c in range(low, min(high, 127) + 1)) | (_OTHERS if high > 127 else 0)
        elif kind is op.CATEGORY:
            chars |= _CLASSES[value]
        else:
            raise _Unread
    return (_ALL & ~chars) | _OTHERS if negated else chars


def _chars(chars: int) -> _Shape:
    return _Shape(False, chars, chars)


def _shape(nodes) -> _Shape:
    whole = _Shape()
    for kind, value in nodes:
        if kind is op.LITERAL:
            part = _chars(_one(value))
        elif kind is op.NOT_LITERAL:
            part = _chars((_ALL & ~_one(value)) | _OTHERS)
        elif kind is op.ANY:
            part = _chars(_ALL)
        elif kind is op.IN:
            part = _chars(_listed(value))
        elif kind is op.BRANCH:
            parts = [_shape(p) for p in value[1]]
            part = parts[0]
            for other in parts[1:]:
                part = part.or_(other)
        elif kind is op.SUBPATTERN and not value[1] and not value[2]:
            part = _shape(value[3])
        elif kind is op.ATOMIC_GROUP:
            part = _shape(value)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = value
            part = _shape(inner)
            if most > 1 and part.last and part.first:
                part.pairs.append((part.last, part.first))
            part.empty = part.empty or least == 0
        elif kind in (op.ASSERT, op.ASSERT_NOT):
            inner = _shape(value[1])
            seen = inner.first | inner.last | inner.asked
            for a, b in inner.pairs:
                seen |= a | b
            part = _Shape(asked=seen)
        elif kind is op.AT and value in (op.AT_BOUNDARY, op.AT_NON_BOUNDARY):
            part = _Shape(asked=_WORD | _OTHERS)
        else:  # anchors, references, flags
            raise _Unread
        whole = whole.then(part)
    return whole


def _java_class(chars: int) -> str:
    """The set as a Java pattern for one character."""
    escaped = "".join(f"\\x{c:02x}" for c in range(128) if chars >> c & 1)
    outside = r"[^\x00-\x7f]"
    if not escaped:
        return outside
    return f"(?:[{escaped}]|{outside})" if chars & _OTHERS else f"[{escaped}]"


def safe_cut(patterns: Iterable[str]) -> str | None:
    """A Java pattern for the character after which a text can be cut, or None if the patterns leave no such place.

    Patterns that cannot be read, hold anchors or refer to groups leave none.
    """
    last = asked = 0
    pairs: list[tuple[int, int]] = []
    for pattern in patterns:
        try:
            parsed = parser.parse(pattern)
            if parsed.state.flags & ~re.UNICODE:
                return None
            shape = _shape(parsed)
        except (_Unread, re.error, RecursionError):
            return None
        last, asked = last | shape.last, asked | shape.asked
        pairs += shape.pairs
    before: dict[int, int] = {}  # the characters that may come after the cut -> those before it
    for code in range(128):
        if chr(code).isalnum() or (last | asked) >> code & 1:
            continue
        free = _ALL
        for a, b in pairs:
            if a >> code & 1:
                free &= ~b
        if free:
            before[free] = before.get(free, 0) | 1 << code
    if not before:
        return None
    return "|".join(_java_class(chars) + ("" if free == _ALL else f"(?={_java_class(free)})") for free, chars in before.items())
