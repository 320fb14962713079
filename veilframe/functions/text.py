"""Text helpers as SQL expression text: size guard, truncation, chunks, line-aligned sections."""

from __future__ import annotations

from veilframe.functions.sqltext import lit

#: No limit: every text is read in full unless the caller asks for a guard.
DEFAULT_MAX_CHARS = 0


def size_error(text: str, max_chars: int = DEFAULT_MAX_CHARS) -> str:
    """A message where the text is longer than ``max_chars`` (0 = no limit), else NULL."""
    if max_chars <= 0:
        return "cast(null as string)"
    return (
        f"if(char_length({text}) > {max_chars}, "
        f"concat('text too large: ', char_length({text}), ' characters, limit {max_chars}'), "
        "cast(null as string))"
    )


def truncated(text: str, max_length: int = 500) -> str:
    """Cut at the last space within ``max_length`` characters and add ``...``."""
    head = f"substring({text}, 1, {max_length})"
    return (
        f"if(char_length({text}) <= {max_length}, {text}, "
        f"concat(regexp_replace({head}, {lit(r' [^ ]*\z')}, ''), '...'))"
    )


def chunks(text: str, max_chunk_size: int = 5000, overlap: int = 200) -> str:
    """Chunks of ``max_chunk_size`` characters; each starts ``overlap`` before the last one ends."""
    if max_chunk_size <= 0 or overlap < 0 or overlap >= max_chunk_size:
        raise ValueError("chunking needs 0 <= overlap < max_chunk_size")
    step = max_chunk_size - overlap
    return (
        f"if(char_length({text}) <= {max_chunk_size}, array({text}), "
        f"transform(sequence(0, greatest(char_length({text}) - 1, 0), {step}), "
        f"s -> substring({text}, s + 1, {max_chunk_size})))"
    )


def sections(text: str, target: int, cut: str) -> str:
    """The text in sections of ``target`` characters and what comes before the next cut: ``array<string>``.

    ``cut`` is a pattern for the character that ends a section.  One pass of one pattern finds all sections; where no
    cut is left the rest is one section.
    """
    if target <= 0:
        raise ValueError("section size must be positive")
    whole = f"(?s).{{{target}}}.*?(?:{cut})|.+"
    return f"if(char_length({text}) <= {target}, array({text}), regexp_extract_all({text}, {lit(whole)}, 0))"
