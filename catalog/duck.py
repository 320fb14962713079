"""Plain-SQL answers: the recognition rules restated for RE2 and list functions."""

from __future__ import annotations

from veilframe.operators import word_lists
from veilframe.operators.policy import GovernancePolicy

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TIME = "(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?"


def _words(terms) -> str:
    return "|".join(sorted(terms, key=lambda t: (-len(t), t)))


_IBAN = """list_reduce(list_prepend(0, list_transform(string_split(
  substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4), ''),
  lambda ch: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', ch) - 1)),
  lambda acc, x: (acc * (CASE WHEN x > 9 THEN 100 ELSE 10 END) + x) % 97) = 1"""
_LUHN = """list_sum(list_transform(range(1, length(translate(v, ' -', '')) + 1), lambda p:
  CASE WHEN (length(translate(v, ' -', '')) - p) % 2 = 0
       THEN cast(substr(translate(v, ' -', ''), p, 1) AS int)
       ELSE (cast(substr(translate(v, ' -', ''), p, 1) AS int) * 2) % 10
          + (cast(substr(translate(v, ' -', ''), p, 1) AS int) * 2) // 10 END)) % 10 = 0"""
_NHS = """list_sum(list_transform(range(1, 11), lambda p:
  cast(substr(replace(v, ' ', ''), p, 1) AS int) * (11 - p))) % 11 = 0"""
_DEA = """(cast(v[3] AS int) + cast(v[5] AS int) + cast(v[7] AS int)
  + 2 * (cast(v[4] AS int) + cast(v[6] AS int) + cast(v[8] AS int))) % 10 = cast(v[9] AS int)"""
_SSN = "v[1:3] NOT IN ('000', '666') AND v[1] <> '9' AND v[5:6] <> '00' AND v[8:11] <> '0000'"

# type -> list of (pattern, check, score, context words)
RULES: dict[str, list[tuple[str, str, float, tuple[str, ...]]]] = {
    "US_SSN": [(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", _SSN, 0.85, ())],
    "CREDIT_CARD": [(
        r"\b(?:[1-9][0-9]{3}[ -](?:[0-9]{4}[ -]){2}[0-9]{1,4}|[1-9][0-9]{3}[ -][0-9]{6}[ -][0-9]{4,5}"
        r"|[1-9][0-9]{12,18})\b", _LUHN, 1.0, ())],
    "US_BANK_NUMBER": [(r"\b[0-9]{8,17}\b", "true", 0.1,
                        ("account", "acct", "bank", "check", "debit", "save"))],
    "IBAN_CODE": [(
        r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
        _IBAN, 1.0, ())],
    "CRYPTO": [(r"\b(?:[13][1-9A-HJ-NP-Za-km-z]{25,34}|bc1[02-9ac-hj-np-z]{11,71})\b", "true", 0.5, ())],
    "US_PASSPORT": [(r"\b(?:[0-9]{9}|[A-Z][0-9]{8})\b", "true", 0.1, ("passport", "travel document"))],
    "UK_NHS": [(r"\b[0-9]{3} ?[0-9]{3} ?[0-9]{4}\b", _NHS, 1.0, ())],
    "MEDICAL_LICENSE": [(r"\b[A-Z]{2}[0-9]{7}\b", _DEA, 1.0, ())],
    "EMAIL_ADDRESS": [(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", "true", 1.0, ())],
    "PHONE_NUMBER": [(
        r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b"
        r"|\+[0-9]{8,15}\b", "true", 0.6, ())],
    "PERSON": [(rf"\b(?:{_words(word_lists.GIVEN_NAMES)})(?: [A-Z][a-z]+){{0,2}}\b", "true", 0.6, ())],
    "US_DRIVER_LICENSE": [(r"\b[A-Z][0-9]{5,12}\b", "true", 0.1,
                           ("driver", "driving", "licence", "license", "permit"))],
    "IP_ADDRESS": [
        (rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", "true", 0.6, ()),
        (r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b", "true", 0.6, ())],
    "LOCATION": [(rf"\b(?:{_words(word_lists.LOCATIONS)})\b", "true", 0.6, ())],
    "URL": [(r"\bhttps?://[^ \t\r\n<>\"'']*[^ \t\r\n<>\"''.,;:!?)]", "true", 0.6, ())],
    "DATE_TIME": [(
        r"\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}"
        r"|(?:1[0-2]|0?[1-9])/(?:3[01]|[12][0-9]|0?[1-9])/(?:[0-9]{4}|[0-9]{2})"
        rf"|(?:3[01]|[12][0-9]|0?[1-9])\.(?:1[0-2]|0?[1-9])\.[0-9]{{4}}){_TIME}\b", "true", 0.6, ())],
    "NRP": [(rf"\b(?:{_words(word_lists.NATIONAL_RELIGIOUS_POLITICAL)})\b", "true", 0.6, ())],
    "TITLE": [(rf"\b(?:{'|'.join(word_lists.TITLES)})\.", "true", 0.5, ())],
}
ALL_TYPES = tuple(RULES)
HEX_TOKEN = r'token = "[0-9a-f]{40}"'


def rule_sql(src: str, entity_type: str, rule, threshold: float) -> str:
    """Spans of one pattern over ``src`` (id, text): id, s, e, entity_type, score, v."""
    pattern, check, score, context = rule
    found = f"""SELECT id, text, m[i] AS v,
        list_sum(list_transform(g[1:i], lambda x: length(x)))
          + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
      FROM (SELECT id, text, string_split_regex(text, '{pattern}') AS g,
                   regexp_extract_all(text, '{pattern}') AS m FROM ({src})),
           unnest(range(1, len(m) + 1)) r(i)"""
    value = f"{score}"
    if context:
        words = "|".join(context)
        near = (
            "regexp_matches(lower(substr(text, cast(greatest(s - 50, 0) AS bigint) + 1, "
            f"cast(s - greatest(s - 50, 0) AS bigint))), '{words}')"
        )
        value = f"CASE WHEN {near} THEN {round(score + 0.35, 4)} ELSE {score} END"
    return f"""SELECT * FROM (SELECT id, cast(s AS bigint) AS s, cast(s + length(v) AS bigint) AS e,
        '{entity_type}' AS entity_type, cast({value} AS double) AS score, v
      FROM ({found}) WHERE {check}) WHERE score >= {threshold}"""


def spans(src: str, types=ALL_TYPES, threshold: float = 0.4, extra: str = "", resolve: bool = True) -> str:
    """All spans over ``src``; overlaps settled for sets in which overlaps do not chain."""
    parts = [rule_sql(src, t, rule, threshold) for t in types for rule in RULES[t]]
    if extra:
        parts.append(extra)
    union = " UNION ALL ".join(f"({p})" for p in parts)
    if not resolve:
        return union
    better = """b.id = a.id AND b.s < a.e AND a.s < b.e AND
        (-b.score, -(b.e - b.s), b.s, b.entity_type) < (-a.score, -(a.e - a.s), a.s, a.entity_type)"""
    return f"""WITH found AS MATERIALIZED ({union})
      SELECT a.* FROM found a WHERE NOT EXISTS (SELECT 1 FROM found b WHERE {better})"""


DOCS = "SELECT doc_id AS id, text FROM documents"


def per_text(src: str, span_sql: str, columns: str) -> str:
    """One row per text of ``src``; ``columns`` are aggregates over its spans (alias sp)."""
    return f"""SELECT t.id, {columns} FROM ({src}) t LEFT JOIN ({span_sql}) sp ON sp.id = t.id
      GROUP BY t.id"""


def level_of(column: str = "sp.entity_type", policy: GovernancePolicy | None = None) -> str:
    policy = policy or GovernancePolicy()
    whens = " ".join(
        f"WHEN {column} IN ({', '.join(repr(t) for t in types)}) THEN '{level}'"
        for level, types in policy.entity_sensitivity.items()
    )
    return f"(CASE {whens} END)"


def classification(column: str = "sp.entity_type") -> str:
    """Aggregate: the classification of a group of spans."""
    level = level_of(column)
    return (
        f"CASE WHEN count({column}) = 0 THEN 'PUBLIC' "
        f"WHEN bool_or(coalesce({level} = 'HIGH', false)) THEN 'RESTRICTED' "
        f"WHEN bool_or(coalesce({level} = 'MEDIUM', false)) THEN 'CONFIDENTIAL' ELSE 'INTERNAL' END"
    )


def default_replacement() -> str:
    level = level_of("entity_type")
    return (
        f"CASE {level} WHEN 'HIGH' THEN '' WHEN 'LOW' THEN "
        "repeat('*', least(4, length(v))) || substr(v, 5) ELSE '[' || entity_type || ']' END"
    )


def rewritten(src: str, span_sql: str, replacement: str) -> str:
    """id and text with every span replaced; ``replacement`` is over entity_type and v."""
    return f"""SELECT t.id, CASE WHEN p.id IS NULL THEN t.text
        ELSE p.head || substr(t.text, p.last_end + 1) END AS new_text
      FROM ({src}) t LEFT JOIN (
        SELECT id, string_agg(substr(text, prev + 1, s - prev) || ({replacement}), '' ORDER BY s) AS head,
               max(e) AS last_end
        FROM (SELECT sp.*, t2.text, coalesce(lag(sp.e) OVER (PARTITION BY sp.id ORDER BY sp.s), 0) AS prev
              FROM ({span_sql}) sp JOIN ({src}) t2 ON t2.id = sp.id)
        GROUP BY id) p ON p.id = t.id"""
