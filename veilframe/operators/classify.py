"""Sensitivity classification as SQL expression text over entity types and scores."""

from __future__ import annotations

from veilframe.functions.sqltext import lit, lits
from veilframe.operators.policy import CLASSIFICATIONS, SENSITIVITY_LEVELS, GovernancePolicy


def _any_at(types: str, policy: GovernancePolicy, level: str) -> str:
    listed = policy.types_at(level)
    return f"exists({types}, t -> t in ({lits(listed)}))" if listed else "false"


def classification(types: str, policy: GovernancePolicy) -> str:
    """PUBLIC without entities, else by the highest level; unmapped types count as INTERNAL."""
    return (
        f"case when {types} is null then cast(null as string) "
        f"when size({types}) = 0 then 'PUBLIC' "
        f"when {_any_at(types, policy, 'HIGH')} then 'RESTRICTED' "
        f"when {_any_at(types, policy, 'MEDIUM')} then 'CONFIDENTIAL' "
        "else 'INTERNAL' end"
    )


def classification_rank(name: str) -> str:
    """Position of a classification, PUBLIC 0 to RESTRICTED 3."""
    return f"array_position(array({lits(CLASSIFICATIONS)}), {name}) - 1"


def entity_summary(types: str, policy: GovernancePolicy) -> str:
    """Distinct types grouped under HIGH, MEDIUM, LOW and UNKNOWN, without empty groups."""
    entries = []
    for level in SENSITIVITY_LEVELS:
        listed = policy.types_at(level)
        inside = f"t in ({lits(listed)})" if listed else "false"
        entries += [lit(level), f"filter({_distinct(types)}, t -> {inside})"]
    known = policy.known_types()
    outside = f"t not in ({lits(known)})" if known else "true"
    entries += ["'UNKNOWN'", f"filter({_distinct(types)}, t -> {outside})"]
    return f"map_filter(map({', '.join(entries)}), (k, v) -> size(v) > 0)"


def _distinct(types: str) -> str:
    return f"array_sort(array_distinct({types}))"


def confidence(types: str, scores: str) -> str:
    """Mean score; without scores 1.0 if nothing was found, else 0.8."""
    mean = f"aggregate({scores}, 0.0D, (acc, x) -> acc + x) / size({scores})"
    return (
        f"case when size({scores}) > 0 then round({mean}, 4) "
        f"when size({types}) = 0 then 1.0D when size({types}) > 0 then 0.8D end"
    )


def reason(summary: str, name: str) -> str:
    """One sentence on what was found, by level."""
    parts = []
    for level in SENSITIVITY_LEVELS:
        group = f"{summary}[{lit(level)}]"
        parts.append(
            f"if(size({group}) > 0, concat(size({group}), ' {level}-sensitivity entit', "
            f"if(size({group}) = 1, 'y', 'ies'), ' (', array_join({group}, ', '), ')'), "
            "cast(null as string))"
        )
    return (
        f"case when {name} = 'PUBLIC' then 'No PII entities detected' "
        f"when {name} is not null then concat('Contains ', concat_ws('; ', {', '.join(parts)})) "
        "end"
    )
