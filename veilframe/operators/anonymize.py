"""Rewriting operators as SQL expression text over one span."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from veilframe.functions.sqltext import lit, lits
from veilframe.operators.policy import GovernancePolicy, OperatorSpec
from veilframe.operators.tokens import encrypted, hmac_sha256

_HASHES = {"sha256": 256, "sha512": 512}


def operator_sql(spec: OperatorSpec, value: str) -> str:
    """The replacement for the matched text ``value``; ``spec`` is already resolved for its type."""
    p = spec.params
    if spec.operator == "redact":
        return "''"
    if spec.operator == "replace":
        return lit(str(p["new_value"]))
    if spec.operator == "mask":
        char, n = str(p.get("masking_char", "*")), int(p.get("chars_to_mask", 4))
        if len(char) != 1 or n < 0:
            raise ValueError("mask needs one masking_char and chars_to_mask >= 0")
        stars = f"repeat({lit(char)}, least({n}, char_length({value})))"
        if p.get("from_end", False):
            kept = f"substring({value}, 1, greatest(char_length({value}) - {n}, 0))"
            return f"concat({kept}, {stars})"
        return f"concat({stars}, substring({value}, {n + 1}))"
    if spec.operator == "hash":
        kind = p.get("hash_type", "sha256")
        if kind == "hmac_sha256":
            if not p.get("key"):
                raise ValueError("hmac_sha256 needs a key")
            return hmac_sha256(value, str(p["key"]).encode())
        if kind not in _HASHES:
            raise ValueError(f"hash_type must be one of {sorted((*_HASHES, 'hmac_sha256'))}")
        return f"sha2(concat({lit(str(p.get('salt', '')))}, {value}), {_HASHES[kind]})"
    return encrypted(value, str(p.get("key", "")), joinable=bool(p.get("joinable", False)), key_id=str(p.get("key_id", "")))


def _with_default(spec: OperatorSpec, entity_type: str) -> OperatorSpec:
    if spec.operator == "replace" and "new_value" not in spec.params:
        return OperatorSpec("replace", {**spec.params, "new_value": f"[{entity_type}]"})
    return spec


def _resolved(
    policy: GovernancePolicy, types: Iterable[str], overrides: Mapping[str, Any] | None
) -> dict[str, OperatorSpec]:
    named = {*types, *policy.known_types(), *policy.operator_overrides, *(overrides or {})}
    return {
        t: _with_default(policy.operator_for(t, overrides), t) for t in sorted(named)
    }


def replacement_sql(
    span: str,
    policy: GovernancePolicy,
    types: Iterable[str] = (),
    overrides: Mapping[str, Mapping[str, Any]] | None = None,
) -> str:
    """The replacement of a span by its type; a type nobody names becomes ``[TYPE]``."""
    branches: dict[str, list[str]] = {}
    for entity_type, spec in _resolved(policy, types, overrides).items():
        sql = operator_sql(spec, f"{span}.text")
        if sql == lit(f"[{entity_type}]"):
            continue  # same as the last branch
        branches.setdefault(sql, []).append(entity_type)
    whens = " ".join(
        f"when {span}.entity_type in ({lits(listed)}) then {sql}"
        for sql, listed in branches.items()
    )
    fallback = f"concat('[', {span}.entity_type, ']')"
    return f"case {whens} else {fallback} end" if whens else fallback


def operators_applied_sql(
    types: str,
    policy: GovernancePolicy,
    listed: Iterable[str] = (),
    overrides: Mapping[str, Mapping[str, Any]] | None = None,
) -> str:
    """Map of every found type to the operator used on it."""
    branches: dict[str, list[str]] = {}
    for entity_type, spec in _resolved(policy, listed, overrides).items():
        if spec.operator != "replace":
            branches.setdefault(spec.operator, []).append(entity_type)
    whens = " ".join(
        f"when t in ({lits(names)}) then {lit(op)}" for op, names in branches.items()
    )
    named = f"case {whens} else 'replace' end" if whens else "'replace'"
    return f"map_from_arrays({types}, transform({types}, t -> {named}))"


def fill_template(template: str, entity_type: str) -> str:
    """Column form of a parameter template: ``{entity_type}`` filled from a column."""
    return f"replace({lit(template)}, {lit('{entity_type}')}, {entity_type})"


