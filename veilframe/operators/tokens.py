"""Keyed tokens: HMAC-SHA-256, and encryption whose equal values give equal tokens, with keys that can be changed.

Everything is built from Spark's own functions.  The keyed hash follows RFC 2104, its two padded keys worked out on the
driver.  A joinable token is AES in CBC mode whose IV is the head of the value's HMAC under a key of its own, so it
is the same in every table and run, and says nothing but which values are equal.  A token may begin with the
id of its key; tokens of former keys can then be read and brought under the present one.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.sqltext import ident, lit, lits

AES_KEY_BYTES = (16, 24, 32)
ID_MARK = ":"
_BLOCK = 64


def hmac_sha256(value: str, key: bytes) -> str:
    """SQL text: the lowercase hex HMAC-SHA-256 of a string or binary expression."""
    key = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    inner, outer = (bytes(b ^ pad for b in key).hex() for pad in (0x36, 0x5C))
    first = f"sha2(concat(X'{inner}', cast({value} as binary)), 256)"
    return f"sha2(concat(X'{outer}', unhex({first})), 256)"


def _checked(key: str) -> str:
    if len(key.encode()) not in AES_KEY_BYTES:
        raise ValueError("encrypt needs a key of 16, 24 or 32 bytes")
    return key


def encrypted(value: str, key: str, *, joinable: bool = False, key_id: str = "") -> str:
    """SQL text: the token of ``value``, on one line; ``joinable`` tokens of equal values are equal."""
    _checked(key)
    if ID_MARK in key_id:
        raise ValueError(f"a key's id may not hold {ID_MARK!r}")
    iv = ""
    if joinable:
        # The IV's key is derived from the cipher's, so one secret is enough and neither is used twice.
        derived = hmac.new(key.encode(), b"iv of joinable tokens", hashlib.sha256).digest()
        iv = f", substring(unhex({hmac_sha256(value, derived)}), 1, 16)"
    # base64 breaks long output into lines; a token must stay on one.
    token = f"translate(base64(aes_encrypt({value}, {lit(key)}, 'CBC', 'PKCS'{iv})), '\\r\\n', '')"
    return f"concat({lit(key_id + ID_MARK)}, {token})" if key_id else token


@dataclass(frozen=True)
class KeyRing:
    """Keys by id, and the one that new tokens are made with.  Keys are secrets: they are part of the plan."""

    keys: Mapping[str, str] = field(repr=False)
    current: str

    def __post_init__(self) -> None:
        if self.current not in self.keys:
            raise ValueError(f"no key {self.current!r}")
        for key_id, key in self.keys.items():
            _checked(key)
            if not key_id or ID_MARK in key_id:
                raise ValueError(f"{key_id!r} is no id for a key")

    def params(self) -> dict[str, Any]:
        """The parameters of an ``encrypt`` operator that makes joinable tokens under the present key."""
        return {"key": self.keys[self.current], "joinable": True, "key_id": self.current}

    def token(self, value: str) -> str:
        return encrypted(value, self.keys[self.current], joinable=True, key_id=self.current)

    def value(self, token: str) -> str:
        """SQL text: the value of a token; NULL for a text that is no token of these keys."""
        body = f"try_to_binary(substring({token}, instr({token}, '{ID_MARK}') + 1), 'base64')"
        whens = " ".join(
            f"when {lit(key_id)} then cast(try_aes_decrypt({body}, {lit(key)}, 'CBC', 'PKCS') as string)"
            for key_id, key in self.keys.items())
        return f"case substring_index({token}, '{ID_MARK}', 1) {whens} end"

    def rotated(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """The frame with the tokens in ``columns`` under the present key; those under it, NULL and other texts stay."""
        changed = {}
        for name in columns:
            column = ident(name)
            old = [k for k in self.keys if k != self.current]
            if old:
                known = f"substring_index({column}, '{ID_MARK}', 1) in ({lits(old)})"
                changed[name] = F.expr(f"if({known}, coalesce({self.token(self.value(column))}, {column}), {column})")
        return df.withColumns(changed)
