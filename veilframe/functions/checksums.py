"""Check-digit rules as SQL expression text over one matched string."""

from __future__ import annotations

# Character order of ISO 7064 (a character's value is its position) and the weights
# of the ten-digit mod-11 scheme.
_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MOD11_WEIGHTS = (10, 9, 8, 7, 6, 5, 4, 3, 2, 1)


def luhn(value: str) -> str:
    """Payment card: the digits, without separators, pass Luhn."""
    return f"luhn_check(translate({value}, ' -', ''))"


def iban_mod97(value: str) -> str:
    """Bank account: country and check digits moved to the end, letters as 10..35, mod 97 is 1."""
    compact = f"replace({value}, ' ', '')"
    moved = f"concat(substring({compact}, 5), substring({compact}, 1, 4))"
    v = f"(instr('{_ALNUM}', ch) - 1)"
    step = f"(acc, ch) -> (acc * if({v} > 9, 100, 10) + {v}) % 97"
    return f"aggregate(split({moved}, ''), 0, {step}) = 1"


def nhs_mod11(value: str) -> str:
    """Health number: weighted digit sum divisible by 11."""
    digits = f"replace({value}, ' ', '')"
    terms = [
        f"{w} * cast(substring({digits}, {i}, 1) as int)"
        for i, w in enumerate(_MOD11_WEIGHTS, start=1)
    ]
    return f"({' + '.join(terms)}) % 11 = 0"


def dea_check(value: str) -> str:
    """Prescriber number: digits 1, 3, 5 plus twice digits 2, 4, 6 end in digit 7."""
    d = [f"cast(substring({value}, {i}, 1) as int)" for i in range(3, 10)]
    return f"({d[0]} + {d[2]} + {d[4]} + 2 * ({d[1]} + {d[3]} + {d[5]})) % 10 = {d[6]}"


def ssn_issued(value: str) -> str:
    """Social security number: area, group and serial are ones that are handed out."""
    return (
        f"substring({value}, 1, 3) not in ('000', '666') and substring({value}, 1, 1) <> '9' "
        f"and substring({value}, 5, 2) <> '00' and substring({value}, 8, 4) <> '0000'"
    )
