"""Numbers as an admin types them into a price or cost field.

The editing pages read a field as the browser's `Number(text) || 0`. The whole
grammar is one column expression: blanks, signs, decimal points, exponents,
`Infinity`, and integers written in base 16, 8 or 2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.schemas import MONEY

# The characters that the browser trims, and its literals.
BLANK = r"[\x09-\x0D\x20\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
DECIMAL = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
INFINITE = r"\A[+-]?Infinity\z"
BASES = {16: r"\A0[xX][0-9a-fA-F]+\z", 8: r"\A0[oO][0-7]+\z", 2: r"\A0[bB][01]+\z"}


def _in_base(text: Column, base: int) -> Column:
    """The value of the digits after a prefix of two characters, as a double.

    Exact up to 2^53; beyond that each digit rounds, so the last bit may differ.
    """
    digits = F.split(F.lower(text.substr(F.lit(3), F.length(text))), "")
    return F.aggregate(digits, F.lit(0.0), lambda so_far, d: so_far * base + (F.instr(F.lit("0123456789abcdef"), d) - 1))


def edited_number(c: Column | str) -> Column:
    """`Number(text) || 0` as a double: what is no number, and NULL, is 0; so is -0."""
    col = F.col(c) if isinstance(c, str) else c
    text = F.regexp_replace(col, rf"\A{BLANK}+|{BLANK}+\z", "")
    out = F.when(text.rlike(DECIMAL), text.try_cast("double"))
    out = out.when(text.rlike(INFINITE), F.when(text.startswith("-"), float("-inf")).otherwise(float("inf")))
    for base, literal in BASES.items():
        out = out.when(text.rlike(literal), _in_base(text, base))
    return F.coalesce(out, F.lit(0.0)) + F.lit(0.0)  # -0 + 0 is 0


def edited_money(c: Column | str) -> Column:
    """The edited number as money, rounded half away from zero; NULL where the
    table takes none: an infinite value, or one of more than ten integer digits."""
    n = edited_number(c)
    return F.when(F.abs(n) < 1e10, n.try_cast(MONEY))
