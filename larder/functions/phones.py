"""Phone spelling rule of the kitchen's sign-in form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.schemas import PHONE_COUNTRY_CODE


def standard_phone(c: Column | str) -> Column:
    """Drop blanks and hyphens; keep `+…`, `00…` -> `+…`, `0…` -> `+964…`, else `+964…`.

    The browser's `\\s` covers Unicode blanks, hence the `(?U)` flag.
    """
    digits = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?U)[\s-]", "")
    after = lambda n: digits.substr(F.lit(n + 1), F.length(digits))  # noqa: E731  drop the first n chars
    return (F.when(digits.startswith("+"), digits)
            .when(digits.startswith("00"), F.concat(F.lit("+"), after(2)))
            .when(digits.startswith("0"), F.concat(F.lit(PHONE_COUNTRY_CODE), after(1)))
            .otherwise(F.concat(F.lit(PHONE_COUNTRY_CODE), digits)))
