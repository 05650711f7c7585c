from larder.functions.money import to_money, to_qty, margin_pct, money_zero
from larder.functions.days import day_start, in_days
from larder.functions.numbers import edited_money, edited_number
from larder.functions.phones import standard_phone

__all__ = [
    "to_money", "to_qty", "margin_pct", "money_zero",
    "day_start", "in_days",
    "edited_number", "edited_money",
    "standard_phone",
]
