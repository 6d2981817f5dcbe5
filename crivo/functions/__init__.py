"""Column expressions shared by every operator. Built-in functions only, no UDFs."""

from .dates import compact_date, date_format_of, date_key, parse_date
from .hashing import fingerprint, row_hash
from .missing import (
    BLANK_TOKENS_6,
    BLANK_TOKENS_8,
    display_bucket,
    has_value,
    is_blank,
    is_zero_text,
    no_value,
    value_class,
)
from .normalize import has_leading_zero, is_digits, mask, numeric_code, strip_zeros
from .ratios import pct, ratio

__all__ = [
    "BLANK_TOKENS_6", "BLANK_TOKENS_8", "compact_date", "date_format_of", "date_key",
    "display_bucket", "fingerprint", "has_leading_zero", "has_value", "is_blank", "is_digits",
    "is_zero_text", "mask", "no_value", "numeric_code", "parse_date", "pct", "ratio",
    "row_hash", "strip_zeros", "value_class",
]
