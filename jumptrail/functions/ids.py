"""Process and window identifiers written as decimal or hex text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = 0xFFFFFFFF

# Blanks allowed around the digits, and the zero characters allowed after them.
_BLANK = r"[\x09-\x0D\x20]*"
_DECIMAL = rf"(?s)\A{_BLANK}\+?0*([0-9]{{1,10}}){_BLANK}\x00*\z"
_HEX = rf"(?s)\A0[xX]{_BLANK}0*([0-9A-Fa-f]{{1,8}}){_BLANK}\x00*\z"


def parse_id(text: Column | str) -> Column:
    """BIGINT in the unsigned 32-bit range; 0 for whatever is not such a number."""
    text = F.col(text) if isinstance(text, str) else text
    decimal = F.regexp_extract(text, _DECIMAL, 1).try_cast("bigint")
    hexadecimal = F.conv(F.nullif(F.regexp_extract(text, _HEX, 1), F.lit("")), 16, 10)
    value = F.when(F.lower(F.substring(text, 1, 2)) == "0x", hexadecimal.cast("bigint"))
    value = value.otherwise(decimal)
    return F.when(value <= LARGEST, value).otherwise(F.lit(0).cast("bigint"))
