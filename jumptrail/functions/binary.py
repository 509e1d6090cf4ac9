"""Functions on binary columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_BYTES = 16
HEX_WIDTH = 50

# Bytes shown as a dot: 0 to 32, 127, 254 and 255.
_UNPRINTABLE = "".join(map(chr, [*range(33), 127, 254, 255]))
_DIGIT = "[0-9A-Fa-f]"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def hexdump(df: DataFrame, column: str, id_column: str) -> DataFrame:
    """Rows of 16 bytes: (id, offset, hex, text). Empty and null input give no row."""
    starts = F.sequence(F.lit(0), F.octet_length(column) - 1, F.lit(ROW_BYTES))
    starts = F.when(F.octet_length(column) > 0, starts)
    # Explode and cut are one generated loop: the value is referred to, not copied to every row.
    rows = df.select(F.col(id_column), F.col(column), F.explode(starts).alias("start")).select(
        id_column,
        F.col("start").cast("bigint").alias("offset"),
        F.substring(F.col(column), F.col("start") + 1, F.lit(ROW_BYTES)).alias("bytes"),
    )
    pairs = [F.hex(F.substring("bytes", at, 1)) for at in range(1, ROW_BYTES + 1)]
    letters = F.decode("bytes", "ISO-8859-1")
    return rows.select(
        id_column,
        "offset",
        F.rpad(F.rtrim(F.concat_ws(" ", *pairs)), HEX_WIDTH, " ").alias("hex"),
        F.translate(letters, _UNPRINTABLE, "." * len(_UNPRINTABLE)).alias("text"),
    )


def reverse_bytes(data: Column | str, offset: int | Column = 0) -> Column:
    """Last `length - offset` bytes in reverse order; null if empty or offset is out of range."""
    data = _column(data)
    offset = F.lit(offset) if isinstance(offset, int) else offset
    tail = F.substring(data, offset + 1, F.octet_length(data))
    # Latin-1 maps bytes to characters one to one.
    reversed_tail = F.encode(F.reverse(F.decode(tail, "ISO-8859-1")), "ISO-8859-1")
    fits = (F.octet_length(data) > 0) & (offset >= 0) & (offset <= F.octet_length(data))
    return F.when(fits, reversed_tail)


def _utf16_units(text: Column) -> Column:
    """Text with every character above U+FFFF as two marks, as UTF-16 counts it."""
    return F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "##")


def bytes_from_hex(text: Column | str) -> Column:
    """Bytes of hex text taken in pairs; a bad pair is 0, odd length gives null.

    Within a pair one digit with a blank beside it, or a zero character after it, is a number too.
    """
    text = _column(text)
    units = _utf16_units(text)
    pair = rf"(?s)((?:{_DIGIT}{{2}})++)|[\x09-\x0D\x20]({_DIGIT})|({_DIGIT})[\x00\x09-\x0D\x20]|.."
    marked = F.regexp_replace(units, pair, "$1$2$3;")
    padded = F.regexp_replace(marked, rf"(?<!{_DIGIT})({_DIGIT});", "0$1;")
    filled = F.regexp_replace(padded, rf"(?<!{_DIGIT});", "00;")
    repaired = F.unhex(F.replace(filled, F.lit(";"), F.lit("")))
    # Text of hex digits only, the usual case, needs no repair.
    return F.when(F.length(units) % 2 == 0, F.coalesce(F.unhex(text), repaired))


def has_odd_length(text: Column | str) -> Column:
    """Error flag of `bytes_from_hex`."""
    return F.length(_utf16_units(_column(text))) % 2 == 1
