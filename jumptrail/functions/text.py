"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jumptrail.functions.case import upper_letters


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def upper_invariant(text: Column | str) -> Column:
    """Upper case, one character to one character."""
    text = _column(text)
    letters = upper_letters()
    translated = F.translate(text, "".join(letters), "".join(letters.values()))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.upper(text)).otherwise(translated)


def appid_hex(bits: Column | str) -> Column:
    """Upper-case hex of the bits without any leading zero."""
    return F.ltrim(F.hex(bits), F.lit("0"))


def file_stem(name: Column | str) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*\z", "")


def html_text(text: Column | str) -> Column:
    """Text with the characters that HTML reserves written as entities; empty for null."""
    escaped = F.coalesce(_column(text), F.lit(""))
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(mark), F.lit(entity))
    return escaped
