"""Invariant upper case: one table, from one character to one, for columns and for bytes.

The table is made once, where a job is planned, from the character database there; expressions carry it as text and
the checksum as numbers, so no other version of that database has a say, in the JVM or on a worker.
"""

from __future__ import annotations

from functools import cache

import numpy as np

# Letters whose upper case is ASCII stay as they are, and so do those that got an upper case only in
# version 16 of the character database.
KEPT_LETTERS = "ıſ"
TOO_NEW = "\u019b\u0264\u1c8a\ua7cd\ua7db"

LAST = 0xFFFF


@cache
def upper_letters() -> dict[str, str]:
    """Every letter up to U+FFFF that has one letter, itself up to there, as its upper case."""
    letters = (chr(point) for point in range(0x80, LAST + 1) if not 0xD800 <= point <= 0xDFFF)
    pairs = ((letter, letter.upper()) for letter in letters if letter not in KEPT_LETTERS + TOO_NEW)
    found = {letter: upper for letter, upper in pairs if len(upper) == 1 and upper != letter and ord(upper) <= LAST}
    return {chr(point): chr(point - 32) for point in range(ord("a"), ord("z") + 1)} | found


@cache
def upper_table() -> np.ndarray:
    """The upper case of each unit."""
    table = np.arange(LAST + 1, dtype=np.uint16)
    for letter, upper in upper_letters().items():
        table[ord(letter)] = ord(upper)
    return table
