"""The checksum and upper-casing in plain Python, one character at a time."""

from __future__ import annotations


def upper(text: str) -> str:
    letters = []
    for c in text:
        u = c.upper()
        letters.append(u if len(u) == 1 and c not in "ıſ" and ord(c) < 0x10000 else c)
    return "".join(letters)


def step(crc: int, byte: int) -> int:
    crc ^= byte
    for _ in range(8):
        crc = (crc >> 1) ^ 0x92C64265D32139A4 if crc & 1 else crc >> 1
    return crc


def crc64(text: str) -> int:
    data = upper(text).encode("utf-16-le")
    crc = 0xFFFFFFFFFFFFFFFF
    for low in data[::2]:
        crc = step(step(crc, low), 0)
    return crc


def appid(text: str) -> str:
    return f"{crc64(text):016X}".lstrip("0")
