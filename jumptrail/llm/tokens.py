"""Token ids of whole texts, as the tokenizer file gives them.

A text of ordinary characters goes through a second library that holds the same vocabulary as ranks and the same
rule for cutting words; it gives the same ids several times faster. Every other text (white space and control
characters that the two could part differently, other scripts, the text of a special token) goes through the
tokenizer itself.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa

# White space, printable ASCII, letters and signs of Latin-1 and Extended Latin, common punctuation.
ORDINARY = re.compile("[\\t\\n\\r\\x20-\\x7e\\u00a1-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]*")

END_OF_DOCUMENT = 2


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to ids, as `Tokenizer.encode(text, add_special_tokens=False)` gives them."""

    def __init__(self, path: str | None = None, ranks_path: str | None = None) -> None:
        import base64
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or tokenizer_path())
        special = [re.escape(token.content) for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or r"(?!)")
        with open(ranks_path or tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def whole(self, text: str) -> list[int]:
        """Ids from the tokenizer itself."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> list[int]:
        if not ORDINARY.fullmatch(text) or self.special.search(text):
            return self.whole(text)
        return self.fast.encode_ordinary(text)

    def documents(self, texts: pa.Array, end: int = END_OF_DOCUMENT) -> Iterator[array]:
        """Ids of each text with the end of document behind them; null counts as empty."""
        for value in texts:
            ids = array("I", self(value.as_py() or ""))
            ids.append(end)
            if sys.byteorder == "big":
                ids.byteswap()
            yield ids


def cut_lengths(total: int, longest: int) -> list[int]:
    """Lengths of the pieces of a document: all full but perhaps the first."""
    first = total % longest
    return ([first] if first else []) + [longest] * (total // longest)
