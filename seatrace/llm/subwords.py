"""Subword ids of texts from a public rank file, word by word."""

from __future__ import annotations

import base64

import tiktoken

from .common import HashMemo

#: The rank file; a parameter of every operator that uses it.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that goes with the rank file: it splits text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Subwords:
    """Encodes texts; what a word gives is remembered.

    A text is cut before single spaces, where the pattern always begins a new piece; texts with runs of spaces are
    encoded whole.
    """

    def __init__(self, ranks: str = RANKS):
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.size = len(table)
        self.encoding = tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.counts = HashMemo(lambda w: len(self.encoding.encode_ordinary(w)), limit=400_000)

    @staticmethod
    def _pieces(text: str) -> list[str] | None:
        if "  " in text:
            return None
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        pieces = self._pieces(text)
        return len(self.encoding.encode_ordinary(text)) if pieces is None else sum(map(self.counts.__getitem__, pieces))
