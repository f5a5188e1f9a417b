"""Split texts into the pre-tokens that byte-level vocabularies are applied to, in bounded blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import regex

WHOLE_CHARS = 1 << 20
BLOCK = 1 << 16

# Fixed value: the pattern of the byte-level vocabularies.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# For texts without the characters of UNUSUAL the standard library's matcher is faster. Letters are listed, since
# a class of ranges is looked up at once; words come first, which no other alternative can begin.
# ASCII separators 1C to 1F are spaces to one library and not to the other.
UNUSUAL = re.compile("[^\x00-\x1b\x20-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]")
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af"
USUAL = re.compile(rf""" [{LETTERS}]++|[{LETTERS}]++|'(?:[stmd]|re|ve|ll)| ?[0-9]++| ?[^\s{LETTERS}0-9]++|\s+(?!\S)|\s+""")


class Splitter:
    """All pre-tokens of a text by a pattern."""

    def __init__(self, pattern: str):
        self.general = regex.compile(pattern)
        self.usual = USUAL if pattern == BYTE_LEVEL else None

    def blocks(self, text: str) -> Iterator[list[str]]:
        """All matches in order: in one list for a common text, in lists of BLOCK for a very long one."""
        matcher = self.usual if self.usual and not UNUSUAL.search(text) else self.general
        if len(text) <= WHOLE_CHARS:
            yield matcher.findall(text)
            return
        matches = (match.group() for match in matcher.finditer(text))
        while block := list(islice(matches, BLOCK)):
            yield block
