"""The split of a text into pre-tokens that both byte-level BPE operators start from."""

from __future__ import annotations

import re
from collections.abc import Iterator

import public_tokenizers
import regex

# The classes of the public pattern for code points below U+0250 (fixed values).
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\\t-\\r \x85\xa0"

_BEYOND = re.compile("[^\x00-ɏ]")


class Splitter:
    """``split(text)`` lists the matches of ``pattern``; ``stream(text)`` yields them one by one.

    For the public pattern and a text of Latin letters the classes are spelled out, which is about three
    times as fast and gives the same matches: a run of letters is tried first, which nothing before it in the
    pattern can take (those begin with an apostrophe).
    """

    def __init__(self, pattern: str = public_tokenizers.PATTERN):
        self.whole = regex.compile(pattern)
        self.latin = None
        if pattern == public_tokenizers.PATTERN:
            self.latin = re.compile(
                f" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+"
                f"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
            )

    def _for(self, text: str):
        return self.latin if self.latin and not _BEYOND.search(text) else self.whole

    def split(self, text: str) -> list[str]:
        return self._for(text).findall(text)

    def stream(self, text: str) -> Iterator[str]:
        return (m.group() for m in self._for(text).finditer(text))
