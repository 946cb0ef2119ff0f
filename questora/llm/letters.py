"""Which characters a word is made of."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

#: The last character of the basic plane; classes of characters up to it are looked up in one step.
BASIC = 0xFFFF
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


@cache
def ranges(kinds: str, last: int = sys.maxunicode) -> str:
    """The characters up to ``last`` whose general category begins with one of ``kinds``, as the inside of a regular expression's class."""
    out, begin = [], None
    for i in range(last + 2):
        inside = i <= last and unicodedata.category(chr(i))[0] in kinds
        if inside and begin is None:
            begin = i
        elif not inside and begin is not None:
            out.append(f"\\U{begin:08x}-\\U{i - 1:08x}")
            begin = None
    return "".join(out)


class Words:
    """The matches of a pattern that has ``{own}`` where the characters of ``kinds`` go, such as letters (L) and combining marks (M).

    Vowel signs and tone marks are marks; without them words of many scripts fall apart. Most texts have no character beyond the basic plane, and for
    these the class without such characters does the same in less time.
    """

    def __init__(self, pattern: str, kinds: str) -> None:
        self.pattern, self.kinds, self.wide = pattern, kinds, None
        self.narrow = self.made(BASIC)

    def made(self, last: int) -> re.Pattern:
        return re.compile(self.pattern.replace("{own}", ranges(self.kinds, last)))

    def findall(self, text: str) -> list[str]:
        if _BEYOND.search(text):
            self.wide = self.wide or self.made(sys.maxunicode)
            return self.wide.findall(text)
        return self.narrow.findall(text)
