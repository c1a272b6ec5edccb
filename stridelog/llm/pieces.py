"""Cutting a text where its tokens provably end, and remembering the parts.

Both public tokenizers split a text into words before any merge, and no token
spans two words. A single space between two non-space characters always starts
a new word for the byte-level one and is dropped by the other, so what lies
between such spaces encodes alike in any context. Parts recur far more often
than texts do; a bounded memory of parts replaces most calls of the library.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space next to other white space: there a cut at each single space would not be safe.
_DOUBLED = re.compile(r"\s\s")
#: What a generation of a memory holds: entries, and one more for each 64 characters of their keys. Two take some 150 MB.
REMEMBERED = 400_000
#: Longer keys (encoded data, minified code) hardly recur: they are computed each time.
LONG = 100


def parts(text: str) -> list[str]:
    """The first part as it stands; each later one follows a single space."""
    if text and not text[0].isspace() and not text[-1].isspace() and "  " not in text and " \n" not in text and "\n " not in text and (text.isascii() and text.isprintable() or _DOUBLED.search(text) is None):
        return text.split(" ")
    return _SAFE_CUT.split(text)


class Memory:
    """part -> result, two generations; unknown parts are computed together by ``many``.

    When the young generation is full it becomes the old one, and what was old
    and not asked for since goes: frequent parts stay, rare ones leave. Results
    grow with their keys, so what keys cost bounds the memory's bytes.
    """

    def __init__(self, many: Callable[[list[str]], Iterable], limit: int = REMEMBERED):
        self.many, self.limit, self.young, self.old, self.held = many, limit, {}, {}, 0

    def of(self, keys: list[str]) -> list:
        """The results, in order; none may be None."""
        out = list(map(self.young.get, keys))
        if None not in out:
            return out
        at = [i for i, v in enumerate(out) if v is None]
        old, new, again = self.old, [], {}
        for k in {keys[i] for i in at}:
            if (v := old.get(k)) is None:
                new.append(k)
            else:
                again[k] = v
        found = again | dict(zip(new, self.many(new), strict=True)) if new else again
        for i in at:
            out[i] = found[keys[i]]
        if max(map(len, found)) > LONG:
            found = {k: v for k, v in found.items() if len(k) <= LONG}
        self.young.update(found)
        self.held += len(found) + sum(map(len, found)) // 64
        if self.held > self.limit:
            self.old, self.young, self.held = self.young, {}, 0
        return out
