"""Words of a text, and small per-task dictionaries of words."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np

SOFT_HYPHEN = 0xAD


def once(name: str, build: Callable[[], Any]) -> Any:
    """What ``build`` makes, kept for the life of the Python process.

    It is kept by the interpreter and not in this module: functions travel to executors by value, so
    each task has its own copy of the module's variables, and a cached function would travel by name.
    """
    kept = sys.__dict__.setdefault("tidegate_tables", {})
    if name not in kept:
        kept[name] = build()
    return kept[name]


def _plan() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: whether it stays, and itself or a blank (for what is no letter or digit)."""
    return once("words", _build_plan)


def _build_plan() -> tuple[np.ndarray, np.ndarray]:
    stays, becomes = np.ones(sys.maxunicode + 1, bool), np.full(sys.maxunicode + 1, ord(" "), np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "M" or c == SOFT_HYPHEN:
            stays[c] = False
        elif ch.isalnum():
            becomes[c] = c
    return stays, becomes


def split_words(text: str) -> list[str]:
    """The runs of letters and digits, without combining marks and soft hyphens; case and forms are kept."""
    stays, becomes = _plan()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = stays[codes]
    if not keep.all():
        codes = codes[keep]
    return becomes[codes].tobytes().decode("utf-32-le", "surrogatepass").split()


def folded_words(text: str) -> list[str]:
    """The words after compatibility decomposition, removal of marks and soft hyphens, and lower-casing."""
    return split_words((text if text.isascii() else unicodedata.normalize("NFKD", text)).lower())


def accented_words(text: str) -> list[str]:
    """The words in lower case with their accents, in composed form."""
    return split_words((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())


class Numbered(dict):
    """Numbers words in order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n

    def of(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.int32, len(found))


def portions(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose lengths add up to about ``most``; each holds at least one."""
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)
