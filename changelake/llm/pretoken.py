"""Pre-tokens of text batches: the pattern of the public rank files, applied outside special tokens."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import regex


@lru_cache(maxsize=4)
def _compiled(pattern: str) -> regex.Pattern:
    # the vocabularies' libraries take White_Space for \s; Python's own class has four controls more
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
                         .replace(r"\S", r"\P{White_Space}"))


PIECE_CHARS = 1 << 18


def split_texts(texts: Sequence[str], pattern: str, special: Sequence[str] = (), piece_chars: int = PIECE_CHARS):
    """(codes, unique pre-tokens, number of pre-tokens a text, number of special tokens a text).

    codes are the pre-tokens of all texts in order, as indices into the unique ones. Strings of more than
    ``piece_chars`` characters at a time are only held where one text is longer."""
    find = _compiled(pattern).findall
    count, marks = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    cut = regex.compile("|".join(map(regex.escape, special))) if special else None
    index: dict[str, int] = {}
    parts: list[np.ndarray] = []
    flat: list[str] = []
    held, nul = 0, False

    def fold() -> None:
        if nul:      # the library's table of strings ends them at a NUL
            parts.append(np.fromiter((index.setdefault(w, len(index)) for w in flat), np.int32, len(flat)))
            flat.clear()
            return
        codes, unique = pd.factorize(np.array(flat, dtype=object))
        number = np.fromiter((index.setdefault(w, len(index)) for w in unique), np.int32, len(unique))
        parts.append(number[codes])
        flat.clear()

    for i, text in enumerate(texts):
        before = len(flat)
        if cut and any(s in text for s in special):
            pieces = cut.split(text)
            marks[i] = len(pieces) - 1
            for piece in pieces:
                flat += find(piece)
        else:
            flat += find(text)
        count[i] = len(flat) - before
        held += len(text)
        nul = nul or "\0" in text
        if held >= piece_chars:
            fold()
            held, nul = 0, False
    if flat:
        fold()
    codes = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return codes, [w.encode() for w in index], count, marks


def sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths (zero for empty runs)."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(count)
    return total[ends] - total[ends - count]
