"""Fuzzy string score of known pairs. [T3]

The score is a string alignment that no built-in expresses, so it runs in an Arrow-batched
pandas UDF. It is meant for pairs that a join has already found.
"""

from __future__ import annotations

import heapq
import sys
from collections import Counter

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tasks carry this module's code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _lcs(masks: dict[str, int], size: int, other: str) -> int:
    """Longest common subsequence, one bit per character of the masked string."""
    full = (1 << size) - 1
    row = full
    for char in other:
        hit = row & masks.get(char, 0)
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def _masks(text: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for place, char in enumerate(text):
        masks[char] = masks.get(char, 0) | (1 << place)
    return masks


def indel_ratio(a: str, b: str) -> float:
    """2 x LCS over the summed lengths; 1 for two empty strings."""
    total = len(a) + len(b)
    return 2 * _lcs(_masks(a), len(a), b) / total if total else 1.0


def partial_ratio(a: str, b: str) -> float:
    """Best indel ratio of the shorter string over windows of the longer, cut windows at both
    ends included."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    if len(a) == len(b):
        return max(_best_window(a, b), _best_window(b, a))
    return _best_window(a, b) if len(a) < len(b) else _best_window(b, a)


def _best_window(needle: str, hay: str) -> float:
    """All cut windows of an end come from one pass. Between whole windows the common subsequence
    changes by at most one a place, so stretches that cannot beat the best are not looked into;
    the stretch that may hold most is halved first."""
    if needle in hay:
        return 1.0
    size, masks = len(needle), _masks(needle)
    best = max(_best_prefix(masks, size, hay), _best_prefix(_masks(needle[::-1]), size, hay[::-1]))
    shared, last = _shared(needle, hay), len(hay) - size

    def most(place: int) -> int:
        """The common subsequence of a whole window, or a bound of it that is not above the best."""
        nonlocal best
        if 2 * shared[place] / (size + size) <= best:
            return shared[place]
        found = _lcs(masks, size, hay[place : place + size])
        best = max(best, 2 * found / (size + size))
        return found

    def stretch(low: int, at_low: int, high: int, at_high: int) -> tuple[int, int, int, int, int]:
        return -((at_low + at_high + high - low) // 2), low, at_low, high, at_high

    open_ = [stretch(0, most(0), last, most(last))]
    while open_:
        bound, low, at_low, high, at_high = heapq.heappop(open_)
        if 2 * -bound / (size + size) <= best:
            break
        if high - low < 2:
            continue
        mid = (low + high) // 2
        at_mid = most(mid)
        heapq.heappush(open_, stretch(low, at_low, mid, at_mid))
        heapq.heappush(open_, stretch(mid, at_mid, high, at_high))
    return best


def _best_prefix(masks: dict[str, int], size: int, hay: str) -> float:
    """Best ratio over the beginnings of ``hay`` that are shorter than the masked string."""
    full = (1 << size) - 1
    row, best = full, 0.0
    for length, char in enumerate(hay[: size - 1], 1):
        hit = row & masks.get(char, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
            best = max(best, 2 * (size - row.bit_count()) / (size + length))
    return best


def _shared(needle: str, hay: str) -> list[int]:
    """Characters each whole window of ``hay`` has in common with ``needle``, repeats counted."""
    size, spare = len(needle), Counter(needle)  # needle characters not yet met in the window
    common, found = 0, []
    for end, entering in enumerate(hay, 1):
        if entering in spare:
            common += spare[entering] > 0
            spare[entering] -= 1
        if end > size:
            leaving = hay[end - 1 - size]
            if leaving in spare:
                spare[leaving] += 1
                common -= spare[leaving] > 0
        if end >= size:
            found.append(common)
    return found


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among shared words and shared-plus-own words of both sides."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both = " ".join(sorted(left & right))
    own_a, own_b = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if both and (not own_a or not own_b):
        return 1.0
    full_a, full_b = f"{both} {own_a}".strip(), f"{both} {own_b}".strip()
    best = indel_ratio(full_a, full_b)
    if both:
        best = max(
            best,
            2 * len(both) / (len(both) + len(full_a)),
            2 * len(both) / (len(both) + len(full_b)),
        )
    return best


def lexical_ratio(task: str, text: str) -> float:
    return 0.5 * partial_ratio(task, text) + 0.5 * token_set_ratio(task, text)


def lexical_score(task: Column, text: Column) -> Column:
    """[T3] Half partial ratio, half token-set ratio, case-sensitive, in 0 .. 1."""

    @F.pandas_udf("double")
    def score(tasks: pd.Series, texts: pd.Series) -> pd.Series:
        pairs = zip(tasks.fillna(""), texts.fillna(""), strict=True)
        return pd.Series([lexical_ratio(a, b) for a, b in pairs], dtype="float64")

    return score(task, text)
