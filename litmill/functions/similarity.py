"""String similarity in percent, as vectorised functions.

The ratio is 200 * LCS / (len a + len b): how much of both strings a longest
common subsequence covers.  LCS runs on machine words, a bit for each character.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common(a: str, b: str) -> int:
    """Length of a longest common subsequence, by the bit-parallel recurrence."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        u = row & where.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * common(a, b) / (len(a) + len(b))


#: Pairs that advance together.
PAIRS = 8192


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Characters as numbers, a row for each text, filled up with 0."""
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    size = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), width), np.int64)
    out[np.repeat(np.arange(len(texts)), size), np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)] = letters
    return out


def _common_block(a: list[str], b: list[str]) -> np.ndarray:
    """`common` of some pairs, none of a longer than its b or empty."""
    wide, words = max(map(len, b)), -(-max(map(len, a)) // 64)
    rows = np.arange(len(a))
    x, y = _codes(a, 64 * words), _codes(b, wide)
    # Characters of a by number from 1 on; 0 stands for none, and for those that a lacks.
    number = np.zeros(max(x.max(), y.max()) + 1, np.int32)
    number[x] = 1
    number[0] = 0
    letters = np.flatnonzero(number)
    number[letters] = np.arange(1, len(letters) + 1)
    x, y = number[x], number[y]
    # For each pair and character the places in a where it stands, as bits; 0 stands for none.
    where = np.zeros((len(a), len(letters) + 1, words), np.uint64)
    for place in range(64 * words):
        where[rows, x[:, place], place // 64] |= np.uint64(1) << np.uint64(place % 64)
    where[:, 0] = 0
    row = np.full((len(a), words), ~np.uint64(0))
    for step in range(wide):
        u = row & where[rows, y[:, step]]
        left = row & ~u
        carry = np.zeros(len(a), np.uint64)
        for w in range(words):
            total = row[:, w] + u[:, w]
            over = total < u[:, w]
            total = total + carry
            carry = (over | (total < carry)).astype(np.uint64)
            row[:, w] = total | left[:, w]
    size = np.array([len(t) for t in a])
    inside = np.clip(size[:, None] - 64 * np.arange(words)[None, :], 0, 64)
    mask = np.where(inside >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(inside, 63).astype(np.uint64)) - np.uint64(1))
    return size - np.bitwise_count(row & mask).sum(axis=1).astype(np.int64)


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """`ratio` of many pairs."""
    size = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64)
    found = np.zeros(len(a), np.int64)
    short = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    by_size = sorted((i for i, (x, _) in enumerate(short) if x), key=lambda i: (len(short[i][0]) // 64, len(short[i][1])))
    for lo in range(0, len(by_size), PAIRS):
        mine = by_size[lo : lo + PAIRS]
        found[mine] = _common_block([short[i][0] for i in mine], [short[i][1] for i in mine])
    return np.where(size > 0, 200.0 * found / np.maximum(size, 1), 100.0)


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words, and the shared words with either side's own."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left = " ".join(filter(None, [both, " ".join(sorted(x - y))]))
    right = " ".join(filter(None, [both, " ".join(sorted(y - x))]))
    best = ratio(left, right)
    return max(best, ratio(both, left), ratio(both, right)) if both else best


def title_percent(a: str | None, b: str | None) -> float | None:
    """Similarity of two normalised titles; sets of words count only when both have five or more."""
    if a is None or b is None:
        return None
    found = [ratio(a, b), token_sort_ratio(a, b)]
    if min(len(a.split()), len(b.split())) >= 5:
        found.append(token_set_ratio(a, b))
    return round(max(found), 1)


def _set_forms(a: str, b: str) -> list[tuple[str, str]]:
    """The pairs of strings of which token_set_ratio takes the best ratio; equal strings where it is 100, none where it is 0."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return []
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return [("=", "=")]
    left = " ".join(filter(None, [both, " ".join(sorted(x - y))]))
    right = " ".join(filter(None, [both, " ".join(sorted(y - x))]))
    return [(left, right), (both, left), (both, right)] if both else [(left, right)]


def _best_of(forms: list[list[tuple[str, str]] | None]) -> list[float | None]:
    """The best ratio of each list of pairs, to one decimal; None stays, an empty list has 0."""
    flat = [pair for each in forms for pair in each or []]
    every = ratios([x for x, _ in flat], [y for _, y in flat]).tolist()
    out, at = [], 0
    for each in forms:
        mine = every[at : at + len(each or [])]
        at += len(mine)
        out.append(None if each is None else round(max(mine, default=0.0), 1))
    return out


def title_percents(a: list[str | None], b: list[str | None]) -> list[float | None]:
    """`title_percent` of many pairs."""
    forms: list[list[tuple[str, str]] | None] = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            forms.append(None)
            continue
        v, w = x.split(), y.split()
        forms.append([(x, y), (" ".join(sorted(v)), " ".join(sorted(w)))] + (_set_forms(x, y) if min(len(v), len(w)) >= 5 else []))
    return _best_of(forms)


def value_percents(a: list[str | None], b: list[str | None]) -> list[float | None]:
    """`value_percent` of many pairs."""
    return _best_of([None if x is None or y is None else [("=", "=")] if x == y else [(x, y), *_set_forms(x, y)] if x and y else [] for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(title_percents(a.tolist(), b.tolist()), dtype="float64")


def value_percent(a: str | None, b: str | None) -> float | None:
    """Similarity of two values in normal form: plain or by sets of words, 100 for two empty ones."""
    if a is None or b is None:
        return None
    if a == b:
        return 100.0
    return round(max(ratio(a, b), token_set_ratio(a, b)), 1) if a and b else 0.0


@F.pandas_udf(T.DoubleType())
def value_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(value_percents(a.tolist(), b.tolist()), dtype="float64")


@F.pandas_udf(T.DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of both strings that longest matching blocks cover, found from the longest on, from 0 to 1."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
