"""Periodic runs in texts: online square catching over dyadic blocks.

A square is a stretch of words that stands twice in a row.  One whose half has
p words, 2B <= p < 4B, holds in its first half a whole block of B words that
begins at a multiple of B; B is a power of two (1 also takes p = 1).  So every
block, once it is complete, gets a catcher: as words are appended, it compares
the suffix of B words with its block, and on a match p words behind it has
caught the period p, whose stretch is followed to both sides.  A catcher ends
4B words behind its block's start, so each word advances a bounded number of
catchers a level.  Squares that are caught merge into maximal runs; a stretch
that lies in a run of a period of at most B words has nothing new to catch.

A task has whole texts, so the catchers of one level, over all texts of a piece,
are advanced together as arrays; unlike marks between the texts keep them apart.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

#: Words that a run has at least, and how often its period fits in.
LEAST, TIMES = 12, 2
#: Primes of the two hashes by which stretches are compared, and their bases.
PRIMES = (np.uint64(2147483647), np.uint64(2147483629))
BASES = (np.uint64(1103515245), np.uint64(1664525))


class Stretches:
    """Compares stretches of a text of any length, by sums of its words times powers of a base."""

    def __init__(self, words: np.ndarray):
        self.sums, self.powers = [], []
        for prime, base in zip(PRIMES, BASES, strict=True):
            power = np.ones(len(words) + 1, np.uint64)
            done, step = 1, base
            while done < len(power):
                power[done : 2 * done] = power[: min(done, len(power) - done)] * step % prime
                done, step = 2 * done, step * step % prime
            total = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(words % prime * power[:-1] % prime, out=total[1:])
            self.sums.append(total % prime)
            self.powers.append(power)

    def same(self, at: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches at `at` and, behind it, at `other` are alike."""
        out = np.ones(len(at), bool)
        for prime, total, power in zip(PRIMES, self.sums, self.powers, strict=True):
            a = (total[at + size] + prime - total[at]) % prime
            b = (total[other + size] + prime - total[other]) % prime
            out &= a * power[other - at] % prime == b
        return out

    def onward(self, at: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Words that are alike from `at` and from `other` on."""
        return self._most(len(self.sums[0]) - 1 - other, lambda size, rows: self.same(at[rows], other[rows], size))

    def backward(self, at: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Words that are alike before `at` and before `other`."""
        return self._most(at, lambda size, rows: self.same(at[rows] - size, other[rows] - size, size))

    @staticmethod
    def _most(limit: np.ndarray, alike) -> np.ndarray:
        """The greatest size up to the limit for which `alike` holds: steps that double, then a search between the last two."""
        low, high = np.zeros(len(limit), np.int64), limit.astype(np.int64)
        rows, step = np.arange(len(limit)), 1
        while len(rows):
            size = np.minimum(step, high[rows])
            ok = alike(size, rows)
            low[rows[ok]] = size[ok]
            high[rows[~ok]] = size[~ok] - 1
            rows = rows[ok & (size < limit[rows])]
            step *= 2
        rows = np.flatnonzero(low < high)
        while len(rows):
            size = (low[rows] + high[rows] + 1) // 2
            ok = alike(size, rows)
            low[rows[ok]] = size[ok]
            high[rows[~ok]] = size[~ok] - 1
            rows = rows[low[rows] < high[rows]]
        return low


def _caught(suffixes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of the block, period) of each match of a block with a suffix of as many words, by the hashes of stretches of `block` words."""
    first, last = (1 if block == 1 else 2 * block), 4 * block
    n = len(suffixes)
    at, period = [], []
    blocks = max(0, -(-(n - first) // block))
    # Catchers whose life ends within the text, all at once; then the few others.
    whole = max(0, (n - last) // block + 1) if n >= last else 0
    if whole:
        window = np.lib.stride_tricks.as_strided(suffixes[first:], (whole, last - first), (block * suffixes.strides[0], suffixes.strides[0]), writeable=False)
        j, d = np.nonzero(window == suffixes[: whole * block : block, None])
        at.append(j * block)
        period.append(d + first)
    for j in range(whole, blocks):
        d = np.flatnonzero(suffixes[j * block + first : j * block + last] == suffixes[j * block])
        at.append(np.full(len(d), j * block))
        period.append(d + first)
    return (np.concatenate(at), np.concatenate(period)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def runs(words: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs of at least two periods, by start and period; `words` are 64-bit hashes."""
    n = len(words)
    found = np.zeros((0, 3), np.int64)
    stretches = None
    suffixes, block = words, 1
    reach = None
    while len(suffixes) > block:
        at, period = _caught(suffixes, block)
        if len(at):
            if reach is not None:  # inside a run of a shorter period
                new = reach[at] < at + period + block
                at, period = at[new], period[new]
            # Of neighbouring blocks that catch the same period the first is followed.
            order = np.lexsort((at, period))
            at, period = at[order], period[order]
            head = np.ones(len(at), bool)
            head[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + block)
            at, period = at[head], period[head]
        if len(at):
            stretches = stretches or Stretches(words)
            start = at - stretches.backward(at, at + period)
            end = at + period + stretches.onward(at, at + period)
            square = end - start >= 2 * period
            found = _merged(np.concatenate((found, np.stack((start, end, period), axis=1)[square])))
        suffixes = kernel.mix(suffixes[:-block] * kernel.WORD_STEP + suffixes[block:])
        block *= 2
        short = found[found[:, 2] <= block]
        if len(short):
            # For each word the end of the farthest run of a short period that holds it.
            reach = np.zeros(n, np.int64)
            np.maximum.at(reach, short[:, 0], short[:, 1])
            np.maximum.accumulate(reach, out=reach)
    return found


def _merged(found: np.ndarray) -> np.ndarray:
    """Each stretch once, with its smallest period, by start and period."""
    order = np.lexsort((found[:, 2], found[:, 1], found[:, 0]))
    found = found[order]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _rewritten(sizes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """For each word of texts of these sizes, the word that stands there: in a tenth of the texts, by `checks` (-1: none), words repeat with a period."""
    first = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum())
    for i in np.flatnonzero((checks >= 0) & (checks % 10 == 0) & (sizes > 0)).tolist():
        g, n = int(checks[i]) // 10, int(sizes[i])
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at = np.arange(a, n)
        place[first[i] + a : first[i] + n] = first[i] + a + (at - a) % p
    return place


_EMPTY = hashlib.sha256(b"").hexdigest()
_OUT = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
OUT_DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _judged(data: np.ndarray, offsets: np.ndarray, checks: np.ndarray) -> list[list]:
    """Columns of the result, but for doc_id, of some whole texts."""
    texts = len(offsets) - 1
    hashes, starts = kernel.placed_words(data, offsets, case=kernel.AS_IS)
    sizes = np.diff(np.searchsorted(starts, offsets, side="left"))
    gap = kernel.IS_SPACE[data]
    gap_at = np.flatnonzero(gap)
    ends = np.append(gap_at, len(data))[np.searchsorted(gap_at, starts)]
    ends = np.minimum(ends, offsets[np.searchsorted(offsets, starts, side="right")])
    place = _rewritten(sizes, checks)
    hashes, starts, ends = hashes[place], starts[place], ends[place]
    first = np.cumsum(sizes) - sizes
    # Marks between texts, each of its own kind: the words of text i begin at first[i] + i.
    line = np.empty(len(hashes) + texts, np.uint64)
    owner = np.repeat(np.arange(texts), sizes)
    line[np.arange(len(hashes)) + owner] = hashes
    line[first + sizes + np.arange(texts)] = kernel.mix(np.arange(texts).astype(np.uint64) + np.uint64(0x51ED270B9F1B2C35))
    found = runs(line)
    length = found[:, 1] - found[:, 0]
    found = found[length >= np.maximum(LEAST, TIMES * found[:, 2])]
    of = np.searchsorted(first + np.arange(texts), found[:, 0], side="right") - 1
    # Words that some run holds behind its first period.
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2] - of, 1)
    np.add.at(change, found[:, 1] - of, -1)
    keep = np.cumsum(change[:-1]) == 0
    size = ends[keep] - starts[keep] + 1  # with a space behind
    last = np.cumsum(size)
    left = data if len(data) else np.zeros(1, np.uint8)
    source = np.repeat(starts[keep] - (last - size), size) + np.arange(last[-1] if len(last) else 0)
    joined = left[np.minimum(source, len(left) - 1)]
    joined[last - 1] = 0x20
    joined = joined.tobytes()
    until = np.concatenate(([0], last))[np.concatenate(([0], np.cumsum(np.bincount(owner[keep], minlength=texts))))]
    out: list[list] = [[0] * texts, *[[None] * texts for _ in range(4)], [_EMPTY] * texts, [_EMPTY] * texts]
    for i in range(texts):
        if until[i + 1] > until[i]:
            out[6][i] = hashlib.sha256(joined[until[i] : until[i + 1] - 1]).hexdigest()
    bounds = np.searchsorted(of, np.arange(texts + 1))
    for i in np.unique(of).tolist():
        mine = found[bounds[i] : bounds[i + 1]]
        start, size, period = mine[:, 0] - first[i] - i, mine[:, 1] - mine[:, 0], mine[:, 2]
        best = np.lexsort((period, start, -size))[0]
        out[0][i] = len(mine)
        out[1][i], out[2][i], out[3][i] = int(start[best]), int(size[best]), int(period[best])
        out[4][i] = 1000 * out[2][i] // out[3][i]
        out[5][i] = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), size.tolist(), period.tolist(), strict=True)).encode()).hexdigest()
    return out


def periodic_runs(docs: DataFrame, rewrite: bool = False) -> DataFrame:
    """A row for every row of docs: doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256.

    Words are what white space of ASCII parts; case counts.  A run is a longest
    stretch of at least 12 words, and two periods, in which each word is that
    one period before.  Of equally long runs the first counts, then that of the
    smaller period.  Words that a run holds behind its first period are left
    out of the collapsed text.  rewrite makes a tenth of the texts, chosen by
    crc32 of doc_id, periodic from some word on, before they are looked at.

    A null text, or one without words, has no runs, nulls for the longest, and
    digests of nothing.  Rows that repeat a document are judged each; a row
    without a doc_id is never rewritten; an empty table gives no rows.  Other
    columns are not looked at.  Work grows as the words times the logarithm of
    the longest text; a text of any length is one task's.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        (F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")), F.lit(-1)) if rewrite else F.lit(-1)).cast("long").alias("check"),
    )

    def run(batches):
        for batch in batches:
            checks = batch.column("check").to_numpy()
            for a, b, data, offsets in kernel.pieces(batch.column("text")):
                columns = _judged(data, offsets, checks[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *[pa.array(c, f.type) for c, f in zip(columns, list(_OUT)[1:], strict=True)]], schema=_OUT)

    return rows.mapInArrow(kernel.tidy(run), OUT_DDL)
