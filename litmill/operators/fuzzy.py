"""Which titles can be alike at all: a join by few, rare parts of them, from which no pair is missing.

Titles are alike by the ratio of their longest common subsequence, in their own
order, with sorted words, or as sets of words.  Parts are the q-grams of each
word with a space on either side, which do not depend on the order of words.

Ratio: of titles of lengths m and n with a ratio of t or more, at most
(1 - t)(m + n) letters are put in or taken out on the way from one to the other.
A letter put in breaks up to q - 1 q-grams, one taken out up to q, so the titles
have a number of q-grams in common.  A title that has g of them and needs c in
common with any partner shares one of its g - c + 1 rarest with it (prefix
filter), in whichever order rareness puts all q-grams, as long as it is one
order.  For sets of words the same holds of the q-grams of the set.

Sets: where the words of both, next to those of one, reach the ratio, the words
that only that one has are short, so of its rarest words, as many as are longer
than these may be, one is among the other's words.

Titles too short for such a bound meet all others of their block.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts whose frequencies everyone gets: those that are more than this share of all; no more than that many.
FREQUENT = 1 << 16
#: Words from which sets of words count.
WORDY = 5


def _hash(text: str) -> int:
    return zlib.crc32(text.encode()) | len(text.encode()) << 32


def grams(words, q: int) -> Counter:
    return Counter(f" {w} "[i : i + q] for w in words for i in range(len(w) + 3 - q))


def in_common(own: int, size: int, t: float, q: int) -> float:
    """How many q-grams a title of `size` letters, which has `own`, at least shares with any that is alike; a line in the partner's length, so least at its ends."""
    return min(own - (q - 0.5) * (1 - t) * (size + other) + (other - size) / 2 for other in (size * t / (2 - t), size * (2 - t) / t))


def width(t: float) -> int:
    """3 where that leaves enough in common, else 2."""
    return 3 if in_common(85, 100, t, 3) > 30 else 2


def _parts(title: str, q: int) -> list[str]:
    """Every q-gram, numbered where it repeats, and every word."""
    return [f"{g}\t{i}" for g, n in grams(title.split(), q).items() for i in range(n)] + [f"\n{w}" for w in set(title.split())]


def tokens(title: str, t: float, q: int, often: dict[int, int]) -> tuple[list[int], list[int]]:
    """What a title offers as the left and as the right of a pair; pairs that are alike have one in common."""

    def rare(parts):
        return sorted(parts, key=lambda p: (often.get(h := _hash(p), 0), h, p))

    words = title.split()
    both, left, right = set(), set(), set()
    short = False
    # As it stands, and as a set of words.
    for kind, line in ((words, title), (sorted(set(words)), " ".join(sorted(set(words)))))[: 2 if len(words) >= WORDY else 1]:
        own = grams(kind, q)
        g, need = own.total(), math.ceil(in_common(own.total(), len(line), t, q) - 1e-9)
        if need < 1:
            short = True
        else:
            both.update(_hash(p) for p in rare(f"{x}\t{i}" for x, n in own.items() for i in range(n))[: g - need + 1])
    if len(words) >= WORDY:
        kind = set(words)
        spare = (sum(map(len, kind)) + len(kind) - 1) * (2 - 2 * t) / (2 - t)
        few, weight = [], 0
        for p in rare(f"\n{w}" for w in kind):
            few.append(p[1:])
            weight += len(p)  # the word and a space
            if weight > spare + 1e-9:
                break
        left.update([_hash(f"\n1{w}") for w in few] + [_hash(f"\n2{w}") for w in kind])
        right.update([_hash(f"\n1{w}") for w in kind] + [_hash(f"\n2{w}") for w in few])
    # A title without a bound meets all, on either side.
    left.update([_hash("\r2"), *([_hash("\r1")] if short else [])])
    right.update([_hash("\r1"), *([_hash("\r2")] if short else [])])
    return sorted(both | left), sorted(both | right)


def with_tokens(titles: DataFrame, least: float) -> DataFrame:
    """titles (id, t, ...) with what each offers on the left and on the right."""
    t = least / 100.0
    q = width(t)

    def counted(batches):
        for batch in batches:
            many = Counter(_hash(p) for title in batch.column("t").to_pylist() for p in _parts(title, q))
            yield pa.RecordBatch.from_arrays([pa.array(many.keys(), pa.int64()), pa.array(many.values(), pa.int64())], names=["part", "n"])

    parts = titles.select("t").mapInArrow(counted, "part long, n long").groupBy("part").agg(F.sum("n").alias("n"))
    total = parts.agg(F.sum("n")).first()[0] or 0
    often = {r["part"]: r["n"] for r in parts.where(F.col("n") > total / FREQUENT).collect()}  # FREQUENT rows at most
    shared = titles.sparkSession.sparkContext.broadcast(often)
    kept = titles.columns

    def offered(batches):
        for batch in batches:
            found = [tokens(title, t, q, shared.value) for title in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (0, 1))], names=[*kept, "on_left", "on_right"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in titles.schema)
    return titles.mapInArrow(offered, f"{schema}, on_left array<long>, on_right array<long>")


def candidates(left: DataFrame, right: DataFrame, fits: Column) -> DataFrame:
    """(a, b): pairs of left (block, a, on_left, ...) and right (block, b, on_right, ...) in one block that have a token in common and fit, each once."""
    met = left.withColumn("token", F.explode("on_left")).drop("on_left").join(right.withColumn("token", F.explode("on_right")).drop("on_right"), ["block", "token"])
    return met.where(fits).select("a", "b").distinct()
