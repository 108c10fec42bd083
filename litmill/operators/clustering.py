"""Spherical k-means over bags of terms that stay where they lie.

A bag is stored as numbers of its frequent terms with their shares.  Each round
sends the centroids of the frequent terms and the clusters of all bags to the
tasks, which return the bags that move to another cluster; what these add to a
centroid, or take from it, is summed up by task, then by blocks of cells.  So a
round reads the bags once, and shuffles what moves in them.

Terms beyond the frequent ones stand in few bags.  Their centroids are not needed:
what they add to a product of a bag and a centroid is the sum of the bag's
products, over those terms, with the centroid's members, and these do not change
from round to round.  They are worked out once and lie with the bag.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .library import numbered

#: Terms whose numbers, and cells of centroids (of 8 bytes) that go to all tasks, at most.
KNOWN, CELLS = 1 << 19, 1 << 24
#: Bags whose numbers and lengths are joined by a broadcast, at most.
SENT = 1 << 21
#: Letters of a title that are sorted; where seeds share them, whole titles are.
HEAD = 24
#: Bags, and entries of bags, that are held at a time; bits of a cell's number within its block.
ROWS, ENTRIES, BLOCK = 2048, 1 << 19, 16


def _encoded(bag: Callable[..., Iterable[tuple[str, float]]], send: Broadcast, out: pa.Schema):
    """(id, gaps, shares, mass, rare, rest): bags with the numbers of their known terms, each as its distance from the one before, and the squares' sum of their weights; the other terms with their shares.

    Distances and shares are bytes, those of distances by place, three of each (CELLS are no more), as they pack better so.
    """

    def block(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, factor = send.value
        found, held = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                for i, cell in zip(*[c.to_pylist() for c in whole.slice(at, 128).columns], strict=True):
                    terms, shares, rare, rest = [], [], [], []
                    for t, x in bag(i, cell):
                        if (n := index.get(t)) is not None:
                            terms.append(n)
                            shares.append(x)
                        else:
                            rare.append(t)
                            rest.append(x)
                    own, x = np.array(terms, np.int32), np.array(shares, np.float64)
                    order = np.argsort(own, kind="stable")
                    own, x = own[order], x[order]
                    gaps = np.diff(own, prepend=np.int32(0)).astype("<i4").view(np.uint8).reshape(-1, 4).T[:3]
                    found.append((i, gaps.tobytes(), x.tobytes(), float(((x * factor[own]) ** 2).sum()), rare, rest))
                    held += len(own) + len(rare)
                    if held >= ENTRIES or len(found) >= ROWS:
                        yield block(found)
                        found, held = [], 0
        if found:
            yield block(found)

    return run


def _with(rows: DataFrame, more: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with more by id; null is an id like others."""
    return rows.join(more.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id")), how).drop("_id")


def _seeds(norm: DataFrame, k: int, n: int, titles: DataFrame | None) -> tuple[DataFrame, list[int]]:
    """(id, norm, place) and the places of the seeds, which stand at even distances in the order of titles, then ids; a place is a number from 0."""
    start = [i * n // k for i in range(k)]
    if titles is None:
        return numbered(norm, [F.col("id").asc()]), start
    # A title's first letters sort as the title does, but for equals.
    heads = titles.groupBy("id").agg(F.min(F.left("title", F.lit(HEAD))).alias("head"))
    at = numbered(_with(norm, heads, "left"), [F.col("head").asc_nulls_first(), F.col("id").asc()])
    wanted = at.where(F.col("place").isin(start)).select("head").distinct()
    group = cut(at.join(F.broadcast(wanted.withColumnRenamed("head", "_head")), F.col("head").eqNullSafe(F.col("_head"))).drop("_head"))  # k heads
    spans = group.groupBy("head").agg(F.min("place").alias("first"), F.count("*").alias("size")).orderBy("first").collect()
    titles = titles.where(F.left("title", F.lit(HEAD)).isin([span["head"] for span in spans if span["head"] is not None]))
    own = _with(titles, group.select("id"), "left_semi").groupBy("id").agg(F.min("title").alias("title"))
    sorted_ = numbered(_with(group.withColumnRenamed("place", "known"), own, "left"), [F.col("title").asc_nulls_first(), F.col("id").asc()])
    places, before = {}, 0
    for span in spans:
        places |= {before + s - span["first"]: s for s in start if span["first"] <= s < span["first"] + span["size"]}
        before += span["size"]
    found = {places[r["place"]]: r["known"] for r in sorted_.where(F.col("place").isin(list(places))).select("place", "known").collect()}  # k rows
    return at.drop("head"), [found[s] for s in start]


def _near(tail: DataFrame) -> DataFrame:
    """(place, near, products): for bags with rare terms (place, term, weight, unit), the bags that share any of them, and the products over each."""
    members = tail.groupBy("term").agg(F.collect_list(F.struct("place", "weight", "unit")).alias("m"))
    rows = members.select(F.explode("m").alias("a"), "m").select(F.col("a.place").alias("place"), F.transform("m", lambda b: b["place"]).alias("near"), F.transform("m", lambda b: F.col("a.weight") * b["unit"]).alias("products"))
    return rows.groupBy("place").agg(F.flatten(F.collect_list("near")).alias("near"), F.flatten(F.collect_list("products")).alias("products"))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the values of lists."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def _terms(part: pa.RecordBatch, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the known terms of bags."""
    column = part.column("shares")
    sizes = pc.binary_length(column).to_numpy() // 8
    row = np.repeat(np.arange(len(column)), sizes)
    packed = np.frombuffer(b"".join(part.column("gaps").to_pylist()), np.uint8)
    shares = np.frombuffer(b"".join(column.to_pylist()), np.float64)
    at = np.arange(len(row)) + np.repeat(2 * (np.cumsum(sizes) - sizes), sizes)
    step = np.repeat(sizes, sizes)
    gaps = packed[at].astype(np.int64)
    for shift in (8, 16):
        at += step
        gaps += packed[at].astype(np.int64) << shift
    total = np.cumsum(gaps)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    base = np.zeros(part.num_rows, np.int64)
    base[row[first]] = total[first] - gaps[first]
    terms = total - base[row]
    return row, terms, shares * factor[terms]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


class State:
    """Which bags are members of which cluster, -1 for none; `kept` has the members of those clusters that keep the centroid of former ones."""

    def __init__(self, of: np.ndarray, k: int, kept: dict[int, np.ndarray]):
        self.of, self.k, self.kept = of, k, kept
        self.sizes = np.bincount(of[of >= 0], minlength=k)
        for c, members in kept.items():
            self.sizes[c] = members.sum()

    def members(self, c: int, place: np.ndarray) -> np.ndarray:
        return self.kept[c][place] if c in self.kept else self.of[place] == c

    def met(self, part: pa.RecordBatch) -> np.ndarray:
        """Sums of the products of bags with the members of each cluster, over rare terms."""
        n = part.num_rows
        row, near = _flat(part.column("near"))
        products = _flat(part.column("products"))[1]
        of = self.of[near]
        some = of >= 0
        out = np.bincount(row[some] * self.k + of[some], weights=products[some], minlength=n * self.k).astype(float).reshape(n, self.k)
        for c, members in self.kept.items():
            out[:, c] = np.bincount(row, weights=products * members[near], minlength=n)
        return out


def _scored(part: pa.RecordBatch, terms: tuple, centre: np.ndarray, length: np.ndarray, state: State) -> np.ndarray:
    """Cosines of bags and centroids, 12 places; of those without a length, none."""
    row, term, weight = terms
    n = part.num_rows
    dots = np.stack([np.bincount(row, weights=weight * c[term], minlength=n) for c in centre], axis=1)
    dots = dots + state.met(part) / state.sizes
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.round(dots / part.column("norm").to_numpy()[:, None] / length, 12)
    return np.where(length > 0, score, -np.inf)


def _moved(shared: Broadcast):
    """(block, cells, sums): what bags add to the sums of units by cluster and term as they move to the nearest centroid, the first of equals, or take from them.  Blocks under 0 have the places of bags that move, and their new clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, centre, length, state = shared.value
        total = np.zeros(centre.size)
        for part in _parts(batches):
            place, norm = part.column("place").to_numpy(), part.column("norm").to_numpy()
            row, term, weight = terms = _terms(part, factor)
            new, of = _scored(part, terms, centre, length, state).argmax(axis=1), state.of[place]
            moved = np.flatnonzero(new != of)
            if not len(moved):
                continue
            here = (new != of)[row]
            row, term, unit = row[here], term[here], weight[here] / norm[row[here]]
            np.add.at(total, new[row] * len(factor) + term, unit)
            out = of[row] >= 0
            np.subtract.at(total, of[row[out]] * len(factor) + term[out], unit[out])
            yield _rows([-1 - int(place[0]) % 64], [place[moved].astype(np.int32).tobytes()], [new[moved].astype(np.int32).tobytes()])
        cells = np.flatnonzero(total)
        yield _blocks(cells, total[cells])

    return run


def _placed(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, *rest = shared.value
        for part in _parts(batches):
            score = _scored(part, _terms(part, factor), *rest)
            near = score.argmax(axis=1)
            best = score[np.arange(len(near)), near]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(near.astype(np.int32)), pa.array(np.where(np.isfinite(best), best, 0.0))], names=["id", "cluster", "score"])

    return run


def _rows(blocks: list[int], cells: list[bytes], sums: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(cells, pa.binary()), pa.array(sums, pa.binary())], names=["block", "cells", "sums"])


def _blocks(cells: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """Sums by cell, in ascending order, as blocks; a block's cells and sums are bytes."""
    ids, first = np.unique(cells >> BLOCK, return_index=True)
    each = list(zip(first, np.append(first, len(cells))[1:], strict=True))
    low = (cells & ((1 << BLOCK) - 1)).astype(np.uint16)
    return _rows(ids.tolist(), [low[a:b].tobytes() for a, b in each], [sums[a:b].tobytes() for a, b in each])


def _sums(shared: Broadcast):
    """(block, cells, sums): the sums of units by cluster and term, of all members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, state = shared.value
        total = np.zeros((state.k, len(factor)))
        for part in _parts(batches):
            place, norm = part.column("place").to_numpy(), part.column("norm").to_numpy()
            row, term, weight = _terms(part, factor)
            for c in range(state.k):
                own = state.members(c, place)[row]
                np.add.at(total[c], term[own], weight[own] / norm[row[own]])
        cells = np.flatnonzero(total)
        yield _blocks(cells, total.ravel()[cells])

    return run


def _squares(shared: Broadcast):
    """(cluster, square): sums of the products of members' units, over rare terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        squares = np.zeros(state.k)
        for part in _parts(batches):
            place, met = part.column("place").to_numpy(), state.met(part) / part.column("norm").to_numpy()[:, None]
            for c in range(state.k):
                squares[c] += met[state.members(c, place), c].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(state.k, dtype=np.int32)), pa.array(squares)], names=["cluster", "square"])

    return run


def _cells(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    block = np.repeat(part.column("block").to_numpy(), [len(c) // 2 for c in part.column("cells").to_pylist()])
    low = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint16)
    return (block << BLOCK) + low, np.frombuffer(b"".join(part.column("sums").to_pylist()), np.float64)


def _added(part: pa.Table) -> pa.Table:
    if part.column("block")[0].as_py() < 0:
        return part
    cells, sums = _cells(part)
    own, at = np.unique(cells, return_inverse=True)
    return pa.Table.from_batches([_blocks(own, np.bincount(at, weights=sums))])


class Bags:
    """Bags (id, place, norm, gaps, shares, near, products), stored, the factors of their terms' shares, and whether any has rare terms."""

    def __init__(self, rows: DataFrame, factor: np.ndarray, n: int, tailed: bool):
        self.rows, self.factor, self.n, self.tailed, self.context = rows, factor, n, tailed, rows.sparkSession.sparkContext

    def collected(self, rows: DataFrame, what: Callable, shared: Broadcast) -> pa.Table:
        """Blocks of sums by cell, added up.  A task adds up all that it reads, so the fewer there are the less is shuffled."""
        schema = "block long, cells binary, sums binary"
        found = rows.coalesce(max(1, self.context.defaultParallelism)).mapInArrow(what(shared), schema)
        found = found.groupBy("block").applyInArrow(_added, schema).toArrow()  # 10 bytes for each cell that changes, 8 for each bag that moves
        shared.destroy()
        return found

    def total(self, found: pa.Table, k: int) -> np.ndarray:
        cells, sums = _cells(found)
        total = np.zeros(k * len(self.factor))
        total[cells] = sums
        return total.reshape(k, -1)

    def sums(self, rows: DataFrame, state: State) -> np.ndarray:
        """Sums of units by cluster and term."""
        return self.total(self.collected(rows, _sums, self.context.broadcast((self.factor, state))), state.k)

    def squares(self, state: State) -> np.ndarray:
        """Squared lengths of the sums of units by cluster, over rare terms."""
        out = np.zeros(state.k)
        if self.tailed:
            shared = self.context.broadcast(state)
            rows = self.rows.where(F.size("near") > 0).select("place", "norm", "near", "products")
            found = rows.mapInArrow(_squares(shared), "cluster int, square double").groupBy("cluster").agg(F.sum("square")).collect()  # k rows
            shared.destroy()
            for c, square in found:
                out[c] = square
        return out

    def rounds(self, k: int, seeds: list[int], most: int) -> tuple[tuple, State]:
        """The centroids by which bags were placed last, and the members of those that follow."""
        of = np.full(self.n, -1, np.int32)
        of[seeds] = np.arange(k)
        state = State(of, k, {})
        total = self.sums(self.rows.where(F.col("place").isin(seeds)), state)
        centre = np.zeros_like(total)
        for _ in range(most):
            for c in range(k):
                if c in state.kept:
                    total[c] = 0.0
                else:
                    centre[c] = total[c] / state.sizes[c]
            length = np.sqrt((centre**2).sum(axis=1) + self.squares(state) / state.sizes**2)
            last = (self.factor, centre, length, state)
            found = self.collected(self.rows, _moved, self.context.broadcast(last))
            moves = found.filter(pc.less(found.column("block"), 0))
            new = state.of.copy()
            for cells, sums in zip(moves.column("cells").to_pylist(), moves.column("sums").to_pylist(), strict=True):
                new[np.frombuffer(cells, np.int32)] = np.frombuffer(sums, np.int32)
            if not moves.num_rows:
                break
            total += self.total(found.filter(pc.greater_equal(found.column("block"), 0)), k)
            state = self.following(state, new)
        return last, state

    def following(self, state: State, new: np.ndarray) -> State:
        """The state of new clusters; one that has lost all its members keeps their centroid."""
        empty = set(np.flatnonzero(np.bincount(new, minlength=state.k) == 0).tolist())
        return State(new, state.k, {c: state.kept[c] if c in state.kept else state.of == c for c in empty})


def _termed(send: Broadcast, shared: Broadcast):
    """(cluster, term, weight) of the known terms among some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, _ = send.value
        for batch in batches:
            terms = batch.column("term")
            at = np.array([index[t] for t in terms.to_pylist()], np.int64)
            for c, row in enumerate(shared.value):
                own = np.flatnonzero(row[at]) if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), c, np.int32)), terms.take(pa.array(own)), pa.array(row[at[own]])], names=["cluster", "term", "weight"])

    return run


def _rarer(shared: Broadcast):
    """(cluster, term, weight): what members add to their centroids' rare terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        for batch in batches:
            place, term, unit = batch.column("place").to_numpy(), batch.column("term"), batch.column("unit").to_numpy()
            for c in range(state.k):
                own = np.flatnonzero(state.members(c, place))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), c, np.int32)), term.take(pa.array(own)), pa.array(unit[own] / state.sizes[c])], names=["cluster", "term", "weight"])

    return run


def clustered(rows: DataFrame, bag: Callable[..., Iterable[tuple[str, float]]], frequency: DataFrame, scale: Callable[[Column], Column], k: int, most: int, titles: DataFrame | None, known: int | None, sent: int | None) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, score) and (cluster, term, weight) of bags: `bag` gives (term, share) of a row (id, ...), of which each id is one.

    frequency is a stored (term, df); a weight is a share times the scale of the term's df.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from .textmine import _least, _stored, id_type

    spark, kind = rows.sparkSession, id_type(rows)
    k = max(1, k)
    least = _least(frequency, min(known or KNOWN, max(1, CELLS // k)))
    top = frequency.where(F.col("df") >= least)
    found = top.select("term", "df", scale(F.col("df")).cast("double").alias("factor")).toArrow()  # KNOWN rows at most
    found = found.sort_by([("df", "descending"), ("term", "ascending")])
    factor = found.column("factor").to_numpy()
    index = dict(zip(found.column("term").to_pylist(), range(len(factor)), strict=True))
    send = spark.sparkContext.broadcast((index, factor))
    del found, index
    rare = frequency.where(F.col("df") < least)
    tailed = not rare.isEmpty()
    schema = f"id {kind}, gaps binary, shares binary, mass double, rare array<string>, rest array<double>"
    each = _stored(rows.mapInArrow(_encoded(bag, send, to_arrow_schema(StructType.fromDDL(schema))), schema))
    norm = each.select("id", F.sqrt("mass").alias("norm"))
    if tailed:
        own = each.select("id", F.explode(F.arrays_zip("rare", "rest")).alias("e")).select("id", F.col("e.rare").alias("term"), F.col("e.rest").alias("share"))
        weighed = _stored(own.join(rare, "term").select("id", "term", (F.col("share") * scale(F.col("df"))).alias("weight")))
        squares = each.select("id", "mass").unionAll(weighed.select("id", F.col("weight") ** 2))
        norm = squares.groupBy("id").agg(F.sqrt(F.sum("mass")).alias("norm"))
    norm = _stored(norm.where("norm > 0"))
    n = norm.count()
    if not n:
        return spark.createDataFrame([], f"id {kind}, cluster int, score double"), spark.createDataFrame([], "cluster int, term string, weight double")
    k = min(k, n)
    info, seeds = _seeds(norm, k, n, titles)
    none = [F.array().cast("array<int>").alias("near"), F.array().cast("array<double>").alias("products")]
    if tailed:
        tail = _stored(_with(weighed, info).select(F.col("place").cast("int").alias("place"), "term", "weight", (F.col("weight") / F.col("norm")).alias("unit")))
        near = _near(tail)
        info = info.withColumn("place", F.col("place").cast("int")).join(near, "place", "left").select("id", "norm", "place", *[F.coalesce(c, e).alias(c) for c, e in zip(("near", "products"), none, strict=True)])
    else:
        info = info.select("id", "norm", F.col("place").cast("int").alias("place"), *none)
    info = info.withColumnRenamed("id", "_id")
    info = F.broadcast(info) if not tailed and n <= (sent or SENT) else info
    encoded = each.select("id", "gaps", "shares").join(info, F.col("id").eqNullSafe(F.col("_id"))).drop("_id")
    stored = _stored(encoded)
    bags = Bags(stored, factor, n, tailed)
    last, state = bags.rounds(k, seeds, most)
    shared = spark.sparkContext.broadcast(last)
    placed = cut(stored.mapInArrow(_placed(shared), f"id {kind}, cluster int, score double"))
    shared.destroy()
    # From all members anew, so that what they have no longer is nought.
    weights = spark.sparkContext.broadcast(bags.sums(stored, state) / state.sizes[:, None])
    centres = top.select("term").mapInArrow(_termed(send, weights), "cluster int, term string, weight double")
    if tailed:
        members = spark.sparkContext.broadcast(state)
        centres = centres.unionAll(tail.select("place", "term", "unit").mapInArrow(_rarer(members), "cluster int, term string, weight double").groupBy("cluster", "term").agg(F.sum("weight").alias("weight")))
    return placed, _stored(centres)
