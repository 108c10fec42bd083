"""Nearest neighbours by an inverted-file index over vectors, with filters.

Vectors of unit length are stored by the list of their nearest centroid, one
folder a list, so a search reads the lists that it probes and no others.  The
centroids are trained on a bounded sample; every vector is indexed.  Lists know
their number of vectors and their radius, the widest angle to the centroid, by
which a search can go on until no unread list can hold a nearer vector.

Vectors meet queries in blocks of bounded size, each of products of matrices that
keep k a query: lists are dealt into bundles, one with many vectors into several,
and queries into turns.  A vector is sent once a turn and a query once a bundle,
so what is sent grows with their number, not with that of the lists.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_folder, cut
from .retrieval import signature

#: Vectors that centroids are trained on at most, those of the least hash of id; lists at most; rounds of training.
SAMPLE, LISTS, ROUNDS = 65_536, 4096, 8
#: Vectors, or queries, that meet lists at a time; scores of a product that are held at a time.
ROWS, TILE = 4096, 1 << 20
#: Blocks of vectors that meet blocks of queries, at least where there are enough of both; components of a block at most.
PRODUCTS, CELLS = 64, 1 << 23
#: Lists that a search reads at first; share of visible vectors under which it scans those instead.
PROBES, NARROW = 16, 0.1
#: What angles may be off by.
SLACK = 1e-7
#: Changes when what is stored does.
VERSION = 1


@dataclass
class Index:
    """rows (id, list, vector) and, for each list, its number of vectors, radius and centroid, LISTS at most."""

    rows: DataFrame
    sizes: np.ndarray
    radius: np.ndarray
    centroids: np.ndarray

    @property
    def count(self) -> int:
        return int(self.sizes.sum())


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(id, vector) at unit length; what is null, zero, or not finite is left out, as it is near nothing."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).withColumn("_norm", norm)
    return rows.where((F.col("_norm") > 0) & (F.col("_norm") < float("inf"))).select("id", F.transform("vector", lambda x: x / F.col("_norm")).alias("vector"))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _lists_of(matrix: np.ndarray) -> pa.ListArray:
    width = matrix.shape[1]
    return pa.ListArray.from_arrays(np.arange(0, matrix.size + 1, width, dtype=np.int32), matrix.ravel())


def _trained(lists: int):
    """Spherical k-means over one table, the sample."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("at").to_numpy(), kind="stable")
        x = _matrix(table.column("vector"))[order]
        centroids = x[:lists].copy()
        for _ in range(ROUNDS):
            of = np.concatenate([(x[lo : lo + ROWS] @ centroids.T).argmax(axis=1) for lo in range(0, len(x), ROWS)])
            total = np.zeros_like(centroids)
            np.add.at(total, of, x)
            norm = np.linalg.norm(total, axis=1)
            centroids[norm > 0] = total[norm > 0] / norm[norm > 0, None]
        return pa.table({"list": np.arange(len(centroids), dtype=np.int32), "centroid": _lists_of(centroids)})

    return run


def _assigned(shared):
    """(id, list, angle, vector) of batches of vectors."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                near = _matrix(part.column("vector")) @ shared.value.T
                of = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(of)), of], -1, 1))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(of.astype(np.int32)), pa.array(angle), part.column("vector")], names=["id", "list", "angle", "vector"])

    return run


def built(vectors: DataFrame, folder: str, lists: int | None = None) -> None:
    """Write the index of vectors (id, vector) into a folder.  Vectors of another width than that of the first sampled one are left out."""
    spark = vectors.sparkSession
    units = cut(unit_vectors(vectors).withColumn("at", F.xxhash64("id")))
    first = units.orderBy("at", "id").limit(1).select(F.size("vector").alias("width")).collect()
    units = units.where(F.size("vector") == (first[0]["width"] if first else 0))
    n = units.count()
    lists = min(LISTS, n, lists or max(1, int(np.ceil(np.sqrt(n)))))
    sample = units.orderBy("at", "id").limit(SAMPLE)
    centroids = cut(sample.select("at", "vector").withColumn("sample", F.lit("all")).groupBy("sample").applyInArrow(_trained(lists), "list int, centroid array<double>"))
    found = centroids.orderBy("list").toArrow()  # LISTS rows at most
    shared = spark.sparkContext.broadcast(_matrix(found.column("centroid")))
    rows = units.select("id", "vector").mapInArrow(_assigned(shared), "id long, list int, angle double, vector array<double>")
    # A list with many vectors goes to several tasks.
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(max(1, n // (max(1, lists) * 16 * ROWS)))))
    dealt.repartition("list", "_part").drop("_part").write.mode("overwrite").partitionBy("list").parquet(f"{folder}/rows")
    stored = spark.read.schema("id long, angle double, vector array<double>, list int").parquet(f"{folder}/rows")
    stats = stored.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    # Written last: an index without it is not whole.
    centroids.join(stats, "list", "left").select("list", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("radius", F.lit(0.0)).alias("radius"), "centroid").coalesce(1).write.mode("overwrite").parquet(f"{folder}/lists")


def opened(spark, folder: str) -> Index:
    lists = spark.read.parquet(f"{folder}/lists").orderBy("list").toArrow()  # LISTS rows at most
    rows = spark.read.schema("id long, angle double, vector array<double>, list int").parquet(f"{folder}/rows").drop("angle")
    return Index(rows, lists.column("n").to_numpy(), lists.column("radius").to_numpy(), _matrix(lists.column("centroid")))


def stored(name: str, table: DataFrame, vectors: DataFrame, lists: int | None = None) -> Index:
    """The index of vectors, written once for each state of the table they come from, in the checkpoint folder."""
    spark = table.sparkSession
    kind = zlib.crc32(repr((VERSION, SAMPLE, LISTS, ROUNDS, lists)).encode())
    folder = f"{checkpoint_folder(spark)}/{name}-{kind:08x}-{signature(table)}"
    try:
        return opened(spark, folder)
    except AnalysisException:  # not there yet
        built(vectors, folder, lists)
        return opened(spark, folder)


def _packed(bits: np.ndarray) -> pa.Array:
    """A row of bits as bytes."""
    return pa.array([row.tobytes() for row in np.packbits(bits, axis=1)], pa.binary())


def _bits(column, width: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1), axis=1, count=width).astype(bool)


def _probed(shared, probes: int):
    """(query_id, vector, least, lists): each query with a bit for each list, set for its nearest."""

    def run(batches):
        centroids, _, filled = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                near = _matrix(part.column("vector")) @ centroids.T
                near[:, ~filled] = -np.inf
                chosen = np.zeros(near.shape, bool)
                np.put_along_axis(chosen, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
                yield pa.RecordBatch.from_arrays([*map(part.column, ("query_id", "vector", "least")), _packed(chosen & filled)], names=["query_id", "vector", "least", "lists"])

    return run


def _widened(shared):
    """Instead of the lists that a query has met, those of the others that may hold a vector as near as its `least`."""

    def run(batches):
        centroids, radius, filled = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                near = _matrix(part.column("vector")) @ centroids.T
                apart = np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - radius - SLACK)
                may = np.cos(np.minimum(apart, np.pi)) >= part.column("least").to_numpy()[:, None]
                chosen = may & filled & ~_bits(part.column("lists"), len(filled))
                yield pa.RecordBatch.from_arrays([*map(part.column, ("query_id", "vector", "least")), _packed(chosen)], names=["query_id", "vector", "least", "lists"])

    return run


def _tallied(lists: int):
    """(list, n): queries of each list; of any at all, under -1."""

    def run(batches):
        n = np.zeros(lists + 1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                bits = _bits(batch.column("lists").slice(lo, ROWS), lists)
                n += np.append(bits.sum(axis=0), bits.any(axis=1).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(lists), -1).astype(np.int32)), pa.array(n)], names=["list", "n"])

    return run


def _bundled(sizes: np.ndarray, load: np.ndarray, bundles: int) -> list[list[int]]:
    """For each list that is asked for, the bundles that its vectors are dealt into: all bundles about even in vectors and in products."""
    work = sizes * load
    share = (sizes / max(1, sizes[load > 0].sum()) + work / max(1, work.sum())) / 2
    pieces = np.where(load > 0, np.clip(np.ceil(share * bundles), 1, bundles), 0).astype(int)
    full = [(0.0, b) for b in range(bundles)]
    out = [[] for _ in sizes]
    for at in np.argsort(-share / np.maximum(pieces, 1), kind="stable"):
        taken = [heapq.heappop(full) for _ in range(pieces[at])]
        for used, b in taken:
            out[at].append(b)
            heapq.heappush(full, (used + share[at] / pieces[at], b))
    return out


def _sent(held: list[np.ndarray]):
    """(bundle, turn, query_id, vector, least, lists): each query once for each bundle that holds one of its lists, with bits for the bundle's lists."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                bits = _bits(part.column("lists"), max((int(own.max()) + 1 for own in held if len(own)), default=0))
                for bundle, own in enumerate(held):
                    rows = np.flatnonzero(bits[:, own].any(axis=1))
                    if len(rows):
                        columns = [part.column(name).take(pa.array(rows)) for name in ("turn", "query_id", "vector", "least")]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), bundle, np.int32)), *columns, _packed(bits[rows][:, own])], names=["bundle", "turn", "query_id", "vector", "least", "lists"])

    return run


def _product(held: list[np.ndarray], k: int, least: float):
    """A bundle of lists and some queries: each query's k nearest in those of the lists that it asks for."""

    def run(part: pa.Table, asked: pa.Table) -> pa.Table:
        if not part.num_rows or not asked.num_rows:
            return pa.table({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        lists = held[part.column("bundle")[0].as_py()]
        of, ids = part.column("list").to_numpy(), part.column("id").to_numpy()
        order = np.lexsort((ids, of))
        of, ids, x = of[order], ids[order], _matrix(part.column("vector"))[order]
        queries, q = asked.column("query_id").to_numpy(), _matrix(asked.column("vector"))
        asks, bound = _bits(asked.column("lists"), len(lists)), np.maximum(asked.column("least").to_numpy(), least)
        top, named = np.full((len(queries), k), -np.inf), np.zeros((len(queries), k), np.int64)
        for at, (start, end) in enumerate(zip(np.searchsorted(of, lists), np.searchsorted(of, lists, "right"), strict=True)):
            mine = np.flatnonzero(asks[:, at])
            for lo in range(start, end, ROWS):
                v, names = x[lo : min(end, lo + ROWS)], ids[lo : min(end, lo + ROWS)]
                for own in np.array_split(mine, max(1, -(-len(mine) * len(v) // TILE))):
                    met = q[own] @ v.T
                    row, col = np.nonzero(met >= (np.maximum(bound[own], top[own, -1]) - 1e-9)[:, None])
                    r, i, s = own[row], names[col], np.round(met[row, col], 9)
                    # What ties with the kth so far comes in by a smaller id only.
                    near = (i != queries[r]) & (s >= least) & ((s > top[r, -1]) | ((s == top[r, -1]) & (i < named[r, -1])))
                    if not near.any():
                        continue
                    r, i, s = r[near], i[near], s[near]
                    touched = np.unique(r)
                    r, i, s = (np.concatenate(both) for both in ((r, np.repeat(touched, k)), (i, named[touched].ravel()), (s, top[touched].ravel())))
                    by = np.lexsort((i, -s, r))
                    r, i, s = r[by], i[by], s[by]
                    place = np.arange(len(r)) - np.searchsorted(r, r)
                    first = place < k
                    top[r[first], place[first]], named[r[first], place[first]] = s[first], i[first]
        row, col = np.nonzero(top > -np.inf)
        return pa.table({"query_id": queries[row], "id": named[row, col], "score": top[row, col]})

    return run


def _met(rows: DataFrame, sizes: np.ndarray, asked: DataFrame, k: int, least: float) -> DataFrame:
    """(query_id, id, score): the k nearest of each query (query_id, vector, least, lists) in parts of the lists whose bits it has set; sizes bounds the rows of each list.

    Lists are dealt into bundles and queries into turns, so a vector is sent once
    a turn and a query once a bundle, however many of its lists it asks for.
    """
    spark = rows.sparkSession
    tally = asked.select("lists").mapInArrow(_tallied(len(sizes)), "list int, n long").groupBy("list").agg(F.sum("n").alias("n")).collect()  # a row for each list
    tally = {r["list"]: r["n"] for r in tally}
    load = np.array([tally.get(at, 0) for at in range(len(sizes))], np.int64)
    n, queries = int(sizes[load > 0].sum()), tally.get(-1, 0)
    if not n or not queries:
        return spark.createDataFrame([], "query_id long, id long, score double")
    width = len(asked.select("vector").first()[0])
    block = max(ROWS, CELLS // max(1, width))
    # As many products for any input, of sides that send the least; more where a block would not fit its task.
    products = max(1, min(max(PRODUCTS, 4 * spark.sparkContext.defaultParallelism), n * queries // (ROWS // 4) ** 2))
    bundles = max(1, min(products, round((products * n / queries) ** 0.5)), -(-n // block))
    turns = max(-(-products // bundles), -(-queries // block))
    into = _bundled(sizes, load, bundles)
    held = [np.array([at for at, own in enumerate(into) if bundle in own], np.int64) for bundle in range(bundles)]
    plan = F.broadcast(spark.createDataFrame([(at, own) for at, own in enumerate(into) if own], "list int, into array<int>"))
    v = rows.where(F.col("list").isin([at for at, own in enumerate(into) if own])).join(plan, "list")
    v = v.select(F.get("into", F.pmod(F.xxhash64("id"), F.size("into")).cast("int")).alias("bundle"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), "list", "id", "vector")
    q = asked.withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int"))
    q = q.mapInArrow(_sent(held), "bundle int, turn int, query_id long, vector array<double>, least double, lists binary")
    return v.groupBy("bundle", "turn").cogroup(q.groupBy("bundle", "turn")).applyInArrow(_product(held, k, least), "query_id long, id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def search(index: Index, queries: DataFrame, k: int, least: float = 0.0, visible: DataFrame | None = None, probes: int = PROBES, exact: bool = False) -> DataFrame:
    """(query_id, id, score, place): the k vectors of greatest cosine, `least` or more, of each query (query_id, vector), itself left out.

    visible (id) leaves out all others before anything is counted.  Where under
    NARROW of all vectors are visible, those are scanned; else as many more lists
    are probed as fewer are visible.  exact goes on to the lists whose radius
    does not rule them out, so that no nearer vector is missed.  Queries without
    a direction, or of another width, find nothing; of several vectors of one
    query_id the least counts; equal scores are placed by id.
    """
    spark = index.rows.sparkSession
    width = index.centroids.shape[1]
    asked = unit_vectors(queries.withColumnRenamed("query_id", "id")).where(F.size("vector") == width).groupBy(F.col("id").alias("query_id")).agg(F.min("vector").alias("vector"))
    if not index.count:
        return spark.createDataFrame([], "query_id long, id long, score double, place int")
    asked = asked.withColumn("least", F.lit(float(least)))
    rows = index.rows
    if visible is not None:
        ids = cut(visible.select("id").distinct())
        seen = ids.count()
        rows = rows.join(ids, "id", "left_semi")
        if seen < NARROW * index.count:
            # The visible vectors in blocks of their own; all queries meet all of them.
            blocks = max(1, -(-seen // ROWS))
            rows = rows.drop("list").withColumn("list", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
            every = np.packbits(np.ones(blocks, bool)).tobytes()
            return _best(_met(rows, np.full(blocks, ROWS), cut(asked.withColumn("lists", F.lit(every))), k, least), k)
        probes = int(np.ceil(probes * index.count / max(seen, 1)))
    shared = spark.sparkContext.broadcast((index.centroids, index.radius, index.sizes > 0))
    marked = "query_id long, vector array<double>, least double, lists binary"
    asked = cut(asked.mapInArrow(_probed(shared, probes), marked))
    found = _best(_met(rows, index.sizes, asked, k, least), k)
    if not exact:
        return found
    found = cut(found)
    kth = found.where(F.col("place") == k).select("query_id", (F.col("score") - 1e-8).alias("kth"))
    open_ = asked.join(kth, "query_id", "left").select("query_id", "vector", F.coalesce("kth", F.col("least") - 1e-8).alias("least"), "lists")
    more = cut(open_.mapInArrow(_widened(shared), marked))
    return _best(found.drop("place").unionAll(_met(rows, index.sizes, more, k, least)), k)
