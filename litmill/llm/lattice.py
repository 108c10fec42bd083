"""Near-duplicate embeddings by lattice hashing.

Unit vectors are projected to eight dimensions, several times over, and each
projection is decoded to the nearest point of the E8 lattice, whose cell is the
bucket.  Every vector also looks into the cells next to its own that it lies
closest to.  Where a label has so many vectors that unlike ones would crowd a
cell, the cells of two or more projections together are the bucket, so cells
stay small at every size.  In each cell one vector serves as hub, and only (member, hub) pairs
are compared; then pairs that meet in a cell but belong to different components.
Links are counted at the end within each component, in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, met
from .session import cut

#: Fixed index parameters: tables, neighbouring cells looked into, and how far apart in cells (whose
#: centres are 1.41 apart or more) a pair of the least similarity is expected to be.
TABLES, PROBES, APART = 4, 6, 0.71
#: Vectors of one label up to which one projection makes a bucket, as cells then hold a few unlike ones; each further
#: projection takes as many times more, with MORE tables to keep the share of near pairs that meet (tests measure it).
CROWD = 8_000_000
MORE = 2
#: Vectors of a cell that are paired with all of it in one task, if they are of different components.
CELL = 1_000
#: Vectors of a component that are compared in one block.
BLOCK = 1024


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
    off = x[odd] - r[odd]
    worst = np.abs(off).argmax(axis=1)
    k = np.arange(len(odd))
    r[odd, worst] += np.where(off[k, worst] >= 0, 1.0, -1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of the E8 lattice, doubled so that they are integers."""
    a = _nearest_d8(x)
    b = _nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.rint(2 * np.where(closer[:, None], a, b)).astype(np.int64)


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: steps to neighbouring cells."""
    out = []
    for i in range(8):
        for j in range(i):
            for s in (-2, 2):
                for t in (-2, 2):
                    v = np.zeros(8, np.int64)
                    v[i], v[j] = s, t
                    out.append(v)
    signs = np.array(np.meshgrid(*[[-1, 1]] * 8)).reshape(8, -1).T
    return np.vstack((np.array(out), signs[(signs < 0).sum(axis=1) % 2 == 0]))


STEPS = _minimal_vectors()


def projections(dim: int, tables: int, depth: int) -> list[list[np.ndarray]]:
    """Orthonormal random projections to eight dimensions, `depth` for each table."""
    return [[np.linalg.qr(np.random.default_rng((7, table, dim, k)).standard_normal((max(dim, 8), 8)))[0] for k in range(depth)] for table in range(tables)]


def depth_of(crowd: int) -> int:
    """Projections of a bucket for a label of that many vectors."""
    return max(1, int(np.ceil(np.log(max(crowd, 2)) / np.log(CROWD) - 1e-9)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrices(column: pa.Array | pa.ChunkedArray):
    """(rows, unit vectors) of a column of number lists, for each length that occurs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield rows, _unit(flat[start[rows][:, None] + np.arange(dim)])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with that row of b, both unit vectors: the one rule by which pairs link."""
    return (a * b).sum(axis=1)


def scale(dim: int, least: float) -> float:
    """How projections are scaled; a projection keeps 8 / dim of a squared distance on average."""
    return APART / np.sqrt(2 * max(1 - least, 1e-4) * 8 / max(dim, 8))


def _cells(least: float, depth: int):
    """(node, table, cell, own) of the bucket of every vector and the buckets it looks into."""
    return lambda batches: (out for batch in batches for out in _cells_of(batch, least, depth))


def _cells_of(batch: pa.RecordBatch, least: float, depth: int):
    ids = batch.column("node").to_numpy(zero_copy_only=False)
    for at, x in matrices(batch.column("v")):
        dim = x.shape[1]
        if dim < 8:
            x = np.pad(x, ((0, 0), (0, 8 - dim)))
        for table, parts in enumerate(projections(int(dim), TABLES + MORE * (depth - 1), depth)):
            for lo in range(0, len(at), 2048):
                n = len(x[lo : lo + 2048])
                combined = np.zeros((n, 1, 0), np.int32)
                for p in parts:
                    y = scale(dim, least) * (x[lo : lo + 2048] @ p)
                    cell = nearest_e8(y)
                    far = -2 * (2 * y - cell) @ STEPS.T  # all steps are equally long
                    near = np.argpartition(far, PROBES, axis=1)[:, :PROBES]
                    cells = np.concatenate((cell[:, None], cell[:, None] + STEPS[near]), axis=1).astype(np.int32)
                    # Every bucket so far with every cell of this projection; the first stays the vector's own.
                    k = combined.shape[1]
                    combined = np.concatenate((np.repeat(combined, PROBES + 1, axis=1), np.tile(cells, (1, k, 1))), axis=2)
                k = combined.shape[1]
                own = np.zeros((n, k), dtype=bool)
                own[:, 0] = True
                names = [c.tobytes() for c in combined.reshape(n * k, -1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at[lo : lo + 2048]], k)), pa.array(np.full(len(names), table, np.int32)), pa.array(names, pa.binary()), pa.array(own.ravel())], names=["node", "table", "cell", "own"])


def _similar(least: float):
    def run(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, dtype=bool)
            others = {x.shape[1]: (rows, x) for rows, x in matrices(batch.column("v_b"))}
            for rows, x in matrices(batch.column("v_a")):
                if x.shape[1] in others:
                    also, y = others[x.shape[1]]
                    met, i, j = np.intersect1d(rows, also, assume_unique=True, return_indices=True)
                    for lo in range(0, len(met), 4096):
                        k = slice(lo, lo + 4096)
                        ok[met[k]] = cosines(x[i[k]], y[j[k]]) >= least
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return run


def _counted(least: float):
    """One block pair of a component: for each vector how many others of the block pair it links with."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        weight, block = table.column("copies").to_numpy(), table.column("block").to_numpy()
        first = table.column("first")[0].as_py()
        links = np.zeros(len(ids), dtype=np.int64)
        for at, x in matrices(table.column("v")):
            for lo in range(0, len(at), 512):
                product = x[lo : lo + 512] @ x.T
                near = product >= least
                # Products round in another order than cosines do: close calls are made by the latter.
                i, j = np.nonzero(np.abs(product - least) < 1e-9)
                near[i, j] = cosines(x[lo + i], x[j]) >= least
                # Pairs within one block are counted where both its names are that block.
                second = table.column("second")[0].as_py()
                if first != second:
                    near &= block[at][lo : lo + 512, None] != block[at][None, :]
                near[np.arange(near.shape[0]), lo + np.arange(near.shape[0])] = False
                links[at[lo : lo + 512]] = near @ weight[at]
        return pa.table({"node": ids, "links": links})

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label).

    Vectors of equal, non-null label link when their cosine, in double
    precision, is at least `least`; those of different length never.  n_links
    counts the other vectors linked directly, component_id is the smallest
    vec_id that links reach, itself included; kept marks it.  Vectors that are
    null, empty, zero, or hold null or non-finite components stay alone, as do
    rows with a null vec_id, whose component is null.  Rows that repeat a
    vec_id with its vector count once; vectors that share a vec_id link each on
    its own, and each row has the result of its vector.  An empty table gives no rows.  Other
    columns are not looked at.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label"))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    keys = [F.xxhash64("label", "v").alias("k1"), F.xxhash64(F.lit("second"), "v", "label").alias("k2")]
    # Equal vectors of a label are one; a group of copies is never expanded.
    kinds = cut(rows.where("sound").groupBy(*keys).agg(F.min("vec_id").alias("first_id"), F.countDistinct("vec_id").alias("copies"), F.any_value("v").alias("v"), F.any_value("label").alias("label")).withColumn("node", F.col("k1")))
    crowd = kinds.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    cells = kinds.select("node", "v").mapInArrow(_cells(least, depth_of(crowd)), "node long, table int, cell binary, own boolean")
    where = cut(cells.join(kinds.select("node", "label"), "node").select("node", F.xxhash64("label", "table", "cell").alias("cell"), "own"))
    v = kinds.select("node", "v", "label")

    def checked(pairs: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(v.select(F.col("node").alias(side), F.col("v").alias(f"v_{side}"), F.col("label").alias(f"label_{side}")), side)
        return cut(pairs.where("label_a = label_b").select("a", "b", "v_a", "v_b").mapInArrow(_similar(least), "a long, b long"))

    def ordered(a: str, b: str) -> list:
        return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]

    hubs = where.where("own").groupBy("cell").agg(F.min("node").alias("hub"))
    links = checked(met(where, hubs, "cell", "node").where("node <> hub").select(*ordered("node", "hub")).distinct())
    found = connected_components(links, "a", "b")
    placed = where.join(found, "node", "left").select("cell", "node", "own", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    mixed = mixed.select("cell", F.ceil(F.col("n") / CELL).cast("int").alias("blocks"))
    # A full cell is split, and each part meets all of it in a task of its own.
    placed = cut(met(placed, mixed, "cell", "node"))
    x = placed.where("own").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).alias("x")
    y = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    across = x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.component") != F.col("y.component")))
    more = checked(across.select(*ordered("x.node", "y.node")).distinct())
    if not more.isEmpty():
        found = connected_components(links.unionAll(more), "a", "b")

    sizes = found.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = found.join(sizes, "component").join(kinds.select("node", "v", "copies"), "node")
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("component", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "node", "v", "copies")
    counted = members.groupBy("component", "first", "second").applyInArrow(_counted(least), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))

    homes = kinds.select("k1", "k2", "node", "first_id", "copies").join(found, "node", "left").join(counted, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = homes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    homes = homes.join(names, "component").select("k1", "k2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    keyed = rows.select("vec_id", *[F.when(F.col("sound"), k).alias(n) for k, n in zip(keys, ("k1", "k2"), strict=True)])
    out = keyed.join(homes, ["k1", "k2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
