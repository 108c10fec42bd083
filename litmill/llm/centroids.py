"""Clustering of vectors around centroids, in integers.

The centroids of a round stand in a vantage-point tree: a node has a centroid as
its vantage point and splits the others by their distance from it, inner and
outer, with the range of distances of each side.  The driver builds the tree
anew each round, as there are few centroids, and broadcasts it.  Each vector
walks the tree best first: of its open nodes it takes the one with the least
bound, measures the exact integer distance to its vantage point, and opens the
sides whose range comes within the best distance, ends included, so that no
centroid of an equal distance is missed; of equal ones the smaller number wins.
The vectors of a batch walk together, each in its own order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .session import cut

WIDTH, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Size up to which the squared distance of two vectors of WIDTH such components fits a long.
MOST = 1 << 27
#: Vectors that walk together.
ROWS = 8192
#: What bounds may be off by, as a share of the distances they come from: they are floating-point numbers.
SLACK = 1e-9


class Tree:
    """A vantage-point tree over centroids, as arrays; node 0 is the root."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)
        #: Of each node: its centroid, its two sides (-1: none), and the least and greatest distance of each side from it.
        self.point, self.side, self.near, self.far = [], [], [], []
        self._build(list(range(len(centroids))))
        self.point, self.side = np.array(self.point, np.int64), np.array(self.side, np.int64).reshape(-1, 2)
        self.near, self.far = np.array(self.near, np.float64).reshape(-1, 2), np.array(self.far, np.float64).reshape(-1, 2)

    def _build(self, members: list[int]) -> int:
        if not members:
            return -1
        # The vantage point is the member with the widest spread of distances to the others.
        apart = np.sqrt(((self.centroids[members][:, None] - self.centroids[members][None]) ** 2).sum(axis=2).astype(np.float64))
        chosen = int(np.argmax(apart.std(axis=1)))
        node = len(self.point)
        self.point.append(members[chosen])
        self.side.append([-1, -1])
        self.near.append([np.inf, np.inf])
        self.far.append([-np.inf, -np.inf])
        rest = [i for i in range(len(members)) if i != chosen]
        rest.sort(key=lambda i: (apart[chosen, i], members[i]))
        half = (len(rest) + 1) // 2
        for k, part in enumerate((rest[:half], rest[half:])):
            if part:
                self.near[node][k], self.far[node][k] = apart[chosen, part].min(), apart[chosen, part].max()
                self.side[node][k] = self._build([members[i] for i in part])
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each integer vector; of equal ones the smallest number."""
        n = len(vectors)
        bound = np.full((n, len(self.point)), np.inf)  # of open nodes
        if len(self.point):
            bound[:, 0] = 0.0
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, len(self.point))
        walking = np.arange(n if len(self.point) else 0)
        while len(walking):
            node = bound[walking].argmin(axis=1)
            go = bound[walking, node] <= np.sqrt(best[walking].astype(np.float64)) * (1 + SLACK)
            walking, node = walking[go], node[go]
            bound[walking, node] = np.inf
            for at in np.unique(node).tolist():
                rows = walking[node == at]
                apart = ((vectors[rows] - self.centroids[self.point[at]]) ** 2).sum(axis=1)
                closer = (apart < best[rows]) | ((apart == best[rows]) & (self.point[at] < number[rows]))
                best[rows[closer]], number[rows[closer]] = apart[closer], self.point[at]
                d = np.sqrt(apart.astype(np.float64))
                for k in range(2):
                    if self.side[at, k] >= 0:
                        slack = SLACK * (d + self.far[at, k])
                        bound[rows, self.side[at, k]] = np.maximum(0.0, np.maximum(d - self.far[at, k], self.near[at, k] - d) - slack)
            walking = walking[np.isfinite(bound[walking]).any(axis=1)]
        return number, best


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a binary column of 32-bit integers."""
    data, _ = kernel.text_bytes(column)
    return np.frombuffer(data.tobytes(), np.int32).reshape(len(column), WIDTH).astype(np.int64)


def _whole(batches):
    for batch in batches:
        x = np.floor(SCALE * batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        x = np.clip(x, -MOST, MOST).astype(np.int32).reshape(batch.num_rows, WIDTH)
        body = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(np.arange(0, 4 * WIDTH * batch.num_rows + 1, 4 * WIDTH, dtype=np.int32)), pa.py_buffer(x.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), body], names=["vec_id", "q"])


def _sums(shared):
    """Vectors to a row for each centroid: how many are nearest to it, and the sums of their components."""

    def run(batches):
        tree = shared.value
        many = np.zeros(len(tree.centroids), np.int64)
        total = np.zeros((len(tree.centroids), WIDTH), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column("q").slice(lo, ROWS))
                number, _ = tree.nearest(x)
                many += np.bincount(number, minlength=len(many))
                for c in np.unique(number).tolist():
                    total[c] += x[number == c].sum(axis=0)
        some = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(many[some]), *[pa.array(total[some, i]) for i in range(WIDTH)]], names=["cluster", "n", *[f"s{i}" for i in range(WIDTH)]])

    return run


def _assigned(shared):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                number, best = shared.value.nearest(_matrix(part.column("q")))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])

    return run


def clustered(vectors: DataFrame, salt: str = "3", centroids: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """A row for each vector of WIDTH finite components: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Components become floor(1024 * x).  Centroids start as the vectors of the
    least sha256 of salt:vec_id, fewer where there are fewer vectors; each
    round replaces a centroid by the floor of the mean of the vectors nearest
    to it, and an empty one stays.  distance is squared, cluster_inertia its
    sum over the cluster, inertia that over all; a sum beyond a long is null.

    Vectors that are null, of another width, or hold null or non-finite
    components have no row.  Rows that repeat a vector count, and are returned,
    as often as they stand there; those of one hash start in the order of their
    components.  Rows without a vec_id are clustered, and start only where
    there are too few others.  Components beyond 131,072 in size count as that,
    so that a distance fits a long.  An empty table gives no rows; other columns
    are not looked at.  Each round scans the integers once and sends a row for
    each task and centroid.
    """
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where((F.size("embedding") == WIDTH) & finite)
    whole = cut(rows.mapInArrow(kernel.tidy(_whole), "vec_id long, q binary"))
    by_hash = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256).asc_nulls_last()
    first = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(SCALE * F.greatest(F.least(x, F.lit(MOST / SCALE)), F.lit(-MOST / SCALE)))).alias("q")).orderBy(by_hash, "q").limit(centroids).collect()
    points = np.array([r["q"] for r in first], np.int64).reshape(-1, WIDTH)
    for _ in range(rounds if len(points) else 0):
        shared = spark.sparkContext.broadcast(Tree(points))  # of `centroids` vectors
        parts = whole.select("q").mapInArrow(kernel.tidy(_sums(shared)), "cluster int, n long, " + ", ".join(f"s{i} long" for i in range(WIDTH)))
        for r in parts.groupBy("cluster").agg(F.sum("n"), *[F.sum(f"s{i}") for i in range(WIDTH)]).collect():  # a row for each centroid
            points[r[0]] = [s // r[1] for s in r[2:]]
    shared = spark.sparkContext.broadcast(Tree(points))
    found = cut(whole.mapInArrow(kernel.tidy(_assigned(shared)), "vec_id long, cluster int, distance long"))
    wide = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # a row for each centroid
    inertia = {r["cluster"]: int(r["d"]) for r in wide}
    fit = lambda x: x if x < 1 << 63 else None
    digests = [hashlib.sha256(",".join(map(str, p.tolist())).encode()).hexdigest() for p in points]
    each = spark.createDataFrame([(c, fit(inertia[c]), fit(sum(inertia.values())), digests[c]) for c in sorted(inertia)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
