"""N-gram Jaccard join by vertical partitioning.

A document is its set of distinct word n-grams.  The global order of n-grams
(by hash) is cut into fragments.  Work per fragment is independent; what a
fragment finds is a partial count, and partial counts are summed:

1. Every fragment counts, over all documents, in how many different sets each
   of its n-grams occurs.  Summed per document this gives the number of its
   n-grams that occur in any other set.  A document with fewer than
   threshold * size of them cannot reach the threshold with anything and is
   done.  This is exact and leaves the near copies.  A block of texts adds up
   what several of its sets have in common, so an n-gram that all documents
   share sends its fragment one number a block.
2. The rest order their n-grams from rare to frequent and keep the prefix in
   which two similar sets must meet.  In each prefix n-gram one document, the
   one with the fewest rarer n-grams, serves as hub; only (member, hub) pairs
   are formed, so a group of k copies gives k pairs.
3. Overlaps of pairs are counted per fragment and summed per pair.
4. Links become components.  Then all prefix meetings between documents of
   different components that pass the size and position bounds are counted
   too, so no link that joins two components is missed.

Equal sets are one node throughout, named by their digest.  N-grams are
compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .components import connected_components, met
from .session import cut

#: N-grams that one fragment of the first step and one block of texts hold.
FRAGMENT = 3_500_000
BLOCK = 1_000_000
#: Fragments in which the overlap of a pair is counted.
PARTS = 8
#: Kinds of prefix entries of one n-gram that are compared with all of its kinds in one task.
KINDS = 1_000

_MESSAGE = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("body", pa.list_(pa.binary()))])
_SET = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("rarity", pa.binary())])
_MESSAGE_DDL = "key long, block long, part int, body array<binary>"
_SET_DDL = "doc_id long, n long, digest binary, rarity binary"


def _digest(sets: np.ndarray) -> bytes:
    """128 bits that stand for a set, given as its sorted hashes."""
    place = np.arange(1, len(sets) + 1, dtype=np.uint64)
    low = kernel.mix(sets + place).sum(dtype=np.uint64)
    high = kernel.mix(sets ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(sets))
    return int(low).to_bytes(8, "little") + int(high).to_bytes(8, "little")


def node_of(digest: bytes) -> int:
    """The number of a set's node: the first half of its digest."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _sets(texts: pa.Array, width: int):
    for _, _, data, offsets in kernel.pieces(texts):
        words, counts = kernel.word_hashes(data, offsets)
        at = 0
        for n in counts.tolist():
            yield np.unique(kernel.shingle_hashes(words[at : at + n], width))
            at += n


def _part(tokens: np.ndarray, fragments: int) -> np.ndarray:
    """The fragment of each n-gram, in the order of n-grams."""
    return ((tokens >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)


def _dealt(width: int, fragments: int):
    """Texts to messages: for each block of texts one per fragment, and one with its list of documents."""

    def flush(block: int, ids: list, sets: list, row: list, digests: list):
        size = np.array([len(s) for s in sets], dtype=np.int64)
        token = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), size)
        # N-grams that several sets of the block have go out once, with their number.
        along = np.argsort(token, kind="stable")
        in_order = token[along]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(token)), bool), in_order[1:] != in_order[:-1])))
        sets_of = np.diff(np.append(first, len(token)))
        several = sets_of > 1
        many, many_sets = in_order[first][several], sets_of[several]
        common = np.zeros(len(token), bool)
        common[along] = np.repeat(several, sets_of)
        named = np.zeros(len(token), np.int32)
        named[along] = np.repeat(np.cumsum(several) - 1, sets_of)
        token, owner = token[~common], owner[~common]
        order = np.argsort(_part(token, fragments), kind="stable")
        bounds = np.searchsorted(_part(token[order], fragments), np.arange(fragments + 1))
        many_bounds = np.searchsorted(_part(many, fragments), np.arange(fragments + 1))
        tags = np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, 2)[:, 0] if digests else np.zeros(0, np.uint64)
        out = [(-1 - block, -1, [np.array(ids, np.int64).tobytes(), np.array(row, np.int32).tobytes(), size.tobytes(), b"".join(digests), np.packbits(common).tobytes(), named[common].tobytes()])]
        for f in range(fragments):
            take = order[bounds[f] : bounds[f + 1]]
            also = slice(many_bounds[f], many_bounds[f + 1])
            if len(take) or also.stop > also.start:
                who, count = np.unique(owner[take], return_counts=True)
                out.append((f, f, [who.astype(np.int32).tobytes(), count.astype(np.int32).tobytes(), tags[who].tobytes(), token[take].astype(np.uint32).tobytes(), many[also].astype(np.uint32).tobytes(), many_sets[also].astype(np.int32).tobytes()]))
        for i in range(0, len(out), 64):
            rows = out[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([block] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.binary()))], schema=_MESSAGE)

    def run(batches):
        block = TaskContext.get().partitionId() << 24
        ids, sets, row, digests, seen, held = [], [], [], [], {}, 0
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for doc, s in zip(names, _sets(batch.column("text"), width), strict=True):
                digest = _digest(s)
                k = seen.get(digest)
                if k is None:
                    k = seen[digest] = len(sets)
                    sets.append(s)
                    digests.append(digest)
                    held += len(s)
                ids.append(doc)
                row.append(k)
                if held >= BLOCK:
                    yield from flush(block, ids, sets, row, digests)
                    block += 1
                    ids, sets, row, digests, seen, held = [], [], [], [], {}, 0
        if ids:
            yield from flush(block, ids, sets, row, digests)

    return run


def _rarity(table: pa.Table) -> pa.Table:
    """One fragment: the rarity class of every n-gram occurrence, 0 if only one set has it, else 1 + 4 log2(sets)."""
    part = table.column("part")[0].as_py()
    if part < 0:
        return table
    body = table.column("body").to_pylist()
    low = np.concatenate([np.frombuffer(b[3], np.uint32) for b in body])
    tags = np.concatenate([np.frombuffer(b[2], np.uint64) for b in body])
    count = np.concatenate([np.frombuffer(b[1], np.int32) for b in body])
    tag = np.repeat(np.unique(tags, return_inverse=True)[1].astype(np.uint64), count)
    many = np.concatenate([np.frombuffer(b[4], np.uint32) for b in body])
    many_sets = np.concatenate([np.frombuffer(b[5], np.int32) for b in body])
    pairs = np.unique((low.astype(np.uint64) << np.uint64(32)) | tag)
    token, sets = np.unique((pairs >> np.uint64(32)).astype(np.uint32), return_counts=True)
    token, back = np.unique(np.concatenate((token, many)), return_inverse=True)
    sets = np.bincount(back, weights=np.concatenate((sets, many_sets)), minlength=len(token))
    shared = sets > 1
    token, level = token[shared], np.minimum(255, 1 + 4 * np.log2(sets[shared])).astype(np.uint8)

    def classes(tokens: np.ndarray) -> np.ndarray:
        if not len(token):
            return np.zeros(len(tokens), np.uint8)
        at = np.minimum(np.searchsorted(token, tokens), len(token) - 1)
        return np.where(token[at] == tokens, level[at], np.uint8(0))

    body = [[b[0], b[1], classes(np.frombuffer(b[3], np.uint32)).tobytes(), classes(np.frombuffer(b[4], np.uint32)).tobytes()] for b in body]
    return pa.Table.from_arrays([table.column("block"), table.column("block"), table.column("part"), pa.array(body, pa.list_(pa.binary()))], schema=_MESSAGE)


def _gathered(percent: int):
    """One block: its fragments' classes summed per document; documents that can still link keep the classes."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("part").to_pylist(), table.column("body").to_pylist(), strict=True), key=lambda r: r[0])
        ids, row, size, digests, common, named = rows[0][1]
        row, size = np.frombuffer(row, np.int32), np.frombuffer(size, np.int64)
        start = np.concatenate(([0], np.cumsum(size)))
        common = np.unpackbits(np.frombuffer(common, np.uint8), count=int(start[-1])).astype(bool)
        seen = np.concatenate(([0], np.cumsum(~common)))[start]
        own, filled = np.zeros(seen[-1], np.uint8), seen[:-1].copy()
        for _, (who, count, classes, _) in rows[1:]:
            who, count = np.frombuffer(who, np.int32), np.frombuffer(count, np.int32)
            first = np.cumsum(count) - count
            own[np.repeat(filled[who] - first, count) + np.arange(count.sum())] = np.frombuffer(classes, np.uint8)
            filled[who] += count
        flat = np.zeros(start[-1], np.uint8)
        flat[~common] = own
        flat[common] = np.frombuffer(b"".join([many for _, (_, _, _, many) in rows[1:]]), np.uint8)[np.frombuffer(named, np.int32)]
        shared = np.concatenate(([0], np.cumsum(flat > 0)))
        shared = shared[start[1:]] - shared[start[:-1]]
        able = (100 * shared >= percent * size) & (size > 0)
        rarity = [flat[start[k] : start[k + 1]].tobytes() if able[k] else None for k in range(len(size))]
        digest = [digests[16 * k : 16 * k + 16] for k in range(len(size))]
        return pa.Table.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pa.array(size[row]), pa.array([digest[k] for k in row], pa.binary()), pa.array([rarity[k] for k in row], pa.binary())], schema=_SET)

    return run


_LED = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("skip", pa.int64()), ("lead", pa.list_(pa.int64())), ("parts", pa.list_(pa.list_(pa.int64())))])
_LED_DDL = "node long, n long, skip long, lead array<long>, parts array<array<long>>"


def _led(width: int, percent: int):
    """Prefix in rare-first order, without its `skip` n-grams that no other set has, and the set cut into fragments."""

    def run(batches):
        for batch in (whole.slice(lo, 1024) for whole in batches for lo in range(0, whole.num_rows, 1024)):
            out = ([], [], [], [], [])
            rest = zip(batch.column("digest").to_pylist(), batch.column("rarity").to_pylist(), strict=True)
            for (digest, rarity), s in zip(rest, _sets(batch.column("text"), width), strict=True):
                if _digest(s) != digest:  # another text under the same id
                    continue
                n = len(s)
                level = np.frombuffer(rarity, np.uint8)
                prefix = n - -(-percent * n // 100) + 1
                order = np.lexsort((s, level))[:prefix]
                skip = int((level[order] == 0).sum())
                cuts = np.searchsorted(s >> np.uint64(61), np.arange(1, PARTS, dtype=np.uint64))
                signed = s.view(np.int64)
                for column, value in zip(out, (node_of(digest), n, skip, signed[order[skip:]], np.split(signed, cuts)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _LED, strict=True)], schema=_LED)

    return run


def _links(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose Jaccard similarity reaches the threshold."""
    left = parts.select(F.col("node").alias("a"), F.col("n").alias("n_a"), "part", F.col("tokens").alias("tokens_a"))
    right = parts.select(F.col("node").alias("b"), F.col("n").alias("n_b"), "part", F.col("tokens").alias("tokens_b"))
    partial = pairs.join(left, "a").join(right, ["b", "part"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("tokens_a", "tokens_b")).alias("common"))
    total = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("common"))
    return total.where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def ngram_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Two documents link when 100 * intersection >= percent * union of their
    sets of distinct `width`-word n-grams; component_id is the smallest doc_id
    that links reach, the document itself included.  Texts are lower-cased
    (A-Z) and split at ASCII white space; a text of fewer words is one n-gram.
    Null and wordless texts have the empty set and stay alone.  Rows that
    repeat a document link with each other; texts that share a doc_id link as
    their own words do, each row with the result of its text.  A null doc_id
    stays alone with a null component; an empty table gives no rows.  Other
    columns of docs are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    letters = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    fragments = max(1, -(-letters // (5 * FRAGMENT)))
    named = docs.where("doc_id is not null")
    dealt = named.mapInArrow(kernel.tidy(_dealt(width, fragments)), _MESSAGE_DDL)
    sets = dealt.groupBy("key").applyInArrow(kernel.tidy_group(_rarity), _MESSAGE_DDL).groupBy("block").applyInArrow(kernel.tidy_group(_gathered(percent)), _SET_DDL)
    sets = cut(sets)

    firsts = sets.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"))
    able = sets.where("rarity is not null").join(firsts, "digest").where("doc_id = first").select("doc_id", "digest", "rarity").dropDuplicates(["digest"])
    # A text whose digest is another, under the same id, is passed over.
    led = cut(named.join(able, "doc_id").mapInArrow(kernel.tidy(_led(width, percent)), _LED_DDL).dropDuplicates(["node"]))
    parts = led.select("node", "n", F.posexplode("parts").alias("part", "tokens")).where(F.size("tokens") > 0)
    meets = led.select("node", "n", "skip", F.posexplode("lead").alias("pos", "token")).select("token", "node", "n", (F.col("skip") + F.col("pos")).alias("pos"))

    def bounded(a: str, b: str):
        """The overlap that is still possible, and the sizes, allow the threshold."""
        most = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
        return (100 + percent) * most >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n"))

    hubs = meets.groupBy("token").agg(F.min(F.struct((F.col("pos") / F.col("n")).alias("rarer"), "node", "n", "pos")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    hubs = hubs.select("token", F.col("hub.node").alias("node"), F.col("hub.n").alias("n"), F.col("hub.pos").alias("pos"))
    hubs = hubs.select("token", *[F.col(c).alias(f"hub_{c}") for c in ("node", "n", "pos")])
    x = met(meets, hubs, "token", "node").where("node <> hub_node")
    most = F.least(F.col("n") - F.col("pos"), F.col("hub_n") - F.col("hub_pos"))
    stars = x.where((100 + percent) * most >= percent * (F.col("n") + F.col("hub_n")))
    stars = stars.select(F.greatest("node", "hub_node").alias("a"), F.least("node", "hub_node").alias("b")).distinct()
    links = cut(_links(stars, parts, percent))
    found = connected_components(links, "a", "b")

    placed = meets.join(found, "node", "left").select("token", "node", "n", "pos", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    placed = cut(met(placed, mixed, "token", "node"))
    kinds = placed.select("token", "n", "pos", "component").distinct()
    # The kinds of a frequent n-gram are split, and each part meets all of them in a task of its own.
    blocks = kinds.groupBy("token").agg(F.ceil(F.count("*") / KINDS).cast("int").alias("blocks"))
    kinds = kinds.join(blocks, "token")
    x = kinds.withColumn("block", F.pmod(F.xxhash64("n", "pos", "component"), F.col("blocks")).cast("int")).alias("x")
    y = kinds.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    across = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.component") < F.col("y.component")) & bounded("x", "y"))
    across = across.select(F.col("x.token").alias("token"), *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "xy" for c in ("n", "pos", "component")))
    for side in "xy":
        own = placed.select("token", *(F.col(c).alias(f"{c}_{side}") for c in ("n", "pos", "component", "node")))
        across = across.join(own, ["token", f"n_{side}", f"pos_{side}", f"component_{side}"])
    rest = across.select(F.greatest("node_x", "node_y").alias("a"), F.least("node_x", "node_y").alias("b")).distinct()
    more = cut(_links(rest, parts, percent))
    if not more.isEmpty():
        found = connected_components(links.unionAll(more), "a", "b")

    # A third of all rows may share one set: rows go to their set's component by a join that can be split.
    keyed = firsts.mapInArrow(_named, "digest binary, first long, node long").join(found, "node", "left").select("digest", "first", F.coalesce("component", "node").alias("component"))
    homes = keyed.join(keyed.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("digest", "component_id")
    out = sets.join(homes, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = docs.where("doc_id is null")
    if not nameless.isEmpty():
        lonely = nameless.mapInArrow(_sizes(width), "doc_id long, n_shingles long, component_id long")
        out = out.unionAll(lonely)
    return out


def _named(batches):
    for batch in batches:
        nodes = pa.array([node_of(d) for d in batch.column("digest").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, nodes], names=["digest", "first", "node"])


def _sizes(width: int):
    def run(batches):
        for batch in batches:
            size = [len(s) for s in _sets(batch.column("text"), width)]
            nothing = pa.nulls(len(size), pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, pa.array(size, pa.int64()), nothing], names=["doc_id", "n_shingles", "component_id"])

    return run


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: that of its smallest doc_id.

    Rows with a null doc_id stay; of rows that repeat a doc_id one stays.
    Columns are as they were.
    """
    keep = cut(ngram_components(docs, width, percent).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")))
    left = docs.join(keep.select(F.col("doc_id").alias("_kept")), docs["doc_id"] == F.col("_kept"), "left_semi")
    if not keep.where("rows > 1").isEmpty():  # repeated rows of one document: the first by hash of all it holds
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns)))
        left = left.withColumn("_place", place).where("_place = 1").drop("_place")
    return left.unionByName(docs.where("doc_id is null"))
