"""URL filtering by a sorted array of 64-bit digests.

The entries of a blocklist (host and path prefixes) are hashed with xxhash64
and sorted by Spark, and packed into one block of bytes: digests, offsets and
strings.  It is broadcast, and each executor maps one copy into the memory of
all its workers.  Every url probes its own host suffixes and path prefixes by
vectorised binary search, and a hit counts only if the stored string is equal.
Rules take precedence over the list.  A list beyond the size that is broadcast
is joined instead.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel

#: Entries of a list, and bytes of their strings, up to which it is broadcast.
ENTRIES, BYTES = 16_000_000, 512 << 20
#: Fixed value: the seed of Spark's xxhash64.
SEED = 42
#: (host, path) of the rules, with their verdicts; the longest that fits wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Hosts (with their subdomains) that the list blocks.
BLOCKED = (
    "ads-track.example.com",
    "adult-x.example.net",
    "casino-win.example.com",
    "cheap-pills.example.com",
    "free-bets.example.com",
    "spam-farm.example.com",
)


def entry(host: str, path: str) -> str:
    """How a host and a path prefix (with its leading slash) are written in lists."""
    return host + path


def packed(entries: DataFrame) -> bytes:
    """entries(entry) as bytes: how many, the digests in order, where each string ends, the strings; of a list within the bounds."""
    keyed = entries.where("entry is not null").distinct().select(F.xxhash64("entry").alias("key"), "entry").orderBy("key", "entry").toArrow()
    # Straight from Arrow's buffers: no string is made on the driver.
    text, ends = kernel.text_bytes(keyed.column("entry"))
    keys = np.ascontiguousarray(keyed.column("key").to_numpy(), "<i8")
    return b"".join([len(keys).to_bytes(8, "little"), keys.data, np.ascontiguousarray(ends[1:], "<i8").data, np.ascontiguousarray(text).data])


class DigestArray:
    """A list of strings that answers which of many strings it holds."""

    def __init__(self, block: np.ndarray):
        n = int(block[:8].view("<u8")[0])
        self.keys = block[8 : 8 + 8 * n].view("<i8")
        self.ends = block[8 + 8 * n : 8 + 16 * n].view("<i8")
        self.text = block[8 + 16 * n :]

    @classmethod
    def mapped(cls, name: str, shared) -> DigestArray:
        """The array of a broadcast block, mapped from a file in the folder that Spark gives an executor.

        The first worker that looks writes it; a new executor writes its own.
        """
        path = os.path.join(SparkFiles.getRootDirectory(), name)
        if not os.path.exists(path):
            own = f"{path}-{uuid.uuid4().hex}"
            with open(own, "wb") as f:
                f.write(shared.value)
            os.replace(own, path)
        return cls(np.memmap(path, np.uint8, "r"))

    def holds(self, strings: list[str]) -> np.ndarray:
        raw = [s.encode() for s in strings]
        found = np.zeros(len(raw), dtype=bool)
        if not len(self.keys):
            return found
        probe = np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in raw), np.uint64, len(raw)).view(np.int64)
        at = np.searchsorted(self.keys, probe)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == probe):
            k = at[i]
            while k < len(self.keys) and self.keys[k] == probe[i]:  # equal digests stand together
                found[i] |= self.text[self.ends[k - 1] if k else 0 : self.ends[k]].tobytes() == raw[i]
                k += 1
        return found


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without `://`."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


def _suffixes(host: str, longest: int):
    """The host and its parent domains, of at most `longest` characters."""
    if len(host) > longest:
        cut = host.find(".", len(host) - longest - 1)
        host = host[cut + 1 :] if cut >= 0 else ""
    while host:
        yield host
        host = host.partition(".")[2]


def _prefixes(path: str, longest: int):
    """Prefixes of a path that end in a slash, and the path itself, of at most `longest` characters."""
    short = path[:longest]
    for i, c in enumerate(short):
        if c == "/":
            yield path[: i + 1]
    if 0 < len(path) <= longest and not path.endswith("/"):
        yield path


def _probes(host: str, path: str, host_size: int, path_size: int):
    """The entries that would fit a url, and whether a rule written so would."""
    for h in _suffixes(host, host_size):
        for p in _prefixes(path, path_size):
            yield entry(h, p), True
        if not path.startswith("/"):
            yield entry(h, "/"), False  # an empty path fits host entries of the list, but starts with no rule's path


def filtered(spark: SparkSession, pages: DataFrame, blocked=BLOCKED, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every row of pages.

    blocked is a DataFrame of (host, path), of any size, or a short list of
    hosts.  A rule or entry fits its host and all subdomains, if the path
    starts with its own, which ends in a slash.  Of rules that fit the longest
    wins; of two verdicts of one rule, the last given.  listed tells whether the
    list holds a host suffix with a path prefix of the url.  Null or malformed
    urls have empty host and path, no rule, and are allowed.  Repeated rows and
    null page_ids get a row each, an empty table gives none.  Other columns are
    not looked at.
    """
    if not isinstance(blocked, DataFrame):
        blocked = spark.createDataFrame([(h, "/") for h in blocked], "host string, path string")
    entries = blocked.where("host is not null and path is not null").select(F.concat("host", "path").alias("entry"), "host", "path")
    size = entries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("entry")), F.lit(0)).alias("bytes"), F.max(F.length("host")).alias("host"), F.max(F.length("path")).alias("path")).first()
    whole = size["n"] <= ENTRIES and size["bytes"] <= BYTES
    rule_list = spark.createDataFrame([(entry(h, p),) for h, p, _ in rules], "entry string")
    context = spark.sparkContext
    # Both arrays are the caller's: a rule names a host and a path prefix just as an entry does.
    names = [f"digests-{uuid.uuid4().hex}" for _ in range(2)]
    shared = [context.broadcast(packed(e)) for e in (entries.select("entry") if whole else rule_list.limit(0), rule_list)]
    host_size, path_size = (max([size[k] or 0, *(len(r[i]) for r in rules)]) for i, k in enumerate(("host", "path")))
    verdicts = {entry(host, path): verdict for host, path, verdict in rules}

    def judged(batches):
        known, ruled = map(DigestArray.mapped, names, shared)
        for batch in batches:
            keys, owner, strict = [], [], []
            for i, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                for key, as_rule in _probes(host, path, host_size, path_size):
                    keys.append(key)
                    owner.append(i)
                    strict.append(as_rule)
            in_list, in_rules = known.holds(keys), ruled.holds(keys) & np.array(strict, bool)
            listed = np.zeros(batch.num_rows, dtype=bool)
            listed[np.array(owner, np.int64)[in_list]] = True
            rule: list[str | None] = [None] * batch.num_rows
            for at in np.flatnonzero(in_rules):
                i, key = owner[at], keys[at]
                if rule[i] is None or len(key) > len(rule[i]):
                    rule[i] = key
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array([verdicts.get(r) for r in rule], pa.string()), pa.array(listed)], names=[*batch.schema.names, "rule", "ruled", "listed"])

    host, path = split_url(F.col("url"))
    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    found = kept.mapInArrow(judged, "page_id long, host string, path string, rule string, ruled string, listed boolean")
    if not whole:
        # Too long a list to send out: the places of the urls meet it in a join.
        def probed(batches):
            for batch in batches:
                rows = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)
                out = [(h, p, key) for h, p in rows for key, _ in _probes(h, p, host_size, path_size)]
                yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in out], pa.string()) for i, n in enumerate(("host", "path", "entry"))})

        probes = kept.select("host", "path").distinct().mapInArrow(probed, "host string, path string, entry string")
        met = probes.join(entries.select("entry"), "entry", "left_semi").select("host", "path").distinct().withColumn("met", F.lit(True))
        found = found.join(met, ["host", "path"], "left").withColumn("listed", F.coalesce("met", F.lit(False)))
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
