"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every text keeps, of each `w` neighbouring k-gram hashes, the least.  Two texts
that share k + w - 1 words share such a fingerprint, so joining the fingerprints
of documents and benchmark items finds every document that shares a span of that
length.  Only narrow rows (a document's keys and one fingerprint) take part in
that join.  In the documents it has found, hits are then extended: the windows
of the document meet those of the items, by 128 bits of hash, and overlapping
windows run together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut

#: Words of a window, and of the k-grams that are hashed.
WINDOW = 13
GRAM = 5
#: Words of items up to which their fingerprints and windows are broadcast (about 60 bytes each); beyond, the joins shuffle.
BROADCAST_ROWS = 500_000
#: Documents with fingerprints of items, up to which their keys are broadcast (about 40 bytes each).
CANDIDATES = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """A-Z lower-cased; maximal runs of a-z, 0-9 and characters beyond ASCII.  Null has none."""
    plain = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(F.coalesce(plain, F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def grams(tokens: Column, k: int, *seed: Column) -> Column:
    """Hash of the k-gram at each position that has one."""
    return F.transform(
        F.slice(tokens, 1, F.greatest(F.size(tokens) - (k - 1), F.lit(0))),
        lambda word, i: F.xxhash64(*[*seed, word, *(F.get(tokens, i + j) for j in range(1, k))]),
    )


def least(hashes: Column, w: int) -> Column:
    """The distinct minima of every w neighbouring hashes; of fewer, of all there are."""
    if w == 1:
        return F.array_distinct(hashes)
    windows = F.slice(hashes, 1, F.greatest(F.size(hashes) - (w - 1), F.lit(1)))
    return F.array_distinct(F.transform(windows, lambda _, i: F.array_min(F.slice(hashes, i + 1, w))))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs.

    A window is `window` consecutive words of an item, or all words of a
    shorter item; a document word inside any occurrence of a window is hit.
    contaminated: n_hit > 0 and 20 * n_hit >= n_words.  Null and wordless texts
    have no words and no hits, and such items no windows.  Equal rows (doc_id
    and text) get equal results, a row each, also where doc_id is null; texts
    that share an item_id count as one item.  Without items nothing is hit.
    Other columns are not looked at.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("item"))
    items = items.where("item_id is not null and size(item) > 0").distinct().withColumn("span", F.least(F.size("item"), F.lit(window)))
    facts = items.agg(F.coalesce(F.sum(F.size("item")), F.lit(0)).alias("words"), F.collect_set("span").alias("spans")).first()
    spans = sorted(facts["spans"])  # at most `window` numbers
    # A shorter item of n words needs fingerprints that n shared words guarantee: its own k and w.
    families = {n: (min(gram, n), n - min(gram, n) + 1) for n in spans}

    def sized(side: DataFrame) -> DataFrame:
        return F.broadcast(side) if facts["words"] <= BROADCAST_ROWS else side

    def hashed(side: DataFrame, tokens: str) -> DataFrame:
        """With a column of hashes for each k, so that what looks at neighbours computes them once."""
        return side.withColumns({f"_{k}": grams(F.col(tokens), k) for k, _ in families.values()})

    def prints(n: int, k: int, w: int) -> Column:
        return F.transform(least(F.col(f"_{k}"), w), lambda h: F.struct(F.lit(n).alias("span"), h.alias("hash")))

    def windows(n: int, tokens: Column) -> Column:
        return F.transform(F.arrays_zip(grams(tokens, n).alias("a"), grams(tokens, n, F.lit(n)).alias("b")), lambda h, i: F.struct(F.lit(n).alias("span"), i.alias("at"), h["a"].alias("a"), h["b"].alias("b")))

    def own(parts: dict[int, Column]) -> Column:
        """Of an item, what belongs to its own span."""
        return F.concat(*[F.when(F.col("span") == n, part).otherwise(F.slice(part, 1, 0)) for n, part in parts.items()])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text").cast("string")).alias("tokens"))
    narrow = keyed.select("doc_id", "text_key", F.size("tokens").cast("long").alias("n_words"), "tokens")
    if not spans:
        nothing = F.lit(0).cast("long")
        return narrow.select("doc_id", "n_words", nothing.alias("n_hit"), nothing.alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))

    item_prints = hashed(items, "item").select(F.explode(own({n: prints(n, *f) for n, f in families.items()})).alias("p")).select("p.*").distinct().withColumn("met", F.lit(True))
    # The first print of each document is a blank that keeps documents without hits; it meets nothing, and not all of them in one place.
    blank = F.array(F.struct(F.lit(-1).alias("span"), F.col("text_key").alias("hash")))
    probes = hashed(narrow, "tokens").select("doc_id", "text_key", "n_words", F.explode(F.concat(blank, *[prints(n, *f) for n, f in families.items()])).alias("p"))
    probes = probes.select("doc_id", "text_key", "n_words", "p.span", "p.hash")
    found = probes.join(sized(item_prints), ["span", "hash"], "left").where("met or span = -1")
    found = cut(found.groupBy("doc_id", "text_key", "n_words").agg(F.count(F.when(F.col("span") == -1, 1)).alias("copies"), F.coalesce(F.bool_or("met"), F.lit(False)).alias("met")))

    candidates = found.where("met").select(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key"))
    if candidates.count() <= CANDIDATES:
        candidates = F.broadcast(candidates)
    # Texts are cut into words behind this join, so only where it has found something.
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    near = texts.join(candidates, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key")), "left_semi")
    near = near.select("doc_id", "text_key", words(F.col("text")).alias("tokens"))
    near = near.select("doc_id", "text_key", F.explode(F.concat(*[windows(n, F.col("tokens")) for n in spans])).alias("w")).select("doc_id", "text_key", "w.*")
    item_windows = items.select("item_id", F.explode(own({n: windows(n, F.col("item")) for n in spans})).alias("w")).select("item_id", "w.span", "w.a", "w.b").distinct()
    hits = cut(near.join(sized(item_windows), ["span", "a", "b"]).select("doc_id", "text_key", "at", "span", "item_id"))

    key = ["doc_id", "text_key"]
    reach = F.max(F.col("at") + F.col("span")).over(Window.partitionBy(*key).orderBy("at", "span").rowsBetween(Window.unboundedPreceding, -1))
    lengths = hits.select(*key, "at", "span").distinct().withColumn("from", F.greatest(F.col("at"), F.coalesce(reach, F.lit(0))))
    lengths = lengths.groupBy(*key).agg(F.sum(F.greatest(F.col("at") + F.col("span") - F.col("from"), F.lit(0))).cast("long").alias("n_hit"))
    names = hits.select(*key, "item_id").distinct().groupBy(*key).agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    out = found
    for side, p in ((lengths, "l"), (names, "i")):
        side = side.withColumnsRenamed({k: f"{p}_{k}" for k in key})
        out = out.join(side, F.col("doc_id").eqNullSafe(F.col(f"{p}_doc_id")) & (F.col("text_key") == F.col(f"{p}_text_key")), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
