"""Quality rules with the perplexity of an n-gram model.

The model is a modified Kneser-Ney model of order 5 over the bytes of the words,
with one space between them, A-Z lower-cased; the language stands before every
n-gram, so each language has a model of its own with common discounts.  Spark
counts all texts and estimates the model by joins over its levels.  What is
kept of it are sorted arrays of n-grams, packed into 64 bits so that they are
their own hash without collisions, with the log-probability of their last byte:
all texts have been counted, so no n-gram of theirs is missing.

The most frequent n-grams, FREQUENT at most, go to everyone.  The others stay in
parts of a table.  One pass over the texts finds what the rules count, adds up
the frequent n-grams and sends the rare ones, with the text that has them, to
their parts, which send back sums; the texts themselves are never shuffled.

Each language's band lies around the middle of its documents' mean
log-probabilities, whose distribution is counted in bins of a thousandth.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel, ppm
from .components import met
from .kernel import pieces
from .session import cut

ORDER = 5
#: Symbols that UTF-8 never uses: what stands before a text, and what ends it.
PAD, END = ppm.PAD, ppm.END
#: Symbols that can be predicted: bytes below END, and END.
SYMBOLS = 255
#: n-grams that everyone gets: those that are more than this part of all symbols, so no more than this many.
FREQUENT = 1 << 21
#: n-grams of a part of the table, and letters whose rare n-grams meet a part at a time.
PART, LETTERS = 1 << 20, 160_000_000
#: Letters of a block, the unit in which texts ask and are told.
BLOCK = 8_000_000
#: Different n-grams that a task holds before it hands them on.
HELD = 1 << 21
#: What the contract's rules count, and their limits.
MARKS = b"#*$%&|<>"
LEAST_WORDS, REPEATED_PERCENT, WINDOW = 50, 50, 3
#: A document is kept from so many interquartile ranges below its language's lower quartile to so many above the upper one; a range is LEAST_RANGE (log10 a symbol) at least.
BELOW, ABOVE, LEAST_RANGE = 5.0, 3.0, 0.01
#: Bins of a unit of log10.
BINS = 1000
#: Languages up to which their bands are broadcast.
LANGUAGES = 10_000

U8 = np.uint64(8)
_LANG = 40  # bits below the language's


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text with one space between them, A-Z lower-cased."""
    gap = kernel.IS_SPACE[data]
    keep = ~gap
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[:-1]] = True
    begins = keep.copy()  # the first letter of each word but a text's first
    begins[1:] &= gap[:-1] | edge[1:-1]
    starts = np.flatnonzero(begins)
    owner = np.searchsorted(offsets, starts, side="right")
    later = starts[np.flatnonzero(owner[1:] == owner[:-1]) + 1]
    keep[later - 1] = True
    out = np.where(gap, np.uint8(0x20), kernel.LOWER[data])[keep]
    return out, np.concatenate(([0], np.cumsum(keep)))[offsets]


def grams(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """Each symbol of each text behind the ORDER - 1 symbols before it and the language, as one number."""
    n, lead = len(offsets) - 1, ORDER - 1
    size = np.diff(offsets)
    line = np.full(len(data) + n * (lead + 1), PAD, np.uint8)
    starts = offsets[:-1] + np.arange(n) * (lead + 1) + lead
    keep = np.ones(len(line), bool)
    for k in range(1, lead + 1):
        keep[starts - k] = False
    line[starts + size] = END
    body = keep.copy()
    body[starts + size] = False
    line[body] = data
    key = np.zeros(len(line), np.uint64)
    for k in range(lead, -1, -1):
        key <<= U8
        key[k:] |= line[: len(line) - k]
    return key[keep] | np.repeat(langs.astype(np.uint64) << np.uint64(_LANG), size + 1)


def _counted(batches):
    """Texts to (key, n) rows, added up as far as a task holds them."""
    held: tuple[list, list] = ([], [])

    def flush():
        key, count = ppm.merge(*held)
        held[0].clear()
        held[1].clear()
        for lo in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + (1 << 16)].view(np.int64)), pa.array(count[lo : lo + (1 << 16)], pa.int64())], names=["key", "n"])

    for batch in batches:
        langs = batch.column("code").to_numpy()
        for a, b, data, offsets in pieces(batch.column("text")):
            for column, part in zip(held, ppm.tally(grams(*spaced(data, offsets), langs[a:b])), strict=True):
                column.append(part)
            if sum(map(len, held[0])) > HELD:
                key, count = ppm.merge(*held)
                held[0][:], held[1][:] = [key], [count]
                if len(key) > HELD // 2:
                    yield from flush()
    yield from flush()


def _suffix(order: int):
    """The key without what stands before its last `order` symbols."""
    return F.col("key").bitwiseAND(F.lit(-(1 << _LANG) | ((1 << (8 * order)) - 1)))


def discounts(levels: list[DataFrame]) -> list[tuple[float, float, float]]:
    """What is taken from counts of one, two, and more, for each level; where the estimate has no ground, a half, one, and one and a half."""
    few = None
    for i, level in enumerate(levels):
        rows = level.where("n <= 4").groupBy(F.lit(i).alias("level"), "n").agg(F.count("*").alias("many"))
        few = rows if few is None else few.unionAll(rows)
    known = {(r["level"], r["n"]): r["many"] for r in few.collect()}  # at most four rows a level
    out = []
    for level in range(len(levels)):
        n1, n2, n3, n4 = (known.get((level, i), 0) for i in (1, 2, 3, 4))
        if n1 and n2 and n3:
            y = n1 / (n1 + 2 * n2)
            found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        else:
            found = (0.0, 0.0, 0.0)
        out.append(tuple(d if 0 < d < i + 1 else (i + 1) / 2 for i, d in enumerate(found)))
    return out


def estimated(counts: DataFrame) -> DataFrame:
    """(key, n, value): log10 of the probability of the last symbol of each n-gram of counts (key, n).

    Lower levels count in how many different n-grams one symbol longer an
    n-gram is the end.  No context has more than 256 followers and no n-gram
    more than 256 predecessors, so no key is hot.
    """
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = cut(levels[k + 1].groupBy(_suffix(k).alias("key")).agg(F.count("*").alias("n")))
    taken = dict(zip(range(1, ORDER + 1), discounts([levels[k] for k in range(1, ORDER + 1)]), strict=True))
    lower = None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = taken[k]
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        rows = levels[k].withColumns({"context": F.col("key").bitwiseAND(F.lit(~0xFF)), "off": off, "suffix": _suffix(k - 1)})
        of = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("off").alias("left"))
        rows = rows.join(of, "context")
        if lower is None:
            below = F.lit(1.0 / SYMBOLS)
        else:
            rows, below = rows.join(lower, "suffix"), F.col("below")
        p = (F.col("n") - F.col("off") + F.col("left") * below) / F.col("total")
        rows = rows.select("key", "n", p.alias("p"))
        lower = rows.select(F.col("key").alias("suffix"), F.col("p").alias("below"))
    return rows.select("key", "n", F.log10("p").cast("float").alias("value"))


def _distinct_in(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys within their owners, and whether each, in that order, is the first of its kind."""
    own = kernel.mix(keys ^ kernel.mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    own = own[order]
    first = np.ones(len(own), bool)
    first[1:] = own[1:] != own[:-1]
    return order, first


_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True
_CLASSES = np.zeros((2, 256), bool)
_CLASSES[0] = ~kernel.IS_SPACE & ((np.arange(256) & 0xC0) != 0x80)  # first bytes of characters
_CLASSES[1, list(MARKS)] = True


def counted_rules(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """What the rules count in each text."""
    n = len(offsets) - 1
    words, starts = kernel.placed_words(data, offsets, case=kernel.AS_IS)
    sizes = np.diff(np.searchsorted(starts, offsets, side="left"))
    chars, marks = kernel.class_counts(data, offsets, _CLASSES)
    owner = np.repeat(np.arange(n), sizes)

    lines, begins = kernel.placed_words(data, offsets, _NEWLINE, kernel.AS_IS)
    breaks = np.append(np.flatnonzero(data == 0x0A), len(data))
    of = np.searchsorted(offsets, begins, side="right") - 1
    ends = np.minimum(breaks[np.searchsorted(breaks, begins)], offsets[of + 1])
    word = np.searchsorted(starts, begins)
    worded = np.append(starts, len(data))[word] < ends
    order, first = _distinct_in(lines[worded], of[worded])
    again = np.bincount(of[worded][order[~first]], minlength=n)

    repeated = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(owner[: len(words) - WINDOW + 1] == owner[WINDOW - 1 :]) if len(words) >= WINDOW else np.zeros(0, np.int64)
    if len(at):
        order, first = _distinct_in(kernel.shingle_hashes(words, WINDOW)[at], owner[at])
        alone = first & np.append(first[1:], True)
        twice = at[order[~alone]]
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + WINDOW, -1)
    covered = np.cumsum(repeated[:-1]) > 0
    return {"n_words": sizes, "word_chars": chars, "n_symbols": marks, "n_dup_lines": again, "n_repeat_words": np.bincount(owner[covered], minlength=n)}


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_BASE = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *[(c, pa.int64()) for c in _COUNTS], ("symbols", pa.int64()), ("total", pa.float64())])
_BASE_DDL = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", symbols long, total double"
_SENT = pa.schema([("part", pa.int32()), ("salt", pa.int32()), ("block", pa.int64()), ("rows", pa.binary()), ("keys", pa.binary())])
_SENT_DDL = "part int, salt int, block long, rows binary, keys binary"
#: The part under which a block's own rows travel.
_OWN = -1


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((kernel.mix(keys + np.uint64(77)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _met(shared, parts: int, salts: int):
    """Texts to blocks: what is known of their texts, and the rare n-grams with the number of their text in the block."""

    def run(batches):
        from pyspark import TaskContext

        known, values = shared.value
        block = TaskContext.get().partitionId() << 32
        own: list[pa.RecordBatch] = []
        rare: tuple[list, list] = ([], [])
        letters = texts = 0

        def flush():
            salt = int(kernel.mix(np.array([block], np.uint64))[0] % np.uint64(salts))
            yield pa.RecordBatch.from_arrays([pa.array([_OWN], pa.int32()), pa.array([salt], pa.int32()), pa.array([block]), pa.array([_ipc(pa.Table.from_batches(own))], pa.binary()), pa.array([b""], pa.binary())], schema=_SENT)
            keys, rows = np.concatenate(rare[0]), np.concatenate(rare[1])
            order = np.argsort(keys, kind="stable")
            keys, rows = keys[order], rows[order]
            part = _part_of(keys, parts)
            for p in np.unique(part).tolist():
                mine = part == p
                # Sorted keys as differences, which compress well.
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([salt], pa.int32()), pa.array([block]), pa.array([rows[mine].tobytes()], pa.binary()), pa.array([np.diff(keys[mine], prepend=np.uint64(0)).tobytes()], pa.binary())], schema=_SENT)

        for batch in batches:
            codes = batch.column("code").to_numpy()
            for a, b, data, offsets in pieces(batch.column("text")):
                line, bounds = spaced(data, offsets)
                keys = grams(line, bounds, codes[a:b])
                order = np.argsort(keys)
                keys = keys[order]
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
                kind, times = keys[first], np.diff(np.append(first, len(keys)))
                at = np.minimum(np.searchsorted(known, kind), max(len(known) - 1, 0))
                hit = known[at] == kind if len(known) else np.zeros(len(kind), bool)
                step = np.empty(len(keys))
                step[order] = np.repeat(np.where(hit, values[at], 0.0) if len(known) else np.zeros(len(kind)), times)
                size = np.diff(bounds) + 1
                total = np.add.reduceat(step, np.cumsum(size) - size)
                rules = counted_rules(data, offsets)
                own.append(pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("lang").slice(a, b - a), *[pa.array(rules[c].astype(np.int64)) for c in _COUNTS], pa.array(size), pa.array(total)], schema=_BASE))
                missed = ~np.repeat(hit, times)
                rare[0].append(keys[missed])
                rare[1].append((texts + np.searchsorted(np.cumsum(size), order[missed], side="right")).astype(np.int32))
                letters += len(data) + 64 * (b - a)
                texts += b - a
                if letters > BLOCK:
                    yield from flush()
                    block += 1
                    own, rare, letters, texts = [], ([], []), 0, 0
        if own:
            yield from flush()

    return run


def _told(sent: pa.Table, model: pa.Table) -> pa.Table:
    """A block's own rows as they are; for rare n-grams the sum for each text of the block."""
    rows, keys = sent.column("rows").to_pylist(), sent.column("keys").to_pylist()
    if sent.num_rows and sent.column("part")[0].as_py() != _OWN:
        known = np.concatenate([np.frombuffer(k, np.uint64) for k in model.column("keys").to_pylist()])
        value = np.concatenate([np.frombuffer(v, np.float32) for v in model.column("values").to_pylist()])
        for i, (of, asked) in enumerate(zip(rows, keys, strict=True)):
            at = np.searchsorted(known, np.cumsum(np.frombuffer(asked, np.uint64), dtype=np.uint64))
            rows[i] = np.bincount(np.frombuffer(of, np.int32), weights=value[at].astype(np.float64)).tobytes()
    return pa.table({"part": sent.column("part"), "block": sent.column("block"), "rows": pa.array(rows, pa.binary())})


def _summed(told: pa.Table) -> pa.Table:
    """One block: its own rows with the sums of its rare n-grams."""
    parts, bodies = told.column("part").to_pylist(), told.column("rows").to_pylist()
    own = pa.ipc.open_stream(bodies[parts.index(_OWN)]).read_all()
    total = own.column("total").to_numpy().copy()
    for part, body in sorted(zip(parts, bodies, strict=True)):
        if part != _OWN:
            more = np.frombuffer(body, np.float64)
            total[: len(more)] += more
    return own.set_column(own.schema.get_field_index("total"), "total", pa.array(total))


def _packed(table: pa.Table) -> pa.Table:
    """One part of the model as two sorted arrays."""
    keys, values = table.column("key").to_numpy().view(np.uint64), table.column("value").to_numpy().astype(np.float32)
    order = np.argsort(keys)
    return pa.table({"part": pa.array(table.column("part").to_numpy()[:1], pa.int32()), "keys": pa.array([keys[order].tobytes()], pa.binary()), "values": pa.array([values[order].tobytes()], pa.binary())})


def perplexities(docs: DataFrame, stable: bool = False) -> DataFrame:
    """(doc_id, lang, what the rules count, symbols, total): total is log10 of the model's probability of a document's symbols.

    docs is scanned twice and must give its rows in the same partitions each
    time: stable says that it does, as a table; else it is checkpointed first.
    """
    spark = docs.sparkSession
    lang = F.col("lang").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.alias("lang"), F.coalesce(F.crc32(lang), F.lit(0)).bitwiseAND(0xFFFFFF).alias("code"))
    rows = rows if stable else cut(rows)
    counts = cut(rows.select("text", "code").mapInArrow(kernel.tidy(_counted), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    model = cut(estimated(counts))
    size = model.agg(F.sum("n").alias("symbols"), F.count("*").alias("different")).first()
    symbols, different = size["symbols"] or 0, size["different"]
    often = F.col("n") > symbols / FREQUENT
    frequent = model.where(often).select("key", "value").toArrow()  # FREQUENT rows at most, of twelve bytes
    keys, values = frequent.column("key").to_numpy().view(np.uint64), frequent.column("value").to_numpy().astype(np.float32)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], values[order]))
    parts = max(1, -(-(different - len(keys)) // PART))
    salts = max(1, -(-symbols // (LETTERS * parts)))  # as many questions for each copy of a part, however many parts there are

    def dealt(batches):
        for batch in batches:
            part = _part_of(batch.column("key").to_numpy().view(np.uint64), parts)
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column("key"), batch.column("value")], names=["part", "key", "value"])

    arrays = model.where(~often).select("key", "value").mapInArrow(kernel.tidy(dealt), "part int, key long, value float").groupBy("part").applyInArrow(kernel.tidy_group(_packed), "part int, keys binary, values binary")
    arrays = cut(arrays).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    sent = rows.mapInArrow(kernel.tidy(_met(shared, parts, salts)), _SENT_DDL)
    told = sent.groupBy("part", "salt").cogroup(arrays.groupBy("part", "salt")).applyInArrow(kernel.tidy_pair(_told), "part int, block long, rows binary")
    return told.groupBy("block").applyInArrow(kernel.tidy_group(_summed), _BASE_DDL)


def bands(found: DataFrame) -> DataFrame:
    """(lang, low, high): the band of `mean` of each language's documents."""
    binned = found.groupBy("lang", F.floor(F.col("mean") * BINS).alias("bin")).agg(F.count("*").alias("n"))
    # A few thousand bins a language at most.
    by = Window.partitionBy("lang").orderBy("bin")
    so_far = binned.withColumns({"upto": F.sum("n").over(by), "all": F.sum("n").over(Window.partitionBy("lang"))})
    quartile = [F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("bin"))).alias(f"q{q}") for q in (1, 3)]
    at = so_far.groupBy("lang").agg(*quartile)
    wide = F.greatest((F.col("q3") - F.col("q1")) / BINS, F.lit(LEAST_RANGE))
    return at.select(F.col("lang").alias("_lang"), (F.col("q1") / BINS - BELOW * wide).alias("low"), ((F.col("q3") + 1) / BINS + ABOVE * wide).alias("high"))


def judged(docs: DataFrame, stable: bool = False) -> DataFrame:
    """A row for every row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, perplexity, kept.

    Words are what white space of ASCII parts; case counts.  base_failed: under
    50 words, or over half of them in windows of three words that stand in the
    text twice or more.  perplexity is that of a symbol; a document that
    passes is kept if its mean log-probability lies within the band of its
    language, which is learned from all documents that pass.  Documents without
    a language are one of their own.

    A null text has no words and fails, as an empty one does; a text of any
    length is looked at whole, by one task.  Rows that repeat a document count,
    and are judged, as often as they stand there; an empty table gives no rows.
    Columns other than doc_id, text and lang are not looked at.
    """
    mean = -F.col("total") / F.col("symbols")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    found = cut(perplexities(docs, stable).withColumns({"mean": mean, "base_failed": failed, "lang": F.coalesce("lang", F.lit(""))}))
    band = cut(bands(found.where("NOT base_failed")))
    if band.count() <= LANGUAGES:
        rows = found.join(F.broadcast(band), F.col("lang") == F.col("_lang"), "left")
    else:
        rows = met(found, band.withColumnRenamed("_lang", "lang"), "lang", "doc_id", "left")
    kept = ~F.col("base_failed") & F.coalesce((F.col("mean") >= F.col("low")) & (F.col("mean") <= F.col("high")), F.lit(False))
    return rows.select("doc_id", *_COUNTS, "base_failed", F.pow(F.lit(10.0), F.col("mean")).alias("perplexity"), kept.alias("kept"))
