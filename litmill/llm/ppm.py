"""Language-model scores by prediction by partial matching over byte contexts.

The trie of contexts (up to ORDER bytes) is counted over all training texts and
kept as a table of (context and byte, count) rows, which Spark adds up; it is
never gathered in one place.  Its deep levels are split by the last three bytes
of the context, so that a context and all it can fall back to stand together;
the shallow levels, at most 2^24 counts, go to everyone, and so do the
log-probabilities of the most frequent entries, FREQUENT at most.

A block of texts asks each fragment of the trie about those of its distinct
(context, byte) pairs that are not among the frequent ones, and gets their
log-probabilities back: that of the byte in the longest context that has seen
it, times the escapes from the longer ones, where bytes that a longer context
has already ruled out are excluded from the shorter.  Escapes are estimated as
in method D: a context seen t times with q different bytes escapes with q / 2t,
and gives (2n - 1) / 2t to a byte seen n times.  Word counts for the base score
travel the same way.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .kernel import pieces
from .session import cut

ORDER = 5
#: Symbols that UTF-8 never uses: what stands before a text, and what ends it.
PAD, END = 0xFF, 0xFE
#: Symbols that can be predicted: bytes below END, and END.
SYMBOLS = 255
#: Rows of a block, and letters that a fragment is laid out for.
BLOCK_ROWS = 3072
LETTERS = 40_000_000
#: Entries of the trie, and words, that everyone gets; more cannot be as frequent as these must be.
FREQUENT = (1 << 18, 1 << 16)
#: Different entries that a task holds before it hands them on.
HELD = 1 << 22
END_WORD = np.uint64(0x2545F4914F6CDD1D)

U8 = np.uint64(8)


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each symbol of each text, A-Z lower-cased, with the ORDER symbols before it, as one number."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    line = np.full(len(data) + n * (ORDER + 1), PAD, np.uint8)
    starts = offsets[:-1] + np.arange(n) * (ORDER + 1) + ORDER
    keep = np.ones(len(line), dtype=bool)
    for k in range(1, ORDER + 1):
        keep[starts - k] = False
    line[starts + size] = END
    body = keep.copy()
    body[starts + size] = False
    line[body] = kernel.LOWER[data]
    key = np.zeros(len(line), np.uint64)
    for k in range(ORDER, -1, -1):
        key <<= U8
        key[k:] |= line[: len(line) - k]
    return key[keep]


def tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    return key[first], np.add.reduceat(count, first) if len(first) else count


class Lookup:
    """Values of distinct keys, found by a few rounds of hashing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        factor = 0x9E3779B97F4A7C15
        while len(keys):
            bits = max(4, int(np.ceil(np.log2(2.5 * len(keys)))))
            at = (keys * np.uint64(factor)) >> np.uint64(64 - bits)
            slot = np.full(1 << bits, -1, np.int64)
            slot[at] = np.arange(len(keys))
            won = slot[at] == np.arange(len(keys))
            held, value = np.full(1 << bits, ~np.uint64(0)), np.zeros(1 << bits, values.dtype)
            held[at[won]], value[at[won]] = keys[won], values[won]
            self.levels.append((np.uint64(factor), np.uint64(64 - bits), held, value))
            keys, values = keys[~won], values[~won]
            factor = (factor * 0xD1342543DE82EF95 + 2) & 0xFFFFFFFFFFFFFFFF | 1
        self.kind = values.dtype

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), self.kind)
        left = None
        for factor, shift, held, value in self.levels:
            asked = keys if left is None else keys[left]
            at = (asked * factor) >> shift
            hit = held[at] == asked
            if left is None:
                out = np.where(hit, value[at], out)
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] = value[at[hit]]
                left = left[~hit]
            if not len(left):
                break
        return out


class Level:
    """Counts of one context length: of (context, symbol) and of contexts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        context = keys >> U8
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), context[1:] != context[:-1])))
        self.contexts = context[first]
        self.first = first
        self.total = np.add.reduceat(counts, first) if len(first) else counts
        self.different = np.diff(np.append(first, len(keys)))
        self.below_total: np.ndarray | None = None

    def exclude(self, shorter: Level, mask: int) -> None:
        """What the symbols seen in each context count for in the context that is one byte shorter."""
        at = np.searchsorted(shorter.keys, self.keys & np.uint64(mask))
        self.below_total = np.add.reduceat(shorter.counts[at], self.first) if len(self.first) else self.total

    def find(self, contexts: np.ndarray) -> np.ndarray:
        """Index of each context, -1 if it was never seen."""
        if not len(self.contexts):
            return np.full(len(contexts), -1)
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        return np.where(self.contexts[at] == contexts, at, -1)

    def count(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0)


def _mask(order: int) -> int:
    return (1 << (8 * (order + 1))) - 1


def levels(keys: np.ndarray, counts: np.ndarray, top: int, low: list[Level]) -> list[Level]:
    """Levels 0 to top from counts of (top context, symbol); the lowest ones may be given."""
    out: list[Level] = list(low)
    for order in range(len(low), top + 1):
        out.append(Level(*merge([keys & np.uint64(_mask(order))], [counts])))
    for order in range(max(1, len(low)), top + 1):
        out[order].exclude(out[order - 1], _mask(order - 1))
    return out


def log_probability(keys: np.ndarray, trie: list[Level]) -> np.ndarray:
    """log10 of the probability of each symbol in its context."""
    out = np.zeros(len(keys))
    open_ = np.ones(len(keys), dtype=bool)
    child = np.full(len(keys), -1)
    for order in range(len(trie) - 1, -1, -1):
        level = trie[order]
        key = keys & np.uint64(_mask(order))
        at = level.find(key >> U8)
        rows = np.flatnonzero(open_ & (at >= 0))
        if not len(rows):
            continue
        i, c = at[rows], child[rows]
        total, different = level.total[i].astype(float), level.different[i].astype(float)
        if order + 1 < len(trie) and len(trie[order + 1].contexts):
            longer = trie[order + 1]
            total -= np.where(c >= 0, longer.below_total[c], 0)
            different -= np.where(c >= 0, longer.different[c], 0)
        n = level.count(key[rows])
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(n > 0, np.log10((2 * n - 1) / (2 * total)), np.where(total > 0, np.log10(different / (2 * total)), 0.0))
        out[rows] += step
        open_[rows[n > 0]] = False
        child[rows] = i
    unseen = SYMBOLS - (trie[0].different[0] if len(trie[0].contexts) else 0)
    out[open_] -= np.log10(unseen) if unseen else 0.0
    return out


def _fragment(keys: np.ndarray, kind: int, fragments: int) -> np.ndarray:
    """The fragment of each key: of a gram by the last three bytes of its context, of a word by the word."""
    by = (keys >> U8) & np.uint64(0xFFFFFF) if kind == 0 else keys
    return (kernel.mix(by + np.uint64(77)) >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)


_COUNT_DDL = "fragment long, key long, n long"
_ASK = pa.schema([("fragment", pa.int64()), ("block", pa.int64()), ("keys", pa.binary())])
_ASK_DDL = "fragment long, block long, keys binary"
_TELL_DDL = "block long, fragment long, values binary"
_OUT_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_KINDS = (0, 1)  # entries of the trie, words


def _counted(fragments: int):
    """Training texts to (fragment, key, n) rows of trie entries and words, added up as far as a task holds them."""

    def rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        fragment = _fragment(keys, kind, fragments).astype(np.int64) + kind * fragments
        return pa.RecordBatch.from_arrays([pa.array(fragment), pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], names=["fragment", "key", "n"])

    def run(batches):
        held = {k: ([], []) for k in _KINDS}

        def flush(kind: int):
            key, count = merge(*held[kind])
            held[kind] = ([], [])
            for lo in range(0, len(key), 1 << 16):
                yield rows(kind, key[lo : lo + (1 << 16)], count[lo : lo + (1 << 16)])

        for batch in batches:
            for a, b, data, offsets in pieces(batch.column("text")):
                words, _ = kernel.word_hashes(data, offsets)
                for kind, keys in enumerate((grams(data, offsets), words)):
                    for held_part, part in zip(held[kind], tally(keys), strict=True):
                        held_part.append(part)
                held[1][0].append(np.array([END_WORD]))
                held[1][1].append(np.array([b - a]))
                for kind in _KINDS:
                    if sum(map(len, held[kind][0])) > HELD:
                        yield from flush(kind)
        for kind in _KINDS:
            yield from flush(kind)

    return run


def _valued(shallow, fragments: int, least: tuple[int, int]):
    """Of one fragment's rows, the values of the frequent keys: log-probabilities, or counts of words."""

    def run(table: pa.Table) -> pa.Table:
        name, keys, counts = _model(table)
        kind = int(name >= fragments)
        often = counts > least[kind]
        values = counts.astype(np.float64)
        if kind == 0 and often.any():
            values = log_probability(keys[often], levels(keys, counts, ORDER, levels(*shallow.value, 2, [])))
        else:
            values = values[often]
        return pa.table({"kind": np.full(int(often.sum()), kind, np.int32), "key": keys[often].view(np.int64), "value": values})

    return run


def _model(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """Name, sorted keys and counts of a fragment."""
    keys, counts = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(keys)
    return table.column("fragment")[0].as_py(), keys[order], counts[order]


class Known:
    """The frequent values that everyone has, and what a block holds besides."""

    _last: tuple[str, Known] | None = None

    def __init__(self, kinds: list[tuple[np.ndarray, np.ndarray]]):
        self.lookups = [Lookup(keys, values.astype((np.float32, np.float64)[kind])) for kind, (keys, values) in enumerate(kinds)]

    @classmethod
    def of(cls, name: str, shared) -> Known:
        """That of a broadcast, made once in a worker."""
        if cls._last is None or cls._last[0] != name:
            cls._last = name, cls(shared.value)
        return cls._last[1]

    def met(self, texts: pa.Array):
        """For each piece of a block: first and last text, lengths in symbols and words, and for each kind (values, which of them are yet 0, their keys)."""
        for a, b, data, offsets in pieces(texts):
            words, counts = kernel.word_hashes(data, offsets)
            found = []
            for kind, keys in enumerate((grams(data, offsets), words)):
                values = self.lookups[kind](keys)
                rare = np.flatnonzero(values == 0).astype(np.int32)
                found.append((values, rare, keys[rare]))
            yield a, b, np.diff(offsets) + 1, counts, found


def _rare(met) -> list[np.ndarray]:
    """The distinct keys of a block, by kind, that are not among the frequent ones, in order."""
    keys: tuple[list, list] = ([], [np.array([END_WORD])])
    for *_, found in met:
        for kind in _KINDS:
            keys[kind].append(found[kind][2])
    return [tally(np.concatenate(k))[0] if k else np.zeros(0, np.uint64) for k in keys]


def _split(keys: np.ndarray, kind: int, fragments: int):
    part = _fragment(keys, kind, fragments)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(fragments + 1))


def _asked(name: str, shared, fragments: int):
    """Texts to questions: of every block one to every fragment that it has a question for."""

    def run(batches):
        known = Known.of(name, shared)
        block, texts = None, []

        def flush():
            rows = []
            for kind, keys in enumerate(_rare(known.met(pa.chunked_array(texts)))):
                order, bounds = _split(keys, kind, fragments)
                # Sorted keys as differences, which compress well.
                rows += [(kind * fragments + f, np.diff(keys[order[bounds[f] : bounds[f + 1]]], prepend=np.uint64(0)).tobytes()) for f in np.unique(_fragment(keys, kind, fragments)).astype(int).tolist()]
            for lo in range(0, len(rows), 64):
                part = rows[lo : lo + 64]
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in part], pa.int64()), pa.array([block] * len(part), pa.int64()), pa.array([k for _, k in part], pa.binary())], schema=_ASK)

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(blocks)], strict=True):
                if b > a and block is not None and block != blocks[a]:
                    yield from flush()
                    texts = []
                if b > a:
                    block = int(blocks[a])
                    texts.append(batch.column("text").slice(a, b - a))
        if texts:
            yield from flush()

    return run


def _told(shallow, fragments: int):
    """One fragment of the trie, or of the words, and what blocks have asked it."""

    def run(asked: pa.Table, model: pa.Table) -> pa.Table:
        name = asked.column("fragment")[0].as_py() if asked.num_rows else 0
        asked_keys = [np.cumsum(np.frombuffer(k, np.uint64), dtype=np.uint64) for k in asked.column("keys").to_pylist()]
        every = np.unique(np.concatenate(asked_keys)) if asked_keys else np.zeros(0, np.uint64)
        _, keys, counts = _model(model) if model.num_rows else (name, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        if name < fragments:
            value = log_probability(every, levels(keys, counts, ORDER, levels(*shallow.value, 2, []))).astype(np.float32)
        else:
            at = np.minimum(np.searchsorted(keys, every), max(len(keys) - 1, 0))
            value = np.where(keys[at] == every, counts[at], 0).astype(np.float64) if len(keys) else np.zeros(len(every))
        bodies = [value[np.searchsorted(every, k)].tobytes() for k in asked_keys]
        return pa.table({"block": asked.column("block"), "fragment": asked.column("fragment"), "values": pa.array(bodies, pa.binary())})

    return run


def _scored(name: str, shared, fragments: int, n_all: int, v_all: int):
    """One block's texts with what everyone knows and what the fragments have told it."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        met = list(Known.of(name, shared).met(docs.column("text")))
        answers = dict(zip(told.column("fragment").to_pylist(), told.column("values").to_pylist(), strict=True))
        rare = []
        for kind, keys in enumerate(_rare(met)):
            order, bounds = _split(keys, kind, fragments)
            value = np.zeros(len(keys))
            for f in np.unique(_fragment(keys, kind, fragments)).astype(int).tolist():
                value[order[bounds[f] : bounds[f + 1]]] = np.frombuffer(answers[kind * fragments + f], (np.float32, np.float64)[kind])
            rare.append((keys, value))

        end = rare[1][1][np.searchsorted(rare[1][0], END_WORD)]
        unit = np.log10(n_all + v_all + 1)
        n, hits, base, score = (np.zeros(docs.num_rows) for _ in range(4))
        for a, b, symbols, counts, found in met:
            step, count = (np.append(values.astype(np.float64), 0.0) for values, _, _ in found)
            for kind, target in enumerate((step, count)):
                _, at, keys = found[kind]
                target[at] = rare[kind][1][np.searchsorted(rare[kind][0], keys)]
            score[a:b] = np.add.reduceat(step[:-1], np.cumsum(symbols) - symbols)
            first = np.cumsum(counts) - counts
            some = counts > 0
            n[a:b] = counts + 1
            for target, value, last in ((hits, (count > 0).astype(float), float(end > 0)), (base, np.log10(count + 1), np.log10(end + 1))):
                total = np.zeros(b - a)
                total[some] = np.add.reduceat(value, first[some])[: some.sum()] if some.any() else 0
                target[a:b] = total + last
        base -= n * unit
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": n.astype(np.int64), "n_known": hits.astype(np.int64), "train_tokens": np.full(len(n), n_all), "base_score": base, "score": score})

    return run


def scored(docs: DataFrame, fold: int = 7, left_out: int = 2, stable: bool = False) -> DataFrame:
    """A row for every row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the texts whose crc32(doc_id as text) mod fold is not left_out
    (a null doc_id is held out).  Tokens are words between ASCII white space,
    A-Z lower-cased, and one end for each text; base_score adds
    log10((c + 1) / (N + V + 1)) over them.  score is log10 of the model's
    probability of the lower-cased bytes and the end.  A null text is empty;
    rows that repeat a document count, and are scored, as often as they stand
    there; an empty table gives no rows.  Other columns are not looked at.
    docs is scanned several times and must give its rows in the same order each
    time: stable says that it does, as a table; else it is checkpointed first.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == left_out, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held.alias("held_out"))
    rows = rows if stable else cut(rows)
    context = docs.sparkSession.sparkContext
    letters = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    fragments = max(1, -(-letters // LETTERS))
    counted = rows.where(~F.col("held_out")).select("text").mapInArrow(kernel.tidy(_counted(fragments)), _COUNT_DDL)
    model = cut(counted.groupBy("fragment", "key").agg(F.sum("n").alias("n")))
    is_word = F.col("fragment") >= fragments
    totals = model.groupBy(is_word.alias("words")).agg(F.sum("n").alias("n"), F.count("*").alias("different")).collect()  # two rows
    sums = {r["words"]: (r["n"], r["different"]) for r in totals}
    # At most 2^24 counts, whatever the input.
    low = model.where(~is_word).groupBy(F.col("key").bitwiseAND(_mask(2)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    low_keys, low_counts = low.column("gram").to_numpy().astype(np.uint64), low.column("n").to_numpy()
    order = np.argsort(low_keys)
    shallow = context.broadcast((low_keys[order], low_counts[order]))
    # Fewer than FREQUENT keys can each have more than this share of all counts.
    least = tuple(sums.get(bool(kind), (0, 0))[0] // FREQUENT[kind] for kind in _KINDS)
    frequent = model.groupBy("fragment").applyInArrow(kernel.tidy_group(_valued(shallow, fragments, least)), "kind int, key long, value double").toArrow()
    kinds = []
    for kind in _KINDS:
        mine = np.flatnonzero(frequent.column("kind").to_numpy() == kind)
        kinds.append((frequent.column("key").to_numpy()[mine].view(np.uint64), frequent.column("value").to_numpy()[mine]))
    shared, name = context.broadcast(kinds), uuid.uuid4().hex
    blocks = rows.withColumn("block", (F.monotonically_increasing_id() / BLOCK_ROWS).cast("long"))
    asked = blocks.select("block", "text").mapInArrow(kernel.tidy(_asked(name, shared, fragments)), _ASK_DDL)
    told = asked.groupBy("fragment").cogroup(model.groupBy("fragment")).applyInArrow(kernel.tidy_pair(_told(shallow, fragments)), _TELL_DDL)
    n_all, v_all = sums.get(True, (0, 0))
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(kernel.tidy_pair(_scored(name, shared, fragments, n_all, v_all)), _OUT_DDL)
