"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Each coordinate has its own learning rate, and the L1 term keeps most weights
at exactly zero, so the model is a short list that is cheap to send out.
Learning uses a bounded sample of the labelled documents; scoring covers all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .kernel import pieces
from .line_crf import scored_rows, with_score
from .sample import chosen

#: Fixed model parameters.
BITS = 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.5
EPOCHS = 3
#: Labelled documents that are learned from, at most; the least by hash of doc_id.
SAMPLE = 8192
#: Letters of a document that is learned from, and of all of them together, at most.  Texts are taken whole or not at all.
LETTERS, ALL_LETTERS = 4_000_000, 64_000_000

#: ASCII characters that are no letters or digits separate words.
GAP = np.ones(256, dtype=bool)
GAP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = False


def _slots(words: np.ndarray) -> list[np.ndarray]:
    """Hashed single words, word pairs, and pairs with one word left out."""
    shift = np.uint64(64 - BITS)
    out = [kernel.mix(words + np.uint64(1)) >> shift]
    if len(words) > 1:
        out.append(kernel.mix(words[:-1] * kernel.WORD_STEP + words[1:] + np.uint64(2)) >> shift)
    if len(words) > 2:
        out.append(kernel.mix(words[:-2] * kernel.WORD_STEP + words[2:] + np.uint64(3)) >> shift)
    return out


def features(words: np.ndarray) -> np.ndarray:
    """Distinct feature slots of one text."""
    return np.unique(np.concatenate(_slots(words))).astype(np.int32) if len(words) else np.zeros(0, np.int32)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over the rows in the given order: slots and values of the non-zero weights, and the bias."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rows = [np.append(r, size).astype(np.int64) for r in rows]  # the last slot is the bias

    def weights(i: np.ndarray) -> np.ndarray:
        l1 = np.where(i == size, 0.0, L1)
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i, y in zip(rows, labels, strict=True):
            w = weights(i)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            root = np.sqrt(n[i])
            z[i] += g - (np.sqrt(n[i] + g * g) - root) / ALPHA * w
            n[i] += g * g
    w = weights(np.arange(size + 1))
    slots = np.flatnonzero(w[:size])
    return slots, w[slots], float(w[size])


def learn(docs: DataFrame, sample: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from a bounded sample of (doc_id, label); no positive or no negative example gives a constant score.

    Null and empty texts have no features; of several texts of one doc_id the
    least is learned from; an empty sample gives no weights and a bias of 0.
    """

    def featurised(batches):
        for batch in batches:
            rows = []
            for _, _, data, offsets in pieces(batch.column("text")):
                words, counts = kernel.word_hashes(data, offsets, GAP)
                rows += [features(w) for w in np.split(words, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "label", "slots"])

    def trained(table: pa.Table) -> pa.Table:
        order = np.argsort(kernel.mix(table.column("doc_id").to_numpy().astype(np.uint64)), kind="stable")
        rows = table.column("slots").to_pylist()
        labels = table.column("label").to_numpy()[order]
        slots, values, bias = fit([np.frombuffer(rows[i], np.int32) for i in order], labels)
        return pa.table({"slots": pa.array([slots.astype(np.int32)], pa.list_(pa.int32())), "weights": pa.array([values], pa.list_(pa.float64())), "bias": [bias]})

    # The sample is bounded, so it is sent to the documents and its features meet in one task.
    found = chosen(docs, sample, F.length("text"), LETTERS, ALL_LETTERS).mapInArrow(featurised, "doc_id long, label int, slots binary")
    row = found.withColumn("sample", F.lit("all")).groupBy("sample").applyInArrow(trained, "slots array<int>, weights array<double>, bias double").first()
    if row is None:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return np.array(row["slots"], np.int64), np.array(row["weights"]), row["bias"]


def toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """docs with `score` (0 to 1) of each whole text; a null or wordless text has the score of no features.

    Repeated rows and null doc_ids get a row each, an empty table gives none.
    Other columns are kept; one named score is replaced.
    """
    slots, values, bias = model

    def scored(batches):
        table = np.zeros(1 << BITS)
        table[slots] = values
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, data, offsets in pieces(batch.column("text")):
                words, counts = kernel.word_hashes(data, offsets, GAP)
                ends = np.cumsum(counts)
                for k, (a, b) in enumerate(zip(ends - counts, ends, strict=True), lo):
                    hit = [s[table[s] != 0] for s in _slots(words[a:b])] if b > a else []
                    hit = np.unique(np.concatenate(hit)) if hit else []
                    out[k] = table[hit].sum() if len(hit) else 0.0
            yield with_score(batch, 1.0 / (1.0 + np.exp(-np.clip(out + bias, -35, 35))))

    return scored_rows(docs, scored)
