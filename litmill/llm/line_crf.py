"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad.  What speaks for it are counts of its own characters
and words and of its neighbours'; what ties lines together are transition
weights.  Forward-backward gives each line's probability of being good, and the
mean over lines, weighted by length, is the document's score.  Learning uses the
lines of a bounded sample of labelled documents, each with its document's label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .sample import chosen

#: Labelled documents that are learned from, lines of each of them, and lines of all, at most.  Texts are taken whole or not at all.
SAMPLE = 4096
LINES, ALL_LINES = 8_192, 262_144
#: Fixed training parameters.
STEPS, RATE, DECAY = 150, 0.08, 1e-3


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Classes of bytes that are counted: upper case, digits, sentence marks, bars, exclamation marks, other ASCII symbols, bytes beyond ASCII, spaces.
CLASSES = np.stack(
    [
        _table((0x41, 0x5A)),
        _table((0x30, 0x39)),
        _table((0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F)),
        _table((0x7C, 0x7C)),
        _table((0x21, 0x21)),
        _table((0x23, 0x26), (0x2A, 0x2B), (0x3C, 0x3E), (0x40, 0x40), (0x5B, 0x60), (0x7B, 0x7B), (0x7D, 0x7E)),
        _table((0x80, 0xFF)),
        _table((0x20, 0x20), (0x09, 0x09)),
    ]
)
OWN = len(CLASSES) + 5


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line with its neighbours', length of each line, number of lines of each text (at least one)."""
    breaks = np.flatnonzero(data == 0x0A) if len(data) else np.zeros(0, np.int64)
    per_text = 1 + np.diff(np.searchsorted(breaks, offsets))
    bounds = np.sort(np.concatenate((offsets[:-1], breaks + 1, offsets[-1:])), kind="stable")
    size = np.diff(bounds)
    counts = kernel.class_counts(data, bounds, CLASSES)
    hashes, where = kernel.placed_words(data, offsets)
    n_words = np.diff(np.searchsorted(where, bounds))
    again = where[1:][hashes[1:] == hashes[:-1]]
    repeats = np.diff(np.searchsorted(again, bounds))
    ever = np.maximum(size, 1)
    share = counts / ever
    words = np.maximum(n_words, 1)
    own = np.stack([*share, np.log1p(size), repeats / words, np.minimum(size / words, 40) / 10, (size == 0).astype(float), np.log1p(n_words)], axis=1)
    # The neighbours of the first and last line of a text are blank lines.
    first = np.zeros(len(own), dtype=bool)
    last = np.zeros(len(own), dtype=bool)
    ends = np.cumsum(per_text)
    first[ends - per_text] = True
    last[ends - 1] = True
    before = np.vstack((own[:1], own[:-1]))
    after = np.vstack((own[1:], own[-1:]))
    before[first] = 0
    after[last] = 0
    edge = np.stack((first, last), axis=1).astype(float)
    return np.hstack((own, before, after, edge)).astype(np.float32), size, per_text


def _chains(per_text: np.ndarray):
    """Texts by falling number of lines, and for each line number how many texts have it."""
    order = np.argsort(-per_text, kind="stable")
    starts = np.cumsum(per_text) - per_text
    lengths = per_text[order]
    alive = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
    return starts[order], lengths, alive


def forward_backward(unary: np.ndarray, moves: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected transitions (2 x 2), and the sum of log partition values.

    unary: score of good over bad for each line; moves: scores of the transitions.
    """
    starts, lengths, alive = _chains(per_text)
    score = np.stack((np.zeros(len(unary)), unary), axis=1)
    ahead, back = np.empty_like(score), np.empty_like(score)
    for t, k in enumerate(alive):
        i = starts[:k] + t
        if t == 0:
            ahead[i] = score[i]
        else:
            ahead[i] = score[i] + np.logaddexp.reduce(ahead[i - 1][:, :, None] + moves, axis=1)
    for t in range(len(alive) - 1, -1, -1):
        k, later = alive[t], alive[t + 1] if t + 1 < len(alive) else 0
        i = starts[:k] + t
        back[i] = 0
        if later:
            j = i[:later]
            back[j] = np.logaddexp.reduce(moves + (score[j + 1] + back[j + 1])[:, None, :], axis=2)
    both = ahead + back
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    inner = np.ones(len(unary), dtype=bool)
    inner[starts] = False
    j = np.flatnonzero(inner)
    pair = ahead[j - 1][:, :, None] + moves + (score[j] + back[j])[:, None, :] - total[j][:, None, None]
    return good, np.exp(pair).sum(axis=0) if len(j) else np.zeros((2, 2)), float(total[starts].sum())


def fit(x: np.ndarray, per_text: np.ndarray, labels: np.ndarray) -> dict:
    """Weights by gradient ascent on the penalised log-likelihood of the lines' labels (Adam steps)."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = np.hstack(((x - mean) / spread, np.ones((len(x), 1)))).astype(np.float64)
    y = np.repeat(labels, per_text)
    n = len(labels)
    theta = np.zeros(x.shape[1] + 4)
    starts, lengths, _ = _chains(per_text)
    inner = np.ones(len(y), dtype=bool)
    inner[starts] = False
    j = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[j - 1], y[j]), 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        good, expected, _ = forward_backward(x @ theta[:-4], theta[-4:].reshape(2, 2), per_text)
        g = np.concatenate((x.T @ (y - good), (seen - expected).ravel())) / n - DECAY * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {"mean": mean, "spread": spread, "weights": theta[:-4], "moves": theta[-4:].reshape(2, 2)}


def scores(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    x, size, per_text = line_features(data, offsets)
    unary = ((x - model["mean"]) / model["spread"]) @ model["weights"][:-1] + model["weights"][-1]
    good, _, _ = forward_backward(unary, model["moves"], per_text)
    weight = np.maximum(size, 1)
    starts = np.cumsum(per_text) - per_text
    return np.clip(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts), 0, 1)


def learn(docs: DataFrame, sample: DataFrame) -> dict | None:
    """The model from a bounded sample of (doc_id, label); None without documents of both labels.

    Null and empty texts are one empty line; of several texts of one doc_id the
    least is learned from.
    """

    def featurised(batches):
        for batch in batches:
            rows = []
            for _, _, data, offsets in kernel.pieces(batch.column("text")):
                x, _, per_text = line_features(data, offsets)
                for part in np.split(x, np.cumsum(per_text)[:-1]):
                    rows.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], names=["doc_id", "label", "lines"])

    def trained(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
        rows = table.column("lines").to_pylist()
        x = [np.frombuffer(rows[i], np.float32).reshape(-1, 3 * OWN + 2) for i in order]
        y = (table.column("label").to_numpy()[order] > 0).astype(int)
        if len(set(y.tolist())) < 2:
            return pa.table({"mean": pa.array([], pa.list_(pa.float64())), "spread": pa.array([], pa.list_(pa.float64())), "weights": pa.array([], pa.list_(pa.float64())), "moves": pa.array([], pa.list_(pa.float64()))})
        model = fit(np.vstack(x), np.array([len(r) for r in x]), y)
        return pa.table({k: pa.array([np.asarray(v, np.float64).ravel()], pa.list_(pa.float64())) for k, v in model.items()})

    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    found = chosen(docs, sample, lines, LINES, ALL_LINES).mapInArrow(featurised, "doc_id long, label int, lines binary")
    row = found.withColumn("sample", F.lit("all")).groupBy("sample").applyInArrow(trained, "mean array<double>, spread array<double>, weights array<double>, moves array<double>").first()
    if row is None:
        return None
    model = {k: np.array(row[k]) for k in row.asDict()}
    return model | {"moves": model["moves"].reshape(2, 2)}


def quality(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with `score`, the length-weighted probability that its lines are good.

    A null or empty text is one empty line.  Without a model every score is
    0.5.  Repeated rows and null doc_ids get a row each, an empty table gives
    none.  Other columns are kept; one named score is replaced.
    """

    def scored(batches):
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if model is not None:
                for a, b, data, offsets in kernel.pieces(batch.column("text")):
                    score[a:b] = scores(model, data, offsets)
            yield with_score(batch, score)

    return scored_rows(docs, scored)


def with_score(batch: pa.RecordBatch, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "score"])


def scored_rows(docs: DataFrame, run) -> DataFrame:
    """docs as it is, passed through `run`, which adds a column `score` to each batch; one that docs has is replaced."""
    rows = docs.drop("score").withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(kernel.tidy(run), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
