"""Language identification in two steps: the family, then the language within it.

Both steps are linear support vector machines over hashed byte trigrams of the
whole text: one against the rest for families, one against one between the
languages of a family, which vote.  Learning uses a bounded sample of labelled
documents; prediction covers all and uses nothing but the text.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .kernel import pieces
from .session import cut

#: Documents that are learned from: this many in all, shared out evenly among languages, so more of rare ones; one of each at least.
SAMPLE = 4000
#: Languages up to which their numbers of documents are broadcast.
LANGUAGES = 10_000
#: Texts whose vectors are held at a time.
ROWS = 1024
BITS = 12
#: Fixed training parameters.
STEPS, RATE, COST = 80, 0.15, 1e-4
UNKNOWN = "und"
#: Families of closely related languages; a language that is missing is a family of its own.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

_CODE = np.zeros(256, np.uint32)
_CODE[:] = kernel.LOWER
# Digits, marks and spaces are alike, so that only letters and where words begin and end count.
_CODE[:0x80] = np.where(((np.arange(0x80) | 0x20) >= 0x61) & ((np.arange(0x80) | 0x20) <= 0x7A), _CODE[:0x80], 0x20)


def family(lang: str) -> str:
    return _FAMILY.get(lang, f"only {lang}")


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A unit vector of damped trigram counts for each text; texts without trigrams have zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, 1 << BITS), np.float32)
    if len(data) < 3:
        return out
    c = _CODE[data]
    slot = ((c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
    for i in range(n):
        a, b = offsets[i], offsets[i + 1] - 2
        if b > a:
            out[i] = np.bincount(slot[a:b], minlength=1 << BITS)
    out[:, int(0x202020 * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - BITS)] = 0  # runs of spaces
    out = np.sqrt(out)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear SVM (squared hinge loss), y in -1, 1; the classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    y = y.astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        slack = np.maximum(np.float32(0), 1 - y * (x @ w[:-1] + w[-1]))
        pull = -2 * weight * y * slack
        g = np.append(x.T @ pull + np.float32(COST) * w[:-1], pull.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def fit(x: np.ndarray, langs: np.ndarray) -> dict[tuple[str, str, str], np.ndarray]:
    """Machines by (kind, a, b): family a against the rest, or language a against b."""
    names = sorted(set(langs.tolist()))
    families = np.array([family(a) for a in langs])
    found = {}
    groups = sorted(set(families.tolist()))
    for name in groups if len(groups) > 1 else []:
        found["family", name, ""] = svm(x, np.where(families == name, 1.0, -1.0))
    for name in groups:
        for a, b in itertools.combinations([n for n in names if family(n) == name], 2):
            rows = (langs == a) | (langs == b)
            found["pair", a, b] = svm(x[rows], np.where(langs[rows] == a, 1.0, -1.0))
    if len(names) == 1:
        found["single", names[0], ""] = np.zeros(x.shape[1] + 1)
    for name in names:  # languages alone in their family
        found.setdefault(("lang", name, ""), np.zeros(1))
    return found


def predict(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each vector: share of the family's and of the language's sigmoid margins."""

    def margin(w):
        return 1.0 / (1.0 + np.exp(-4.0 * np.clip(x @ w[:-1].astype(np.float32) + w[-1], -8, 8)))

    names = sorted(a for kind, a, _ in model if kind == "lang")
    groups = sorted({family(a) for a in names})
    if len(groups) > 1:
        by = np.stack([margin(model["family", g, ""]) for g in groups], axis=1)
        by /= by.sum(axis=1, keepdims=True)
    else:
        by = np.ones((len(x), 1))
    group = by.argmax(axis=1)
    lang = np.empty(len(x), dtype=object)
    score = np.empty(len(x))
    for g, name in enumerate(groups):
        inside = [n for n in names if family(n) == name]
        votes = np.zeros((len(x), len(inside)))
        for (i, a), (j, b) in itertools.combinations(enumerate(inside), 2):
            p = margin(model["pair", a, b])
            votes[:, i] += (p >= 0.5) + p / len(inside)  # votes first, then margins
            votes[:, j] += (p < 0.5) + (1 - p) / len(inside)
        at = np.flatnonzero(group == g)
        best = votes[at].argmax(axis=1)
        lang[at] = np.array(inside, dtype=object)[best]
        total = votes[at].sum(axis=1)
        score[at] = by[at, g] * (np.where(total > 0, votes[at, best] / np.where(total > 0, total, 1), 1.0))
    return lang, np.clip(score, 0, 1)


def learn(docs: DataFrame, fold: int, left_out: int, sample: int = SAMPLE) -> dict:
    """The model from documents outside the left-out fold; empty if none has a text and a language.

    Rows without a doc_id, a language or a letter in their text are passed
    over; a text that stands several times under one doc_id and language counts
    once.  Every language is learned, however rare, and however few ids its rows
    share.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % fold != left_out))
    rows = rows.withColumn("body", F.xxhash64("text"))
    different = cut(rows.select("lang", "doc_id", "body", F.xxhash64("doc_id", "body").alias("key")).distinct())
    known = different.groupBy("lang").agg(F.count("*").alias("rows"), F.min("key").alias("least"))
    languages = known.count()
    if not languages:
        return {}
    each = max(1, sample // languages)
    # A few times as many as are wanted, by hash, whatever a language's share of all rows, and its first in any case; then the first of them.
    near = F.least(F.lit(1.0), F.lit(4.0 * each + 32) / F.col("rows"))
    known = F.broadcast(known) if languages <= LANGUAGES else known
    few = different.join(known, "lang").where((F.pmod("key", F.lit(1 << 30)) < near * (1 << 30)) | (F.col("key") == F.col("least")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id", "body"))
    wanted = few.withColumn("place", place).where(F.col("place") <= each).select("lang", "doc_id", "body")
    wanted = F.broadcast(wanted) if languages <= LANGUAGES else wanted
    chosen = rows.join(wanted, ["lang", "doc_id", "body"]).groupBy("lang", "doc_id", "body").agg(F.min("text").alias("text"))

    def featurised(batches):
        for batch in batches:
            out = []
            for _, _, data, offsets in pieces(batch.column("text"), rows=ROWS):
                out += [x.astype(np.float16).tobytes() for x in vectors(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(out, pa.binary())], names=["doc_id", "lang", "x"])

    def trained(table: pa.Table) -> pa.Table:
        drawn = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "lang", "x")), strict=True))  # the same order in each run
        model = fit(np.stack([np.frombuffer(x, np.float16) for *_, x in drawn]).astype(np.float32), np.array([lang for _, lang, _ in drawn], dtype=object))
        return pa.table({"kind": [k[0] for k in model], "a": [k[1] for k in model], "b": [k[2] for k in model], "w": pa.array([v.astype(np.float32).tobytes() for v in model.values()], pa.binary())})

    found = chosen.select("doc_id", "text", "lang").mapInArrow(featurised, "doc_id long, lang string, x binary")
    machines = found.withColumn("sample", F.lit("all")).groupBy("sample").applyInArrow(trained, "kind string, a string, b string, w binary").collect()
    return {(r["kind"], r["a"], r["b"]): np.frombuffer(r["w"], np.float32) for r in machines}


def identified(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs; `und` with score 0 for texts that are null or have no letter.

    Only the text is looked at.  Without a model every text is `und`.  Repeated
    rows and null doc_ids get a row each, an empty table gives none.  Of equal
    votes the language first by name wins.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # machines of fixed size for each language pair of a family

    def run(batches):
        for batch in batches:
            lang = np.full(batch.num_rows, UNKNOWN, dtype=object)
            score = np.zeros(batch.num_rows)
            if shared.value:
                for a, b, data, offsets in pieces(batch.column("text"), rows=ROWS):
                    lang[a:b], score[a:b] = predict(shared.value, vectors(data, offsets))
            none = ~batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            lang[none], score[none] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    text = F.col("text").cast("string")
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return kept.mapInArrow(run, "doc_id long, lang_pred string, score double")
