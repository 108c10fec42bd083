"""Clusters of texts, whose weights are not written out, against the plain way; what they write."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
from litmill.operators import clustering, textmine
from litmill.session import checkpoint_folder


def rows():
    """Texts of four kinds, copies, ids with several texts, ids and titles that are null, titles that differ late or not at all."""
    r = random.Random(5)
    kinds = [[f"{a}{b}er" for a in "bcdf" for b in "aeiou"], [f"{a}{b}os" for a in "gkl" for b in "aeiou"], ["mind", "salt", "the", "deep-sea"], ["stone's", "river", "x"]]
    out = []
    for i in range(60):
        own = kinds[i % 4] + r.choice(kinds)
        body = " ".join(r.choice(own) if r.random() < 0.8 else f"rare{'abcdefgh'[r.randrange(8)]}{'xyz'[r.randrange(3)]}" for _ in range(r.randrange(1, 30)))
        out.append((i, body, None if i % 11 == 3 else "A title of more than twenty-four letters " * (i % 3) + f"t{r.randrange(9)}"))
    return [*out, (70, out[5][1], out[5][2]), (71, out[5][1], "z"), (8, "Salt mind raref", "s"), (8, None, None), (None, "mind raref", "n"), (None, "salt", "n"), (90, None, "t"), (91, "the x", "t")]


def plain(k, rounds):
    """(cluster, score) by id and weights by cluster and term."""
    bags, titles = {}, {}
    for i, body, title in rows():
        bags.setdefault(i, Counter()).update(w for w in (body or "").lower().split() if len(w) > 2 and w not in textmine.STOPWORDS)
        titles[i] = min(filter(None, (titles.get(i), title)), default=None)
    bags = {i: bag for i, bag in bags.items() if bag}
    df = Counter(w for bag in bags.values() for w in bag)
    terms = sorted(df)
    ids = sorted((i for i in bags if i is not None), key=lambda i: (titles[i] is not None, titles[i] or "", i))
    x = np.array([[bags[i][t] / bags[i].total() * (math.log((1 + len(bags)) / (1 + df[t])) + 1) for t in terms] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre, before = x[[i * len(ids) // k for i in range(k)]].copy(), None
    for _ in range(rounds):
        score = np.round(x @ (centre / np.linalg.norm(centre, axis=1, keepdims=True)).T, 12)
        at = score.argmax(axis=1)
        if before is not None and (at == before).all():
            break
        before = at
        for c in set(at):
            centre[c] = x[at == c].mean(axis=0)
    return {i: (int(a), round(float(s[a]), 9)) for i, a, s in zip(ids, at, score, strict=True)}, {(c, t): round(float(v), 9) for c, row in enumerate(centre) for t, v in zip(terms, row, strict=True) if v}


@pytest.mark.parametrize(("known", "sent", "k", "rounds"), [(None, None, 5, 15), (2, 1, 5, 15), (6, 1, 5, 2), (0, None, 40, 15), (9, None, 40, 1)])
def test_equals_plain(spark, monkeypatch, known, sent, k, rounds):
    monkeypatch.setattr(clustering, "ROWS", 7)
    docs = spark.createDataFrame(rows(), "id long, body string, title string").repartition(5)
    monkeypatch.setattr(clustering, "KNOWN", known if known is not None else clustering.KNOWN)
    placed, centres = textmine.text_clusters(docs, k, rounds, docs.select("id", "title"), sent=sent)
    want, weights = plain(k, rounds)
    assert {r.id: (r.cluster, pytest.approx(r.score, abs=1e-8)) for r in placed.collect()} == want
    got = {(r.cluster, r.term): r.weight for r in centres.collect()}
    assert got.keys() == weights.keys() and all(got[x] == pytest.approx(weights[x], abs=1e-8) for x in got)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "the x", "t"), (None, "mind", "t")], "id long, body string, title string")
    placed, centres = textmine.text_clusters(docs, 3, titles=docs.select("id", "title"))
    assert (placed.count(), centres.count()) == (0, 0) and textmine.text_clusters(docs.limit(0), 3)[0].count() == 0


def written(spark):
    top = checkpoint_folder(spark).removeprefix("file:")
    return sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(top) for f in files if not f.endswith(".crc"))


def shuffled(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(os.path.getsize(f"{d}/{f}") for top in dirs for d, _, files in os.walk(str(top)) for f in files if f.startswith("shuffle_"))


@pytest.mark.parametrize("name", ["topic_model", "topic_hierarchy"])
def test_little_is_written(spark, tables, name):
    """Weights were written out twice as rows, and each round's sums were shuffled and written in full: nineteen times the input in all."""
    before = written(spark) + shuffled(spark)
    assert __spark_entry__.queries()[name](spark, tables).count()
    assert written(spark) + shuffled(spark) - before < 4 * os.path.getsize(f"{tables}/documents.parquet")
