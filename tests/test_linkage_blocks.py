"""Title pairs and reference matches against brute force over all pairs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from litmill.functions import similarity
from litmill.functions.similarity import title_percent
from litmill.operators import fuzzy, linkage

TITLES = ["transformer networks for long texts", "transformers networks for long texts", "trans former networks", "transform networks for long texts", "a theory of parsing", "theory of parsing", "The Theory of Parsing", "on the theory of parsing", "theories of parsing", "graph search", "graphs search", "graphsearch", "of the", "to"]


def test_fuzzy_titles_meet_by_prefix(spark):
    r = random.Random(1)
    rows = [(i, t, r.choice([None, 2001, 2002])) for i, t in enumerate(TITLES + [t + " today" for t in TITLES])]
    want = set()
    for i, s, y in rows:
        for j, t, z in rows:
            s, t = s.lower(), t.lower()
            if i < j and (y is None or z is None or y == z) and (s.startswith(t.split(" ")[0]) or t.startswith(s.split(" ")[0])) and title_percent(s, t) >= 80:
                want.add((i, j, title_percent(s, t)))
    got = linkage.fuzzy_titles(spark.createDataFrame(rows, "id long, title string, year int"), 80.0).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    near = spark.createDataFrame([(1, TITLES[0], 2001), (2, TITLES[1], 2001)], "id long, title string, year int")
    assert [(x.a, x.b) for x in linkage.fuzzy_titles(near).collect()] == [(1, 2)]


def _title_kinds(spark, rows):
    from pyspark.sql import functions as F

    kinds = spark.createDataFrame(rows, "id long, t string, year int").withColumn("word", F.substring_index("t", " ", 1))
    words = kinds.select("word", F.col("word").alias("block")).distinct()
    return kinds, words


def test_one_hot_first_word(spark):
    """2,000 titles under one first word against brute force, and how many pairs are looked at."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(900)]
    titles = [" ".join(["study", *r.choices(words, k=r.randint(0, 9))]) for _ in range(1400)]

    def changed(title):
        w = title.split()[1:]
        kind = r.randrange(6)
        if kind == 0 and w:
            w[r.randrange(len(w))] += r.choice("xyz")
        elif kind == 1:
            r.shuffle(w)
        elif kind == 2 and len(w) > 1:
            w.pop(r.randrange(len(w)))
        elif kind == 3:
            w += r.choices(words, k=r.randint(1, 6))
        elif kind == 4 and w:
            w.append(r.choice(w))
        elif len(w) > 1:
            i = r.randrange(len(w) - 1)
            w[i : i + 2] = ["".join(w[i : i + 2])]
        return " ".join(["study", *w])

    titles = list(dict.fromkeys(titles + [changed(changed(t) if r.random() < 0.4 else t) for t in r.choices(titles, k=700)]))[:2000]
    # A tenth of the titles against all, and all that the join finds for them.
    every = [(min(i, j), max(i, j)) for i in range(0, len(titles), 10) for j in range(len(titles)) if j > i or j % 10]
    scores = similarity.title_percents([titles[i] for i, _ in every], [titles[j] for _, j in every])
    kinds = _title_kinds(spark, [(i, t, None) for i, t in enumerate(titles)])
    for least in (92.0, 75.0):
        want = {p: s for p, s in zip(every, scores, strict=True) if s >= least}
        got = linkage.fuzzy_titles(kinds[0].withColumnRenamed("t", "title"), least).collect()
        mine = {(x.a, x.b): x.score for x in got if x.a % 10 == 0 or x.b % 10 == 0}
        assert mine == want and len(want) > 50 and len({(x.a, x.b) for x in got}) == len(got)
        looked_at = linkage.title_pairs(*kinds, least).count()
        assert len(got) <= looked_at and (least < 92 or looked_at < len(titles) ** 2 / 20), looked_at


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab c", max_size=14), min_size=2, max_size=2), st.sampled_from([92.0, 80.0, 70.0, 60.0]))
def test_alike_titles_share_a_token(pair, least):
    x, y = (" ".join(t.split()) for t in pair)
    if x and y and similarity.title_percent(x, y) >= least:
        t, often = least / 100 - 0.0005, {fuzzy._hash("\na"): 5, fuzzy._hash(" a \t0"): 9}
        (a, _), (_, b) = (fuzzy.tokens(s, t, fuzzy.width(t), often) for s in (x, y))
        assert set(a) & set(b)


SIDE = "id long, title string, year int, doi string, arxiv string, authors array<string>"


def test_matched_past_stop_words_and_gates(spark):
    works = [
        (1, "Theory of Parsing and Compiling", 2001, "10.1/a", None, ["Jane Doe", "Roe, R."]),
        (2, "A theory of parsings and compiling", 2001, None, None, None),
        (3, "Graph search", 2005, "10.48550/arXiv.2101.00001", None, ["Ann Lee"]),
        (4, "Graph search", 2005, "10.1/g", None, ["Bo Chu"]),
        (5, "Deep sums", None, None, "2102.00002v3", None),
    ]
    refs = [
        (10, "The Theory of Parsing and Compiling", 2002, None, None, ["Doe, J.", "Nobody, X."]),  # half of the authors
        (11, "The Theory of Parsing and Compiling", 2001, "10.1/b", None, None),  # another DOI than 1, so 2
        (12, "The Theory of Parsing and Compiling", 2001, None, None, ["Else, Q."]),  # no common author with 1, so 2
        (13, "On the theory of parsing and compiling", 2009, None, None, None),  # too late
        (14, "Graph search", 2005, "10.1/h", None, None),  # an arXiv DOI rules nothing out
        (15, "Graph search", 2005, None, None, ["Ch\u00fa, B.", "et al."]),
        (16, "unlike", None, "https://doi.org/10.1/G", None, None),
        (17, "unlike", None, "10.48550/arXiv.2102.00002", None, None),
        (18, "Deep sums", None, None, "2102.00009", None),  # another arXiv identifier
    ]
    got = {x.ref_id: (x.work_id, x.via) for x in linkage.matched(spark.createDataFrame(refs, SIDE), spark.createDataFrame(works, SIDE)).collect()}
    assert got == {10: (1, "title"), 11: (2, "title"), 12: (2, "title"), 14: (3, "title"), 15: (4, "title"), 16: (4, "identifier"), 17: (5, "identifier")}


def test_matched_equals_all_pairs(spark):
    """Every pair whose first words past stop words agree is scored."""
    stop = {"a", "an", "the", "on", "of", "in", "for", "to", "toward", "towards"}
    key = lambda t: next((w for w in t.lower().split() if w not in stop), t.lower().split()[0])
    refs = [(i, t, 2000 + i % 3, None) for i, t in enumerate(TITLES)]
    works = [(100 + i, t, 2000 + i % 2, None) for i, t in enumerate(reversed(TITLES))]
    want = {}
    for i, s, y, _ in refs:
        found = [(title_percent(s.lower(), t.lower()), -j) for j, t, z, _ in works if abs(y - z) <= 1 and key(s) == key(t) and title_percent(s.lower(), t.lower()) >= 85]
        if found:
            want[i] = (-max(found)[1], max(found)[0])
    made = [spark.createDataFrame(x, "id long, title string, year int, doi string") for x in (refs, works)]
    assert {x.ref_id: (x.work_id, x.score) for x in linkage.matched(*made, 85.0).collect()} == want
