"""Perplexity rules, periodic runs and centroid clusters against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litmill.llm import centroids, kernel, kneser_ney, queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- rules and perplexity


def plain_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def plain_model(texts):
    """log10 probability of each (language, text) by a modified Kneser-Ney model over their bytes, written out."""
    n = kneser_ney.ORDER

    def symbols(text):
        body = b" ".join(w.encode() for w in WORD.findall(text or ""))
        return list(bytes(b + 32 if 65 <= b <= 90 else b for b in body)) + [kneser_ney.END]

    def grams(lang, text):
        line = [kneser_ney.PAD] * (n - 1) + symbols(text)
        return [(lang, *line[i : i + n]) for i in range(len(line) - n + 1)]

    levels = {n: Counter(g for lang, text in texts for g in grams(lang, text))}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter((g[0], *g[2:]) for g in levels[k + 1])
    contexts = {k: defaultdict(list) for k in levels}
    off = {}
    for k, level in levels.items():
        many = Counter(level.values())
        n1, n2, n3, n4 = (many[i] for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 and n3 else 0
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3] if y else [0, 0, 0]
        off[k] = [x if 0 < x < i + 1 else (i + 1) / 2 for i, x in enumerate(d)]
        for g, c in level.items():
            contexts[k][g[:-1]].append(c)

    def p(g):
        k = len(g) - 1
        if k == 0:
            return 1 / kneser_ney.SYMBOLS
        d = off[k]
        after = contexts[k][g[:-1]]
        c = levels[k][g]
        left = sum(d[min(x, 3) - 1] for x in after)
        return (c - d[min(c, 3) - 1] + left * p((g[0], *g[2:]))) / sum(after)

    return [(sum(math.log10(p(g)) for g in grams(lang, text)), len(symbols(text))) for lang, text in texts]


def rule_documents(seed=4):
    r = random.Random(seed)
    vocabulary = {"en": ["the", "River", "flows,", "to", "of|", "sea.", "ünder"], "de": ["der", "Fluß", "geht", "ins", "$Meer"], None: ["α", "β%", "γ"]}
    rows = []
    for i in range(60):
        lang = r.choice(["en", "en", "en", "de", None])
        n = r.choice([0, 1, 2, 3, 40, 60, 80])
        text = "".join(r.choice(vocabulary[lang]) + r.choice([" ", "  ", "\n", "\n\n", "\t", "\r\n"]) for _ in range(n))
        rows.append((i, r.choice(["", " ", "\n"]) + text, lang))
    line = "one two three four five six"
    rows += [(100, None, "en"), (101, "", None), (102, " \n\t", "en"), (103, "\n".join([line, line + " ", line, "", " ", " ", "\r", line]), "en"), (104, "a a a a a", "xx"), (105, "zq#" * 3000 + " " + "x" * 70_000, "en"), (None, "no id", "de"), rows[5], rows[5]]
    rows.append((106, " ".join(chr(0x4E00 + r.randrange(9000)) for _ in range(70)), "en"))
    return rows


@pytest.mark.parametrize(("frequent", "block", "part"), [(1 << 21, 8_000_000, 1 << 20), (16, 3000, 64), (0.5, 500, 200)])
def test_rules(spark, monkeypatch, frequent, block, part):
    monkeypatch.setattr(kneser_ney, "FREQUENT", frequent)
    monkeypatch.setattr(kneser_ney, "BLOCK", block)
    monkeypatch.setattr(kneser_ney, "PART", part)
    monkeypatch.setattr(kneser_ney, "LETTERS", 20_000)
    rows = rule_documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).withColumns({c: F.lit("clash") for c in ("key", "n", "low", "total", "mean", "part", "block")})
    found = defaultdict(list)
    for x in kneser_ney.judged(df).collect():
        found[x["doc_id"]].append(x)
    assert sum(map(len, found.values())) == len(rows)
    scores = plain_model([(lang, text) for _, text, lang in rows])
    expected = {}
    for (doc_id, text, lang), (total, size) in zip(rows, scores, strict=True):
        counts = plain_rules(text)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        expected[doc_id] = (lang or "", counts, failed, -total / size)
        for x in found[doc_id]:
            assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == counts, doc_id
            assert x["base_failed"] == failed
            assert math.isclose(math.log10(x["perplexity"]), -total / size, rel_tol=1e-5), (doc_id, x["perplexity"], 10 ** (-total / size))
    # The bands, over all rows.
    means = defaultdict(list)
    for doc_id, _, _ in rows:
        lang, _, failed, mean = expected[doc_id]
        if not failed:
            means[lang].append(math.floor(mean * kneser_ney.BINS))
    band = {}
    for lang, values in means.items():
        values.sort()
        q1, q3 = (values[math.ceil(len(values) * q / 4) - 1] for q in (1, 3))
        wide = max((q3 - q1) / kneser_ney.BINS, kneser_ney.LEAST_RANGE)
        band[lang] = q1 / kneser_ney.BINS - kneser_ney.BELOW * wide, (q3 + 1) / kneser_ney.BINS + kneser_ney.ABOVE * wide
    for doc_id, (lang, _, failed, mean) in expected.items():
        assert all(x["kept"] == (not failed and band[lang][0] <= mean <= band[lang][1]) for x in found[doc_id]), doc_id
    assert not found[106][0]["kept"] and not found[106][0]["base_failed"]


def test_rules_of_many_languages(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i % 7}{k}" for k in range(60)), f"l{i % 5}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = sorted(kneser_ney.judged(df).collect())
    monkeypatch.setattr(kneser_ney, "LANGUAGES", 1)
    assert sorted(kneser_ney.judged(df).collect()) == few


def test_model_sums_to_one(spark):
    texts = ["the sea", "the shore", "sea shells"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    total, size = plain_model([("en", t) for t in texts])[0]
    got = {r["doc_id"]: r for r in kneser_ney.perplexities(df).collect()}
    assert got[0]["symbols"] == size == 8 and math.isclose(got[0]["total"], total, rel_tol=1e-5)


# -- runs


def plain_runs(words):
    seen = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            if words[i] == words[i + p]:
                j = i
                while j + p < len(words) and words[j] == words[j + p]:
                    j += 1
                if j - i >= p:
                    seen.setdefault((i, j + p), p)
                i = j
            else:
                i += 1
    return sorted((a, e, p) for (a, e), p in seen.items())


def plain_document(doc_id, text, rewrite):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if rewrite and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = [(a, e - a, q) for a, e, q in plain_runs(words) if e - a >= max(12, 2 * q)]
    found.sort(key=lambda r: (r[0], r[2]))
    out = {i for a, size, q in found for i in range(a + q, a + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    listed = "".join(f"{a},{size},{q}\n" for a, size, q in found)
    left = " ".join(w for i, w in enumerate(words) if i not in out)
    return doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, left))


def hashed(words):
    return kernel.mix(np.array(words, np.uint64) + np.uint64(3))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80))
def test_runs_of_few_words(words):
    assert [tuple(r) for r in sorted(runs.runs(hashed(words)).tolist())] == [tuple(x) for x in plain_runs(words)]


def test_runs_of_famous_words():
    a, b = [0], [0, 1]
    while len(b) < 500:
        a, b = b, b + a
    for words in (b, [bin(i).count("1") & 1 for i in range(512)], [0] * 300, [int(i % 37 == 0) for i in range(400)], list(range(300)), ([0, 1, 2] * 40 + [3]) * 4):
        assert [tuple(r) for r in sorted(runs.runs(hashed(words)).tolist())] == [tuple(x) for x in plain_runs(words)]


def test_runs_of_a_very_long_text():
    found = runs.runs(hashed([i % 50_000 for i in range(1_000_000)]))
    assert found.tolist() == [[0, 1_000_000, 50_000]]


def run_documents(seed=9):
    r = random.Random(seed)
    rows = []
    for i in range(300):
        words = [r.choice(["a", "b", "A", "é,", "long" * 30]) for _ in range(r.choice([0, 1, 5, 13, 40, 150]))]
        rows.append((i, r.choice(["", "  "]) + "".join(w + r.choice([" ", "\n", "\t \r"]) for w in words)))
    return [*rows, (400, None), (401, ""), (402, " \n"), (403, "x " * 3000), (404, "x"), (None, "a b " * 10), (None, None), rows[4], rows[4], (405, "y" * 100_000 + " y" * 20)]


@pytest.mark.parametrize("rewrite", [True, False])
def test_periodic_runs(spark, rewrite):
    rows = run_documents()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).withColumns({c: F.lit("clash") for c in ("check", "start", "n_runs")})
    got = [tuple(r) for r in runs.periodic_runs(df, rewrite).collect()]
    expected = [plain_document(*row, rewrite) for row in rows]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert sum(r[1] > 0 for r in expected) > (10 if rewrite else 2)


# -- clusters


def plain_clusters(vectors, k=8, rounds=10):
    points = [q for _, q in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), q) for i, q in vectors)][:k]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, p, strict=True)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        of = [nearest(q)[1] for _, q in vectors]
        for c in set(of):
            mine = [q for (_, q), o in zip(vectors, of, strict=True) if o == c]
            points[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return points, [(i, *nearest(q)) for i, q in vectors]


def test_tree_finds_the_nearest():
    r = np.random.default_rng(3)
    for n, spread in ((0, 5), (1, 5), (2, 1), (8, 1), (8, 2), (8, 1000), (40, 2), (200, 3)):
        points = r.integers(-spread, spread + 1, (n, centroids.WIDTH)) if spread > 2 else np.repeat(r.integers(-spread, spread + 1, (n, 1)), centroids.WIDTH, axis=1)
        vectors = np.concatenate((r.integers(-spread, spread + 1, (300, centroids.WIDTH)), points, (points + np.roll(points, 1, axis=0)) // 2))
        number, best = centroids.Tree(points).nearest(vectors)
        if n:
            apart = ((vectors[:, None] - points[None]) ** 2).sum(axis=2)
            assert (number == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()


@pytest.mark.parametrize("kind", ["spread", "ties", "few", "large"])
def test_clusters(spark, monkeypatch, kind):
    monkeypatch.setattr(centroids, "ROWS", 16)
    r = random.Random(6)
    rows = []
    for i in range(5 if kind == "few" else 120):
        c = r.randrange(5)
        x = {"spread": lambda: c + r.gauss(0, 0.7), "ties": lambda: r.choice([0.0, 1.0]) if i % 2 else 0.5, "few": lambda: r.random(), "large": lambda: r.uniform(-1e4, 1e4)}[kind]
        rows.append((i, [float(np.float32(x())) for _ in range(64)], c))
    if kind == "ties":
        rows = [(i, [v[i % 3]] * 64, c) for i, v, c in rows]
    rows += [rows[1], (rows[0][0], rows[2][1], 0)]
    bad = [(900, None, 1), (901, [0.0] * 63, 1), (902, [None] + [0.0] * 63, 1), (903, [math.nan] + [0.0] * 63, 1), (904, [math.inf] * 64, 1), (905, [], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumn("cluster", F.lit("clash")).repartition(3)
    got = centroids.clustered(df).collect()
    points, expected = plain_clusters([(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows])
    assert sorted((x["vec_id"], x["distance"], x["cluster"]) for x in got) == sorted(expected)
    inertia = Counter()
    for _, d, c in expected:
        inertia[c] += d
    for x in got:
        assert x["cluster_inertia"] == inertia[x["cluster"]] and x["inertia"] == sum(inertia.values())
        assert x["centroid_sha256"] == hashlib.sha256(",".join(map(str, points[x["cluster"]])).encode()).hexdigest()


def test_clusters_without_vec_id_and_beyond_a_long(spark):
    rows = [(None, [1.0] * 64), (1, [1e30] * 64), (2, [-1e30] * 64), (None, [1.0] * 64)]
    got = centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 4 and all(x["distance"] == 0 for x in got)


@pytest.mark.parametrize("name", ["op11_kneser_ney_rules", "op12_dyadic_square_runs", "op13_vantage_point_clusters"])
def test_queries(spark, tables, tmp_path, name):
    """A row for each of the table, and none for an empty one."""
    of = "embeddings" if "13" in name else "documents"
    df = queries.QUERIES[name](spark, tables)
    assert df.count() == spark.read.parquet(f"{tables}/{of}.parquet").count()
    spark.read.parquet(f"{tables}/{of}.parquet").limit(0).write.parquet(f"{tmp_path}/{of}.parquet")
    nothing = queries.QUERIES[name](spark, str(tmp_path))
    assert nothing.collect() == [] and nothing.columns == df.columns


def test_rewritten_documents(spark, tables):
    """The query against the plain version, over the whole small table."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").collect() if len(r["text"] or "") < 8000}
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op12_dyadic_square_runs"](spark, tables).collect()}
    for doc_id, text in itertools.islice(docs.items(), 200):
        assert got[doc_id] == plain_document(doc_id, text, True)
