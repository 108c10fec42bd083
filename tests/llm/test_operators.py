"""Each operator against a plain version of what it computes, on small fixtures with awkward rows."""

import hashlib
import math
import random
import zlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litmill.llm import kernel, langid, lattice, license_scan, line_crf, ngram_join, ppm, sample, toxicity, urlfilter, winnow
from litmill.llm.components import connected_components

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, lang=None):
    rows = [(i, t, (lang or {}).get(i, "en"), "src0", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def near_texts(seed=5):
    """Groups of near copies, exact copies, shared passages, and awkward texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefgé", k=r.randint(2, 6))) for _ in range(300)]
    passage = " ".join(r.choices(vocabulary, k=25))
    texts, i = [], 0
    for group in range(8):
        base = r.choices(vocabulary, k=r.choice([6, 30, 80, 150]))
        for _ in range(r.choice([1, 3, 12])):
            words = list(base)
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            texts.append((i, " ".join(words) + (" " + passage if group % 2 else "")))
            i += 1
    extra = [None, "", " \n\t ", "one", "One", "one two three", "a b c d", "a b c d e", passage, passage.upper(), "x " * 3000, "y", "Ünï cödé wörds ünï cödé"]
    texts += [(i + k, t) for k, t in enumerate(extra)]
    return texts


def brute_components(texts, width, percent):
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_ngram_join(spark, width, percent):
    texts = near_texts()
    docs = frame(spark, texts)
    repeated = docs.unionAll(docs.where("doc_id = 3")).repartition(3)
    got = [tuple(r) for r in ngram_join.ngram_components(repeated, width, percent).collect()]
    want = brute_components(texts, width, percent)
    assert len(got) == len(texts) + 1
    assert {i: (n, c) for i, n, c in got} == want


def test_ngram_join_edges(spark):
    assert ngram_join.ngram_components(frame(spark, [])).count() == 0
    got = ngram_join.ngram_components(frame(spark, [(None, "a b"), (None, None), (4, "a b")])).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(None, 1, None), (None, 0, None), (4, 1, 4)]))


def test_ngram_join_hot(spark, monkeypatch):
    """A passage that most documents share, many blocks and fragments, split kinds, and two texts under one id."""
    monkeypatch.setattr(ngram_join, "BLOCK", 300)
    monkeypatch.setattr(ngram_join, "FRAGMENT", 200)
    monkeypatch.setattr(ngram_join, "KINDS", 3)
    r = random.Random(12)
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [(i, passage + " " + " ".join(r.choices("abcdefgh", k=r.randint(1, 6)))) for i in range(60)]
    texts += [(60 + i, " ".join(r.choices([f"w{k}" for k in range(40)], k=30)) + " " + passage) for i in range(20)]
    texts += [(80 + i, "w " * 5 + "x" * 3000 + " y" * i) for i in range(8)] + [(90, "k" * 200_000)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.ngram_components(frame(spark, texts).withColumn("node", F.lit("clash")).repartition(5), 4, 85).collect()}
    assert got == brute_components(texts, 4, 85)
    two = frame(spark, [(1, "a b c d e"), (1, "q r s t u v"), (0, "a b c d e"), (2, "q r s t u v"), (3, "z")])
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.ngram_components(two, 4, 85).collect())
    assert got == [(0, 2, 0), (1, 2, 0), (1, 3, 1), (2, 3, 1), (3, 1, 3)]


def test_hashes_have_no_structure():
    """Words that a polynomial hash modulo a power of two cannot tell apart."""
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    hashes, _ = kernel.word_hashes(*kernel.text_bytes(pa.array([word, other, word])))
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]
    of = [kernel.shingle_hashes(kernel.word_hashes(*kernel.text_bytes(pa.array([" ".join(w)])))[0], len(w))[0] for w in (word, other)]
    assert of[0] != of[1]


def test_one_of_each(spark):
    texts = near_texts()
    docs = frame(spark, texts)
    kept = ngram_join.one_of_each(docs.unionAll(docs.where("doc_id = 0")), 5, 80)
    assert kept.columns == docs.columns
    want = sorted({c for _, c in brute_components(texts, 5, 80).values()})
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(50)] + [(7, 7)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(parent)}


def test_bpe(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    from litmill.llm import bpe

    source = bpe.read_vocabulary(public.path("word_bpe_49k.json"))
    library = tokenizers.Tokenizer.from_str(source)
    library.no_truncation(), library.no_padding()
    r = random.Random(2)
    texts = [None, "", " ", "<|endoftext|>a <|startoftext|>", "ΑΣ ΟΔΟΣ İ", "it's 'LL 12345 x²½ 漢字 👩‍👩‍👧", "a\x1cb\x85c\u00a0d", "aaaa" * 500, "\u0558 \ua7ce\u1c89x"]
    texts += ["".join(r.choices("aabcdehinorst etaoin 'ñßé漢1!.\n", k=r.randint(0, 60))) for _ in range(300)]
    texts += ["".join(chr(r.choice([r.randint(32, 0x24F), r.randint(0x250, 0x2FFF)])) for _ in range(30)) for _ in range(200)]
    got = {x.doc_id: x for x in bpe.encoded(frame(spark, list(enumerate(texts))), source, "ids").collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids, t
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_marks_and_long_words():
    """Every combining mark behind others, every assigned character, and a word of five million letters."""
    import unicodedata

    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    from litmill.llm import bpe

    source = bpe.read_vocabulary(public.path("word_bpe_49k.json"))
    library, codec = tokenizers.Tokenizer.from_str(source), bpe.Codec(source)
    library.no_truncation(), library.no_padding()

    def ours(texts):
        ids, counts = codec.encode_all(texts)
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]

    marks = [chr(o) for o in range(0x300, 0x20000) if unicodedata.category(chr(o))[0] == "M"]
    texts = [f"a\u0308{m}b {m}\u0345 x{m}" for m in marks] + ["\u0308\u0899", "\u0345\u08ca", "\u0345\u089b"]
    texts += ["".join(f"a{chr(o + k)}b1{chr(o + k)} " for k in range(16)) for o in range(0, 0x20000, 16) if not 0xD7F0 < o < 0xE000]
    assert ours(texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    r = random.Random(13)
    word = "".join(r.choices("abcdeé", k=5_000_000))
    start = ours([word[:100_000]])[0]
    assert start == library.encode(word[:100_000], add_special_tokens=False).ids
    whole = ours([word])[0]  # minutes, were it not linear
    assert whole[: len(start) - 50] == start[:-50]
    text, _ = codec.decode(np.array(whole[:5000], np.uint32))
    assert text.tobytes()[:-1].decode() == library.decode(whole[:5000], skip_special_tokens=False)


@pytest.mark.parametrize("frequent,fragment", [(1 << 20, 10**9), (40, 200), (1, 10**9)])
def test_ppm(spark, monkeypatch, frequent, fragment):
    """With all, some or none of the entries sent out, in one fragment or several."""
    monkeypatch.setattr(ppm, "FREQUENT", (frequent, frequent))
    monkeypatch.setattr(ppm, "LETTERS", fragment)
    monkeypatch.setattr(ppm, "BLOCK_ROWS", 7)
    r = random.Random(4)
    texts = [(i, " ".join(r.choices(["the", "cat", "Sat", "önce", "matte"], k=r.randint(0, 12))) or None) for i in range(60)] + [(60, ""), (61, "zq " * 50), (62, "the Cat")]
    docs = frame(spark, texts).withColumn("key", F.lit("clash")).withColumn("n", F.lit(1))
    got = {x.doc_id: x for x in ppm.scored(docs.repartition(3)).collect()}
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in texts}
    count = Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(count.values()), len(count)
    symbols = {i: [255] * ppm.ORDER + list((t or "").translate(LOWER).encode()) + [254] for i, t in texts}
    seen = {}
    for i, s in symbols.items():
        for j in range(ppm.ORDER, len(s)):
            for o in range(ppm.ORDER + 1):
                if not held[i]:
                    seen.setdefault(tuple(s[j - o : j]), Counter())[s[j]] += 1

    def step(s, j):
        out, gone = 0.0, set()
        for o in range(ppm.ORDER, -1, -1):
            here = {a: k for a, k in seen.get(tuple(s[j - o : j]), {}).items() if a not in gone}
            if here:
                total = sum(here.values())
                if s[j] in here:
                    return out + math.log10((2 * here[s[j]] - 1) / (2 * total))
                out += math.log10(len(here) / (2 * total))
                gone |= set(here)
        return out - math.log10(ppm.SYMBOLS - len(gone))

    assert any(held.values()) and set(got) == set(tokens)
    for i, x in got.items():
        assert (x.held_out, x.n_tokens, x.train_tokens, x.n_known) == (held[i], len(tokens[i]), n, sum(count[w] > 0 for w in tokens[i]))
        assert x.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens[i]))
        assert x.score == pytest.approx(sum(step(symbols[i], j) for j in range(ppm.ORDER, len(symbols[i]))), rel=1e-5)


def test_ppm_sums_to_one():
    data, offsets = kernel.text_bytes(pa.array(["abab abba", "baab", ""]))
    trie = ppm.levels(*ppm.tally(ppm.grams(data, offsets)), ppm.ORDER, [])
    for context in (b"\xff\xff\xff\xff\xff", b"\xff\xffaba", b"zzzzz"):
        keys = (np.uint64(int.from_bytes(context, "big")) << np.uint64(8)) | np.arange(ppm.SYMBOLS, dtype=np.uint64)
        assert (10 ** ppm.log_probability(keys, trie)).sum() == pytest.approx(1.0, abs=1e-9)


def test_ppm_empty(spark):
    assert ppm.scored(frame(spark, [])).count() == 0


def test_language(spark):
    r = random.Random(6)
    words = {"en": ["the", "and", "thing", "with"], "de": ["der", "und", "nicht", "schön"], "fr": ["les", "été", "avec", "dans"], "es": ["los", "año", "pero", "muy"]}
    texts, langs = [], {}
    for i in range(400):
        lang = r.choice(list(words))
        texts.append((i, " ".join(r.choices(words[lang], k=r.randint(3, 40)))))
        langs[i] = lang
    texts += [(400, None), (401, ""), (402, "123 !?"), (403, "é")]
    docs = frame(spark, texts, langs).withColumn("score", F.lit("clash"))
    got = {x.doc_id: x for x in langid.identified(docs, langid.learn(docs, 3, 1)).collect()}
    assert len(got) == 404 and all(0 <= x.score <= 1 for x in got.values())
    assert np.mean([got[i].lang_pred == langs[i] for i in range(400)]) > 0.98
    assert [got[i].lang_pred for i in (400, 401, 402)] == ["und"] * 3 and got[403].lang_pred in words
    assert {x.lang_pred for x in langid.identified(docs, {}).collect()} == {"und"}
    assert langid.learn(frame(spark, []), 3, 1) == {}


def test_no_language_is_lost(spark):
    """Languages whose rows share few ids, or one text, or that have few rows beside many."""
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    text = F.concat_ws(" ", *[F.element_at(F.array(*map(F.lit, ["los", "pero", "muy", "casas", "niños"])), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(5)) + 1).cast("int")) for k in range(8)])
    row = spark.range(60_000).withColumn("text", F.concat_ws(" ", text, F.lit("x").cast("string")))
    shared = row.select(F.lit(ids[0]).alias("doc_id"), "text", F.lit("es").alias("lang"))
    same = spark.range(20_000).select(F.lit(ids[1]).alias("doc_id"), F.lit("les hommes avec des femmes dans la maison").alias("text"), F.lit("fr").alias("lang"))
    many = spark.range(40_000).select((F.col("id") + 1000).alias("doc_id"), F.concat(F.lit("the thing with words of "), F.col("id").cast("string"), F.lit(" and other things")).alias("text"), F.lit("en").alias("lang"))
    rare = spark.createDataFrame([(i, "der Mensch und nicht das schöne Haus", "de") for i in ids[2:12]], "doc_id long, text string, lang string")
    docs = shared.unionAll(same).unionAll(many).unionAll(rare)
    model = langid.learn(docs, 3, 1, sample=200)
    assert {a for kind, a, _ in model if kind == "lang"} == {"de", "en", "es", "fr"}
    probe = spark.createDataFrame([(1, "muy casas pero los niños"), (2, "avec les femmes dans la maison"), (3, "the other things with words"), (4, "das schöne Haus und der Mensch")], "doc_id long, text string")
    assert {x.doc_id: x.lang_pred for x in langid.identified(probe, model).collect()} == {1: "es", 2: "fr", 3: "en", 4: "de"}
    again = langid.learn(docs.repartition(7), 3, 1, sample=200)
    assert model.keys() == again.keys() and all((model[k] == again[k]).all() for k in model)


def test_forward_backward():
    rng = np.random.default_rng(0)
    per_text = np.array([3, 1, 4])
    unary, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    good, expected, total = line_crf.forward_backward(unary, moves, per_text)
    want, pairs, logs, at = [], np.zeros((2, 2)), 0.0, 0
    for n in per_text:
        u = unary[at : at + n]
        at += n
        scores = {y: sum(u[i] * y[i] for i in range(n)) + sum(moves[y[i - 1], y[i]] for i in range(1, n)) for y in __import__("itertools").product((0, 1), repeat=int(n))}
        z = sum(map(math.exp, scores.values()))
        logs += math.log(z)
        want += [sum(math.exp(s) for y, s in scores.items() if y[i]) / z for i in range(n)]
        for y, s in scores.items():
            for i in range(1, n):
                pairs[y[i - 1], y[i]] += math.exp(s) / z
    assert good == pytest.approx(want) and expected == pytest.approx(pairs) and total == pytest.approx(logs)


def labelled(spark, seed=7):
    r = random.Random(seed)
    texts, labels = [], []
    for i in range(300):
        bad, toxic = r.random() < 0.3, r.random() < 0.3
        words = r.choices(["calm", "sea", "walks", "under", "trees", "Light"], k=30)
        if toxic:
            words[r.randrange(30)] = r.choice(["idiot", "Scum,"])
        texts.append((i, " | ".join(words) + "\n###$$$ ***" if bad else " ".join(words) + ".\nA line."))
        labels.append((i, int(not bad), int(toxic)))
    texts += [(900, None), (901, ""), (902, "\n\n")]
    return frame(spark, texts).withColumn("score", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled(spark)
    model = line_crf.learn(docs, sample.sample_of(labels, "quality", 5, 0, 200))
    got = {x.doc_id: x for x in line_crf.quality(docs, model).collect()}
    assert len(got) == 303 and all(0 <= x.score <= 1 for x in got.values())
    want = {x.doc_id: x.quality for x in labels.collect()}
    assert np.mean([(got[i].score >= 0.3) == (want[i] == 1) for i in want]) > 0.97
    assert line_crf.learn(docs, sample.sample_of(labels.where("quality = 1"), "quality", 5, 0, 200)) is None
    assert {x.score for x in line_crf.quality(docs, None).collect()} == {0.5}
    assert line_crf.quality(frame(spark, []), model).count() == 0


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.learn(docs, sample.sample_of(labels, "toxic", 4, 2, 250))
    got = {x.doc_id: x for x in toxicity.toxicity(docs, model).collect()}
    want = {x.doc_id: x.toxic for x in labels.collect()}
    assert np.mean([(got[i].score >= 0.3) == (want[i] == 1) for i in want]) > 0.95
    assert len(model[0]) < 2000
    assert toxicity.learn(docs, sample.sample_of(labels.limit(0), "toxic", 4, 2, 250))[2] == 0.0


def test_lattice():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 3
    p = lattice.nearest_e8(x)
    assert len(np.unique(lattice.STEPS, axis=0)) == 240
    assert ((p % 2 == p[:, :1] % 2).all(axis=1) & (p.sum(axis=1) % 4 == 0)).all()
    near = ((2 * x - p) ** 2).sum(axis=1)
    assert (near[:, None] <= ((2 * x[:, None] - p[:, None] - lattice.STEPS[None]) ** 2).sum(axis=2) + 1e-9).all()


@pytest.mark.parametrize("crowd,cell", [(8_000_000, 1000), (6, 3)])
def test_near_duplicates(spark, monkeypatch, crowd, cell):
    """With one projection a bucket, and with two and cells that are split."""
    monkeypatch.setattr(lattice, "CROWD", crowd)
    monkeypatch.setattr(lattice, "CELL", cell)
    monkeypatch.setattr(lattice, "BLOCK", cell)
    rng = np.random.default_rng(2)
    rows, i = [], 0
    for label in (0, 1):
        for _ in range(6):
            centre = rng.normal(size=16)
            for _ in range(rng.integers(1, 9)):
                rows.append((i, (centre + 0.12 * rng.normal(size=16)).tolist(), label))
                i += 1
    rows += [(i, rows[0][1], 0), (i + 1, rows[0][1], 0), (i + 2, [2 * a for a in rows[0][1]], 0), (i + 3, rows[0][1], 1)]
    odd = [(i + 4, None, 0), (i + 5, [0.0] * 16, 0), (i + 6, [math.nan] * 16, 0), (i + 7, [math.inf] * 16, 0), (i + 8, [None, 1.0], 0), (i + 9, rows[0][1], None), (i + 10, [], 0), (i + 11, rows[0][1][:5], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("cell", F.lit("clash"))
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in lattice.near_duplicates(df).collect()}
    links = {a: set() for a, *_ in rows}
    for a, v, l in rows:
        for b, w, m in rows:
            if a != b and l == m and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[a].add(b)

    def reach(a):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return min(seen)

    for a in links:
        assert got[a] == (len(links[a]), reach(a), reach(a) == a), a
    assert all(got[a] == (0, a, True) for a, *_ in odd)
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_repeats(spark):
    """Repeated ids with equal and other vectors, a null id, clashing columns."""
    a, b, c = [1.0, 0.0, 0.1], [1.0, 0.01, 0.1], [0.0, 1.0, 0.0]
    rows = [(1, a, "x"), (1, a, "x"), (2, b, "x"), (3, c, "x"), (3, b, "x"), (None, a, "x"), (4, a, "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumns({"v": F.lit("clash"), "node": F.lit(0), "copies": F.lit(1)})
    got = sorted(repr(tuple(r)) for r in lattice.near_duplicates(df).collect())
    # The second vector of 3 equals that of 2, so it is a copy of it and links with 1.
    assert got == sorted(map(repr, [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (3, 2, 1, False), (None, 0, None, True), (4, 0, 4, True)]))


@pytest.mark.parametrize("dim,depth,tables,least", [(16, 1, 4, 0.98), (64, 1, 4, 0.98), (384, 1, 4, 0.98), (64, 2, 6, 0.95)])
def test_lattice_recall(dim, depth, tables, least):
    """How many pairs of exactly the least similarity meet in a bucket: at least 0.9 is asked of an index, these do better."""
    rng = np.random.default_rng(dim)
    x, g = rng.normal(size=(2, 3000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g -= (g * x).sum(axis=1, keepdims=True) * x
    z = 0.98 * x + np.sqrt(1 - 0.98**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    found = []
    for rows in (x, z):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["node", "v"])
        own, near = {}, {}
        for out in lattice._cells_of(batch, 0.98, depth):
            for i, t, c, o in zip(*(out.column(n).to_pylist() for n in ("node", "table", "cell", "own")), strict=True):
                near.setdefault(i, set()).add((t, c))
                if o:
                    own.setdefault(i, set()).add((t, c))
        found.append((own, near))
    (own_x, near_x), (own_z, near_z) = found
    assert len(own_x[0]) == tables
    assert np.mean([bool(own_x[i] & near_z[i] or own_z[i] & near_x[i]) for i in range(len(x))]) > least


def brute_contamination(docs, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w = word.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_contamination(spark):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "ñandú"]
    items = [(i, " ".join(r.choices(vocabulary, k=k))) for i, k in enumerate([40, 13, 14, 30, 12, 5, 3, 1, 25])] + [(20, None), (21, "..."), (22, "aa " * 30)]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 80)))) for i in range(30)]
    for i in range(30, 60):
        w = r.choices([f"v{k}" for k in range(500)], k=60)
        source = (r.choice([t for _, t in items if t]).upper()).split()
        a = r.randrange(len(source))
        w[20:20] = source[a : a + r.randint(1, 40)]
        docs.append((i, ", ".join(w)))
    docs += [(60, None), (61, ""), (62, "aa " * 50), (63, items[0][1] + "\n" + items[0][1])]
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    d = frame(spark, docs)
    got = [tuple(x) for x in winnow.contamination(d.unionAll(d.where("doc_id = 40")), b).collect()]
    assert len(got) == len(docs) + 1
    assert {x[0]: x[1:] for x in got} == brute_contamination(docs, items)
    assert winnow.contamination(d, b.limit(0)).where("n_hit > 0").count() == 0
    assert winnow.contamination(d.limit(0), b).count() == 0


def test_contamination_awkward(spark, monkeypatch):
    """Joins that shuffle; long texts of few words; two texts under one id; null ids; clashing columns."""
    monkeypatch.setattr(winnow, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(winnow, "CANDIDATES", -1)
    r = random.Random(9)
    items = [(1, "aa " * 40), (1, " ".join(f"q{k}" for k in range(20))), (2, "bb cc " * 10), (None, "zz zz"), (3, "one two")]
    docs = [(1, "aa " * 20_000), (2, " ".join(r.choices(["bb", "cc"], k=5000))), (3, " ".join(f"q{k}" for k in range(25))), (4, "x one TWO y"), (None, "one two"), (None, "one two"), (5, "b" * 100_000)]
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("tokens", F.lit("clash")).withColumn("span", F.lit(2))
    d = frame(spark, docs).withColumn("hash", F.lit("clash")).withColumn("items", F.lit(1)).repartition(3)
    want = brute_contamination([(i if i is not None else -1, t) for i, t in docs], [x for x in items if x[0] is not None])
    got = [tuple(x) for x in winnow.contamination(d, b).collect()]
    assert sorted((x[0] if x[0] is not None else -1, *x[1:]) for x in got) == sorted((i if i is not None else -1, *want[i if i is not None else -1]) for i, _ in docs)


def test_contamination_is_native(spark):
    d, b = frame(spark, [(1, "a b c")]), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = winnow.contamination(d, b)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_licenses(spark):
    mit = next(t for n, t in license_scan.KNOWN if n == "MIT" and len(t) > 500)
    texts = [(1, "Copyright (c) 2020 Jane Doe\n\n" + mit.replace("\n", "\n\n").upper()), (2, mit + " and more"), (3, "Prose.\n  released under the mit LICENCE!\nMore."), (4, None), (5, ""), (6, "© 2021 Me\nAll rights reserved.\nText")]
    got = {x.doc_id: (x.license, x.notices) for x in license_scan.scanned(frame(spark, texts)).collect()}
    assert got == {1: ("MIT", ""), 2: (None, ""), 3: (None, "MIT"), 4: (None, ""), 5: (None, ""), 6: (None, "")}


def test_urls(spark):
    urls = ["HTTP://Sub.Example.NET/en/x?q#f", "https://example.net/fr/", "http://a.example.com/de/x", "http://x.org/fr/1", "http://x.org/en/", "m.casino-win.example.com/a", "http://m.casino-win.example.com", "http://CASINO-win.example.com?x", "http://notexample.net", None, "", "http://", "x://example.net", "http://a.org/de/http://b.net/fr/", "http://" + "a." * 5000 + "net/" + "x/" * 5000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = {x.page_id: x for x in urlfilter.filtered(spark, df).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(14)] == [("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow")]
    assert (got[0].host, got[0].path, got[14].rule) == ("sub.example.net", "/en/x", "net/")


def test_digest_array(spark):
    block = urlfilter.packed(spark.createDataFrame([("b",), ("a",), (None,), ("éa",), ("a",)], "entry string"))
    held = urlfilter.DigestArray(np.frombuffer(block, np.uint8))
    assert held.holds(["a", "c", "éa", ""]).tolist() == [True, False, True, False]
    assert urlfilter.DigestArray(np.frombuffer(urlfilter.packed(spark.createDataFrame([], "entry string")), np.uint8)).holds(["a"]).tolist() == [False]


@pytest.mark.parametrize("most", [10**9, 0])
def test_long_blocklist(spark, monkeypatch, most):
    """A table of entries, sent out whole or joined, against plain matching."""
    monkeypatch.setattr(urlfilter, "ENTRIES", most)
    r = random.Random(11)
    listed = spark.range(300_000).select(F.concat(F.lit("h"), F.pmod(F.xxhash64("id"), F.lit(200_000)), F.lit(".example.org")).alias("host"), F.when(F.col("id") % 3 == 0, "/").otherwise("/a/").alias("path"))
    listed = listed.unionAll(spark.createDataFrame([(None, "/"), ("x.net", None), ("k.com", "/a/b/")], "host string, path string"))
    entries = {(x.host, x.path) for x in listed.collect() if x.host and x.path}
    urls = [f"http://{r.choice(['', 'm.', 'a.b.'])}h{r.randrange(400_000)}.example.org{r.choice(['', '/', '/a', '/a/', '/a/x', '?q'])}" for _ in range(2000)] + ["http://k.com/a/b/c", "http://k.com/a/", None]
    df = spark.createDataFrame([(i % 1990, u) for i, u in enumerate(urls)] + [(None, "http://k.com/a/b/")], "page_id long, url string")
    got = Counter((x.page_id, x.host, x.path, x.verdict) for x in urlfilter.filtered(spark, df, listed, ()).collect())

    def plain(url):
        rest = (url or "").partition("://")[2]
        host, path = re.match("([^/?#]*)([^?#]*)", rest).groups()
        labels = host.split(".")
        fits = any((".".join(labels[k:]), p) in entries for k in range(len(labels)) for p in ("/", "/a/", "/a/b/") if path.startswith(p) or (p == "/" and not path))
        return host, path, "block" if fits else "allow"

    assert got == Counter((x.page_id, *plain(x.url)) for x in df.collect())
    assert urlfilter.filtered(spark, df.limit(0), listed, ()).count() == 0


def test_kernel_blocks(monkeypatch):
    texts = ["", "Ab ab\tAB", "x" * 50, "a " * 40, "é\x0bé"]
    whole = kernel.word_hashes(*kernel.text_bytes(pa.array(texts)))
    monkeypatch.setattr(kernel, "BLOCK", 7)
    cut = kernel.word_hashes(*kernel.text_bytes(pa.array(texts)))
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all() and whole[1].tolist() == [0, 3, 1, 40, 2]
    assert whole[0][0] == whole[0][1] == whole[0][2]


def test_pipeline(spark, tables):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    ids = {x.doc_id for x in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    out = corpus_pipeline.run(spark, tables)
    assert {x.doc_id for x in out.select("doc_id").collect()} < ids
