"""The ten queries and the pipeline on tables with awkward rows, against plain versions of what they compute."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from litmill.llm import kernel, langid, line_crf, queries, toxicity
from litmill.llm.sample import sample_of
from tests.llm.test_operators import LOWER, brute_components, brute_contamination

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": ["the", "thing", "with", "walks"], "de": ["der", "nicht", "schön", "und"], "fr": ["les", "été", "avec", "dans"], "es": ["los", "año", "pero", "muy"]}


def held(doc_id, by, left_out):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % by == left_out


def documents(seed=21, n=160):
    r = random.Random(seed)
    rows, labels = [], []
    item = " ".join(f"bench{k}" for k in range(20))
    for i in range(n):
        lang = r.choice(list(WORDS))
        lines = [" ".join(r.choices(WORDS[lang], k=r.randint(2, 9))) + "." for _ in range(r.randint(1, 7))]
        bad, toxic = r.random() < 0.3, r.random() < 0.3
        if bad:
            lines = ["### | $$$ " + line.replace(" ", " | ") for line in lines] + ["!!!"]
        if toxic:
            lines[r.randrange(len(lines))] += " " + r.choice(["idiot", "Scum,", "idiot scum"])
        if i % 20 == 3:
            lines.append(item)
        rows.append((i, "\n".join(lines), None if i % 11 == 0 else lang, "src", 1))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(n, None, "en", "s", 0), (n + 1, "", None, None, None), (n + 2, " \n\t", "en", "s", 0), (n + 3, "12 !?", "en", "s", 0), (n + 4, "the " * 30_000 + "\n" * 3000, "en", "s", 1), (n + 5, rows[3][1], "en", "s", 1), (None, "the thing", "en", "s", 1), (None, None, None, None, None), rows[5], rows[5], (7, "der der schön", "de", "s", 1)]
    labels += [(5, 0, 1), (5, 1, 0), (None, 1, 1), (8, None, None), (n + 1, 1, 0), (10_000, 1, 1)]
    return rows, labels, item


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    rows, labels, item = documents()
    d = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit("clash") for n in ("score", "predicted", "label", "node", "tokens", "key", "row", "held_out")})
    d.repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "muy muy muy pero"), (3, None), (3, "..."), (None, "the")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (2, [1.0, 0.01], 1), (3, None, 1), (None, [1.0, 0.0], 1), (4, [1.0, 0.0], None)], "vec_id long, embedding array<double>, label int").withColumn("cell", F.lit("clash")).write.parquet(f"{base}/embeddings.parquet")
    spark.createDataFrame([(1, "http://a.net/x", "h"), (1, "http://a.net/x", "h"), (None, None, None), (2, "", ""), (3, "http://" + "b." * 3000 + "org/fr/", "h")], "page_id long, url string, html string").withColumn("rule", F.lit("clash")).write.parquet(f"{base}/pages.parquet")
    return base


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "embeddings", "pages"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{base}/{name}.parquet")
    return base


COLUMNS = {
    "op1_ngram_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op2_bpe_codec": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op3_ppm_scores": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op4_hierarchical_langid": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_line_crf_quality": ["doc_id", "held_out", "score", "predicted"],
    "op6_e8_near_duplicates": ["vec_id", "n_links", "component_id", "kept"],
    "op7_winnowing_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op8_license_digests": ["doc_id", "license", "notices"],
    "op9_sorted_digest_urls": ["page_id", "host", "path", "rule", "verdict"],
    "op10_ftrl_toxicity": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_empty_tables(spark, empty, name):
    got = queries.QUERIES[name](spark, empty)
    assert got.columns == COLUMNS[name] and got.count() == 0


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_a_row_for_each(spark, folder, name):
    """Every row of the table has one, repeated rows alike, and ids are as they were."""
    source = {"op6_e8_near_duplicates": ("embeddings", "vec_id"), "op9_sorted_digest_urls": ("pages", "page_id")}.get(name, ("documents", "doc_id"))
    got = queries.QUERIES[name](spark, folder).collect()
    ids = Counter(r[0] for r in spark.read.parquet(f"{folder}/{source[0]}.parquet").select(source[1]).collect())
    assert Counter(r[0] for r in got) == ids
    repeated = Counter(tuple(r) for r in got if r[0] == 5)
    assert len(repeated) <= 1


@pytest.mark.parametrize("name,by,left_out", [("op3_ppm_scores", 7, 2), ("op4_hierarchical_langid", 3, 1), ("op5_line_crf_quality", 5, 0), ("op10_ftrl_toxicity", 4, 2)])
def test_folds_and_calls(spark, folder, name, by, left_out):
    for x in queries.QUERIES[name](spark, folder).collect():
        assert x.held_out == held(x.doc_id, by, left_out)
        if "predicted" in x:
            assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3)


def test_joins(spark, folder):
    rows, _, _ = documents()
    named = [(i, t) for i, t, *_ in rows if i is not None and i != 7]
    want = brute_components(named, 4, 85)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in queries.op1_ngram_jaccard_join(spark, folder).where("doc_id <> 7").collect()}
    assert got == want
    items = [(1, " ".join(f"bench{k}" for k in range(20))), (2, "muy muy muy pero")]
    found = {x[0]: tuple(x)[1:] for x in queries.op7_winnowing_decontamination(spark, folder).where("doc_id <> 7").collect()}
    assert found == brute_contamination(named, items)


def test_tokens(spark, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    library.no_truncation(), library.no_padding()
    rows, _, _ = documents()
    want = Counter()
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(x) for x in queries.op2_bpe_codec(spark, folder).collect()) == want


def plain_labels(labels, which, by, left_out):
    out = {}
    for i, *values in labels:
        if i is not None and values[which] is not None and not held(i, by, left_out):
            out[i] = max(values[which], out.get(i, 0))
    return out


def plain_texts(rows):
    """The text that is learned from under each id: the least."""
    out = {}
    for i, t, *_ in rows:
        if i is not None:
            out[i] = min(t or "", out.get(i, t or ""))
    return out


def plain_ftrl(texts, labels, order):
    """Weights by feature, as words and not as slots."""
    z, n = Counter(), Counter()

    def weight(f):
        l1 = 0.0 if f == "bias" else toxicity.L1
        return 0.0 if abs(z[f]) <= l1 else -(z[f] - math.copysign(l1, z[f])) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for i in order:
            found = [*plain_features(texts[i]), "bias"]
            w = {f: weight(f) for f in found}
            g = 1 / (1 + math.exp(-sum(w.values()))) - labels[i]
            for f in found:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * w[f]
                n[f] += g * g
    return weight


def plain_features(text):
    import re

    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return {("one", a) for a in w} | {("two", a, b) for a, b in zip(w, w[1:], strict=False)} | {("skip", a, b) for a, b in zip(w, w[2:], strict=False)}


def test_toxicity_scores(spark, folder):
    rows, labels, _ = documents()
    texts, known = plain_texts(rows), plain_labels(labels, 1, 4, 2)
    known = {i: y for i, y in known.items() if i in texts}
    order = sorted(known, key=lambda i: int(kernel.mix(np.array([i], np.uint64))[0]))
    weight = plain_ftrl(texts, known, order)
    for x in queries.op10_ftrl_toxicity(spark, folder).where("doc_id <> 7").collect():
        text = next(t for i, t, *_ in rows if i == x.doc_id) if x.doc_id is not None else None
        if x.doc_id is not None:
            total = sum(weight(f) for f in plain_features(text)) + weight("bias")
            assert x.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6), x.doc_id


def plain_line(line, before):
    """Features of one line of bytes."""
    share = [sum(bool(c[b]) for b in line) / max(len(line), 1) for c in line_crf.CLASSES]
    words = line.translate(bytes(LOWER.get(i, i) for i in range(256))).split()
    repeats = sum(a == b for a, b in zip(([before] if before else []) + words, words if before else words[1:], strict=False))
    return [*share, math.log1p(len(line)), repeats / max(len(words), 1), min(len(line) / max(len(words), 1), 40) / 10, float(not line), math.log1p(len(words))]


def plain_quality(model, text):
    """Score of a short text by summing over all labellings of its lines."""
    raw = (text or "").encode()
    parts = raw.split(b"\n")
    lines = [p + (b"\n" if k < len(parts) - 1 else b"") for k, p in enumerate(parts)]
    own, last = [], None
    for line in lines:
        own.append(plain_line(line, last))
        words = line.translate(bytes(LOWER.get(i, i) for i in range(256))).split()
        last = words[-1] if words else last
    blank = [0.0] * len(own[0])
    x = np.array([own[k] + (own[k - 1] if k else blank) + (own[k + 1] if k + 1 < len(own) else blank) + [float(k == 0), float(k == len(own) - 1)] for k in range(len(own))], np.float32)
    unary = ((x - model["mean"]) / model["spread"]) @ model["weights"][:-1] + model["weights"][-1]
    total, good = 0.0, np.zeros(len(lines))
    for y in itertools.product((0, 1), repeat=len(lines)):
        p = math.exp(sum(u * b for u, b in zip(unary, y, strict=True)) + sum(model["moves"][a, b] for a, b in zip(y, y[1:], strict=False)))
        total += p
        good += p * np.array(y)
    size = np.maximum([len(line) for line in lines], 1)
    return float((good / total * size).sum() / size.sum())


def test_quality_scores(spark, folder):
    rows, _, _ = documents()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = line_crf.learn(docs, sample_of(spark.read.parquet(f"{folder}/labels.parquet"), "quality", 5, 0, line_crf.SAMPLE))
    got = {x.doc_id: x.score for x in queries.op5_line_crf_quality(spark, folder).where("doc_id is not null and doc_id <> 7").collect()}
    checked = 0
    for i, t, *_ in rows:
        if i is not None and i != 7 and (t or "").count("\n") < 9:
            assert got[i] == pytest.approx(plain_quality(model, t), abs=1e-4), i
            checked += 1
    assert checked > 150


def plain_language(model, text):
    """Language and score of a text, byte by byte."""
    raw = (text or "").encode()
    code = [c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in raw]
    counts = Counter(((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - langid.BITS) for a, b, c in zip(code, code[1:], code[2:], strict=False))
    counts.pop((0x202020 * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - langid.BITS), None)
    norm = math.sqrt(sum(counts.values())) or 1.0
    x = {s: math.sqrt(n) / norm for s, n in counts.items()}

    def margin(w):
        return 1 / (1 + math.exp(-4 * max(-8, min(8, sum(w[s] * v for s, v in x.items()) + w[-1]))))

    names = sorted(a for kind, a, _ in model if kind == "lang")
    families = sorted({langid.family(a) for a in names})
    share = {f: margin(model["family", f, ""]) for f in families}
    best = max(families, key=lambda f: share[f])
    inside = [a for a in names if langid.family(a) == best]
    votes = Counter()
    for a, b in itertools.combinations(inside, 2):
        p = margin(model["pair", a, b])
        votes[a] += (p >= 0.5) + p / len(inside)
        votes[b] += (p < 0.5) + (1 - p) / len(inside)
    winner = max(inside, key=lambda a: votes[a])
    return winner, share[best] / sum(share.values()) * (votes[winner] / sum(votes.values()) if votes else 1.0)


def test_languages(spark, folder):
    rows, _, _ = documents()
    model = langid.learn(spark.read.parquet(f"{folder}/documents.parquet"), 3, 1)
    got = {x.doc_id: x for x in queries.op4_hierarchical_langid(spark, folder).where("doc_id is not null and doc_id <> 7").collect()}
    right = 0
    for i, t, lang, *_ in rows:
        if i is None or i == 7:
            continue
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        want, score = plain_language(model, t)
        assert got[i].lang_pred == want and got[i].score == pytest.approx(score, abs=1e-3), i
        right += got[i].lang_pred == lang
    assert right > 130


def test_pipeline_stages(spark, folder):
    """Each stage against the plain versions, on what the one before it kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    bench = [(1, " ".join(f"bench{k}" for k in range(20))), (2, "muy muy muy pero")]

    def rows_of(df):
        return sorted(map(repr, (tuple(r) for r in df.collect())))

    kept = corpus_pipeline.toxicity(spark, docs, folder)
    scores = queries.toxicity_of(spark, folder, docs.select("doc_id", "text")).where("predicted = 1").select("doc_id", "text").distinct()
    want = docs.join(scores.withColumnsRenamed({"doc_id": "i", "text": "t"}), F.col("doc_id").eqNullSafe(F.col("i")) & F.col("text").eqNullSafe(F.col("t")), "left_anti")
    assert kept.columns == columns and rows_of(kept) == rows_of(want)
    kept = corpus_pipeline.quality(spark, docs, folder)
    good = queries.quality_of(spark, folder, docs.select("doc_id", "text")).where("predicted = 1").select("doc_id", "text").distinct()
    want = docs.join(good.withColumnsRenamed({"doc_id": "i", "text": "t"}), F.col("doc_id").eqNullSafe(F.col("i")) & F.col("text").eqNullSafe(F.col("t")), "left_semi")
    assert kept.columns == columns and rows_of(kept) == rows_of(want)
    named = docs.where("doc_id <> 7 or doc_id is null")
    kept = corpus_pipeline.near_copies(spark, named, folder)
    texts = [(r.doc_id, r.text) for r in named.collect() if r.doc_id is not None]
    classes = brute_components(texts, 5, 80)
    assert kept.columns == columns and Counter(r.doc_id for r in kept.collect()) == Counter({c for _, c in classes.values()}) + Counter({None: 2})
    kept = corpus_pipeline.decontamination(spark, named, folder)
    dirty = {i for i, found in brute_contamination(texts, bench).items() if found[-1]}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {i for i, _ in texts} - dirty | {None}
    tokens = corpus_pipeline.tokens(spark, named, folder)
    assert tokens.count() == named.count() and all(len(r.ids) == r.n_tokens for r in tokens.collect())


@pytest.mark.parametrize("where", ["folder", "empty"])
def test_whole_pipeline(spark, request, where):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, request.getfixturevalue(where))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    if where == "empty":
        assert got.count() == 0
    else:
        ids = [r.doc_id for r in got.collect() if r.doc_id is not None]
        assert ids and len(ids) == len(set(ids)) and None in [r.doc_id for r in got.collect()]
