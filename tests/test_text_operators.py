"""Folds, iterations and similarities that SQL cannot say, against plain versions on small fixtures."""

import difflib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from litmill.functions import similarity
from litmill.functions.names import parsed
from litmill.operators import library, linkage, retrieval, textmine
from litmill.plans import dsl
from litmill.sources import records, tei


def texts(seed, n=25):
    r = random.Random(seed)
    words = ["network", "networks", "of", "Deep", "graph", "sparse", "the", "model", "x", "C++", "state-of", "learning", "2d", "and"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 60))).replace("graph and", "graph. And"), " ".join(r.choices(words, k=3))) for i in range(n)]
    return rows + [(n, None, None), (n + 1, "", ""), (n + 2, "the of and", "x")]


def plain_chunks(text, target, most, overlap):
    words = (text or "").split()
    sizes = []
    for sentence in re.split(r"(?<=[.!?])\s+", " ".join(words)):
        left = len(sentence.split())
        while left > 0:
            sizes.append(min(left, most))
            left -= most
    out, begin, stop, fresh = [], 0, 0, False
    for n in sizes:
        if stop > begin and stop - begin + n > most:
            out.append(words[begin:stop])
            begin = max(begin, stop - overlap)
        stop, fresh = stop + n, True
        if stop - begin >= target:
            out.append(words[begin:stop])
            begin, fresh = max(begin, stop - overlap), False
    if fresh:
        out.append(words[begin:stop])
    return [" ".join(c) for c in out]


@pytest.mark.parametrize("target,most,overlap", [(400, 512, 60), (8, 12, 3), (5, 5, 0)])
def test_chunks(spark, target, most, overlap):
    r = random.Random(1)
    rows = [(i, " ".join(w + ("." if r.random() < 0.1 else "") for w in map(str, range(r.randint(0, 1500))))) for i in range(12)]
    rows += [(20, None), (21, ""), (22, " \n "), (23, "One short sentence."), (24, "x " * 1000), (25, "a. b! c? d")]
    df = spark.createDataFrame(rows, "id long, body string")
    got = {}
    for x in textmine.chunks(df, target, most, overlap).collect():
        got.setdefault(x.id, {})[x.pos] = (x.chunk, x.n_words)
    for i, text in rows:
        want = plain_chunks(text, target, most, overlap)
        assert [got.get(i, {})[k] for k in range(len(got.get(i, {})))] == [(c, len(c.split())) for c in want], i
    assert textmine.chunks(df.limit(0)).count() == 0


def plain_keywords(rows, k):
    def content(text):
        return [w if re.fullmatch(r"[a-z][a-z0-9+\-]+", w) and len(w) > 2 and w not in textmine.PHRASE_STOPS else None for w in re.split(r"[^a-z0-9+\-]+", (text or "").lower())]

    seen = Counter(w for _, body, _ in rows for w in set(content(body)) - {None})
    idf = {w: math.log((1 + len(rows)) / (1 + n)) + 1 for w, n in seen.items()}
    out = {}
    for i, body, title in rows:
        runs, run = [], []
        for w in [*content(body), None]:
            if w is not None:
                run.append(w)
            elif run:
                runs.append(tuple(run[:4]))
                run = []
        if not runs:
            continue
        freq, degree = Counter(w for p in runs for w in p), Counter()
        for p in runs:
            for w in p:
                degree[w] += len(p)
        score = {p: round(sum(degree[w] / freq[w] for w in p), 6) for p in runs}
        order = sorted(score, key=lambda p: (-score[p], " ".join(p)))
        head = set(content(title))
        value = {p: round((1.5 if set(p) <= head else 1.0) * sum(idf[w] for w in p) / len(p) / (60 + at), 9) for at, p in enumerate(order)}
        kept = []
        for p in sorted(value, key=lambda p: (-value[p], " ".join(p))):
            stems = {w[:-1] if len(w) > 3 and w.endswith("s") else w for w in p}
            if len(kept) < k and all(len(stems & s) / len(stems | s) < 0.6 for _, s in kept):
                kept.append((" ".join(p), stems))
        out[i] = [p for p, _ in kept]
    return out


def test_keywords(spark):
    rows = texts(2)
    df = spark.createDataFrame(rows, "id long, body string, title string")
    assert {x.id: x.keywords for x in textmine.keywords(df, 4).collect()} == plain_keywords(rows, 4)


def test_packed_blocks(spark):
    r = random.Random(3)
    rows = [(i % 5, p, "y" * r.randint(1, 70)) for p in range(12) for i in range(5)]
    got = {(x.id, x.pack): x.text for x in textmine.packed_blocks(spark.createDataFrame(rows, "id long, pos int, text string"), 100).collect()}
    want = {}
    for i in range(5):
        packs, size = [], 0
        for text in [t for j, _, t in sorted(rows) if j == i]:
            if packs and size + len(text) <= 100:
                packs[-1].append(text)
                size += len(text) + 1
            else:
                packs.append([text])
                size = len(text) + 1
        want |= {(i, k): "\n".join(p) for k, p in enumerate(packs)}
    assert got == want


def plain_clusters(vectors, k, rounds=15):
    """Spherical k-means from documents at even distances."""
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = x[[i * len(ids) // k for i in range(k)]].copy()
    before = None
    for _ in range(rounds):
        score = np.round(x @ (centre / np.linalg.norm(centre, axis=1, keepdims=True)).T, 12)
        at = score.argmax(axis=1)
        if before is not None and (at == before).all():
            break
        before = at
        for c in range(k):
            if (at == c).any():
                centre[c] = x[at == c].mean(axis=0)
    return {i: (int(a), float(s[a])) for i, a, s in zip(ids, at, score, strict=True)}


def test_topics(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3, 6))
    vectors = {i: (centres[i % 3] + 0.3 * rng.normal(size=6)).tolist() for i in range(40)}
    weights = spark.createDataFrame([(i, f"t{j}", v) for i, row in vectors.items() for j, v in enumerate(row)], "id long, term string, weight double")
    placed, _ = textmine.clusters(weights, 3)
    want = plain_clusters(vectors, 3)
    got = {x.id: (x.cluster, x.score) for x in placed.collect()}
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], abs=1e-9) for i in want)
    dense = spark.createDataFrame([(i, v) for i, v in vectors.items()], "id long, vector array<double>")
    for x in textmine.dense_topics(dense, 3).collect():
        members = sorted(((-s, i) for i, (c, s) in want.items() if c == x.cluster))
        assert x.n == len(members) and x.representatives == ",".join(str(i) for _, i in members[:3])
        assert x.coherence == pytest.approx(round(min(1, max(0, -sum(s for s, _ in members) / len(members))), 4), abs=1e-4) and x.outliers == sum(-s < 0.05 for s, _ in members)


def test_topics_start_in_order_of_titles(spark):
    """Seeds go by title, then id; a paper without a title comes first."""
    rng = np.random.default_rng(9)
    vectors = {i: rng.normal(size=5).tolist() for i in range(60)}
    titles = {i: None if i == 31 else f"t{i * 7 % 20:02}" for i in vectors}
    weights = spark.createDataFrame([(i, f"t{j}", v) for i, row in vectors.items() for j, v in enumerate(row)], "id long, term string, weight double")
    order = sorted(vectors, key=lambda i: (titles[i] is not None, titles[i] or "", i))
    want = plain_clusters({place: vectors[i] for place, i in enumerate(order)}, 4)
    placed, _ = textmine.clusters(weights, 4, titles=spark.createDataFrame(list(titles.items()), "id long, title string"))
    assert {x.id: x.cluster for x in placed.collect()} == {order[p]: c for p, (c, _) in want.items()}
    assert textmine.clusters(weights.limit(0), 4)[0].count() == 0
    got = library.numbered(placed.select("id"), [F.desc("id")])
    assert {(r.id, r.place) for r in got.collect()} == {(i, 59 - i) for i in range(60)}
    assert library.numbered(placed.limit(0), [F.desc("id")]).collect() == []


def test_hierarchy(spark):
    rng = np.random.default_rng(7)
    x = rng.random(size=(4, 5))
    rows = [(c, f"t{j}", float(v)) for c in range(4) for j, v in enumerate(x[c])]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {r.topic_a: (r.topic_b, r.similarity) for r in textmine.hierarchy(spark.createDataFrame(rows, "cluster int, term string, weight double")).collect()}
    assert got == {a: max(((b, round(float(unit[a] @ unit[b]), 4)) for b in range(a + 1, 4)), key=lambda m: (m[1], -m[0])) for a in range(3)}


def test_backup(spark, tmp_path):
    from litmill.sources import export

    tables = {"a": spark.range(5), "b": spark.createDataFrame([("x",)], "v string")}
    manifest = export.write_backup(tables, f"{tmp_path}/backup")
    assert {(r.table, r.rows, tuple(r.columns)) for r in manifest.collect()} == {("a", 5, ("id",)), ("b", 1, ("v",))}
    assert spark.read.schema("id long").json(f"{tmp_path}/backup/a").count() == 5


def test_plane(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 7)) * np.array([5, 3, 1, 1, 0.5, 0.5, 0.1])
    got = {r.id: (r.x, r.y) for r in textmine.plane(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")).collect()}
    middle = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(middle, full_matrices=False)
    axes = axes[:2] * np.sign([a[np.abs(a).argmax()] for a in axes[:2]])[:, None]
    assert np.allclose([got[i] for i in range(60)], middle @ axes.T, atol=1e-6)
    assert textmine.plane(spark.createDataFrame([], "id long, vector array<double>")).count() == 0


def test_disagreement(spark):
    rows = [(1, "t", "Deep  Learning"), (1, "t", "deep learn-\ning"), (1, "t", "Shallow"), (2, "t", "a"), (2, "t", None), (3, "t", "x y z"), (3, "t", "z y x")]
    got = {x.entity_id: x.match for x in linkage.disagreement(spark.createDataFrame(rows, "entity_id long, field_name string, value string")).collect()}
    low = lambda a, b: similarity.value_percent(a, b)
    assert got == {1: min(low("deep learning", "shallow"), low("deep learning", "deep learning")), 3: 100.0}
    assert similarity.value_percent("", "") == 100.0 and similarity.value_percent("", "a") == 0.0 and similarity.value_percent(None, "a") is None


def test_ranked_candidates(spark):
    r = random.Random(6)
    words = ["sea", "salt", "stone", "river"]
    rows = [(q, c, " ".join(r.choices(words, k=4)), r.choice([None, 2000, 2001, 2005]), [f"{a} {r.choice(words)}" for a in "AB"], r.random() < 0.5, " ".join(r.choices(words, k=4)), r.choice([None, 2001]), [f"C {r.choice(words)}"]) for q in range(6) for c in range(8)]
    df = spark.createDataFrame(rows, "query_id long, cand_id long, title string, year int, authors array<string>, open boolean, wanted_title string, wanted_year int, wanted_authors array<string>")

    def score(title, year, authors, free, want, want_year, want_authors):
        years = 0.5 if year is None or want_year is None else {0: 1.0, 1: 0.6}.get(abs(year - want_year), 0.0)
        wanted = {a.split()[-1] for a in want_authors}
        share = len(wanted & {a.split()[-1] for a in authors}) / len(wanted)
        return round(min(1, 0.6 * difflib.SequenceMatcher(None, want, title).ratio() + 0.2 * years + 0.2 * share + 0.05 * free), 4)

    scores = {(q, c): score(*rest) for q, c, *rest in rows}
    got = {(x.query_id, x.place): (x.cand_id, x.score) for x in linkage.ranked_candidates(df, 3).collect()}
    for q in range(6):
        best = sorted(((-s, c) for (p, c), s in scores.items() if p == q))[:3]
        assert [got[q, k + 1] for k in range(3)] == [(c, pytest.approx(-s, abs=1e-4)) for s, c in best]


def test_fuzzy_titles_and_names(spark):
    assert parsed("José Ñandú") == ("nandu", "j") and parsed("O, P") == ("o", "p")
    rows = [(1, "Deep networks for graphs", 2000), (2, "Deeper networks for graphs", 2000), (3, "Deep network for graphs", 2001), (4, "Deep networks for graphs", None), (5, None, None)]
    got = {(x.a, x.b) for x in linkage.fuzzy_titles(spark.createDataFrame(rows, "id long, title string, year int"), 92).collect()}
    want = {(a, b) for a, x, y in rows for b, u, v in rows if a < b and x and u and (y is None or v is None or y == v) and similarity.title_percent(x.lower(), u.lower()) >= 92}
    assert got == want


def test_written_index(spark, tmp_path):
    rows = spark.createDataFrame([(1, "title", "alpha beta"), (2, "body_low", "alpha the of"), (3, "body_high", "the"), (3, "abstract", None)], "id long, field string, text string")
    rows.write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    built = []

    def build():
        built.append(1)
        return retrieval.field_postings(table)

    for _ in range(2):
        index = retrieval.written("test", table, build, by_term=True)
        assert [x.id for x in retrieval.stored_search(index, "Alpha of", 5).collect()] == [1, 2]
    assert len(built) == 1 and {x.id for x in index.select("id").collect()} == {1, 2}
    assert re.search(r"PartitionFilters: \[[^\]]*part#", retrieval.stored_search(index, "alpha", 5)._jdf.queryExecution().toString())
    rows.where("id = 1").withColumn("id", F.lit(9).cast("long")).write.mode("append").parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    assert 9 in {x.id for x in retrieval.written("test", table, build, by_term=True).select("id").collect()} and len(built) == 2
    assert retrieval.signature(rows) == retrieval.signature(rows.repartition(2)) != retrieval.signature(rows.limit(1))


def test_bags_and_labels(spark):
    docs = spark.createDataFrame([(1, "sea salt sea"), (2, None), (3, "stone")], "id long, body string")
    bags = retrieval.bag_vectors(docs)
    got = {x.id: (x.label, x.place, x.score) for x in retrieval.label_affinity(bags, bags.where("id = 3").withColumnRenamed("id", "label"), 1).collect()}
    assert got[3] == (3, 1, 1.0) and 2 not in got


def test_search_needs_tables(spark):
    works = spark.createDataFrame([(1, "t")], "id long, title string")
    for text in ("has:pdf", "cites:3", "warning:*", "version:yes"):
        with pytest.raises(ValueError):
            dsl.filtered(works, dsl.parse(text))


def test_tei_awkward(spark):
    nested = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div type="intro"><p>Lead , here.</p><div><head n="1.1">Part</head><p>Inner.</p></div><div><p/></div></div><div><head>2 Own</head><p>A</p><p>B</p></div></body></text></TEI>'
    rows = [(1, nested), (2, None), (3, "<broken"), (4, "")]
    got = {x.id: x for x in tei.read_tei_records(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert [(s.label, s.text) for s in got[1].sections] == [("intro", "Lead, here. Inner."), ("2 Own", "A B")]
    assert [(s.label, s.text) for s in got[1].leaves] == [("intro", "Lead, here."), ("intro › 1.1 Part", "Inner."), ("2 Own", "A B")]
    assert all(got[i].title is None and got[i].sections == [] and got[i].references == [] for i in (2, 3, 4))
    coords = spark.createDataFrame([(1, "1,2,3,4,5; x,1,1,1,1;7,0.5,1,1,2;1,2"), (2, None), (3, "")], "id int, c string")
    assert [[tuple(b) for b in x.boxes] for x in coords.select("id", tei.boxes(F.col("c")).alias("boxes")).orderBy("id").collect()] == [[(1, 2.0, 3.0, 4.0, 5.0), (7, 0.5, 1.0, 1.0, 2.0)], [], []]


def test_tei_mentions(spark):
    """Header, references and mentions of a document with sentences, boxes of two pages and a reference that is but a line."""
    text = """<?xml version="1.0" encoding="UTF-8"?>
    <TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title level="a" type="main">On Seas</title></titleStmt><sourceDesc><biblStruct>
      <analytic><author><persName><forename type="first">Ada</forename><forename>B.</forename><surname>Sea</surname></persName></author><author><persName><surname>Lone</surname></persName></author><idno type="DOI">10.5/sea</idno></analytic>
      <monogr><title level="j">Water</title><imprint><date type="published" when="2017-03">May 2017</date></imprint></monogr></biblStruct></sourceDesc></fileDesc>
      <profileDesc><abstract><div><p>We swim , a lot .</p></div></abstract></profileDesc></teiHeader>
    <text><body><div type="introduction"><head>Introduction</head><p>
      <s>Seas are old.</s>
      <s>Waves were seen <ref type="bibr" target="#b0" coords="3,123.40,456.70,12.00,10.50">[1]</ref>.</s>
      <s>Others <hi>also</hi> looked <ref type="bibr" target="#b1" coords="4,88,120,10,9;5,100,120,6,9">[2]</ref> and <ref type="bibr" target="#b0">[1]</ref>.</s></p>
      <div><head n="1.1">Deep</head><p>No sentences <ref type="bibr" target=" #b1 ">x</ref> here <ref type="figure" target="#f">1</ref>.</p></div></div></body>
    <back><div type="references"><listBibl><biblStruct xml:id="b0"><analytic><title level="a">Waves</title><idno type="DOI">10.5/w</idno></analytic><monogr><title>Tides</title><imprint><date when="2015">2015</date></imprint></monogr><note type="raw_reference">Bo. Waves. 2015.</note></biblStruct>
      <biblStruct xml:id="b1"><note type="raw_reference">Some line, 2010.</note></biblStruct><biblStruct xml:id="b2"><monogr/></biblStruct><biblStruct><monogr><title>Book</title></monogr></biblStruct></listBibl></div></back></text></TEI>"""
    alone = "<x><biblStruct><monogr><title>Only</title><author><persName><surname>Yu</surname></persName></author><date>in 1999 or so</date></monogr></biblStruct><biblStruct/></x>"
    got = {x.id: x for x in tei.read_tei_records(spark.createDataFrame([(1, text), (2, alone)], "id long, text string")).collect()}
    x = got[1]
    assert (x.title, x.abstract, x.doi, x.venue, x.year, x.authors) == ("On Seas", "We swim, a lot.", "10.5/sea", "Water", 2017, ["Ada B. Sea", "Lone"])
    assert [(r.key, r.raw, r.title, r.venue, r.doi, r.year) for r in x.references] == [("b0", "Bo. Waves. 2015.", "Waves", "Tides", "10.5/w", 2015), ("b1", "Some line, 2010.", None, None, None, None), ("b3", None, "Book", None, None, None)]
    assert [(m.key, m.marker, m.section, m.before, m.sentence, m.after, m.page, len(m.boxes)) for m in x.mentions] == [
        ("b0", "[1]", "Introduction", "Seas are old.", "Waves were seen [1].", "Others also looked [2] and [1].", 3, 1),
        ("b1", "[2]", "Introduction", "Waves were seen [1].", "Others also looked [2] and [1].", None, 4, 2),
        ("b0", "[1]", "Introduction", "Waves were seen [1].", "Others also looked [2] and [1].", None, None, 0),
        ("b1", "x", "Deep", None, "No sentences x here 1.", None, None, 0),
    ]
    assert all(m.sentence[m.offset :].startswith(m.marker) for m in x.mentions)
    assert [(r.key, r.title, r.year, r.authors) for r in got[2].references] == [("b0", "Only", 1999, ["Yu"]), ("b1", None, None, [])]


def test_records_awkward(spark):
    rows = spark.createDataFrame([(1, None), (2, "no json"), (3, "{}"), (4, '{"message": {"title": [], "author": [{"family": "Lone"}, {}]}}')], "id long, text string")
    for read in (records.read_crossref, records.read_openalex, records.read_semantic_scholar):
        assert {x.id: x.title for x in read(rows).collect()} == {1: None, 2: None, 3: None, 4: None}
    assert [x.authors for x in records.read_crossref(rows).where("id = 4").collect()] == [["Lone"]]


def test_publisher_links(spark):
    urls = {"https://ieeexplore.ieee.org/document/12/": "https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?tp=&arnumber=12", "https://www.mdpi.com/2072-4292/1/2": "https://www.mdpi.com/2072-4292/1/2/pdf", "https://www.biorxiv.org/content/1.v2?x=1": "https://www.biorxiv.org/content/1.v2.full.pdf", "https://proceedings.neurips.cc/paper/hash/a-Abstract.html": "https://proceedings.neurips.cc/paper/file/a-Paper.pdf", "https://www.nature.com/articles/a.pdf": None, "https://journals.plos.org/plosone/article?id=10.1/j.p&x=1": "https://journals.plos.org/plosone/article/file?id=10.1/j.p&x=1&type=printable", "https://journals.plos.org/plosone/article": None, "https://www.medrxiv.org/content/2": "https://www.medrxiv.org/content/2.full.pdf", "https://papers.nips.cc/paper/7-x/?a": "https://papers.nips.cc/paper/7-x.pdf", "https://onlinelibrary.wiley.com/doi/10.1/x": "https://onlinelibrary.wiley.com/doi/pdfdirect/10.1/x", "https://link.springer.com/article/10.1/x/": "https://link.springer.com/content/pdf/10.1/x.pdf", "https://proceedings.neurips.cc/paper/b-Abstract.html": "https://proceedings.neurips.cc/paper/b-Paper.pdf", "nothing": None, None: None}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {x.url: x.pdf for x in df.select("url", F.get(records.publisher_pdfs(F.col("url")), F.lit(0)).alias("pdf")).collect()} == urls


def test_folder_scan(spark, tmp_path):
    import hashlib

    for name, body in (("a.pdf", b"one"), ("b.pdf", b"one"), ("sub/c.pdf", b"two")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    known = files.where("path like '%c.pdf'").select("path", F.col("modificationTime").alias("mtime"), F.lit("kept").alias("sha256"))
    got = {x.path.rsplit("/", 1)[1]: (x.sha256, x.fate) for x in records.scanned_folder(files, known).collect()}
    one = hashlib.sha256(b"one").hexdigest()
    assert got == {"a.pdf": (one, "new"), "b.pdf": (one, "copy"), "c.pdf": ("kept", "unchanged")}
    assert records.schema_changes(files, files.drop("length").withColumn("x", F.lit(1))) == {"dropped": ["length"], "added": ["x"]}
