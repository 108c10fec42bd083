import random

import duckdb
import pytest

from litmill import queries as Q
from litmill import queries_more, queries_text  # noqa: F401  their queries register with the others
from litmill.functions import similarity
from litmill.functions import text as T
from litmill.operators import graph, library, linkage
from litmill.plans import dsl
from litmill.sources import bibliography, export
from litmill.streaming import events as ev
from pyspark.sql import functions as F

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) and v == v else v


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_equals_sql(spark, tables, name):
    con = duckdb.connect()
    for t in NAMES:
        con.sql(f"create view {t} as select * from '{tables}/{t}.parquet'")
    want = con.sql(Q.SQL[name])
    got = Q.QUERIES[name](spark, tables)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    order = ",".join(f'"{c}"' for c in columns)
    assert rows == sorted(repr(tuple(map(plain, r))) for r in want.project(order).fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, tables, name):
    """What SQL cannot say has tests of its values elsewhere; here it must give rows, whole and once."""
    got = Q.QUERIES[name](spark, tables)
    rows = [tuple(map(repr, r)) for r in got.collect()]
    assert rows and len(set(rows)) == len(rows) and not all(r[-1] == "None" for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[0] == "id"


def test_search_language():
    s = dsl.parse('lichens venue:"Field Notes" year:>=1987 year:1990-1994 colour:green has:pdf')
    assert s.text == "lichens colour:green" and s.terms == {"venue": "Field Notes", "has": "pdf"}
    assert (s.year_min, s.year_max) == (1990, 1994)
    assert (dsl.parse("year:<=2001").year_min, dsl.parse("year:<=2001").year_max) == (None, 2001)
    assert dsl.parse("year:soon").year_min is None
    assert dsl.parse('say "hi').text == 'say "hi'
    assert not dsl.truth("No") and dsl.truth("yes")


def test_visibility_and_pages(spark):
    works = spark.createDataFrame([(i, 2000 + i if i % 3 else None) for i in range(1, 8)], "id long, year int")
    links = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (3, 1)], "work_id long, shelf_id int")
    shelves = spark.createDataFrame([(1, "open"), (2, "private")], "shelf_id int, access_level string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(library.visible(works, links, shelves, [])) == [1, 3, 4, 5, 6, 7]
    assert ids(library.visible(works, links, shelves, [2])) == [1, 2, 3, 4, 5, 6, 7]
    order = library.order("year:desc", ["year"])
    assert [r.id for r in library.page(works, order, 1, 5).collect()] == [7, 5, 4, 2, 1]
    assert [r.id for r in library.page(works, order, 99, 5).collect()] == [3, 6]
    assert library.page(works.limit(0), order, 1, 5).count() == 0


def test_normalisation(spark):
    row = spark.createDataFrame([("  Deep-Learning:  A\tSurvey ", "https://doi.org/10.1/ABC", "https://arxiv.org/pdf/1706.03762v7.pdf", "10.48550/arXiv.1706.03762")], "t string, d string, a string, b string")
    got = row.select(T.normalize_title(F.col("t")), T.normalize_doi(F.col("d")), T.arxiv_base(F.col("a")), T.arxiv_version(F.col("a")), T.arxiv_from_doi(F.col("b")), T.dedup_key(F.col("b"), F.col("a"), F.col("t"), F.lit(1))).first()
    assert list(got) == ["deeplearning asurvey", "10.1/abc", "1706.03762", 7, "1706.03762", "arxiv:1706.03762"]


def test_similarity():
    def slow(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        return rows[-1][-1]

    r = random.Random(3)
    for _ in range(200):
        a, b = ("".join(r.choices("abcd ", k=r.randint(0, 40))) for _ in "ab")
        assert similarity.common(a, b) == slow(a, b)
    assert similarity.title_percent("a b c d e", "e d c b a") == 100.0
    assert similarity.ratio("", "") == 100.0


def test_graph(spark):
    path = spark.createDataFrame([(1, 2, 1), (2, 3, 1)], "src long, dst long, weight long")
    assert {r.node: r.betweenness for r in graph.betweenness(path).collect()} == {1: 0.0, 2: 1.0, 3: 0.0}
    ranks = {r.node: r["rank"] for r in graph.pagerank(path).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6 and ranks[3] > ranks[2] > ranks[1]
    two = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 9), (9, 3)]
    links = spark.createDataFrame([(a, b, 1) for a, b in two], "src long, dst long, weight long")
    best = graph.betweenness(links).orderBy(F.desc("betweenness")).first()
    assert best.betweenness == 9.0 and best.node == 9
    assert {(r.node, r.hop) for r in graph.neighbourhood(path, 1, 5).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_linkage(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "y"), (9, "x")], "id long, k string")
    assert sorted((r.a, r.b) for r in linkage.same_key(rows, "k", "k").collect()) == [(1, 2), (1, 9)]
    refs = spark.createDataFrame([("k", 1, None, "external", 5), ("k", 2, "T", "confirmed_match", 7), ("k", 3, "U", "rejected_match", None), (None, 4, "V", "external", 1)], "key string, id long, title string, state string, created_at int")
    one = linkage.consolidated(refs).collect()
    assert len(one) == 1 and (one[0].survivor, one[0].state, one[0].title, one[0].members, one[0].contradiction) == (1, "confirmed_match", "T", 3, True)


def test_readers(spark):
    ris = "TY  - JOUR\nAU  - Doe, Jane\nAU  - Roe, R.\nTI  - A Title\nPY  - 2017/01\nJO  - Venue\nDO  - 10.1/x\nER  - \nTY  - BOOK\nER  - \n"
    got = bibliography.read_ris(spark.createDataFrame([(1, ris)], "id long, text string")).collect()
    assert len(got) == 1 and (got[0].title, got[0].year, got[0].authors) == ("A Title", 2017, ["Doe, Jane", "Roe, R."])
    bib = '@comment{x}\n@Article{k1,\n title = {A {Nested} Title},\n author = "Doe, Jane and Richard Roe",\n year = 2018, journal={J} }\n'
    got = bibliography.read_bibtex(spark.createDataFrame([(1, bib)], "id long, text string")).collect()
    assert len(got) == 1 and (got[0].cite_key, got[0].title, got[0].year, got[0].authors) == ("k1", "A Nested Title", 2018, ["Jane Doe", "Richard Roe"])
    index = '{"title": "T", "publication_year": 2020, "cited_by_count": 3, "abstract_inverted_index": {"deep": [1], "we": [0, 2]}}'
    assert bibliography.read_works_json(spark.createDataFrame([(index,)], "text string")).first().abstract == "we deep we"
    tei = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><titleStmt><title>Paper</title></titleStmt><idno type="DOI">10.1/p</idno><abstract><p>Short.</p></abstract></teiHeader><text><body><p>Body text.</p></body><listBibl><biblStruct><title>Cited</title></biblStruct></listBibl></text></TEI>'
    row = bibliography.read_tei(spark.createDataFrame([(tei,)], "tei string")).first()
    assert (row.title, row.doi, row.cited_titles) == ("Paper", "10.1/p", ["Cited"])


def test_backup(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    export.write_backup({"t": old}, str(tmp_path / "b"))
    back = spark.read.json(str(tmp_path / "b" / "t"))
    assert sorted(r.id for r in export.restored(old.where("id = 1"), back, "id").collect()) == [1, 2]
    assert export.restored(old, back.limit(0), "id", "replace").count() == 0


def test_streams_equal_batches(spark, tables):
    batch = {tuple(r) for r in ev.rates(spark.read.parquet(f"{tables}/events.parquet")).collect()}
    assert {tuple(r) for r in ev.drained(ev.rates(ev.stream(spark, tables)), "rates_test").collect()} == batch


def test_batch_similarity():
    """Many pairs at once, up to and across machine words, against one at a time."""
    r = random.Random(2)
    texts = ["".join(r.choice("abcdeé 𝄞") for _ in range(r.choice([0, 1, 5, 30, 63, 64, 65, 127, 128, 200]))) for _ in range(1200)]
    a, b = texts[::2], texts[1::2]
    assert similarity.ratios(a, b).tolist() == [similarity.ratio(x, y) for x, y in zip(a, b, strict=True)]
    assert similarity.title_percents([*a, None], [*b, "x"]) == [similarity.title_percent(x, y) for x, y in zip([*a, None], [*b, "x"], strict=True)]
    assert similarity.value_percents([*a, None, ""], [*b, "x", ""]) == [similarity.value_percent(x, y) for x, y in zip([*a, None, ""], [*b, "x", ""], strict=True)]
    assert similarity.ratios([], []).tolist() == []
