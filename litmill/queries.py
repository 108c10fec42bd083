"""Queries over the library's operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import SQL as VIEWS
from .catalog import Catalog
from .functions import text as T
from .operators import graph, library, linkage, recommend, reports, retrieval, textmine, vector_index
from .plans import dsl
from .sources import bibliography, export
from .streaming import events as ev

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    """Register a query of (catalog); its SQL may use the catalog's views."""

    def put(f: Callable[[Catalog], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, folder: f(Catalog(spark, folder))
        if sql:
            SQL[name] = (f"WITH RECURSIVE {VIEWS}" + (", " if sql.lstrip()[:1] != "S" else "") + sql) if views else sql
        return f

    return put


_VISIBLE = """vis AS (SELECT * FROM live_works w WHERE NOT EXISTS (SELECT 1 FROM shelf_works s WHERE s.work_id = w.id)
  OR EXISTS (SELECT 1 FROM shelf_works s JOIN shelves h USING (shelf_id) WHERE s.work_id = w.id AND (h.access_level IN ('open', 'visible') OR h.shelf_id IN (5, 8))))"""
_GRANTED = [5, 8]


def _visible(c: Catalog) -> DataFrame:
    return library.visible(c.live_works(), c.shelf_works(), c.shelves(), _GRANTED)


@query(f"""{_VISIBLE}, refd AS (SELECT citing_id, count(*) AS mention_count, count(DISTINCT cited_id) AS reference_count FROM citations GROUP BY 1)
SELECT id, title, year, reading_status, coalesce(mention_count, 0) AS mention_count, coalesce(reference_count, 0) AS reference_count
FROM vis LEFT JOIN refd ON id = citing_id WHERE year >= 1997 AND reading_status = 'F' AND mention_count > 0 ORDER BY reference_count DESC, id LIMIT 100""")
def library_query(c):
    """`year:>=1997 status:F has:references`, most references first."""
    found = dsl.filtered(_visible(c), dsl.parse("year:>=1997 status:F has:references"), {"has:references": c.citations().select(F.col("citing_id").alias("id"))})
    counted = library.citation_counts(found, c.citations()).select("id", "title", "year", "reading_status", "mention_count", "reference_count")
    return counted.orderBy(F.desc("reference_count"), "id").limit(100)


@query(r"""SELECT id, venue, lang FROM texts WHERE title ILIKE '%with%' OR venue ILIKE '%with%'""")
def search_free_text(c):
    return dsl.filtered(c.texts(), dsl.parse("with")).select("id", "venue", "lang")


@query("""SELECT id, year, doi FROM live_works WHERE title ILIKE '%urgent%' AND doi ILIKE '10.1000/w1%' AND year BETWEEN 1996 AND 1999""")
def search_fields(c):
    return dsl.filtered(c.live_works(), dsl.parse('title:urgent doi:10.1000/w1 year:1996-1999')).select("id", "year", "doi")


@query("""SELECT id, title FROM live_works WHERE doi IS NULL AND (citation_count IS NULL OR CAST(citation_count AS VARCHAR) = '')""")
def search_missing_fields(c):
    return dsl.filtered(c.live_works(), dsl.parse("missing:doi,citation_count")).select("id", "title")


@query("""SELECT id, year FROM live_works w WHERE EXISTS (SELECT 1 FROM citations WHERE citing_id = w.id AND cited_id = 7)""")
def search_cites(c):
    sides = {"cites": c.citations().select(F.col("citing_id").alias("id"), F.col("cited_id").alias("name"))}
    return dsl.filtered(c.live_works(), dsl.parse("cites:7"), sides).select("id", "year")


@query("""SELECT DISTINCT w.id, w.year FROM live_works w JOIN shelf_works s ON s.work_id = w.id JOIN shelves h USING (shelf_id) WHERE h.name ILIKE '%1%'""")
def search_shelf_name(c):
    sides = {"shelf": c.shelf_works().join(c.shelves(), "shelf_id").select(F.col("work_id").alias("id"), "name")}
    return dsl.filtered(c.live_works(), dsl.parse("shelf:1"), sides).select("id", "year")


@query("""SELECT id FROM live_works w WHERE NOT EXISTS (SELECT 1 FROM citations WHERE citing_id = w.id)""")
def works_without_references(c):
    return c.live_works().join(c.citations().select(F.col("citing_id").alias("id")), "id", "left_anti").select("id")


@query(f"""{_VISIBLE} SELECT reading_status, count(*) AS n, min(id) AS first_id FROM vis GROUP BY 1""")
def visible_works(c):
    return _visible(c).groupBy("reading_status").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("""s AS (SELECT 'library' AS scope, count(*) AS n FROM live_works UNION ALL
  SELECT 'shelf', count(*) FROM live_works WHERE id IN (SELECT work_id FROM shelf_works WHERE shelf_id = 3) UNION ALL
  SELECT 'rack', count(*) FROM live_works WHERE id IN (SELECT work_id FROM shelf_works JOIN shelves USING (shelf_id) WHERE rack_id = 2))
SELECT scope, n FROM s""")
def scope_counts(c):
    works, links, shelves = c.live_works(), c.shelf_works(), c.shelves()
    out = None
    for scope, i in (("library", None), ("shelf", 3), ("rack", 2)):
        part = library.in_scope(works, scope, i, links, shelves).agg(F.count("*").alias("n")).select(F.lit(scope).alias("scope"), "n")
        out = part if out is None else out.unionAll(part)
    return out


@query("""SELECT work_id, count(DISTINCT tag) AS n_tags FROM tags GROUP BY 1 HAVING bool_or(tag = 'click') AND bool_or(tag = 'view') AND (bool_or(tag = 'purchase') OR bool_or(tag = 'signup')) AND NOT bool_or(tag = 'error')""")
def works_by_tags(c):
    return library.tagged(c.tags(), every=["click", "view"], some=["purchase", "signup"], none=["error"])


@query("""SELECT id, venue, citation_count, year FROM live_works ORDER BY citation_count DESC NULLS LAST, venue ASC NULLS LAST, id LIMIT 50 OFFSET 100""")
def library_page(c):
    known = ["citation_count", "venue", "year", "updated_at"]
    return library.page(c.live_works(), library.order("citation_count:desc,venue,nonsense", known), 3, 50).select("id", "venue", "citation_count", "year")


@query("""r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, field_name ORDER BY canonical DESC, coalesce(confidence, 0.0) DESC, assertion_id DESC) AS k FROM assertions)
SELECT entity_id, field_name, value, source, assertion_id FROM r WHERE k = 1""")
def best_assertions(c):
    return library.best_assertion(c.assertions())


@query("""SELECT entity_id, field_name, count(DISTINCT value) AS n_values, count(*) AS n_claims FROM assertions GROUP BY 1, 2 HAVING count(DISTINCT value) > 1""")
def conflicting_fields(c):
    return library.conflicts(c.assertions())


@query("""n AS (SELECT cited_id, marker, count(*) AS n FROM citations GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cited_id ORDER BY n DESC, marker) AS k FROM n)
SELECT cited_id, n, marker FROM r WHERE k = 1""")
def usual_markers(c):
    return library.usual_marker(c.citations())


@query("""SELECT year, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM live_works GROUP BY 1""")
def chronology(c):
    return reports.chronology(c.live_works())


@query("""v AS (SELECT trim(regexp_replace(lower(venue), '[^a-z0-9]+', ' ', 'g')) AS venue_key, count(*) AS n, min(year) AS first_year, max(year) AS last_year, count(DISTINCT venue) AS spellings FROM refs WHERE venue IS NOT NULL GROUP BY 1)
SELECT venue_key, n, round(100.0 * n / (SELECT sum(n) FROM v), 1) AS pct, first_year, last_year, spellings FROM v""")
def venue_summary(c):
    return reports.venues(c.references())


@query("""m AS (SELECT cited_id AS missing_id, count(DISTINCT citing_id) AS cited_by, count(*) AS mentions FROM citations GROUP BY 1 HAVING count(DISTINCT citing_id) >= 2)
SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM refs WHERE id = missing_id AND score < 950)""")
def missing_works(c):
    return reports.missing_works(c.citations(), c.references().where("score < 950"), "cited_id")


@query("""SELECT cited_id, count(DISTINCT citing_id) AS in_degree FROM citations GROUP BY 1 ORDER BY in_degree DESC, cited_id LIMIT 50""")
def most_cited(c):
    return reports.in_degree(c.citations(), 50)


@query("""SELECT id, title FROM refs WHERE id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def isolated_works(c):
    """Cited papers without a strong link: no order of more than 45."""
    strong = c.table("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("src"), F.col("l_partkey").alias("dst"))
    return reports.isolated(c.references(), strong).select("id", "title")


@query("""n AS (SELECT year, work_type AS topic, count(*) AS c FROM refs GROUP BY 1, 2), f AS (SELECT y.year, t.topic, coalesce(c, 0) AS c FROM (SELECT DISTINCT year FROM n) y CROSS JOIN (SELECT DISTINCT topic FROM n) t LEFT JOIN n ON n.year = y.year AND n.topic = t.topic)
SELECT year, topic, round(c / CAST(sum(c) OVER (PARTITION BY year) AS DOUBLE), 4) AS share FROM f""")
def topic_river(c):
    return reports.topic_river(c.references(), "year", "work_type")


@query("""SELECT cited_id, count(*) FILTER (section = 'A') AS n_a, count(*) FILTER (section = 'N') AS n_n, count(*) FILTER (section = 'R') AS n_r,
  count(*) FILTER (section = 'A') * 5 + count(*) FILTER (section = 'N') * 3 + count(*) FILTER (section = 'R') * 1 AS weighted FROM citations GROUP BY 1""")
def reference_sections(c):
    return reports.section_mentions(c.citations(), {"A": 5, "N": 3, "R": 1})


@query("""SELECT (SELECT count(*) FROM live_works) || ':' || (SELECT strftime(max(updated_at), '%Y-%m-%d') FROM live_works) || ':' || (SELECT count(*) FROM vectors) AS signature""")
def corpus_signature(c):
    return reports.signature(c.live_works(), c.vectors())


@query("""o AS (SELECT id, year, row_number() OVER (ORDER BY year, id) - 1 AS k, count(*) OVER () AS n FROM live_works)
SELECT id, year FROM o WHERE k IN (SELECT (i * n) // 200 FROM range(200) r(i))""")
def even_sample(c):
    return reports.evenly_sampled(c.live_works().select("id", "year"), ["year", "id"], 200)


@query("""p AS (SELECT work_id, pos, avg(x) AS x FROM (SELECT work_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM vectors) GROUP BY 1, 2)
SELECT work_id, count(*) AS dim, round(sum(x * x), 6) AS squared FROM p GROUP BY 1""")
def mean_vectors(c):
    mean = c.vectors().select("work_id", F.posexplode("vector").alias("pos", "x")).groupBy("work_id", "pos").agg(F.avg("x").alias("x"))
    return mean.groupBy("work_id").agg(F.count("*").alias("dim"), F.round(F.sum(F.col("x") * F.col("x")), 6).alias("squared"))


@query("""r AS (SELECT entity_id, assertion_id AS id, row_number() OVER (PARTITION BY entity_id ORDER BY retrieved_at DESC, assertion_id DESC) AS place FROM assertions)
SELECT * FROM r WHERE place <= 3""")
def newest_kept(c):
    return linkage.newest_kept(c.assertions().select("entity_id", F.col("assertion_id").alias("id"), "retrieved_at"), "entity_id", "retrieved_at", 3).select("entity_id", "id", "place")


@query("""SELECT rack_id AS parent_id, round(sum(n), 6) AS score FROM (SELECT shelf_id, CAST(count(*) AS DOUBLE) AS n FROM shelf_works GROUP BY 1) JOIN shelves USING (shelf_id) GROUP BY 1""")
def recommended_racks(c):
    scores = c.shelf_works().groupBy(F.col("shelf_id").alias("child_id")).agg(F.count("*").cast("double").alias("score"))
    return recommend.combined(scores, c.shelves().select(F.col("shelf_id").alias("child_id"), F.col("rack_id").alias("parent_id")))


@query("""SELECT w.work_id, t.tag FROM (SELECT DISTINCT work_id FROM tags) w CROSS JOIN (SELECT DISTINCT tag FROM tags) t WHERE NOT EXISTS (SELECT 1 FROM tags x WHERE x.work_id = w.work_id AND x.tag = t.tag)""")
def assignable_tags(c):
    return recommend.assignable(c.tags(), c.tags())


@query("""SELECT citing_id AS src, cited_id AS dst, count(*) AS weight FROM citations WHERE citing_id <> cited_id AND citing_id IN (SELECT id FROM live_works) GROUP BY 1, 2""")
def citation_graph(c):
    return graph.edges(c.citations(), c.live_works())


@query("""e AS (SELECT src AS node, weight FROM shelf_links UNION ALL SELECT dst, weight FROM shelf_links) SELECT node, CAST(sum(weight) AS BIGINT) AS degree, count(*) AS n_edges FROM e GROUP BY 1""")
def weighted_degrees(c):
    return graph.weighted_degree(c.shelf_links())


@query("""n AS (SELECT src // 3 * 3 AS src, dst // 3 * 3 AS dst, weight FROM shelf_links) SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM n WHERE src <> dst GROUP BY 1, 2""")
def collapsed_versions(c):
    versions = c.shelves().select(F.col("shelf_id").alias("id"), (F.col("shelf_id") - F.col("shelf_id") % 3).alias("representative"))
    return graph.collapsed(c.shelf_links(), versions)


@query("""l AS (SELECT src, dst, CAST(weight AS DOUBLE) / sum(weight) OVER (PARTITION BY src) AS share FROM shelf_links), nodes AS (SELECT src AS node FROM shelf_links UNION SELECT dst FROM shelf_links), k AS (SELECT count(*) AS n FROM nodes),
p(i, node, rank) AS (SELECT 0, node, 1.0::DOUBLE / (SELECT n FROM k) FROM nodes UNION ALL
  SELECT p.i + 1, n.node, 0.15 / (SELECT n FROM k) + 0.85 * sum(coalesce(l.share, 0) * p.rank) FROM p CROSS JOIN nodes n LEFT JOIN l ON l.src = p.node AND l.dst = n.node WHERE p.i < 60 GROUP BY p.i, n.node)
SELECT node, round(rank, 5) AS rank FROM p WHERE i = 60""")
def pagerank(c):
    return graph.pagerank(c.shelf_links()).select("node", F.round("rank", 5).alias("rank"))


@query()
def betweenness(c):
    return graph.betweenness(c.shelf_links()).select("node", F.round("betweenness", 4).alias("betweenness"))


@query("""b AS (SELECT citing_id AS src, cited_id AS dst FROM citations WHERE position = 1 UNION SELECT cited_id, citing_id FROM citations WHERE position = 1),
h AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS hop UNION ALL SELECT DISTINCT b.dst, h.hop + 1 FROM h JOIN b ON b.src = h.node WHERE h.hop < 2)
SELECT node, min(hop) AS hop FROM h GROUP BY 1""")
def neighbourhood(c):
    links = c.citations().where("position = 1").select(F.col("citing_id").alias("src"), F.col("cited_id").alias("dst"))
    return graph.neighbourhood(links, 1, 2)


@query("""b AS (SELECT citing_id AS src, cited_id AS dst FROM citations UNION SELECT cited_id, citing_id FROM citations),
h AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS hop UNION ALL SELECT DISTINCT b.dst, h.hop + 1 FROM h JOIN b ON b.src = h.node WHERE h.hop < 2)
SELECT node, min(hop) AS hop FROM h GROUP BY 1""")
def whole_neighbourhood(c):
    """Over all citations, where `neighbourhood` follows first references."""
    return graph.neighbourhood(c.citations().select(F.col("citing_id").alias("src"), F.col("cited_id").alias("dst")), 1, 2)


@query("""d AS (SELECT DISTINCT citing_id, cited_id FROM citations), x AS (SELECT p.citing_id AS a, q.citing_id AS b, count(*) AS weight FROM d p JOIN d q USING (cited_id) WHERE p.citing_id < q.citing_id GROUP BY 1, 2)
SELECT * FROM x WHERE weight >= 2""")
def bibliographic_coupling(c):
    return graph.coupling(c.citations(), least=2)


@query("""d AS (SELECT DISTINCT citing_id, cited_id FROM citations), x AS (SELECT p.cited_id AS a, q.cited_id AS b, count(*) AS weight FROM d p JOIN d q USING (citing_id) WHERE p.cited_id < q.cited_id GROUP BY 1, 2)
SELECT * FROM x WHERE weight >= 2""")
def co_citation(c):
    return graph.co_citation(c.citations(), least=2)


_KNN = """s AS (SELECT q.chunk_id AS query_id, v.chunk_id AS id, round(list_cosine_similarity(v.vector, q.vector), 9) AS score FROM vectors v, vectors q WHERE q.chunk_id % 100 = 0 AND v.chunk_id <> q.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s WHERE score >= 0.3)"""


@query(f"""{_KNN} SELECT query_id, id, round(score, 6) AS score, place FROM r WHERE place <= 6""")
def nearest_vectors(c):
    """Six nearest of every vector whose id is divisible by 100, against all."""
    v = c.vectors()
    return graph.nearest(v, v.where("chunk_id % 100 = 0"), 6, 0.3).select("query_id", "id", F.round("score", 6).alias("score"), "place")


def _vector_index(c: Catalog) -> vector_index.Index:
    """All chunk vectors, written once for each state of the table."""
    return vector_index.stored("vectors", c.table("embeddings"), c.vectors().select(F.col("chunk_id").alias("id"), "vector"))


@query(f"""{_KNN.replace("q.chunk_id % 100 = 0 AND ", "")} SELECT least(query_id, id) AS a, greatest(query_id, id) AS b, round(max(score), 6) AS weight FROM r WHERE place <= 6 GROUP BY 1, 2""")
def topic_graph(c):
    """The six nearest of every vector, as a graph: by the inverted file."""
    queries = c.vectors().select(F.col("chunk_id").alias("query_id"), "vector")
    return graph.undirected(vector_index.search(_vector_index(c), queries, 6, 0.3, exact=True)).select("a", "b", F.round("weight", 6).alias("weight"))


def _asked(c: Catalog) -> DataFrame:
    return c.vectors().where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")


@query(f"""{_KNN} SELECT query_id, id, round(score, 6) AS score, place FROM r WHERE place <= 6""")
def indexed_neighbours(c):
    """`nearest_vectors` by the inverted file: the nearest lists, then those that cannot be ruled out."""
    return vector_index.search(_vector_index(c), _asked(c), 6, 0.3, exact=True).select("query_id", "id", F.round("score", 6).alias("score"), "place")


@query(f"""{_KNN.replace("v.chunk_id <> q.chunk_id", "v.chunk_id <> q.chunk_id AND v.work_id <> 3")} SELECT query_id, id, round(score, 6) AS score, place FROM r WHERE place <= 6""")
def visible_neighbours(c):
    """The six nearest among most vectors, those of all works but one: by the inverted file."""
    visible = c.vectors().where("work_id <> 3").select(F.col("chunk_id").alias("id"))
    return vector_index.search(_vector_index(c), _asked(c), 6, 0.3, visible, exact=True).select("query_id", "id", F.round("score", 6).alias("score"), "place")


@query(f"""{_KNN.replace("v.chunk_id <> q.chunk_id", "v.chunk_id <> q.chunk_id AND v.work_id = 3 AND v.chunk_id IN (SELECT id FROM live_works WHERE year >= 2000)").replace("0.3", "0.02")} SELECT query_id, id, round(score, 6) AS score, place FROM r WHERE place <= 6""")
def narrow_neighbours(c):
    """The six nearest among few vectors, those of one work: these are scanned."""
    visible = c.vectors().where("work_id = 3").select(F.col("chunk_id").alias("id")).join(c.live_works().where("year >= 2000").select("id"), "id", "left_semi")
    return vector_index.search(_vector_index(c), _asked(c), 6, 0.02, visible).select("query_id", "id", F.round("score", 6).alias("score"), "place")


@query("""s AS (SELECT q.chunk_id AS query_id, v.chunk_id AS id, round(list_cosine_similarity(v.vector, q.vector), 9) AS score FROM vectors v, vectors q WHERE v.chunk_id <> q.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s WHERE score >= 0.3)
SELECT least(query_id, id) AS a, greatest(query_id, id) AS b, round(max(score), 6) AS weight FROM r WHERE place <= 3 GROUP BY 1, 2""")
def whole_topic_graph(c):
    """The three nearest of every vector, as a graph: by the inverted file."""
    queries = c.vectors().select(F.col("chunk_id").alias("query_id"), "vector")
    return graph.undirected(vector_index.search(_vector_index(c), queries, 3, 0.3, exact=True)).select("a", "b", F.round("weight", 6).alias("weight"))


@query("""n AS (SELECT shelf_id AS src, count(*) AS n FROM shelf_works GROUP BY 1), c AS (SELECT count(*) AS k, sum(n) AS total FROM n),
b AS (SELECT src, n, least(n, greatest(1, CAST(ceil(250.0 / (SELECT k FROM c)) AS BIGINT))) AS base FROM n),
e AS (SELECT *, (n - base) * CAST(greatest(0, 500 - (SELECT sum(base) FROM b)) AS DOUBLE) / greatest((SELECT total FROM c) - (SELECT sum(base) FROM b), 1) AS exact FROM b),
f AS (SELECT *, least(CAST(floor(exact) AS BIGINT), n - base) AS fl, exact - floor(exact) AS part FROM e),
g AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN part > 0 THEN part END DESC NULLS LAST, src) AS k FROM f)
SELECT src, n, CAST(base + fl + CASE WHEN part > 0 AND k <= 500 - (SELECT sum(base) FROM b) - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END AS BIGINT) AS keep FROM g""")
def external_quota(c):
    return graph.external_quota(c.shelf_works().groupBy(F.col("shelf_id").alias("src")).agg(F.count("*").alias("n")), 500)


_TOKENS = "regexp_extract_all(lower({}), '[a-z][a-z0-9''-]+')"
_STOP = ", ".join(f"'{w}'" for w in retrieval.STOPWORDS)
_BM25 = f"""f AS (SELECT id, 'title' AS field, 3.0 AS weight, list_filter({_TOKENS.format('coalesce(title, chr(32))')}, lambda t: t NOT IN ({_STOP})) AS terms FROM texts UNION ALL
  SELECT id, 'body', 1.0, list_filter({_TOKENS.format('coalesce(body, chr(32))')}, lambda t: t NOT IN ({_STOP})) FROM texts),
m AS (SELECT field, avg(len(terms)) AS mean FROM f GROUP BY 1),
t AS (SELECT id, field, weight, len(terms) AS length, unnest(terms) AS term FROM f),
c AS (SELECT id, term, field, weight, length, count(*) AS tf FROM t GROUP BY ALL),
w AS (SELECT id, term, sum(weight * tf / (0.25 + 0.75 * length / mean)) AS wtf FROM c JOIN m USING (field) GROUP BY 1, 2),
d AS (SELECT term, count(*) AS df FROM w GROUP BY 1),
p AS (SELECT id, term, (wtf * 2.5 / (1.5 + wtf) + 1) * ln(((SELECT count(*) FROM texts) - df + 0.5) / (df + 0.5) + 1) AS score FROM w JOIN d USING (term)),
hits AS (SELECT id, round(sum(score), 6) AS score FROM p WHERE term IN ('tion', 'erth', 'oned') GROUP BY 1),
lex AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS place FROM hits WHERE score > 0 ORDER BY score DESC, id LIMIT 60)"""
_QUERY = "tion erth of oned"


@query(f"""{_BM25} SELECT id, round(score, 4) AS score FROM lex""")
def lexical_search(c):
    return retrieval.stored_search(_postings(c), _QUERY, 60).select("id", F.round("score", 4).alias("score"))


_BAGS = f"""bw AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest({_TOKENS.format("coalesce(body, '')")}) AS t FROM texts) GROUP BY 1, 2),
bags AS (SELECT * FROM (SELECT id, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % 256 AS INTEGER) AS bucket, CAST(sum(CASE WHEN ('0x' || substr(md5(t), 9, 2))::INTEGER % 2 = 1 THEN n ELSE -n END) AS DOUBLE) AS x FROM bw GROUP BY 1, 2) WHERE x <> 0),
norms AS (SELECT id, sqrt(sum(x * x)) AS norm FROM bags GROUP BY 1),
near AS (SELECT b.id, round(sum(b.x * q.x) / (any_value(n.norm) * (SELECT norm FROM norms WHERE id = 1)), 6) AS score FROM bags b JOIN bags q ON q.bucket = b.bucket AND q.id = 1 JOIN norms n ON n.id = b.id WHERE b.id <> 1 GROUP BY 1),
sem AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS place FROM near WHERE score > 0 ORDER BY score DESC, id LIMIT 60)"""


def _postings(c: Catalog) -> DataFrame:
    """Title and body, written once for each state of the documents."""
    return retrieval.written("postings", c.table("documents"), lambda: retrieval.postings(c.texts()), by_term=True, made_with=(retrieval.WEIGHTS, retrieval.STOPWORDS))


def _bags(c: Catalog) -> DataFrame:
    return retrieval.written("bags", c.table("documents"), lambda: retrieval.bag_vectors(c.texts()))


def _related(c: Catalog, limit: int) -> DataFrame:
    bags = _bags(c)
    return retrieval.nearest_bags(bags.where("id <> 1"), limit, bags.where("id = 1"))


@query(f"""{_BAGS} SELECT id, round(score, 5) AS score FROM sem""")
def related_works(c):
    """Works most like one work by hashed bags of words."""
    return _related(c, 60).select("id", F.round("score", 5).alias("score"))


@query(f"""{_BM25}, {_BAGS} SELECT id, round(sum(1.0::DOUBLE / (60 + place)), 9) AS score, count(*) AS lists FROM (SELECT id, place FROM lex UNION ALL SELECT id, place FROM sem) GROUP BY 1 ORDER BY score DESC, id LIMIT 50""")
def hybrid_search(c):
    lexical = retrieval.stored_search(_postings(c), _QUERY, 60)
    semantic = _related(c, 60).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # 60 rows
    return retrieval.fused([lexical.select("id", "place"), semantic.select("id", "place")], 50)


@query("""q AS (SELECT vector FROM vectors WHERE chunk_id = 0), s AS (SELECT work_id, chunk_id, round(list_cosine_similarity(vector, (SELECT vector FROM q)), 9) AS score FROM vectors WHERE chunk_id <> 0),
t AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 100), r AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY score DESC, chunk_id) AS k FROM t)
SELECT work_id, chunk_id, round(score, 6) AS score FROM r WHERE k = 1""")
def chunk_search(c):
    v = c.vectors()
    return retrieval.chunk_rollup(v, v.where("chunk_id = 0"), 100).select("work_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"""o AS (SELECT id, list_filter({_TOKENS.format("coalesce(body, '')")}, lambda w: w IN ('the', 'tion', 'zebra')) AS hits, len({_TOKENS.format("coalesce(body, '')")}) AS n FROM texts),
s AS (SELECT id, round(len(list_distinct(hits)) / 3.0::DOUBLE + len(hits) / CAST(greatest(n, 1) AS DOUBLE), 6) AS score FROM o) SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 40""")
def overlap_search(c):
    return retrieval.overlap(c.texts(), "the tion zebra", 40)


_MINED = "[a-z][a-z''-]{2,}"
_TFIDF = f"""mw AS (SELECT id, unnest(list_filter(regexp_extract_all(lower(coalesce(body, '')), '{_MINED}'), lambda t: t NOT IN ({_STOP}))) AS term FROM texts), mc AS (SELECT id, term, count(*) AS n FROM mw GROUP BY 1, 2)"""


@query(f"""{_TFIDF}, tt AS (SELECT id, sum(n) AS total FROM mc GROUP BY 1), df AS (SELECT term, count(*) AS df FROM mc GROUP BY 1),
w AS (SELECT id, term, CAST(n AS DOUBLE) / total * (ln((1.0 + (SELECT count(*) FROM tt)) / (1 + df)) + 1) AS weight FROM mc JOIN tt USING (id) JOIN df USING (term))
SELECT id, count(*) AS terms, round(sum(weight), 6) AS mass, round(max(weight), 6) AS peak FROM w GROUP BY 1""")
def tf_idf(c):
    return textmine.tf_idf(c.texts()).groupBy("id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("mass"), F.round(F.max("weight"), 6).alias("peak"))


@query(f"""{_TFIDF}, r AS (SELECT id, term, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, term) AS place FROM mc) SELECT id, term, n, place FROM r WHERE place <= 5""")
def paper_topics(c):
    return textmine.frequent_terms(c.texts(), 5)


@query()
def topic_model(c):
    """Clusters of texts by TF-IDF, with their six strongest terms."""
    placed, centres = textmine.text_clusters(c.texts(), 5, titles=c.texts().select("id", "title"))
    terms = textmine.cluster_terms(centres).groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda t: t["term"]), " ").alias("terms"))
    return placed.join(terms, "cluster", "left").select("id", "cluster", F.round("score", 4).alias("score"), "terms")


@query()
def text_chunks(c):
    return textmine.chunks(c.texts()).select("id", "pos", "n_words", F.sha2("chunk", 256).alias("sha256"))


@query("""SELECT conv_id, turn, lag(text) OVER w AS before, text AS sentence, lead(text) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def citation_context(c):
    s = c.table("conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), F.col("text").alias("sentence"))
    return textmine.neighbours(s).select(F.col("id").alias("conv_id"), F.col("pos").alias("turn"), "before", "sentence", "after")


@query("""f AS (SELECT text, min(doc_id) AS a FROM documents GROUP BY 1) SELECT 'same_text' AS kind, a, doc_id AS b, 1.0::DOUBLE AS score FROM documents JOIN f USING (text) WHERE doc_id <> a""")
def same_texts(c):
    rows = c.table("documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"))
    return linkage.same_key(rows, "sha256", "same_text")


@query()
def fuzzy_titles(c):
    return linkage.fuzzy_titles(c.references().select("id", "title", "year"), 70.0)


@query("""w AS (SELECT lower(title) AS t, year, min(id) AS id FROM refs WHERE score < 950 GROUP BY 1, 2), m AS (SELECT r.id AS ref_id, w.id AS work_id, row_number() OVER (PARTITION BY r.id ORDER BY w.id) AS k
  FROM refs r JOIN w ON w.t = lower(r.title) AND abs(w.year - r.year) <= 1)
SELECT ref_id, work_id, 100.0::DOUBLE AS score, 'title' AS via FROM m WHERE k = 1""")
def matched_references(c):
    """Shouted references matched by title with the cheaper papers."""
    none = F.lit(None).cast("string")
    shouted = c.references().select("id", F.concat(F.upper("title"), F.lit(".")).alias("title"), "year", none.alias("doi"))
    return linkage.matched(shouted, c.references().where("score < 950").select("id", "title", "year", none.alias("doi")), 100.0)


@query("""r AS (SELECT p_name AS key, p_partkey AS id, p_type AS title, ['unresolved', 'external', 'likely_match', 'local_match', 'rejected_match', 'confirmed_match'][p_size % 6 + 1] AS state, p_size % 6 AS rank, p_size AS age FROM part)
SELECT key, arg_min(id, age * 1000000 + id) AS survivor, arg_max(state, rank * 1000000 - id) AS state, arg_min(title, age * 1000000 + id) AS title, count(*) AS members, bool_or(rank = 5) AND bool_or(rank = 4) AS contradiction FROM r GROUP BY 1""")
def consolidated_references(c):
    p = c.table("part")
    state = F.array(*[F.lit(s) for s in linkage.STATES])[F.col("p_size") % 6]
    return linkage.consolidated(p.select(F.col("p_name").alias("key"), F.col("p_partkey").alias("id"), F.col("p_type").alias("title"), state.alias("state"), F.col("p_size").alias("created_at")))


@query("""SELECT DISTINCT citing_id, cited_id // 4 * 4 AS cited_id FROM citations""")
def repointed_edges(c):
    mapping = c.references().select(F.col("id").alias("old"), (F.col("id") - F.col("id") % 4).alias("new"))
    return linkage.remapped(c.citations().select("citing_id", "cited_id").distinct(), mapping, "cited_id")


@query("""o AS (SELECT 'doi' AS kind, least(l_orderkey, l_partkey) AS a, greatest(l_orderkey, l_partkey) AS b, max(l_discount) AS score FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2, 3),
n AS (SELECT 'doi' AS kind, least(l_orderkey, l_partkey) AS a, greatest(l_orderkey, l_partkey) AS b, max(l_tax) AS score FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2, 3)
SELECT kind, a, b, greatest(o.score, n.score) AS score, CASE WHEN o.score IS NOT NULL THEN 'dismissed' ELSE 'open' END AS status FROM o FULL JOIN n USING (kind, a, b)""")
def upserted_candidates(c):
    line = c.table("lineitem")
    pair = [F.lit("doi").alias("kind"), F.least("l_orderkey", "l_partkey").alias("a"), F.greatest("l_orderkey", "l_partkey").alias("b")]
    old = line.where("l_linenumber = 1").groupBy(*pair).agg(F.max("l_discount").alias("score")).withColumn("status", F.lit("dismissed"))
    new = line.where("l_linenumber <= 2").select(*pair, F.col("l_tax").alias("score"))
    return linkage.upserted(old, new)


@query("""o AS (SELECT 'doi' AS kind, least(l_orderkey, l_partkey) AS a, greatest(l_orderkey, l_partkey) AS b, max(l_discount) AS score FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY 1, 2, 3),
n AS (SELECT 'doi' AS kind, least(l_orderkey, l_partkey) AS a, greatest(l_orderkey, l_partkey) AS b, max(l_tax) AS score FROM lineitem WHERE l_linenumber % 3 <> 1 GROUP BY 1, 2, 3)
SELECT kind, a, b, greatest(o.score, n.score) AS score, CASE WHEN o.score IS NOT NULL THEN 'dismissed' ELSE 'open' END AS status FROM o FULL JOIN n USING (kind, a, b)""")
def whole_upserted_candidates(c):
    """Every line item is an old candidate, a new one or both, where `upserted_candidates` takes first and second lines."""
    line = c.table("lineitem")
    pair = [F.lit("doi").alias("kind"), F.least("l_orderkey", "l_partkey").alias("a"), F.greatest("l_orderkey", "l_partkey").alias("b")]
    old = line.where("l_linenumber % 3 <> 0").groupBy(*pair).agg(F.max("l_discount").alias("score")).withColumn("status", F.lit("dismissed"))
    return linkage.upserted(old, line.where("l_linenumber % 3 <> 1").select(*pair, F.col("l_tax").alias("score")))


@query(r"""SELECT id, regexp_replace(regexp_replace(trim(lower(title)), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g') AS normal, regexp_replace(regexp_replace(lower(trim(venue)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM texts""")
def normalized_titles(c):
    return c.texts().select("id", T.normalize_title(F.col("title")).alias("normal"), T.slug(F.col("venue")).alias("slug"))


@query(r"""SELECT id, CASE WHEN doi IS NOT NULL THEN 'doi:' || lower(doi) ELSE 'title:' || regexp_replace(regexp_replace(trim(lower(title)), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g') || '|' || year END AS key FROM live_works""")
def dedup_keys(c):
    spelled = F.concat(F.lit("https://doi.org/"), F.upper("doi"))
    return c.live_works().select("id", T.dedup_key(spelled, F.lit(None).cast("string"), F.col("title"), F.col("year")).alias("key"))


_KEYED = """k AS (SELECT *, coalesce(nullif(regexp_replace(lower(split_part(title, ' ', 1)), '[^a-z]', '', 'g'), ''), 'anon') || year AS base FROM refs), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS r FROM k),
e AS (SELECT *, CASE WHEN r = 1 THEN base ELSE base || r END AS cite_key FROM n)"""


def _entries(c: Catalog) -> DataFrame:
    return export.cite_keys(c.references().withColumn("doi", F.lit(None).cast("string")), F.split("title", " ")[0], F.col("year"))


@query(f"""{_KEYED} SELECT id, cite_key FROM e""")
def cite_keys(c):
    return _entries(c).select("id", "cite_key")


@query(f"""{_KEYED} SELECT id, '@article{{' || cite_key || ',' || chr(10) || '  title = {{' || title || '}},' || chr(10) || '  journal = {{' || replace(venue, '#', chr(92) || '#') || '}},' || chr(10) || '  year = {{' || year || '}}' || chr(10) || '}}' AS entry FROM e""")
def export_bibtex(c):
    return _entries(c).select("id", export.bibtex().alias("entry"))


@query("""SELECT id, 'TY  - JOUR' || chr(10) || 'TI  - ' || title || chr(10) || 'JO  - ' || venue || chr(10) || 'PY  - ' || year || chr(10) || 'ER  - ' AS entry FROM refs""")
def export_ris(c):
    return _entries(c).select("id", export.ris().alias("entry"))


@query("""SELECT id, '- **' || title || '**, *' || venue || '* (' || year || ')' AS entry FROM refs""")
def export_markdown(c):
    return _entries(c).select("id", export.markdown().alias("entry"))


@query("""SELECT id, title, year, venue FROM refs""")
def ris_round_trip(c):
    """Written as RIS and read again."""
    text = _entries(c).select("id", export.ris().alias("text"))
    return bibliography.read_ris(text).select("id", "title", "year", "venue")


@query(f"""{_KEYED} SELECT id, cite_key, title, year, venue FROM e""")
def bibtex_round_trip(c):
    text = _entries(c).select("id", export.bibtex().alias("text"))
    return bibliography.read_bibtex(text).select("id", "cite_key", "title", "year", "venue")


@query(f"""{_KEYED} SELECT id, title, year, venue FROM e""")
def csl_round_trip(c):
    text = _entries(c).select(F.col("id").alias("work"), export.csl_json().alias("text"))
    return bibliography.read_csl(text).select(F.col("work").alias("id"), "title", "year", "venue")


@query("""a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref\\s*=\\s*"([^"]*)"', 1)) AS href FROM pages) SELECT page_id, count(*) AS n, count(DISTINCT href) AS n_different FROM a GROUP BY 1""", True)
def page_links(c):
    return bibliography.links(c.table("pages")).groupBy("page_id").agg(F.count("*").alias("n"), F.countDistinct("href").alias("n_different"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""", False)
def event_rates(c):
    return ev.rates(c.table("events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS start, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 4""", False)
def rate_limited_users(c):
    return ev.over_limit(c.table("events"), 4).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""w AS (SELECT user_id, date_trunc('hour', ts) - to_hours(k) AS start FROM events, range(6) r(k) WHERE event_type = 'error') SELECT start, user_id, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 2""".replace("w AS", "WITH w AS", 1), False)
def repeated_failures(c):
    return ev.failures(c.table("events"), 2).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""", False)
def user_sessions(c):
    return ev.sessions(c.table("events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT user_id, event_type, arg_max(value, epoch_us(ts) * 10 + event_id % 10) AS value, max(ts) AS ts FROM events GROUP BY 1, 2""", False)
def newest_values(c):
    return ev.newest(c.table("events"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""", False)
def streamed_rates(c):
    """The same windows from a stream that is run to its end."""
    import uuid

    rows = ev.rates(ev.stream(c.spark, c.folder))
    return ev.drained(rows, f"rates_{uuid.uuid4().hex}").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT user_id, count(*) AS n, max(value) AS peak FROM events GROUP BY 1""", False)
def streamed_state(c):
    """The last state of each user, kept by a stateful operator."""
    import uuid

    rows = ev.drained(ev.running(ev.stream(c.spark, c.folder)), f"state_{uuid.uuid4().hex}", "update")
    return rows.groupBy("user_id").agg(F.max("n").alias("n"), F.max("peak").alias("peak"))


@query("""SELECT entity_id, field_name, count(*) AS n_claims, count(DISTINCT value) AS n_values, min(value) FILTER (canonical) AS canonical_value, count(DISTINCT value) > 1 AS has_conflict FROM assertions GROUP BY 1, 2""")
def field_reviews(c):
    return library.field_reviews(c.assertions())


@query("""SELECT w.id, coalesce(string_agg(DISTINCT h.name, ', ' ORDER BY h.name), '(none)') AS "group" FROM live_works w LEFT JOIN shelf_works s ON s.work_id = w.id LEFT JOIN shelves h USING (shelf_id) GROUP BY 1""")
def membership_groups(c):
    return library.membership(c.live_works(), c.shelf_works(), c.shelves())


@query("""SELECT id, concat_ws(',', CASE WHEN doi IS NULL THEN 'no_doi' END, CASE WHEN citation_count > 300000 THEN 'cited' END, CASE WHEN year = 1997 THEN 'old' END) AS badges FROM live_works""")
def work_badges(c):
    flags = c.live_works().select("id", F.col("doi").isNull().alias("no_doi"), F.coalesce(F.col("citation_count") > 300000, F.lit(False)).alias("cited"), (F.col("year") == 1997).alias("old"))
    return library.badges(flags, ["no_doi", "cited", "old"])


@query("""r AS (SELECT c_custkey AS rec_id, CASE WHEN c_nationkey % 2 = 0 THEN '10.1000/w' || c_custkey END AS doi, lower(c_mktsegment) AS norm FROM customer),
t AS (SELECT lower(venue) AS norm, min(id) AS id FROM live_works GROUP BY 1), d AS (SELECT doi, min(id) AS id FROM live_works WHERE doi IS NOT NULL GROUP BY 1)
SELECT rec_id, coalesce(d.id, t.id) AS work_id, CASE WHEN coalesce(d.id, t.id) IS NULL THEN 'new' ELSE 'matched' END AS status FROM r LEFT JOIN d USING (doi) LEFT JOIN t ON t.norm = r.norm""")
def imported_records(c):
    doi = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("10.1000/w"), F.col("c_custkey").cast("string")))
    records = c.table("customer").select(F.col("c_custkey").alias("rec_id"), doi.alias("doi"), F.lower("c_mktsegment").alias("norm"))
    return library.imported(records, c.live_works().withColumn("norm", F.lower("venue")))


@query("""p AS (SELECT l_orderkey AS a, l_partkey AS b, l_returnflag = 'A' AS ca, l_returnflag = 'N' AS cb, l_linenumber AS va, p_size AS vb, l_quantity AS fa, p_retailprice AS fb FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT a, b, CASE WHEN cb > ca OR (cb = ca AND (vb > va OR (vb = va AND fb > fa))) THEN b ELSE a END AS survivor FROM p""")
def merge_survivors(c):
    line, part = c.table("lineitem"), c.table("part")
    pairs = line.join(part, line["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), (F.col("l_returnflag") == "A").alias("confirmed_a"), (F.col("l_returnflag") == "N").alias("confirmed_b"), F.col("l_linenumber").alias("version_a"), F.col("p_size").alias("version_b"), F.col("l_quantity").alias("complete_a"), F.col("p_retailprice").alias("complete_b"))
    return library.survivor(pairs)


@query("""r AS (SELECT citing_id AS work_id, cited_id AS child_id, row_number() OVER (PARTITION BY citing_id ORDER BY position, cited_id) AS place FROM citations) SELECT work_id, child_id, place, CAST(3 - place + 1 AS DOUBLE) AS points FROM r WHERE place <= 3""")
def rank_points(c):
    place = F.row_number().over(Window.partitionBy("citing_id").orderBy("position", "cited_id"))
    return recommend.rank_points(c.citations().select(F.col("citing_id").alias("work_id"), F.col("cited_id").alias("child_id"), place.alias("place")), 3)


@query("""s AS (SELECT shelf_id, CAST(count(*) AS DOUBLE) AS score FROM shelf_works GROUP BY 1), r AS (SELECT rack_id, CAST(count(*) AS DOUBLE) AS score FROM shelves GROUP BY 1)
SELECT 1 AS level, rack_id AS id, score FROM r UNION ALL SELECT 2, shelf_id, round(s.score + 0.5 * r.score, 6) FROM s JOIN shelves USING (shelf_id) JOIN r USING (rack_id)""")
def propagated_scores(c):
    """Shelves take half of their rack's score."""
    racks = c.shelves().groupBy(F.col("rack_id").alias("id")).agg(F.count("*").cast("double").alias("score")).select(F.lit(1).alias("level"), "id", "score")
    shelves = c.shelf_works().groupBy(F.col("shelf_id").alias("id")).agg(F.count("*").cast("double").alias("score")).select(F.lit(2).alias("level"), "id", "score")
    chain = c.shelves().select(F.lit(2).alias("level"), F.col("shelf_id").alias("id"), F.lit(1).alias("parent_level"), F.col("rack_id").alias("parent_id"))
    return recommend.propagated(racks.unionAll(shelves), chain)


@query("""f AS (SELECT p_name AS title, p_size + 1970 AS year, p_brand AS source, string_split(p_type, ' ') AS authors FROM part)
SELECT lower(title) || '|' || year AS key, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, max(len(authors)) AS n_authors FROM f GROUP BY 1""")
def web_candidates(c):
    found = c.references().select(F.lit(None).cast("string").alias("doi"), "title", "year", F.col("venue").alias("source"), F.split("work_type", " ").alias("authors"))
    return recommend.candidates(found).select("key", "sources", F.size("authors").alias("n_authors"))


@query("""SELECT event_id, user_id, ts, count(*) OVER w AS n, count(*) OVER w >= 3 AS locked FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)""", False)
def locked_users(c):
    return ev.locked(c.table("events"), 3)


@query("""r AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) SELECT user_id, event_type, event_id, ts FROM r WHERE k = 1""")
def coalesced_jobs(c):
    return ev.coalesced(c.table("events"), ["user_id", "event_type"])


@query("""SELECT a.user_id, a.event_id AS start_id, a.ts AS started, b.event_id AS end_id, b.ts AS ended FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 DAY WHERE a.event_type = 'signup' AND b.event_type = 'purchase'""", False)
def completed_jobs(c):
    e = c.table("events")
    done = ev.completed(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"))
    return done.withColumns({n: F.col(n).cast("timestamp_ntz") for n in ("started", "ended")})


@query("""a AS (SELECT url AS path, min(page_id) AS size, 0 AS mtime FROM pages WHERE length(html) > 1500 GROUP BY 1), b AS (SELECT url AS path, max(page_id) AS size, 0 AS mtime FROM pages WHERE length(html) < 2500 GROUP BY 1)
SELECT path, CASE WHEN a.size IS NULL THEN 'new' WHEN b.size IS NULL THEN 'missing' ELSE 'changed' END AS change FROM a FULL JOIN b USING (path) WHERE a.size IS DISTINCT FROM b.size""")
def scan_changes(c):
    p = c.table("pages")
    a = p.where("length(html) > 1500").groupBy(F.col("url").alias("path")).agg(F.min("page_id").alias("size")).withColumn("mtime", F.lit(0))
    b = p.where("length(html) < 2500").groupBy(F.col("url").alias("path")).agg(F.max("page_id").alias("size")).withColumn("mtime", F.lit(0))
    return ev.scan_changes(a, b)


@query("""SELECT user_id AS id, arg_min(CAST(value AS VARCHAR), event_id % 4 * 10000000 + event_id) FILTER (event_type = 'click') AS title, arg_min(CAST(value AS VARCHAR), event_id % 4 * 10000000 + event_id) FILTER (event_type = 'view') AS venue FROM events GROUP BY 1""", False)
def merged_fields(c):
    """First value of each field over sources in order."""
    e = c.table("events").select(F.col("user_id").alias("id"), *[F.when(F.col("event_type") == t, F.col("value").cast("string")).alias(n) for t, n in (("click", "title"), ("view", "venue"))], (F.col("event_id") % 4 * 10000000 + F.col("event_id")).alias("rank"))
    return linkage.merge_fill(e, ["title", "venue"], "rank")


@query("""v AS (SELECT * FROM vectors ORDER BY chunk_id DESC LIMIT 50) SELECT a.chunk_id AS a, b.chunk_id AS b, round(list_cosine_similarity(a.vector, b.vector), 6) AS score FROM v a JOIN v b ON a.chunk_id < b.chunk_id""")
def similarity_heatmap(c):
    """The 50 newest vectors with each other."""
    v = c.vectors().orderBy(F.desc("chunk_id")).limit(50)
    a, b = (v.select(F.col("chunk_id").alias(n), F.col("vector").alias(f"_{n}")) for n in "ab")
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(T.cosine(F.col("_a"), F.col("_b")), 6).alias("score"))


@query("""d AS (SELECT cited_id, count(DISTINCT citing_id) AS n FROM citations GROUP BY 1) SELECT r.id, r.year, coalesce(n, 0) AS citers, round(coalesce(n, 0) / CAST(greatest(1, 2024 - r.year) AS DOUBLE), 6) AS velocity FROM refs r LEFT JOIN d ON cited_id = r.id""")
def temporal_map(c):
    """Papers by year and citation velocity, as of 2024."""
    n = c.citations().groupBy("cited_id").agg(F.countDistinct("citing_id").alias("n"))
    r = c.references().join(n, F.col("id") == F.col("cited_id"), "left")
    return r.select("id", "year", F.coalesce("n", F.lit(0)).alias("citers"), F.round(F.coalesce("n", F.lit(0)) / F.greatest(F.lit(1), 2024 - F.col("year")), 6).alias("velocity"))


@query("""SELECT count(*) AS total, count(*) FILTER (doi IS NULL) AS without_doi, count(*) FILTER (citation_count IS NULL) AS without_count, (SELECT count(DISTINCT work_id) FROM vectors) AS embedded FROM live_works""")
def coverage(c):
    w = c.live_works().agg(F.count("*").alias("total"), F.count_if(F.col("doi").isNull()).alias("without_doi"), F.count_if(F.col("citation_count").isNull()).alias("without_count"))
    return w.crossJoin(c.vectors().agg(F.countDistinct("work_id").alias("embedded")))  # two single rows


@query("""SELECT id, '<li>' || title || ', <i>' || venue || '</i> (' || year || ')</li>' AS entry FROM refs""")
def export_html(c):
    return _entries(c).select("id", export.html().alias("entry"))


@query(f"""{_KEYED} SELECT id, chr(92) || 'bibitem{{' || cite_key || '}} ' || title || '. ' || chr(92) || 'emph{{' || replace(venue, '#', chr(92) || '#') || '}}.' AS entry FROM e""")
def export_latex(c):
    return _entries(c).select("id", export.latex().alias("entry"))


@query("""t AS (SELECT id, list_distinct(string_split(lower(title), ' ')) AS a, list_distinct(string_split(lower(work_type), ' ')) AS b FROM refs)
SELECT id, round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 4) AS jaccard FROM t""")
def keyword_overlap(c):
    words = [F.array_distinct(F.split(F.lower(n), " ")) for n in ("title", "work_type")]
    return c.references().select("id", F.round(T.jaccard(*words), 4).alias("jaccard"))


@query("""s AS (SELECT length(body) AS chars, len(string_split(body, chr(10))) AS lines, id FROM texts) SELECT id, CASE WHEN chars = 0 THEN 'none' WHEN chars < greatest(200, 100 * lines // 4) THEN 'poor' ELSE 'good' END AS layer FROM s""")
def text_layer_quality(c):
    chars, lines = F.length("body"), F.size(F.split("body", "\n"))
    return c.texts().select("id", F.when(chars == 0, "none").when(chars < F.greatest(F.lit(200), F.floor(100 * lines / 4)), "poor").otherwise("good").alias("layer"))


@query("""SELECT DISTINCT u.user_id FROM (SELECT DISTINCT user_id FROM events) u WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = u.user_id) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = u.user_id)""")
def known_hashes(c):
    """Probes that exist and are linked to a paper."""
    probes = c.table("events").select("user_id").distinct()
    return probes.join(c.table("customer"), F.col("user_id") == F.col("c_custkey"), "left_semi").join(c.table("orders"), F.col("user_id") == F.col("o_custkey"), "left_semi")


@query("""x AS (SELECT c_custkey AS id, c_acctbal AS score FROM customer) SELECT id, round(greatest(0.0, score) / max(score) OVER (), 6) AS relevance FROM x""")
def relevance(c):
    """Scores over the best one; the best comes from one aggregate, not from a global window."""
    x = c.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    return x.crossJoin(x.agg(F.max("score").alias("best"))).select("id", F.round(F.greatest(F.lit(0.0), F.col("score")) / F.col("best"), 6).alias("relevance"))


@query("""n AS (SELECT id, trim(unnest(string_split(title || '; ' || venue || ';', ';'))) AS name FROM refs), p AS (SELECT id, name, string_split_regex(lower(name), '\\s+') AS w FROM n WHERE name <> '')
SELECT trim(w[-1] || ' ' || CASE WHEN len(w) > 1 THEN substr(lower(name), 1, 1) ELSE '' END) AS author, count(DISTINCT id) AS n, count(DISTINCT name) AS spellings FROM p GROUP BY 1""")
def author_summary(c):
    """Titles and brands stand in for names."""
    return reports.authors(c.references().withColumn("authors", F.concat_ws("; ", "title", "venue")))


@query("""SELECT work_id, min(name) AS shelf FROM shelf_works JOIN shelves USING (shelf_id) WHERE access_level IN ('open', 'visible') GROUP BY 1""")
def first_shelves(c):
    return reports.first_container(c.shelf_works(), c.shelves())


@query("""SELECT id, id IN (SELECT citing_id FROM citations WHERE marker = 'O' AND section = 'N') OR id IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000) AS warning FROM live_works""")
def warned_works(c):
    a = c.citations().where("marker = 'O' and section = 'N'").select(F.col("citing_id").alias("id"))
    b = c.table("orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("id"))
    return reports.warned(c.live_works(), [a, b])


_MERGE = """m AS (SELECT DISTINCT user_id AS source, user_id - user_id % 4 AS target FROM events WHERE user_id % 4 <> 0),
n AS (SELECT t.work_id, t.tag, m.target FROM tags t LEFT JOIN m ON m.source = t.work_id),
j AS (SELECT n.work_id AS was, n.tag, n.target, n.target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tags h WHERE h.work_id = n.target AND h.tag = n.tag)
  AND n.work_id = (SELECT min(x.work_id) FROM n x WHERE x.target = n.target AND x.tag = n.tag) AS moves FROM n)"""


def _journal(c: Catalog) -> DataFrame:
    users = c.table("events").select(F.col("user_id").alias("source")).distinct()
    mapping = users.where("source % 4 <> 0").withColumn("target", F.col("source") - F.col("source") % 4)
    return linkage.merged_links(c.tags(), mapping, "tag")


@query(f"""{_MERGE} SELECT was, CASE WHEN moves THEN target ELSE was END AS work_id, tag, CASE WHEN moves THEN 'moved' WHEN target IS NOT NULL THEN 'kept' ELSE 'untouched' END AS action FROM j""")
def merged_links(c):
    return _journal(c)


@query("""SELECT work_id, tag FROM tags""")
def unmerged_links(c):
    """Merged, and taken apart again by the journal of what has moved."""
    journal = _journal(c)
    return linkage.unmerged(journal.select("work_id", "tag"), journal, "tag")


@query("""i AS (SELECT p_partkey AS item_id, '10.1000/w' || (p_size * 40) AS doi, p_name AS title FROM part), l AS (SELECT p_name AS title FROM part WHERE p_retailprice > 999),
n AS (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY item_id) AS k FROM i)
SELECT item_id, CASE WHEN doi IN (SELECT doi FROM live_works WHERE id < 500 AND doi IS NOT NULL) THEN 'in_library' WHEN k > 1 THEN 'in_batch' WHEN title IN (SELECT title FROM l) THEN 'same_title' ELSE 'accept' END AS fate FROM n""")
def staged_items(c):
    items = c.table("part").select(F.col("p_partkey").alias("item_id"), F.concat(F.lit("10.1000/w"), (F.col("p_size") * 40).cast("string")).alias("doi"), F.col("p_name").alias("title"))
    known = c.live_works().where("id < 500").select("doi", F.lit(None).cast("string").alias("title"))
    named = c.table("part").where("p_retailprice > 999").select(F.lit(None).cast("string").alias("doi"), F.col("p_name").alias("title"))
    return linkage.staged(items, known.unionAll(named))


@query("""i AS (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 5 <> 0 THEN '10.1000/w' || (p_partkey - p_partkey % 3) END AS doi, p_name || ' ' || p_size AS title FROM part),
l AS (SELECT p_name || ' ' || p_size AS title FROM part WHERE p_partkey % 7 = 3), n AS (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY item_id) AS k FROM i)
SELECT item_id, CASE WHEN doi IN (SELECT doi FROM live_works WHERE doi IS NOT NULL) THEN 'in_library' WHEN doi IS NOT NULL AND k > 1 THEN 'in_batch' WHEN title IN (SELECT title FROM l) THEN 'same_title' ELSE 'accept' END AS fate FROM n""")
def whole_staged_items(c):
    """Against the whole library, with DOIs of which some are in it."""
    p, title = c.table("part"), F.concat_ws(" ", "p_name", "p_size")
    doi = F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("10.1000/w"), (F.col("p_partkey") - F.col("p_partkey") % 3).cast("string")))
    named = p.where("p_partkey % 7 = 3").select(F.lit(None).cast("string").alias("doi"), title.alias("title"))
    known = c.live_works().select("doi", F.lit(None).cast("string").alias("title"))
    return linkage.staged(p.select(F.col("p_partkey").alias("item_id"), doi.alias("doi"), title.alias("title")), known.unionAll(named))


@query(f"""{_BM25}, {_BAGS}, ov AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) AS place FROM (SELECT id, len(terms) AS n FROM f WHERE field = 'body') ORDER BY n DESC, id LIMIT 60)
SELECT id, round(sum(1.0::DOUBLE / (60 + place)), 9) AS score, count(*) AS lists FROM (SELECT id, place FROM lex UNION ALL SELECT id, place FROM sem UNION ALL SELECT id, place FROM ov) GROUP BY 1 ORDER BY score DESC, id LIMIT 30""")
def fused_rankings(c):
    """Three rankings fused: lexical, vectors, and the longest texts."""
    lexical = retrieval.stored_search(_postings(c), _QUERY, 60)
    semantic = _related(c, 60).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # 60 rows
    size = F.size(F.filter(T.tokens(F.col("body")), lambda t: ~t.isin(*retrieval.STOPWORDS)))
    long = c.texts().select("id", size.alias("n")).orderBy(F.desc("n"), "id").limit(60).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "id")))  # 60 rows
    return retrieval.fused([r.select("id", "place") for r in (lexical, semantic, long)], 30)


@query("""SELECT turn, role, conv_id, text FROM conversations WHERE text ILIKE '%and%' AND role = 'user' ORDER BY turn DESC, conv_id LIMIT 25""")
def annotation_search(c):
    """Notes that contain a word, latest turn first."""
    return c.table("conversations").where(F.col("text").ilike("%and%") & (F.col("role") == "user")).select("turn", "role", "conv_id", "text").orderBy(F.desc("turn"), "conv_id").limit(25)


@query("""SELECT id FROM live_works WHERE reading_status = 'O' AND year >= 1999""")
def saved_filter(c):
    """A stored query, replayed to ids."""
    import json

    stored = json.dumps({"q": "status:O year:>=1999"})
    return dsl.filtered(c.live_works(), dsl.parse(json.loads(stored)["q"])).select("id")


@query("""SELECT event_type AS state, count(*) AS n, max(ts) AS latest FROM events GROUP BY 1""", False)
def job_states(c):
    return c.table("events").groupBy(F.col("event_type").alias("state")).agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


@query("""SELECT event_id, user_id, event_type, ts FROM events ORDER BY ts DESC, event_id LIMIT 50 OFFSET 50""", False)
def audit_page(c):
    return c.table("events").select("event_id", "user_id", "event_type", "ts").orderBy(F.desc("ts"), "event_id").offset(50).limit(50)
