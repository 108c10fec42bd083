"""The logical tables of a paper library, as views over the stored tables.

Papers that cite are orders, papers that are cited are parts, and a line item is
one citation of a part by an order.  Nations are shelves and regions are racks;
an order stands on its customer's shelf.  Documents are full texts, embeddings
are chunk vectors, and events carry tags, field values and audit entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Catalog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._own: dict[str, DataFrame] = {}

    def over(self, **tables: DataFrame) -> Catalog:
        """The same library with other stored tables in place of some."""
        other = Catalog(self.spark, self.folder)
        other._own = tables
        return other

    def table(self, name: str) -> DataFrame:
        if name in self._own:
            return self._own[name]
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def works(self) -> DataFrame:
        """Citing papers."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("Study "), F.col("o_orderkey").cast("string"), F.lit(" on "), F.lower(F.col("o_orderpriority"))).alias("title"),
            F.col("o_orderpriority").alias("venue"),
            F.col("o_orderstatus").alias("reading_status"),
            F.year("o_orderdate").alias("year"),
            F.col("o_orderdate").alias("updated_at"),
            F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("10.1000/w"), F.col("o_orderkey").cast("string"))).alias("doi"),
            F.col("o_custkey").alias("owner_id"),
            # Shadows of merged papers are invisible to every operator.
            F.when(F.col("o_orderkey") % 50 == 7, F.col("o_orderkey") - 1).alias("merged_into_id"),
            F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("citation_count"),
        )

    def live_works(self) -> DataFrame:
        return self.works().where("merged_into_id is null")

    def references(self) -> DataFrame:
        """Cited papers."""
        return self.table("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("title"),
            F.col("p_brand").alias("venue"),
            F.col("p_type").alias("work_type"),
            (F.col("p_size") + 1970).alias("year"),
            F.col("p_retailprice").alias("score"),
        )

    def citations(self) -> DataFrame:
        """One row for each mention of a cited paper."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("citing_id"), F.col("l_partkey").alias("cited_id"), F.col("l_linenumber").alias("position"), F.col("l_returnflag").alias("section"), F.col("l_linestatus").alias("marker"))

    def shelf_works(self) -> DataFrame:
        return self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("work_id"), F.col("c_nationkey").alias("shelf_id"))

    def shelves(self) -> DataFrame:
        access = F.when(F.col("n_nationkey") % 3 == 0, "open").when(F.col("n_nationkey") % 3 == 1, "visible").otherwise("private")
        return self.table("nation").select(F.col("n_nationkey").alias("shelf_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("rack_id"), access.alias("access_level"))

    def racks(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").alias("rack_id"), F.col("r_name").alias("name"))

    def tags(self) -> DataFrame:
        """A strong enough event tags its user's paper with its type."""
        return self.table("events").where("value >= 120").select(F.col("user_id").alias("work_id"), F.col("event_type").alias("tag")).distinct()

    def assertions(self) -> DataFrame:
        """Claims about fields of entities, from several sources."""
        e = self.table("events")
        return e.select(
            F.col("event_id").alias("assertion_id"),
            F.col("user_id").alias("entity_id"),
            F.col("event_type").alias("field_name"),
            F.floor("value").cast("long").cast("string").alias("value"),
            F.when(F.col("value") >= 1, F.col("value") / 100).alias("confidence"),
            (F.col("event_id") % 11 == 0).alias("canonical"),
            F.concat(F.lit("source"), (F.col("event_id") % 4).cast("string")).alias("source"),
            F.col("ts").alias("retrieved_at"),
        )

    def texts(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("id"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("body"), F.col("source").alias("venue"), "lang")

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("work_id"), F.col("embedding").cast("array<double>").alias("vector"))

    def identified_works(self) -> DataFrame:
        """Live papers with a DOI or an arXiv identifier."""
        number = F.lpad(F.col("id").cast("string"), 5, "0")
        return self.live_works().withColumn("arxiv", F.when(F.col("id") % 4 == 0, F.concat(F.lit("2101."), number, F.lit("v"), (F.col("id") % 3 + 1).cast("string"))))

    def identified_references(self) -> DataFrame:
        """Cited papers as they are spelled in reference lists: some with a DOI, an arXiv identifier or a stored link, some with nothing."""
        k = F.col("p_partkey")
        number = F.lpad(k.cast("string"), 5, "0")
        doi = F.when(k % 3 != 0, F.concat(F.lit("https://doi.org/10.1000/W"), (k - k % 2).cast("string"))).when(k % 9 == 0, F.concat(F.lit("10.48550/arXiv.2101."), number))
        return self.table("part").select(
            k.alias("id"),
            F.when(k % 12 != 0, F.col("p_name")).alias("title"),
            (F.col("p_size") + 1970).alias("year"),
            doi.alias("doi"),
            F.when(k % 5 == 0, F.concat(F.lit("arXiv:2101."), number, F.lit("v1"))).alias("arxiv"),
            F.when(k % 11 == 0, k + 1).alias("stored_id"),
        )

    def files(self) -> DataFrame:
        """Stored files: web pages."""
        status = F.array(*[F.lit(x) for x in ("extracted", "extract_failed", "queued")])[(F.col("page_id") % 3).cast("int")]
        quality = F.when(F.length("html") < 1500, "poor").otherwise("good")
        return self.table("pages").select(F.col("page_id").alias("file_id"), F.sha2("html", 256).alias("sha256"), F.col("url").alias("path"), F.length("html").alias("size"), status.alias("status"), quality.alias("quality"))

    def file_links(self) -> DataFrame:
        """Which papers a file belongs to; every seventh is loose."""
        f = self.table("pages").where("page_id % 7 <> 3")
        return f.select(F.col("page_id").alias("file_id"), (F.col("page_id") * 3 % 1000 + 1).alias("work_id")).unionAll(f.where("page_id % 4 = 0").select("page_id", F.col("page_id") % 500 + 1)).distinct()

    def sections(self) -> DataFrame:
        """Texts by section: each line is one."""
        labels = F.array(*[F.lit(x) for x in ("1 Introduction", "2 Methods", "2.1 Data", "Related work", "3 Results", "Acknowledgments")])
        lines = self.table("documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
        label = F.when(F.col("pos") == 0, "title").when(F.col("pos") == 1, "abstract").otherwise(labels[(F.col("pos") - 2) % 6])
        return lines.where("text <> ''").select("id", "pos", label.alias("label"), "text")

    def shelf_links(self) -> DataFrame:
        """A weighted graph of shelves: citing shelf to the cited paper's supplier's shelf."""
        line, supplier = self.table("lineitem"), self.table("supplier")
        ends = line.join(self.shelf_works(), line["l_orderkey"] == F.col("work_id")).join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
        return ends.where("shelf_id <> s_nationkey").groupBy(F.col("shelf_id").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("weight"))


#: The same views for DuckDB, to put before a query.
SQL = """works AS (SELECT o_orderkey AS id, 'Study ' || o_orderkey || ' on ' || lower(o_orderpriority) AS title, o_orderpriority AS venue, o_orderstatus AS reading_status,
  CAST(year(o_orderdate) AS INTEGER) AS year, o_orderdate AS updated_at, CASE WHEN o_orderkey % 4 <> 0 THEN '10.1000/w' || o_orderkey END AS doi, o_custkey AS owner_id,
  CASE WHEN o_orderkey % 50 = 7 THEN o_orderkey - 1 END AS merged_into_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS citation_count FROM orders),
live_works AS (SELECT * FROM works WHERE merged_into_id IS NULL),
refs AS (SELECT p_partkey AS id, p_name AS title, p_brand AS venue, p_type AS work_type, p_size + 1970 AS year, p_retailprice AS score FROM part),
citations AS (SELECT l_orderkey AS citing_id, l_partkey AS cited_id, l_linenumber AS position, l_returnflag AS section, l_linestatus AS marker FROM lineitem),
shelf_works AS (SELECT o_orderkey AS work_id, c_nationkey AS shelf_id FROM orders JOIN customer ON o_custkey = c_custkey),
shelves AS (SELECT n_nationkey AS shelf_id, n_name AS name, n_regionkey AS rack_id, CASE n_nationkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'visible' ELSE 'private' END AS access_level FROM nation),
racks AS (SELECT r_regionkey AS rack_id, r_name AS name FROM region),
tags AS (SELECT DISTINCT user_id AS work_id, event_type AS tag FROM events WHERE value >= 120),
assertions AS (SELECT event_id AS assertion_id, user_id AS entity_id, event_type AS field_name, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS value,
  CASE WHEN value >= 1 THEN value / 100 END AS confidence, event_id % 11 = 0 AS canonical, 'source' || (event_id % 4) AS source, ts AS retrieved_at FROM events),
texts AS (SELECT doc_id AS id, string_split(text, chr(10))[1] AS title, text AS body, source AS venue, lang FROM documents),
vectors AS (SELECT vec_id AS chunk_id, label AS work_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
shelf_links AS (SELECT shelf_id AS src, s_nationkey AS dst, count(*) AS weight FROM lineitem JOIN shelf_works ON l_orderkey = work_id JOIN supplier ON l_suppkey = s_suppkey WHERE shelf_id <> s_nationkey GROUP BY 1, 2),
idworks AS (SELECT *, CASE WHEN id % 4 = 0 THEN '2101.' || lpad(CAST(id AS VARCHAR), 5, '0') || 'v' || (id % 3 + 1) END AS arxiv FROM live_works),
idrefs AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 12 <> 0 THEN p_name END AS title, p_size + 1970 AS year,
  CASE WHEN p_partkey % 3 <> 0 THEN 'https://doi.org/10.1000/W' || (p_partkey - p_partkey % 2) WHEN p_partkey % 9 = 0 THEN '10.48550/arXiv.2101.' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') END AS doi,
  CASE WHEN p_partkey % 5 = 0 THEN 'arXiv:2101.' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || 'v1' END AS arxiv, CASE WHEN p_partkey % 11 = 0 THEN p_partkey + 1 END AS stored_id FROM part),
files AS (SELECT page_id AS file_id, sha256(html) AS sha256, url AS path, length(html) AS size, ['extracted', 'extract_failed', 'queued'][page_id % 3 + 1] AS status, CASE WHEN length(html) < 1500 THEN 'poor' ELSE 'good' END AS quality FROM pages),
file_links AS (SELECT page_id AS file_id, page_id * 3 % 1000 + 1 AS work_id FROM pages WHERE page_id % 7 <> 3 UNION SELECT page_id, page_id % 500 + 1 FROM pages WHERE page_id % 7 <> 3 AND page_id % 4 = 0),
sections AS (SELECT id, pos, CASE WHEN pos = 0 THEN 'title' WHEN pos = 1 THEN 'abstract' ELSE ['1 Introduction', '2 Methods', '2.1 Data', 'Related work', '3 Results', 'Acknowledgments'][(pos - 2) % 6 + 1] END AS label, text
  FROM (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE text <> '')
"""
