"""References resolved to papers, external nodes, and what is missing from a library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import arxiv_base, arxiv_from_doi, normalize_doi, normalize_title
from ..session import spread

#: Nodes that a drawn graph keeps.
NODES = 1500


def identifier_keys(doi: Column, arxiv: Column) -> Column:
    """What a paper is looked up by, in this order: `doi:...`, `arxiv:...`; a DOI that spells an arXiv identifier gives both."""
    plain = F.nullif(normalize_doi(doi), F.lit(""))
    base = F.coalesce(F.nullif(arxiv_base(arxiv), F.lit("")), arxiv_from_doi(doi))
    return F.array_compact(F.array(F.concat(F.lit("doi:"), plain), F.concat(F.lit("arxiv:"), base)))


def identifier_index(works: DataFrame) -> DataFrame:
    """(key, work_id): the first paper of each key."""
    return works.select("id", F.explode(identifier_keys(F.col("doi"), F.col("arxiv"))).alias("key")).groupBy("key").agg(F.min("id").alias("work_id"))


def resolved(references: DataFrame, works: DataFrame) -> DataFrame:
    """references with work_id, kind (stored, identifier, external, unresolved) and the node that they are in a graph.

    A stored link is trusted; else the first key that a paper has decides;
    else what names itself is external, under its first key.
    """
    keys = identifier_keys(F.col("doi"), F.col("arxiv"))
    met = references.select("id", F.posexplode(keys).alias("place", "key")).join(identifier_index(works), "key").groupBy("id").agg(F.min_by("work_id", "place").alias("_found"))
    named = F.coalesce("title", "doi", "arxiv").isNotNull()
    kind = F.when(F.col("stored_id").isNotNull(), "stored").when(F.col("_found").isNotNull(), "identifier").when(named, "external").otherwise("unresolved")
    out = references.join(met, "id", "left").withColumns({"work_id": F.coalesce("stored_id", "_found"), "kind": kind}).drop("_found")
    external = F.concat(F.lit("ext:"), F.coalesce(F.get(keys, F.lit(0)), F.concat(F.lit("ref:"), F.col("id").cast("string"))))
    return out.withColumn("node", F.when(F.col("work_id").isNotNull(), F.col("work_id").cast("string")).when(F.col("kind") == "external", external))


def graph_edges(citations: DataFrame, references: DataFrame) -> DataFrame:
    """(src, dst, weight): how many different references of a paper lead to a node; loops and unresolved ones are left out."""
    r = references.where("node is not null").select(F.col("id").alias("cited_id"), F.col("node").alias("dst"))
    rows = citations.select(F.col("citing_id").cast("string").alias("src"), "cited_id").distinct().join(r, "cited_id").where("src <> dst")
    return rows.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def external_nodes(citations: DataFrame, references: DataFrame) -> DataFrame:
    """(node, label, n_references, citers, mentions) of papers outside the library, references of one key as one."""
    r = references.where("kind = 'external'").select("node", "id", F.coalesce("title", "doi", "arxiv").alias("label"))
    nodes = r.groupBy("node").agg(F.min_by("label", "id").alias("label"), F.count("*").alias("n_references"))
    cited = citations.join(r.select(F.col("id").alias("cited_id"), "node"), "cited_id").groupBy("node").agg(F.countDistinct("citing_id").alias("citers"), F.count("*").alias("mentions"))
    return nodes.join(cited, "node", "left").na.fill(0, ["citers", "mentions"])


def capped(edges: DataFrame, most: int = NODES) -> tuple[DataFrame, DataFrame]:
    """(node, weight) of the best connected nodes, local ones first among equals, and the edges between these."""
    ends = edges.select(F.col("src").alias("node"), "weight").unionAll(edges.select(F.col("dst").alias("node"), "weight"))
    nodes = ends.groupBy("node").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), F.col("node").startswith("ext:"), "node").limit(most)
    kept = F.broadcast(nodes.select("node"))  # at most `most` rows
    inside = edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return nodes, inside.select("src", "dst", "weight")


def typed_edges(references: DataFrame, citing: DataFrame) -> DataFrame:
    """(src, dst, relation, weight): edges from reference lists and from lists of citing papers; where both have one, the former counts, with all its weight."""
    both = references.select("src", "dst", F.lit(True).alias("listed"), "weight").unionAll(citing.select("src", "dst", F.lit(False).alias("listed"), "weight"))
    # Rows are dealt out by their number; numbers and flags fit a hash table, where structs would be sorted.
    sums = {r: F.sum(F.when(F.col("listed") == (r == "reference"), F.col("weight"))).alias(r) for r in ("reference", "citing")}
    met = spread(both, "src", "dst").groupBy("src", "dst").agg(F.max("listed").alias("listed"), *sums.values())
    return met.select("src", "dst", F.when(F.col("listed"), "reference").otherwise("citing").alias("relation"), F.when(F.col("listed"), F.col("reference")).otherwise(F.col("citing")).alias("weight"))


def missing_key(doi: Column, arxiv: Column, title: Column) -> Column:
    """What a missing paper is known by: DOI, else arXiv identifier, else title."""
    named = F.nullif(normalize_title(title), F.lit(""))
    return F.coalesce(F.concat(F.lit("doi:"), F.nullif(normalize_doi(doi), F.lit(""))), F.concat(F.lit("arxiv:"), F.nullif(F.lower(F.trim(arxiv)), F.lit(""))), F.concat(F.lit("title:"), named))


def missing(citations: DataFrame, references: DataFrame, works: DataFrame) -> DataFrame:
    """(key, title, doi, year, cited_by, mentions) of cited papers that the library lacks.

    External references are taken together by key, then by title; those whose
    DOI, arXiv identifier or title a paper of the library has are left out.
    """
    r = references.where("kind = 'external'").withColumn("key", missing_key(F.col("doi"), F.col("arxiv"), F.col("title"))).where("key is not null")
    r = r.withColumns({"t": F.nullif(normalize_title(F.col("title")), F.lit("")), "d": F.nullif(normalize_doi(F.col("doi")), F.lit("")), "a": F.nullif(arxiv_base(F.col("arxiv")), F.lit(""))})
    for mine, theirs in (("d", normalize_doi(F.col("doi"))), ("a", arxiv_base(F.col("arxiv"))), ("t", normalize_title(F.col("title")))):
        held = works.select(theirs.alias("_held")).where("_held <> ''").distinct()
        r = r.join(held, F.col(mine) == F.col("_held"), "left_anti")
    by_key = r.groupBy("key").agg(F.min_by("t", "id").alias("title_key"))
    first = by_key.where("title_key is not null").groupBy("title_key").agg(F.min("key").alias("group"))
    named = by_key.join(first, "title_key", "left").select("key", F.coalesce("group", "key").alias("group"))
    r = r.join(named, "key")
    cited = citations.select("citing_id", "cited_id").join(r.select(F.col("id").alias("cited_id"), "group"), "cited_id").groupBy("group").agg(F.countDistinct("citing_id").alias("cited_by"), F.count("*").alias("mentions"))
    about = r.groupBy("group").agg(F.min_by("title", F.when(F.col("title").isNotNull(), F.col("id"))).alias("title"), F.min("d").alias("doi"), F.min("year").alias("year"))
    return about.join(cited, "group").select(F.col("group").alias("key"), "title", "doi", "year", "cited_by", "mentions")


def decided(rows: DataFrame) -> DataFrame:
    """rows (status, via, score, suggested, candidate, named, auto, sure) with the state after matching.

    A confirmed match stays; identifiers link; a rejected suggestion that comes
    up again stays rejected; other titles link from `auto` per cent (null: not
    by itself) or `sure`, else are likely; without a candidate a rejection
    stays, what names itself is external, and the rest is unresolved.
    """
    accepts = (F.col("auto").isNotNull() & (F.col("score") >= F.col("auto"))) | (F.col("score") >= F.col("sure"))
    state = (
        F.when(F.col("status") == "confirmed_match", "confirmed_match")
        .when(F.col("via") == "identifier", "local_match")
        .when(F.col("via").isNotNull() & (F.col("status") == "rejected_match") & (F.col("suggested") == F.col("candidate")), "rejected_match")
        .when(F.col("via").isNotNull() & accepts, "local_match")
        .when(F.col("via").isNotNull(), "likely_match")
        .when(F.col("status") == "rejected_match", "rejected_match")
        .when(F.col("named"), "external")
        .otherwise("unresolved")
    )
    return rows.withColumn("state", state)


def contradictions(references: DataFrame) -> DataFrame:
    """(key, members, states) of keys with confirmed and rejected references, members oldest first."""
    age = F.struct(F.col("created_at").isNull().alias("undated"), "created_at", "id", "state")
    groups = references.where("key is not null").groupBy("key").agg(F.array_sort(F.collect_list(age)).alias("m"), F.max(F.col("state") == "confirmed_match").alias("yes"), F.max(F.col("state") == "rejected_match").alias("no"))
    found = groups.where("yes and no")
    return found.select("key", F.array_join(F.transform("m", lambda x: x["id"].cast("string")), ",").alias("members"), F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda x: x["state"]))), ",").alias("states"))


def created(items: DataFrame, references: DataFrame) -> DataFrame:
    """(key, id, is_new): each key's reference, found or made; a new one takes the least item id."""
    known = references.groupBy("key").agg(F.min("id").alias("found"))
    mine = items.where("key is not null").groupBy("key").agg(F.min("item_id").alias("item_id"))
    return mine.join(known, "key", "left").select("key", F.coalesce("found", "item_id").alias("id"), F.col("found").isNull().alias("is_new"))
