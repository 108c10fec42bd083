"""Visibility, scopes, sorting and per-paper aggregates of a library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Sort keys whose nulls come last in either direction; for the others ascending has nulls last, descending first.
NULLS_LAST = frozenset({"year", "venue", "doi", "citation_count", "shelves", "racks", "rows"})


def visible(works: DataFrame, shelf_works: DataFrame, shelves: DataFrame, granted: list[int] | None, admin: bool = False) -> DataFrame:
    """Papers that a reader may see: on no shelf, on a public shelf, or on a granted one."""
    if admin:
        return works
    public = F.col("access_level").isin("open", "visible") | F.col("shelf_id").isin(granted or [])
    seen = shelf_works.join(shelves, "shelf_id").groupBy("work_id").agg(F.max(public).alias("_open"))
    return works.join(seen, works["id"] == seen["work_id"], "left").where(F.coalesce("_open", F.lit(True))).drop("work_id", "_open")


def in_scope(works: DataFrame, scope: str, scope_id: object, shelf_works: DataFrame, shelves: DataFrame) -> DataFrame:
    """Papers of a scope: library, shelf, rack, row (of racks), import_batch by id; search_result by ids, saved_filter by a table (work_id), selection (ids in the caller's order as `_pos`)."""
    if scope == "library":
        return works
    if scope == "selection":
        ids = works.sparkSession.createDataFrame([(i, k) for k, i in enumerate(dict.fromkeys(scope_id))], "work_id long, _pos int")
        return works.join(ids, works["id"] == ids["work_id"]).drop("work_id")
    if scope == "import_batch":
        return works.where(F.col("import_batch_id") == scope_id)
    if scope == "search_result":
        ids = works.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(scope_id)], "work_id long")
    elif scope == "saved_filter":
        ids = scope_id.select("work_id").distinct()
    else:
        links = shelf_works if scope == "shelf" else shelf_works.join(shelves, "shelf_id")
        ids = links.where(F.col(f"{scope}_id") == scope_id).select("work_id").distinct()
    return works.join(ids, works["id"] == ids["work_id"], "left_semi")


def order(spec: str, known: list[str], direction: str = "asc", default: str = "updated_at:desc") -> list[Column]:
    """Sort columns of `key[:dir],...`; unknown keys are skipped, and the id breaks ties."""
    out = []
    for part in (spec or default).split(","):
        key, _, way = part.strip().partition(":")
        if key not in known:
            continue
        c, down = F.col(key), (way or direction) == "desc"
        if key in NULLS_LAST:
            out.append(c.desc_nulls_last() if down else c.asc_nulls_last())
        else:
            out.append(c.desc_nulls_first() if down else c.asc_nulls_last())
    return [*out, F.col("id").asc()]


def page(rows: DataFrame, columns: list[Column], number: int, size: int) -> DataFrame:
    """One page; the number is brought into the pages that there are."""
    pages = max(1, -(-rows.count() // size))
    return rows.orderBy(*columns).offset((min(max(number, 1), pages) - 1) * size).limit(size)


def citation_counts(works: DataFrame, citations: DataFrame) -> DataFrame:
    """works with the number of references and of different cited papers."""
    counts = citations.groupBy("citing_id").agg(F.count("*").alias("mention_count"), F.countDistinct("cited_id").alias("reference_count"))
    out = works.join(counts, works["id"] == counts["citing_id"], "left").drop("citing_id")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("mention_count", "reference_count")})


def tagged(tags: DataFrame, every: list[str] = (), some: list[str] = (), none: list[str] = ()) -> DataFrame:
    """Ids with all of `every`, at least one of `some` (if any are given), and none of `none`; one pass over the links."""
    have = {t: F.max(F.col("tag") == t) for t in {*every, *some, *none}}
    named = {t: f"_t{i}" for i, t in enumerate(sorted(have))}
    out = tags.groupBy("work_id").agg(*[have[t].alias(n) for t, n in named.items()], F.count("tag").alias("n_tags"))
    for t in every:
        out = out.where(F.col(named[t]))
    if some:
        hit = F.lit(False)
        for t in some:
            hit = hit | F.col(named[t])
        out = out.where(hit)
    for t in none:
        out = out.where(~F.col(named[t]))
    return out.select("work_id", "n_tags")


def best_assertion(assertions: DataFrame) -> DataFrame:
    """One claim for each (entity, field): canonical first, then by confidence (null as 0), then the newest id."""
    rank = F.struct(F.col("canonical"), F.coalesce("confidence", F.lit(0.0)).alias("c"), F.col("assertion_id"))
    return assertions.groupBy("entity_id", "field_name").agg(F.max_by(F.struct("value", "source", "assertion_id"), rank).alias("best")).select("entity_id", "field_name", "best.*")


def conflicts(assertions: DataFrame) -> DataFrame:
    """(entity, field) pairs that have more than one value."""
    return assertions.groupBy("entity_id", "field_name").agg(F.countDistinct("value").alias("n_values"), F.count("*").alias("n_claims")).where("n_values > 1")


def usual_marker(citations: DataFrame) -> DataFrame:
    """The most frequent marker of each cited paper, the least of equals."""
    counts = citations.groupBy("cited_id", "marker").count()
    return counts.groupBy("cited_id").agg(F.max("count").alias("n"), F.min_by("marker", F.struct((-F.col("count")).alias("n"), "marker")).alias("marker"))


def field_reviews(assertions: DataFrame) -> DataFrame:
    """For each field of an entity: how many claims and values, the canonical value (least of equals), whether they conflict."""
    return assertions.groupBy("entity_id", "field_name").agg(
        F.count("*").alias("n_claims"),
        F.countDistinct("value").alias("n_values"),
        F.min(F.when(F.col("canonical"), F.col("value"))).alias("canonical_value"),
        (F.countDistinct("value") > 1).alias("has_conflict"),
    )


def membership(works: DataFrame, shelf_works: DataFrame, shelves: DataFrame, placeholder: str = "(none)") -> DataFrame:
    """Papers with the sorted names of their shelves, or a placeholder."""
    names = shelf_works.join(shelves, "shelf_id").groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("group"))
    return works.select("id").join(names, works["id"] == names["work_id"], "left").select("id", F.coalesce("group", F.lit(placeholder)).alias("group"))


def badges(flags: DataFrame, names: list[str]) -> DataFrame:
    """Names of the flags that are set, in the given order, as one string."""
    return flags.select("id", F.array_join(F.filter(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]), lambda b: b.isNotNull()), ",").alias("badges"))


def imported(records: DataFrame, works: DataFrame) -> DataFrame:
    """Records (rec_id, doi, title) with the paper they are: by DOI, else by normalised title; status matched or new."""
    by_doi = works.where("doi is not null").groupBy(F.col("doi").alias("_doi")).agg(F.min("id").alias("_by_doi"))
    by_title = works.where("norm is not null").groupBy(F.col("norm").alias("_norm")).agg(F.min("id").alias("_by_title"))
    met = records.join(by_doi, records["doi"] == F.col("_doi"), "left").join(by_title, records["norm"] == F.col("_norm"), "left")
    work = F.coalesce("_by_doi", "_by_title")
    return met.select("rec_id", work.alias("work_id"), F.when(work.isNotNull(), "matched").otherwise("new").alias("status"))


def survivor(pairs: DataFrame) -> DataFrame:
    """Which of (a, b) lives on: confirmed first, then the higher version, then the more complete; a on a tie."""

    def rank(side: str) -> Column:
        return F.struct(F.col(f"confirmed_{side}"), F.col(f"version_{side}"), F.col(f"complete_{side}"))

    return pairs.select("a", "b", F.when(rank("b") > rank("a"), F.col("b")).otherwise(F.col("a")).alias("survivor"))


def offered(tags: DataFrame, scopes: DataFrame, container: int) -> DataFrame:
    """Tags that a container may use: those without a scope, and those scoped to it."""
    scoped = scopes.groupBy("tag").agg(F.max(F.col("shelf_id") == container).alias("_here"))
    return tags.join(scoped, "tag", "left").where("_here is null or _here").select("tag")


def files_of(links: DataFrame, files: DataFrame) -> DataFrame:
    """(work_id, n_files, statuses, qualities): how many files a paper has, and what they are like."""
    names = [F.array_join(F.array_sort(F.collect_set(n)), ",").alias(to) for n, to in (("status", "statuses"), ("quality", "qualities"))]
    return links.join(files, "file_id").groupBy("work_id").agg(F.count("*").alias("n_files"), *names)


def flagged(works: DataFrame, marks: dict[str, DataFrame]) -> DataFrame:
    """works with a flag for each table of ids."""
    for name, ids in marks.items():
        works = works.join(ids.select("id").distinct().withColumn(name, F.lit(True)), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return works


def other_works(citations: DataFrame, works: DataFrame, mine: str, other: str) -> DataFrame:
    """(id, other_works): how many different other papers of the library are on the other side of a paper's links."""
    rows = citations.where(F.col(mine) != F.col(other)).join(works.select(F.col("id").alias(other)), other, "left_semi")
    return rows.groupBy(F.col(mine).alias("id")).agg(F.countDistinct(other).alias("other_works"))


def best_fields(assertions: DataFrame, names: dict[str, str], fields: list[str]) -> DataFrame:
    """A column for each field with the best claim, after fields of other names have been folded in."""
    alias = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("field_name")]
    best = best_assertion(assertions.withColumn("field_name", alias).where("field_name is not null"))
    return best.groupBy("entity_id").pivot("field_name", fields).agg(F.first("value"))


def chosen(assertions: DataFrame, trusted: str) -> DataFrame:
    """One claim for each field: the latest of the trusted source, else the canonical one, else the latest."""
    rank = F.struct(F.when(F.col("source") == trusted, 2).when(F.col("canonical"), 1).otherwise(0).alias("r"), "retrieved_at", "assertion_id")
    return assertions.groupBy("entity_id", "field_name").agg(F.max_by(F.struct("value", "source"), rank).alias("best")).select("entity_id", "field_name", "best.*")


def history(rows: DataFrame, by: str, key: str, keep: int) -> DataFrame:
    """The newest rows of each group, by when they were promoted or else made."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.coalesce("promoted_at", "created_at").desc(), F.desc(key)))
    return rows.withColumn("place", place).where(F.col("place") <= keep).select(key, by, "place")


def polymorphic(links: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(id, name, entity) of links (entity, entity_id), each in the table of its kind."""
    out = None
    for kind, rows in tables.items():
        ids = links.where(F.col("entity") == kind).select(F.col("entity_id").alias("id")).distinct()
        part = rows.join(ids, "id", "left_semi").select("id", "name", F.lit(kind).alias("entity"))
        out = part if out is None else out.unionAll(part)
    return out


def counted(works: DataFrame, counts: dict[str, tuple[DataFrame, str, Column]]) -> DataFrame:
    """works with a count for each (rows, their column of paper ids, aggregate); papers without rows have 0."""
    for name, (rows, key, value) in counts.items():
        works = works.join(rows.groupBy(F.col(key).alias("id")).agg(value.alias(name)), "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return works


def containers(shelf_works: DataFrame, shelves: DataFrame, racks: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, kind, key, name): the shelves, racks and rows that papers (work_id) are in.

    shelves (shelf_id, rack_id, name), racks (rack_id, row_id, name) and rows
    (row_id, name) are those that the reader may see: a rack counts only by
    way of a shelf that is seen, a row by way of both.
    """
    s = shelves.select("shelf_id", "rack_id", F.col("name").alias("_shelf"))
    r = racks.select("rack_id", "row_id", F.col("name").alias("_rack"), F.lit(True).alias("_known"))
    w = rows.select("row_id", F.col("name").alias("_row"))
    places = s.join(r, "rack_id", "left").join(w.withColumn("_seen", F.lit(True)), "row_id", "left")
    levels = F.array(*[F.struct(F.lit(kind).alias("kind"), key.cast("long").alias("key"), name.alias("name")) for kind, key, name in (("shelf", F.col("shelf_id"), F.col("_shelf")), ("rack", F.when(F.col("_known"), F.col("rack_id")), F.col("_rack")), ("row", F.when(F.col("_seen"), F.col("row_id")), F.col("_row")))])
    each = places.select("shelf_id", F.explode(levels).alias("_c")).select("shelf_id", "_c.*").where("key is not null")
    return shelf_works.join(each, "shelf_id").select(F.col("work_id").alias("id"), "kind", "key", "name").distinct()


#: Keys that papers may be sorted by.
SORT_KEYS = ("title", "year", "venue", "added_at", "updated_at", "reading_status", "doi", "file_count", "reference_count", "citation_count", "local_reference_count", "local_citation_count", "shelves", "racks", "rows")


def sortable(works: DataFrame, citations: DataFrame, file_links: DataFrame, places: DataFrame) -> DataFrame:
    """works with the sort keys that other tables give: counts, and the first names of the `containers` that each is in.

    References count by mention, local references by different papers that are in works.
    """
    ids = works.select("id")
    inside = citations.join(ids.withColumnRenamed("id", "cited_id"), "cited_id", "left_semi")
    citing = citations.join(ids.withColumnRenamed("id", "citing_id"), "citing_id", "left_semi")
    out = counted(works, {
        "file_count": (file_links, "work_id", F.count("*")),
        "reference_count": (citations, "citing_id", F.count("*")),
        "local_reference_count": (inside, "citing_id", F.countDistinct("cited_id")),
        "local_citation_count": (citing, "cited_id", F.countDistinct("citing_id")),
    })
    names = places.groupBy("id").agg(*[F.min(F.when(F.col("kind") == kind, F.col("name"))).alias(f"{kind}s") for kind in ("shelf", "rack", "row")])
    return out.join(names.withColumnRenamed("shelfs", "shelves"), "id", "left")


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place in an order, from 0.  The order must tell all rows apart.

    The rows are sorted in ranges and numbered within each; only the sizes of the ranges come to the driver.
    """
    spread = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    start, starts = 0, []
    for at, size in sorted(spread.groupBy("_range").count().collect()):
        starts.append((at, start - 1))
        start += size
    if not starts:
        return spread.drop("_range").withColumn(name, F.lit(None).cast("long"))
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "_range int, _start long"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return spread.withColumn(name, within).join(offsets, "_range").withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_start")
