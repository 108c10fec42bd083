"""More queries over the library's operators: resolution, access, listings, merging, records and texts by section."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import access, library, linkage, resolution, sections
from .plans import dsl
from .queries import _VISIBLE, _visible, query
from .sources import export, page_links, records, tei

# -- references resolved, and graphs of what they resolve to

_KEYS = r"""ndoi AS (SELECT *, nullif(regexp_replace(lower(doi), '^https?://doi.org/', ''), '') AS d, nullif(regexp_replace(regexp_replace(lower(arxiv), '^arxiv:', ''), 'v[0-9]+$', ''), '') AS x FROM idrefs),
nref AS (SELECT *, coalesce(x, nullif(regexp_extract(d, '^10\.48550/arxiv\.(.+)$', 1), '')) AS base FROM ndoi),
wkey AS (SELECT key, min(id) AS work_id FROM (SELECT id, 'doi:' || lower(doi) AS key FROM idworks WHERE doi IS NOT NULL UNION ALL SELECT id, 'arxiv:' || regexp_replace(lower(arxiv), 'v[0-9]+$', '') FROM idworks WHERE arxiv IS NOT NULL) GROUP BY 1),
res AS (SELECT n.*, coalesce(stored_id, a.work_id, b.work_id) AS work_id,
    CASE WHEN stored_id IS NOT NULL THEN 'stored' WHEN coalesce(a.work_id, b.work_id) IS NOT NULL THEN 'identifier' WHEN coalesce(n.title, n.doi, n.arxiv) IS NOT NULL THEN 'external' ELSE 'unresolved' END AS kind
  FROM nref n LEFT JOIN wkey a ON a.key = 'doi:' || n.d LEFT JOIN wkey b ON b.key = 'arxiv:' || n.base),
resolved AS (SELECT *, CASE WHEN work_id IS NOT NULL THEN CAST(work_id AS VARCHAR) WHEN kind = 'external' THEN 'ext:' || coalesce('doi:' || d, 'arxiv:' || base, 'ref:' || id) END AS node FROM res),
redges AS (SELECT CAST(citing_id AS VARCHAR) AS src, node AS dst, count(DISTINCT cited_id) AS weight FROM citations JOIN resolved ON cited_id = id WHERE node IS NOT NULL AND node <> CAST(citing_id AS VARCHAR) GROUP BY 1, 2)"""


def _resolved(c):
    return resolution.resolved(c.identified_references(), c.identified_works())


@query(f"{_KEYS} SELECT id, work_id, kind, node FROM resolved")
def resolved_references(c):
    return _resolved(c).select("id", "work_id", "kind", "node")


@query(f"{_KEYS} SELECT * FROM redges")
def resolved_graph(c):
    """Papers to what their references resolve to."""
    return resolution.graph_edges(c.citations(), _resolved(c))


_EXTERNAL = f"""{_KEYS}, xn AS (SELECT node, arg_min(coalesce(title, doi, arxiv), id) AS label, count(*) AS n_references FROM resolved WHERE kind = 'external' GROUP BY 1),
xc AS (SELECT node, count(DISTINCT citing_id) AS citers, count(*) AS mentions FROM citations JOIN resolved ON cited_id = id WHERE kind = 'external' GROUP BY 1)"""


@query(f"{_EXTERNAL} SELECT node, label, n_references, coalesce(citers, 0) AS citers, coalesce(mentions, 0) AS mentions FROM xn LEFT JOIN xc USING (node)")
def external_nodes(c):
    return resolution.external_nodes(c.citations(), _resolved(c))


@query(f"{_EXTERNAL} SELECT node, label, citers FROM xn JOIN xc USING (node) ORDER BY citers DESC, node LIMIT 20")
def most_cited_external(c):
    return resolution.external_nodes(c.citations(), _resolved(c)).select("node", "label", "citers").where("citers > 0").orderBy(F.desc("citers"), "node").limit(20)


_CAP = f"""{_KEYS}, ends AS (SELECT src AS node, weight FROM redges UNION ALL SELECT dst, weight FROM redges),
kept AS (SELECT node, CAST(sum(weight) AS BIGINT) AS weight FROM ends GROUP BY 1 ORDER BY weight DESC, starts_with(node, 'ext:'), node LIMIT 300)"""


@query(f"{_CAP} SELECT src, dst, weight FROM redges WHERE src IN (SELECT node FROM kept) AND dst IN (SELECT node FROM kept)")
def capped_graph(c):
    """Edges between the 300 best connected nodes."""
    return resolution.capped(resolution.graph_edges(c.citations(), _resolved(c)), 300)[1]


@query(f"{_CAP} SELECT node, weight FROM kept")
def capped_nodes(c):
    return resolution.capped(resolution.graph_edges(c.citations(), _resolved(c)), 300)[0]


@query("""r AS (SELECT citing_id AS src, cited_id AS dst, count(*) AS weight FROM citations WHERE section <> 'R' GROUP BY 1, 2), f AS (SELECT citing_id AS src, cited_id AS dst, count(*) AS weight FROM citations WHERE section <> 'N' GROUP BY 1, 2)
SELECT src, dst, CASE WHEN r.weight IS NOT NULL THEN 'reference' ELSE 'citing' END AS relation, coalesce(r.weight, f.weight) AS weight FROM r FULL JOIN f USING (src, dst)""")
def typed_edges(c):
    """Mentions outside section R as reference lists, those outside N as fetched lists of citing papers."""
    def mentions(rows):
        return rows.select(F.col("citing_id").alias("src"), F.col("cited_id").alias("dst"), F.lit(1).cast("long").alias("weight"))

    return resolution.typed_edges(mentions(c.citations().where("section <> 'R'")), mentions(c.citations().where("section <> 'N'")))


_MISSING = rf"""{_KEYS}, titled AS (SELECT *, nullif(regexp_replace(regexp_replace(trim(lower(title)), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'), '') AS t FROM resolved WHERE kind = 'external'),
mk AS (SELECT *, coalesce('doi:' || d, 'arxiv:' || lower(trim(arxiv)), 'title:' || t) AS mkey FROM titled),
lack AS (SELECT * FROM mk WHERE mkey IS NOT NULL AND (d IS NULL OR d NOT IN (SELECT lower(doi) FROM idworks WHERE doi IS NOT NULL))
  AND (x IS NULL OR x NOT IN (SELECT regexp_replace(lower(arxiv), 'v[0-9]+$', '') FROM idworks WHERE arxiv IS NOT NULL)) AND (t IS NULL OR t NOT IN (SELECT regexp_replace(regexp_replace(trim(lower(title)), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g') FROM idworks))),
kt AS (SELECT mkey, arg_min(t, id) AS tkey FROM lack GROUP BY 1), tg AS (SELECT tkey, min(mkey) AS grp FROM kt WHERE tkey IS NOT NULL GROUP BY 1),
kg AS (SELECT mkey, coalesce(grp, mkey) AS grp FROM kt LEFT JOIN tg USING (tkey)), lg AS (SELECT * FROM lack JOIN kg USING (mkey)),
ab AS (SELECT grp, arg_min(title, id) FILTER (title IS NOT NULL) AS title, min(d) AS doi, min(year) AS year FROM lg GROUP BY 1),
ct AS (SELECT grp, count(DISTINCT citing_id) AS cited_by, count(*) AS mentions FROM citations JOIN lg ON cited_id = id GROUP BY 1),
miss AS (SELECT grp AS key, title, doi, year, cited_by, mentions FROM ab JOIN ct USING (grp))"""


@query(f"{_MISSING} SELECT * FROM miss")
def missing_by_key(c):
    return resolution.missing(c.citations(), _resolved(c), c.identified_works())


@query(f"""{_MISSING}, n AS (SELECT *, lower(coalesce(nullif(regexp_extract(title, '[A-Za-z0-9]+', 0), ''), 'work')) || coalesce(CAST(year AS VARCHAR), 'nd') AS base FROM miss), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY cited_by DESC, key) AS k FROM n)
SELECT CASE WHEN k = 1 THEN base ELSE base || k END AS cite_key, '"' || coalesce(replace(title, '"', '""'), '') || '",,' || coalesce(CAST(year AS VARCHAR), '') || ',' || coalesce(doi, '') || ',' || cited_by || ',' || mentions AS line FROM r""")
def export_missing_csv(c):
    rows = export.missing_keys(resolution.missing(c.citations(), _resolved(c), c.identified_works()))
    return rows.select("cite_key", export.missing_csv().alias("line"))


@query(f"""{_MISSING}, n AS (SELECT *, lower(coalesce(nullif(regexp_extract(title, '[A-Za-z0-9]+', 0), ''), 'work')) || coalesce(CAST(year AS VARCHAR), 'nd') AS base FROM miss), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY cited_by DESC, key) AS k FROM n)
SELECT key, '@misc{{' || CASE WHEN k = 1 THEN base ELSE base || k END || ',' || chr(10) || '  title = {{' || coalesce(title, 'Untitled') || '}},' || chr(10) || '  year = {{' || year || '}},' || chr(10) || CASE WHEN doi IS NOT NULL THEN '  doi = {{' || doi || '}},' || chr(10) ELSE '' END || '  note = {{Cited by ' || cited_by || ' paper(s) in the scope}}' || chr(10) || '}}' AS entry FROM r""")
def export_missing_bibtex(c):
    rows = export.missing_keys(resolution.missing(c.citations(), _resolved(c), c.identified_works()))
    return rows.select("key", export.missing_bibtex().alias("entry"))


@query(f"""{_KEYS} SELECT id, coalesce(nullif(concat_ws(' ', trim(title), CASE WHEN year IS NOT NULL THEN '(' || year || ')' END, CASE WHEN doi IS NOT NULL THEN 'DOI: ' || doi END, CASE WHEN arxiv IS NOT NULL THEN 'arXiv:' || arxiv END), ''), 'Untitled reference') AS entry FROM resolved WHERE work_id IS NULL""")
def export_missing_references(c):
    return _resolved(c).where("work_id is null").select("id", export.reference_line().alias("entry"))


@query(f"""{_KEYS} SELECT count(DISTINCT work_id) AS held, count(DISTINCT CASE WHEN kind = 'external' THEN node END) AS external, round(100.0::DOUBLE * count(DISTINCT work_id) / (count(DISTINCT work_id) + count(DISTINCT CASE WHEN kind = 'external' THEN node END)), 1) AS pct FROM resolved""")
def reference_coverage(c):
    """How much of what is cited the library holds."""
    held, external = F.countDistinct("work_id"), F.countDistinct(F.when(F.col("kind") == "external", F.col("node")))
    return _resolved(c).agg(held.alias("held"), external.alias("external")).withColumn("pct", F.round(100.0 * F.col("held") / (F.col("held") + F.col("external")), 1))


_STATES = "['unresolved', 'external', 'likely_match', 'local_match', 'rejected_match', 'confirmed_match']"


@query(f"""l AS (SELECT l_orderkey, l_linenumber, {_STATES}[l_suppkey % 6 + 1] AS status, CASE l_returnflag WHEN 'A' THEN 'identifier' WHEN 'N' THEN 'title' END AS via, l_quantity * 2.0 AS score, l_partkey % 3 AS suggested, l_orderkey % 3 AS candidate, l_tax > 0.02 AS named FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN status = 'confirmed_match' THEN status WHEN via = 'identifier' THEN 'local_match' WHEN via IS NOT NULL AND status = 'rejected_match' AND suggested = candidate THEN status
  WHEN via IS NOT NULL AND (score >= 80 OR score >= 100) THEN 'local_match' WHEN via IS NOT NULL THEN 'likely_match' WHEN status = 'rejected_match' THEN status WHEN named THEN 'external' ELSE 'unresolved' END AS state FROM l""")
def matching_states(c):
    """What becomes of references after matching."""
    l = c.table("lineitem")
    state = F.array(*[F.lit(s) for s in linkage.STATES])[(F.col("l_suppkey") % 6).cast("int")]
    rows = l.select("l_orderkey", "l_linenumber", state.alias("status"), F.when(F.col("l_returnflag") == "A", "identifier").when(F.col("l_returnflag") == "N", "title").alias("via"), (F.col("l_quantity") * 2.0).alias("score"), (F.col("l_partkey") % 3).alias("suggested"), (F.col("l_orderkey") % 3).alias("candidate"), (F.col("l_tax") > 0.02).alias("named"), F.lit(80.0).alias("auto"), F.lit(100.0).alias("sure"))
    return resolution.decided(rows).select("l_orderkey", "l_linenumber", "state")


@query(f"""{_KEYS}, rk AS (SELECT n.id, coalesce(a.work_id, b.work_id) AS a_id, least(coalesce(a.work_id, b.work_id), coalesce(b.work_id, a.work_id)) AS work_id, {_STATES}[n.id % 6 + 1] AS status, n.title, n.doi, n.arxiv FROM nref n LEFT JOIN wkey a ON a.key = 'doi:' || n.d LEFT JOIN wkey b ON b.key = 'arxiv:' || n.base)
SELECT id, work_id, CASE WHEN status = 'confirmed_match' THEN status WHEN work_id IS NOT NULL THEN 'local_match' WHEN status = 'rejected_match' THEN status WHEN coalesce(title, doi, arxiv) IS NOT NULL THEN 'external' ELSE 'unresolved' END AS state FROM rk""")
def rescanned_references(c):
    """All references matched again by identifier, and their new states."""
    r = c.identified_references()
    found = linkage.matched(r.select("id", F.lit("").alias("title"), "year", "doi", "arxiv"), c.identified_works().select("id", "title", "year", "doi", "arxiv"))
    status = F.array(*[F.lit(s) for s in linkage.STATES])[(F.col("id") % 6).cast("int")]
    rows = r.join(found, r["id"] == found["ref_id"], "left").select("id", "work_id", "via", "score", status.alias("status"), F.lit(None).cast("long").alias("suggested"), F.col("work_id").alias("candidate"), F.coalesce("title", "doi", "arxiv").isNotNull().alias("named"), F.lit(None).cast("double").alias("auto"), F.lit(100.0).alias("sure"))
    return resolution.decided(rows).select("id", "work_id", "state")


@query(f"""{_KEYS} SELECT n.id FROM nref n WHERE n.base IN (SELECT regexp_replace(lower(arxiv), 'v[0-9]+$', '') FROM idworks WHERE id = 40) OR n.d IN (SELECT lower(doi) FROM idworks WHERE id = 40)""")
def references_of_new_work(c):
    """References that a newly added paper answers, by either identifier: a join for each, not one with `or`."""
    one = resolution.identifier_index(c.identified_works().where("id = 40")).select("key")
    r = c.identified_references()
    keyed = r.select("id", F.explode(resolution.identifier_keys(F.col("doi"), F.col("arxiv"))).alias("key"))
    return keyed.join(F.broadcast(one), "key", "left_semi").select("id").distinct()


_CONFLICT = f"r AS (SELECT p_name AS key, p_partkey AS id, {_STATES}[p_size % 6 + 1] AS state, p_size AS created_at FROM part)"


@query(f"""{_CONFLICT} SELECT key, string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at, id) AS members, string_agg(DISTINCT state, ',' ORDER BY state) AS states FROM r GROUP BY 1 HAVING bool_or(state = 'confirmed_match') AND bool_or(state = 'rejected_match')""")
def contradictions(c):
    p = c.table("part")
    state = F.array(*[F.lit(s) for s in linkage.STATES])[F.col("p_size") % 6]
    return resolution.contradictions(p.select(F.col("p_name").alias("key"), F.col("p_partkey").alias("id"), state.alias("state"), F.col("p_size").alias("created_at")))


@query("""i AS (SELECT p_name || p_size AS key, min(p_partkey) AS item_id FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), k AS (SELECT p_name || p_size AS key, min(p_partkey) AS id FROM part WHERE p_partkey % 3 = 0 GROUP BY 1)
SELECT key, coalesce(id, item_id) AS id, id IS NULL AS is_new FROM i LEFT JOIN k USING (key)""")
def created_references(c):
    p = c.table("part").select(F.concat("p_name", F.col("p_size").cast("string")).alias("key"), "p_partkey")
    return resolution.created(p.where("p_partkey % 2 = 0").select("key", F.col("p_partkey").alias("item_id")), p.where("p_partkey % 3 = 0").select("key", F.col("p_partkey").alias("id")))


# -- access

_GRANTS = """members AS (SELECT c_custkey AS user_id, c_nationkey AS group_id, ['reader', 'contributor', 'editor', 'librarian', 'owner'][c_custkey % 5 + 1] AS role FROM customer),
grants AS (SELECT DISTINCT s_nationkey AS group_id, s_suppkey % 25 AS target_id FROM supplier), mine AS (SELECT DISTINCT user_id, target_id FROM members JOIN grants USING (group_id))"""


def _members(c):
    role = F.array(*[F.lit(r) for r in access.ROLES])[(F.col("c_custkey") % 5).cast("int")]
    return c.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("group_id"), role.alias("role"))


def _granted(c):
    grants = c.table("supplier").select(F.col("s_nationkey").alias("group_id"), F.lit("shelf").alias("target_type"), (F.col("s_suppkey") % 25).alias("target_id"))
    return access.granted(_members(c), grants, "shelf")


@query(f"{_GRANTS} SELECT user_id, target_id FROM mine")
def granted_shelves(c):
    """Memberships of groups joined with what the groups have been granted."""
    return _granted(c)


@query(f"""{_GRANTS} SELECT m.user_id, s.shelf_id AS target_id, role = 'owner' OR access_level IN ('open', 'visible') OR g.user_id IS NOT NULL AS sees, role = 'owner' OR (role = 'librarian' AND (access_level = 'open' OR g.user_id IS NOT NULL)) AS changes
FROM members m CROSS JOIN shelves s LEFT JOIN mine g ON g.user_id = m.user_id AND g.target_id = s.shelf_id""")
def shelf_rights(c):
    return access.container_rights(_members(c).select("user_id", "role"), c.shelves().select(F.col("shelf_id").alias("id"), "access_level"), _granted(c))


@query("""o AS (SELECT work_id, bool_or(access_level = 'open' OR shelf_id IN (5, 8)) AS opens FROM shelf_works JOIN shelves USING (shelf_id) GROUP BY 1)
SELECT id, owner_id = 7 AND coalesce(opens, true) AS changes FROM live_works LEFT JOIN o ON work_id = id""")
def changeable_works(c):
    """What a contributor may change: own papers on open or granted shelves."""
    return access.paper_rights(c.live_works(), c.shelf_works(), c.shelves(), [5, 8], "contributor", 7)


@query(f"""{_VISIBLE} SELECT file_id, sha256 FROM files f WHERE NOT EXISTS (SELECT 1 FROM file_links l WHERE l.file_id = f.file_id) OR EXISTS (SELECT 1 FROM file_links l JOIN vis v ON v.id = l.work_id WHERE l.file_id = f.file_id)""")
def visible_files(c):
    return access.visible_files(c.files(), c.file_links(), _visible(c)).select("file_id", "sha256")


@query(f"""{_VISIBLE} SELECT DISTINCT l_orderkey AS a, l_orderkey + l_linenumber AS b FROM lineitem WHERE l_orderkey IN (SELECT id FROM vis) AND l_orderkey + l_linenumber IN (SELECT id FROM vis)""")
def visible_candidates(c):
    pairs = c.table("lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("b")).distinct()
    return access.visible_pairs(pairs, _visible(c))


# -- scopes and search keys

@query("""s AS (SELECT 'row' AS scope, count(*) AS n FROM live_works WHERE id IN (SELECT work_id FROM shelf_works JOIN shelves USING (shelf_id) WHERE rack_id % 2 = 1) UNION ALL
  SELECT 'search_result', count(*) FROM live_works WHERE id IN (1, 3, 7, 57, 99) UNION ALL SELECT 'import_batch', count(*) FROM live_works WHERE year = 1997 UNION ALL SELECT 'saved_filter', count(*) FROM live_works WHERE reading_status = 'O')
SELECT scope, n FROM s""")
def more_scope_counts(c):
    """A row of racks, a search result, an import batch, a saved filter."""
    works = c.live_works().withColumn("import_batch_id", F.col("year"))
    rows = c.shelves().withColumn("row_id", F.col("rack_id") % 2)
    saved = dsl.filtered(works, dsl.parse("status:O")).select(F.col("id").alias("work_id"))
    scopes = {"row": 1, "search_result": [1, 3, 7, 57, 99], "import_batch": 1997, "saved_filter": saved}
    out = None
    for scope, of in scopes.items():
        n = library.in_scope(works, scope, of, c.shelf_works(), rows).agg(F.count("*").alias("n")).select(F.lit(scope).alias("scope"), "n")
        out = n if out is None else out.unionAll(n)
    return out


@query("""SELECT id, venue FROM texts WHERE lower(CAST(to_json(list_slice(string_split(lower(title), ' '), 1, 5)) AS VARCHAR)) LIKE '%"en%'""")
def search_keywords(c):
    """`keyword:` looks into the list as it is written."""
    t = c.texts().withColumn("keywords", F.slice(F.split(F.lower("title"), " "), 1, 5))
    return dsl.filtered(t, dsl.parse("""keyword:'"en'""")).select("id", "venue")


@query("""SELECT id, year FROM live_works w WHERE title ILIKE '%' || (SELECT substr(sha256, 1, 10) FROM files WHERE file_id = (SELECT min(file_id) FROM file_links)) || '%' OR EXISTS (SELECT 1 FROM file_links l JOIN files f USING (file_id) WHERE l.work_id = w.id AND starts_with(f.sha256, (SELECT substr(sha256, 1, 10) FROM files WHERE file_id = (SELECT min(file_id) FROM file_links))))""")
def search_by_hash(c):
    """Free text of hexadecimal digits also finds papers by the hash of a file."""
    links = c.file_links().join(c.files(), "file_id")
    start = links.orderBy("file_id").select(F.substring("sha256", 1, 10)).first()
    sides = {"sha256": links.select(F.col("work_id").alias("id"), F.col("sha256").alias("name"))}
    return dsl.filtered(c.live_works(), dsl.parse(start[0] if start else ""), sides).select("id", "year")


@query("""SELECT id, year FROM live_works w WHERE NOT EXISTS (SELECT 1 FROM file_links l WHERE l.work_id = w.id) AND year >= 1998""")
def search_without_files(c):
    sides = {"has:pdf": c.file_links().select(F.col("work_id").alias("id"))}
    return dsl.filtered(c.live_works(), dsl.parse("has:no-pdf year:>=1998"), sides).select("id", "year")


@query("""SELECT id FROM live_works w WHERE (w.id % 30 = 1 OR EXISTS (SELECT 1 FROM works v WHERE v.merged_into_id = w.id)) AND EXISTS (SELECT 1 FROM file_links l JOIN files f USING (file_id) WHERE l.work_id = w.id AND f.status <> 'extracted')""")
def search_versions_and_warnings(c):
    """`version:yes warning:*`"""
    works = c.live_works().withColumn("version_group_id", F.when(F.col("id") % 30 == 1, F.col("id")))
    state = F.when(F.col("status") == "extracted", "none").otherwise(F.col("status"))
    sides = {"version": c.works().where("merged_into_id is not null").select(F.col("merged_into_id").alias("id")), "warning": c.file_links().join(c.files(), "file_id").select(F.col("work_id").alias("id"), state.alias("name"))}
    return dsl.filtered(works, dsl.parse("version:yes warning:*"), sides).select("id")


@query("""SELECT id, venue FROM texts t WHERE EXISTS (SELECT 1 FROM sections s WHERE s.id = t.id AND s.label = 'abstract' AND s.text ILIKE '%and%') AND EXISTS (SELECT 1 FROM sections s WHERE s.id = t.id AND s.text ILIKE '%ea%')""")
def search_texts(c):
    """`summary:` and `fulltext:` look into other tables."""
    s = c.sections()
    sides = {"summary": s.where("label = 'abstract'").select("id", F.col("text").alias("name")), "fulltext": s.select("id", F.col("text").alias("name"))}
    return dsl.filtered(c.texts(), dsl.parse("summary:and fulltext:ea"), sides).select("id", "venue")


@query("""t AS (SELECT DISTINCT tag FROM tags), s AS (SELECT 'click' AS tag, 3 AS shelf_id UNION ALL SELECT 'view', 4)
SELECT tag FROM t WHERE tag NOT IN (SELECT tag FROM s) OR tag IN (SELECT tag FROM s WHERE shelf_id = 3)""")
def offered_tags(c):
    """Tags without a scope and those scoped to shelf 3."""
    scopes = c.spark.createDataFrame([("click", 3), ("view", 4)], "tag string, shelf_id int")
    return library.offered(c.tags().select("tag").distinct(), scopes, 3)


@query("""SELECT r.id, coalesce(w.title, r.title) AS title, coalesce(w.year, r.year) AS year, w.id IS NOT NULL AS held FROM idrefs r LEFT JOIN live_works w ON w.id = r.stored_id""")
def reference_rows(c):
    """References as they are shown: what the paper says goes before what the reference says."""
    w = c.live_works().select(F.col("id").alias("stored_id"), F.col("title").alias("_t"), F.col("year").alias("_y"))
    r = c.identified_references().join(w, "stored_id", "left")
    return r.select("id", F.coalesce("_t", "title").alias("title"), F.coalesce("_y", "year").alias("year"), F.col("_t").isNotNull().alias("held"))


# -- listings and aggregates

@query("""SELECT work_id, count(*) AS n_files, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses, string_agg(DISTINCT quality, ',' ORDER BY quality) AS qualities FROM file_links JOIN files USING (file_id) GROUP BY 1""")
def files_of_works(c):
    return library.files_of(c.file_links(), c.files())


@query("""SELECT file_id, count(*) AS n_works, count(*) - 1 AS others FROM file_links GROUP BY 1""")
def works_of_files(c):
    return c.file_links().groupBy("file_id").agg(F.count("*").alias("n_works")).withColumn("others", F.col("n_works") - 1)


@query(f"""SELECT w.id, EXISTS (SELECT 1 FROM citations WHERE citing_id = w.id AND {_STATES}[cited_id % 6 + 1] = 'likely_match') AS likely, EXISTS (SELECT 1 FROM citations c JOIN live_works x ON x.id = c.citing_id WHERE c.cited_id = w.id AND x.id <> w.id) AS cited_here FROM live_works w""")
def work_flags(c):
    """Whether references wait for a decision, and whether papers of the library cite it."""
    likely = c.citations().where("cited_id % 6 = 2").select(F.col("citing_id").alias("id"))
    citers = c.citations().where("citing_id <> cited_id").join(c.live_works().select(F.col("id").alias("citing_id")), "citing_id", "left_semi").select(F.col("cited_id").alias("id"))
    return library.flagged(c.live_works().select("id"), {"likely": likely, "cited_here": citers})


@query("""SELECT citing_id AS id, count(DISTINCT cited_id) AS other_works FROM citations JOIN live_works w ON w.id = cited_id WHERE citing_id <> cited_id GROUP BY 1""")
def local_references(c):
    """Different other papers of the library that a paper refers to; shadows are no papers."""
    return library.other_works(c.citations(), c.live_works(), "citing_id", "cited_id")


@query("""SELECT cited_id AS id, count(DISTINCT citing_id) AS other_works FROM citations JOIN live_works w ON w.id = citing_id WHERE citing_id <> cited_id GROUP BY 1""")
def local_citers(c):
    return library.other_works(c.citations(), c.live_works(), "cited_id", "citing_id")


@query("""a AS (SELECT *, CASE field_name WHEN 'signup' THEN 'volume' WHEN 'click' THEN 'volume' WHEN 'view' THEN 'issue' WHEN 'purchase' THEN 'pages' END AS field FROM assertions), r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, field ORDER BY canonical DESC, coalesce(confidence, 0.0) DESC, assertion_id DESC) AS k FROM a WHERE field IS NOT NULL)
SELECT entity_id, max(value) FILTER (field = 'volume') AS volume, max(value) FILTER (field = 'issue') AS issue, max(value) FILTER (field = 'pages') AS pages FROM r WHERE k = 1 GROUP BY 1""")
def publication_fields(c):
    """The best claim of each field, other names of a field folded in, as columns."""
    return library.best_fields(c.assertions(), {"signup": "volume", "click": "volume", "view": "issue", "purchase": "pages"}, ["volume", "issue", "pages"])


@query("""r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, field_name ORDER BY CASE WHEN source = 'source0' THEN 0 WHEN canonical THEN 1 ELSE 2 END, retrieved_at DESC, assertion_id DESC) AS k FROM assertions) SELECT entity_id, field_name, value, source FROM r WHERE k = 1""")
def chosen_assertions(c):
    """The latest of the trusted source, else the canonical, else the latest."""
    return library.chosen(c.assertions(), "source0")


@query("""r AS (SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN ts END AS promoted, ts FROM events), n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(promoted, ts - INTERVAL 1 DAY) DESC, event_id DESC) AS place FROM r) SELECT event_id, user_id, place FROM n WHERE place <= 5""", True)
def summary_history(c):
    """The five newest of each user; what has been promoted counts from then."""
    e = c.table("events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", F.col("ts")).alias("promoted_at"), (F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("created_at"))
    return library.history(e, "user_id", "event_id", 5)


@query("""SELECT event_id, event_type, ts FROM events ORDER BY CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END, ts DESC, event_id LIMIT 40""")
def job_listing(c):
    """Active ones first, then newest first."""
    return c.table("events").select("event_id", "event_type", "ts").orderBy(F.when(F.col("event_type").isin("click", "view"), 0).otherwise(1), F.desc("ts"), "event_id").limit(40)


@query("""SELECT id, title, updated_at FROM live_works WHERE reading_status = 'O' ORDER BY CASE WHEN id % 3 = 0 THEN id END ASC NULLS LAST, updated_at DESC, id LIMIT 60""")
def reading_queue(c):
    position = F.when(F.col("id") % 3 == 0, F.col("id"))
    return c.live_works().where("reading_status = 'O'").orderBy(position.asc_nulls_last(), F.desc("updated_at"), "id").select("id", "title", "updated_at").limit(60)


@query("""SELECT l_orderkey AS a, l_partkey AS b, l_shipdate FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N' ORDER BY l_shipdate DESC, a, b, l_linenumber LIMIT 50""")
def duplicates_listing(c):
    """Open candidates of one kind, newest first."""
    l = c.table("lineitem").where("l_linestatus = 'O' and l_returnflag = 'N'").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_partkey", "l_linenumber").limit(50)
    return l.select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), "l_shipdate")


@query("""SELECT id, row_number() OVER (ORDER BY lower(coalesce(nullif(title, ''), venue)), title, id) AS place FROM refs""")
def title_order(c):
    """Stable order by title; numbers come from ranges of titles, not from one sorted task."""
    order = [F.lower(F.coalesce(F.nullif("title", F.lit("")), "venue")).asc_nulls_last(), F.col("title").asc_nulls_last(), F.col("id").asc_nulls_last()]
    return library.numbered(c.references(), order).select("id", (F.col("place") + 1).alias("place"))


@query("""SELECT id, CASE WHEN id % 2 = 0 THEN venue ELSE title END AS name, 'work' AS entity FROM live_works WHERE id IN (SELECT work_id FROM tags) UNION ALL SELECT shelf_id, name, 'shelf' FROM shelves WHERE shelf_id IN (SELECT user_id FROM events WHERE event_type = 'view')""")
def tagged_entities(c):
    """Links that name a kind and an id, each joined with the table of its kind."""
    links = c.tags().select(F.lit("work").alias("entity"), F.col("work_id").alias("entity_id")).unionAll(c.table("events").where("event_type = 'view'").select(F.lit("shelf"), "user_id"))
    works = c.live_works().select("id", F.when(F.col("id") % 2 == 0, F.col("venue")).otherwise(F.col("title")).alias("name"))
    return library.polymorphic(links, {"work": works, "shelf": c.shelves().select(F.col("shelf_id").alias("id"), "name")})


@query("""e AS (SELECT user_id AS id, event_id % 4 AS source, event_type, value, ts FROM events WHERE event_type IN ('click', 'view')), l AS (SELECT id, event_type, source, arg_max(value, epoch_us(ts) * 1000 + 0) AS value FROM e GROUP BY 1, 2, 3),
p AS (SELECT id, arg_min(value, source) FILTER (event_type = 'click') AS title, arg_min(value, source) FILTER (event_type = 'view') AS venue FROM l GROUP BY 1)
SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE title END AS title, venue FROM p""")
def enriched_works(c):
    """The latest value of each field and source, promoted by the order of sources unless the field is locked."""
    e = c.table("events").where("event_type in ('click', 'view')").select(F.col("user_id").alias("id"), F.when(F.col("event_type") == "click", "title").otherwise("venue").alias("field"), (F.col("event_id") % 4).alias("rank"), "value", F.col("ts").alias("at"))
    locks = e.where("id % 5 = 0").select("id", F.lit("title").alias("field")).distinct()
    return linkage.enriched(e, locks, ["title", "venue"])


# -- duplicates and merging

@query("""x AS (SELECT id, regexp_replace('2101.' || lpad(CAST(id // 3 * 3 AS VARCHAR), 5, '0'), 'v[0-9]+$', '') AS base, id % 3 + 1 AS version FROM live_works), f AS (SELECT base, arg_min(version, id) AS v, min(id) AS a FROM x GROUP BY 1)
SELECT 'same_arxiv' AS kind, a, id AS b, CASE WHEN version = v THEN 1.0::DOUBLE ELSE 0.99::DOUBLE END AS score FROM x JOIN f USING (base) WHERE id <> a""")
def same_arxiv(c):
    """Versions of one preprint."""
    number = F.lpad((F.col("id") - F.col("id") % 3).cast("string"), 5, "0")
    return linkage.same_arxiv(c.live_works().select("id", F.concat(F.lit("arXiv:2101."), number, F.lit("v"), (F.col("id") % 3 + 1).cast("string")).alias("arxiv")))


@query("""l AS (SELECT sha256, work_id FROM file_links JOIN files USING (file_id)), f AS (SELECT sha256, min(work_id) AS a FROM l GROUP BY 1)
SELECT DISTINCT 'shared_file' AS kind, a, work_id AS b, 1.0::DOUBLE AS score FROM l JOIN f USING (sha256) WHERE work_id <> a""")
def shared_files(c):
    rows = c.file_links().join(c.files(), "file_id").select(F.col("work_id").alias("id"), "sha256")
    return linkage.same_key(rows, "sha256", "shared_file").distinct()


@query("""n AS (SELECT doc_id, text, regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') AS fp FROM documents WHERE text IS NOT NULL), s AS (SELECT text, min(doc_id) AS a FROM n GROUP BY 1), f AS (SELECT fp, min(doc_id) AS a FROM n GROUP BY 1)
SELECT 'exact_file' AS kind, a, doc_id AS b, 1.0::DOUBLE AS score FROM n JOIN s USING (text) WHERE doc_id <> a UNION ALL SELECT 'text_fingerprint', a, doc_id, 0.98::DOUBLE FROM n JOIN f USING (fp) WHERE doc_id <> a""")
def file_candidates(c):
    """Files of equal bytes, and of equal words."""
    rows = c.table("documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"), F.sha2(F.regexp_replace(F.lower(F.trim("text")), r"\s+", " "), 256).alias("fingerprint"))
    return linkage.same_key(rows, "sha256", "exact_file").unionAll(linkage.same_key(rows, "fingerprint", "text_fingerprint", 0.98))


_COUNT = "(length(h) - length(replace(h, '{0}', ''))) // {1}"


@query(f"""p AS (SELECT page_id AS id, lower(html) AS h, length(html) // 40 AS pages FROM pages), n AS (SELECT id, pages, {_COUNT.format("href", 4)} AS abstracts, {_COUNT.format("copyright", 9)} AS refs, contains(h, 'nav')::INT + contains(h, 'div')::INT + contains(h, 'login')::INT AS marks FROM p)
SELECT id, CASE WHEN abstracts >= 2 OR refs >= 2 THEN 0.78::DOUBLE ELSE 0.68::DOUBLE END AS score, CASE WHEN abstracts >= 2 OR refs >= 2 THEN 'multiple_section_markers' ELSE 'proceedings_like_preview' END AS reason FROM n WHERE abstracts >= 2 OR refs >= 2 OR (pages >= 40 AND marks >= 2)""")
def bundled_files(c):
    """Files that look like several papers; the words of web pages stand in for those of proceedings."""
    p = c.table("pages").select(F.col("page_id").alias("id"), F.col("html").alias("preview"), F.floor(F.length("html") / 40).alias("pages"))
    return linkage.bundles(p, "href", "copyright", ("nav", "div", "login"))


@query("""SELECT w.id, w.title, w.year, coalesce(w.doi, s.doi) AS doi, coalesce(w.citation_count, s.citation_count) AS citation_count, s.title <> w.title AS title_differs FROM live_works w JOIN works s ON s.merged_into_id = w.id""")
def merge_previews(c):
    """What a paper would be after its shadow has been merged into it."""
    return linkage.previewed(c.live_works(), c.works().where("merged_into_id is not null"), "merged_into_id", ["title", "year", "doi", "citation_count"]).select("id", "title", "year", "doi", "citation_count", "title_differs")


@query("""SELECT id, coalesce(nullif(trim(w.doi), ''), CASE WHEN NOT id % 6 = 0 THEN '10.1000/w' || (id + 1) END) AS doi, w.doi IS NULL AND id % 6 <> 0 AS filled FROM live_works w""")
def backfilled_identifiers(c):
    """Empty, unlocked identifiers are filled."""
    w = c.live_works().select("id", "doi", F.concat(F.lit("https://doi.org/10.1000/W"), (F.col("id") + 1).cast("string")).alias("known"), (F.col("id") % 6 == 0).alias("locked"))
    return linkage.backfilled(w)


@query("""s AS (SELECT work_id, shelf_id FROM shelf_works WHERE work_id % 7 <> 0) SELECT work_id, shelf_id FROM s UNION ALL SELECT id, 1 FROM live_works WHERE id NOT IN (SELECT work_id FROM s)""")
def shelved_works(c):
    """Papers on no shelf are put on the default one."""
    return linkage.shelved(c.live_works(), c.shelf_works().where("work_id % 7 <> 0"), 1)


@query("""c AS (SELECT DISTINCT l_orderkey AS a, l_orderkey + l_linenumber AS b FROM lineitem) SELECT a, b, 'Study ' || a || ' on ' || lower(x.venue) || ' | ' || coalesce(y.title, '(gone)') AS label, CASE WHEN y.year > x.year THEN b ELSE a END AS suggested FROM c JOIN works x ON x.id = a LEFT JOIN works y ON y.id = b""")
def described_candidates(c):
    """Candidates with the titles of both sides and the side that would live on."""
    pairs = c.table("lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("b")).distinct()
    return linkage.described(pairs, c.works())


@query("""o AS (SELECT p_partkey AS id, p_partkey % 200 AS work_id, p_name AS title FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey AS id, p_partkey % 200 AS work_id, p_name || ' ' || p_size AS title FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 200 < 100)
SELECT coalesce(n.id, o.id) AS id, coalesce(n.work_id, o.work_id) AS work_id, coalesce(n.title, o.title) AS title, w.id IS NOT NULL AS held FROM (SELECT * FROM o WHERE work_id NOT IN (SELECT work_id FROM n) OR id IN (SELECT id FROM n)) o FULL JOIN n USING (id) LEFT JOIN live_works w ON w.id = coalesce(n.id, o.id)""")
def stored_citers(c):
    """Citing papers of some works fetched again: those works' lists are replaced, others stay, and what nothing links to goes."""
    p = c.table("part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 200).alias("work_id"), F.col("p_name").alias("title"), "p_size")
    new = p.where("id % 5 <> 0 and work_id < 100").select("id", "work_id", F.concat_ws(" ", "title", "p_size").alias("title"))
    return linkage.replaced(p.where("id % 3 <> 0").drop("p_size"), new, c.live_works())


# -- sections

@query("""SELECT id, pos, label, CASE WHEN label = 'title' THEN 'title' WHEN label = 'abstract' THEN 'abstract' WHEN regexp_matches(lower(label), 'introduc|related|background|prior work|motivation|acknowledg') THEN 'body_low' ELSE 'body_high' END AS field,
CASE WHEN regexp_matches(lower(label), 'title|abstract|intro|related|background') THEN 'Background' WHEN regexp_matches(lower(label), 'method|data') THEN 'Methods' WHEN regexp_matches(lower(label), 'result') THEN 'Results' ELSE 'Other' END AS bucket, regexp_matches(lower(label), 'acknowledg') AS skipped FROM sections""")
def section_kinds(c):
    """Index field, bucket, and whether a section is left out of chunks."""
    label = F.col("label")
    return c.sections().select("id", "pos", "label", sections.index_field(label).alias("field"), sections.bucket(label).alias("bucket"), sections.skipped(label).alias("skipped"))


@query("""s AS (SELECT *, regexp_extract(label, '^([0-9]+) ', 1) AS m FROM sections), t AS (SELECT *, max(CASE WHEN m <> '' THEN CAST(m AS INT) END) OVER (PARTITION BY id ORDER BY pos) AS run FROM s),
u AS (SELECT *, CASE WHEN m <> '' AND CAST(m AS INT) > coalesce(lag(run) OVER (PARTITION BY id ORDER BY pos), 0) THEN 1 ELSE 0 END AS main FROM t), v AS (SELECT *, sum(main) OVER (PARTITION BY id ORDER BY pos) AS g FROM u),
n AS (SELECT id, greatest(g, 1) AS g, count(*) AS parts, sum(length(text)) AS letters, bool_or(m <> '') AS any_main FROM v GROUP BY 1, 2), k AS (SELECT id, max(g) AS top FROM v GROUP BY 1)
SELECT v.id, greatest(v.g, 1) AS main, arg_min(v.label, CASE WHEN v.main = 1 THEN v.pos END) AS label, count(*) AS parts, CAST(sum(length(v.text)) AS BIGINT) AS letters FROM v JOIN k USING (id) WHERE top > 0 GROUP BY 1, 2""")
def main_sections(c):
    """Subsections folded into the section that they belong to."""
    return sections.mains(c.sections())


@query("""SELECT id, CASE WHEN bool_or(label NOT IN ('title', 'abstract')) THEN 'full_text' WHEN bool_or(label = 'abstract') THEN 'abstract_only' ELSE 'title_only' END AS tier, count(*) AS n_sections FROM sections GROUP BY 1""")
def source_tiers(c):
    return sections.tiers(c.sections())


@query("""f AS (SELECT id, bool_or(label = 'title') AS t, string_agg(text, ' ' ORDER BY pos) FILTER (label = 'title') AS title, string_agg(text, ' ' ORDER BY pos) FILTER (label = 'abstract') AS abstract, string_agg(label, ', ' ORDER BY pos) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM sections) WHERE k <= 20 OR label IN ('title', 'abstract') GROUP BY 1)
SELECT id, substr('Title: ' || coalesce(title, '') || chr(10) || 'Topics: ' || topics || CASE WHEN abstract IS NOT NULL THEN chr(10) || 'Abstract: ' || abstract ELSE '' END, 1, 4000) AS block FROM f""")
def feature_blocks(c):
    """What a paper is described by, at most 4,000 letters."""
    return sections.feature_blocks(c.sections())


# -- names, keys and numbers

@query("""SELECT p_partkey AS id, p_size AS value FROM part""")
def roman_numbers(c):
    """Sizes written in Roman numerals and read again."""
    ones, tens = (F.array(*[F.lit(x) for x in row]) for row in (("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"), ("", "X", "XX", "XXX", "XL", "L")))
    p = c.table("part")
    written = F.concat(tens[F.floor(F.col("p_size") / 10).cast("int")], ones[F.col("p_size") % 10])
    return p.select(F.col("p_partkey").alias("id"), T.roman(written).cast("int").alias("value"))


@query(r"""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE '{"n":' || p_size || '}' END AS found FROM part""")
def extracted_json(c):
    """JSON in prose; braces that hold none give null."""
    p = c.table("part")
    prose = F.concat(F.lit("Here you are: "), F.when(F.col("p_partkey") % 4 == 0, F.lit("{nothing}")).otherwise(F.concat(F.lit('{"n":'), F.col("p_size").cast("string"), F.lit("}"))), F.lit(" That is all."))
    return p.select(F.col("p_partkey").alias("id"), T.json_within(prose).alias("found"))


@query(r"""SELECT p_partkey AS id, substr(trim(regexp_replace(p_name || ' ' || p_type, '\s+', ' ', 'g')), 1, 255) AS label FROM part""")
def clean_labels(c):
    """Control characters and runs of spaces taken out."""
    return c.table("part").select(F.col("p_partkey").alias("id"), T.clean_label(F.concat(F.lit(" "), "p_name", F.lit("\u0000\t \u0007"), "p_type")).alias("label"))


@query(r"""k AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'Müller.' || p_size ELSE 'x-title-INJECTED' END AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS r FROM k) SELECT id, CASE WHEN r = 1 THEN base ELSE base || '-' || r END AS cite_key FROM n""")
def overridden_keys(c):
    """Keys that readers gave, made harmless and different."""
    p = c.table("part").withColumn("id", F.col("p_partkey"))
    raw = F.when(F.col("id") % 3 == 0, F.concat(F.lit("--Müller."), F.col("p_size").cast("string"))).otherwise("x},title={INJECTED")
    return export.unique_keys(p.select("id", export.safe_key(raw, F.lit("work")).alias("cite_key")))


# -- records written and read

_ENTRY = """e AS (SELECT id, title, year, venue, work_type AS abstract, '10.1000/w' || id AS doi, ['Ada ' || split_part(title, ' ', 1), split_part(work_type, ' ', 1) || ', Bo'] AS authors FROM refs)"""


def _records(c):
    authors = F.array(F.concat(F.lit("Ada "), F.split("title", " ")[0]), F.concat(F.split("work_type", " ")[0], F.lit(", Bo")))
    return c.references().select("id", "title", "year", "venue", F.col("work_type").alias("abstract"), F.concat(F.lit("10.1000/w"), F.col("id").cast("string")).alias("doi"), authors.alias("authors"))


_READ = f"{_ENTRY} SELECT id, title, year, venue, doi, array_to_string(authors, ';') AS authors FROM e"


def _shown(rows):
    return rows.select("id", "title", "year", "venue", "doi", F.array_join("authors", ";").alias("authors"))


@query(_READ)
def crossref_records(c):
    return _shown(records.read_crossref(_records(c).select("id", records.crossref_json().alias("text"))))


@query(_READ)
def openalex_records(c):
    return _shown(records.read_openalex(_records(c).select("id", records.openalex_json().alias("text"))))


@query(f"{_ENTRY} SELECT id, title, year, abstract, doi, array_to_string(authors, ';') AS authors, '2101.' || lpad(CAST(id AS VARCHAR), 5, '0') AS arxiv FROM e")
def semantic_scholar_records(c):
    rows = records.read_semantic_scholar(_records(c).select("id", records.semantic_scholar_json().alias("text")))
    return rows.select("id", "title", "year", "abstract", "doi", F.array_join("authors", ";").alias("authors"), "arxiv")


@query(f"{_ENTRY} SELECT id, title, year, abstract, doi, array_to_string(authors, ';') AS authors, '2101.' || lpad(CAST(id AS VARCHAR), 5, '0') AS arxiv FROM e")
def atom_records(c):
    rows = records.read_atom(_records(c).select("id", records.atom_xml().alias("text")))
    return rows.select("id", "title", "year", "abstract", "doi", F.array_join("authors", ";").alias("authors"), "arxiv")


@query("""g AS (SELECT year, list(id ORDER BY id) AS ids FROM refs GROUP BY 1) SELECT year AS page, place, id AS external_id, title FROM (SELECT year, unnest(ids[1:25]) AS id, generate_subscripts(ids[1:25], 1) - 1 AS place FROM g) JOIN (SELECT id, title FROM refs) USING (id)""")
def citing_pages(c):
    """Pages of citing papers: at most 25 rows of each."""
    item = F.struct(F.struct(F.col("id").cast("string").alias("paperId"), "title", "year").alias("citingPaper"))
    # Ranked and cut, in each task first, before anything is gathered.
    place = F.row_number().over(Window.partitionBy("year").orderBy("id"))
    first = c.references().select("id", "title", "year").withColumn("place", place).where(F.col("place") <= 25)
    page = first.groupBy(F.col("year").alias("page")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("id", item.alias("i")))), lambda x: x["i"]).alias("data"))).alias("text"))
    return records.read_citing(page, 25).select("page", "place", F.col("external_id").cast("long").alias("external_id"), "title")


@query(f"""{_ENTRY} SELECT id, title, abstract, year, 'Ada ' || split_part(title, ' ', 1) AS first_author, 2 AS n_sections, 'Intro' || chr(10) || '1. Methods' AS labels, title || ' again' AS cited_title, venue AS cited_venue, 2 AS n_boxes FROM e""")
def tei_records(c):
    """Title, authors, sections, references and boxes of TEI documents."""
    r = tei.read_tei_records(_records(c).select("id", records.tei_xml().alias("text")))
    labels = F.array_join(F.transform("sections", lambda s: s["label"]), "\n")
    return r.select("id", "title", "abstract", F.col("references")[0]["year"].alias("year"), F.col("authors")[0].alias("first_author"), F.size("sections").alias("n_sections"), labels.alias("labels"), F.col("references")[0]["title"].alias("cited_title"), F.col("references")[0]["venue"].alias("cited_venue"), F.size(F.col("references")[0]["boxes"]).alias("n_boxes"))


@query(f"""{_ENTRY}, m AS (SELECT id, 'b0' AS key, '[1]' AS marker, 'Intro' AS section, title || ' is known.' AS before, 'Some use it [1], too.' AS sentence, 'Others of ' || venue || ' do not.' AS after, 12 AS mark, 3 AS page, 2 AS n_boxes, title AS cited FROM e
UNION ALL SELECT id, 'b1', 'Bo', 'methods', NULL, 'In ' || venue || ' by Bo. End. lost F', NULL, length('In ' || venue || ' by '), NULL, 0, 'Bo, ' || year || '.' FROM e) SELECT * FROM m""")
def tei_mentions(c):
    """Where TEI documents cite their references: mark, section, sentence and those beside it, offset, boxes."""
    r = tei.read_tei_records(_records(c).select("id", records.mention_xml().alias("text")))
    known = F.map_from_entries(F.transform("references", lambda x: F.struct(x["key"], F.coalesce(x["title"], x["raw"]))))
    m = r.select("id", F.explode("mentions").alias("m"), known.alias("known"))
    return m.select("id", "m.key", "m.marker", "m.section", "m.before", "m.sentence", "m.after", F.col("m.offset").alias("mark"), "m.page", F.size("m.boxes").alias("n_boxes"), F.col("known")[F.col("m.key")].alias("cited"))


@query(f"""{_ENTRY} SELECT id, concat_ws(chr(10), 'TY  - JOUR', 'AU  - ' || authors[1], 'AU  - ' || authors[2], 'TI  - ' || title, 'PY  - ' || year, 'JO  - ' || venue, 'DO  - ' || doi, 'AB  - ' || abstract, 'ER  - ') AS entry FROM e""")
def export_full_ris(c):
    return _records(c).select("id", export.full_ris().alias("entry"))


@query(f"""{_ENTRY} SELECT id, '@article{{k' || id || ',' || chr(10) || '  author = {{' || authors[1] || ' and ' || authors[2] || '}},' || chr(10) || '  title = {{' || title || '}},' || chr(10) || '  date = {{' || year || '}},' || chr(10) || '  journaltitle = {{' || replace(venue, '#', chr(92) || '#') || '}},' || chr(10) || '  doi = {{' || doi || '}}' || chr(10) || '}}' AS entry FROM e""")
def export_biblatex(c):
    return _records(c).withColumn("cite_key", F.concat(F.lit("k"), F.col("id").cast("string"))).select("id", export.full_bibtex(biblatex=True).alias("entry"))


@query(f"""{_ENTRY} SELECT id, '- [@k' || id || ']: **' || title || '** (' || year || '). ' || authors[1] || ', ' || authors[2] || '. *' || venue || '*. DOI: [' || doi || '](https://doi.org/' || doi || ')' AS entry FROM e""")
def export_pandoc(c):
    return _records(c).withColumn("cite_key", F.concat(F.lit("k"), F.col("id").cast("string"))).select("id", export.pandoc().alias("entry"))


@query(_READ.replace("authors, ';'", "['Ada ' || split_part(title, ' ', 1), split_part(abstract, ' ', 1) || ', Bo'], ';'"))
def full_ris_round_trip(c):
    from .sources import bibliography

    return _shown(bibliography.read_ris(_records(c).select("id", export.full_ris().alias("text"))))


@query(_READ.replace("authors, ';'", "['Ada ' || split_part(title, ' ', 1), 'Bo ' || split_part(abstract, ' ', 1)], ';'"))
def full_bibtex_round_trip(c):
    """Names come back as first name, last name."""
    from .sources import bibliography

    keyed = _records(c).withColumn("cite_key", F.concat(F.lit("k"), F.col("id").cast("string")))
    return _shown(bibliography.read_bibtex(keyed.select("id", export.full_bibtex().alias("text"))))


def _filed(c, texts):
    """A folder of files with these texts, in the checkpoint folder."""
    import uuid

    from .session import checkpoint_folder

    folder = f"{checkpoint_folder(c.spark)}/files-{uuid.uuid4().hex}"
    texts.select("text").write.text(folder)
    return folder


_FILED = f"""{_ENTRY} SELECT title, year, venue, doi, AUTHORS AS authors FROM e"""


@query(_FILED.replace("AUTHORS", "'Ada ' || split_part(title, ' ', 1) || ';' || split_part(abstract, ' ', 1) || ', Bo'"))
def ris_files(c):
    """All records as RIS files, read in ranges of bytes."""
    from .sources import files

    read = files.read_ris_files(c.spark, _filed(c, _records(c).select(export.full_ris().alias("text"))))
    return read.select("title", "year", "venue", "doi", F.array_join("authors", ";").alias("authors"))


@query(_FILED.replace("AUTHORS", "'Ada ' || split_part(title, ' ', 1) || ';Bo ' || split_part(abstract, ' ', 1)"))
def bibtex_files(c):
    """All records as BibTeX files, read in ranges of bytes."""
    from .sources import files

    keyed = _records(c).withColumn("cite_key", F.concat(F.lit("k"), F.col("id").cast("string")))
    read = files.read_bibtex_files(c.spark, _filed(c, keyed.select(export.full_bibtex().alias("text"))))
    return read.select("title", "year", "venue", "doi", F.array_join("authors", ";").alias("authors"))


@query(_FILED.replace("AUTHORS", "'Ada ' || split_part(title, ' ', 1) || ';' || split_part(abstract, ' ', 1)"))
def csl_files(c):
    """All records as files of CSL-JSON objects, read in ranges of bytes."""
    from .sources import files

    author = F.array(F.struct(F.lit("Ada").alias("given"), F.split("title", " ")[0].alias("family")), F.struct(F.lit(None).cast("string").alias("given"), F.split("abstract", " ")[0].alias("family")))
    item = F.struct(F.col("id").cast("string").alias("id"), "title", F.col("doi").alias("DOI"), F.col("venue").alias("container-title"), author.alias("author"), F.struct(F.array(F.array("year")).alias("date-parts")).alias("issued"))
    read = files.read_csl_files(c.spark, _filed(c, _records(c).select(F.to_json(item).alias("text"))))
    return read.select("title", "year", "venue", "doi", F.array_join("authors", ";").alias("authors"))


@query("""SELECT conv_id, string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn) AS notes FROM conversations WHERE text IS NOT NULL GROUP BY 1""")
def export_annotations(c):
    return export.annotations(c.table("conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("page"), F.col("role").alias("kind"), F.col("text").alias("note"))).select(F.col("id").alias("conv_id"), "notes")


_LINES = """l AS (SELECT p_partkey AS id, p_name || ' (' || (p_size + 1970) || ') doi:10.1000/W' || p_partkey || '.' AS line FROM part)"""


@query(r"""SELECT p_partkey AS id, p_name AS title, p_size + 1970 AS year, '10.1000/W' || p_partkey AS doi FROM part""")
def citation_lines(c):
    """Year and DOI taken out of lines of free text."""
    p = c.table("part")
    line = F.concat(F.lit("  "), "p_name", F.lit(" ("), (F.col("p_size") + 1970).cast("string"), F.lit(") doi:10.1000/W"), F.col("p_partkey").cast("string"), F.lit(". "))
    return records.cited_lines(p.select(F.col("p_partkey").alias("id"), line.alias("line")))


@query("""d AS (SELECT p_partkey AS id, lower('10.1000/W' || p_partkey) AS doi, p_name AS title, p_partkey % 9 <> 0 AS included FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY id) AS k FROM d WHERE included)
SELECT d.id, CASE WHEN NOT d.included THEN 'skipped' WHEN w.id IS NOT NULL THEN 'matched' ELSE 'created' END AS fate FROM d LEFT JOIN live_works w ON w.doi = d.doi""")
def committed_drafts(c):
    """Drafts of a batch: left out, found in the library, or made."""
    p = c.table("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("10.1000/W"), F.col("p_partkey").cast("string")).alias("doi"), F.col("p_name").alias("title"), (F.col("p_partkey") % 9 != 0).alias("included"))
    return records.committed(p, c.live_works())


@query("""SELECT year AS batch, count(*) AS n_works, count(*) FILTER (doi IS NULL) AS without_doi FROM live_works GROUP BY 1""")
def import_batches(c):
    return c.live_works().groupBy(F.col("year").alias("batch")).agg(F.count("*").alias("n_works"), F.count_if(F.col("doi").isNull()).alias("without_doi"))


@query("""a AS (SELECT url AS path, min(page_id) AS size FROM pages WHERE page_id % 3 <> 0 GROUP BY 1), b AS (SELECT url AS path, max(page_id) AS size FROM pages WHERE page_id % 4 <> 0 GROUP BY 1)
SELECT path, coalesce(b.size, a.size) AS size, b.path IS NULL AS source_removed, a.path IS NULL AS is_new FROM a FULL JOIN b USING (path)""")
def manifest_upserts(c):
    """Known files against a new manifest."""
    p = c.table("pages")
    old = p.where("page_id % 3 <> 0").groupBy(F.col("url").alias("path")).agg(F.min("page_id").alias("size"))
    new = p.where("page_id % 4 <> 0").groupBy(F.col("url").alias("path")).agg(F.max("page_id").alias("size"))
    return records.upserted_manifest(old, new)


_HOSTS = "['arxiv.org/abs/', 'dl.acm.org/doi/', 'link.springer.com/article/', 'www.nature.com/articles/', 'aclanthology.org/', 'openreview.net/forum?id=', 'example.com/x/'][p_partkey % 7 + 1]"


@query(f"""u AS (SELECT p_partkey AS id, 'https://' || {_HOSTS} || p_partkey AS url FROM part) SELECT id, CASE id % 7 WHEN 0 THEN replace(url, '/abs/', '/pdf/') WHEN 1 THEN replace(url, '/doi/', '/doi/pdf/') WHEN 2 THEN replace(url, '/article/', '/content/pdf/') || '.pdf' WHEN 3 THEN url || '.pdf' WHEN 4 THEN url || '.pdf' WHEN 5 THEN replace(url, '/forum', '/pdf') END AS pdf FROM u""")
def publisher_links(c):
    """Where publishers keep the file of a page."""
    hosts = F.array(*[F.lit(h) for h in ("arxiv.org/abs/", "dl.acm.org/doi/", "link.springer.com/article/", "www.nature.com/articles/", "aclanthology.org/", "openreview.net/forum?id=", "example.com/x/")])
    p = c.table("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("https://"), hosts[(F.col("p_partkey") % 7).cast("int")], F.col("p_partkey").cast("string")).alias("url"))
    return p.select("id", F.get(records.publisher_pdfs(F.col("url")), F.lit(0)).alias("pdf"))


#: A page of each publisher whose files are known, and its file, with a number for `#`.
_PAGES = (
    ("https://arxiv.org/abs/#", "https://arxiv.org/pdf/#"), ("https://dl.acm.org/doi/10.1/#", "https://dl.acm.org/doi/pdf/10.1/#"),
    ("https://link.springer.com/article/#/", "https://link.springer.com/content/pdf/#.pdf"), ("https://onlinelibrary.wiley.com/doi/#", "https://onlinelibrary.wiley.com/doi/pdfdirect/#"),
    ("https://ieeexplore.ieee.org/document/#", "https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?tp=&arnumber=#"), ("https://www.nature.com/articles/#?a=b", "https://www.nature.com/articles/#.pdf"),
    ("https://www.mdpi.com/1111-222/1/#", "https://www.mdpi.com/1111-222/1/#/pdf"), ("https://aclanthology.org/#/", "https://aclanthology.org/#.pdf"),
    ("https://openreview.net/forum?id=#", "https://openreview.net/pdf?id=#"), ("https://papers.nips.cc/paper/#", "https://papers.nips.cc/paper/#.pdf"),
    ("https://proceedings.neurips.cc/paper/hash/#-Abstract.html", "https://proceedings.neurips.cc/paper/file/#-Paper.pdf"), ("https://www.medrxiv.org/content/#", "https://www.medrxiv.org/content/#.full.pdf"),
    ("https://www.biorxiv.org/content/#v1", "https://www.biorxiv.org/content/#v1.full.pdf"), ("https://journals.plos.org/plosone/article?id=10.1/#", "https://journals.plos.org/plosone/article/file?id=10.1/#&type=printable"),
)


@query(f"""SELECT p_partkey AS id, replace([{", ".join(f"'{f}'" for _, f in _PAGES)}][p_partkey % {len(_PAGES)} + 1], '#', CAST(p_partkey AS VARCHAR)) AS pdf FROM part""")
def all_publisher_links(c):
    """Where each publisher keeps the file of a page."""
    page = F.array(*[F.lit(p) for p, _ in _PAGES])[(F.col("p_partkey") % len(_PAGES)).cast("int")]
    url = F.replace(page, F.lit("#"), F.col("p_partkey").cast("string"))
    return c.table("part").select(F.col("p_partkey").alias("id"), F.get(records.publisher_pdfs(url), F.lit(0)).alias("pdf"))


#: What is added to each page, with its number for `#`, and the links that it must lead to: kind, address (`^`: the page's host before it), score.
_ADDED = """<meta NAME='citation_pdf_url' content="/files/#.pdf?a=1&amp;b=2"><a href=/paper/#.pdf class=btn-download>Article</a><a href='/doc/#' title="PDF">View PDF<b> now</b></a><a href="/suppl/#.pdf">supplement</a><a href="mailto:x">PDF</a><!-- <a href="/no.pdf">PDF</a> --><link rel="alternate" type="application/pdf" href="https://x.org/#.pdf"><a href="/paper/#.pdf">again PDF</a><script>{"u": "https:\\/\\/y.org\\/#.pdf"}</script><a href="/open.pdf">never ends"""
_ADDED_LINKS = (("meta", "^/files/#.pdf?a=1&b=2", None), ("alternate", "https://x.org/#.pdf", None), ("anchor", "^/paper/#.pdf", 6), ("anchor", "^/doc/#", 5), ("script", "https://y.org/#.pdf", None))


@query("SELECT page_id, CAST(place AS INTEGER) AS place, kind, CAST(score AS INTEGER) AS score, replace(replace(link, '^', regexp_extract(url, '^[a-z]+://[^/?#]*')), '#', CAST(page_id AS VARCHAR)) AS link FROM pages, (VALUES " + ", ".join(f"({i}, '{k}', '{u}', {'NULL' if n is None else n})" for i, (k, u, n) in enumerate(_ADDED_LINKS)) + ") AS l(place, kind, link, score)")
def pdf_links(c):
    """Links of web pages to files: metas, alternates, anchors with scores, scripts; five of each are added to the pages."""
    p = c.table("pages").select("page_id", "url", F.concat("html", F.replace(F.lit(_ADDED), F.lit("#"), F.col("page_id").cast("string"))).alias("html"))
    return page_links.pdf_links(p)


# -- vectors, topics and recommendation

@query("""c AS (SELECT cited_id AS id, count(DISTINCT citing_id) AS citers, count(*) AS mentions, count(DISTINCT section) AS sections FROM citations GROUP BY 1) SELECT r.id, r.year, coalesce(citers, 0) AS citers, coalesce(mentions, 0) AS mentions, coalesce(sections, 0) AS sections, round(coalesce(citers, 0) / CAST(greatest(1, 2024 - r.year) AS DOUBLE), 6) AS velocity, 2024 - r.year AS age, round(coalesce(mentions, 0) / CAST(greatest(1, coalesce(citers, 0)) AS DOUBLE), 6) AS depth FROM refs r LEFT JOIN c USING (id)""")
def temporal_axes(c):
    """The axes of a map of papers over time."""
    n = c.citations().groupBy(F.col("cited_id").alias("id")).agg(F.countDistinct("citing_id").alias("citers"), F.count("*").alias("mentions"), F.countDistinct("section").alias("sections"))
    r = c.references().select("id", "year").join(n, "id", "left").na.fill(0, ["citers", "mentions", "sections"])
    return r.withColumns({"velocity": F.round(F.col("citers") / F.greatest(F.lit(1), 2024 - F.col("year")), 6), "age": 2024 - F.col("year"), "depth": F.round(F.col("mentions") / F.greatest(F.lit(1), F.col("citers")), 6)})


@query("""t AS (SELECT cited_id AS node, count(DISTINCT citing_id) AS citers FROM citations GROUP BY 1 ORDER BY citers DESC, node LIMIT 60), d AS (SELECT DISTINCT citing_id, cited_id FROM citations WHERE cited_id IN (SELECT node FROM t))
SELECT p.cited_id AS a, q.cited_id AS b, count(*) AS weight FROM d p JOIN d q USING (citing_id) WHERE p.cited_id < q.cited_id GROUP BY 1, 2""")
def co_citation_network(c):
    """Which of the 60 most cited papers are cited together."""
    from .operators import graph, reports

    top = reports.in_degree(c.citations(), 60).select("cited_id")
    return graph.co_citation(c.citations().join(F.broadcast(top), "cited_id", "left_semi"), least=1)


@query("""SELECT 'papers' AS measure, CAST(count(*) AS BIGINT) AS value FROM live_works UNION ALL SELECT 'citing', count(DISTINCT citing_id) FROM citations UNION ALL SELECT 'cited', count(DISTINCT cited_id) FROM citations UNION ALL SELECT 'mentions', count(*) FROM citations
UNION ALL SELECT 'isolated', count(*) FROM refs WHERE id NOT IN (SELECT cited_id FROM citations) UNION ALL SELECT 'years', count(DISTINCT year) FROM live_works UNION ALL SELECT 'most_cited', max(n) FROM (SELECT count(DISTINCT citing_id) AS n FROM citations GROUP BY cited_id)""")
def citation_summary(c):
    """Figures of a scope in one table."""
    cited = c.citations().groupBy("cited_id").agg(F.countDistinct("citing_id").alias("n"), F.count("*").alias("mentions"))
    parts = [
        ("papers", c.live_works().agg(F.count("*"))),
        ("citing", c.citations().agg(F.countDistinct("citing_id"))),
        ("cited", cited.agg(F.count("*"))),
        ("mentions", cited.agg(F.sum("mentions"))),
        ("isolated", c.references().join(cited, F.col("id") == F.col("cited_id"), "left_anti").agg(F.count("*"))),
        ("years", c.live_works().agg(F.countDistinct("year"))),
        ("most_cited", cited.agg(F.max("n"))),
    ]
    out = None
    for name, value in parts:
        row = value.toDF("value").select(F.lit(name).alias("measure"), F.col("value").cast("long").alias("value"))
        out = row if out is None else out.unionAll(row)
    return out


@query("""m AS (SELECT work_id, pos, avg(x) AS x FROM (SELECT work_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM vectors) GROUP BY 1, 2), n AS (SELECT work_id, sqrt(sum(x * x)) AS norm FROM m GROUP BY 1), u AS (SELECT work_id, pos, x / norm AS x FROM m JOIN n USING (work_id)),
h AS (SELECT work_id, pos, avg(x) AS x FROM (SELECT work_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM vectors WHERE chunk_id % 2 = 0) GROUP BY 1, 2), hn AS (SELECT work_id, sqrt(sum(x * x)) AS norm FROM h GROUP BY 1)
SELECT work_id, count(*) AS dim, round(sum(x * x), 6) AS squared FROM (SELECT work_id, x FROM u UNION ALL SELECT work_id, x / norm FROM h JOIN hn USING (work_id)) GROUP BY 1""")
def joined_vectors(c):
    """Means of two models, each of unit length, side by side; every second chunk stands for the other model."""
    v = c.vectors()
    return sections.side_by_side([v, v.where("chunk_id % 2 = 0")]).select("work_id", F.size("vector").cast("long").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 6).alias("squared"))


@query("""t AS (SELECT work_id, tag FROM tags UNION SELECT user_id, 'topic ' || (event_id % 3) FROM events WHERE event_type = 'view') SELECT tag, count(*) AS n, min(work_id) AS first_id FROM t GROUP BY 1""")
def topics_as_tags(c):
    """Assignments of topics added to tags, each pair once."""
    topics = c.table("events").where("event_type = 'view'").select(F.col("user_id").alias("work_id"), F.concat(F.lit("topic "), (F.col("event_id") % 3).cast("string")).alias("tag"))
    return c.tags().unionAll(topics).distinct().groupBy("tag").agg(F.count("*").alias("n"), F.min("work_id").alias("first_id"))


@query("""a AS (SELECT user_id AS id, event_id % 3 AS topic, event_type AS term, value FROM events), s AS (SELECT topic, term, round(sum(value), 4) AS weight FROM a GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS place FROM s), n AS (SELECT topic, count(DISTINCT id) AS members FROM a GROUP BY 1)
SELECT topic, members, string_agg(term, ' ' ORDER BY place) AS terms FROM r JOIN n USING (topic) WHERE place <= 3 GROUP BY 1, 2""")
def stored_topics(c):
    """Topics rebuilt from stored assignments, their terms from the members' weights."""
    a = c.table("events").select(F.col("user_id").alias("id"), (F.col("event_id") % 3).alias("topic"), F.col("event_type").alias("term"), "value")
    return sections.rebuilt_topics(a, 3)


@query("""SELECT s.shelf_id, w.venue, count(*) AS n FROM shelf_works s JOIN live_works w ON w.id = s.work_id WHERE s.shelf_id % 5 = 0 GROUP BY 1, 2""")
def shelf_profiles(c):
    return c.shelf_works().where("shelf_id % 5 = 0").join(c.live_works(), F.col("work_id") == F.col("id")).groupBy("shelf_id", "venue").agg(F.count("*").alias("n"))
