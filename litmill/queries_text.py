"""Queries over stored indexes, key phrases, summaries, chunks, topics, recommendation and enrichment."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import graph, linkage, recommend, reports, retrieval, sections, segments, substring, textmine
from .queries import _TOKENS, _bags, query
from .session import cut

# -- the field index

_FSTOP = ", ".join(f"'{w}'" for w in retrieval.FIELD_STOPS)
_FIELDS = f"""fx AS (SELECT id, CASE WHEN label = 'title' THEN 'title' WHEN label = 'abstract' THEN 'abstract' WHEN regexp_matches(lower(label), 'introduc|related|background|prior work|motivation|acknowledg') THEN 'body_low' ELSE 'body_high' END AS field,
  list_filter({_TOKENS.format("text")}, lambda t: t NOT IN ({_FSTOP})) AS terms FROM sections),
fl AS (SELECT id, field, sum(len(terms)) AS length FROM fx WHERE len(terms) > 0 GROUP BY 1, 2), fn AS (SELECT count(DISTINCT id) AS n FROM fl), fm AS (SELECT field, sum(length) / CAST((SELECT n FROM fn) AS DOUBLE) AS mean FROM fl GROUP BY 1),
ft AS (SELECT id, field, unnest(terms) AS term FROM fx), fc AS (SELECT id, term, field, count(*) AS tf FROM ft GROUP BY ALL),
fw AS (SELECT id, term, sum(CASE field WHEN 'title' THEN 3.0::DOUBLE WHEN 'abstract' THEN 2.0::DOUBLE WHEN 'body_high' THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END * tf / (0.25 + 0.75 * length / mean)) AS wtf FROM fc JOIN fl USING (id, field) JOIN fm USING (field) GROUP BY 1, 2),
fd AS (SELECT term, count(*) AS df FROM fw GROUP BY 1), fp AS (SELECT id, term, (wtf * 2.5 / (1.5 + wtf) + 1) * ln(((SELECT n FROM fn) - df + 0.5) / (df + 0.5) + 1) AS score FROM fw JOIN fd USING (term))"""


def _field_rows(c):
    return c.sections().select("id", sections.index_field(F.col("label")).alias("field"), "text")


def _field_index(c):
    return retrieval.written("fields", c.table("documents"), lambda: retrieval.field_postings(_field_rows(c)), by_term=True, made_with=(retrieval.FIELD_WEIGHTS, retrieval.FIELD_STOPS))


@query(f"""{_FIELDS} SELECT id, round(round(sum(score), 6), 4) AS score FROM (SELECT id, score, sum(score) OVER (PARTITION BY id) AS total FROM fp WHERE term IN ('tion', 'erth', 'oned')) GROUP BY 1, total ORDER BY round(total, 6) DESC, id LIMIT 40""")
def field_search(c):
    """Four weighted fields; the index is stored once, and only the parts of the query's terms are read."""
    return retrieval.stored_search(_field_index(c), "tion erth of oned", 40).select("id", F.round("score", 4).alias("score"))


@query(f"""{_FIELDS} SELECT id, count(*) AS terms, round(sum(score), 4) AS mass FROM fp GROUP BY 1""")
def field_index(c):
    return _field_index(c).groupBy("id").agg(F.count("*").alias("terms"), F.round(F.sum("score"), 4).alias("mass"))


@query(f"""{_FIELDS} SELECT id, round(round(sum(score), 6), 4) AS score FROM (SELECT id, score, sum(score) OVER (PARTITION BY id) AS total FROM fp WHERE term IN ('tion', 'erth', 'oned')) GROUP BY 1, total ORDER BY round(total, 6) DESC, id LIMIT 40""")
def segmented_search(c):
    """`field_search` over an index in batches, which counts only files that it does not know."""
    folder, living = segments.kept_up(c.table("documents"), "segments", "doc_id", lambda docs: _field_rows(c.over(documents=docs)))
    return retrieval.search(segments.scored(folder, living, "tion erth of oned"), "tion erth oned", 40).select("id", F.round("score", 4).alias("score"))


#: Patterns of a substring search: with and without wildcards, and one without three letters in a row.
_PATTERNS = ("THONTI", "erth%ing and", "e_de_ther", "é%ß", "$$$ re", "ou", "not in any text")


@query(" UNION ALL ".join(f"SELECT '{p}' AS pattern, id FROM texts WHERE body ILIKE '%{p}%'" for p in _PATTERNS))
def substring_search(c):
    """Texts that contain each of some patterns, by an index of trigrams."""
    texts = c.texts().select("id", F.col("body").alias("text"))
    index = substring.stored("trigrams", c.table("documents"), texts)
    found = [substring.search(index, texts, p).select(F.lit(p).alias("pattern"), "id") for p in _PATTERNS]
    return functools.reduce(DataFrame.unionAll, found)


# -- key phrases and summaries

_PSTOP = ", ".join(f"'{w}'" for w in textmine.PHRASE_STOPS)
_WORDS = "string_split_regex(lower(coalesce({0}, '')), '[^a-z0-9+\\-]+')"
_CONTENT = f"regexp_matches(w, '^[a-z][a-z0-9+\\-]+$') AND length(w) >= 3 AND w NOT IN ({_PSTOP})"
_PHRASES = f"""pr AS (SELECT id, trim(unnest(string_split(array_to_string(list_transform({_WORDS.format("body")}, lambda w: CASE WHEN {_CONTENT} THEN w ELSE '|' END), ' '), '|'))) AS run FROM texts),
ph AS (SELECT id, list_slice(string_split(run, ' '), 1, 4) AS words FROM pr WHERE run <> ''), pw AS (SELECT id, len(words) AS size, unnest(words) AS word FROM ph), pq AS (SELECT id, word, CAST(sum(size) AS DOUBLE) / count(*) AS ratio FROM pw GROUP BY 1, 2),
pd AS (SELECT DISTINCT id, words, array_to_string(words, ' ') AS phrase FROM ph), pe AS (SELECT id, phrase, unnest(words) AS word FROM pd), psc AS (SELECT id, phrase, round(sum(ratio), 6) AS score FROM pe JOIN pq USING (id, word) GROUP BY 1, 2),
pk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, phrase) - 1 AS place FROM psc)"""


@query(f"""{_PHRASES} SELECT id, phrase, score, place + 1 AS place FROM pk WHERE place < 5""")
def key_phrases(c):
    return textmine.key_phrases(c.texts(), 5)


@query(f"""{_PHRASES}, rw AS (SELECT DISTINCT id, unnest(list_filter({_WORDS.format("body")}, lambda w: {_CONTENT})) AS word FROM texts), ri AS (SELECT word, ln((1.0 + (SELECT count(*) FROM texts)) / (1 + count(*))) + 1 AS idf FROM rw GROUP BY 1),
tw AS (SELECT id, list_filter({_WORDS.format("title")}, lambda w: {_CONTENT}) AS title_words FROM texts), pi AS (SELECT id, phrase, avg(idf) AS idf FROM pe JOIN ri USING (word) GROUP BY 1, 2)
SELECT id, phrase, round(CASE WHEN list_has_all(title_words, words) THEN 1.5 ELSE 1.0 END * idf / (60 + place), 9) AS value FROM pk JOIN pd USING (id, phrase) JOIN pi USING (id, phrase) JOIN tw USING (id)""")
def phrase_values(c):
    """What every phrase is worth: by place, title and rarity."""
    return textmine.phrase_values(c.texts()).select("id", "phrase", "value")


@query()
def keywords(c):
    """The ten best phrases of each text without near-equal ones; by a fold, so tested against a plain version."""
    return textmine.keywords(c.texts())


_SENTENCES = r"""sp AS (SELECT id, string_split(regexp_replace(coalesce(body, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM {0}), su AS (SELECT id, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS pos FROM sp), se AS (SELECT id, pos, trim(sentence) AS sentence FROM su WHERE trim(sentence) <> '')"""
_SALIENT = "unnest(list_filter(regexp_extract_all(lower(sentence), '[a-z][a-z''-]{2,}'), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in retrieval.STOPWORDS) + "))) AS w"


@query(f"""{_SENTENCES.format("texts")}, sw AS (SELECT id, pos, {_SALIENT} FROM se), sf AS (SELECT id, w, count(*) AS f FROM sw GROUP BY 1, 2), sk AS (SELECT id, max(f) AS peak FROM sf GROUP BY 1),
sc AS (SELECT id, pos, round(sum(CAST(f AS DOUBLE) / peak) / sqrt(count(*)), 6) AS score FROM sw JOIN sf USING (id, w) JOIN sk USING (id) GROUP BY 1, 2), sr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos DESC) AS k FROM sc)
SELECT id, pos, score, sentence FROM sr JOIN se USING (id, pos) WHERE k <= 3""")
def summaries(c):
    return textmine.summary(c.texts(), 3)


@query(f"""ab AS (SELECT id, text AS body FROM sections WHERE label = 'abstract'), {_SENTENCES.format("ab")}, sw AS (SELECT id, pos, {_SALIENT} FROM se), sf AS (SELECT w, count(*) AS f FROM sw GROUP BY 1),
sc AS (SELECT id, pos, round(sum(CAST(f AS DOUBLE) / (SELECT max(f) FROM sf)) / sqrt(count(*)), 6) AS score FROM sw JOIN sf USING (w) GROUP BY 1, 2), best AS (SELECT * FROM sc ORDER BY score DESC, id DESC, pos DESC LIMIT 8)
SELECT id, pos, score, sentence FROM best JOIN se USING (id, pos)""")
def scope_summary(c):
    """The eight most salient sentences of all abstracts."""
    return textmine.scope_summary(c.sections().where("label = 'abstract'").select("id", F.col("text").alias("body")), 8)


@query()
def packed_sections(c):
    """Sections packed in order into blocks of at most 2,000 letters; a fold, tested against a plain version."""
    return textmine.packed_blocks(c.sections().select("id", "pos", "text"), 2000).select("id", "pack", "letters", F.sha2("text", 256).alias("sha256"))


@query()
def section_chunks(c):
    """Chunks of sections that are not left out, numbered through each paper; a fold, tested against a plain version."""
    s = c.sections().where(~sections.skipped(F.col("label")))
    keyed = s.select(F.struct("id", "pos", "label").alias("id"), F.col("text").alias("body"))
    cut_up = textmine.chunks(keyed, 80, 100, 12).select("id.id", F.col("id.pos").alias("section_pos"), F.col("id.label").alias("section"), "pos", "n_words", "chunk")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("id").orderBy("section_pos", "pos")) - 1
    return cut_up.select("id", place.alias("position"), "section", "n_words", F.sha2("chunk", 256).alias("sha256"))


# -- topics and maps of vectors

@query()
def embedding_topics(c):
    """Clusters of papers by their mean vectors; iterative, tested against a plain version."""
    return textmine.dense_topics(_means(c), 4)


def _means(c):
    v = c.vectors().select("work_id", F.posexplode("vector").alias("pos", "x")).groupBy("work_id", "pos").agg(F.avg("x").alias("x"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return v.groupBy(F.col("work_id").cast("long").alias("id")).agg(F.transform(rows, lambda r: r["x"]).alias("vector"))


_CSTOP = ", ".join(f"'{w}'" for w in textmine.STOPWORDS)


@query(rf"""w AS (SELECT work_id AS cluster, unnest(list_filter(regexp_extract_all(lower(coalesce(body, '')), '[a-z][a-z''-]{{2,}}'), lambda t: t NOT IN ({_CSTOP}))) AS term FROM vectors v JOIN texts t ON t.id = v.chunk_id),
n AS (SELECT cluster, count(*) AS words FROM w GROUP BY 1), f AS (SELECT term, count(*) AS everywhere FROM w GROUP BY 1), c AS (SELECT cluster, term, count(*) AS here FROM w GROUP BY 1, 2),
s AS (SELECT cluster, term, round(here / CAST(words AS DOUBLE) * ln(1 + (SELECT avg(words) FROM n) / everywhere), 9) AS weight FROM c JOIN n USING (cluster) JOIN f USING (term)),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS place FROM s) SELECT cluster, place, term, round(weight, 6) AS weight FROM r WHERE place <= 5""")
def cluster_labels(c):
    """The five terms that tell each cluster of vectors, by its papers' texts, from the others."""
    members = c.vectors().select(F.col("chunk_id").alias("id"), F.col("work_id").alias("cluster"))
    return textmine.cluster_labels(c.texts().select("id", "body"), members, 5).select("cluster", "place", "term", F.round("weight", 6).alias("weight"))


@query()
def embedding_plane(c):
    """Chunk vectors on their two main axes; tested against a singular value decomposition."""
    rows = c.vectors().select(F.col("chunk_id").alias("id"), "vector")
    return textmine.plane(rows).select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query()
def bridge_papers(c):
    """Nodes that most shortest paths go through; see `betweenness`."""
    return graph.betweenness(c.shelf_links()).orderBy(F.desc("betweenness"), "node").limit(5).select("node", F.round("betweenness", 4).alias("betweenness"))


_HASH = "CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % 256 AS INTEGER) AS bucket, CAST(sum(CASE WHEN ('0x' || substr(md5(t), 9, 2))::INTEGER % 2 = 1 THEN n ELSE -n END) AS DOUBLE) AS x"


@query(f"""bw AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest({_TOKENS.format("coalesce(body, '')")}) AS t FROM texts) GROUP BY 1, 2), bags AS (SELECT * FROM (SELECT id, {_HASH} FROM bw GROUP BY 1, 2) WHERE x <> 0),
lw AS (SELECT label, t, count(*) AS n FROM (SELECT label, unnest({_TOKENS.format("title")}) AS t FROM (SELECT title, venue AS label FROM texts)) GROUP BY 1, 2), labels AS (SELECT * FROM (SELECT label, {_HASH} FROM lw GROUP BY 1, 2) WHERE x <> 0),
nb AS (SELECT id, sqrt(sum(x * x)) AS norm FROM bags GROUP BY 1), nl AS (SELECT label, sqrt(sum(x * x)) AS norm FROM labels GROUP BY 1),
sc AS (SELECT b.id, l.label, round(sum(b.x * l.x) / (any_value(nb.norm) * any_value(nl.norm)), 6) AS score FROM bags b JOIN labels l USING (bucket) JOIN nb ON nb.id = b.id JOIN nl ON nl.label = l.label GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS place FROM sc WHERE score > 0)
SELECT id, label, place FROM r WHERE place <= 3""")
def label_affinity(c):
    """The three sources whose titles are most like a text."""
    labels = retrieval.bag_vectors(c.texts().select(F.col("venue").alias("id"), F.col("title").alias("body"))).withColumnRenamed("id", "label")
    return retrieval.label_affinity(_bags(c), labels, 3).select("id", "label", "place")


@query("""p AS (SELECT work_id, tag FROM tags), f AS (SELECT shelf_id, tag, count(*) AS n FROM shelf_works JOIN p USING (work_id) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY n DESC, shelf_id) AS place FROM f),
s AS (SELECT rack_id, sum(greatest(0, 3 - place + 1)) AS points FROM r JOIN shelves USING (shelf_id) WHERE place <= 3 GROUP BY 1) SELECT rack_id, CAST(points AS DOUBLE) AS points FROM s""")
def recommended_run(c):
    """A whole run: shelves ranked for each tag, ranks to points, points added up for racks."""
    from pyspark.sql import Window

    counts = c.shelf_works().join(c.tags(), "work_id").groupBy("shelf_id", "tag").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("n"), "shelf_id"))
    ranked = counts.select(F.col("tag").alias("work_id"), F.col("shelf_id").alias("child_id"), place.alias("place"))
    points = recommend.rank_points(ranked, 3)
    return points.join(c.shelves().select(F.col("shelf_id").alias("child_id"), "rack_id"), "child_id").groupBy("rack_id").agg(F.sum("points").alias("points"))


@query("""w AS (SELECT work_id, count(*) AS n FROM vectors WHERE chunk_id % 3 <> 0 GROUP BY 1), a AS (SELECT DISTINCT work_id FROM vectors) SELECT id, title FROM texts WHERE id % 3 = 0 AND id NOT IN (SELECT chunk_id FROM vectors WHERE chunk_id % 2 = 0)""")
def missing_embeddings(c):
    """Texts that still want a vector."""
    have = c.vectors().where("chunk_id % 2 = 0").select(F.col("chunk_id").alias("id")).distinct()
    return c.texts().where("id % 3 = 0").join(have, "id", "left_anti").select("id", "title")


# -- enrichment and matching by similarity

@query()
def disagreeing_fields(c):
    """How alike the least alike values of a field are; string similarity is beyond SQL."""
    return linkage.disagreement(c.assertions().where("value is not null"))


@query()
def ranked_candidates(c):
    """Cited papers as candidates for shortened titles; string similarity is beyond SQL."""
    r = c.references()
    words = F.split("title", " ")
    found = r.select(F.col("id").alias("query_id"), F.array_join(F.slice(words, 1, 3), " ").alias("wanted_title"), (F.col("year") + F.col("id").cast("int") % 3).alias("wanted_year"), F.array(F.concat(F.lit("Ada "), words[0])).alias("wanted_authors"), F.substring("title", 1, 4).alias("block"))
    cand = r.select(F.col("id").alias("cand_id"), "title", "year", F.array(F.concat(F.lit("Bo "), words[0]), F.lit("Cy Doe")).alias("authors"), (F.col("id") % 2 == 0).alias("open"), F.substring("title", 1, 4).alias("block"))
    return linkage.ranked_in_blocks(found, cand, 3)


@query("""p AS (SELECT p_partkey AS id, p_size / 50.0::DOUBLE AS score, p_name AS title, p_partkey % 4 = 0 AS has_doi FROM part) SELECT id, CASE WHEN score >= 0.6 THEN title ELSE '(line)' END AS title, CASE WHEN score >= 0.6 OR has_doi THEN 'matched' ELSE 'unmatched' END AS status FROM p""")
def previewed_lines(c):
    """Lines of a batch with their best candidate, if it is good enough."""
    p = c.table("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("score"), F.col("p_name").alias("title"), (F.col("p_partkey") % 4 == 0).alias("has_doi"))
    good = F.col("score") >= 0.6
    return p.select("id", F.when(good, F.col("title")).otherwise("(line)").alias("title"), F.when(good | F.col("has_doi"), "matched").otherwise("unmatched").alias("status"))


@query("""SELECT id, '10.1000/w' || id AS doi, EXISTS (SELECT 1 FROM live_works w WHERE w.doi = '10.1000/w' || r.id) AS known FROM refs r""")
def previewed_bibtex(c):
    """Entries of BibTeX text, and whether the library has them; nothing is written."""
    from .sources import bibliography, export

    r = c.references().withColumn("cite_key", F.concat(F.lit("k"), F.col("id").cast("string"))).withColumn("doi", F.concat(F.lit("10.1000/w"), F.col("id").cast("string")))
    read = bibliography.read_bibtex(r.select("id", export.bibtex().alias("text"))).select("id", "doi")
    known = c.live_works().where("doi is not null").select("doi").distinct().withColumn("known", F.lit(True))
    return read.join(known, "doi", "left").select("id", "doi", F.coalesce("known", F.lit(False)).alias("known"))


_EXTRACT = """pa AS (SELECT id, 'New ' || id AS title, 1990 AS year FROM live_works WHERE id % 4 = 1), fo AS (SELECT l_orderkey AS citing_id, l_partkey AS cited_id FROM lineitem WHERE l_orderkey % 4 = 1 AND l_linenumber = 1),
ke AS (SELECT DISTINCT citing_id, cited_id FROM (SELECT citing_id, cited_id FROM citations WHERE citing_id NOT IN (SELECT id FROM pa) UNION ALL SELECT * FROM fo))"""


@query(f"""{_EXTRACT} SELECT 'links' AS what, count(*) AS n FROM ke UNION ALL SELECT 'orphans', count(*) FROM (SELECT DISTINCT cited_id FROM citations WHERE cited_id NOT IN (SELECT cited_id FROM ke)) UNION ALL SELECT 'titles', count(*) FROM live_works w LEFT JOIN pa USING (id) WHERE coalesce(CASE WHEN w.id % 5 <> 0 THEN w.title END, pa.title) IS NOT NULL""")
def stored_extractions(c):
    """Papers read again: blanks filled, links replaced, orphans found."""
    works = c.live_works().select("id", F.when(F.col("id") % 5 != 0, F.col("title")).alias("title"), "year")
    parsed = c.live_works().where("id % 4 = 1").select("id", F.concat(F.lit("New "), F.col("id").cast("string")).alias("title"), F.lit(1990).alias("year"))
    found = c.table("lineitem").where("l_orderkey % 4 = 1 and l_linenumber = 1").select(F.col("l_orderkey").alias("citing_id"), F.col("l_partkey").alias("cited_id"))
    filled, kept, orphans = linkage.extracted(works, parsed, c.citations(), found)
    parts = [("links", kept), ("orphans", orphans), ("titles", filled.where("title is not null"))]
    out = None
    for name, rows in parts:
        n = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = n if out is None else out.unionAll(n)
    return out


@query("""q AS (SELECT shelf_id AS src, work_id AS dst, 1 + work_id % 5 AS weight FROM shelf_works), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS place FROM q) SELECT src, dst, weight FROM r WHERE place <= 4""")
def kept_external(c):
    """The heaviest targets of each source, within its quota of four."""
    links = c.shelf_works().select(F.col("shelf_id").alias("src"), F.col("work_id").alias("dst"), (1 + F.col("work_id") % 5).alias("weight"))
    quota = links.select("src").distinct().withColumn("keep", F.lit(4))
    return graph.kept_targets(links, quota)


@query("""n AS (SELECT id, unnest(['Zoé ' || split_part(title, ' ', 1), 'ZOE ' || split_part(title, ' ', 1)]) AS name FROM refs), k AS (SELECT id, name, strip_accents(lower(split_part(name, ' ', 2))) || ' ' || strip_accents(lower(substr(name, 1, 1))) AS author FROM n)
SELECT author, count(DISTINCT id) AS n, count(DISTINCT name) AS spellings FROM k GROUP BY 1""")
def folded_authors(c):
    """Authors whose names differ in accents and case only are one."""
    word = F.split("title", " ")[0]
    return reports.folded_authors(c.references().withColumn("authors", F.concat_ws("; ", F.concat(F.lit("Zoé "), word), F.concat(F.lit("ZOE "), word))))


# -- contexts, listings and colours

_SEC_SENTENCES = r"""sp AS (SELECT id, pos AS section, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM sections WHERE label NOT IN ('title', 'abstract')), su AS (SELECT id, section, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS pos FROM sp), se AS (SELECT id, section, pos, trim(sentence) AS sentence FROM su WHERE trim(sentence) <> '')"""


@query(rf"""{_SEC_SENTENCES}, n AS (SELECT id, section, pos, lag(sentence) OVER w AS before, sentence, lead(sentence) OVER w AS after FROM se WINDOW w AS (PARTITION BY id, section ORDER BY pos)) SELECT * FROM n WHERE regexp_matches(sentence, ' under |[0-9]')""")
def mention_contexts(c):
    """Sentences with a mark, each with the one before and the one after in its section; digits and one word stand for marks."""
    body = c.sections().where("label not in ('title', 'abstract')").select(F.struct("id", F.col("pos").alias("section")).alias("id"), F.col("text").alias("body"))
    found = textmine.neighbours(textmine.sentences(body)).where(F.col("sentence").rlike(" under |[0-9]"))
    return found.select("id.id", "id.section", "pos", "before", "sentence", "after")


@query("""SELECT year, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM refs GROUP BY 1""")
def chronology_members(c):
    return reports.chronology_members(c.references())


@query(f"""SELECT year, CAST(floor(id / {reports.PAGE}) AS BIGINT) AS page, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM refs GROUP BY 1, 2""")
def chronology_pages(c):
    return reports.chronology_pages(c.references())


@query("""r AS (SELECT id, CASE WHEN id % 3 = 0 THEN upper(venue) WHEN id % 3 = 1 THEN venue || '.' ELSE venue END AS venue, year FROM refs), k AS (SELECT *, trim(regexp_replace(lower(venue), '[^a-z0-9]+', ' ', 'g')) AS venue_key FROM r), n AS (SELECT venue_key, venue, count(*) AS n FROM k GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY venue_key ORDER BY n DESC, length(venue) DESC, venue DESC) AS p FROM n) SELECT venue_key, venue, (SELECT sum(n) FROM n x WHERE x.venue_key = b.venue_key)::BIGINT AS n FROM b WHERE p = 1""")
def venue_spellings(c):
    """Venues under one key, shown in their most frequent spelling."""
    spelled = F.when(F.col("id") % 3 == 0, F.upper("venue")).when(F.col("id") % 3 == 1, F.concat("venue", F.lit("."))).otherwise(F.col("venue"))
    return reports.spellings(c.references().withColumn("venue", spelled))


@query("""r AS (SELECT citing_id, count(*) AS refs, count(DISTINCT cited_id) AS different FROM citations GROUP BY 1), f AS (SELECT work_id, count(*) AS files FROM file_links GROUP BY 1), l AS (SELECT cited_id, count(DISTINCT citing_id) AS citers FROM citations WHERE citing_id IN (SELECT id FROM live_works) GROUP BY 1)
SELECT w.id, coalesce(files, 0) AS file_count, coalesce(refs, 0) AS reference_count, coalesce(different, 0) AS local_reference_count, coalesce(citers, 0) AS local_citation_count FROM live_works w LEFT JOIN r ON citing_id = w.id LEFT JOIN f ON work_id = w.id LEFT JOIN l ON cited_id = w.id
ORDER BY local_citation_count DESC, file_count DESC, reference_count, w.id LIMIT 80""")
def listing_by_counts(c):
    """The library sorted by counts that belong to other tables."""
    from .operators import library

    w = c.live_works()
    counts = {
        "file_count": (c.file_links(), "work_id", F.count("*")),
        "reference_count": (c.citations(), "citing_id", F.count("*")),
        "local_reference_count": (c.citations(), "citing_id", F.countDistinct("cited_id")),
        "local_citation_count": (c.citations().join(w.select(F.col("id").alias("citing_id")), "citing_id", "left_semi"), "cited_id", F.countDistinct("citing_id")),
    }
    rows = library.counted(w.select("id"), counts)
    order = library.order("local_citation_count:desc,file_count:desc,reference_count", list(counts))
    return library.page(rows, order, 1, 80)


@query("""SELECT 'status' AS colour, coalesce(reading_status, '(none)') AS name, count(*) AS n FROM live_works GROUP BY 2 UNION ALL SELECT 'year', coalesce(CAST(year AS VARCHAR), '(none)'), count(*) FROM live_works GROUP BY 2 UNION ALL SELECT 'topic', coalesce(tag, '(none)'), count(*) FROM live_works LEFT JOIN tags ON work_id = id GROUP BY 2""")
def colour_groups(c):
    """How papers are coloured in a graph: by status, year or topic."""
    w = c.live_works()
    topics = w.select("id").join(c.tags(), F.col("id") == F.col("work_id"), "left").select("tag")
    parts = [("status", w.select("reading_status")), ("year", w.select(F.col("year").cast("string"))), ("topic", topics)]
    out = None
    for colour, values in parts:
        part = values.toDF("name").groupBy(F.coalesce("name", F.lit("(none)")).alias("name")).agg(F.count("*").alias("n")).select(F.lit(colour).alias("colour"), "name", "n")
        out = part if out is None else out.unionAll(part)
    return out


_BUCKETED = "CASE section WHEN 'A' THEN 'introduction' WHEN 'N' THEN 'methods and data' ELSE 'final results' END"


@query(f"""b AS (SELECT citing_id, cited_id, CASE WHEN contains({_BUCKETED}, 'method') THEN 'Methods' WHEN contains({_BUCKETED}, 'result') THEN 'Results' ELSE 'Background' END AS bucket FROM citations)
SELECT citing_id AS src, cited_id AS dst, count(*) FILTER (bucket = 'Background') AS background, count(*) FILTER (bucket = 'Methods') AS methods, count(*) FILTER (bucket = 'Results') AS results, CAST(sum(CASE bucket WHEN 'Methods' THEN 5 WHEN 'Results' THEN 4 ELSE 2 END) AS BIGINT) AS weight FROM b GROUP BY 1, 2""")
def reference_graph(c):
    """Each paper's references with how often and where it mentions them; where decides the weight."""
    label = F.when(F.col("section") == "A", "introduction").when(F.col("section") == "N", "methods and data").otherwise("final results")
    rows = c.citations().select(F.col("citing_id").alias("src"), F.col("cited_id").alias("dst"), sections.bucket(label).alias("bucket"))
    return graph.reference_weights(rows, {"Methods": 5, "Results": 4, "Background": 2})


@query("""SELECT id, title FROM texts WHERE title IS NOT NULL AND title <> '' AND EXISTS (SELECT 1 FROM sections s WHERE s.id = texts.id AND s.label = 'abstract')""")
def search_has_abstract(c):
    """`has:abstract` looks at the paper itself."""
    from .plans import dsl

    abstracts = c.sections().where("label = 'abstract'").groupBy("id").agg(F.min("text").alias("abstract"))
    return dsl.filtered(c.texts().join(abstracts, "id", "left").where("title <> ''"), dsl.parse("has:abstract")).select("id", "title")


@query("""SELECT id, doi FROM live_works WHERE doi ILIKE '10.1000/w12%'""")
def search_by_doi(c):
    """A DOI is brought to normal form before it is looked for."""
    from .plans import dsl

    return dsl.filtered(c.live_works(), dsl.parse("doi:HTTPS://doi.org/10.1000/W12")).select("id", "doi")


@query("""SELECT DISTINCT w.id, w.year FROM live_works w JOIN shelf_works s ON s.work_id = w.id JOIN shelves h USING (shelf_id) WHERE h.name ILIKE '%7%' OR h.shelf_id = 7""")
def search_shelf(c):
    """A shelf by a part of its name or by its id."""
    from .plans import dsl

    sides = {"shelf": c.shelf_works().join(c.shelves(), "shelf_id").select(F.col("work_id").alias("id"), "name", F.col("shelf_id").alias("key"))}
    return dsl.filtered(c.live_works(), dsl.parse("shelf:7"), sides).select("id", "year")


@query("""l AS (SELECT least(l_orderkey, l_partkey) AS a, greatest(l_orderkey, l_partkey) AS b FROM lineitem WHERE l_linenumber % 2 = 1) SELECT DISTINCT a AS work_id, b AS linked_id FROM l WHERE a <> b UNION SELECT DISTINCT b, a FROM l WHERE a <> b""")
def linked_works(c):
    """Links between papers hold in both directions."""
    pairs = c.table("lineitem").where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"))
    return linkage.symmetric(pairs)


@query()
def topic_hierarchy(c):
    """Which topic is most like which; tested against a plain version."""
    _, centres = textmine.text_clusters(c.texts(), 5, titles=c.texts().select("id", "title"))
    return textmine.hierarchy(centres)


@query("""SELECT event_type AS stage, count(*) AS n FROM (SELECT user_id, event_type FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT user_id, 'joined' FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT DISTINCT user_id FROM events WHERE event_type = 'view')) GROUP BY 1""", False)
def streamed_stages(c):
    """A stream worked through in stages: each batch is stored, then what it makes due is stored."""
    from .streaming import events as ev

    return ev.staged(c.spark, c.folder)


_THROTTLED = """WITH e AS (SELECT event_id, user_id, ts, epoch_us(ts) AS us, event_type = 'purchase' AS clears FROM events WHERE event_type IN ('error', 'purchase')),
s AS (SELECT *, coalesce(sum(CAST(clears AS INT)) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spell FROM e),
r AS (SELECT *, count(*) FILTER (NOT clears) OVER w AS n, min(us) FILTER (NOT clears) OVER w AS oldest, min(us) FILTER (clears) OVER (PARTITION BY user_id, spell) AS cleared FROM s
  WINDOW w AS (PARTITION BY user_id, spell ORDER BY us RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW)),
k AS (SELECT *, lead(us) OVER w AS last, lead(us, 2) OVER w AS next FROM r WHERE NOT clears WINDOW w AS (PARTITION BY user_id, spell ORDER BY us, event_id)),
o AS (SELECT user_id, us, 'failure' AS kind, event_id, n, n >= 2 AS locked, CASE WHEN n >= 2 THEN greatest(1, (oldest + 21600000000 - us) // 1000000) ELSE 0 END AS retry_after FROM r WHERE NOT clears
  UNION ALL SELECT user_id, us, 'unlocked', min(event_id), 0, false, 0 FROM r WHERE clears AND n >= 2 GROUP BY 1, 2
  UNION ALL SELECT user_id, us + 21600000000, 'unlocked', NULL, 1, false, 0 FROM k WHERE last < us + 21600000000 AND coalesce(next >= us + 21600000000, true) AND coalesce(cleared >= us + 21600000000, true))
SELECT user_id, make_timestamp(us) AS ts, kind, event_id, n, locked, CAST(retry_after AS BIGINT) AS retry_after FROM o"""


@query(_THROTTLED, False)
def throttled_users(c):
    """Failures in the six hours before each, locks from two on, and their ends; a purchase forgets them."""
    from .streaming import throttle

    return throttle.throttled(c.table("events"), 2, 6 * 60, clears="purchase").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(_THROTTLED + " WHERE us < (SELECT epoch_ms(max(ts)) * 1000 FROM events) - 600000000", False)
def streamed_throttle(c):
    """The same from a stream with timers, as far as its watermark has come: ten minutes before the newest event."""
    from .streaming import events as ev
    from .streaming import throttle

    rows = throttle.throttled(ev.stream(c.spark, c.folder), 2, 6 * 60, clears="purchase")
    return ev.drained(rows, "throttle", "append", ev.ROCKS).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""WITH a AS (SELECT event_id, user_id, ts, date_trunc('minute', ts) AS m, row_number() OVER (PARTITION BY date_trunc('minute', ts), user_id ORDER BY ts, event_id) > 1 AS own FROM events),
b AS (SELECT *, sum(CASE WHEN own THEN 0 ELSE 1 END) OVER (PARTITION BY m ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS passed FROM a)
SELECT event_id, user_id, ts, CASE WHEN own THEN 'client' ELSE 'global' END AS scope, CAST(greatest(1, 60 - second(ts)) AS BIGINT) AS retry_after FROM b WHERE own OR passed > 1""", False)
def limited_requests(c):
    """Requests beyond one of a user, or of all, in a minute, and when to try again."""
    from .streaming import throttle

    return throttle.limited(c.table("events"), 1, 1)


@query("""SELECT id, coalesce(r.title, w.title) AS title, coalesce(r.year, w.year) AS year, coalesce(r.venue, w.venue) AS venue, w.reading_status FROM (SELECT id, title, year, venue, reading_status FROM live_works) w FULL JOIN (SELECT id, title, year, venue FROM refs) r USING (id)""")
def keyed_writes(c):
    """Works as a table with a key, after a second write has filled in and added what the references say."""
    import uuid

    from .session import checkpoint_folder
    from .sources import keyed

    folder = f"{checkpoint_folder(c.spark)}/keyed-{uuid.uuid4().hex}"
    keyed.create(c.live_works().select("id", "title", "year", "venue", "reading_status"), folder, ["id"])
    keyed.write(c.references().select("id", "title", "year", "venue"), folder, "fill")
    return keyed.read(c.spark, folder)


_PLACES = """vs AS (SELECT * FROM shelves WHERE access_level IN ('open', 'visible') OR shelf_id IN (5, 8)), rk AS (SELECT r_regionkey AS rack_id, r_name AS name, r_regionkey % 2 AS row_id FROM region WHERE r_regionkey <> 3),
rw AS (SELECT DISTINCT row_id, 'Row ' || row_id AS name FROM rk), pl AS (SELECT work_id AS id, 'shelf' AS kind, shelf_id AS key, name FROM shelf_works JOIN vs USING (shelf_id)
  UNION SELECT work_id, 'rack', rk.rack_id, rk.name FROM shelf_works JOIN vs USING (shelf_id) JOIN rk USING (rack_id) UNION SELECT work_id, 'row', row_id, rw.name FROM shelf_works JOIN vs USING (shelf_id) JOIN rk USING (rack_id) JOIN rw USING (row_id))"""


def _places(c):
    """Where papers are, for a reader who does not see private shelves but two, nor one of the racks."""
    from .operators import library

    shelves = c.shelves().where("access_level IN ('open', 'visible') OR shelf_id IN (5, 8)")
    racks = c.racks().where("rack_id <> 3").withColumn("row_id", F.col("rack_id") % 2)
    rows = racks.select("row_id", F.concat(F.lit("Row "), F.col("row_id").cast("string")).alias("name")).distinct()
    return library.containers(c.shelf_works(), shelves, racks, rows)


@query(f"""{_PLACES} SELECT 'rack' AS term, id FROM live_works WHERE id IN (SELECT id FROM pl WHERE kind = 'rack' AND (name ILIKE '%a%' OR CAST(key AS VARCHAR) = 'a')) UNION ALL SELECT 'row', id FROM live_works WHERE id IN (SELECT id FROM pl WHERE kind = 'row' AND (name ILIKE '%1%' OR CAST(key AS VARCHAR) = '1'))
UNION ALL SELECT 'shelf', id FROM live_works WHERE id IN (SELECT id FROM pl WHERE kind = 'shelf' AND (name ILIKE '%7%' OR CAST(key AS VARCHAR) = '7')) UNION ALL SELECT 'both', id FROM live_works WHERE id IN (SELECT id FROM pl WHERE kind = 'rack' AND name ILIKE '%asia%') AND id IN (SELECT id FROM pl WHERE kind = 'row' AND name ILIKE '%row%')""")
def search_places(c):
    """`rack:`, `row:` and `shelf:` by name or id, only through what the reader sees."""
    from .plans import dsl

    places = cut(_places(c))
    sides = {kind: places.where(F.col("kind") == kind) for kind in ("shelf", "rack", "row")}
    out = None
    for term, search in (("rack", "rack:a"), ("row", "row:1"), ("shelf", "shelf:7"), ("both", "rack:asia row:row")):
        part = dsl.filtered(c.live_works(), dsl.parse(search), sides).select(F.lit(term).alias("term"), "id")
        out = part if out is None else out.unionAll(part)
    return out


#: Each sort key once, in one direction or the other.
_ORDERS = ("title:desc", "year:asc", "venue:desc", "added_at:asc", "updated_at:desc", "reading_status:asc", "doi:desc", "file_count:desc", "reference_count:asc", "citation_count:desc", "local_reference_count:desc", "local_citation_count:asc", "shelves:desc", "racks:asc", "rows:desc")
_ORDERED = " UNION ALL ".join(f"""SELECT * FROM (SELECT '{k}' AS spec, id, row_number() OVER (ORDER BY "{k.split(":")[0]}" {k.split(":")[1]} NULLS LAST, id) AS place FROM st) WHERE place <= 10""" for k in _ORDERS)


@query(f"""{_PLACES}, st AS (SELECT w.id, title, year, venue, updated_at, CAST(updated_at AS DATE) - CAST(w.id % 30 AS INTEGER) AS added_at, reading_status, doi, citation_count, coalesce(f.n, 0) AS file_count, coalesce(r.n, 0) AS reference_count, coalesce(l.n, 0) AS local_reference_count, coalesce(b.n, 0) AS local_citation_count, shelves, racks, "rows"
FROM live_works w LEFT JOIN (SELECT work_id, count(*) AS n FROM file_links GROUP BY 1) f ON f.work_id = w.id LEFT JOIN (SELECT citing_id, count(*) AS n FROM citations GROUP BY 1) r ON r.citing_id = w.id
LEFT JOIN (SELECT citing_id, count(DISTINCT cited_id) AS n FROM citations WHERE cited_id IN (SELECT id FROM live_works) GROUP BY 1) l ON l.citing_id = w.id LEFT JOIN (SELECT cited_id, count(DISTINCT citing_id) AS n FROM citations WHERE citing_id IN (SELECT id FROM live_works) GROUP BY 1) b ON b.cited_id = w.id
LEFT JOIN (SELECT id, min(name) FILTER (kind = 'shelf') AS shelves, min(name) FILTER (kind = 'rack') AS racks, min(name) FILTER (kind = 'row') AS "rows" FROM pl GROUP BY 1) p ON p.id = w.id) {_ORDERED}""")
def sorted_pages(c):
    """The first page of the library by each of the fifteen sort keys."""
    from pyspark.sql import Window

    from .operators import library

    works = c.live_works().withColumn("added_at", F.date_sub(F.col("updated_at").cast("date"), (F.col("id") % 30).cast("int")))
    rows = cut(library.sortable(works, c.citations(), c.file_links(), _places(c)).select("id", *library.SORT_KEYS))
    out = None
    for spec in _ORDERS:
        order = library.order(spec, list(library.SORT_KEYS))
        # The page comes first, so the numbering has ten rows.
        part = rows.orderBy(*order).limit(10).select(F.lit(spec).alias("spec"), "id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("place"))
        out = part if out is None else out.unionAll(part)
    return out


@query(f"""bw AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest({_TOKENS.format("coalesce(body, '')")}) AS t FROM texts) GROUP BY 1, 2), bags AS (SELECT * FROM (SELECT id, {_HASH} FROM bw GROUP BY 1, 2) WHERE x <> 0),
lw AS (SELECT label, t, count(*) AS n FROM (SELECT label, unnest({_TOKENS.format("body")}) AS t FROM (SELECT item_id AS label, text AS body FROM benchmark)) GROUP BY 1, 2), labels AS (SELECT * FROM (SELECT label, {_HASH} FROM lw GROUP BY 1, 2) WHERE x <> 0),
nb AS (SELECT id, sqrt(sum(x * x)) AS norm FROM bags GROUP BY 1), nl AS (SELECT label, sqrt(sum(x * x)) AS norm FROM labels GROUP BY 1),
sc AS (SELECT b.id, l.label, round(sum(b.x * l.x) / (any_value(nb.norm) * any_value(nl.norm)), 6) AS score FROM bags b JOIN labels l USING (bucket) JOIN nb ON nb.id = b.id JOIN nl ON nl.label = l.label GROUP BY 1, 2),
ev AS (SELECT nb.id, nl.label, greatest(coalesce(score, 0), 0) AS score FROM nb CROSS JOIN nl LEFT JOIN sc ON sc.id = nb.id AND sc.label = nl.label),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS place FROM ev) SELECT id, label, score, place FROM r WHERE place <= 60""")
def prefiltered_candidates(c):
    """The sixty candidates, here the benchmark's items, that are most like each paper's text."""
    candidates = retrieval.bag_vectors(c.table("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("body"))).withColumnRenamed("id", "label")
    return retrieval.prefiltered(_bags(c), candidates, 60).select("id", "label", "score", "place")


_HEADINGS = ("Abstract", "1 Introduction", "Related methods", "2 Methods and Materials", "3 RESULTS", "State of the art", "Ablation", "Thanks")
_KIND_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(h), '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in sections.HEADINGS.items()) + " ELSE 'other' END"


@query(f"""m AS (SELECT citing_id AS src, cited_id AS dst, {list(_HEADINGS)}[(position + cited_id) % 9 + 1] AS h FROM citations), b AS (SELECT src, dst, {_KIND_SQL} AS bucket FROM m)
SELECT src, dst, {", ".join(f"count(*) FILTER (bucket = '{k}') AS {k}" for k in sorted(sections.HEADING_WEIGHTS))}, CAST(sum(CASE bucket {" ".join(f"WHEN '{k}' THEN {w}" for k, w in sections.HEADING_WEIGHTS.items())} END) AS BIGINT) AS weight FROM b GROUP BY 1, 2""")
def weighted_mentions(c):
    """Each paper's references by the kinds of section that mention them, all six, with their usual weights; some mentions have no heading."""
    heading = F.get(F.array(*map(F.lit, _HEADINGS)), ((F.col("position") + F.col("cited_id")) % 9).cast("int"))
    rows = c.citations().select(F.col("citing_id").alias("src"), F.col("cited_id").alias("dst"), sections.heading_kind(heading).alias("bucket"))
    return graph.reference_weights(rows, sections.HEADING_WEIGHTS)


@query("""k AS (SELECT user_id AS id, CASE event_type WHEN 'click' THEN 'crossref' WHEN 'view' THEN 'semanticscholar' WHEN 'purchase' THEN 'openalex' ELSE event_type END AS source, CAST(floor(value) AS BIGINT) - 20 AS n, ts FROM events),
l AS (SELECT id, source, n, row_number() OVER (PARTITION BY id, source ORDER BY ts DESC, n DESC) AS age FROM k WHERE n >= 0 AND source IN ('openalex', 'semanticscholar', 'crossref')),
f AS (SELECT id, n, source, row_number() OVER (PARTITION BY id ORDER BY CASE source WHEN 'openalex' THEN 1 WHEN 'semanticscholar' THEN 2 ELSE 3 END) AS place FROM l WHERE age = 1)
SELECT id, coalesce(n, CAST(floor(citation_count) AS BIGINT)) AS citation_count, coalesce(source, CASE WHEN citation_count IS NOT NULL THEN 'import' END) AS citation_count_source FROM live_works LEFT JOIN (SELECT * FROM f WHERE place = 1) USING (id)""")
def recounted_works(c):
    """Citation counts of papers after a fetch from several sources: the first source in order that has one."""
    source = F.when(F.col("event_type") == "click", "crossref").when(F.col("event_type") == "view", "semanticscholar").when(F.col("event_type") == "purchase", "openalex").otherwise(F.col("event_type"))
    counts = c.table("events").select(F.col("user_id").alias("id"), source.alias("source"), (F.floor("value").cast("long") - 20).alias("n"), F.col("ts").alias("at"))
    works = c.live_works().select("id", F.floor("citation_count").cast("long").alias("citation_count"), F.when(F.col("citation_count").isNotNull(), "import").alias("citation_count_source"))
    return linkage.recounted(works, counts)


_RIS = "'TY  - JOUR' || chr(10) || 'TI  - ' || title || chr(10) || 'JO  - ' || venue || chr(10) || 'PY  - ' || year || coalesce(chr(10) || 'DO  - ' || doi, '') || chr(10) || 'ER  - '"


@query(f"""p AS (SELECT work_id, CASE WHEN work_id % 3 <> 0 THEN work_id % 100 END AS position FROM shelf_works WHERE shelf_id = 5)
SELECT 'library' AS scope, row_number() OVER (ORDER BY year, title, id) - 1 AS place, id, {_RIS} AS entry FROM live_works
UNION ALL SELECT 'shelf', row_number() OVER (ORDER BY position NULLS LAST, year, title, id) - 1, id, {_RIS} FROM live_works JOIN p ON work_id = id
UNION ALL SELECT 'rack', row_number() OVER (ORDER BY year, title, id) - 1, id, {_RIS} FROM live_works WHERE id IN (SELECT work_id FROM shelf_works JOIN shelves USING (shelf_id) WHERE rack_id = 2)""")
def exported_scopes(c):
    """The library, a shelf in its own order and a rack as RIS, in the order of their lists."""
    from .sources import export

    placed = c.shelf_works().withColumn("position", F.when(F.col("work_id") % 3 != 0, F.col("work_id") % 100))
    out = None
    for scope, which in (("library", None), ("shelf", 5), ("rack", 2)):
        part = export.exported(c.live_works(), "ris", scope, which, placed, c.shelves()).select(F.lit(scope).alias("scope"), "place", "id", "entry")
        out = part if out is None else out.unionAll(part)
    return out
