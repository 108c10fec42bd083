"""Duplicates, reference matching, consolidation and merging."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import overlap
from ..functions.similarity import block_ratio, title_similarity, value_similarity
from ..functions.text import arxiv_base, arxiv_from_doi, arxiv_version, first_word, normalize_doi, normalize_title, relaxed_word, similarity_text
from . import fuzzy

#: Rank of the states of a reference, best last.
STATES = ("unresolved", "external", "likely_match", "local_match", "rejected_match", "confirmed_match")


def same_key(rows: DataFrame, key: str, kind: str, score: float = 1.0) -> DataFrame:
    """(kind, a, b, score): each row with the least id that has the same key.

    A group of k rows gives k - 1 links to its first row, which say all that
    its k(k-1)/2 pairs would, and never meets in one task.
    """
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("a"))
    return rows.join(first, key).where("id <> a").select(F.lit(kind).alias("kind"), "a", F.col("id").alias("b"), F.lit(score).alias("score"))


def fuzzy_titles(rows: DataFrame, least: float = 92.0) -> DataFrame:
    """(a, b, score) of papers with similar titles where one starts with the other's first word, in whole or as a part of a word, and that agree on the year if both have one.

    Equal titles are one entry, so copies do not multiply pairs; titles under one
    first word meet only where they share rare parts, as far as `least` allows.
    """
    named = rows.withColumn("t", normalize_title(F.col("title"))).where("t <> ''")
    kinds = named.groupBy("t", "year").agg(F.min("id").alias("id")).withColumn("word", first_word(F.col("t")))
    # Of two first words one is a prefix of the other, so a title meets others under each prefix of its first word that is a first word too.
    words = kinds.select("word").distinct()
    cuts = F.transform(F.sequence(F.lit(0), F.length("word")), lambda n: F.substring(F.col("word"), F.lit(1), n))
    prefixes = words.select("word", F.explode(cuts).alias("block")).join(words.select(F.col("word").alias("block")), "block")
    pairs = title_pairs(kinds, prefixes, least)
    a, b = (kinds.select(F.col("id").alias(x), F.col("t").alias(f"t_{x}")) for x in ("a", "b"))
    scored = pairs.join(a, "a").join(b, "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), title_similarity("t_a", "t_b").alias("score"))
    return scored.where(F.col("score") >= least)


def title_pairs(kinds: DataFrame, prefixes: DataFrame, least: float) -> DataFrame:
    """(a, b): the pairs of titles (id, t, year, word) that may score `least`, of blocks (word, block) in which each word is met."""
    # Half of the last digit: scores are rounded to one decimal.
    parts = fuzzy.with_tokens(kinds, least - 0.05)
    sized = F.length("t").alias("size"), (F.size(F.filter(F.split("t", " "), lambda w: w != "")) >= fuzzy.WORDY).alias("wordy")
    a = parts.select(F.col("word").alias("block"), F.col("id").alias("a"), F.col("year").alias("y_a"), sized[0].alias("n_a"), sized[1].alias("w_a"), "on_left")
    b = parts.join(prefixes, "word").select("block", (F.col("word") == F.col("block")).alias("whole"), F.col("id").alias("b"), F.col("year").alias("y_b"), sized[0].alias("n_b"), sized[1].alias("w_b"), "on_right")
    # Lengths bound the ratio, unless sets of words count.
    close = 200.0 * F.least("n_a", "n_b") / (F.col("n_a") + F.col("n_b")) >= least - 0.05
    fits = (~F.col("whole") | (F.col("a") < F.col("b"))) & (F.col("y_a").isNull() | F.col("y_b").isNull() | (F.col("y_a") == F.col("y_b"))) & (close | (F.col("w_a") & F.col("w_b")))
    return fuzzy.candidates(a, b, fits)


def _cited(rows: DataFrame) -> DataFrame:
    """(id, t, year, doi, arxiv, authors) with identifiers in normal form; arxiv and authors may be missing."""
    doi = F.nullif(normalize_doi(F.col("doi")), F.lit(""))
    none = F.lit(None).cast("string")
    arxiv = F.coalesce(F.nullif(arxiv_base(F.col("arxiv")), F.lit("")) if "arxiv" in rows.columns else none, arxiv_from_doi(F.col("doi")))
    authors = F.filter("authors", lambda n: F.trim(n) != "") if "authors" in rows.columns else F.lit(None).cast("array<string>")
    return rows.select("id", normalize_title(F.col("title")).alias("t"), "year", doi.alias("doi"), arxiv.alias("arxiv"), authors.alias("authors"))


def _same_entry(a: str, b: str) -> Column:
    return reduce(and_, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ("t", "year", "doi", "arxiv", "authors")])


def matched(references: DataFrame, works: DataFrame, least: float = 90.0, years: int = 1, shared: float = 0.5) -> DataFrame:
    """(ref_id, work_id, score, via): by identifier, else by title within `years`; the best, then the least id.

    Both sides have id, title, year and doi, and may have arxiv and a list of
    authors.  Titles meet by their first word that is no leading stop word.  A
    pair is out if both have an identifier of a kind and these differ (DOIs that
    spell arXiv identifiers count as those), or if the work has less than `shared` of
    the reference's authors; what either side lacks rules nothing out.
    """
    cited, held = _cited(references), _cited(works)
    keys = F.explode(F.array_compact(F.array(F.concat(F.lit("doi:"), "doi"), F.concat(F.lit("arxiv:"), "arxiv")))).alias("key")
    by_key = held.select("id", keys).groupBy("key").agg(F.min("id").alias("work_id"))
    by_id = cited.select("id", keys).join(by_key, "key").groupBy(F.col("id").alias("ref_id")).agg(F.min("work_id").alias("work_id"))
    by_id = by_id.select("ref_id", "work_id", F.lit(100.0).alias("score"), F.lit("identifier").alias("via"))
    rest = cited.join(by_id.select(F.col("ref_id").alias("id")), "id", "left_anti").where("t <> ''")
    # Rows that agree on all that is compared are one entry on either side.
    entry = ("t", "year", "doi", "arxiv", "authors")
    r = rest.select(*entry).distinct().withColumn("block", relaxed_word(F.col("t"))).alias("r")
    w = held.where("t <> ''").groupBy(*entry).agg(F.min("id").alias("work_id")).withColumn("block", relaxed_word(F.col("t"))).alias("w")
    met = r.join(w, "block").where(f"r.year is null or w.year is null or abs(r.year - w.year) <= {int(years)}")
    other_doi = (F.col("r.doi") != F.col("w.doi")) & arxiv_from_doi(F.col("r.doi")).isNull() & arxiv_from_doi(F.col("w.doi")).isNull()
    met = met.where(~F.coalesce(other_doi, F.lit(False)) & ~F.coalesce(F.col("r.arxiv") != F.col("w.arxiv"), F.lit(False)))
    scored = met.select(*[F.col(f"r.{c}") for c in entry], F.col("w.authors").alias("by"), "work_id", title_similarity("r.t", "w.t").alias("score")).where(F.col("score") >= least)
    if "authors" in references.columns and "authors" in works.columns:
        unlisted = (F.coalesce(F.size("authors"), F.lit(0)) <= 0) | (F.coalesce(F.size("by"), F.lit(0)) <= 0)
        scored = scored.where(unlisted | (overlap("authors", "by") >= shared))
    best = scored.groupBy(*entry).agg(F.max_by(F.struct("work_id", "score"), F.struct("score", (-F.col("work_id")).alias("i"))).alias("b"))
    best = rest.alias("r").join(best.alias("k"), _same_entry("r", "k")).select(F.col("r.id").alias("ref_id"), "b.*", F.lit("title").alias("via"))
    return by_id.unionByName(best)


def consolidated(references: DataFrame) -> DataFrame:
    """References of one key as one: the oldest row lives on, with the best state of all and blanks filled.

    A key with both confirmed and rejected rows is a contradiction and is parked.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("state"))
    age = F.struct(F.col("created_at").isNull().alias("undated"), "created_at", "id")
    by = references.where("key is not null").groupBy("key").agg(
        F.min_by("id", age).alias("survivor"),
        F.max_by("state", F.struct(rank.alias("r"), (-F.col("id")).alias("i"))).alias("state"),
        F.min_by("title", F.when(F.col("title").isNotNull(), age)).alias("title"),
        F.count("*").alias("members"),
        (F.max(F.col("state") == "confirmed_match") & F.max(F.col("state") == "rejected_match")).alias("contradiction"),
    )
    return by


def remapped(edges: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """edges with `column` sent to survivors by (old, new), each edge once."""
    to = mapping.select(F.col("old").alias(column), F.col("new").alias("_new"))
    return edges.join(to, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").distinct()


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Candidates (kind, a, b, score, status) after new ones (kind, a, b, score) have come in.

    Pairs are unordered; the higher score stays; the status of known pairs stays.
    """

    def ordered(df: DataFrame) -> DataFrame:
        return df.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})

    n = ordered(new).groupBy("kind", "a", "b").agg(F.max("score").alias("new_score"))
    return ordered(old).join(n, ["kind", "a", "b"], "full").select("kind", "a", "b", F.greatest("score", "new_score").alias("score"), F.coalesce("status", F.lit("open")).alias("status"))


def merge_fill(sources: DataFrame, fields: list[str], order: str) -> DataFrame:
    """For each id the first non-empty value of each field, by the rank of its source."""
    return sources.groupBy("id").agg(*[F.min_by(f, F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), F.col(order))).alias(f) for f in fields])


def newest_kept(rows: DataFrame, by: str, at: str, keep: int) -> DataFrame:
    """The newest `keep` rows of each group."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), F.desc("id")))
    return rows.withColumn("place", place).where(F.col("place") <= keep)


def merged_links(links: DataFrame, mapping: DataFrame, value: str) -> DataFrame:
    """Links (work_id, value) after papers (source) have been merged into others (target), with what happened to each.

    A link moves unless the target has one like it; then it stays on the
    source.  Of several sources with the same link the least one's moves.  The
    rows are the journal by which `unmerged` takes the merge back.
    """
    own = links.select("work_id", value).distinct()
    to = mapping.select(F.col("source").alias("work_id"), "target")
    named = own.join(to, "work_id", "left")
    held = own.select(F.col("work_id").alias("target"), F.col(value), F.lit(True).alias("_held"))
    first = named.where("target is not null").groupBy("target", value).agg(F.min("work_id").alias("_first"))
    all_ = named.join(held, ["target", value], "left").join(first, ["target", value], "left")
    moves = F.col("target").isNotNull() & F.col("_held").isNull() & (F.col("work_id") == F.col("_first"))
    return all_.select(F.col("work_id").alias("was"), F.when(moves, F.col("target")).otherwise(F.col("work_id")).alias("work_id"), value, F.when(moves, "moved").when(F.col("target").isNotNull(), "kept").otherwise("untouched").alias("action"))


def unmerged(links: DataFrame, journal: DataFrame, value: str) -> DataFrame:
    """Merged links (work_id, value) as they were before: what the journal says has moved goes back, links made since stay."""
    moved = journal.where("action = 'moved'").select(F.col("work_id"), value, "was")
    return links.join(moved, ["work_id", value], "left").select(F.coalesce("was", "work_id").alias("work_id"), value)


def staged(items: DataFrame, library: DataFrame) -> DataFrame:
    """Staged items (item_id, doi, title) with their fate: a DOI that the library or an earlier item has is refused, a known title collides."""
    first = F.row_number().over(Window.partitionBy("doi").orderBy("item_id"))
    dois = library.where("doi is not null").select(F.col("doi").alias("_doi")).distinct()
    titles = library.where("title is not null").select(F.col("title").alias("_title")).distinct()
    met = items.withColumn("_n", F.when(F.col("doi").isNotNull(), first)).join(dois, F.col("doi") == F.col("_doi"), "left").join(titles, F.col("title") == F.col("_title"), "left")
    fate = F.when(F.col("_doi").isNotNull(), "in_library").when(F.col("_n") > 1, "in_batch").when(F.col("_title").isNotNull(), "same_title").otherwise("accept")
    return met.select("item_id", fate.alias("fate"))


def same_arxiv(works: DataFrame) -> DataFrame:
    """(kind, a, b, score): each paper with the first of its preprint; 0.99 where the versions differ."""
    rows = works.where("arxiv is not null").select("id", arxiv_base(F.col("arxiv")).alias("base"), arxiv_version(F.col("arxiv")).alias("version"))
    first = rows.groupBy("base").agg(F.min("id").alias("a"), F.min_by(F.struct("version"), "id").alias("v"))
    score = F.when(F.col("version").eqNullSafe(F.col("v.version")), 1.0).otherwise(0.99)
    return rows.join(first, "base").where("id <> a").select(F.lit("same_arxiv").alias("kind"), "a", F.col("id").alias("b"), score.alias("score"))


#: Words that tell proceedings from single papers.
VOLUME_WORDS = ("proceedings", "table of contents", "contents", "session ", "paper ")


def bundles(files: DataFrame, opening: str = "abstract", closing: str = "references", words: tuple[str, ...] = VOLUME_WORDS) -> DataFrame:
    """(id, score, reason) of files (id, preview, pages) that look like several papers: sections that repeat, or 40 pages with words of proceedings."""
    text = F.lower(F.coalesce("preview", F.lit("")))
    many = F.greatest(F.regexp_count(text, F.lit(opening)), F.regexp_count(text, F.lit(closing))) >= 2
    marks = sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
    volume = (F.coalesce("pages", F.lit(0)) >= 40) & (marks >= 2)
    found = files.select("id", many.alias("many"), volume.alias("volume")).where("many or volume")
    return found.select("id", F.when(F.col("many"), 0.78).otherwise(0.68).alias("score"), F.when(F.col("many"), "multiple_section_markers").otherwise("proceedings_like_preview").alias("reason"))


def previewed(works: DataFrame, shadows: DataFrame, into: str, fields: list[str]) -> DataFrame:
    """Papers as they would be after a merge: blanks filled from the other one, with a flag where both differ."""
    s = shadows.select(F.col(into).alias("id"), *[F.col(f).alias(f"_{f}") for f in fields])
    met = works.join(s, "id")
    return met.select("id", *[F.coalesce(f, f"_{f}").alias(f) for f in fields], *[F.coalesce(F.col(f) != F.col(f"_{f}"), F.lit(False)).alias(f"{f}_differs") for f in fields])


def backfilled(works: DataFrame) -> DataFrame:
    """(id, doi, filled): empty DOIs filled from `known` unless they are locked."""
    own = F.nullif(F.trim("doi"), F.lit(""))
    new = F.when(~F.col("locked"), normalize_doi(F.col("known")))
    return works.select("id", F.coalesce(own, new).alias("doi"), (own.isNull() & new.isNotNull()).alias("filled"))


def shelved(works: DataFrame, shelf_works: DataFrame, default: int) -> DataFrame:
    """Links of papers to shelves with the default shelf for papers that have none."""
    loose = works.join(shelf_works.select(F.col("work_id").alias("id")), "id", "left_anti").select(F.col("id").alias("work_id"), F.lit(default).alias("shelf_id"))
    return shelf_works.select("work_id", "shelf_id").unionAll(loose)


def described(pairs: DataFrame, works: DataFrame) -> DataFrame:
    """(a, b, label, suggested): both titles, and the newer paper, a if they are alike."""
    x, y = (works.select(F.col("id").alias(n), F.col("title").alias(f"t_{n}"), F.col("year").alias(f"y_{n}")) for n in "ab")
    met = pairs.join(x, "a").join(y, "b", "left")
    return met.select("a", "b", F.concat("t_a", F.lit(" | "), F.coalesce("t_b", F.lit("(gone)"))).alias("label"), F.when(F.col("y_b") > F.col("y_a"), F.col("b")).otherwise(F.col("a")).alias("suggested"))


def replaced(old: DataFrame, new: DataFrame, works: DataFrame) -> DataFrame:
    """Citing papers (id, work_id, title) after some works have been fetched again.

    The lists of those works are replaced, so what is in none any more goes; a
    paper that comes up again keeps its id and takes the new title and work.
    held tells whether the library has it.
    """
    again = new.select("work_id").distinct().withColumn("_again", F.lit(True))
    kept = old.join(again, "work_id", "left").join(new.select("id", F.lit(True).alias("_new")), "id", "left").where("_again is null or _new")
    both = kept.select("id", F.col("work_id").alias("_w"), F.col("title").alias("_t")).join(new, "id", "full")
    rows = both.select("id", F.coalesce("work_id", "_w").alias("work_id"), F.coalesce("title", "_t").alias("title"))
    return rows.join(works.select("id", F.lit(True).alias("held")), "id", "left").select("id", "work_id", "title", F.coalesce("held", F.lit(False)).alias("held"))


def enriched(values: DataFrame, locks: DataFrame, fields: list[str]) -> DataFrame:
    """A column for each field: of the latest value of each source (id, field, rank, value, at) the first by rank; locked fields (id, field) are left empty."""
    latest = values.groupBy("id", "field", "rank").agg(F.max_by("value", "at").alias("value"))
    first = latest.groupBy("id", "field").agg(F.min_by("value", "rank").alias("value"))
    open_ = first.join(locks.withColumn("_locked", F.lit(True)), ["id", "field"], "left").select("id", "field", F.when(F.col("_locked").isNull(), F.col("value")).alias("value"))
    return open_.groupBy("id").pivot("field", fields).agg(F.first("value"))


#: Sources of citation counts, the most trusted first.
COUNT_SOURCES = ("openalex", "semanticscholar", "crossref")


def recounted(works: DataFrame, counts: DataFrame, sources: tuple[str, ...] = COUNT_SOURCES) -> DataFrame:
    """works (id, citation_count, citation_count_source, ...) with the counts (id, source, n, at) that a fetch has brought.

    Of each source the newest row counts (ties: the larger number), and of
    those with a number that is not negative the first source in order; it
    takes the place of what was known.  Papers without one, and other sources, change nothing.
    """
    newest = counts.where(F.col("source").isin(*sources) & (F.col("n") >= 0)).groupBy("id", "source").agg(F.max(F.struct("at", "n"))["n"].alias("n"))
    rank = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    first = newest.groupBy("id").agg(F.min(F.struct(rank.alias("rank"), "n", "source")).alias("_found"))
    found = works.join(first, "id", "left")
    return found.withColumns({"citation_count": F.coalesce(F.col("_found.n"), "citation_count"), "citation_count_source": F.coalesce("_found.source", "citation_count_source")}).drop("_found")


def disagreement(assertions: DataFrame) -> DataFrame:
    """(entity_id, field_name, match): of fields with several values, how much the two least alike have in common, in per cent."""
    values = assertions.where("value is not null").select("entity_id", "field_name", "value").distinct()
    x, y = values.withColumnRenamed("value", "x"), values.withColumnRenamed("value", "y")
    pairs = x.join(y, ["entity_id", "field_name"]).where("x < y")
    return pairs.withColumn("score", value_similarity(similarity_text(F.col("x")), similarity_text(F.col("y")))).groupBy("entity_id", "field_name").agg(F.min("score").alias("match"))


def _candidate_score(title: Column) -> Column:
    """Six tenths are the titles, two the years (half if one is unknown, 0.6 for neighbours), two the share of wanted last names; free copies add 0.05, up to 1."""
    last = lambda names: F.array_distinct(F.transform(F.filter(names, lambda n: F.trim(n) != ""), lambda n: F.lower(F.element_at(F.split(F.trim(n), r"\s+"), -1))))
    apart = F.abs(F.col("year") - F.col("wanted_year"))
    year = F.when(apart.isNull(), 0.5).when(apart == 0, 1.0).when(apart == 1, 0.6).otherwise(0.0)
    wanted = last(F.col("wanted_authors"))
    author = F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, last(F.col("authors")))) / F.size(wanted)).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), 0.6 * title + 0.2 * year + 0.2 * author + F.when(F.col("open"), 0.05).otherwise(0.0)), 4)


def ranked_candidates(candidates: DataFrame, k: int) -> DataFrame:
    """The k best candidates (query_id, cand_id, title, year, authors, open, and wanted_title, wanted_year, wanted_authors) of each query; see `_candidate_score`."""
    title = block_ratio(normalize_title(F.col("wanted_title")), normalize_title(F.col("title")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "cand_id"))
    scored = candidates.withColumn("_title", title).withColumn("score", _candidate_score(F.col("_title")))
    return scored.withColumn("place", place).where(F.col("place") <= k).select("query_id", "cand_id", "score", "place")


#: Tasks among which the titles of one block are dealt out.
DEALT = 16


def ranked_in_blocks(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """`ranked_candidates` of all queries (block, query_id, wanted_title, wanted_year, wanted_authors) with the candidates (block, cand_id, title, year, authors, open) of their block.

    Rows that agree on all that is compared are one kind, and titles are
    compared once, so copies multiply no pairs.  The k best candidates are of
    the k best kinds by score and least id, and of each kind among its k least ids.
    """
    wanted, given = ("block", "wanted_title", "wanted_year", "wanted_authors"), ("block", "title", "year", "authors", "open")
    asked = queries.where("block is not null").select(*wanted, "query_id").withColumns({"_q": normalize_title(F.col("wanted_title")), "_kind": F.sha2(F.to_json(F.struct(*wanted)), 256)})
    kinds = asked.groupBy("_kind").agg(*[F.first(c).alias(c) for c in (*wanted, "_q")])
    # A window's limit holds in each task before the shuffle, so a kind of any size sends k ids a task.
    least = F.row_number().over(Window.partitionBy(*given).orderBy("cand_id"))
    few = candidates.where("block is not null").select(*given, "cand_id").withColumn("_n", least).where(F.col("_n") <= k)
    held = few.groupBy(*given).agg(F.array_sort(F.collect_list("cand_id")).alias("_ids")).withColumn("_t", normalize_title(F.col("title")))
    q = kinds.select("block", "_q").distinct().withColumn("_part", F.pmod(F.xxhash64("_q"), F.lit(DEALT)))
    t = held.select("block", "_t").distinct().withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)).cast("array<bigint>")))
    alike = q.join(t, ["block", "_part"]).select("block", "_q", "_t", block_ratio("_q", "_t").alias("_title"))
    met = kinds.alias("q").join(alike.alias("s"), (F.col("q.block") == F.col("s.block")) & F.col("q._q").eqNullSafe(F.col("s._q"))).select("_kind", *[f"q.{c}" for c in wanted[1:]], F.col("q.block").alias("block"), "_t", "_title")
    pairs = met.alias("m").join(held.alias("h"), (F.col("m.block") == F.col("h.block")) & F.col("m._t").eqNullSafe(F.col("h._t")))
    scored = pairs.select("_kind", "_ids", _candidate_score(F.col("_title")).alias("score"))
    first = F.row_number().over(Window.partitionBy("_kind").orderBy(F.desc("score"), F.col("_ids")[0]))
    best = scored.withColumn("_n", first).where(F.col("_n") <= k).select("_kind", "score", F.explode("_ids").alias("cand_id"))
    found = asked.select("query_id", "_kind").join(best, "_kind")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "cand_id"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("query_id", "cand_id", "score", "place")


def extracted(works: DataFrame, parsed: DataFrame, links: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a new extraction leaves: papers with blanks filled, links of re-read papers replaced, and references that nothing links to any more."""
    p = parsed.select("id", F.col("title").alias("_t"), F.col("year").alias("_y"))
    filled = works.join(p, "id", "left").select("id", F.coalesce(F.nullif("title", F.lit("")), "_t").alias("title"), F.coalesce("year", "_y").alias("year"))
    kept = links.join(parsed.select(F.col("id").alias("citing_id")), "citing_id", "left_anti").select("citing_id", "cited_id").unionAll(found.select("citing_id", "cited_id")).distinct()
    orphans = links.select("cited_id").distinct().join(kept.select("cited_id").distinct(), "cited_id", "left_anti")
    return filled, kept, orphans


def symmetric(pairs: DataFrame) -> DataFrame:
    """(work_id, linked_id): links (a, b) in both directions, each once."""
    p = pairs.where("a <> b")
    return p.select(F.col("a").alias("work_id"), F.col("b").alias("linked_id")).unionAll(p.select("b", "a")).distinct()
