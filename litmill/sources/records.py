"""Records of other catalogues: JSON and Atom to columns, and the writers of their shapes and of TEI; manifests, lines and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_doi, normalize_title
from ..session import COSTLY, spread


def _clean(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def _others(rows: DataFrame, text: str) -> list[str]:
    return [c for c in rows.columns if c != text]


def _names(names: Column) -> Column:
    return F.filter(F.transform(names, _clean), lambda n: n.isNotNull())


# -- Crossref

def crossref_json() -> Column:
    author = F.transform("authors", lambda a: F.struct(F.regexp_extract(a, r"^(\S+) (.+)$", 1).alias("given"), F.regexp_extract(a, r"^(\S+) (.+)$", 2).alias("family")))
    message = F.struct(F.array("title").alias("title"), F.array("venue").alias("container-title"), F.concat(F.lit("<jats:p>"), "abstract", F.lit("</jats:p>")).alias("abstract"), F.col("doi").alias("DOI"), F.struct(F.array(F.array("year")).alias("date-parts")).alias("issued"), author.alias("author"))
    return F.to_json(F.struct(message.alias("message")))


def read_crossref(rows: DataFrame, text: str = "text") -> DataFrame:
    """title, year, venue, doi, authors, abstract (without tags), citation_count of works; other shapes give nulls."""
    shape = "struct<message:struct<title:array<string>,`container-title`:array<string>,abstract:string,DOI:string,issued:struct<`date-parts`:array<array<int>>>,author:array<struct<given:string,family:string>>,`is-referenced-by-count`:long>>"
    m = F.from_json(text, shape)["message"]
    authors = _names(F.transform(m["author"], lambda a: F.concat_ws(" ", F.nullif(a["given"], F.lit("")), F.nullif(a["family"], F.lit("")))))
    return rows.select(*_others(rows, text), _clean(F.get(m["title"], F.lit(0))).alias("title"), F.get(F.get(m["issued"]["date-parts"], F.lit(0)), F.lit(0)).alias("year"), _clean(F.get(m["container-title"], F.lit(0))).alias("venue"), m["DOI"].alias("doi"), authors.alias("authors"), _clean(F.regexp_replace(m["abstract"], "<[^>]+>", " ")).alias("abstract"), m["is-referenced-by-count"].alias("citation_count"))


# -- OpenAlex

def openalex_json() -> Column:
    authors = F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author")))
    return F.to_json(F.struct(F.concat(F.lit("W"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("https://doi.org/"), "doi").alias("doi"), F.col("title").alias("display_name"), F.col("year").alias("publication_year"), F.struct(F.struct(F.col("venue").alias("display_name")).alias("source")).alias("primary_location"), authors.alias("authorships")))


def read_openalex(rows: DataFrame, text: str = "text") -> DataFrame:
    """title, year, venue, doi, authors, citation_count of works; one without an id gives nulls."""
    shape = "struct<id:string,doi:string,display_name:string,title:string,publication_year:int,cited_by_count:long,primary_location:struct<source:struct<display_name:string>>,host_venue:struct<display_name:string>,authorships:array<struct<author:struct<display_name:string>>>>"
    parsed = F.from_json(text, shape)
    w = F.when(parsed["id"].isNotNull(), parsed)
    venue = F.coalesce(w["primary_location"]["source"]["display_name"], w["host_venue"]["display_name"])
    return rows.select(*_others(rows, text), _clean(F.coalesce(w["display_name"], w["title"])).alias("title"), w["publication_year"].alias("year"), _clean(venue).alias("venue"), F.regexp_replace(w["doi"], "^https://doi.org/", "").alias("doi"), _names(F.transform(w["authorships"], lambda a: a["author"]["display_name"])).alias("authors"), w["cited_by_count"].alias("citation_count"))


# -- Semantic Scholar

def _arxiv_number() -> Column:
    return F.concat(F.lit("2101."), F.lpad(F.col("id").cast("string"), 5, "0"))


def semantic_scholar_json() -> Column:
    return F.to_json(F.struct("title", "abstract", "year", "venue", F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors"), F.struct(F.col("doi").alias("DOI"), _arxiv_number().alias("ArXiv")).alias("externalIds")))


def read_semantic_scholar(rows: DataFrame, text: str = "text") -> DataFrame:
    """title, abstract, year, venue, doi, arxiv, authors, citation_count of papers."""
    p = F.from_json(text, "struct<title:string,abstract:string,year:int,venue:string,citationCount:long,authors:array<struct<name:string>>,externalIds:struct<DOI:string,ArXiv:string>>")
    return rows.select(*_others(rows, text), _clean(p["title"]).alias("title"), _clean(p["abstract"]).alias("abstract"), p["year"].alias("year"), _clean(p["venue"]).alias("venue"), p["externalIds"]["DOI"].alias("doi"), _clean(p["externalIds"]["ArXiv"]).alias("arxiv"), _names(F.transform(p["authors"], lambda a: a["name"])).alias("authors"), p["citationCount"].alias("citation_count"))


def read_citing(rows: DataFrame, most: int, text: str = "text") -> DataFrame:
    """(place, external_id, title, year, doi) of the first citing papers of each page."""
    page = F.from_json(text, "struct<data:array<struct<citingPaper:struct<paperId:string,title:string,year:int,externalIds:struct<DOI:string>>>>>")
    rows = rows.select(*_others(rows, text), F.posexplode(F.slice(page["data"], 1, most)).alias("place", "d"))
    p = F.col("d.citingPaper")
    return rows.select(*[c for c in rows.columns if c != "d"], p["paperId"].alias("external_id"), p["title"].alias("title"), p["year"].alias("year"), F.nullif(normalize_doi(p["externalIds"]["DOI"]), F.lit("")).alias("doi"))


# -- Atom

def _escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def atom_xml() -> Column:
    authors = F.array_join(F.transform("authors", lambda a: F.concat(F.lit("<author><name>"), _escaped(a), F.lit("</name></author>"))), "")
    parts = [F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/'), _arxiv_number(), F.lit("</id><published>"), F.col("year").cast("string"), F.lit("-01-02T00:00:00Z</published><title>"), _escaped(F.col("title")), F.lit("</title><summary> "), _escaped(F.col("abstract")), F.lit("\n</summary>"), authors, F.lit("<arxiv:doi>"), F.col("doi"), F.lit("</arxiv:doi></entry></feed>")]
    return F.concat(*parts)


def read_atom(rows: DataFrame, text: str = "text") -> DataFrame:
    """title, abstract, year, doi, arxiv, authors of the first entry of a feed."""

    def path(*names: str) -> Column:
        return F.lit("//" + "/".join(f'*[local-name()="{n}"]' for n in ("entry", *names)))

    def one(*names: str) -> Column:
        return _clean(F.xpath_string(text, path(*names)))

    # Each path reads the feed anew, and a table of one file is one task's.
    rows = spread(rows, most=COSTLY)
    number = F.nullif(F.regexp_extract(one("id"), "/abs/(.+)$", 1), F.lit(""))
    authors = _names(F.xpath(text, F.lit('(//*[local-name()="entry"])[1]/*[local-name()="author"]/*[local-name()="name"]/text()')))
    return rows.select(*_others(rows, text), one("title").alias("title"), one("summary").alias("abstract"), F.substring(one("published"), 1, 4).try_cast("int").alias("year"), one("doi").alias("doi"), number.alias("arxiv"), authors.alias("authors"))


# -- TEI

def tei_xml() -> Column:
    """A small TEI document with a header, two numbered sections (one with a subsection) and a reference."""
    def tag(name: str, text: Column, attributes: str = "") -> Column:
        return F.concat(F.lit(f"<{name}{attributes}>"), text, F.lit(f"</{name}>"))

    first = tag("persName", F.concat(tag("forename", F.lit("Ada")), tag("surname", _escaped(F.split("title", " ")[0]))))
    header = tag("teiHeader", F.concat(tag("titleStmt", tag("title", _escaped(F.col("title")))), tag("sourceDesc", tag("biblStruct", tag("analytic", tag("author", first)))), tag("profileDesc", tag("abstract", tag("p", _escaped(F.col("abstract")))))))
    intro = tag("div", F.concat(tag("head", F.lit("Intro")), tag("p", _escaped(F.concat("title", F.lit(" is studied."))))))
    methods = tag("div", F.concat(tag("head", F.lit("Methods"), ' n="1."'), tag("p", F.lit("Lead.")), tag("div", F.concat(tag("head", F.lit("Data")), tag("p", _escaped(F.col("abstract")))))))
    date = F.concat(F.lit('<date when="'), F.col("year").cast("string"), F.lit('-05"/>'))
    reference = F.concat(F.lit('<biblStruct xml:id="b0" coords="1,2.5,3,4,5;x,1;2,1,1,1,1">'), tag("analytic", F.concat(tag("title", _escaped(F.concat("title", F.lit(" again")))), tag("author", first))), tag("monogr", F.concat(tag("title", _escaped(F.col("venue"))), tag("imprint", date))), tag("idno", F.col("doi"), ' type="DOI"'), F.lit("</biblStruct>"))
    body = tag("text", F.concat(tag("body", F.concat(intro, methods)), tag("back", tag("listBibl", reference))))
    return F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0">'), header, body, F.lit("</TEI>"))


def mention_xml() -> Column:
    """A small TEI document whose body cites a reference in sentences and another in a bare paragraph."""
    sentences = F.concat(F.lit("<s>"), _escaped(F.col("title")), F.lit(" is known.</s> <s>Some <hi>use</hi> it <ref type='bibr' target='#b0' coords='3,1.5,2,3,4;x,1,1,1,1;4,1,1,1,1'>[1]</ref> , too.</s><note>n</note>\n<s>Others of "), _escaped(F.col("venue")), F.lit(" do not.</s>"))
    bare = F.concat(F.lit("In "), _escaped(F.col("venue")), F.lit(" by <ref type='bibr' target='#b1'>Bo</ref>. End.<ref type='bibr'>lost</ref><ref type='figure' target='#f1'>F</ref>"))
    body = F.concat(F.lit("<body><div type='introduction'><head n='1.'>Intro</head><p>"), sentences, F.lit("</p></div><div type='methods'><p>"), bare, F.lit("</p></div></body>"))
    back = F.concat(F.lit("<back><div><listBibl><biblStruct xml:id='b0'><analytic><title>"), _escaped(F.col("title")), F.lit("</title></analytic></biblStruct><biblStruct xml:id='b1'><note type='raw_reference'>Bo, "), F.col("year").cast("string"), F.lit(".</note></biblStruct><biblStruct xml:id='b2'/></listBibl></div></back>"))
    return F.concat(F.lit("<t:TEI xmlns:t='http://www.tei-c.org/ns/1.0' xmlns='http://www.tei-c.org/ns/1.0'><text>"), body, back, F.lit("</text></t:TEI>"))


# -- lines, drafts, manifests, links

_DOI = r"(?i)(?:doi:\s*)?(10\.\d{4,9}/[^\s,;)\]]+)"
_YEAR = r"\((1[5-9]\d{2}|20\d{2})\)"


def cited_lines(lines: DataFrame) -> DataFrame:
    """(id, title, year, doi) of lines of free text: what is recognised is taken out of the title."""
    line = F.trim("line")
    doi = F.nullif(F.regexp_replace(F.regexp_extract(line, _DOI, 1), r"[.,;)\]}]+$", ""), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, _DOI, ""), r"(?i)\bdoi:\s*", ""), _YEAR, "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\s{2,}", " "), r"^[ .,;–-]+|[ .,;–-]+$", "")
    kept = lines.where(line != "")
    return kept.select("id", F.coalesce(F.nullif(bare, F.lit("")), line).alias("title"), F.regexp_extract(line, _YEAR, 1).try_cast("int").alias("year"), doi.alias("doi"))


def committed(drafts: DataFrame, works: DataFrame) -> DataFrame:
    """(id, fate) of drafts (id, doi, title, included): skipped, matched by DOI or else title, or created."""
    d = drafts.withColumns({"_doi": F.nullif(normalize_doi(F.col("doi")), F.lit("")), "_t": F.nullif(normalize_title(F.col("title")), F.lit(""))})
    by_doi = works.where("doi is not null").select(normalize_doi(F.col("doi")).alias("_doi")).distinct().withColumn("_by_doi", F.lit(True))
    by_title = works.select(normalize_title(F.col("title")).alias("_t")).where("_t <> ''").distinct().withColumn("_by_title", F.lit(True))
    met = d.join(by_doi, "_doi", "left").join(by_title, "_t", "left")
    return met.select("id", F.when(~F.col("included"), "skipped").when(F.coalesce("_by_doi", "_by_title").isNotNull(), "matched").otherwise("created").alias("fate"))


def upserted_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, size, source_removed, is_new): what was known, with what a new manifest says; a path that it lacks has been removed."""
    met = old.select("path", F.col("size").alias("_old")).join(new.select("path", F.col("size").alias("_new")), "path", "full")
    return met.select("path", F.coalesce("_new", "_old").alias("size"), F.col("_new").isNull().alias("source_removed"), F.col("_old").isNull().alias("is_new"))


#: By host, what the address of an article page looks like, what its path must not have, and the address of the file ($: groups of the whole address without what stands behind `?`, unless the page needs it).
PUBLISHERS = (
    # host, the page's address, path to leave alone, the file's address
    ("arxiv.org", r"^(.*?)/abs/(.*)$", None, "$1/pdf/$2"),
    ("dl.acm.org", r"^(.*?)/doi/(.*)$", "/doi/pdf", "$1/doi/pdf/$2"),
    ("link.springer.com", r"^(.*?)/article/(.*?)/*$", None, "$1/content/pdf/$2.pdf"),
    ("onlinelibrary.wiley.com", r"^(.*?)/doi/(.*)$", "/pdf", "$1/doi/pdfdirect/$2"),
    ("ieeexplore.ieee.org", r"^.*?/document/(\d+).*$", None, "https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?tp=&arnumber=$1"),
    ("nature.com", r"^([^?]*/articles/[^?]*?)/*(?:\?.*)?$", r"\.pdf$", "$1.pdf"),
    ("mdpi.com", r"^([^?]*/\d{4}-\d{3,4}/[^?]*?)/*(?:\?.*)?$", r"(?:/|\.)pdf$", "$1/pdf"),
    ("aclanthology.org", r"^([^?]*?)/*(?:\?.*)?$", r"\.pdf$", "$1.pdf"),
    ("openreview.net", r"^(.*?)/forum(.*)$", None, "$1/pdf$2"),
    ("papers.nips.cc", r"^([^?]*/paper[^?]*?)/*(?:\?.*)?$", r"\.pdf$", "$1.pdf"),
    ("proceedings.neurips.cc", r"^(.*?)/hash/(.*?)-Abstract\.html(.*)$", None, "$1/file/$2-Paper.pdf$3"),
    ("proceedings.neurips.cc", r"^((?:(?!/hash/).)*?)-Abstract\.html(.*)$", None, "$1-Paper.pdf$2"),
    ("biorxiv.org", r"^([^?]*/content/[^?]*?)/*(?:\?.*)?$", r"\.full\.pdf$", "$1.full.pdf"),
    ("medrxiv.org", r"^([^?]*/content/[^?]*?)/*(?:\?.*)?$", r"\.full\.pdf$", "$1.full.pdf"),
    ("journals.plos.org", r"^([^?]*?)/article([^?#]*)\?([^#]*id=[^#]*)(?:#.*)?$", None, "$1/article/file$2?$3&type=printable"),
)


def publisher_pdfs(url: Column) -> Column:
    """Where publishers keep the file of an article page, likeliest first."""
    host, path = (F.coalesce(F.try_parse_url(url, F.lit(part)), F.lit("")) for part in ("HOST", "PATH"))

    def file_of(of: str, page: str, spared: str | None, file: str) -> Column:
        fits = F.lower(host).endswith(of) & url.rlike(page) & (~path.rlike(spared) if spared else F.lit(True))
        return F.when(fits, F.nullif(F.regexp_replace(url, page, file), url))

    return F.array_compact(F.array(*[file_of(*rule) for rule in PUBLISHERS]))


def scanned_folder(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, sha256, fate) of files read as binaryFile: unchanged ones keep their known hash (path, mtime, sha256), equal contents are one."""
    k = known.select(F.col("path"), F.col("mtime").alias("_mtime"), F.col("sha256").alias("_sha"))
    met = files.select("path", F.col("modificationTime").alias("mtime"), "content").join(k, "path", "left")
    same = F.coalesce(F.col("mtime") == F.col("_mtime"), F.lit(False))
    rows = met.select("path", same.alias("same"), F.when(same, F.col("_sha")).otherwise(F.sha2("content", 256)).alias("sha256"))
    first = rows.groupBy("sha256").agg(F.min("path").alias("first"))
    return rows.join(first, "sha256").select("path", "sha256", F.when(F.col("path") != F.col("first"), "copy").when(F.col("same"), "unchanged").otherwise("new").alias("fate"))


def schema_changes(stored: DataFrame, now: DataFrame) -> dict[str, list[str]]:
    """Columns of a backup that the table lacks, and those that it has gained."""
    return {"dropped": sorted(set(stored.columns) - set(now.columns)), "added": sorted(set(now.columns) - set(stored.columns))}
