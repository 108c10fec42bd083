"""Readers of bibliographic records, as DataFrame functions over text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read_ris(rows: DataFrame, text: str = "text") -> DataFrame:
    """Records of RIS text: type, title, authors, year, venue, doi; records without a title are dropped."""
    records = F.filter(F.split(F.concat(F.lit("\n"), F.regexp_replace(text, "\r", "")), r"\n(?=TY  - )"), lambda r: F.trim(r).startswith("TY"))
    r = rows.select(*[c for c in rows.columns if c != text], F.posexplode(records).alias("pos", "record"))

    def all_of(tags: str) -> Column:
        return F.regexp_extract_all("record", F.lit(rf"(?m)^(?:{tags})  - ?(.*?)\s*$"), F.lit(1))

    def one(tags: str) -> Column:
        return F.nullif(F.trim(F.get(all_of(tags), F.lit(0))), F.lit(""))

    fields = {"kind": one("TY"), "title": one("TI|T1"), "authors": all_of("AU|A1"), "year": F.regexp_extract(one("PY|Y1"), r"\d{4}", 0).try_cast("int"), "venue": one("JO|JF|T2"), "doi": one("DO")}
    return r.withColumns(fields).drop("record").where("title is not null")


def read_bibtex(rows: DataFrame, text: str = "text") -> DataFrame:
    """Entries of BibTeX text: kind, cite_key, title, authors, year, venue, doi; values in braces (nested once) or quotes."""
    entries = F.filter(F.split(F.concat(F.lit("\n"), F.col(text)), r"\n\s*(?=@)"), lambda e: e.rlike(r"^@\w+\s*\{") & ~F.lower(e).rlike(r"^@(comment|string|preamble)"))
    r = rows.select(*[c for c in rows.columns if c != text], F.posexplode(entries).alias("pos", "entry"))

    def value(name: str) -> Column:
        raw = F.regexp_extract("entry", rf'(?is)[,{{]\s*{name}\s*=\s*(?:\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}|"([^"]*)"|(\w+))', 0)
        bare = F.regexp_replace(F.regexp_replace(raw, rf"(?is)^[,{{]\s*{name}\s*=\s*", ""), r'^[{"]|[}"]$', "")
        plain = F.regexp_replace(F.regexp_replace(bare, r"\\([&%$#_])", "$1"), "[{}]", "")
        return F.nullif(F.trim(F.regexp_replace(plain, r"\s+", " ")), F.lit(""))

    authors = F.transform(F.split(value("author"), r"\s+and\s+"), display_name)
    fields = {"kind": F.lower(F.regexp_extract("entry", r"^@(\w+)", 1)), "cite_key": F.regexp_extract("entry", r"^@\w+\s*\{\s*([^,\s]*)", 1), "title": value("title"), "authors": authors, "year": F.regexp_extract(value("year"), r"\d{4}", 0).try_cast("int"), "venue": F.coalesce(value("journal"), value("booktitle")), "doi": value("doi")}
    return r.withColumns(fields).drop("entry")


def display_name(name: Column) -> Column:
    """`Last, First` as `First Last`."""
    return F.trim(F.regexp_replace(F.trim(name), r"^([^,]+),\s*(.+)$", "$2 $1"))


def read_csl(rows: DataFrame, text: str = "text") -> DataFrame:
    """Items of CSL-JSON, an array or a single object."""
    item = "struct<id:string,type:string,title:string,DOI:string,`container-title`:string,author:array<struct<family:string,given:string>>,issued:struct<`date-parts`:array<array<int>>>>"
    wrapped = F.when(F.trim(text).startswith("["), F.col(text)).otherwise(F.concat(F.lit("["), F.col(text), F.lit("]")))
    r = rows.select(*[c for c in rows.columns if c != text], F.explode(F.from_json(wrapped, f"array<{item}>")).alias("i"))
    return r.withColumns({"title": F.col("i.title"), "doi": F.lower("i.DOI"), "venue": F.col("i.container-title"), "authors": F.transform("i.author", lambda a: F.concat_ws(" ", a["given"], a["family"])), "year": F.col("i.issued.date-parts")[0][0]}).drop("i")


def abstract_of_index(index: Column) -> Column:
    """The text of an inverted index, a JSON map from word to places."""
    places = F.flatten(F.transform(F.map_entries(F.from_json(index, "map<string,array<int>>")), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(places), lambda p: p["word"]), " ")


def read_works_json(rows: DataFrame, text: str = "text") -> DataFrame:
    """Titles, years and abstracts of works described in JSON with an inverted abstract index."""
    w = F.from_json(text, "struct<doi:string,title:string,publication_year:int,cited_by_count:long>")
    index = F.get_json_object(text, "$.abstract_inverted_index")
    return rows.select(*[c for c in rows.columns if c != text], w["doi"].alias("doi"), w["title"].alias("title"), w["publication_year"].alias("year"), w["cited_by_count"].alias("citation_count"), abstract_of_index(index).alias("abstract"))


def read_tei(rows: DataFrame, text: str = "tei") -> DataFrame:
    """Title, abstract, DOI, year and cited titles of a TEI document."""

    def path(*names: str) -> str:
        return "//" + "//".join(f'*[local-name()="{n}"]' for n in names)

    return rows.select(
        *[c for c in rows.columns if c != text],
        F.trim(F.xpath_string(text, F.lit(path("titleStmt", "title")))).alias("title"),
        F.trim(F.xpath_string(text, F.lit(path("abstract")))).alias("abstract"),
        F.nullif(F.xpath_string(text, F.lit('//*[local-name()="teiHeader"]//*[local-name()="idno"][@type="DOI"]')), F.lit("")).alias("doi"),
        F.xpath(text, F.lit(path("listBibl", "biblStruct", "title") + "/text()")).alias("cited_titles"),
        F.array_join(F.xpath(text, F.lit(path("body", "p") + "//text()")), " ").alias("body"),
    )


def links(pages: DataFrame) -> DataFrame:
    """(page_id, place, href, score): anchors of a page by how likely they lead to a PDF."""
    anchors = F.regexp_extract_all("html", F.lit(r'(?is)<a\b[^>]*\bhref\s*=\s*"([^"]*)"'), F.lit(1))
    a = pages.select("page_id", F.posexplode(F.coalesce(anchors, F.array())).alias("place", "href"))
    low = F.lower("href")
    score = F.when(low.rlike(r"\.pdf($|[?#])"), 3).otherwise(0) + F.when(low.contains("pdf"), 2).otherwise(0) + F.when(low.contains("download"), 2).otherwise(0) - F.when(low.rlike("supplement|license|terms"), 6).otherwise(0)
    return a.withColumn("score", score)


def manifest(folder: DataFrame) -> DataFrame:
    """(path, size, sha256) of files read as binaryFile; the first path of each content is kept."""
    rows = folder.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return rows.groupBy("sha256").agg(F.min("path").alias("path"), F.max("size").alias("size"), F.count("*").alias("copies"))
