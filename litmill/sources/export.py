"""Writers of bibliographic records: a text column for each format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escape_html, escape_latex
from ..operators import library


def cite_keys(rows: DataFrame, surname: Column, year: Column, by: str = "id") -> DataFrame:
    """rows with `cite_key`: surname and year; equal ones get 2, 3, ... in order of `by`."""
    base = F.concat(F.coalesce(F.nullif(F.regexp_replace(F.lower(surname), "[^a-z]", ""), F.lit("")), F.lit("anon")), F.coalesce(year.cast("string"), F.lit("nd")))
    n = F.row_number().over(Window.partitionBy("_base").orderBy(by))
    return rows.withColumn("_base", base).withColumn("_n", n).withColumn("cite_key", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.col("_n").cast("string")))).drop("_base", "_n")


def _field(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"  {name} = {{"), value, F.lit("}")))


def bibtex() -> Column:
    body = F.concat_ws(",\n", _field("title", escape_latex(F.col("title"))), _field("journal", escape_latex(F.col("venue"))), _field("year", F.col("year").cast("string")), _field("doi", F.col("doi")))
    return F.concat(F.lit("@article{"), F.col("cite_key"), F.lit(",\n"), body, F.lit("\n}"))


def ris() -> Column:
    def line(tag: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{tag}  - "), value))

    return F.concat_ws("\n", F.lit("TY  - JOUR"), line("TI", F.col("title")), line("JO", F.col("venue")), line("PY", F.col("year").cast("string")), line("DO", F.col("doi")), F.lit("ER  - "))


def csl_json() -> Column:
    issued = F.when(F.col("year").isNotNull(), F.struct(F.array(F.array("year")).alias("date-parts")))
    return F.to_json(F.struct(F.col("cite_key").alias("id"), F.lit("article-journal").alias("type"), "title", F.col("venue").alias("container-title"), issued.alias("issued"), F.col("doi").alias("DOI")))


def markdown() -> Column:
    return F.concat(F.lit("- **"), F.col("title"), F.lit("**"), F.coalesce(F.concat(F.lit(", *"), F.col("venue"), F.lit("*")), F.lit("")), F.coalesce(F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")")), F.lit("")))


def html() -> Column:
    return F.concat(F.lit("<li>"), escape_html(F.col("title")), F.coalesce(F.concat(F.lit(", <i>"), escape_html(F.col("venue")), F.lit("</i>")), F.lit("")), F.coalesce(F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")")), F.lit("")), F.lit("</li>"))


def latex() -> Column:
    return F.concat(F.lit("\\bibitem{"), F.col("cite_key"), F.lit("} "), escape_latex(F.col("title")), F.coalesce(F.concat(F.lit(". \\emph{"), escape_latex(F.col("venue")), F.lit("}")), F.lit("")), F.lit("."))


FORMATS = {"bibtex": bibtex, "ris": ris, "csl_json": csl_json, "markdown": markdown, "html": html, "latex": latex}


def write_backup(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Each table as JSON lines in a folder of its own, and a manifest (table, rows, columns), which is returned."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{folder}/{name}")
    counts = [(name, spark.read.schema(df.schema).json(f"{folder}/{name}").count(), df.columns) for name, df in tables.items()]
    manifest = spark.createDataFrame(counts, "table string, rows long, columns array<string>")
    manifest.write.mode("errorifexists").json(f"{folder}/manifest")
    return manifest


def restored(old: DataFrame, backup: DataFrame, key: str, mode: str = "merge") -> DataFrame:
    """Rows after a restore: `replace` takes the backup's, `merge` adds those whose key is new; columns may differ."""
    known = backup.select(*[F.col(c).cast(old.schema[c].dataType).alias(c) for c in backup.columns if c in old.columns])
    if mode == "replace":
        return old.limit(0).unionByName(known, allowMissingColumns=True)
    return old.unionByName(known.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def _missing_base() -> Column:
    word = F.nullif(F.regexp_extract(F.coalesce("title", F.lit("")), "[A-Za-z0-9]+", 0), F.lit(""))
    return F.concat(F.lower(F.coalesce(word, F.lit("work"))), F.coalesce(F.col("year").cast("string"), F.lit("nd")))


def missing_keys(rows: DataFrame) -> DataFrame:
    """Missing papers with `cite_key`: first word and year, numbered from the most cited."""
    n = F.row_number().over(Window.partitionBy("_base").orderBy(F.desc("cited_by"), "key"))
    keyed = rows.withColumn("_base", _missing_base()).withColumn("_n", n)
    return keyed.withColumn("cite_key", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.col("_n").cast("string")))).drop("_base", "_n")


def missing_bibtex() -> Column:
    note = F.concat(F.lit("Cited by "), F.col("cited_by").cast("string"), F.lit(" paper(s) in the scope"))
    body = F.concat_ws(",\n", _field("title", escape_latex(F.coalesce("title", F.lit("Untitled")))), _field("year", F.col("year").cast("string")), _field("doi", F.col("doi")), _field("note", note))
    return F.concat(F.lit("@misc{"), F.col("cite_key"), F.lit(",\n"), body, F.lit("\n}"))


def missing_csv() -> Column:
    """title, authors (none), year, doi, cited_by, mentions."""
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("title", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", quoted, F.lit(""), F.coalesce(F.col("year").cast("string"), F.lit("")), F.coalesce("doi", F.lit("")), F.col("cited_by").cast("string"), F.col("mentions").cast("string"))


def reference_line() -> Column:
    """A reference that no paper answers, as a line."""
    parts = F.concat_ws(" ", F.trim("title"), F.concat(F.lit("("), F.col("year").cast("string"), F.lit(")")), F.concat(F.lit("DOI: "), "doi"), F.concat(F.lit("arXiv:"), "arxiv"))
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit("Untitled reference"))


def safe_key(raw: Column, fallback: Column) -> Column:
    """A reader's key without what could break out of an entry; letters of any script, digits and . : + / _ - stay."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"[^\p{L}\p{N}_.:+/-]", "-"), "-{2,}", "-")
    return F.coalesce(F.nullif(F.regexp_replace(bare, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""), F.lit("")), fallback)


def unique_keys(rows: DataFrame) -> DataFrame:
    """Keys that occur again get -2, -3, ... in order of id."""
    n = F.row_number().over(Window.partitionBy("cite_key").orderBy("id"))
    return rows.withColumn("_n", n).withColumn("cite_key", F.when(F.col("_n") == 1, F.col("cite_key")).otherwise(F.concat("cite_key", F.lit("-"), F.col("_n").cast("string")))).drop("_n")


def full_bibtex(biblatex: bool = False) -> Column:
    """An entry with authors; BibLaTeX names date and journal otherwise."""
    authors = F.nullif(F.array_join("authors", " and "), F.lit(""))
    body = F.concat_ws(",\n", _field("author", escape_latex(authors)), _field("title", escape_latex(F.coalesce("title", F.lit("Untitled")))), _field("date" if biblatex else "year", F.col("year").cast("string")), _field("journaltitle" if biblatex else "journal", escape_latex(F.col("venue"))), _field("doi", escape_latex(F.col("doi"))))
    return F.concat(F.lit("@article{"), F.col("cite_key"), F.lit(",\n"), body, F.lit("\n}"))


def full_ris() -> Column:
    """A record with authors and abstract."""
    def line(tag: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{tag}  - "), value))

    authors = F.nullif(F.array_join(F.transform("authors", lambda a: F.concat(F.lit("AU  - "), a)), "\n"), F.lit(""))
    return F.concat_ws("\n", F.lit("TY  - JOUR"), authors, line("TI", F.coalesce("title", F.lit("Untitled"))), line("PY", F.col("year").cast("string")), line("JO", F.col("venue")), line("DO", F.col("doi")), line("AB", F.col("abstract")), F.lit("ER  - "))


def inline() -> Column:
    """A work in one line of Markdown."""
    head = F.concat(F.lit("**"), F.coalesce("title", F.lit("Untitled")), F.lit("**"), F.coalesce(F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(").")), F.lit(".")))
    authors = F.concat(F.nullif(F.array_join("authors", ", "), F.lit("")), F.lit("."))
    doi = F.concat(F.lit("DOI: ["), "doi", F.lit("](https://doi.org/"), "doi", F.lit(")"))
    return F.concat_ws(" ", head, authors, F.concat(F.lit("*"), "venue", F.lit("*.")), doi)


def pandoc() -> Column:
    return F.concat(F.lit("- [@"), F.col("cite_key"), F.lit("]: "), inline())


def annotations(notes: DataFrame) -> DataFrame:
    """(id, notes): the notes of each paper in order of page."""
    row = F.struct("page", "kind", "note")
    lines = F.transform(F.array_sort(F.collect_list(row)), lambda n: F.concat(F.lit("["), n["kind"], F.lit("] "), n["note"]))
    return notes.where("note is not null").groupBy("id").agg(F.array_join(lines, "\n").alias("notes"))


FORMATS |= {"biblatex": lambda: full_bibtex(biblatex=True), "pandoc": pandoc, "text": inline, "full_ris": full_ris}


def exported(works: DataFrame, form: str, scope: str = "library", scope_id: object = None, shelf_works: DataFrame | None = None, shelves: DataFrame | None = None) -> DataFrame:
    """(place, id, entry): the papers of a scope (as `library.in_scope`) in one of FORMATS, numbered from 0 in the order of a list.

    A selection keeps the caller's order; a shelf goes by `position` where
    shelf_works has it, then, like all others, by year, title and id, with
    nulls last.  The columns are those that the format reads.
    """
    chosen = library.in_scope(works, scope, scope_id, shelf_works, shelves)
    order = [F.col(c).asc_nulls_last() for c in ("year", "title", "id")]
    if scope == "selection":
        order = [F.col("_pos").asc()]
    elif scope == "shelf" and "position" in shelf_works.columns:
        first = shelf_works.where(F.col("shelf_id") == scope_id).groupBy(F.col("work_id").alias("id")).agg(F.min("position").alias("_position"))
        chosen, order = chosen.join(first, "id"), [F.col("_position").asc_nulls_last(), *order]
    return library.numbered(chosen, order).select("place", "id", FORMATS[form]().alias("entry"))
