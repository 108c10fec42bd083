"""Normalisation of titles, identifiers and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_title(title: Column) -> Column:
    """Lower-cased and trimmed, then only a-z, 0-9 and spaces, runs of spaces as one."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(title)), "[^a-z0-9 ]", ""), " +", " ")


def normalize_doi(doi: Column) -> Column:
    """Lower-cased and trimmed, without scheme, resolver host or `doi:`, each taken off once."""
    out = F.lower(F.trim(doi))
    for prefix in ("https?://", "(dx\\.)?doi\\.org/", "doi:"):
        out = F.regexp_replace(out, f"^{prefix}", "")
    return F.trim(out)


def arxiv_base(value: Column) -> Column:
    """The identifier without host, `arxiv:`, `.pdf` and version."""
    bare = F.regexp_replace(F.lower(F.trim(value)), r"^(https?://)?(www\.)?(arxiv\.org/(abs|pdf)/)?(arxiv:)?", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\.pdf$", ""), r"v\d+$", "")


def arxiv_version(value: Column) -> Column:
    """The version number, null without one."""
    found = F.regexp_extract(F.regexp_replace(F.lower(F.trim(value)), r"\.pdf$", ""), r"v(\d+)$", 1)
    return F.nullif(found, F.lit("")).cast("int")


def arxiv_from_doi(doi: Column) -> Column:
    """The arXiv identifier that a DataCite DOI spells, null for other DOIs."""
    return F.nullif(F.regexp_extract(normalize_doi(doi), r"^10\.48550/arxiv\.(.+)$", 1), F.lit(""))


def similarity_text(text: Column) -> Column:
    """Line-break hyphens joined, white space collapsed, trimmed, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"-\s*\n\s*", ""), r"\s+", " ")))


def dedup_key(doi: Column, arxiv: Column, title: Column, year: Column) -> Column:
    """What a reference is known by: its arXiv identifier or DOI, else its title and year."""
    bridged = F.coalesce(arxiv_from_doi(doi), F.nullif(arxiv_base(arxiv), F.lit("")))
    plain = F.nullif(normalize_doi(doi), F.lit(""))
    named = F.nullif(normalize_title(title), F.lit(""))
    by_title = F.concat(F.lit("title:"), named, F.lit("|"), F.coalesce(year.cast("string"), F.lit("")))
    return F.substring(F.coalesce(F.concat(F.lit("arxiv:"), arxiv_from_doi(doi)), F.concat(F.lit("doi:"), plain), F.concat(F.lit("arxiv:"), bridged), by_title), 1, 512)


def first_word(title: Column) -> Column:
    """The blocking key of a normalised title."""
    return F.substring_index(title, " ", 1)


#: Words that citation styles add or drop before a title.
LEADING = ("a", "an", "the", "on", "of", "in", "for", "to", "toward", "towards")


def relaxed_word(title: Column) -> Column:
    """The first word of a normalised title that is no leading stop word, else its first word."""
    words = F.filter(F.split(title, " "), lambda w: w != "")
    return F.coalesce(F.get(F.filter(words, lambda w: ~w.isin(*LEADING)), F.lit(0)), F.get(words, F.lit(0)))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def tokens(text: Column, pattern: str = "[a-z][a-z0-9'-]+") -> Column:
    """All tokens of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def first_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\d{4}", 0), F.lit("")).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 if their lengths differ or one is zero."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets, null if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def escape_latex(text: Column) -> Column:
    """Special characters escaped in a single pass."""
    marked = F.regexp_replace(text, r"\\", "\u0001")
    marked = F.regexp_replace(marked, r"([&%$#_{}])", r"\\$1")
    marked = F.replace(F.replace(marked, F.lit("~"), F.lit(r"\textasciitilde{}")), F.lit("^"), F.lit(r"\textasciicircum{}"))
    return F.replace(marked, F.lit("\u0001"), F.lit(r"\textbackslash{}"))


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


#: Roman digits.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman(text: Column) -> Column:
    """The value of a Roman numeral, null for other text: a digit before a greater one counts against it."""
    digits = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))

    def step(state: Column, c: Column) -> Column:
        v = digits[c]
        return F.struct((state["total"] + F.when(v < state["most"], -v).otherwise(v)).alias("total"), F.greatest(state["most"], v).alias("most"))

    value = F.aggregate(F.reverse(F.split(text, "")), start, step, lambda s: s["total"])
    return F.when(text.rlike("^[IVXLCDM]+$"), value)


def json_within(text: Column) -> Column:
    """The text if it is JSON, else what stands from the first to the last bracket if that is, else null."""
    inner = F.regexp_extract(text, r"(?s)[\[{].*[\]}]", 0)
    return F.when(F.try_parse_json(text).isNotNull(), text).when((inner != "") & F.try_parse_json(inner).isNotNull(), inner)


def clean_label(label: Column) -> Column:
    """Without control characters, white space collapsed, at most 255 letters; null if nothing is left."""
    bare = F.regexp_replace(label, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
    return F.nullif(F.substring(F.trim(F.regexp_replace(bare, r"\s+", " ")), 1, 255), F.lit(""))
