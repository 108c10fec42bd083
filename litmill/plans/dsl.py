"""The search language: `key:value` terms and free text, to a filter over papers.

Terms are joined by and.  Of a repeated key the last one counts; unknown keys
are free text; a malformed year is ignored.
"""

from __future__ import annotations

import re
import shlex
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that the language knows.
KEYS = ("title", "venue", "abstract", "type", "status", "year", "author", "tag", "doi", "arxiv", "shelf", "rack", "cites", "cited_by_local", "row", "keyword", "topic", "summary", "fulltext", "file", "version", "warning", "has", "missing", "duplicate")
#: What counts as no.
_FALSE = ("false", "no", "n", "0", "none")


@dataclass
class Search:
    text: str = ""
    terms: dict[str, str] = field(default_factory=dict)
    year_min: int | None = None
    year_max: int | None = None


def truth(value: str) -> bool:
    return value.strip().lower() not in _FALSE


def parse(query: str) -> Search:
    """Terms and free text of a query; quotes group, and unbalanced quotes fall back to white space."""
    try:
        parts = shlex.split(query)
    except ValueError:
        parts = query.split()
    out, free = Search(), []
    for part in parts:
        key, colon, value = part.partition(":")
        if colon and value and key.lower() in KEYS:
            out.terms[key.lower()] = value
        else:
            free.append(part)
    out.text = " ".join(free)
    year = out.terms.pop("year", "")
    if m := re.fullmatch(r"(\d{4})-(\d{4})", year):
        out.year_min, out.year_max = int(m[1]), int(m[2])
    elif m := re.fullmatch(r"(>=|<=|=)?(\d{4})", year):
        y = int(m[2])
        out.year_min = y if m[1] != "<=" else None
        out.year_max = y if m[1] != ">=" else None
    return out


def like(column: str, value: str) -> Column:
    """Case-insensitive containment; % and _ in the value are wildcards."""
    return F.coalesce(F.col(column).ilike(f"%{value}%"), F.lit(False))


def _side(sides: dict[str, DataFrame], name: str) -> DataFrame:
    if name not in sides:
        raise ValueError(f"the search needs the table for {name}")
    return sides[name]


def filtered(works: DataFrame, search: Search, sides: dict[str, DataFrame] | None = None) -> DataFrame:
    """works that fit the search.

    sides gives ids (a column `id`) for the terms that look at other tables,
    by term: `has:references` under "has:references", `cites:7` under "cites",
    `tag` and the like with a column `name` to match; "sha256" gives the hashes
    of files, which free text of 8 to 64 hexadecimal digits also looks into.  A
    term whose table is not given is a ValueError.
    """
    sides = sides or {}
    text_columns = [c for c in ("title", "abstract", "doi", "arxiv_id", "venue") if c in works.columns]
    out = works
    if search.text:
        hit = F.lit(False)
        for c in text_columns:
            hit = hit | like(c, search.text)
        if "sha256" in sides and re.fullmatch("[0-9a-fA-F]{8,64}", search.text):
            files = sides["sha256"].where(F.col("name").startswith(search.text.lower())).select(F.col("id").alias("_id")).distinct()
            out = out.join(files, F.col("id") == F.col("_id"), "left")
            hit = hit | F.col("_id").isNotNull()
            out = out.where(hit).drop("_id")
        else:
            out = out.where(hit)
    for key, value in search.terms.items():
        if key in ("title", "venue", "abstract"):
            out = out.where(like(key, value))
        elif key == "type":
            out = out.where(F.col("work_type") == value)
        elif key == "status":
            out = out.where(F.col("reading_status") == value)
        elif key == "doi":
            plain = re.sub(r"^(https?://)?(dx\.)?(doi\.org/)?(doi:)?", "", value.strip().lower())
            out = out.where(F.col("doi").ilike(f"{plain}%"))
        elif key == "arxiv":
            hit = like("arxiv_id", value)
            out = out.where(hit | like("arxiv_base_id", value) if "arxiv_base_id" in works.columns else hit)
        elif key == "missing":
            for name in value.split(","):
                empty = F.col(name).isNull() if name == "year" else F.col(name).isNull() | (F.col(name).cast("string") == "")
                out = out.where(empty)
        elif key in ("keyword", "topic"):  # in the list as it is written
            out = out.where(F.contains(F.lower(F.to_json(f"{key}s")), F.lit(value.lower())))
        elif key == "has" and value == "abstract":
            out = out.where(F.coalesce(F.col("abstract") != "", F.lit(False)))
        elif key == "has":
            absent = value.startswith("no-")
            ids = _side(sides, f"has:{value.removeprefix('no-')}")
            out = out.join(ids.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left_anti" if absent else "left_semi")
        elif key == "version":
            ids = _side(sides, "version").select(F.col("id").alias("_id")).distinct()
            out = out.join(ids, F.col("id") == F.col("_id"), "left")
            has = F.col("version_group_id").isNotNull() | F.col("_id").isNotNull()
            out = out.where(has if truth(value) else ~has).drop("_id")
        elif key == "warning":
            ids = _side(sides, "warning")
            ids = ids.where((F.col("name") != "none") if value == "*" else F.col("name").ilike(f"%{value}%"))
            out = out.join(ids.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left_semi")
        elif key == "duplicate":
            ids = _side(sides, "duplicate").select(F.col("id").alias("_id")).distinct()
            out = out.join(ids, F.col("id") == F.col("_id"), "left_semi" if truth(value) else "left_anti")
        else:  # terms that match names or ids in other tables
            ids = _side(sides, key)
            hit = F.col("name").cast("string").ilike(f"%{value}%") if key not in ("cites", "cited_by_local") else F.col("name").cast("string") == value
            ids = ids.where(hit | (F.col("key").cast("string") == value) if "key" in ids.columns else hit)
            out = out.join(ids.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left_semi")
    if search.year_min is not None:
        out = out.where(F.col("year") >= search.year_min)
    if search.year_max is not None:
        out = out.where(F.col("year") <= search.year_max)
    return out
