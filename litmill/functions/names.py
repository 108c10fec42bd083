"""Author names: folding, parsing, and how many two lists share."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def folded(names: pd.Series) -> pd.Series:
    """Lower case without accents; Spark compares without accents but cannot write text without them."""

    def fold(name: str | None) -> str | None:
        if name is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", name.lower()) if not unicodedata.combining(c))

    return names.map(fold)


def person(name: Column) -> Column:
    """`surname initial` of `Last, First` or `First Last`."""
    n = F.trim(F.lower(name))
    comma = n.contains(",")
    surname = F.when(comma, F.trim(F.substring_index(n, ",", 1))).otherwise(F.element_at(F.split(n, r"\s+"), -1))
    given = F.when(comma, F.trim(F.regexp_extract(n, r"^[^,]*,(.*)$", 1))).otherwise(F.when(F.size(F.split(n, r"\s+")) > 1, n).otherwise(""))
    return F.trim(F.concat_ws(" ", surname, F.substring(given, 1, 1)))


def people(names: Column) -> Column:
    """Each name of a `;` list as `surname initial`, blanks dropped."""
    return F.transform(F.filter(F.split(names, ";"), lambda n: F.trim(n) != ""), lambda n: person(n))


def share(of: Column, among: Column) -> Column:
    """How many of the names of the first list the second has, null if the first is empty."""
    return F.when(F.size(of) > 0, F.size(F.array_intersect(of, among)) / F.size(F.array_distinct(of)))


_ET_AL = re.compile(r"\bet\.?\s*al\.?", re.IGNORECASE)


def parsed(name: str) -> tuple[str, str | None] | None:
    """(surname, initial or None) of `Last, First` or `First Last`, None if there is no surname."""
    n = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower().strip()
    surname, comma, given = n.partition(",")
    if not comma:
        *first, surname = n.split() or [""]
        given = " ".join(first)
    initial = re.search("[a-z]", given)
    return (surname.strip(), initial[0] if initial else None) if surname.strip() else None


def overlap_of(of: list[str], among: list[str]) -> float:
    """Share of the first list's names that the second has: equal surnames, and initials that agree if both have one.

    With `et al` in the first list a single common name is 1.
    """
    x, y = ([p for n in names if not _ET_AL.search(n) and (p := parsed(n))] for names in (of, among))
    if not x or not y:
        return 0.0
    known = [any(a[0] == b[0] and (a[1] is None or b[1] is None or a[1] == b[1]) for b in y) for a in x]
    return float(any(known)) if any(map(_ET_AL.search, of)) else sum(known) / len(x)


@F.pandas_udf(T.DoubleType())
def overlap(of: pd.Series, among: pd.Series) -> pd.Series:
    """`overlap_of` of two columns of lists, null if either is null."""
    return pd.Series([None if x is None or y is None else overlap_of(list(x), list(y)) for x, y in zip(of, among, strict=True)], dtype="float64")
