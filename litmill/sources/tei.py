"""TEI documents: header, sections, references and the places where the text cites them.

A document is walked once.  What is left of it are its pieces of text in order
and, for each element, which of them are its own: elements are stretches of the
text, with a path and attributes.  Everything else is said by tables of paths.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import COSTLY, spread

#: Marks that no space stands before.
_BEFORE_MARKS = re.compile(r"\s+([,.;:!?])")

#: Fields of a header and of a reference: the first of these paths that leads to some text; `//` skips levels, `@` asks for a type.
HEADER = {
    "title": ("teiHeader//titleStmt/title",),
    "abstract": ("profileDesc/abstract",),
    "doi": ("teiHeader//idno@DOI",),
    "venue": ("teiHeader//sourceDesc//biblStruct//monogr/title",),
}
HEADER_DATES = ("teiHeader//sourceDesc//biblStruct//monogr//imprint//date", "teiHeader//sourceDesc//biblStruct//monogr//date")
HEADER_PEOPLE = ("teiHeader//sourceDesc//author/persName",)
REFERENCE = {
    "raw": ("note@raw_reference",),
    "title": ("analytic/title", "monogr/title"),
    "doi": ("idno@DOI",),
    "arxiv": ("idno@arXiv",),
}
#: Where a reference has an article's title, that of the whole is its venue.
ARTICLE, WHOLE = "analytic/title", "monogr/title"
REFERENCE_DATES = ("monogr//date", "date")
REFERENCE_PEOPLE = ("analytic/author/persName", "author/persName")


class Stretches:
    """The elements of a document in order: name, path from the root, parent, pieces of text from `start` to `end`, last element inside, attributes."""

    def __init__(self, text: str | bytes):
        self.names: list[str] = []
        self.paths: list[str] = []
        self.parents: list[int] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.last: list[int] = []
        self.attributes: list[dict] = []
        self.pieces: list[str] = []
        self._open = [-1]
        reader = expat.ParserCreate(namespace_separator=" ")
        reader.buffer_text = True
        reader.StartElementHandler, reader.EndElementHandler, reader.CharacterDataHandler = self._begin, self._finish, self._text
        reader.Parse(text, True)
        self.by_name: dict[str, list[int]] = {}
        for i, name in enumerate(self.names):
            self.by_name.setdefault(name, []).append(i)

    def _begin(self, name: str, attributes: dict) -> None:
        name, above = name.rpartition(" ")[2], self._open[-1]
        self.names.append(name)
        self.paths.append((self.paths[above] if above >= 0 else "") + "/" + name)
        self.parents.append(above)
        self.start.append(len(self.pieces))
        self.end.append(-1)
        self.last.append(-1)
        self.attributes.append({k.rpartition(" ")[2]: v for k, v in attributes.items()})
        self._open.append(len(self.names) - 1)

    def _finish(self, name: str) -> None:
        i = self._open.pop()
        self.end[i], self.last[i] = len(self.pieces), len(self.names) - 1

    def _text(self, text: str) -> None:
        line = " ".join(text.split())
        if line:
            self.pieces.append(line)

    def text(self, i: int, until: int | None = None) -> str | None:
        """The text of an element, or of its beginning up to a piece."""
        line = " ".join(self.pieces[self.start[i] : self.end[i] if until is None else until])
        return _BEFORE_MARKS.sub(r"\1", line) or None

    def inside(self, i: int, name: str) -> list[int]:
        """Elements of a name inside another, in order."""
        known = self.by_name.get(name, [])
        return known[bisect_left(known, i + 1) : bisect_left(known, self.last[i] + 1)] if i >= 0 else known

    def at(self, i: int, path: str) -> list[int]:
        """Elements inside another (-1: the document) whose path ends so."""
        path, _, kind = path.partition("@")
        # A path is matched from its end; what lies above the element does not count.
        ends = re.compile("/" + path.replace("//", "/(?:[^/]+/)*") + "$")
        above = len(self.paths[i]) if i >= 0 else 0
        return [j for j in self.inside(i, path.rpartition("/")[2]) if ends.search(self.paths[j], above) and (not kind or self.attributes[j].get("type") == kind)]

    def first(self, i: int, paths: tuple[str, ...]) -> int | None:
        return next((found[0] for path in paths if (found := self.at(i, path))), None)

    def above(self, i: int, name: str) -> int | None:
        """The nearest element of a name that holds this one."""
        while (i := self.parents[i]) >= 0:
            if self.names[i] == name:
                return i
        return None


def _told(doc: Stretches, i: int, fields: dict[str, tuple[str, ...]]) -> dict:
    found = {name: doc.first(i, paths) for name, paths in fields.items()}
    return {name: doc.text(j) if j is not None else None for name, j in found.items()}


def _year(doc: Stretches, i: int, paths: tuple[str, ...]) -> int | None:
    at = doc.first(i, paths)
    digits = re.search(r"\d{4}", doc.attributes[at].get("when") or doc.text(at) or "") if at is not None else None
    return int(digits[0]) if digits else None


def _people(doc: Stretches, i: int, paths: tuple[str, ...]) -> list[str]:
    people = next((found for path in paths if (found := doc.at(i, path))), [])
    parts = ([j for name in ("forename", "surname") for j in doc.inside(p, name) if doc.parents[j] == p] for p in people)
    names = (" ".join(filter(None, map(doc.text, each))) for each in parts)
    return [n for n in names if n]


def _label(doc: Stretches, div: int, numbered: bool = True) -> str | None:
    """A section's head, or its type; behind its number where that is kept apart."""
    head = next((j for j in doc.inside(div, "head") if doc.parents[j] == div), None)
    label = (doc.text(head) if head is not None else None) or doc.attributes[div].get("type")
    number = doc.attributes[head].get("n", "").strip() if head is not None and numbered else ""
    return label if label and label.startswith(number.rstrip(".")) else " ".join(filter(None, (number, label))) or None


def _sections(doc: Stretches, leaves: bool) -> list[dict]:
    """The sections of the body with their paragraphs; as leaves, one with parts is followed by its parts and keeps what it says itself."""
    body = doc.at(-1, "text/body")
    out = []
    for div in [d for b in body for d in doc.inside(b, "div") if doc.parents[d] == b]:
        parts = [d for d in doc.inside(div, "div") if doc.parents[d] == div] if leaves else []
        name, paragraphs = _label(doc, div), doc.inside(div, "p")
        rows = [(name, [p for p in paragraphs if not parts or doc.parents[p] == div])]
        rows += [(" › ".join(filter(None, (name, _label(doc, part)))) or None, doc.inside(part, "p")) for part in parts]
        out += [{"label": label, "text": text} for label, inner in rows if (text := " ".join(filter(None, map(doc.text, inner))))]
    return out


def _references(doc: Stretches) -> list[dict]:
    """The entries of the list of references that say something, or all of a document that is but entries."""
    listed = doc.at(-1, "listBibl/biblStruct")
    alone = not doc.by_name.get("teiHeader") and not listed
    out = []
    for place, i in enumerate(doc.by_name.get("biblStruct", []) if alone else listed):
        own = doc.attributes[i]
        found = _told(doc, i, REFERENCE)
        venue = _told(doc, i, {"venue": (WHOLE,)}) if doc.at(i, ARTICLE) else {"venue": None}
        row = {"key": own.get("id") or f"b{place}", **found, **venue, "year": _year(doc, i, REFERENCE_DATES), "authors": _people(doc, i, REFERENCE_PEOPLE), "coords": own.get("coords")}
        if alone or row["raw"] or row["title"] or row["doi"]:
            out.append(row)
    return out


def _mentions(doc: Stretches) -> list[dict]:
    """What the body cites: the sentence of each mark, or its paragraph where there are no sentences, where in it the mark stands, and the sentences beside."""
    out = []
    for i in doc.at(-1, "text//body//ref@bibr"):
        key = doc.attributes[i].get("target", "").strip().removeprefix("#")
        if not key:
            continue
        sentence, section = doc.above(i, "s"), doc.above(i, "div")
        around = [] if sentence is None else [j for j in doc.inside(doc.parents[sentence], "s") if doc.parents[j] == doc.parents[sentence]]
        place = around.index(sentence) if around else 0
        holder = sentence if sentence is not None else doc.above(i, "p")
        lead = doc.text(holder, doc.start[i]) if holder is not None else None
        out.append({
            "key": key,
            "marker": doc.text(i),
            "section": _label(doc, section, numbered=False) if section is not None else None,
            "before": doc.text(around[place - 1]) if place else None,
            "sentence": doc.text(holder) if holder is not None else None,
            "after": doc.text(around[place + 1]) if place + 1 < len(around) else None,
            "offset": len(lead) + 1 if lead else 0,
            "coords": doc.attributes[i].get("coords"),
        })
    return out


_SECTION = pa.struct([("label", pa.string()), ("text", pa.string())])
_REFERENCE = pa.struct([("key", pa.string()), ("raw", pa.string()), ("title", pa.string()), ("venue", pa.string()), ("doi", pa.string()), ("arxiv", pa.string()), ("year", pa.int32()), ("authors", pa.list_(pa.string())), ("coords", pa.string())])
_MENTION = pa.struct([("key", pa.string()), ("marker", pa.string()), ("section", pa.string()), ("before", pa.string()), ("sentence", pa.string()), ("after", pa.string()), ("offset", pa.int32()), ("coords", pa.string())])
_FIELDS = {"title": pa.string(), "abstract": pa.string(), "doi": pa.string(), "venue": pa.string(), "year": pa.int32(), "authors": pa.list_(pa.string()), "sections": pa.list_(_SECTION), "leaves": pa.list_(_SECTION), "references": pa.list_(_REFERENCE), "mentions": pa.list_(_MENTION)}
_DDL = (
    "title string, abstract string, doi string, venue string, year int, authors array<string>, sections array<struct<label:string,text:string>>, leaves array<struct<label:string,text:string>>, "
    "references array<struct<key:string,raw:string,title:string,venue:string,doi:string,arxiv:string,year:int,authors:array<string>,coords:string>>, "
    "mentions array<struct<key:string,marker:string,section:string,before:string,sentence:string,after:string,offset:int,coords:string>>"
)


def record(text: str | None) -> dict:
    """All that a document says; a malformed one says nothing."""
    try:
        doc = Stretches(text or "")
    except expat.ExpatError:
        return {**dict.fromkeys(("title", "abstract", "doi", "venue", "year")), **{name: [] for name in ("authors", "sections", "leaves", "references", "mentions")}}
    return {
        **_told(doc, -1, HEADER),
        "year": _year(doc, -1, HEADER_DATES),
        "authors": _people(doc, -1, HEADER_PEOPLE),
        "sections": _sections(doc, leaves=False),
        "leaves": _sections(doc, leaves=True),
        "references": _references(doc),
        "mentions": _mentions(doc),
    }


def boxes(coords: Column) -> Column:
    """Boxes (page, x, y, w, h) of `page,x,y,w,h;...`; malformed ones are passed over."""
    parts = F.transform(F.split(coords, ";"), lambda box: F.transform(F.split(box, ","), lambda x: F.trim(x).try_cast("double")))
    whole = F.filter(parts, lambda p: (F.size(p) == 5) & F.forall(p, lambda x: x.isNotNull()))
    return F.coalesce(F.transform(whole, lambda p: F.struct(p[0].cast("int").alias("page"), p[1].alias("x"), p[2].alias("y"), p[3].alias("w"), p[4].alias("h"))), F.array())


def read_tei_records(rows: DataFrame, text: str = "text") -> DataFrame:
    """title, abstract, doi, venue, year, authors, sections, leaves, references and mentions of TEI documents, beside the other columns."""
    kept = [c for c in rows.columns if c != text]

    def run(batches):
        for batch in batches:
            found = [record(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([f[n] for f in found], kind) for n, kind in _FIELDS.items())], names=[*kept, *_FIELDS])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)
    # Parsing is dear, and a table of one file is one task's.
    read = spread(rows.select(*kept, text), most=COSTLY).mapInArrow(run, ", ".join(filter(None, [schema, _DDL])))

    def with_boxes(items: str) -> Column:
        return F.transform(items, lambda x: x.withField("boxes", boxes(x["coords"])).dropFields("coords"))

    return read.withColumns({"references": with_boxes("references"), "mentions": F.transform(with_boxes("mentions"), lambda m: m.withField("page", F.get(m["boxes"], F.lit(0))["page"]))})
