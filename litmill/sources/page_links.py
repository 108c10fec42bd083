"""Where web pages lead to a paper's file.

A page is cut into tags and the text between them by one pattern; quotes of
either kind, none, entities, comments and tags that never end are taken as they
come.  Links are told by four kinds of places, best first: metadata, alternates,
anchors by what speaks for and against them, and addresses inside scripts.
"""

from __future__ import annotations

import json
import re
from html import unescape
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

#: Names of metas that name the file, and the type of files.
METAS = ("citation_pdf_url", "eprints.document_url")
FILE_TYPE = "application/pdf"
#: What is looked at in an anchor (its address, its label: class, id, aria-label and title together, its type), what is looked for, and what it counts.
SIGNS = (
    ("href", re.compile(r"\.pdf($|[?#])|/pdf(/|$|\?)|[?&]type=printable", re.IGNORECASE), 3),
    ("label", re.compile("pdf", re.IGNORECASE), 2),
    ("label", re.compile("download|full[-_ ]?text|fulltext", re.IGNORECASE), 2),
    ("type", re.compile(f"^{FILE_TYPE}$", re.IGNORECASE), 3),
)
#: What the text of an anchor counts, once.
TEXT = re.compile(r"\b(download|view|get|full[- ]?text)?\s*(article\s+)?pdf\b", re.IGNORECASE), 3
#: Other files than the paper, and what they count: once for an address or label, and for each stretch of text up to one that counts.
OTHERS = re.compile(r"supplement|suppl|appendix|sample|preview|toc|front[-_ ]?matter|cover|erratum|correction|checklist|permission|citation|bibtex|ris\b|epub|slides", re.IGNORECASE), -6
#: What an anchor needs, links of a page, letters of scripts that are looked at, and addresses in scripts.
NEEDED, MOST, SCRIPTS = 3, 5, 3 * 1024 * 1024
IN_SCRIPT = re.compile(r"https?://[^\s\"'<>\\]+?(?:\.pdf(?:[?#][^\s\"'<>\\]*)?|/pdfft\?[^\s\"'<>\\]*)", re.IGNORECASE)
#: The address that a state object with pii, queryParams (md5, pid), path and pdfExtension stands for.
STATE = "https://www.sciencedirect.com/{path}/{pii}{extension}?md5={md5}&pid={pid}"
STATE_PATH, STATE_EXTENSION = "science/article/pii", "/pdfft"
#: Addresses that lead nowhere.
NOWHERE = ("javascript:", "mailto:", "#")

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:"[^"]*"|'[^']*'|[^>"'])*)>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Elements whose content is no markup.
_RAW = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style")}


def markup(html: str):
    """(kind, name, attributes or text) of a page in order: begin, end, text, and raw for the content of scripts and styles."""
    at = 0
    while at < len(html):
        tag = _MARKUP.search(html, at)
        if not tag:
            yield "text", "", unescape(html[at:])
            return
        if tag.start() > at:
            yield "text", "", unescape(html[at : tag.start()])
        at = tag.end()
        if not tag["name"]:
            continue
        name = tag["name"].lower()
        if tag["end"]:
            yield "end", name, ""
            continue
        yield "begin", name, {k.lower(): unescape(a or b or c) for k, a, b, c in reversed(_ATTRIBUTE.findall(tag["attributes"]))}
        if name in _RAW:
            close = _RAW[name].search(html, at)
            yield "raw", name, html[at : close.start() if close else len(html)]
            at = close.end() if close else len(html)


def _score(attributes: dict) -> int:
    seen = {"href": attributes.get("href", ""), "label": " ".join(attributes.get(k, "") for k in ("class", "id", "aria-label", "title")), "type": attributes.get("type", "")}
    pattern, loss = OTHERS
    return sum(gain for where, sign, gain in SIGNS if sign.search(seen[where])) + (loss if pattern.search(seen["href"]) or pattern.search(seen["label"]) else 0)


def _of_state(text: str) -> list[str]:
    """Addresses that the objects of a JSON state stand for, in order."""
    try:
        left = [json.loads(text)]
    except (ValueError, RecursionError):
        return []
    found = []
    while left:
        value = left.pop()
        if isinstance(value, dict):
            query = value.get("queryParams")
            if isinstance(value.get("pii"), str) and isinstance(query, dict) and query.get("md5") and query.get("pid"):
                found.append(STATE.format(path=str(value.get("path") or STATE_PATH).strip("/"), pii=value["pii"], extension=value.get("pdfExtension") or STATE_EXTENSION, md5=query["md5"], pid=query["pid"]))
            value = list(value.values())
        if isinstance(value, list):
            left += reversed(value)
    return found


def told(html: str) -> list[tuple[str, str, int | None]]:
    """(kind, address, score) of all links of a page to files, best first: meta, alternate, anchor, script."""
    ranks: dict[str, list] = {"meta": [], "alternate": [], "anchor": [], "script": []}
    address, score, counted, read = None, 0, False, 0
    for kind, name, value in markup(html):
        if kind == "begin" and name == "meta" and value.get("name", "").lower() in METAS and value.get("content"):
            ranks["meta"].append((value["content"], None))
        elif kind == "begin" and name == "link" and "alternate" in value.get("rel", "").lower() and value.get("type", "").lower() == FILE_TYPE and value.get("href"):
            ranks["alternate"].append((value["href"], None))
        elif kind == "begin" and name == "a":
            address = value.get("href") or None
            if address and address.startswith(NOWHERE):
                address = None
            score, counted = _score(value), False
        elif kind == "text" and address and not counted and value.strip():
            counted = bool(TEXT[0].search(value))
            score += TEXT[1] * counted + (OTHERS[1] if OTHERS[0].search(value) else 0)
        elif kind == "end" and name == "a" and address:
            ranks["anchor"].append((address, score))
            address = None
        elif kind == "raw" and name == "script" and read < SCRIPTS:
            text = value[: SCRIPTS - read].replace("\\/", "/")
            read += len(value)
            inside = [u for u in IN_SCRIPT.findall(text) if not OTHERS[0].search(u)]
            ranks["script"] += [(u, None) for u in inside + (_of_state(text) if text.lstrip()[:1] in ("{", "[") else [])]
    ranks["anchor"] = sorted((a for a in ranks["anchor"] if a[1] >= NEEDED), key=lambda a: -a[1])
    return [(kind, address, score) for kind, links in ranks.items() for address, score in links]


def best(html: str | None, url: str | None, most: int = MOST) -> list[tuple[int, str, str, int | None]]:
    """(place, kind, address, score): the best links of a page, absolute, each once, without the page itself."""
    out, seen = [], {url}
    for kind, address, score in told(html or ""):
        try:
            address = urljoin(url or "", address.strip())
            scheme = urlsplit(address).scheme
        except ValueError:  # no address
            continue
        if scheme in ("http", "https") and address not in seen and len(out) < most:
            seen.add(address)
            out.append((len(out), kind, address, score))
    return out


def pdf_links(pages: DataFrame, most: int = MOST) -> DataFrame:
    """(page_id, place, kind, link, score) of pages (page_id, url, html): at most `most` links of each, best first.

    Null and broken pages have those links that can be told; rows that repeat a
    page have theirs each; score is null but for anchors.
    """

    def run(batches):
        for batch in batches:
            rows = [(page, *link) for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True) for link in best(html, url, most)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32()), strict=True)], names=["page_id", "place", "kind", "link", "score"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, "page_id long, place int, kind string, link string, score int")
