"""Each rule by which links of pages are told."""

import pytest

from litmill.sources.page_links import best, pdf_links

BASE = "https://journal.org/a/b.html"
CASES = {
    # what is on the page, and the links with their scores
    "<a href='x.pdf'>text</a>": [("anchor", "https://journal.org/a/x.pdf", 3)],
    '<a href="/pdf/7">text</a>': [("anchor", "https://journal.org/pdf/7", 3)],
    '<a href="/f?id=1&amp;type=printable">t</a>': [("anchor", "https://journal.org/f?id=1&type=printable", 3)],
    '<a href="/f" class="pdf-link">t</a>': [],
    '<a href="/f" class="pdf-link" id=download>t</a>': [("anchor", "https://journal.org/f", 4)],
    '<a href="/f" aria-label="full text" TYPE="Application/PDF">t</a>': [("anchor", "https://journal.org/f", 5)],
    '<a href="/f">Download <b>PDF</b></a>': [("anchor", "https://journal.org/f", 3)],
    '<a href="/f">view article pdf pdf</a>': [("anchor", "https://journal.org/f", 3)],
    '<a href="/f">pdfs</a>': [],
    '<a href="/supplement.pdf" class=pdf>PDF</a>': [],
    '<a href="/x.pdf">Supplementary PDF</a>': [],
    '<a href="/x.pdf" class="pdf download" type=application/pdf>Cover <i>PDF</i></a>': [("anchor", "https://journal.org/x.pdf", 7)],
    '<a href="/a.pdf">a<a href="/b.pdf">b</a>': [("anchor", "https://journal.org/b.pdf", 3)],
    '<a href="/a.pdf">never closed': [],
    '<a name=x>PDF</a><a href="">PDF</a><a href="#pdf">PDF</a><a href="javascript:pdf()">PDF</a><a href="mailto:pdf">PDF</a><a href="ftp://x/y.pdf">PDF</a>': [],
    '<A HREF=/one.pdf>1</A><a href="/two.pdf" title=pdf>2</a><a href=/three.pdf>3</a>': [("anchor", "https://journal.org/two.pdf", 5), ("anchor", "https://journal.org/one.pdf", 3), ("anchor", "https://journal.org/three.pdf", 3)],
    "<link rel='alternate stylesheet' type='application/pdf' href='/l'><meta name=Citation_PDF_URL content=' /m '><meta name='eprints.document_url' content='/e'>": [("meta", "https://journal.org/m", None), ("meta", "https://journal.org/e", None), ("alternate", "https://journal.org/l", None)],
    "<link rel=alternate type=text/html href=/l><link rel=icon type=application/pdf href=/l><meta name=citation_pdf_url>": [],
    '<script>var a = "https:\\/\\/z.org\\/q.pdf?x=1", b = "https://z.org/suppl.pdf", c = "<a href=/s.pdf>";</script>': [("script", "https://z.org/q.pdf?x=1", None)],
    '<script type="application/json">{"a": [{"urlMetadata": {"pii": "S1", "queryParams": {"md5": "m", "pid": "p"}, "path": "/sci/", "pdfExtension": "/pdfft"}}]}</script>': [("script", "https://www.sciencedirect.com/sci/S1/pdfft?md5=m&pid=p", None)],
    '<style>a::after { content: "<a href=/s.pdf>PDF</a>" }</style><!-- <a href="/c.pdf">PDF</a> -->': [],
    '<a href="b.html">PDF</a><a href="/x.pdf">1</a><a href="/x.pdf">2</a>': [("anchor", "https://journal.org/x.pdf", 3)],
    "<a title='a > b' href=\"/x.pdf\">q</a> < b <": [("anchor", "https://journal.org/x.pdf", 3)],
    "".join(f"<a href=/{i}.pdf>x</a>" for i in range(9)): [("anchor", f"https://journal.org/{i}.pdf", 3) for i in range(5)],
    "": [],
}


@pytest.mark.parametrize("html", CASES)
def test_rules(html):
    assert [link[1:] for link in best(html, BASE)] == CASES[html]


def test_pages(spark):
    rows = [(1, BASE, '<a href="x.pdf">p</a>'), (2, None, '<a href="x.pdf">p</a><a href="http://q.org/x.pdf">p</a>'), (3, BASE, None), (None, "no address", "<a href=http://[.pdf>x</a>"), (1, BASE, '<a href="x.pdf">p</a>')]
    got = sorted(tuple(r) for r in pdf_links(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, 0, "anchor", "https://journal.org/a/x.pdf", 3)] * 2 + [(2, 0, "anchor", "http://q.org/x.pdf", 3)]
