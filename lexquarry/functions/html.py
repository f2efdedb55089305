"""Links of HTML pages, read by a tokenizer that knows comments, scripts, entities and attributes in and out of quotes."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LINK = pa.struct([("href", pa.string()), ("text", pa.string())])
#: Elements whose text is no text of the page.
SILENT = {"script", "style", "template", "noscript"}


class Anchors(HTMLParser):
    """Collects (href, text) of anchors in order; one ends with its end tag, the next anchor, or the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, list[str]]] = []
        self.open, self.silent = False, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._space()
        if tag in SILENT:
            self.silent += 1
        elif tag == "a":
            href = next((v for k, v in attrs if k == "href"), None)
            self.open = href is not None
            if self.open:
                self.found.append((href.strip(), []))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._space()

    def handle_endtag(self, tag: str) -> None:
        self._space()
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "a":
            self.open = False

    def handle_data(self, data: str) -> None:
        if self.open and not self.silent:
            self.found[-1][1].append(data)

    def _space(self) -> None:
        if self.open:
            self.found[-1][1].append(" ")


def anchors(html: str) -> list[tuple[str, str]]:
    parser = Anchors()
    parser.feed(html)
    parser.close()
    return [(href, " ".join("".join(text).split())) for href, text in parser.found]


def links(html: Column) -> Column:
    """array of (href, text) of anchors with an href, in order; text without tags and with single spaces. Empty for a null or empty page."""

    @F.arrow_udf("array<struct<href:string,text:string>>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([[{"href": h, "text": t} for h, t in anchors(x)] if x else [] for x in b.to_pylist()], pa.list_(LINK))

    return read(html)
