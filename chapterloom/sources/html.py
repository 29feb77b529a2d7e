"""Lenient extraction of text blocks from HTML that need not be well formed."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

BLOCKS = frozenset(["p", "h1", "h2", "h3", "h4", "h5", "h6", "div", "li", "td", "table", "tr", "ul", "ol", "br", "body", "section", "article"])
HIDDEN = frozenset(["script", "style", "head", "title", "template"])


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.tag, self.text, self.hidden = "body", [], 0

    def cut(self, tag: str) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.found.append((self.tag, text))
        self.tag, self.text = tag, []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in BLOCKS:
            self.cut(tag if tag != "br" else self.tag)

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self.cut("body")

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def blocks(html: str) -> list[tuple[str, str]]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.cut("body")
    return parser.found


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, block_order, tag, block_text."""

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, i, t, x) for p, h in zip(frame["page_id"], frame["html"], strict=True) for i, (t, x) in enumerate(blocks(h), 1)]
            yield pd.DataFrame(rows, columns=["page_id", "block_order", "tag", "block_text"])

    return pages.select("page_id", "html").mapInPandas(parsed, "page_id long, block_order int, tag string, block_text string")
