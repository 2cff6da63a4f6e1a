"""HTML to text with the standard parser (no native Spark expression exists)."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose text is dropped.
DROPPED = {"script", "style", "table", "nav"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Text(HTMLParser):
    """Text nodes of the wanted element (by id, else the body), without the dropped elements."""

    def __init__(self, wanted: str | None):
        super().__init__(convert_charrefs=True)
        self.wanted, self.depth, self.inside, self.dropped = wanted, 0, None, 0
        self.nodes: list[str] = []
        self.node = ""

    def flush(self):
        if self.node.strip():
            self.nodes.append(self.node.strip())
        self.node = ""

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag in VOID:
            return
        self.depth += 1
        hit = dict(attrs).get("id") == self.wanted if self.wanted else tag == "body"
        if self.inside is None and hit:
            self.inside = self.depth
        self.dropped += tag in DROPPED

    def handle_endtag(self, tag):
        self.flush()
        if tag in VOID:
            return
        self.dropped = max(0, self.dropped - (tag in DROPPED))
        if self.inside is not None and (tag == "body" or self.depth == self.inside and self.wanted):
            self.inside = None
        self.depth -= 1

    def handle_comment(self, data):
        self.flush()

    def handle_data(self, data):
        if self.inside is not None and not self.dropped:
            self.node += data


def html_to_text(html: str, element_id: str | None = None) -> str:
    parser = _Text(element_id)
    parser.feed(html)
    parser.close()
    parser.flush()
    return "\n\n".join(parser.nodes)


def text_of_html(element_id: str | None = None):
    @F.pandas_udf(T.StringType())
    def batch(html: pd.Series) -> pd.Series:
        return html.map(lambda h: None if h is None else html_to_text(h, element_id))

    return batch
