"""Main content of HTML by its tag tree, with the standard library's parser (Spark has none)."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements that are never content, and words in a class or id that mark boilerplate.
DROPPED = frozenset("script style nav footer header aside form noscript iframe table".split())
HINTS = ("cookie", "consent", "gdpr", "banner", "subscribe", "newsletter", "sidebar", "breadcrumb", "advert", "promo", "footer", "nav-", "navbar", "menu", "social-share", "related-posts", "comment", "popup", "modal")
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Content(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, str]] = []  # tag, dropped, main part
        self.parts: dict[str, list[str]] = {"": [], "article": [], "main": [], "role": []}

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        values = {k: v or "" for k, v in attrs}
        marked = f"{values.get('class', '')} {values.get('id', '')}".lower()
        outer = self.open[-1] if self.open else ("", False, "")
        dropped = outer[1] or tag in DROPPED or any(h in marked for h in HINTS)
        part = outer[2] or (tag if tag in ("article", "main") else "role" if values.get("role") == "main" else "")
        self.open.append((tag, dropped, part))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        outer = self.open[-1] if self.open else ("", False, "")
        if not outer[1]:
            self.parts[""].append(data)
            if outer[2]:
                self.parts[outer[2]].append(data)


def content(page: str | None) -> str:
    """Texts of the page's article, else its main part, else all of it, one a line, without dropped elements."""
    if not page:
        return ""
    parser = _Content()
    parser.feed(page)
    parser.close()
    parts = next((parser.parts[k] for k in ("article", "main", "role", "") if parser.parts[k]), [])
    return "\n".join(parts)


@F.pandas_udf(StringType())
def tree_content(pages: pd.Series) -> pd.Series:
    return pages.map(content)
