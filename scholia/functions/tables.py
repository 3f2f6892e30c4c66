"""HTML tables as Markdown, with spans filled."""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ROW = re.compile(r"<tr\b[^>]*>(.*?)(?=</tr>|<tr\b|</table>|\Z)", re.S | re.I)
_CELL = re.compile(r"<(t[dh])\b([^>]*)>(.*?)(?=</\1>|<t[dh]\b|\Z)", re.S | re.I)


def grid(html: str) -> list[list[str]]:
    """Rows of cells; a cell that spans stands in each place it covers."""
    out: list[dict[int, str]] = []
    open_: dict[int, tuple[int, str]] = {}
    for row in _ROW.findall(html or ""):
        places: dict[int, str] = {}
        for k, (left, text) in list(open_.items()):
            places[k] = text
            open_[k] = (left - 1, text)
            if left <= 1:
                del open_[k]
        at = 0
        for _, attributes, inner in _CELL.findall(row):
            span = lambda name: int(m[1]) if (m := re.search(rf"{name}\s*=\s*[\"']?(\d+)", attributes, re.I)) else 1  # noqa: B023, E731
            text = " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", inner)).split()).replace("|", "\\|")
            for _ in range(max(1, span("colspan"))):
                while at in places:
                    at += 1
                places[at] = text
                if (down := span("rowspan")) > 1:
                    open_[at] = (down - 1, text)
        out.append(places)
    width = max((max(p) + 1 for p in out if p), default=0)
    return [[p.get(k, "") for k in range(width)] for p in out]


def markdown(html: str | None) -> str:
    """A Markdown table; its header is the first row.  Without rows: empty."""
    rows = grid(html or "")
    if not rows or not rows[0]:
        return ""
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])


def table_markdown(html: Column) -> Column:
    """``markdown`` over a column: spans need a grid, which no built-in function keeps."""

    @F.pandas_udf("string")
    def convert(cells: pd.Series) -> pd.Series:
        return cells.map(markdown)

    return convert(html)
