"""Formulas among text, formula tags, and tables from structure tokens."""

from __future__ import annotations

import html
import re

#: Signs that prose lacks, words that formulas lack.
SIGNS = set("=+−∑∏∫√≤≥≈≠∞∂∇∈∉⊂⊆∪∩→←⇒⇔±×÷·^_∀∃αβγδεζηθλμνξπρστφχψωΓΔΘΛΞΠΣΦΨΩ")
_PROSE = re.compile(r"\b[a-zA-Z]{4,}\b")
_FUNCTIONS = {"sqrt", "argmax", "argmin", "softmax", "diag", "trace", "rank", "sinh", "cosh", "tanh", "const", "subject"}
_TAG = re.compile(r"^(?P<body>.*\S)\s*\((?P<tag>\d+(?:\.\d+)*[a-z]?)\)\s*$", re.S)


def prose_words(text: str) -> int:
    return sum(w.lower() not in _FUNCTIONS for w in _PROSE.findall(text))


def looks_like_formula(text: str) -> bool:
    """At least five characters, a sign of maths in eight, and hardly a word of prose."""
    bare = re.sub(r"\s", "", text)
    return len(bare) >= 5 and sum(c in SIGNS for c in bare) * 8 >= len(bare) and prose_words(text) <= 1


def split_tag(text: str) -> tuple[str, str | None]:
    """A formula and the number in brackets at its end."""
    m = _TAG.match(text)
    return (m["body"], m["tag"]) if m and looks_like_formula(m["body"]) else (text, None)


def table_of_tokens(tokens: list[str], cells: list[str]) -> str:
    """HTML of structure tokens: fcel a cell with text, ecel an empty one, lcel one that goes on from the left, ucel from above, xcel from both, nl a row's end, ched and rhed headers."""
    rows: list[list[str]] = [[]]
    for t in tokens:
        if t == "nl":
            rows.append([])
        else:
            rows[-1].append(t)
    rows, texts, out = [r for r in rows if r], iter(cells), []
    at = lambda r, c: rows[r][c] if r < len(rows) and c < len(rows[r]) else ""
    for r, row in enumerate(rows):
        parts = []
        for c, t in enumerate(row):
            if t in ("lcel", "ucel", "xcel"):
                continue
            across = down = 1
            while at(r, c + across) == "lcel":
                across += 1
            while at(r + down, c) == "ucel":
                down += 1
            text = next(texts, "") if t != "ecel" else ""
            name = "th" if t in ("ched", "rhed") else "td"
            spans = (f' colspan="{across}"' if across > 1 else "") + (f' rowspan="{down}"' if down > 1 else "")
            parts.append(f"<{name}{spans}>{html.escape(text, False)}</{name}>")
        out.append(f"<tr>{''.join(parts)}</tr>")
    return f"<table>{''.join(out)}</table>"
