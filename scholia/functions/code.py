"""Code, pseudocode, lists and notes among extracted text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs of code, a point each; words that open or close a line of pseudocode.
SIGNS = [r"\b(?:def|class|function|return|import|include|void|int|float|const|var|let)\b", r"[;{}]\s*(?:\n|$)", r"(?:==|!=|<=|>=|\+=|-=|->|=>|::|&&|\|\|)", r"\w+\([^)]*\)", r"^\s{2,}\S", r"//|/\*|^\s*#", r"\w+\[\w+\]"]
KEYWORDS = r"^(?:for |end for|end if|if |while |end while|else|return |repeat|until )|(?:\bdo|\bthen)$"


def code_score(text: Column) -> Column:
    """How many kinds of signs of code a text shows, 0 to 7."""
    return sum((F.when(text.rlike(f"(?m){s}"), 1).otherwise(0) for s in SIGNS[1:]), F.when(text.rlike(f"(?m){SIGNS[0]}"), 1).otherwise(0))


def looks_like_code(text: Column) -> Column:
    """At least 15 characters and three signs; of more than 30 words, five."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return (F.length(F.trim(text)) >= 15) & (code_score(text) >= F.when(n > 30, 5).otherwise(3))


def looks_like_pseudocode(text: Column) -> Column:
    """At least three lines that open or close with the words of pseudocode, line numbers aside."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.trim(F.lower(x)), r"^[\d.]+\s*", ""))
    return F.size(F.filter(lines, lambda x: x.rlike(KEYWORDS))) >= 3


def list_items(text: str) -> tuple[str, list[str]] | None:
    """(numbered or bulleted, items) of a text whose lines are a run from 1, or at least two bullets."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    numbers = [re.match(r"(\d+)[.)]\s+(.*)", x) for x in lines]
    if len(lines) > 1 and all(numbers) and [int(m[1]) for m in numbers] == list(range(1, len(lines) + 1)):
        return "numbered", [m[2] for m in numbers]
    bullets = [re.match(r"[•▪◦*-]\s+(.*)", x) for x in lines]
    return ("bulleted", [m[1] for m in bullets]) if len(lines) > 1 and all(bullets) else None


def footnote_marker(text: Column) -> Column:
    """The marker that opens a note: a number, a letter with a bracket, or a sign; else null."""
    return F.nullif(F.regexp_extract(text, r"^\s*(?:\[(\w{1,3})\]|(\d{1,3})[.)\s]|([*†‡§¶])|([a-z])\))", 0), F.lit(""))


def rendered_list(items: Column, numbered: bool) -> Column:
    return F.array_join(F.transform(items, lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), x) if numbered else F.concat(F.lit("- "), x)), "\n")
