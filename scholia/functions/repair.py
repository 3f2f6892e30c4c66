"""Repairs of extracted text, and labels and titles by their form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import distinct_paragraphs, single_ligatures, without_production_marks

#: Label words of captions and of mathematical statements, each before its short forms.
VISUAL_LABELS = ["figure", "fig.", "fig", "table", "tab.", "tab", "tbl.", "algorithm", "alg.", "alg", "listing", "pseudocode", "procedure", "code", "plate", "scheme", "chart", "graph", "diagram"]
STATEMENT_LABELS = [
    "definition", "defn.", "def.", "proposition", "prop.", "corollary", "corol.", "cor.", "conjecture", "conj.", "assumption", "observation", "theorem", "thm.", "example", "ex.", "exercise", "property",
    "remark", "rem.", "lemma", "lem.", "claim", "axiom", "proof", "tip",
]
#: Quotation marks as some fonts' encodings give them, and what was meant.
MOJIBAKE = {"\u00e2\u0141\u2122": "\u2019", "\u00e2\u0141\u201c": "\u201c", "\u00e2\u0141\u201d": "\u201d"}
#: Bytes of a formula, and of what it raises, from which it may be a drop cap; spaces of prose; least shares of letters.
DROP_CAP_BYTES, RAISED_BYTES, PROSE_SPACES, PROSE_SHARE, RUN_SHARE = 55, 50, 5, 0.7, 0.8
#: Hosts whose files may be fetched directly.
DIRECT_HOSTS = ["arxiv.org", "europepmc.org", "biorxiv.org", "medrxiv.org", "ncbi.nlm.nih.gov", "peerj.com", "mdpi.com", "frontiersin.org", "plos.org"]


def _alternatives(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def label(text: Column) -> Column:
    """The label word a block opens with, or null.

    A label stands alone in a short block, or before a space, mark or digit; one of a figure or table
    needs a number and then a mark, or few words: else it is prose about the figure.
    """
    low = F.lower(F.ltrim(text))
    word = F.regexp_extract(low, rf"^({_alternatives(VISUAL_LABELS + STATEMENT_LABELS)})(?=$|[ .:\d-])", 1)
    rest = F.trim(F.substring(low, F.length(word) + 1, F.length(low)))
    caption = rest.rlike(r"^[.:]?\s*[\divxlc]+(?:\.\d+)*[a-z]?\s*[.:)*]") | ((F.length(rest) < 80) & rest.rlike(r"^[.:]?\s*\d"))
    good = F.when(word.isin(VISUAL_LABELS), caption).otherwise((rest != "") | (F.length(F.trim(text)) < 80))
    return F.when((word != "") & good, word)


def drop_cap(text: Column) -> Column:
    """The paragraph that a formula such as ``P^{hysics is...}`` was before its first letter was taken for a base; null if it is a formula.

    What is raised or lowered is prose if it is long, has spaces and hardly anything but letters, and no
    command; without spaces it is one run of words, which are set apart at their capitals.
    """
    whole = F.trim(text)
    raised = F.regexp_extract(whole, r"^(?s)[A-Z][\^_]\{(.*)\}", 1)
    size, letters = F.octet_length(raised), F.length(F.regexp_replace(raised, r"[^\p{IsAlphabetic}]", ""))
    spaces = F.length(raised) - F.length(F.replace(raised, F.lit(" "), F.lit("")))
    apart = F.regexp_replace(raised, r"(?<=\p{IsLowercase})(?=\p{IsUppercase})", " ")
    prose = (spaces >= PROSE_SPACES) & ~F.contains(raised, F.lit("\\")) & ((letters + spaces) / size >= PROSE_SHARE)
    run = (spaces < PROSE_SPACES) & (size > RAISED_BYTES) & (letters / size > RUN_SHARE)
    found = F.when(prose, raised).when(run, apart)
    return F.when((F.octet_length(whole) >= DROP_CAP_BYTES) & (size >= RAISED_BYTES), F.concat(F.substring(whole, 1, 1), found))


def without_mojibake(text: Column) -> Column:
    """Quotation marks set right; a lone \u0141 between letters or digits is an apostrophe."""
    for wrong, right in MOJIBAKE.items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return F.regexp_replace(text, "(?<=[\\p{IsAlphabetic}\\p{N}])\u0141(?=[\\p{IsAlphabetic}\\p{N}])", "\u2019")


def clean_block(text: Column) -> Column:
    """A block's text after all its repairs, in their order: drop cap, doubled ligatures, production marks, repeated paragraphs."""
    formula = F.contains(text, F.lit("^{")) | F.contains(text, F.lit("_{"))
    text = F.when(formula, F.coalesce(drop_cap(text), text)).otherwise(text)
    return distinct_paragraphs(without_production_marks(single_ligatures(text)))


def single_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t]+", " "))


def joined_hyphens(text: Column) -> Column:
    """Words cut at a line's end, joined; lines become spaces."""
    return F.regexp_replace(F.regexp_replace(text, r"(\p{Ll})-\n(\p{Ll})", "$1$2"), r"\s*\n\s*", " ")


def spaced_letters(text: Column) -> Column:
    """``A B S T R A C T`` as one word."""
    return F.when(text.rlike(r"^(?:\p{Lu} ){3,}\p{Lu}$"), F.replace(text, F.lit(" "), F.lit(""))).otherwise(text)


def is_all_caps(text: Column) -> Column:
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    return (F.length(letters) >= 2) & (letters == F.upper(letters))


def title_match(a: Column, b: Column) -> Column:
    """Titles that are equal without numbering and marks, or of which one opens with the other, or that share over 80 % of the shorter one's words."""
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s*(?:chapter\s+)?[\dA-Z]+(?:\.\d+)*\.?\s+", ""), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))
    x, y = clean(a), clean(b)
    wx, wy = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    share = F.size(F.array_intersect(wx, wy)) / F.least(F.size(wx), F.size(wy))
    return (x != "") & (y != "") & ((x == y) | ((F.least(F.length(x), F.length(y)) >= 8) & (x.startswith(y) | y.startswith(x))) | (share > 0.8))


def font_family(name: Column) -> Column:
    """A font's family without subset tag, style and size."""
    bare = F.regexp_replace(name, r"^[A-Z]{6}\+", "")
    return F.regexp_replace(bare, r"(?i)[-,]?(?:bold|italic|oblique|regular|medium|light|roman|semibold|black|ps|mt|it|bd)*\d*$", "")


def size_bucket(size: Column) -> Column:
    return F.round(size * 2).cast("int")


def bold_label(text: Column) -> Column:
    """``**Label**.`` and ``** Label **`` set right."""
    return F.regexp_replace(F.regexp_replace(text, r"\*\*\s*([^*]+?)\s*\*\*", r"**$1**"), r"\*\*([.:])", r"$1**")


def may_fetch(url: Column) -> Column:
    return url.rlike(_alternatives(DIRECT_HOSTS))


def fetch_candidates(*urls: Column) -> Column:
    """Distinct urls that may be fetched, in the order given."""
    return F.filter(F.array_distinct(F.array_compact(F.array(*urls))), may_fetch)


def full_id(prefix: str, ident: Column) -> Column:
    """An id as its address, whatever of it is given."""
    return F.concat(F.lit(prefix), F.regexp_extract(ident, r"([^/]*)$", 1))
