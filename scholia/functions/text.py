"""Scalar functions over strings, as Column expressions that stay inside the JVM, but for ``inverted_index``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: about how many words are indexed at once.
MOST_WORDS = 500_000
#: Preview lengths, tokens a word, kinds of exhibits by their names in text.
PREVIEW, PREVIEW_MOST, TOKENS_PER_WORD = 120, 300, 1.3
FIGURE = ["figure", "fig", "figures", "figs"]
TABLE = ["table", "tab", "tables", "tabs"]
ALGORITHM = ["algorithm", "alg", "algorithms", "algs", "procedure", "procedures", "pseudocode", "pseudocodes", "listing", "listings", "code", "codes"]
#: Patterns of a caption's number and of mentions, and of an algorithm's header.
CAPTION = r"(?i)(Figure|Fig|Table|Tab|Algorithm|Alg|Procedure|Pseudocode|Listing|Code)\s*\.?\s+(\d+)"
MENTIONS = {
    "figure": r"(?i)(?:Figures?|Figs?)\s*\.?\s+(\d+)",
    "table": r"(?i)(?:Tables?|Tabs?)\s*\.?\s+(\d+)",
    "algorithm": r"(?i)(?:Algorithms?|Algs?|Procedures?|Pseudocodes?|Listings?|Codes?)\s*\.?\s+(\d+)",
}
ALGORITHM_HEADER = r"(?i)^(?:Algorithm|Procedure|Pseudocode|Listing|Code)\s+\d+"
#: Library item types by catalog types; any other is a document.
ITEM_TYPES = {
    "journalArticle": ["article", "journal-article", "review", "review-article", "editorial"],
    "preprint": ["preprint", "posted-content"],
    "book": ["book"],
    "bookSection": ["book-chapter", "book-section"],
    "thesis": ["dissertation", "thesis"],
    "letter": ["letter"],
    "report": ["report", "report-component"],
    "standard": ["standard"],
    "conferencePaper": ["proceedings-article", "proceedings", "conference-paper"],
}
#: Ligatures that extraction doubles, in the order in which they are mended, and those that show that a text has any.
LIGATURES = [("ffiffi", "ffi"), ("fflffl", "ffl"), ("fifi", "fi"), ("flfl", "fl"), ("ffff", "ff")]
SIGNS = ["fifi", "flfl", "ffff"]


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def estimate_tokens(text: Column) -> Column:
    """Words times 1.3, rounded up; null or blank: 0."""
    return F.ceil(F.size(words(F.coalesce(text, F.lit("")))) * F.lit(TOKENS_PER_WORD)).cast("long")


def preview(text: Column) -> Column:
    """At most 120 characters as they are; else up to the first sentence end from there that comes before 300; else 300 and dots."""
    sentence = F.regexp_extract(text, r"(?s)^(.{120,299}?[.?!])(?:\s|\z)", 1)
    return F.when(F.length(text) <= PREVIEW, text).when(sentence != "", sentence).when(F.length(text) > PREVIEW_MOST, F.concat(F.substring(text, 1, PREVIEW_MOST), F.lit("..."))).otherwise(text)


def strip_html(html: Column) -> Column:
    """Without tags and stray ``>``, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>?|>", ""), r"\s+", " "))


def strip_html_keep_math(html: Column) -> Column:
    """As ``strip_html``, with the insides of ``<math>`` between dollars."""
    return strip_html(F.regexp_replace(html, r"(?s)<math[^>]*>(.*?)</math>", r"\$$1\$"))


def attribute(html: Column, name: str) -> Column:
    """The first value of ``name="…"``, or null."""
    return F.nullif(F.regexp_extract(html, rf'{name}="([^"]*)"', 1), F.lit(""))


def exhibit_kind(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.isin(FIGURE), "figure").when(low.isin(TABLE), "table").when(low.isin(ALGORITHM), "algorithm").otherwise(low)


def caption_key(caption: Column) -> Column:
    """struct(kind, number) that a caption names, or null."""
    number = F.regexp_extract(caption, CAPTION, 2).try_cast("int")
    return F.when(number.isNotNull(), F.struct(exhibit_kind(F.regexp_extract(caption, CAPTION, 1)).alias("kind"), number.alias("number")))


def mentions(text: Column) -> Column:
    """Distinct struct(kind, number) that a text refers to: figures, then tables, then algorithms, each in text order."""
    one = lambda kind, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: F.struct(F.lit(kind).alias("kind"), n.try_cast("int").alias("number")))
    return F.array_distinct(F.concat(*[one(k, p) for k, p in MENTIONS.items()]))


def heading_level(html: Column) -> Column:
    """1 to 5 by an opening h tag, else 6."""
    return F.coalesce(F.regexp_extract(html, r"^<[hH]([1-5])", 1).try_cast("int"), F.lit(6))


def heading_title(section: Column, text: Column) -> Column:
    return F.concat_ws(" ", F.nullif(section, F.lit("")), text)


def is_algorithm_header(title: Column) -> Column:
    return title.rlike(ALGORITHM_HEADER)


def is_references_title(title: Column) -> Column:
    return F.lower(title).contains("references") | F.lower(title).contains("bibliography")


def inverted_index(words: Column) -> Column:
    """A map of each row's words to their places, made within the row; null: null."""

    def of(rows: pa.Array) -> pa.Array:
        lengths = rows.value_lengths().fill_null(0).to_numpy()
        row = np.repeat(np.arange(len(rows)), lengths)
        place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        coded = rows.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(row * len(coded.dictionary) + codes, kind="stable")
        row, codes = row[order], codes[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (codes[1:] != codes[:-1])
        first = np.flatnonzero(new)
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(place[order], pa.int32()))
        ends = np.append(0, np.cumsum(np.bincount(row[first], minlength=len(rows))))
        return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), coded.dictionary.take(pa.array(codes[first])), places)

    @F.arrow_udf("map<string, array<int>>")
    def index(rows: pa.Array) -> pa.Array:
        before = np.append(0, np.cumsum(rows.value_lengths().fill_null(0).to_numpy().astype(np.int64))[:-1]) if len(rows) else np.zeros(1, np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(before // MOST_WORDS)) + 1).tolist(), len(rows)]
        return pa.concat_arrays([of(rows[start:end]) for start, end in zip(cuts, cuts[1:])])

    return F.when(words.isNotNull(), index(words))


def inverted_index_text(index: Column) -> Column:
    """A text from a map of words to their places."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x["word"]), " ")


def scripts_to_math(text: Column) -> Column:
    """``<sup>`` and ``<sub>`` as TeX scripts; one space before is taken."""
    up = F.regexp_replace(text, r"(?s) ?<sup[^>]*>(.*?)</sup>", r"\$^{$1}\$")
    return F.regexp_replace(up, r"(?s) ?<sub[^>]*>(.*?)</sub>", r"\$_{$1}\$")


def bare_doi(doi: Column) -> Column:
    """Lower-cased, without an address or scheme before it."""
    return F.lower(F.regexp_replace(doi, r"^(?:https?://(?:dx\.)?doi\.org/|doi:)", ""))


def date_year(date: Column) -> Column:
    """The number before the first dash, or null."""
    return F.split_part(date, F.lit("-"), F.lit(1)).try_cast("int")


def item_type(kind: Column) -> Column:
    out = F.lit("document")
    for name, those in ITEM_TYPES.items():
        out = F.when(kind.isin(those), name).otherwise(out)
    return out


def short_id(full: Column) -> Column:
    """What follows the last slash."""
    return F.regexp_extract(full, r"([^/]*)$", 1)


def single_ligatures(text: Column) -> Column:
    """Doubled ligatures made single, in texts that show a sign of them."""
    mended = text
    for double, single in LIGATURES:
        mended = F.replace(mended, F.lit(double), F.lit(single))
    return F.when(text.rlike("|".join(SIGNS)), mended).otherwise(text)


def without_production_marks(text: Column) -> Column:
    """Without the file, date and time that layout programs print."""
    return F.regexp_replace(text, r"\S*\.indd[0-9/: APM]*", "")


def distinct_paragraphs(text: Column) -> Column:
    """Paragraphs in order, without those that equal the one kept before, or that one of two is the other's opening: of at least 20 bytes and over 0.8 of its length."""

    def echo(a, b):
        short, long = F.least(F.octet_length(a), F.octet_length(b)), F.greatest(F.octet_length(a), F.octet_length(b))
        return (a == b) | ((short >= 20) & (short > long * 0.8) & (F.startswith(a, b) | F.startswith(b, a)))

    step = lambda kept, p: F.when((F.size(kept) > 0) & F.coalesce(echo(F.element_at(kept, F.when(F.size(kept) > 0, F.size(kept)).otherwise(1)), p), F.lit(False)), kept).otherwise(F.concat(kept, F.array(p)))
    parts = F.split(text, "\n\n")
    return F.array_join(F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.slice(parts, 1, 1), step), "\n\n")


def doubled_characters(text: Column) -> Column:
    """A paragraph whose first 40 characters are over 70 % pairs, with each pair made single; others as they are."""
    head = F.regexp_replace(F.substring(text, 1, 40), r"\s", "")
    pairs = F.regexp_count(head, F.lit(r"(\S)\1")) * 2
    return F.when((F.length(head) >= 4) & (pairs > F.length(head) * 0.7), F.regexp_replace(text, r"(\S)\1", "$1")).otherwise(text)


def word_overlap(a: Column, b: Column) -> Column:
    """Shared distinct words over those of the smaller set; an empty one: 0."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def has_leader_dots(line: Column) -> Column:
    """Runs of dots, spaced or not, before a page number."""
    return line.rlike(r"(?:\.\s?){4,}\s*\S{1,8}\s*$")


def roman_value(text: Column) -> Column:
    """The number of a canonical Roman numeral, or null."""
    low = F.lower(text)
    value = lambda c: F.element_at(F.create_map(*[F.lit(x) for p in zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000)) for x in p]), c)
    digits = F.transform(F.split(low, ""), value)
    signed = F.transform(digits, lambda v, k: F.when(v < F.coalesce(F.get(digits, k + 1), F.lit(0)), -v).otherwise(v))
    shape = low.rlike("^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$") & (low != "")
    return F.when(shape, F.aggregate(signed, F.lit(0), lambda a, v: a + v))


def section_key(number: Column) -> Column:
    """``1.4.2`` as an array of numbers, which sorts as sections do."""
    return F.transform(F.split(number, r"\."), lambda p: p.try_cast("int"))


def mapped_page(value: Column, body_offset: Column, front_offset: Column) -> Column:
    """Page index of a printed page: Roman ones are negative."""
    return F.when(value >= 0, value - 1 + body_offset).otherwise(-value - 1 + front_offset)


def lenient_int(text: Column) -> Column:
    """A number from a number or its text; else null."""
    return F.trim(text).try_cast("long")


def request_key(url: Column, pairs: Column, body: Column) -> Column:
    """Key of a cached response: of the url, the sorted query pairs and the body."""
    return F.md5(F.concat_ws("\n", url, F.array_join(F.array_sort(pairs), "&"), F.coalesce(body, F.lit(""))))


def is_doi(text: Column) -> Column:
    return text.rlike(r"^10\..*/")


def is_entity_id(text: Column) -> Column:
    """A prefixed number, a hierarchy's number, or an address that ends with one."""
    return text.rlike(r"^(?:https?://\S+/)?[WATSPIF]\d+$") | text.rlike(r"^(?:(?:domains|fields|subfields)/)?\d+$")


def is_identifier(text: Column) -> Column:
    """Ids that a lookup takes as they are: DOI, PubMed, person, organisation and serial numbers."""
    serial = text.rlike(r"^[0-9]{4}-[0-9]{3}[0-9Xx]$")
    return is_doi(bare_doi(text)) | text.rlike(r"(?i)^pmid:") | text.rlike(r"^(?:https://orcid\.org/)?\d{4}-\d{4}-\d{4}-\d{3}[\dX]$") | text.rlike(r"^(?:https://)?ror\.org/") | serial


def is_item_key(text: Column) -> Column:
    return text.rlike("^[A-Z0-9]{8}$")


def sequence_confidence(log_probabilities: Column) -> Column:
    """exp of the mean log probability; none: 0."""
    n = F.size(log_probabilities)
    return F.when(n > 0, F.exp(F.aggregate(log_probabilities, F.lit(0.0), lambda a, x: a + x) / n)).otherwise(F.lit(0.0))


def argmax(values: Column) -> Column:
    """0-based place of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
