"""Statistics across a document's pages: running text, margin stamps, watermarks, fonts, heading levels, columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered

#: Pages on which text repeats to count as running; lengths in bytes; shares of the page that are margin.
PAGES, SECTION_BYTES, PARAGRAPH_BYTES, STAMP_CHARS = 3, (3, 150), (10, 150), (3, 80)
TOP, BOTTOM, SIDE = 0.12, 0.85, 0.18


def text_key(text: Column) -> Column:
    return F.lower(F.trim(text))


def running_text(sections: DataFrame, paragraph: str = "\n") -> DataFrame:
    """doc, key, pages of section texts and paragraphs that stand on at least three pages."""
    whole = sections.select("doc", "page", text_key(F.col("text")).alias("key")).where(F.octet_length("key").between(*SECTION_BYTES))
    parts = sections.select("doc", "page", F.explode(F.split("text", paragraph)).alias("p")).select("doc", "page", text_key(F.col("p")).alias("key")).where(F.octet_length("key").between(*PARAGRAPH_BYTES))
    return whole.union(parts).distinct().groupBy("doc", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= PAGES)


def without_running_text(sections: DataFrame) -> DataFrame:
    """Sections whose whole text doesn't run across pages."""
    found = running_text(sections).select("doc", "key")
    return sections.withColumn("key", text_key(F.col("text"))).join(found, ["doc", "key"], "left_anti").drop("key")


def stamp_key(text: Column) -> Column:
    """Letters and single spaces only, lower case."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\s]", ""), r"\s+", " "))


def in_margin() -> Column:
    """Regions (y1, y2, x1, x2, height, width) near an edge."""
    return (F.col("y1") < TOP * F.col("height")) | (F.col("y2") > BOTTOM * F.col("height")) | (F.col("x2") < SIDE * F.col("width")) | (F.col("x1") > (1 - SIDE) * F.col("width"))


def margin_stamps(regions: DataFrame) -> DataFrame:
    """doc, key, pages of margin texts on three pages; of a stamp and its openings the shortest stays, if it has ten characters or opens none."""
    rows = regions.where(in_margin()).select("doc", "page", stamp_key(F.col("text")).alias("key")).where(F.length("key").between(*STAMP_CHARS))
    found = rows.distinct().groupBy("doc", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= PAGES)
    # A stamp's openings are looked up by equality: each key gives its own prefixes, at most 80.
    openings = found.select("doc", "key", F.explode(F.sequence(F.lit(1), F.length("key") - 1)).alias("n")).where("n < length(key)").select("doc", F.expr("substring(key, 1, n)").alias("opening"), F.col("key").alias("longer"))
    pairs = openings.join(found.select("doc", F.col("key").alias("opening")), ["doc", "opening"])
    short_prefix = pairs.where(F.length("opening") < 10).select("doc", F.col("opening").alias("key")).distinct()
    candidates = found.join(short_prefix, ["doc", "key"], "left_anti")
    covered = pairs.join(candidates.select("doc", F.col("key").alias("opening")), ["doc", "opening"]).select("doc", F.col("longer").alias("key")).distinct()
    return candidates.join(covered, ["doc", "key"], "left_anti")


def running_headers(regions: DataFrame, least: int = 4) -> DataFrame:
    """doc, key, times of page-edge texts that come at least ``least`` times: each page's topmost, its lowest, and those in the margins.

    A region that is topmost and in the margin counts twice, as the rule has it.
    """
    rows = regions.withColumn("key", stamp_key(F.col("text"))).where("key <> ''")
    edge = lambda order: rows.withColumn("n", F.row_number().over(Window.partitionBy("doc", "page").orderBy(*order))).where("n = 1").select("doc", "page", "key")
    margin = rows.where((F.col("y1") < TOP * F.col("height")) | (F.col("y2") > BOTTOM * F.col("height"))).select("doc", "page", "key")
    every = edge([F.col("y1"), F.col("x1"), F.col("key")]).unionAll(edge([F.desc("y2"), F.col("x1"), F.col("key")])).unionAll(margin)
    return every.groupBy("doc", "key").agg(F.count("*").alias("times")).where(F.col("times") >= least)


def watermarks(lines: DataFrame, share: float = 0.5, least_pages: int = 5) -> DataFrame:
    """doc, key, pages of lines of 5 to 40 characters on more than half of at least five pages."""
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("all_pages"))
    rows = lines.select("doc", "page", F.trim("text").alias("key")).where(F.length("key").between(5, 40)).distinct()
    found = rows.groupBy("doc", "key").agg(F.count("*").alias("pages")).join(pages, "doc")
    return found.where((F.col("all_pages") >= least_pages) & (F.col("pages") > share * F.col("all_pages"))).drop("all_pages")


#: Openings and parts of names of fonts that hold symbols, not text; bytes of a sample and of its opening; raw names of a font kept.
SYMBOL_OPENINGS = ["CMMI", "CMSY", "CMEX", "LMMI", "LMSY", "NEWPXMI", "PXMI", "PXSY", "TXEX", "TXSY", "PXEX", "TXMI", "MSAM", "MSBM", "EUSM", "EUFM", "RSFS", "STMARY", "WASY", "LCIRCLE", "LINE", "WINGDING"]
SYMBOL_PARTS = ["MATH", "SYMBOL", "DINGBAT", "ARROW"]
SAMPLE_BYTES, SAMPLE_OPENING, RAW_NAMES = 60, 57, 3
#: Characters under a heading from which it needs no number; the forms of a number; titles of front and back matter.
LEAST_CONTAINED = 2000
NUMBERED = r"^\s*(?:\d+(?:[.\-][A-Za-z0-9]+)*|[A-Z]\d+(?:[.\-][A-Za-z0-9]+)*|[A-Z](?:[.\-][A-Za-z0-9]+)+|[A-Z]|[IVXLCDM]{2,})\s+[a-zA-Z]"
MATTER = [
    "contents", "table of contents", "preface", "foreword", "index", "subject index", "author index", "name index", "keyword index", "figures", "list of figures", "tables", "list of tables", "list of algorithms",
    "bibliography", "references", "glossary", "glossary of symbols", "glossary of notation", "notation", "list of symbols", "acknowledgements", "acknowledgments",
]


def holds_symbols(name: Column) -> Column:
    """Whether a font's name says that it holds symbols; an empty or null name says nothing."""
    return F.coalesce(F.upper(name).rlike(rf"^(?:{'|'.join(SYMBOL_OPENINGS)})|{'|'.join(SYMBOL_PARTS)}"), F.lit(False))


def font_table(segments: DataFrame) -> DataFrame:
    """doc, family, bucket with characters, segments, the upper median of heights (the sorted heights' element at half), and pages.

    Where segments have a ``raw_name``, also the first three raw names, whether one of them holds symbols, and,
    of fonts that hold text, a sample: the first segment that is not blank, its opening if it is long.
    """
    heights = F.array_sort(F.collect_list("height"))
    named = "raw_name" in segments.columns
    more = [F.array_sort(F.collect_list(F.struct("page", "seq", "raw_name", "text"))).alias("rows")] if named else []
    rows = segments.groupBy("doc", "family", "bucket").agg(F.sum(F.length("text")).cast("long").alias("chars"), F.count("*").alias("segments"), F.countDistinct("page").alias("pages"), heights.alias("h"), *more)
    rows = rows.withColumn("height", F.element_at("h", (F.floor(F.size("h") / 2) + 1).cast("int"))).drop("h")
    if not named:
        return rows
    rows = rows.withColumn("raw_names", F.slice(F.array_distinct(F.transform("rows", lambda r: r["raw_name"])), 1, RAW_NAMES))
    rows = rows.withColumn("is_math", F.exists("raw_names", holds_symbols))
    first = F.get(F.filter("rows", lambda r: F.trim(r["text"]) != ""), F.lit(0))["text"]
    sample = F.when(F.octet_length(first) > SAMPLE_BYTES, F.concat(F.substring(first, 1, SAMPLE_OPENING), F.lit("..."))).otherwise(first)
    return rows.withColumn("sample", F.when(~F.col("is_math"), sample)).drop("rows")


def body_font(fonts: DataFrame) -> DataFrame:
    """doc and the font of most characters among those that hold text; ties by family and bucket."""
    w = Window.partitionBy("doc").orderBy(F.desc("chars"), "family", "bucket")
    rows = fonts.where(~F.col("is_math")) if "is_math" in fonts.columns else fonts
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("doc", "family", "bucket", "chars", "height")


def heading_levels(fonts: DataFrame, pages: DataFrame, most: int = 10, candidates: DataFrame | None = None) -> DataFrame:
    """doc, family, bucket, level: fonts of headings, tallest first.

    A font must stand on two pages and in five segments, in long documents (50 pages) on four and in ten. One that
    comes too seldom is taken up all the same if it is taller than every font that comes often enough.
    Taller fonts than the body's come first, of equal ones that of fewer characters; ``candidates`` (a font
    table of segments that may be headings for other reasons) may also hold shorter ones, which follow by
    fewer characters.  Fonts of under ten characters, and those beyond ``most`` levels, have none.
    """
    body = body_font(fonts).select("doc", F.col("height").alias("body_height"))
    rows = (fonts if candidates is None else candidates).join(body, "doc").join(pages, "doc")
    long, taller = F.col("n_pages") >= 50, F.col("height") > F.col("body_height")
    rows = rows.where((F.col("pages") >= F.when(long, 4).otherwise(2)) & (taller | F.lit(candidates is not None)))
    rows = rows.withColumns({"taller": taller, "often": F.col("segments") >= F.when(long, 10).otherwise(5)})
    tallest = F.coalesce(F.max(F.when(F.col("often") & F.col("taller"), F.col("height"))).over(Window.partitionBy("doc")), F.lit(0.0))
    rows = rows.withColumn("tallest", tallest).where(F.col("often") | (F.col("taller") & (F.col("height") > F.col("tallest")))).where(F.col("chars") >= 10)
    w = Window.partitionBy("doc").orderBy(F.desc("taller"), F.desc(F.when(F.col("taller"), F.col("height"))), "chars", "family", "bucket")
    return rows.withColumn("level", F.row_number().over(w)).where(F.col("level") <= most).select("doc", "family", "bucket", "level")


def is_matter(title: Column) -> Column:
    """Whether a heading, from its first letter on, names front or back matter."""
    return F.lower(F.trim(F.regexp_replace(title, r"^[^A-Za-z]*", ""))).isin(MATTER)


def substantial_headings(headings: DataFrame) -> DataFrame:
    """Headings (title, chars) with enough text under them, or a number before them, or the name of front or back matter."""
    return headings.where((F.col("chars") >= LEAST_CONTAINED) | F.trim("title").rlike(NUMBERED) | is_matter(F.col("title")))


def contained_characters(headings: DataFrame, segments: DataFrame) -> DataFrame:
    """doc, seq, chars of what stands under each heading up to the next of the same or a smaller depth: one pass in order."""
    return ordered.contents(headings, segments)


def repeated_headings(headings: DataFrame, least: int = 3) -> DataFrame:
    """doc, depth, pattern of headings that, digits aside, stand on at least three pages."""
    rows = headings.withColumn("pattern", F.regexp_replace(F.lower(F.trim("text")), r"\d+", "#"))
    return rows.groupBy("doc", "depth", "pattern").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= least)


def auto_numbered(headings: DataFrame, most: float = 0.3) -> DataFrame:
    """doc, depth, auto: depths of which under three in ten headings carry numbers are numbered by us."""
    rows = headings.groupBy("doc", "depth").agg(F.avg(F.when(F.col("text").rlike(r"^\s*(?:\d+|[A-Z])(?:\.\d+)*\.?\s"), 1.0).otherwise(0.0)).alias("share"))
    return rows.select("doc", "depth", (F.col("share") < most).alias("auto"))


def column_gaps(glyphs: DataFrame, least_width: int = 8, share: float = 0.1) -> DataFrame:
    """doc, page, gap_start, gap_end: runs of one-point bins, inside the text's extent, that hold few glyph centres."""
    bins = glyphs.groupBy("doc", "page", F.floor("cx").alias("bin")).agg(F.count("*").alias("n"))
    span = bins.groupBy("doc", "page").agg(F.min("bin").alias("low"), F.max("bin").alias("high"), F.max("n").alias("top"))
    every = span.select("doc", "page", "top", F.explode(F.sequence("low", "high")).alias("bin")).join(bins, ["doc", "page", "bin"], "left")
    few = every.where(F.coalesce("n", F.lit(0)) <= share * F.col("top"))
    w = Window.partitionBy("doc", "page").orderBy("bin")
    runs = few.withColumn("run", F.col("bin") - F.row_number().over(w)).groupBy("doc", "page", "run").agg(F.min("bin").alias("gap_start"), F.max("bin").alias("gap_end"))
    return runs.where(F.col("gap_end") - F.col("gap_start") + 1 >= least_width).drop("run")


def font_runs(glyphs: DataFrame) -> DataFrame:
    """doc, page, run, family, text of neighbouring glyphs in one font."""
    w = Window.partitionBy("doc", "page").orderBy("seq")
    changed = F.when(F.lag("family").over(w) == F.col("family"), 0).otherwise(1)
    rows = glyphs.withColumn("run", changed)
    rows = rows.withColumn("run", F.sum("run").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc", "page", "run").agg(F.first("family").alias("family"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda g: g["text"]), "").alias("text"))


def inferred_depths(headings: DataFrame) -> DataFrame:
    """Headings with a depth: a number's own, else one below the last numbered heading before."""
    numbered = F.when(F.col("number").isNotNull(), F.size(F.split("number", r"\.")))
    w = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return headings.withColumn("own", numbered).withColumn("depth", F.coalesce("own", F.last("own", True).over(w) + 1, F.lit(1))).drop("own")


def tree_parents(headings: DataFrame) -> DataFrame:
    """doc, seq, parent_seq of each place: the last heading before with a smaller depth than its deepest, in one pass in order."""
    return ordered.nested(headings.withColumn("value", F.lit(None).cast("int")), merged=True).select("doc", "seq", "parent_seq")


def numeric_summary(rows: DataFrame, kind: str, value: str) -> DataFrame:
    """Count, median (mean of the middle two), least, greatest and deviation by kind."""
    return rows.groupBy(kind).agg(F.count(value).alias("n"), F.percentile(value, 0.5).alias("median"), F.min(value).alias("low"), F.max(value).alias("high"), F.stddev_samp(value).alias("deviation"))
