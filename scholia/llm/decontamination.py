"""Benchmark decontamination with DataFrame functions alone: SimHash of item-sized windows, Hamming blocks, exact verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, pick, sized, written

#: Words of a shingle; least weighted similarity; Hamming radius of a window's and an item's fingerprints.
#: A pair at 0.8 differs in 10 of 64 bits on average, so 23 is more than four deviations away.
WIDTH, SIMILARITY, RADIUS, BLOCK = 5, 0.8, 23, 8


def words_of(text: Column) -> Column:
    """Lower-cased words: runs of letters and digits.  Null or blank: none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(width)])


def shingles(words: Column, width: int) -> Column:
    """Hash and weight of each shingle of ``words``, in order; fewer words than ``width``: the whole sequence."""
    n = F.size(words)
    one = lambda part: F.struct(F.xxhash64(F.concat_ws(" ", part)).alias("h"), F.length(F.concat_ws(" ", part)).cast("double").alias("w"))
    return F.when(n == 0, F.array().cast("array<struct<h:bigint,w:double>>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - width + 1)), lambda k: one(F.slice(words, k, width))))


def simhash(parts: Column) -> Column:
    """64-bit fingerprint of weighted shingles: bit b is 1 where the weights of hashes with it outweigh the others."""
    lean = lambda b: F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.when(F.getbit(p["h"], b) == 1, p["w"]).otherwise(-p["w"]))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.when(lean(b) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))


def numbered(parts: Column) -> Column:
    """Shingles with their number among equal ones, so that sets of them are multisets."""
    return F.transform(parts, lambda p, k: F.struct(p["h"].alias("h"), F.size(F.filter(F.slice(parts, F.lit(1), k), lambda q: q["h"] == p["h"])).alias("k"), p["w"].alias("w")))


def weight(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["w"])


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two multisets of shingles, each weighing its characters."""
    return weight(F.array_intersect(a, b)) / weight(F.array_union(a, b))


def block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, k * BLOCK).bitwiseAND(F.lit((1 << BLOCK) - 1)).cast("int")


def known_shingles(items: DataFrame, widths: list[int], width: int) -> DataFrame:
    """Each item's distinct shingles: item, long (its words), whole (its weight), n and h (a shingle's words and hash), w (its weight)."""
    found = None
    for n in widths:
        of_width = (F.size("item_words") >= n) if n == width else (F.size("item_words") == n)
        rows = items.where(of_width).select("item", F.size("item_words").alias("long"), weight(F.col("item_parts")).alias("whole"), "item_words", F.explode(F.sequence(F.lit(0), F.size("item_words") - n)).alias("j"))
        held = F.length(F.concat_ws(" ", F.slice("item_words", F.col("j") + 1, n))).cast("long")
        rows = rows.select("item", "long", F.lit(n).alias("n"), "whole", shingle(F.col("item_words"), F.col("j"), n).alias("h"), held.alias("w")).distinct()
        found = rows if found is None else found.union(rows)
    return found


def placed_shingles(words: DataFrame, widths: list[int]) -> DataFrame:
    """mark, size (the text's words), k (place), n, h of every shingle of ``words`` (mark, words); the words themselves go no further."""
    places = words.select("mark", F.size("words").alias("size"), "words", F.explode(F.when(F.size("words") >= widths[0], F.sequence(F.lit(0), F.size("words") - widths[0]))).alias("k"))
    one = lambda n: F.struct(F.lit(n).alias("n"), F.when(F.col("k") + n <= F.col("size"), shingle(F.col("words"), F.col("k"), n)).alias("h"))
    if len(widths) == 1:
        return places.select("mark", "size", "k", F.lit(widths[0]).alias("n"), shingle(F.col("words"), F.col("k"), widths[0]).alias("h"))
    return places.select("mark", "size", "k", F.explode(F.array(*map(one, widths))).alias("s")).select("mark", "size", "k", "s.n", "s.h").where("h is not null")


def bounded_windows(hits: DataFrame, least: float) -> DataFrame:
    """mark, item, long, start, room: every window that may have the least similarity to an item, by what it shares with it.

    ``hits``: mark, size, item, long, whole, n, k, w of shingles found among an item's.  What a window shares
    with the item weighs at most the sum of the hits inside it.  A hit lies in the windows that start from
    k - long + n to k, so running sums of both ends give every window's bound.  Shared weight s against
    the item's weight i and the window's w has similarity at most s / (i + w - s); so s must reach
    ``least`` * i, and the window may weigh no more than ``room``.
    """
    group = ["mark", "size", "item", "long", "whole"]
    ends = F.array(F.struct((F.col("k") - F.col("long") + F.col("n")).alias("start"), F.col("w")), F.struct((F.col("k") + 1).alias("start"), (-F.col("w")).alias("w")))
    steps = hits.distinct().select(*group, F.explode(ends).alias("e")).groupBy(*group, F.col("e.start").alias("start")).agg(F.sum("e.w").alias("w"))
    order = Window.partitionBy(*group).orderBy("start")
    steps = steps.select(*group, "start", F.sum("w").over(order).alias("shared"), F.lead("start").over(order).alias("until"))
    steps = steps.where(F.col("shared") >= least * (1 - 1e-9) * F.col("whole"))
    low, high = F.greatest("start", F.lit(0)), F.least(F.col("until") - 1, F.greatest(F.col("size") - F.col("long"), F.lit(0)))
    steps = steps.select("mark", "item", "long", "whole", "shared", low.alias("low"), high.alias("high")).where("low <= high")
    room = F.col("shared") * ((1 + least) / least * (1 + 1e-9)) - F.col("whole")
    return steps.select("mark", "item", "long", room.alias("room"), F.explode(F.sequence("low", "high")).alias("start")).groupBy("mark", "item", "long", "start").agg(F.max("room").alias("room"))


def passages(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """One row for each different text and item of which a window as long as the item has at least ``least`` weighted shingle similarity.

    Returns mark (the text's MD5), item_id, window_start and window_words (place and length in words), distance (of the
    fingerprints), similarity: the best window's, the first of equals.

    1. Every shingle of every whole text is hashed and looked up among the items' shingles; ``bounded_windows``
       keeps each window with the items for which what it shares allows the least similarity, wherever it
       starts, so none that has it is missed.  Equal texts are one.
    2. The SimHash of each such window is looked up in the multi-index of its items: 64 bits are eight blocks
       of eight, and an item stands in each block under all values within ``radius // 8`` bits.  If all eight
       blocks differed by more, the distance would exceed the radius, so no fingerprint within it is missed.
       A window meets only items that it shares most of its shingles with, not all that share a block.
    3. The exact similarity of weighted shingles, as multisets, decides.

    Null texts and items, and those without a word, match nothing; an item shorter than ``width`` words is
    one shingle, sought among windows of as many words; a text of any length is read whole, and only
    hashes and places of its shingles are shuffled; repeated rows of a document give one row, repeated
    items one each by item_id; empty tables give an empty result; other columns are left out.
    """
    spark = docs.sparkSession
    items = pick(benchmark, item_id="long", text="string").select("item_id", words_of(F.col("text")).alias("item_words")).where(F.size("item_words") > 0).distinct()
    items = items.withColumn("parts", shingles(F.col("item_words"), width)).select("item_id", F.xxhash64("item_words").alias("item"), "item_words", simhash(F.col("parts")).alias("item_fp"), numbered(F.col("parts")).alias("item_parts"))
    items = written(items, "items")
    widths = sorted(r[0] for r in items.select(F.least(F.size("item_words"), F.lit(width))).distinct().collect())
    if not widths:
        return spark.createDataFrame([], "mark string, item_id long, window_start int, window_words int, distance int, similarity double")
    different = items.dropDuplicates(["item"])

    texts = pick(docs, text="string").select("text", F.md5("text").alias("mark"))
    known = written(known_shingles(different, widths, width), "shingles")
    placed = placed_shingles(texts.select("mark", words_of(F.col("text")).alias("words")), widths)
    hits = placed.join(sized(known), ["n", "h"]).select("mark", "size", "item", "long", "n", "whole", "k", "w")
    starts = written(bounded_windows(hits, least), "starts")

    marks = starts.select("mark").distinct()
    some = texts.join(sized(marks), "mark", "left_semi").groupBy("mark").agg(F.first("text").alias("text")).select("mark", words_of(F.col("text")).alias("words"))
    windows = some.join(starts, "mark").select("mark", "item", "start", "room", F.slice("words", F.col("start") + 1, F.col("long")).alias("window"))
    windows = windows.withColumn("parts", shingles(F.col("window"), width)).where(weight(F.col("parts")) <= F.col("room"))
    windows = written(windows.select("mark", "item", "start", F.size("window").alias("n"), simhash(F.col("parts")).alias("fp"), numbered(F.col("parts")).alias("parts")), "windows")

    found = within_radius(windows.select("mark", "item", "start", "fp"), different.select("item", "item_fp"), radius)
    found = found.join(windows, ["mark", "item", "start"]).join(sized(different.select("item", "item_parts")), "item")
    found = found.select("mark", "item", F.col("start").alias("window_start"), F.col("n").alias("window_words"), "distance", similarity(F.col("parts"), F.col("item_parts")).alias("similarity"))
    best = F.max(F.struct("similarity", (-F.col("window_start")).alias("back"), "window_words", "distance"))
    found = found.where(F.col("similarity") >= least).groupBy("mark", "item").agg(best.alias("x"))
    found = found.join(sized(items.select("item", "item_id")), "item").select("mark", "item_id", (-F.col("x.back")).alias("window_start"), "x.window_words", "x.distance", "x.similarity")
    found = written(found, "found")
    dropped(items, known, starts, windows)
    return found


def within_radius(windows: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """mark, item, start, distance of windows (mark, item, start, fp) whose fingerprint is within ``radius`` of their item's (item, item_fp), by the multi-index."""
    each, blocks = radius // (64 // BLOCK), range(64 // BLOCK)
    index = items.select("item", "item_fp", F.posexplode(F.array(*[block(F.col("item_fp"), k) for k in blocks])).alias("b", "own"))
    values = F.filter(F.sequence(F.lit(0), F.lit((1 << BLOCK) - 1)), lambda v: F.bit_count(v.bitwiseXOR(F.col("own"))) <= each)
    index = written(index.select("item", "item_fp", "b", F.explode(values).alias("value")), "blocks")
    probes = windows.select("*", F.posexplode(F.array(*[block(F.col("fp"), k) for k in blocks])).alias("b", "value"))
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    earlier = F.exists(F.array(*[F.struct(F.lit(k).alias("k"), F.bit_count(block(apart, k)).alias("d")) for k in blocks]), lambda x: (x["k"] < F.col("b")) & (x["d"] <= each))
    found = probes.join(sized(index), ["item", "b", "value"]).where(F.bit_count(apart) <= radius).where(~earlier)
    return found.select("mark", "item", "start", F.bit_count(apart).alias("distance"))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """One row for each document and item of ``passages``: doc_id, item_id and the best window's columns, of rows with one id the best.

    Null ids count as one id; nulls, empty tables, ties and long texts are as in ``passages``.
    """
    found = passages(docs, benchmark, least, radius, width)
    texts = pick(docs, doc_id="long", text="string").select("doc_id", F.md5("text").alias("mark"))
    best = F.max(F.struct("similarity", (-F.col("window_start")).alias("back"), "window_words", "distance"))
    rows = texts.join(sized(found), "mark").groupBy("doc_id", "item_id").agg(best.alias("x"))
    return rows.select("doc_id", "item_id", (-F.col("x.back")).alias("window_start"), "x.window_words", "x.distance", "x.similarity")


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs``, all columns, without the rows whose text has one of ``passages``; each row is judged by its own text, whatever its id.

    Rows with a null text stay; a text that is no string is cast; repeated rows stay or go alike; an empty
    table or benchmark takes nothing away; columns of any other name and type pass through.
    """
    found = passages(docs, benchmark, least).select(F.col("mark").alias("found mark")).distinct()
    return docs.join(sized(found), F.md5(docs["text"].cast("string")) == F.col("found mark"), "left_anti")
