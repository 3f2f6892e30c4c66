"""Page geometry: overlaps by joins; reading order, captions and groups by folds over one page at a time."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from . import ordered

#: Bias of column cuts over row cuts, least gap as a share of the span and in points, distance of grouped figures.
COLUMN_BIAS, LEAST_GAP, LEAST_POINTS, GROUP_DISTANCE = 1.5, 0.02, 1.0, 30.0
#: Kinds of regions.
TEXT_KINDS = ["Title", "ParagraphTitle", "Text", "VerticalText", "Abstract", "References", "Footnote", "Algorithm", "SidebarText", "TOC", "PageNumber", "FormulaNumber", "PageHeader", "PageFooter"]
CAPTION_KINDS = ["FigureTitle", "TableTitle", "FigureTableTitle", "ChartTitle"]
VISUAL_KINDS = ["Image", "Chart", "Seal"]
GROUPED_KINDS = ["Image", "Chart", "Table", "Seal"]
PAGE = ["doc", "page"]
BOX = ["x1", "y1", "x2", "y2"]


def pairs(regions: DataFrame) -> DataFrame:
    """Pairs a < b of one page's regions, columns prefixed; pages are small, so the join is per page."""
    side = lambda p: regions.select(*PAGE, *[F.col(c).alias(f"{p}{c}") for c in regions.columns if c not in PAGE])
    return side("a_").join(side("b_"), PAGE).where("a_id < b_id")


def meeting_pairs(regions: DataFrame, cell: float = 100.0) -> DataFrame:
    """As ``pairs``, of boxes that share area: boxes meet in cells of a grid, and a pair is named by the first cell both lie in.

    The work follows what meets, not the square of a page; a box over many cells stands in each of them.
    """
    place = lambda c: F.floor(F.col(c) / cell)
    cells = regions.where("x2 > x1 and y2 > y1").withColumns({"cx": F.explode(F.sequence(place("x1"), place("x2")))}).withColumn("cy", F.explode(F.sequence(place("y1"), place("y2"))))
    keys = [*PAGE, "cx", "cy"]
    side = lambda p: cells.select(*keys, *[F.col(c).alias(f"{p}{c}") for c in regions.columns if c not in PAGE])
    both = side("a_").join(side("b_"), keys).where("a_id < b_id")
    first = (F.col("cx") == F.floor(F.greatest("a_x1", "b_x1") / cell)) & (F.col("cy") == F.floor(F.greatest("a_y1", "b_y1") / cell))
    return both.where(first & (boxes.intersection(boxes.box("a_"), boxes.box("b_")) > 0)).drop("cx", "cy")


def contained_visuals(regions: DataFrame, share: float = 0.5) -> DataFrame:
    """doc, page, id of visuals of which more than half lies in a larger one; of two equal ones the less confident goes."""
    both = meeting_pairs(regions.where(F.col("kind").isin(VISUAL_KINDS)))
    a, b = boxes.box("a_"), boxes.box("b_")
    hit = both.where(boxes.overlap_of_smaller(a, b) > share)
    first = (boxes.area(a) < boxes.area(b)) | ((boxes.area(a) == boxes.area(b)) & ((F.col("a_confidence") < F.col("b_confidence"))))
    return hit.select(*PAGE, F.when(first, F.col("a_id")).otherwise(F.col("b_id")).alias("id")).distinct()


def inside_figures(regions: DataFrame, slack: float = 1.0) -> DataFrame:
    """doc, page, id of text regions that lie inside a header or figure."""
    outer = regions.where(F.col("kind").isin(*VISUAL_KINDS, "PageHeader")).select(*PAGE, *[F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")])
    rows = regions.where(F.col("kind") == "Text").join(outer, PAGE)
    return rows.where(boxes.contains(boxes.box("o_"), boxes.box(), slack)).select(*PAGE, "id").distinct()


def detections(rows: DataFrame, kinds: list[str], threshold: float) -> DataFrame:
    """Detections of known kinds with at least the score, boxes cut to the page, in order."""
    cut = lambda c, most: F.greatest(F.lit(0.0), F.least(F.col(c), F.col(most)))
    return rows.where((F.col("score") >= threshold) & F.col("kind").isin(kinds)).withColumns({"x1": cut("x1", "width"), "x2": cut("x2", "width"), "y1": cut("y1", "height"), "y2": cut("y2", "height")}).orderBy(*PAGE, "order_key", "id")


def widest_gap(spans: list[tuple[float, float]]) -> tuple[float, float]:
    """(width, middle) of the widest gap between intervals; none wide enough: (0, 0)."""
    spans = sorted(spans)
    reach, best, middle = spans[0][1], 0.0, 0.0
    least = max(LEAST_POINTS, LEAST_GAP * (max(e for _, e in spans) - spans[0][0]))
    for start, end in spans[1:]:
        if start - reach > max(best, least):
            best, middle = start - reach, (start + reach) / 2
        reach = max(reach, end)
    return best, middle


def xy_cut(items: list[tuple]) -> list:
    """Ids of boxes (id, x1, y1, x2, y2) in reading order: cut at the wider of the widest column and row gaps, columns preferred; then each part."""
    if len(items) < 2:
        return [i[0] for i in items]
    across, x = widest_gap([(i[1], i[3]) for i in items])
    down, y = widest_gap([(i[2], i[4]) for i in items])
    if not across and not down:
        return [i[0] for i in sorted(items, key=lambda i: (i[2], i[1], i[0]))]
    by_column = across > 0 and (not down or across * COLUMN_BIAS >= down)
    centre = (lambda i: (i[1] + i[3]) / 2) if by_column else (lambda i: (i[2] + i[4]) / 2)
    middle = x if by_column else y
    low = [i for i in items if centre(i) < middle]
    if not low or len(low) == len(items):
        return [i[0] for i in sorted(items, key=lambda i: (i[2], i[1], i[0]))]
    return xy_cut(low) + xy_cut([i for i in items if centre(i) >= middle])


def reading_order(regions: DataFrame) -> DataFrame:
    """doc, page, id, place of each page's regions by XY-cut; pages stream through a task one after the other."""

    def order(rows):
        for (doc, page), boxes_of in groupby(rows, key=lambda r: r[:2]):
            for place, ident in enumerate(xy_cut([r[2:] for r in boxes_of])):
                yield doc, page, ident, place

    kind = dict(regions.dtypes)
    return ordered.in_order(regions.select(*PAGE, "id", "x1", "y1", "x2", "y2"), ["page", "id"], order, f"doc {kind['doc']}, page {kind['page']}, id {kind['id']}, place int")


def slices(rows: int, columns: int, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of ``rows`` that hold at most ``most`` pairs with ``columns``, or one row."""
    step = max(1, most // max(1, columns))
    return ((k, min(k + step, rows)) for k in range(0, rows, step))


def one_to_one(found: list[tuple]) -> dict:
    """First to second of pairs (the last two of each), taken in order where neither has been taken."""
    out: dict = {}
    taken: set = set()
    for *_, a, b in found:
        if a not in out and b not in taken:
            out[a] = b
            taken.add(b)
    return out


def matched(ids: np.ndarray, box: list[np.ndarray], captions: np.ndarray, figures: np.ndarray, reach: float) -> dict:
    """As ``match_captions``, of columns: ids and x1, y1, x2, y2, and the rows of captions and figures."""
    x1, y1, x2, y2 = box
    found = []
    f = figures
    for start, end in slices(len(captions), len(f)):
        c = captions[start:end, None]
        far = np.maximum(np.maximum(y1[c] - y2[f], y1[f] - y2[c]), 0.0)
        hit = (np.minimum(x2[c], x2[f]) > np.maximum(x1[c], x1[f])) & (far <= reach)
        above = y1[c] < (y1[f] + y2[f]) / 2
        a, b = np.nonzero(hit)
        found += zip(above[a, b].tolist(), far[a, b].tolist(), ids[captions[start + a]].tolist(), ids[f[b]].tolist())
    return one_to_one(sorted(found))


def match_captions(captions: list[dict], figures: list[dict], reach: float) -> dict:
    """Caption id to figure id, one to one: pairs that align across and lie within reach, captions below first, then the nearest."""
    rows = [*captions, *figures]
    k = np.arange(len(rows))
    return matched(np.array([r["id"] for r in rows], object), [np.array([r[c] for r in rows], float) for c in BOX], k[: len(captions)], k[len(captions) :], reach)


def captions(regions: DataFrame) -> DataFrame:
    """doc, page, caption_id, figure_id; reach is twice the page's median region height (the sorted heights' element at half)."""

    def match(ids, role, *box):
        heights = np.sort(box[3] - box[1])
        return matched(ids, box, np.flatnonzero(role == 1), np.flatnonzero(role == 2), 2 * heights[len(heights) // 2]).items()

    role = F.when(F.col("kind").isin(CAPTION_KINDS), 1).when(F.col("kind").isin(GROUPED_KINDS), 2).otherwise(0)
    return ordered.in_pages(regions.select(*PAGE, "id", role.alias("role"), *BOX), ["id"], match, "caption_id string, figure_id string")


def parts(ids: np.ndarray, linked: Callable[[slice, slice], np.ndarray]) -> dict:
    """Each id's least connected id; rows are sorted by id, ``linked`` says which rows of one slice link to which of another."""
    n = len(ids)
    top = list(range(n))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for k in range(1, n):
        if ids[k] == ids[k - 1]:
            top[k] = find(k - 1)
    for start, end in slices(n, n, 1 << 16):
        links = np.triu(linked(slice(start, end), slice(start, None)), 1)
        if start:
            roots = np.array([find(k) for k in range(start, n)])
            links &= roots[: end - start, None] != roots
        for a, b in zip(*(x.tolist() for x in np.nonzero(links))):
            x, y = find(start + a), find(start + b)
            top[max(x, y)] = min(x, y)
    return {i: ids[find(k)] for k, i in enumerate(ids.tolist())}


def figure_groups(regions: DataFrame, distance: float = GROUP_DISTANCE) -> DataFrame:
    """doc, page, id, group: groupable regions whose edges are near, as connected parts of at least two."""

    def groups(ids, x1, y1, x2, y2):
        def near(a, b):
            dx = np.maximum(np.maximum(x1[a, None] - x2[b], x1[b] - x2[a, None]), 0)
            dy = np.maximum(np.maximum(y1[a, None] - y2[b], y1[b] - y2[a, None]), 0)
            return np.sqrt(dx * dx + dy * dy) < distance

        found = parts(ids, near)
        size = Counter(found.values())
        return ((i, g) for i, g in found.items() if size[g] > 1)

    rows = regions.where(F.col("kind").isin(GROUPED_KINDS)).select(*PAGE, "id", *BOX)
    return ordered.in_pages(rows, ["id"], groups, "id string, group string")


def glyphs_in_regions(glyphs: DataFrame, regions: DataFrame) -> DataFrame:
    """doc, page, id, text of the glyphs whose centres lie in each region, in order."""
    cx, cy = (F.col("gx1") + F.col("gx2")) / 2, (F.col("gy1") + F.col("gy2")) / 2
    rows = regions.join(glyphs, PAGE).where((cx >= F.col("x1")) & (cx <= F.col("x2")) & (cy >= F.col("y1")) & (cy <= F.col("y2")))
    return rows.groupBy(*PAGE, "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "char"))), lambda g: g["char"]), "").alias("text"))


def lines(glyphs: list[tuple], pad: float = 0.3) -> list[list]:
    """Glyphs (y1, y2, x1, text) as lines: a glyph joins the line it overlaps in height, padded by a share of its own."""
    out: list[list] = []
    low = high = None
    for y1, y2, x1, text in sorted(glyphs, key=lambda g: ((g[0] + g[1]) / 2, g[2])):
        if out and y1 < high - pad * (y2 - y1):
            out[-1].append((x1, text))
            low, high = min(low, y1), max(high, y2)
        else:
            out.append([(x1, text)])
            low, high = y1, y2
    return ["".join(t for _, t in sorted(line)) for line in out]


#: Which of two overlapping regions stays: the higher; others count 0.
PRIORITY = {"Table": 3, "Algorithm": 2, "Image": 2, "DisplayFormula": 2, "Footnote": 1}


def staying(ids: np.ndarray, rank: np.ndarray, box: list[np.ndarray], share: float = 0.5) -> list:
    """As ``kept_of_duplicates``, of columns: ids, ranks and x1, y1, x2, y2."""
    gone: set = set()
    x1, y1, x2, y2 = box
    size = np.maximum(0.0, x2 - x1) * np.maximum(0.0, y2 - y1)
    for start, end in slices(len(ids), len(ids)):
        a, b = slice(start, end), slice(start, None)
        both = np.maximum(0.0, np.minimum(x2[a, None], x2[b]) - np.maximum(x1[a, None], x1[b])) * np.maximum(0.0, np.minimum(y2[a, None], y2[b]) - np.maximum(y1[a, None], y1[b]))
        least = np.minimum(size[a, None], size[b])
        for k, m in zip(*(x.tolist() for x in np.nonzero(np.triu((least != 0) & (both > share * least), 1)))):
            k, m = start + k, start + m
            if ids[k] not in gone and ids[m] not in gone:
                gone.add(ids[k] if rank[k] < rank[m] else ids[m])
    return [i for i in ids.tolist() if i not in gone]


def kept_of_duplicates(rows: list[dict], share: float = 0.5) -> list:
    """Ids that stay when, pair by pair in order, the lower of two regions that overlap by more than ``share`` of the smaller goes; of equals the later."""
    box = [np.array([r[c] for r in rows], float) for c in BOX]
    return staying(np.array([r["id"] for r in rows], object), np.array([PRIORITY.get(r["kind"], 0) for r in rows]), box, share)


def without_duplicates(regions: DataFrame) -> DataFrame:
    """doc, page, id of the regions that stay; of equal ids the one with the lesser box comes first."""
    rank = F.lit(0)
    for kind, value in PRIORITY.items():
        rank = F.when(F.col("kind") == kind, value).otherwise(rank)
    rows = regions.select(*PAGE, "id", rank.alias("rank"), *BOX)
    return ordered.in_pages(rows, ["id", *BOX, "rank"], lambda ids, rank, *box: ((i,) for i in staying(ids, rank, box)), "id string")


def formula_numbers(regions: DataFrame, reach: float = 50.0) -> DataFrame:
    """doc, page, number_id, formula_id: each formula number and the display formula level with it, nearest pairs first, one to one."""

    def match(number, ids, y1, y2):
        middle = (y1 + y2) / 2
        numbers, formulas = np.flatnonzero(number), np.flatnonzero(~number)
        found = []
        for start, end in slices(len(numbers), len(formulas)):
            far = np.abs(middle[numbers[start:end], None] - middle[formulas])
            n, f = np.nonzero(far <= reach)
            found += zip(far[n, f].tolist(), ids[numbers[start + n]].tolist(), ids[formulas[f]].tolist())
        return one_to_one(sorted(found)).items()

    rows = regions.where(F.col("kind").isin("FormulaNumber", "DisplayFormula")).select(*PAGE, (F.col("kind") == "FormulaNumber").alias("number"), "id", "y1", "y2")
    return ordered.in_pages(rows, ["id"], match, "number_id string, formula_id string")


def abstract_duplicates(regions: DataFrame, ratio: float = 0.95, least: float = 0.5) -> DataFrame:
    """doc, page, id of the abstract or text to drop where both have one box: the abstract stays if it is confident enough."""
    a = regions.where(F.col("kind") == "Abstract").select(*PAGE, *[F.col(c).alias(f"a_{c}") for c in ("id", "x1", "y1", "x2", "y2", "confidence")])
    rows = regions.where(F.col("kind") == "Text").join(a, PAGE)
    shared = boxes.intersection(boxes.box(), boxes.box("a_")) / F.greatest(boxes.area(boxes.box()), boxes.area(boxes.box("a_")))
    return rows.where(shared >= ratio).select(*PAGE, F.when(F.col("a_confidence") > least, F.col("id")).otherwise(F.col("a_id")).alias("id")).distinct()


def same_columns(regions: DataFrame, kind: str = "References", share: float = 0.5) -> DataFrame:
    """doc, page, id, column of a kind's regions: those that overlap across by more than half of the narrower are one column."""

    def columns(ids, x1, x2):
        across = lambda a, b: np.minimum(x2[a, None], x2[b]) - np.maximum(x1[a, None], x1[b]) > share * np.minimum((x2 - x1)[a, None], (x2 - x1)[b])
        return parts(ids, across).items()

    return ordered.in_pages(regions.where(F.col("kind") == kind).select(*PAGE, "id", "x1", "x2"), ["id"], columns, "id string, column string")
