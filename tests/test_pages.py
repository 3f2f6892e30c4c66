"""Folds over one page at a time: pages without a row, pages over several batches, and results against plain pair loops."""

import random

import numpy as np
import pyarrow as pa
import pytest

from scholia.operators import layout, ordered

REGIONS = "doc string, page int, id string, kind string, x1 double, y1 double, x2 double, y2 double, confidence double"


def some_regions(kinds, n=160, seed=1):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        x, y = r.randrange(300), r.randrange(300)
        rows.append(("d", k % 3, f"{k:03}", r.choice(kinds), float(x), float(y), float(x + r.randrange(90)), float(y + r.randrange(90)), 0.5))
    return [*rows, ("d", 7, "900", "Other", 0.0, 0.0, 1.0, 1.0, 0.5), (None, None, "901", "Other", 0.0, 0.0, 1.0, 1.0, 0.5)]


def by_page(rows):
    pages = {}
    for r in sorted(rows, key=lambda r: r[2]):
        pages.setdefault(r[:2], []).append(dict(zip(["id", "kind", "x1", "y1", "x2", "y2"], r[2:])))
    return pages


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_pages_over_batches(size):
    doc, page = ["a"] * 4 + ["b"] * 3 + [None] * 2, [1, 1, 2, 2, 2, None, None, None, 3]
    batches = pa.Table.from_arrays([pa.array(doc), pa.array(page, pa.int32()), pa.array(range(9))], ["doc", "page", "n"]).to_batches(max_chunksize=size)
    assert [c[2].tolist() for c in ordered._pages(batches, 2)] == [[0, 1], [2, 3], [4], [5, 6], [7], [8]]
    assert list(ordered._pages([], 2)) == []


def test_formula_numbers(spark):
    rows = some_regions(["FormulaNumber", "DisplayFormula", "Text"])
    want = set()
    for key, page in by_page(rows).items():
        middle = lambda r: (r["y1"] + r["y2"]) / 2
        pairs = sorted((abs(middle(n) - middle(f)), n["id"], f["id"]) for n in page if n["kind"] == "FormulaNumber" for f in page if f["kind"] == "DisplayFormula")
        used = set()
        for far, n, f in pairs:
            if far <= 20 and not {n, f} & used:
                used |= {n, f}
                want.add((*key, n, f))
    got = layout.formula_numbers(spark.createDataFrame(rows, REGIONS), 20.0).collect()
    assert len(got) == len(want) > 20 and set(map(tuple, got)) == want
    assert list(layout.slices(5, 1 << 21)) == [(k, k + 1) for k in range(5)] and list(layout.slices(5, 0)) == [(0, 5)]


def test_region_duplicates(spark):
    rows = some_regions(["Table", "Text", "Footnote", "Image"])
    size = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    want = set()
    for key, page in by_page(rows).items():
        gone = set()
        for k, a in enumerate(page):
            for b in page[k + 1 :]:
                both = max(0, min(a["x2"], b["x2"]) - max(a["x1"], b["x1"])) * max(0, min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]))
                if not {a["id"], b["id"]} & gone and min(size(a), size(b)) and both > min(size(a), size(b)) / 2:
                    gone.add((a if layout.PRIORITY.get(a["kind"], 0) < layout.PRIORITY.get(b["kind"], 0) else b)["id"])
        want |= {(*key, r["id"]) for r in page if r["id"] not in gone}
    got = layout.without_duplicates(spark.createDataFrame(rows, REGIONS)).collect()
    assert len(got) == len(want) < len(rows) and set(map(tuple, got)) == want

def connected(page, linked):
    top = {r["id"]: r["id"] for r in page}
    for _ in page:
        for a in page:
            for b in page:
                if linked(a, b):
                    top[a["id"]] = top[b["id"]] = min(top[a["id"]], top[b["id"]])
    return top


def test_figure_groups(spark):
    """Connected parts, on pages without any too."""
    rows = some_regions(["Image", "Table", "Text", "Other"], 90)
    gap = lambda a, b, lo, hi: max(a[lo] - b[hi], b[lo] - a[hi], 0)
    want = set()
    for key, page in by_page(rows).items():
        top = connected([r for r in page if r["kind"] in layout.GROUPED_KINDS], lambda a, b: gap(a, b, "x1", "x2") ** 2 + gap(a, b, "y1", "y2") ** 2 < 12**2)
        want |= {(*key, i, g) for i, g in top.items() if list(top.values()).count(g) > 1}
    got = layout.figure_groups(spark.createDataFrame(rows, REGIONS), 12.0).collect()
    assert len({r[3] for r in got}) > 3 and len(got) == len(want) and set(map(tuple, got)) == want


def test_parts_in_slices():
    """More rows than one slice holds: chains across slices, and equal ids are one."""
    ids = np.array([f"{k // 2:04}" for k in range(700)], object)
    group = (np.arange(700) // 2) % 5
    got = layout.parts(ids, lambda a, b: group[a, None] == group[b])
    assert len(list(layout.slices(700, 700, 1 << 16))) > 1 and got == {f"{k:04}": f"{k % 5:04}" for k in range(350)}

def test_page_blocks_keep_every_page(spark):
    """Blocks as of a page alone, pages of one line and null texts too."""
    from scholia.operators import blocks

    r = random.Random(3)
    rows = [("d", k % 4, float(r.randrange(50)), float(r.randrange(400)), 90.0, 400.0, 9.0, r.choice(["x = y + z", "some prose here", "ab"])) for k in range(80)] + [("e", 0, 0.0, 0.0, 1.0, 1.0, 9.0, None)]
    names = ["x1", "y1", "x2", "y2", "size", "text"]
    got = blocks.page_blocks(spark.createDataFrame(rows, "doc string, page int, x1 double, y1 double, x2 double, y2 double, size double, text string")).collect()
    for key in {x[:2] for x in rows}:
        page = sorted((dict(zip(names, (*x[2:7], x[7] or ""))) for x in rows if x[:2] == key), key=lambda x: (x["y1"], x["x1"], x["text"]))
        assert sorted(tuple(x)[2:] for x in got if tuple(x)[:2] == key) == [(k, len(b), "\n".join(x["text"] for x in b)) for k, b in enumerate(blocks.line_blocks(page))]

def test_reference_columns(spark):
    """A page without the kind gives nothing, others the columns of plain loops."""
    rows = some_regions(["References", "Text"], 40)
    want = set()
    for key, page in by_page(rows).items():
        wide = lambda r: r["x2"] - r["x1"]
        top = connected([r for r in page if r["kind"] == "References"], lambda a, b: min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]) > min(wide(a), wide(b)) / 2)
        want |= {(*key, i, g) for i, g in top.items()}
    got = layout.same_columns(spark.createDataFrame(rows, REGIONS)).collect()
    assert len({r[3] for r in got}) > 3 and len(got) == len(want) and set(map(tuple, got)) == want

def test_figure_captions(spark):
    """Captions as matched pair by pair, on pages without any too."""
    rows = some_regions(["FigureTitle", "Image", "Table", "Text"])
    want = set()
    for key, page in by_page(rows).items():
        heights = sorted(r["y2"] - r["y1"] for r in page)
        found = []
        for c in (r for r in page if r["kind"] == "FigureTitle"):
            for f in (r for r in page if r["kind"] in layout.GROUPED_KINDS):
                far = max(c["y1"] - f["y2"], f["y1"] - c["y2"], 0.0)
                if min(c["x2"], f["x2"]) > max(c["x1"], f["x1"]) and far <= 2 * heights[len(heights) // 2]:
                    found.append((c["y1"] < (f["y1"] + f["y2"]) / 2, far, c["id"], f["id"]))
        used = set()
        for *_, c, f in sorted(found):
            if not {c, f} & used:
                used |= {c, f}
                want.add((*key, c, f))
    got = layout.captions(spark.createDataFrame(rows, REGIONS)).collect()
    assert len(got) == len(want) > 10 and set(map(tuple, got)) == want
