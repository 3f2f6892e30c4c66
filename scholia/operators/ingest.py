"""From block rows to chunks and exhibits: counters by windows, the token-budgeted fold by document, cross-links by joins."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ALGORITHM_HEADER, caption_key, mentions

#: Tokens below which a chunk joins the one before it, at which one is full, and that none exceeds by joining; sentences carried over.
MIN_TOKENS, TARGET_TOKENS, MAX_TOKENS, OVERLAP = 200, 400, 600, 2
SKIPPED = {"Page", "PageHeader", "PageFooter", "TableOfContents", "Caption"}
_ALGORITHM = re.compile(ALGORITHM_HEADER)
_END = re.compile(r"[.?!](?=\s|$)")
_LEVEL = re.compile(r"^<[hH]([1-5])")
FOLD = "paper_id string, kind string, chapter_idx int, section_idx int, idx int, chapter_title string, section_title string, text string, page_start int, page_end int, tokens int"


def tokens(text: str) -> int:
    return math.ceil(len(text.split()) * 1.3)


def overlap_tail(text: str) -> str:
    """The last two sentences and what follows them; nothing unless two sentences end."""
    ends = [m.end() for m in _END.finditer(text)]
    if len(ends) < OVERLAP:
        return ""
    return text[ends[-OVERLAP - 1] if len(ends) > OVERLAP else 0 :].strip()


def plain(html: str) -> str:
    return " ".join(re.sub(r"<[^>]*>?|>", "", html or "").split())


class Fold:
    """One document's state: counters, the buffer, an open algorithm, captions taken."""

    def __init__(self, paper: str):
        self.paper, self.rows = paper, []
        self.chapter = self.section = self.chunk = self.exhibits = 0
        self.titles, self.buffer, self.references, self.algorithm = ["", ""], [], False, None

    def emit(self) -> None:
        if not self.buffer:
            return
        pages = [p for _, p in self.buffer if p is not None]
        text = "\n\n".join(t for t, _ in self.buffer)
        self.rows.append([self.paper, "chunk", self.chapter, self.section, self.chunk, *self.titles, text, min(pages, default=None), max(pages, default=None), tokens(text)])
        self.chunk += 1
        self.buffer = []

    def boundary(self) -> None:
        """At a section's end a small rest joins the chunk before it, if that is of the same section and the two stay small enough."""
        if not self.buffer:
            return
        text = "\n\n".join(t for t, _ in self.buffer)
        last = next((r for r in reversed(self.rows) if r[1] == "chunk"), None)
        if sum(tokens(t) for t, _ in self.buffer) < MIN_TOKENS and last and last[2:4] == [self.chapter, self.section]:
            both = last[7] + "\n\n" + text
            if tokens(both) <= MAX_TOKENS:
                pages = [p for p in (last[8], last[9], *(p for _, p in self.buffer)) if p is not None]
                last[7:] = [both, min(pages, default=None), max(pages, default=None), tokens(both)]
                self.buffer = []
                return
        self.emit()

    def push(self, text: str, page) -> None:
        if self.buffer and sum(tokens(t) for t, _ in self.buffer) + tokens(text) > TARGET_TOKENS:
            tail = overlap_tail("\n\n".join(t for t, _ in self.buffer))
            self.emit()
            if tail:
                self.buffer.append((tail, None))
        self.buffer.append((text, page))

    def exhibit(self, kind: str, text: str, page) -> None:
        self.exhibits += 1
        self.rows.append([self.paper, kind, self.chapter, self.section, self.exhibits, *self.titles, text, page, page, tokens(text)])

    def close_algorithm(self) -> None:
        if self.algorithm and any(t.strip() for t in self.algorithm[1]):
            self.exhibit("algorithm", "\n".join([self.algorithm[0], *self.algorithm[1]]), self.algorithm[2])
        self.algorithm = None

    def header(self, html: str, page) -> None:
        self.close_algorithm()
        level, title = int(m[1]) if (m := _LEVEL.match(html or "")) else 6, plain(html)
        if level == 1:
            return
        if level == 2:
            self.boundary()
            if "references" in title.lower() or "bibliography" in title.lower():
                self.references = True
                return
            self.chapter, self.section, self.chunk, self.titles = self.chapter + 1, 0, 0, [title, ""]
        elif level <= 4:
            self.boundary()
            self.section, self.chunk, self.titles[1] = self.section + 1, 0, title
        elif _ALGORITHM.match(title):
            self.boundary()
            self.algorithm = (title, [], page)


def fold_document(paper: str, blocks: list[tuple[str, str, int | None]]) -> list[list]:
    """Chunk and exhibit rows (FOLD) of one document's blocks (type, html, page) in order."""
    state, taken = Fold(paper), set()
    for k, (kind, html, page) in enumerate(blocks):
        if kind in SKIPPED:
            continue
        if kind == "SectionHeader":
            state.header(html, page)
        elif kind in ("Figure", "Table", "Picture"):
            state.close_algorithm()
            near = next((j for j in (k + 1, k - 1) if 0 <= j < len(blocks) and blocks[j][0] == "Caption" and j not in taken), None)
            alt = re.search(r'alt="([^"]*)"', html or "")
            caption = plain(blocks[near][1]) if near is not None else alt[1] if alt else ""
            if near is not None:
                taken.add(near)
            if kind != "Picture" or caption:
                state.exhibit("table" if kind == "Table" else "figure", caption, page)
        elif not state.references and (text := plain(html)):
            if state.algorithm:
                state.algorithm[1].append(text)
            else:
                state.push(text, page)
    state.close_algorithm()
    state.boundary()
    return state.rows


def folded(blocks: DataFrame) -> DataFrame:
    """FOLD rows of blocks (paper_id, page_no, block_no, block_type, html, page): one pass over each document in order.

    What a chunk holds depends on the sentences carried into it, so no window expresses it; a document is one group.
    """

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page_no", "block_no"])
        pages = [None if pd.isna(p) else int(p) for p in pdf.page]
        return pd.DataFrame(fold_document(key[0], list(zip(pdf.block_type, pdf.html, pages))), columns=[x.split()[0] for x in FOLD.split(", ")])

    return blocks.groupBy("paper_id").applyInPandas(fold, FOLD)


def heading_counters(blocks: DataFrame, order: list[str]) -> DataFrame:
    """Blocks with chapter_idx and section_idx: headings of level 2 and 3 or 4 counted so far, sections anew in each chapter."""
    w = Window.partitionBy("paper_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.withColumn("chapter_idx", F.sum(F.when(F.col("level") == 2, 1).otherwise(0)).over(w))
    w = Window.partitionBy("paper_id", "chapter_idx").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section_idx", F.sum(F.when(F.col("level").isin(3, 4), 1).otherwise(0)).over(w))


def cross_links(chunks: DataFrame, exhibits: DataFrame) -> DataFrame:
    """paper_id, chunk_id, exhibit_id of every exhibit a chunk mentions by kind and number; of equal captions the last exhibit counts."""
    named = exhibits.select("paper_id", "exhibit_id", "exhibit_no", caption_key(F.col("caption")).alias("key")).where("key is not null")
    named = named.groupBy("paper_id", F.col("key.kind").alias("kind"), F.col("key.number").alias("number")).agg(F.max_by("exhibit_id", "exhibit_no").alias("exhibit_id"))
    said = chunks.select("paper_id", "chunk_id", F.explode(mentions(F.col("text"))).alias("m")).select("paper_id", "chunk_id", "m.kind", "m.number")
    return said.join(named, ["paper_id", "kind", "number"]).select("paper_id", "chunk_id", "exhibit_id").distinct()


def reference_stats(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """exhibit_id, ref_count (chunks), first_ref_chunk_id."""
    rows = links.join(chunks.select("chunk_id", "chapter_idx", "section_idx", "chunk_idx"), "chunk_id")
    return rows.groupBy("exhibit_id").agg(F.count("*").alias("ref_count"), F.min_by("chunk_id", F.struct("chapter_idx", "section_idx", "chunk_idx", "chunk_id")).alias("first_ref_chunk_id"))




def type_counts(exhibits: DataFrame) -> DataFrame:
    """paper_id, types: how many exhibits of each type an article has, by type, as ``1 figure, 3 tables``."""
    rows = exhibits.groupBy("paper_id", "exhibit_type").agg(F.count("*").alias("n"))
    one = F.concat(F.col("n"), F.lit(" "), "exhibit_type", F.when(F.col("n") == 1, "").otherwise("s"))
    listed = F.array_sort(F.collect_list(F.struct("exhibit_type", one.alias("said"))))
    return rows.groupBy("paper_id").agg(F.array_join(F.transform(listed, lambda x: x["said"]), ", ").alias("types"))


def fold_tree(paper: str, nodes: list[dict]) -> list[list]:
    """FOLD rows of a reflow document's nodes (type, depth, text, and of some section, items, language, marker) in page order.

    Chapters are headings of depth 1 and sections of depth 2; deeper ones are bold text, before which a
    buffer over half the target is emitted.  A formula leaves the buffer only at the limit, a footnote
    never; everything after a references heading is left out.
    """
    state = Fold(paper)
    held = lambda: sum(tokens(t) for t, _ in state.buffer)
    for n in nodes:
        kind, text = n["type"], (n.get("text") or "").strip()
        if kind == "heading":
            title, depth = " ".join(filter(None, [n.get("section"), text])), n.get("depth") or 0
            if "references" in title.lower() or "bibliography" in title.lower():
                break
            if depth == 1:
                state.boundary()
                state.chapter, state.section, state.chunk, state.titles = state.chapter + 1, 0, 0, [title, ""]
            elif depth == 2:
                state.boundary()
                state.section, state.chunk, state.titles[1] = state.section + 1, 0, title
            elif depth >= 3:
                if held() > TARGET_TOKENS // 2:
                    state.emit()
                state.buffer.append((f"**{title}**", None))
        elif kind == "text" and text:
            state.push(text, None)
        elif kind == "footnote" and text:
            state.buffer.append((f"[{n['marker']}] {text}" if n.get("marker") else text, None))
        elif kind == "formula":
            text = text or "[display formula]"
            if state.buffer and held() + tokens(text) > MAX_TOKENS:
                state.emit()
            state.buffer.append((text, None))
        elif kind == "list" and n.get("items"):
            numbered = n.get("list_type") == "numbered"
            state.push("\n".join(f"{k}. {x}" if numbered else f"- {x}" for k, x in enumerate(n["items"], 1)), None)
        elif kind in ("code_block", "formatted_text") and text:
            state.push(f"```{n.get('language') or ''}\n{text}\n```" if kind == "code_block" else text, None)
        elif kind in ("figure", "figure_group", "table", "algorithm"):
            state.exhibit({"figure_group": "figure"}.get(kind, kind), (n.get("caption") or text).strip(), None)
    state.boundary()
    return state.rows


def folded_trees(nodes: DataFrame) -> DataFrame:
    """FOLD rows of flattened reflow nodes (paper_id, seq, type, depth, text, payload as JSON), one document a group."""
    import json

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.sort_values("seq").itertuples():
            rows.append({**json.loads(r.payload or "{}"), "type": r.type, "depth": None if pd.isna(r.depth) else int(r.depth), "text": r.text})
        return pd.DataFrame(fold_tree(key[0], rows), columns=[x.split()[0] for x in FOLD.split(", ")]).astype({"page_start": "Int32", "page_end": "Int32"})

    return nodes.groupBy("paper_id").applyInPandas(fold, FOLD)
