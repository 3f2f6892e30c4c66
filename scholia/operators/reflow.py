"""A document's nodes put in order: headings merged and numbered, echoes and repeats removed, lists and notes found, Markdown.

Each pass looks at what the passes before left, so a document is one ordered fold; the order of the
passes is part of their meaning.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.code import SIGNS, list_items

NODES = "doc string, seq int, kind string, depth int, number string, text string"
#: Nodes an echo is sought in, least bytes of an opening that repeats, share of shared words.
ECHO_WINDOW, LEAST_OPENING, SHARED = 5, 20, 0.8
_NUMBER = re.compile(r"^((?:\d+|[A-Z])(?:\.\d+)*)\.?\s+(?=\S)")
_MARKER = re.compile(r"^\s*(?:\[(\w{1,3})\]|(\d{1,3})[.)]?|([*†‡§¶]))\s+(?=\S)")
_GLUED = re.compile(r"(?<=[).\]:;])(\d{1,2})(?=[A-Z]\w*(?:\s+\S+){3})")


def bag(text: str) -> set[str]:
    return set(re.findall(r"\w+", text.lower()))


def same_text(a: str, b: str) -> bool:
    """Equal, one the other's opening, or sharing over 0.8 of the smaller one's words."""
    if a == b:
        return True
    short, long = sorted((a, b), key=len)
    if len(short.encode()) >= LEAST_OPENING and long.startswith(short):
        return True
    x, y = bag(a), bag(b)
    return len(x) >= 4 and len(y) >= 4 and len(x & y) / min(len(x), len(y)) > SHARED


def without_echoes(nodes: list[dict]) -> list[dict]:
    """After a heading, text that repeats its title loses those words, or goes."""
    out, gone = [dict(n) for n in nodes], set()
    for k, head in enumerate(out):
        title = " ".join(re.findall(r"\w+", head["text"].lower())) if head["kind"] == "heading" else ""
        if len(title) < 5:
            continue
        for j in range(k + 1, min(len(out), k + 1 + ECHO_WINDOW)):
            n = out[j]
            if n["kind"] == "heading" and (n["depth"] or 1) <= (head["depth"] or 1):
                break
            if n["kind"] != "text":
                continue
            spoken = list(re.finditer(r"\w+", n["text"]))
            count = len(title.split())
            if " ".join(m[0].lower() for m in spoken[:count]) == title and count >= 2:
                rest = n["text"][spoken[count - 1].end() :].lstrip(" .:\n")
                n["text"] = rest
                if not rest:
                    gone.add(j)
                break
    return [n for k, n in enumerate(out) if k not in gone]


def without_repeats(nodes: list[dict]) -> list[dict]:
    """Text that says what the text before said, one formula apart at most; the longer one stays."""
    out: list[dict] = []
    for n in nodes:
        last = next((k for k in range(len(out) - 1, max(-1, len(out) - 3), -1) if out[k]["kind"] != "formula"), None)
        if n["kind"] == "text" and last is not None and out[last]["kind"] == "text" and same_text(out[last]["text"], n["text"]):
            if len(n["text"]) > len(out[last]["text"]):
                out[last] = {**out[last], "text": n["text"]}
        else:
            out.append(dict(n))
    return out


def split_notes(nodes: list[dict]) -> list[dict]:
    """A note glued to the end of a sentence becomes its own node; of notes with one marker the first stays."""
    out, seen = [], set()
    for n in nodes:
        parts = [dict(n)]
        if n["kind"] == "text" and (m := _GLUED.search(n["text"])) and len(n["text"][: m.start()].encode()) >= 20:
            parts = [{**n, "text": n["text"][: m.start()]}, {**n, "kind": "footnote", "number": m[1], "text": n["text"][m.end() :]}]
        for p in parts:
            if p["kind"] == "footnote":
                m = None if p.get("number") else _MARKER.match(p["text"])
                if m:
                    p["number"], p["text"] = m[1] or m[2] or m[3], p["text"][m.end() :]
                if p.get("number") and p["number"] in seen:
                    continue
                seen.add(p.get("number"))
            out.append(p)
    return out


def with_lists_and_code(nodes: list[dict]) -> list[dict]:
    """Texts that are lists or code, as such; neighbouring code in one node."""
    out: list[dict] = []
    for n in nodes:
        n = dict(n)
        if n["kind"] == "text":
            signs = sum(bool(re.search(s, n["text"], re.M)) for s in SIGNS)
            if list_items(n["text"]):
                n["kind"] = "list"
            elif len(n["text"].strip().encode()) >= 15 and signs >= (5 if len(n["text"].split()) > 30 else 3):
                n["kind"] = "code"
        if n["kind"] == "code" and out and out[-1]["kind"] == "code":
            out[-1]["text"] += "\n" + n["text"]
        else:
            out.append(n)
    return out


def rejoined(nodes: list[dict]) -> list[dict]:
    """Paragraphs cut by a page's end: a word's halves, or a sentence that goes on in lower case."""
    out: list[dict] = []
    for n in nodes:
        last = out[-1] if out else None
        if n["kind"] == "text" and last and last["kind"] == "text" and n["text"][:1].islower():
            if re.search(r"[^\W\d_]-$", last["text"]):
                last["text"] = last["text"][:-1] + n["text"]
                continue
            if not re.search(r"[.?!:;)\"”]\s*$", last["text"]):
                last["text"] = f"{last['text'].rstrip()} {n['text']}"
                continue
        out.append(dict(n))
    return out


def numbered(nodes: list[dict]) -> list[dict]:
    """Headings with numbers: printed ones are read, and where most of a depth have none, they are counted, anew below each parent."""
    out = [dict(n) for n in nodes]
    heads = [n for n in out if n["kind"] == "heading"]
    for n in heads:
        if m := _NUMBER.match(n["text"]):
            n["number"], n["text"] = m[1], n["text"][m.end() :]
    share: dict[int, list[bool]] = {}
    for n in heads:
        share.setdefault(n["depth"], []).append(bool(n.get("number")))
    counts: list[int] = []
    for n in heads:
        d = n["depth"]
        counts = (counts + [0] * d)[:d]
        if n.get("number") and re.fullmatch(r"\d+(?:\.\d+)*", n["number"]):
            own = [int(x) for x in n["number"].split(".")]
            counts = (own + [0] * d)[:d]
        elif sum(share[d]) / len(share[d]) < 0.3:
            counts[d - 1] += 1
            n["number"] = ".".join(map(str, counts))
    return out


def markdown(nodes: list[dict]) -> str:
    """The nodes as Markdown."""
    parts = []
    for n in nodes:
        text, kind = n["text"] or "", n["kind"]
        if kind == "heading":
            parts.append("#" * min(6, n["depth"] or 1) + " " + " ".join(filter(None, [n.get("number"), text])))
        elif kind == "list":
            how, items = list_items(text) or ("bulleted", text.splitlines())
            parts.append("\n".join(f"{k}. {x}" if how == "numbered" else f"- {x}" for k, x in enumerate(items, 1)))
        elif kind == "code":
            parts.append(f"```\n{text}\n```")
        elif kind == "formula":
            parts.append(f"$$\n{text}\n$$")
        elif kind == "footnote":
            parts.append(f"[^{n.get('number') or ''}]: {text}")
        else:
            parts.append(text)
    return "\n\n".join(parts)


PASSES = [without_echoes, split_notes, without_repeats, with_lists_and_code, rejoined, numbered]


def _records(pdf: pd.DataFrame) -> list[dict]:
    rows = pdf.sort_values("seq").astype(object).where(pdf.sort_values("seq").notna(), None).to_dict("records")
    for r in rows:
        r["depth"] = None if r["depth"] is None else int(r["depth"])
        r["text"] = r["text"] or ""
    return rows


def reflowed(nodes: DataFrame) -> DataFrame:
    """NODES after all passes, numbered anew."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _records(pdf)
        for one in PASSES:
            rows = one(rows)
        df = pd.DataFrame([(key[0], k, r["kind"], r["depth"], r.get("number"), r["text"]) for k, r in enumerate(rows)], columns=["doc", "seq", "kind", "depth", "number", "text"])
        return df.astype({"depth": "Int32"})

    return nodes.groupBy("doc").applyInPandas(run, NODES)


def rendered(nodes: DataFrame) -> DataFrame:
    """doc, markdown."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc": [key[0]], "markdown": [markdown(_records(pdf))]})

    return nodes.groupBy("doc").applyInPandas(run, "doc string, markdown string")


# ---- passes that windows and joins express ----


def merged_headings(headings: DataFrame, gap: float = 1.5) -> DataFrame:
    """Headings of one page and depth whose lines follow each other closely, as one: islands of lines."""
    w = Window.partitionBy("doc", "page", "depth").orderBy("seq")
    close = (F.col("y1") - F.lag("y2").over(w) < gap * F.col("height")) & ~F.col("text").rlike(r"^\s*\d+(?:\.\d+)*\.?\s") & (F.col("seq") == F.lag("seq").over(w) + 1)
    rows = headings.withColumn("fresh", F.when(F.coalesce(close, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("part", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("doc", "page", "depth", "part").agg(F.min("seq").alias("seq"), text.alias("text")).drop("part")


def interrupters(headings: DataFrame) -> DataFrame:
    """doc, seq of headings without a number between two siblings whose numbers follow on each other."""
    parent, last = F.regexp_replace("number", r"\.?\d+$", ""), F.regexp_extract("number", r"(\d+)$", 1).cast("int")
    known = headings.where("number is not null").withColumns({"parent": parent, "last": last})
    w = Window.partitionBy("doc", "parent", "depth").orderBy("seq")
    spans = known.withColumns({"next_seq": F.lead("seq").over(w), "next_last": F.lead("last").over(w)}).where("next_last = last + 1").select("doc", F.col("seq").alias("low"), F.col("next_seq").alias("high"), F.col("depth").alias("at"))
    rows = headings.where("number is null").join(spans, "doc").where("seq > low and seq < high and depth <= at")
    return rows.select("doc", "seq").distinct()


def appendix_parents(headings: DataFrame) -> DataFrame:
    """doc, letter, before_seq of appendix parts (A.1) whose own heading (A) is missing."""
    rows = headings.withColumn("letter", F.regexp_extract("number", r"^([A-Z])(?:\.|$)", 1)).where("letter <> ''")
    found = rows.groupBy("doc", "letter").agg(F.min("seq").alias("before_seq"), F.max(F.when(F.col("number") == F.col("letter"), 1).otherwise(0)).alias("held"))
    return found.where("held = 0").drop("held")


def first_notes(notes: DataFrame) -> DataFrame:
    """Notes without those whose marker came before in the document; without a marker, all."""
    w = Window.partitionBy("doc", "marker").orderBy("seq")
    rows = notes.withColumn("n", F.row_number().over(w))
    return rows.where("n = 1 or marker is null or marker = ''").drop("n")


def back_matter_titles(headings: DataFrame, titles: list[str]) -> DataFrame:
    """doc, title, times, sole: how often each back-matter title comes; a sole one stands at the first depth."""
    rows = headings.withColumn("title", F.lower(F.trim("text"))).where(F.col("title").isin(titles))
    return rows.groupBy("doc", "title").agg(F.count("*").alias("times")).withColumn("sole", F.col("times") == 1)


def in_number_order(nodes: list[dict]) -> list[dict]:
    """Numbered headings, each with what follows it, sorted among their siblings, where a page's layout turned them round.

    Only neighbours of one parent and depth change places; what stands before the first numbered heading stays.
    """
    parts: list[list[dict]] = [[]]
    for n in nodes:
        if n["kind"] == "heading" and n.get("number") and re.fullmatch(r"\d+(?:\.\d+)*", n["number"]):
            parts.append([n])
        else:
            parts[-1].append(n)
    head, rest = parts[0], parts[1:]
    key = lambda p: [int(x) for x in p[0]["number"].split(".")]
    swapped = True
    while swapped:
        swapped = False
        for k in range(len(rest) - 1):
            a, b = key(rest[k]), key(rest[k + 1])
            if a[:-1] == b[:-1] and a > b or len(a) > len(b) and a[: len(b)] == b:
                rest[k], rest[k + 1] = rest[k + 1], rest[k]
                swapped = True
    return head + [n for p in rest for n in p]


def assembled(lines: list[str]) -> str:
    """A paragraph of a block's lines: words cut by hyphens are joined, but for compounds before a capital or digit."""
    out = ""
    for line in (x.strip() for x in lines if x.strip()):
        if re.search(r"[^\W\d_]-$", out) and line[:1].islower():
            out = out[:-1] + line
        elif re.search(r"[^\W\d_]-$", out):
            out += line
        else:
            out = f"{out} {line}" if out else line
    return out


def without_stamps(text: str, stamps: set[str]) -> str:
    """A text without the lines that are margin stamps (letters only, lower case)."""
    key = lambda s: " ".join(re.sub(r"[^\w\s]|[\d_]", "", s.lower()).split())
    return "\n".join(x for x in text.split("\n") if key(x) not in stamps)
