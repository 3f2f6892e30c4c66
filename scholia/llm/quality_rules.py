"""Quality rules: counts of a text, and its distance from its language's character classes and common words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encoding import slices
from .shared import pick, written

#: Common words of languages; each language's, and the rest of its words, make a histogram.
COMMON = {
    "en": "the of and to in is that it for was on are as with be by at this from or an have not which a",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch an nach wie wird",
    "fr": "de la le et les des en un du une que est pour qui dans par sur plus pas au avec il sont ce ou",
    "es": "de la que el en y los del se las por un para con no una su al es lo como más o pero sus",
}
#: Greatest Jensen-Shannon distance (base 2) from the reference: of a long text, and what chance adds to a short one's
#: squared, times its characters or words.  Texts with fewer are not judged by that histogram.
MOST_CLASSES, CLASS_NOISE, LEAST_CHARS = 0.245, 15.0, 100
MOST_WORDS, WORD_NOISE, LEAST_WORDS = 0.245, 5.0, 40
#: Least share of its language's common words that a document of a reference has: the fixed lists anchor what is counted.
LEAST_COMMON = 0.1
CLASSES = ["a-z", "A-Z", "0-9", "space", "line", "mark", "quote", "symbol", "ascii", "two bytes", "more bytes"]
SYMBOLS = b"#*$%&|<>"
#: Fixed value: about how many bytes of texts are counted before their counts are handed on.
MOST_BYTES = 1_000_000


def _class_table() -> np.ndarray:
    """Class of each byte; bytes that continue a character: none (the last)."""
    table = np.full(256, CLASSES.index("ascii"))
    for name, those in {"a-z": range(97, 123), "A-Z": range(65, 91), "0-9": range(48, 58), "space": [9, 11, 12, 13, 32], "line": [10], "mark": b".,;:!?", "quote": b"'\"()[]{}-", "symbol": SYMBOLS, "two bytes": range(0xC0, 0xE0), "more bytes": range(0xE0, 256)}.items():
        table[list(those)] = CLASSES.index(name)
    table[0x80:0xC0] = len(CLASSES)
    return table


_TABLE = _class_table()
_PLACE = {w: k + 1 for k, w in enumerate(dict.fromkeys(" ".join(COMMON.values()).split()))}
_VARIANTS = {(form(w) + end).encode(): k for w, k in _PLACE.items() for form in (str, str.capitalize, str.upper) for end in ("", ".", ",")}


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that stand in a window of ``width`` words found at least twice."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    seen: dict[tuple, list[int]] = {}
    for k in np.flatnonzero(twice).tolist():
        seen.setdefault(tuple(words[k : k + width]), []).append(k)
    cover = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            for k in places:
                cover[k] += 1
                cover[k + width] -= 1
    return int((np.cumsum(cover) > 0).sum())


def counted(text: str | None) -> tuple[list[int], list[int], list[int]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), characters by class, common words by place (0: others)."""
    raw = (text or "").encode(errors="replace")
    words = raw.split()
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    classes = np.bincount(_TABLE, by_byte, len(CLASSES) + 1).astype(np.int64)[:-1]
    blank = int(by_byte[[9, 10, 11, 12, 13, 32]].sum())
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    get = _VARIANTS.get
    common = np.bincount([get(w, 0) for w in words], minlength=len(_PLACE) + 1) if words else np.zeros(len(_PLACE) + 1, np.int64)
    return [len(words), int(classes.sum()) - blank, int(by_byte[list(SYMBOLS)].sum()), dup, repeated_words(words)], classes.tolist(), common.tolist()


def statistics(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, the base counts, base_failed, and the two histograms.

    A worker holds one Arrow batch and the counts of about MOST_BYTES of its texts, whatever the input.
    """
    kinds = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, common array<long>"

    def run(batches):
        for batch in (b.slice(start, end - start) for b in batches for start, end in slices(b.column(2), MOST_BYTES)):
            found = [counted(t.as_py()) for t in batch.column(2)]
            base = list(zip(*[x[0] for x in found])) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in base], pa.array([x[1] for x in found], pa.list_(pa.int64())), pa.array([x[2] for x in found], pa.list_(pa.int64()))], names=[x.split()[0] for x in kinds.split(", ")]
            )

    rows = pick(docs, doc_id="long", lang="string", text="string").mapInArrow(run, kinds)
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, the root of the divergence in bits, of each row of counts from a reference; without counts on either side 0."""
    reference = reference.astype(float)
    if not reference.sum():
        return np.zeros(len(counts))
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    q = np.broadcast_to(reference / reference.sum(), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = (np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)).sum(1) / 2
    return np.where(counts.sum(1) > 0, np.sqrt(np.maximum(d, 0.0)), 0.0)


def _group(lang: Column) -> Column:
    return F.when(lang.isin(list(COMMON)), lang).otherwise(F.lit(""))


def _common_share() -> Column:
    """The share of a row's words that are common ones of its language; of an unknown language, of any."""
    total = F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x)
    share = lambda lang: sum((F.col("common")[k] for k in own_words(lang)), F.lit(0)) / F.greatest(total, F.lit(1))
    out = share("")
    for lang in COMMON:
        out = F.when(F.col("lang") == lang, share(lang)).otherwise(out)
    return out


def references(stats: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean histograms of documents by each language of COMMON, and pooled under "": every document weighs the same, whatever its length.

    Only documents that pass the base rules, are long enough to be judged, and have a least share of common
    words take part, so a corpus of junk makes no reference of itself.  Twelve dozen numbers a language
    come to the driver, whatever the input.
    """
    fit = stats.where(~F.col("base_failed") & (F.col("word_chars") >= LEAST_CHARS) & (F.col("n_words") >= LEAST_WORDS) & (_common_share() >= LEAST_COMMON))
    chars, words = (F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x) for c in ("classes", "common"))
    sums = [F.sum(F.col("classes")[k] / chars).alias(f"a{k}") for k in range(len(CLASSES))] + [F.sum(F.col("common")[k] / words).alias(f"b{k}") for k in range(len(_PLACE) + 1)]
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for r in fit.groupBy(_group(F.col("lang")).alias("of")).agg(*sums).collect():
        out[r["of"]] = (np.array([r[f"a{k}"] for k in range(len(CLASSES))]), np.array([r[f"b{k}"] for k in range(len(_PLACE) + 1)]))
    out[""] = (sum((x for x, _ in out.values()), np.zeros(len(CLASSES))), sum((y for _, y in out.values()), np.zeros(len(_PLACE) + 1)))
    return out


def robust_references(stats: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """``references`` of the middle of each language: those of all documents first, then of the half that lies nearest to them by both histograms."""
    far = judged(stats, references(stats))
    middle = {r["of"]: (r["c"], r["w"]) for r in far.where("not base_failed").groupBy(_group(F.col("lang")).alias("of")).agg(F.percentile_approx("class_distance", 0.5).alias("c"), F.percentile_approx("word_distance", 0.5).alias("w")).collect()}
    near = F.lit(False)
    for lang, (c, w) in middle.items():
        near |= (_group(F.col("lang")) == lang) & (F.col("class_distance") <= c) & (F.col("word_distance") <= w)
    return references(far.where(near))


def own_words(lang: str) -> list[int]:
    """Places of a language's common words; without a known language, of all."""
    return [_PLACE[w] for w in COMMON[lang].split()] if lang in COMMON else list(_PLACE.values())


_STATS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, common array<long>, base_failed boolean"


def judged(stats: DataFrame, known: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``stats`` with class_distance and word_distance from each row's reference, and whether either is too far."""

    def run(batches):
        for batch in batches:
            langs, n = [x if x in COMMON else "" for x in batch.column(1).to_pylist()], batch.num_rows
            classes = np.asarray(batch.column(7).flatten()).reshape(n, -1).astype(float)
            common = np.asarray(batch.column(8).flatten()).reshape(n, -1).astype(float)
            words = batch.column(2).to_numpy().astype(float)
            by_class, by_word = np.zeros(n), np.zeros(n)
            for lang in set(langs):
                rows, at = np.array([x == lang for x in langs]), own_words(lang)
                a, b = known.get(lang, known[""])
                split = lambda c, total: np.column_stack([c[:, at], total - c[:, at].sum(1)])
                by_class[rows] = distance(classes[rows], a)
                by_word[rows] = distance(split(common[rows], words[rows]), split(b[None, :], np.array([b.sum()]))[0])
            chars = batch.column(3).to_numpy().astype(float)
            far = (chars >= LEAST_CHARS) & (by_class**2 > MOST_CLASSES**2 + CLASS_NOISE / np.maximum(chars, 1))
            far |= (words >= LEAST_WORDS) & (by_word**2 > MOST_WORDS**2 + WORD_NOISE / np.maximum(words, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(by_class), pa.array(by_word), pa.array(far)], names=[*batch.schema.names, "class_distance", "word_distance", "far"])

    return stats.mapInArrow(run, f"{_STATS}, class_distance double, word_distance double, far boolean")


def kept_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance per row.

    A row is kept if it passes the base rules and neither of its histograms lies too far from its language's
    reference; texts under LEAST_CHARS word characters or LEAST_WORDS words are not judged by that histogram.
    A null text has no words and so fails; a null or unknown language is held against all languages
    pooled, and so is one without a document fit for a reference; where there is no reference at all, none
    is far; null ids and repeated rows are judged like any other, a distance equal to the bound is kept; a text of
    any length is counted whole; an empty table gives an empty one; other columns are left out.
    """
    stats = written(statistics(docs), "statistics")
    rows = judged(stats, robust_references(stats)).withColumn("kept", ~F.col("base_failed") & ~F.col("far"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
