"""Every operator's query, with production parameters over a whole table, against a plain version of it."""

import html
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_classifiers import plain_quality, plain_toxicity
from test_decontamination import plain_similarity, words
from test_simhash import plain_components, plain_fingerprint
from test_url_filter import plain as plain_url
from tokenizers import Tokenizer

import corpus_pipeline
from scholia.llm import queries, quality_classifier, toxicity

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text, end):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()


@pytest.fixture(scope="module")
def rows(spark):
    return {name: queries.table(spark, SF, name).collect() for name in ("documents", "pages", "benchmark", "labels")}


def contaminated(docs, items, width=5):
    """(doc, item): best similarity of an item-sized window, of those that reach 0.8; a window that shares no shingle has none."""
    held, out = defaultdict(set), {}
    items = [(i, words(t)) for i, t in items if words(t)]
    for i, q in items:
        for k in range(max(1, len(q) - width + 1)):
            held[tuple(q[k : k + width])].add(i)
    item = dict(items)
    for d, text in docs:
        w, near = words(text), defaultdict(set)
        for n in {min(width, len(q)) for _, q in items}:
            for k in range(len(w) - n + 1):
                for i in held.get(tuple(w[k : k + n]), ()):
                    m = len(item[i])
                    near[i].update(range(max(0, k - m + n), min(k, max(0, len(w) - m)) + 1))
        for i, starts in near.items():
            best = max(plain_similarity(w[k : k + len(item[i])], item[i]) for k in starts)
            if best >= 0.8:
                out[d, i] = best
    return out


def test_op1(spark, rows):
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in queries.QUERIES["op1_decontamination"](spark, SF).collect()}
    want = contaminated([(r.doc_id, r.text) for r in rows["documents"]], [(r.item_id, r.text) for r in rows["benchmark"]])
    assert got == {k: round(v, 9) for k, v in want.items()} and got


def test_op2(spark, rows):
    start, want = 0, []
    for r in sorted(rows["documents"], key=lambda r: r.doc_id):
        ids = ids_of(r.text, 0)
        want.append((r.doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(map(tuple, queries.QUERIES["op2_token_output"](spark, SF).collect())) == want


def test_op3(spark, rows):
    got = {r.page_id: r for r in queries.QUERIES["op3_url_filter"](spark, SF).collect()}
    assert len(got) == len(rows["pages"])
    for r in rows["pages"]:
        host, path, rule, said = plain_url(r.url)
        x = got[r.page_id]
        assert (x.host, x.path, x.rule) == (host, path, rule) and x.verdict == (said or ("block" if x.mined_rule else "allow"))


def test_op4(spark, rows):
    got = {r.page_id: r for r in queries.QUERIES["op4_html_extraction"](spark, SF).collect()}
    for r in rows["pages"]:
        inner = r.html.split("<article>", 1)[1].split("</article>")[0]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>?", " ", inner)).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def unpacked(pieces, texts):
    """Checks pieces against the library's ids of ``texts`` (by doc_id) and that sequences are gapless and full or a power of two."""
    held, fill = defaultdict(dict), defaultdict(list)
    for r in pieces:
        ids = ids_of(texts[r.doc_id], 1)
        assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) and r.doc_tokens == len(ids) // 4
        for k in range(r.start, r.start + r.length):
            assert k not in held[r.doc_id]
            held[r.doc_id][k] = True
        fill[r.sequence_id].append((r.offset, r.length))
    for doc, places in held.items():
        assert len(places) == len(ids_of(texts[doc], 1)) // 4
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    return set(held)


def test_op6(spark, rows):
    texts = {r.doc_id: r.text for r in rows["documents"]}
    assert unpacked(queries.QUERIES["op6_packing"](spark, SF).collect(), texts) == set(texts)


def components_of(docs):
    prints = {d: plain_fingerprint(t) for d, t in docs}
    some = sorted(set(prints.values()))
    parts = plain_components(some, [(a, b) for a in some for b in some if a < b and (a ^ b).bit_count() <= 4])
    low = {}
    for d, f in sorted(prints.items()):
        low.setdefault(parts[f], d)
    return prints, {d: low[parts[f]] for d, f in prints.items()}


def test_op9(spark, rows):
    prints, low = components_of([(r.doc_id, r.text) for r in rows["documents"]])
    assert {tuple(r) for r in queries.QUERIES["op9_simhash_dedup"](spark, SF).collect()} == {(d, f"{f:016x}", low[d]) for d, f in prints.items()}


def test_pipeline(spark, rows):
    """run() keeps what plain versions of its stages keep, one after the other, and packs exactly that."""
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    left = {r.doc_id: r.text for r in rows["documents"]}
    weights = quality_classifier.train(docs, labels)
    left = {d: t for d, t in left.items() if plain_quality(t, weights) >= 0.3}
    model = toxicity.train(docs.where(docs["doc_id"].isin(list(left))), labels)
    left = {d: t for d, t in left.items() if plain_toxicity(t, model) < 0.5}
    _, low = components_of(left.items())
    left = {d: t for d, t in left.items() if low[d] == d}
    leaks = {d for d, _ in contaminated(left.items(), [(r.item_id, r.text) for r in rows["benchmark"]])}
    left = {d: t for d, t in left.items() if d not in leaks}
    assert 0 < len(left) < len(rows["documents"]) and leaks
    assert unpacked(corpus_pipeline.run(spark, SF).collect(), left) == set(left)


def test_stages_of_an_empty_table(spark):
    """No document at all, with an extra column of a clashing name: every stage gives an empty table, the last one pieces' columns."""
    docs = queries.table(spark, SF, "documents").limit(0).withColumn("score", queries.F.lit(1))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (k == 4 or out.columns == docs.columns)


def test_stages_of_odd_rows(spark, docs):
    """Null, blank and very long texts, null and repeated ids, equal rows: stages neither fail nor lose what they do not reject."""
    odd = docs([(1, "a few plain words stand here alone"), (1, "other words under the same number")])
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, odd, SF)
        kept = out.collect()
        if name == "SimHash near-dedup":
            assert {r.text for r in kept if r.doc_id == 1} == {"a few plain words stand here alone", "other words under the same number"} and sum(r.doc_id == 906 for r in kept) == 1
        elif name == "benchmark decontamination":
            assert len(kept) == odd.count()
        elif k == 4:
            assert {r.doc_id for r in kept} == {r.doc_id for r in odd.collect()}
