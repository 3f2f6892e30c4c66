import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scholia.llm import queries
from scholia.llm import token_counts as tc
from scholia.llm.shared import fresh_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(rows, count):
    docs, tokens = Counter(), Counter()
    for r in rows:
        docs[r.source, r.lang] += 1
        tokens[r.source, r.lang] += count(r.text or "")
    return {k: (docs[k], tokens[k]) for k in docs}


def test_rollup_follows_deltas(spark, docs):
    df = docs([(k, "word " * (k % 7) + "é\x0bend") for k in range(50)])
    rollup = tc.Rollup(spark, fresh_path(spark, "rollup"))
    assert rollup.totals().count() == 0
    counted = tc.counts(df, {"bpe": PATH})
    assert rollup.commit("load", tc.inserts(counted)) and not rollup.commit("load", tc.inserts(counted))
    t = Tokenizer.from_file(PATH)
    want = plain(df.collect(), lambda x: len(t.encode(x, add_special_tokens=False).ids))
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()} == want
    words = tc.word_counts(df)
    rollup.commit("words", tc.inserts(words))
    rollup.commit("revised", tc.revisions(words, words.withColumn("n_tokens", words["n_tokens"] * 3)))
    totals = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().collect() if r.tokenizer == "words-1"}
    assert totals == plain(df.collect(), lambda x: 3 * len(re.findall(r"[^\x20\x09-\x0D]+", x)))
    rollup.commit("gone", tc.deletes(counted))
    assert {r.tokenizer for r in rollup.totals().collect()} == {"words-1"}
    again = tc.Rollup(spark, rollup.path)
    assert not again.commit("revised", tc.inserts(words)) and again.totals().count() == len(totals)
    with pytest.raises(ValueError):
        again.commit("../up", tc.inserts(words))


def test_a_lost_writer_leaves_nothing_that_is_read(spark, docs):
    rollup = tc.Rollup(spark, fresh_path(spark, "rollup"))
    words = tc.word_counts(docs([]))
    rollup.commit("a", tc.inserts(words))
    before = sorted(map(str, rollup.totals().collect()))
    spark.createDataFrame([("x", "y", "z", 1, 1)], tc.TOTALS).write.parquet(f"{rollup.path}/totals-1-b")
    assert rollup.totals().where("source = 'x'").count() == 0
    rollup.commit("b", tc.inserts(words))
    assert rollup.totals().where("source = 'x'").count() == 0
    assert sorted(map(str, rollup.totals().collect())) != before


def test_of_two_writers_one_fails(spark, docs, monkeypatch):
    """Both read the same state; the second to publish finds its number taken, and what it wrote is never read."""
    path = fresh_path(spark, "rollup")
    one, two = tc.Rollup(spark, path), tc.Rollup(spark, path)
    words = tc.word_counts(docs([(1, "a b")], extra=False))
    one.commit("first", tc.inserts(words))
    stale = two._state()
    one.commit("second", tc.inserts(words))
    want = sorted(map(tuple, one.totals().collect()), key=str)
    monkeypatch.setattr(two, "_state", lambda: stale)
    with pytest.raises(RuntimeError):
        two.commit("third", tc.inserts(words))
    monkeypatch.undo()
    assert sorted(map(tuple, two.totals().collect()), key=str) == want
    assert two.commit("third", tc.inserts(words)) and not one.commit("third", tc.inserts(words))


def test_a_mark_that_a_lost_writer_left_out(spark, docs):
    """A batch whose manifest stands counts as committed, though its mark was never set."""
    rollup = tc.Rollup(spark, fresh_path(spark, "rollup"))
    words = tc.word_counts(docs([]))
    rollup.commit("a", tc.inserts(words))
    rollup.files.delete(rollup._path("batches/a"), False)
    assert not rollup.commit("a", tc.inserts(words))
    for k in range(6):
        rollup.commit(f"b{k}", tc.inserts(words))
    assert len([n for n in rollup._names("") if n.startswith("totals-")]) <= rollup.KEPT + 1
    assert {r.n_docs for r in rollup.totals().collect()} == {7 * r.n_docs for r in words.groupBy("source").agg(F.count("*").alias("n_docs")).collect()}


def test_no_documents_and_no_deltas(spark, docs):
    empty = docs([], extra=False)
    rollup = tc.Rollup(spark, fresh_path(spark, "rollup"))
    assert tc.counts(empty, {"bpe": PATH}).count() == tc.word_counts(empty).count() == 0
    assert rollup.commit("none", tc.inserts(tc.counts(empty, {"bpe": PATH}))) and rollup.totals().count() == 0
    assert rollup.commit("gone", tc.revisions(tc.word_counts(empty), tc.word_counts(empty))) and rollup.totals().count() == 0


def test_query_against_plain_counts(spark):
    """Inserts, a repeated batch, revisions and deletes over a whole table end where counting what is left ends."""
    sf = "/root/testdata/sf0.001"
    t, want = Tokenizer.from_file(PATH), Counter()
    for r in queries.table(spark, sf, "documents").collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        if n:
            for name, k in (("byte_bpe_50k", len(t.encode(r.text, add_special_tokens=False).ids)), ("words-1", n + 1)):
                want[r.source, r.lang, name, "docs"] += 1
                want[r.source, r.lang, name, "tokens"] += k
    got = Counter()
    for r in queries.QUERIES["op8_token_counts"](spark, sf).collect():
        got[r.source, r.lang, r.tokenizer, "docs"], got[r.source, r.lang, r.tokenizer, "tokens"] = r.n_docs, r.n_tokens
    assert got == want
