import math
import random
import re
import zlib

import numpy as np
import pytest

from scholia.llm import quality_classifier, queries, toxicity
from scholia.llm.training import fitted, labelled_sample


def fold(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


def world(seed=2, n=400):
    rnd = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("mo", "ta", "ri", "lu") for b in ("na", "sem", "kol") for c in ("", "de", "s", "ing")]
    rows, labels = [], []
    for k in range(n):
        w = rnd.choices(words, k=rnd.randint(20, 200))
        bad, toxic = k % 7 == 0, k % 6 == 0
        if bad:
            w = [x.upper() + "!!" for x in w] if k % 2 else [x + rnd.choice(["###", "$$$"]) for x in w]
        if toxic:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(["idiot", "zorkan", "zorkeb", "zorkil", "moron"]))
        rows.append((k, " ".join(w)))
        if k % 10:
            labels.append((k, int(not bad), int(toxic)))
    return rows, labels


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.fixture(scope="module")
def made(spark):
    rows, labels = world()
    return rows, labels, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label", "threshold"), [(quality_classifier, "quality", 0.3), (toxicity, "toxic", 0.5)])
def test_held_out_documents(spark, docs, made, module, label, threshold):
    rows, labels, table = made
    df = docs(rows)
    model = module.train(df, table)
    got = module.scored(df, model, threshold).collect()
    assert len(got) == df.count()
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and fold(r.doc_id)) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in got)
    y = {d: (q if label == "quality" else t) for d, q, t in labels}
    held = [d for d in y if fold(d)]
    assert len(held) > 40
    assert auc(np.array([by[d].score for d in held]), np.array([y[d] for d in held])) > 0.98
    keep = module.accepted if label == "quality" else module.harmless
    kept = keep(df, model, threshold)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if (r.score >= threshold) == (label == "quality"))


def test_held_out_labels_are_not_read(spark, docs, made):
    rows, labels, table = made
    flipped = spark.createDataFrame([(d, 1 - q if fold(d) else q, 1 - t if fold(d) else t) for d, q, t in labels], table.schema)
    df = docs(rows, extra=False).coalesce(1)
    assert (quality_classifier.train(df, table) == quality_classifier.train(df, flipped)).all()
    assert toxicity.train(df, table) == toxicity.train(df, flipped)


def test_sample_is_bounded_though_one_id_repeats(spark, docs):
    df = docs([(1, f"text {k}") for k in range(500)], extra=False)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    sample = labelled_sample(df, labels, "quality", 50).collect()
    assert len(sample) == 50 and {r.label for r in sample} == {1}


def test_sample_is_bounded_in_bytes(spark):
    """Rows beyond the bound are left out whole; the first is read however long it is."""
    rows = spark.createDataFrame([("x" * 50, 1), ("y" * 60, 0), ("z" * 30, 1), (None, 0)], "text string, label int").coalesce(1)
    seen = lambda most: sorted(n for n, _ in fitted(rows, lambda texts, y: [(f"{t[:1]}{len(t)}", v) for t, v in zip(texts, y)], most))
    assert seen(10) == ["x50"] and seen(80) == ["0", "x50", "z30"] and seen(1000) == ["0", "x50", "y60", "z30"]


def test_no_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs([(1, "a b")])
    assert {r.score for r in quality_classifier.scored(df, quality_classifier.train(df, labels)).collect()} == {0.5}
    assert {r.score for r in toxicity.scored(df, toxicity.train(df, labels)).collect()} == {0.5}
    assert quality_classifier.scored(docs([], extra=False), np.zeros(quality_classifier.BUCKETS + 1, np.float32)).count() == 0


def hidden_votes(n=2000, seed=0):
    """Rows of a hidden class, independent voters with rates of their own, and five near copies of a poor one."""
    rng = np.random.default_rng(seed)
    truth = rng.random(n) < 0.2
    on1, on0 = rng.uniform(0.3, 0.7, 12), rng.uniform(0.01, 0.06, 12)
    votes = rng.random((n, 12)) < np.where(truth[:, None], on1, on0)
    poor = rng.random(n) < np.where(truth, 0.5, 0.35)
    copies = poor[:, None] ^ (rng.random((n, 5)) < 0.02)
    return truth, on1, on0, np.column_stack([votes, poor, copies]).astype(np.uint8)


def test_label_model_sees_votes_alone():
    """Accuracies and classes come from agreement: no label is given, and flipping the order of rows or voters changes nothing."""
    truth, on1, on0, votes = hidden_votes()
    model = toxicity.LabelModel(votes)
    assert ((model.posterior > 0.5) == truth).mean() > 0.98
    assert np.abs(model.rates[1, :12] - on1).max() < 0.1 and np.abs(model.rates[0, :12] - on0).max() < 0.03
    back = toxicity.LabelModel(votes[::-1])
    assert np.abs(back.posterior[::-1] - model.posterior).max() < 1e-3


def test_label_model_finds_dependencies():
    """Near copies hang on each other and count about once; independent voters hang on none."""
    truth, _, _, votes = hidden_votes()
    model = toxicity.LabelModel(votes)
    assert sum(p >= 0 for p in model.parent[:12]) == 0 and sum(p >= 12 for p in model.parent[12:]) == 5
    alone = toxicity.LabelModel(votes[:, :13]).posterior
    assert ((alone > 0.5) == (model.posterior > 0.5)).mean() > 0.99


def test_dependencies_carry_information():
    """Every edge of the forest has the mutual information that it claims, by plain counts, and there is no cycle."""
    _, _, _, votes = hidden_votes(300, 4)
    parent = toxicity.dependencies(votes.astype(np.float32), np.full(300, 0.5), 10.0)
    assert (parent >= 0).any()
    for k, p in enumerate(parent):
        if p >= 0:
            a, b, info = votes[:, k] > 0, votes[:, p] > 0, 0.0
            for x in (a, ~a):
                for z in (b, ~b):
                    joint = (x & z).mean()
                    info += 300 * joint * np.log(joint / (x.mean() * z.mean())) if joint else 0
            assert info > 10.0
        seen = set()
        while k >= 0:
            assert k not in seen
            seen.add(k)
            k = int(parent[k])


def test_gold_labels_reach_the_classifier_through_voters_only(monkeypatch):
    """With the same voters, other labels give the same classifier."""
    rows, labels = world()
    y = {d: t for d, _, t in labels}
    texts = [t for d, t in rows if d in y]
    gold = np.array([y[d] for d, _ in rows if d in y], float)
    names = toxicity.mined([toxicity.words(t) for t in texts], gold)
    monkeypatch.setattr(toxicity, "mined", lambda bags, y: list(names))
    assert {"zorkan"} < set(names) and toxicity.fit(texts, gold) == toxicity.fit(texts, 1 - gold)


def test_distinct_columns():
    votes = np.array([[1, 1, 0, 0, 1], [0, 0, 0, 1, 0], [1, 1, 0, 1, 1]])
    assert toxicity.distinct_columns(votes).tolist() == [0, 3]


def plain_toxicity(text, model):
    """The score as its definition has it: weights of the words, openings and patterns that stand in the text."""
    found = {u for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for u in (w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) > k))}
    total = model.get("", 0.0) + sum(v for u, v in model.items() if u in found and u not in toxicity.PATTERNS)
    total += sum(model.get(p, 0.0) for p, r in toxicity.PATTERNS.items() if r.search(text or ""))
    return 1 / (1 + math.exp(-max(-35, min(35, total))))


def plain_quality(text, weights):
    """The score as its definition has it, gram by gram in whole numbers."""
    words = (text or "").encode(errors="replace").split()
    low = [zlib.crc32(w.decode(errors="replace").lower().encode()) for w in words]
    shape = [zlib.crc32(re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a", w.decode(errors="replace"))).encode()) for w in words]
    mix = lambda a, b, salt: ((a * 0x9E3779B97F4A7C15 + b + salt) * 0xC2B2AE3D27D4EB4F % 2**64) >> 46
    pairs = list(range(len(words) - 1))
    kinds = [[mix(x, 0, 1) for x in low], [mix(x, 0, 2) for x in shape], [mix(low[k], low[k + 1], 3) for k in pairs], [mix(shape[k], shape[k + 1], 4) for k in pairs], [mix(int(low[k] == low[k + 1]), 0, 5) for k in pairs]]
    total = float(weights[-1]) + sum(quality_classifier.SCALE * sum(float(weights[g]) for g in kind) / len(kind) for kind in kinds if kind)
    return 1 / (1 + math.exp(-max(-35, min(35, total))))


@pytest.mark.parametrize("name", ["op7_quality_classifier", "op10_toxicity"])
def test_queries_against_plain_scores(spark, name):
    """The registered queries, whole tables and production parameters, against the definition of each score."""
    sf = "/root/testdata/sf0.001"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, sf).collect()}
    quality = name.startswith("op7")
    model = (quality_classifier if quality else toxicity).train(docs, labels)
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        want = plain_quality(r.text, model) if quality else plain_toxicity(r.text, model)
        assert abs(got[r.doc_id].score - want) < 1e-4 and got[r.doc_id].held_out == fold(r.doc_id)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= (0.3 if quality else 0.5))


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_stages_take_odd_tables(spark, docs, module):
    """Null and blank texts, repeated rows, texts that are no strings, columns of clashing names, and an empty table."""
    keep = module.accepted if module is quality_classifier else module.harmless
    model = np.zeros(quality_classifier.BUCKETS + 1, np.float32) if module is quality_classifier else {"": -1.0}
    odd = docs([(1, "a b")])
    odd = odd.withColumns({"score": odd["doc_id"], "held_out": odd["text"]})
    assert sorted(map(str, keep(odd, model, 0.5).collect())) == sorted(map(str, odd.collect()))
    numbers = spark.createDataFrame([(1, 5), (2, None)], "doc_id long, text long")
    assert keep(numbers, model, 0.5).count() == 2 and keep(odd.limit(0), model, 0.5).count() == 0
    assert module.scored(odd, model).count() == odd.count()
