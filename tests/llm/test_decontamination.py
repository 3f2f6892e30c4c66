import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scholia.llm import decontamination, shared


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def plain_similarity(a, b, width=5):
    bag = lambda w: Counter(" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1)))
    a, b = bag(a), bag(b)
    size = lambda c: sum(len(s) * n for s, n in c.items())
    return size(a & b) / size(a | b)


def plain(docs, items):
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            n = len(q := words(item))
            if n and w:
                best = max(plain_similarity(w[k : k + n], q) for k in range(max(1, len(w) - n + 1)))
                if best >= 0.8:
                    out[d, i] = max(best, out.get((d, i), 0))
    return out


def test_contaminated_documents(spark, docs):
    rnd = random.Random(3)
    vocabulary = [f"word{k}x"[: rnd.randint(3, 8)] for k in range(300)]
    some = lambda n: rnd.choices(vocabulary, k=n)
    items = [(k, " ".join(some(rnd.randint(12, 40)))) for k in range(8)] + [(8, "Three short words"), (9, ""), (10, None), (11, "a b c d e a b c d e a b c d e"), (11, "a b c d e a b c d e a b c d e")]
    rows = []
    for k in range(60):
        w, item = some(rnd.randint(0, 50)), (items[k % 9][1]).split()
        if k % 3 == 1 and len(item) > 12:
            item[rnd.choice([0, 1, -1])] = "edited"
        if k % 3 == 2:
            item = [x.upper() + "," for x in item]
        if k % 5 == 4:
            item = item[: len(item) // 2]
        rows.append((k, " ".join(w + item + some(rnd.randint(0, 50)))))
    rows += [(61, "x y a b c d e a b c d e a b c d e a b c d e"), (62, "three short words"), (63, items[0][1])]
    df = docs(rows)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = decontamination.contaminated(df, bench).collect()
    want = plain([(r.doc_id, r.text) for r in df.collect()], items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert len(got) == len(want) > 20
    clean = decontamination.decontaminated(df, bench)
    assert clean.columns == df.columns
    assert clean.count() == sum(r.doc_id not in {d for d, _ in want} for r in df.collect())


def test_fingerprints_and_index(spark):
    """Every value within two bits of a block leads to its item, and the radius leaves room at the least similarity."""
    df = spark.createDataFrame([("one two three four five six seven".split(),)], "w array<string>")
    parts = decontamination.shingles(df["w"], 5)
    (row,) = df.select(parts.alias("p"), decontamination.simhash(parts).alias("fp")).collect()
    fp = 0
    for b in range(64):
        if sum(x.w if (x.h >> b) & 1 else -x.w for x in row.p) > 0:
            fp |= 1 << b
    assert row.fp % (1 << 64) == fp and [x.w for x in row.p] == [23.0, 23.0, 25.0]


def test_empty(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(docs([]), bench).count() == 0
    assert decontamination.contaminated(docs([], extra=False), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_inserted_and_deleted_words(spark):
    """Passages with one or two edits: the best window may start anywhere, since a shingle weighs its characters."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(1, 14))) for _ in range(3000)]
    some = lambda n: rnd.choices(vocabulary, k=n)
    items, rows = [], []
    for k in range(1500):
        item = some(rnd.randint(25, 59))
        items.append((k, " ".join(item)))
        for _ in range(rnd.randint(1, 2)):
            at, kind = rnd.randrange(len(item)), rnd.randrange(3)
            if kind == 0:
                item[at:at] = some(rnd.randint(1, 3))
            elif kind == 1:
                item[at : at + 2] = item[at : at + 2][::-1]
            else:
                del item[at : at + rnd.randint(1, 2)]
        rows.append((k, " ".join(some(rnd.randint(0, 20)) + item + some(rnd.randint(0, 20)))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = decontamination.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for (k, text), (_, item) in zip(rows, items):
        want |= plain([(k, text)], [(k, item)])
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert len(want) > 200


def test_rows_are_judged_by_their_own_text(spark):
    passage = "one two three four five six seven eight nine"
    rows = [(None, passage, 1), (None, "clean text of a few words", 2), (5, "so it says " + passage, 3), (5, "another clean text of words", 4), (6, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert sorted(r.n for r in decontamination.decontaminated(df, bench).collect()) == [2, 4, 5]
    assert {r.doc_id for r in decontamination.contaminated(df, bench).collect()} == {None, 5}


@pytest.mark.parametrize("broadcast", [0, 1 << 30])
def test_mixed_word_lengths_and_a_long_text(spark, monkeypatch, broadcast):
    """Windows that start between those that align: short shared words between very long ones; joins by shuffle give the same."""
    monkeypatch.setattr(shared, "MOST_BROADCAST", broadcast)
    rnd = random.Random(17)
    short = lambda n: ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(n)]
    items = [(k, " ".join(short(30))) for k in range(12)] + [(20, "one two three"), (21, "solo")]
    rows = []
    for k in range(12):
        w = items[k][1].split()
        rows.append((k, " ".join([*short(3), "x" * 150, "so", *w[k % 3 : 28 + k % 3], "to", "y" * 150, *short(2)])))
        rows.append((100 + k, " ".join([*w[4:], *short(k)])))
        rows.append((200 + k, " ".join([*short(k), *w[:25]])))
    long = short(30_000)
    long[17_000:17_030] = items[3][1].split()
    rows += [(300, " ".join(long)), (301, "so one two three go"), (302, "Solo!")]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = plain([r for r in rows if r[0] != 300], items) | {(300, 3): 1.0}
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert {(300, 3), (301, 20), (302, 21), (0, 0)} <= set(want)


def test_only_texts_that_share_most_of_an_item_become_windows(spark):
    """Candidates follow what is shared, not how many items there are: unrelated texts and items make none."""
    rnd = random.Random(5)
    text = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=5)) for _ in range(n))
    items = spark.createDataFrame([(k, text(40)) for k in range(300)], "item_id long, text string")
    item = items.head().text
    df = spark.createDataFrame([(k, text(200)) for k in range(100)] + [(500, item + " " + text(30))], "doc_id long, text string")
    words = df.select(F.md5("text").alias("mark"), decontamination.words_of(F.col("text")).alias("words"))
    parts = items.select(F.col("item_id").alias("item"), decontamination.words_of(F.col("text")).alias("item_words"))
    known = decontamination.known_shingles(parts.withColumn("item_parts", decontamination.numbered(decontamination.shingles(F.col("item_words"), 5))), [5], 5)
    starts = decontamination.bounded_windows(decontamination.placed_shingles(words, [5]).join(known, ["n", "h"]), 0.8).collect()
    assert 0 < len(starts) < 12 and {r.item for r in starts} == {0}


def test_recall_of_the_radius():
    """Of pairs with a similarity of at least 0.8, few in a million lie beyond the radius: measured over edited items."""
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(1, 12))) for _ in range(4000)]

    def print_of(words):
        parts = [" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))]
        h = np.array([xxhash.xxh64_intdigest(p, 1) for p in parts], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return (2 * bits.astype(float) - 1).T @ np.array([len(p) for p in parts], float) > 0

    far = []
    while len(far) < 4000:
        a = rnd.choices(vocabulary, k=rnd.randint(12, 60))
        b = list(a)
        for _ in range(rnd.randint(1, 2)):
            b[rnd.choice([0, -1, rnd.randrange(len(b))])] = rnd.choice(vocabulary)
        if plain_similarity(a, b) >= 0.8:
            far.append(int((print_of(a) != print_of(b)).sum()))
    assert max(far) <= decontamination.RADIUS
