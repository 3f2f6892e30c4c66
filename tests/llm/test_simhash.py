import random
from collections import defaultdict

import numpy as np
import xxhash
import pytest
from pyspark.sql import functions as F

from scholia.llm import simhash
from scholia.llm.shared import components


def plain_fingerprint(text, width=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, linked):
    label = {n: n for n in nodes}

    def top(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in linked:
        a, b = top(a), top(b)
        label[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two three four", "One two three four FIVE", "É É ß nbsp is a letter here x y z", "a b\x0bc\x0cd\re f " * 300])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("n", [3, 200, 900])
def test_tree_finds_all_within_the_radius(n):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = np.unique(centres[rng.integers(0, 12, n)] ^ (np.uint64(1) << rng.integers(0, 63, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, n).astype(np.uint64)))
    got = {(k, q) for k, hits in simhash.BKTree(fps).search(fps, 3) for q in hits.tolist()}
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if bin(int(fps[i]) ^ int(fps[j])).count("1") <= 3}
    assert got == want


def flipped(value, bits, rnd):
    for b in rnd.sample(range(64), bits):
        value ^= 1 << b
    return value


@pytest.mark.parametrize("tree", [8, 4096])
def test_links_connect_what_all_pairs_connect(spark, tree):
    rnd = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(25):
        chain = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 20)):
            fps.add(chain)
            chain = flipped(chain, rnd.randint(1, 6), rnd)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = simhash.links(df, tree=tree).collect()
    exact = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 4]
    assert {(min(r), max(r)) for r in map(tuple, got)} <= set(exact) | {(min(a, b), max(a, b)) for a, b in got}
    assert plain_components(signed, got) == plain_components(signed, exact)
    parts = {r.node: r.component for r in components(simhash.links(df, tree=tree)).collect()}
    assert {n: c for n, c in plain_components(signed, exact).items() if n in parts} == parts


def test_more_blocks_find_the_same(spark):
    assert [simhash.blocks_for(n, 4) for n in (0, 10**6, 10**9, 10**11)] == [5, 5, 6, 7]
    rnd = random.Random(9)
    fps = [rnd.getrandbits(63) for _ in range(60)]
    fps += [flipped(f, k % 6, rnd) % (1 << 63) for k, f in enumerate(fps)]
    df = spark.createDataFrame([(f,) for f in set(fps)], "fp long")
    want = plain_components(set(fps), [(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 4])
    for blocks in (6, 7):
        assert plain_components(set(fps), simhash.links(df, 4, blocks).collect()) == want


def test_links_come_through_edges(spark):
    """On a whole table the shards' trees have edges keyed by distance; searches follow some and leave others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fps = np.array([r.fp for r in simhash.fingerprints(docs).select("fp").distinct().collect()], np.int64).view(np.uint64)
    keys = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long").select("fp", F.explode(simhash.block_keys(F.col("fp"), 4, 5)).alias("key")).collect()
    shards, followed, pruned, direct = defaultdict(list), 0, 0, set()
    for r in keys:
        shards[r.key].append(r.fp)
    for shard in shards.values():
        own = np.array(shard, np.int64).view(np.uint64)
        tree = simhash.BKTree(own)
        assert all(d == (int(own[k]) ^ int(own[c])).bit_count() for k, kids in enumerate(tree.children) for d, c in kids.items())
        for k, hits in tree.search(own, 4):
            direct |= {(min(a, b), max(a, b)) for a in [int(own[k])] for b in own[hits].tolist() if a != b}
        followed, pruned = followed + tree.followed, pruned + tree.pruned
    assert followed > 100 and pruned > 100
    far = np.bitwise_count(fps[:, None] ^ fps[None, :])
    assert direct == {(min(a, b), max(a, b)) for a, b in ((int(fps[i]), int(fps[j])) for i, j in zip(*np.nonzero(far <= 4)) if i != j)}


def test_hubs_and_chains(spark):
    """A node with far more neighbours than HUB, a long chain and small groups, against a plain union."""
    rnd = random.Random(3)
    pairs = [(5, k) for k in range(1000, 2500)] + [(2600, k) for k in range(2000, 2550)] + [(k, k + 1) for k in range(5000, 5060)] + [(9, 9), (7000, 6000), (6000, 7000)] + [(rnd.randrange(8000, 8200), rnd.randrange(8000, 8200)) for _ in range(90)]
    rnd.shuffle(pairs)
    got = [tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()]
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    assert len(got) == len(nodes) and dict(got) == plain_components(nodes, [p for p in pairs if p[0] != p[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, docs):
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rnd.choices(words, k=120)) for _ in range(12)]
    rows = []
    for k, t in enumerate(base):
        rows += [(100 + 10 * k + j, t if j < 3 else t.upper() if j == 3 else t.replace(" ", "  ") + f" extra{j}" * (j % 3)) for j in range(6)]
    df = docs(rows)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == df.count()
    by = defaultdict(set)
    for r in df.collect():
        by[plain_fingerprint(r.text)].add(r.doc_id)
    fps = list(by)
    parts = plain_components(fps, [(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 4])
    low = defaultdict(set)
    for f, c in parts.items():
        low[c] |= by[f]
    want = {(d, f"{f:016x}", min((x for x in low[parts[f]] if x is not None), default=None)) for f, ids in by.items() for d in ids}
    assert {tuple(r) for r in got} == want
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(c) for _, _, c in want})
    assert simhash.near_duplicates(docs([], extra=False)).count() == 0


def test_one_row_of_each_component_stays(spark):
    """Rows without an id, and rows that share one, are each judged by their own text."""
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices([f"w{k}" for k in range(400)], k=60)) for _ in range(9)]
    rows = [(None, t) for t in texts[:4]] * 2 + [(7, t) for t in texts[4:7]] * 2 + [(8, texts[7]), (None, texts[7]), (None, texts[8]), (9, texts[8].upper()), (0, None), (None, None)]
    df = spark.createDataFrame([(i, t, {"k": str(n)}) for n, (i, t) in enumerate(rows)], "doc_id long, text string, extra map<string,string>").repartition(3)
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    want = [(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:7]] + [(8, texts[7]), (9, texts[8].upper()), (0, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
