"""Near-duplicates by SimHash: fingerprints within a Hamming radius, found with BK-trees, one or more to a shard."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, deals, dropped, pick, written

#: Fingerprints in one BK-tree; a shard with more is dealt to several trees.  Fingerprints that spread shards hold on average at most.
TREE, SHARD = 4096, 1024
SEED = 42


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit SimHash of the XXH64 hashes of ``width``-word shingles of a text, A-Z lower-cased; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-width] + 1]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:e], SEED) for a, e in zip(starts, ends[width - 1 :].tolist())]
    n, counts = len(hashes), np.zeros(64, np.int64)
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(n, 8)
    for k in range(0, n, 65536):
        counts += np.unpackbits(raw[k : k + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, *also: str) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every whole text, and the columns of strings named in ``also``."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *also])

    return pick(docs, doc_id="long", text="string", **dict.fromkeys(also, "string")).mapInArrow(run, ", ".join(["doc_id long, fp long", *(f"{c} string" for c in also)]))


class BKTree:
    """A BK-tree of fingerprints: each node is one of them, its children keyed by their integer Hamming distance to it.

    A fingerprint goes down the edge of its distance until that edge is free.  ``search`` takes many
    queries at once and passes down an edge only those whose own distance to the node differs from the
    edge's by no more than the radius; ``followed`` and ``pruned`` count queries at edges.
    """

    def __init__(self, fps: np.ndarray):
        self.fps, self.children = fps, [{} for _ in fps]
        self.followed = self.pruned = 0
        values, children = fps.tolist(), self.children
        for k in range(1, len(values)):
            value, at = values[k], 0
            while (below := children[at].get(far := (value ^ values[at]).bit_count())) is not None:
                at = below
            children[at][far] = k

    def search(self, queries: np.ndarray, radius: int):
        """Pairs (place of one fingerprint of the tree, places of the queries within the radius of it)."""
        todo = [(0, np.arange(len(queries)))] if len(self.fps) else []
        while todo:
            node, at = todo.pop()
            far = np.bitwise_count(queries[at] ^ self.fps[node])
            hits = at[far <= radius]
            if len(hits):
                yield node, hits
            for edge, child in self.children[node].items():
                near = at[(far >= max(0, edge - radius)) & (far <= edge + radius)]
                self.followed += len(near)
                self.pruned += len(at) - len(near)
                if len(near):
                    todo.append((child, near))


def joined_up(tree: np.ndarray, queries: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that connect all fingerprints of ``tree`` and ``queries`` which hits of queries in the tree connect, at most one for each.

    Without ``queries`` the tree's own are the queries.  A hit inside what is connected already adds no link.
    """
    every = tree if queries is None else np.concatenate([tree, queries])
    shift = 0 if queries is None else len(tree)
    label = np.arange(len(every))
    for k, hits in BKTree(tree).search(tree if queries is None else queries, radius):
        if len(hits) == 1 and hits[0] + shift == k:
            continue
        roots = np.unique(label[np.append(hits + shift, k)])
        if len(roots) > 1:
            label[np.isin(label, roots)] = roots[0]
    own = np.flatnonzero(label != np.arange(len(every)))
    return list(zip(every[own].tolist(), every[label[own]].tolist()))


def block_keys(fp, radius: int, blocks: int):
    """Shard keys of a fingerprint: its bits cut into ``blocks``, one key for each choice of ``blocks - radius`` of them.

    Two fingerprints that differ in at most ``radius`` bits agree in that many blocks at least, so they share a shard.
    """
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        keys.append(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*keys)


def blocks_for(n: int, radius: int, shard: int = SHARD) -> int:
    """Blocks to cut fingerprints into, so that a shard of ``n`` spread ones holds about ``shard`` at most: more blocks give more, narrower keys.  Any number is exact."""
    blocks = radius + 1
    while n >> (64 * (blocks - radius) // blocks) > shard and blocks < radius + 6:
        blocks += 1
    return blocks


def links(fps: DataFrame, radius: int = 4, blocks: int | None = None, tree: int = TREE) -> DataFrame:
    """Links (a, b) among the distinct ``fp`` of ``fps`` that connect all pairs within ``radius``, written to the shared folder.

    Each shard of fingerprints with equal blocks is searched with its own BK-tree; a shard of more than
    ``tree`` is dealt to several trees of that size in other tasks, each of which every fingerprint of
    the shard queries.  A tree emits one link for each fingerprint at most, never all pairs.
    """
    spark = fps.sparkSession
    rows = fps.select(F.explode(block_keys(F.col("fp"), radius, blocks or radius + 1)).alias("key"), "fp")

    def small(batches):
        held_keys, held_fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in itertools.chain(batches, [None]):
            out: list[tuple] = []
            if batch is not None:
                held_keys = np.concatenate([held_keys, batch.column(0).to_numpy()])
                held_fps = np.concatenate([held_fps, batch.column(1).to_numpy().view(np.uint64)])
            if not len(held_keys):
                continue
            starts = np.flatnonzero(np.concatenate([[True], held_keys[1:] != held_keys[:-1]]))
            ends = np.append(starts[1:], len(held_keys))
            whole = slice(0, len(starts) if batch is None else len(starts) - 1)
            sizes = (ends - starts)[whole]
            # Trees of a root and one child, all at once: the root, as a query, follows the edge if its key is within the radius.
            two = starts[whole][sizes == 2]
            near = two[np.bitwise_count(held_fps[two] ^ held_fps[two + 1]) <= radius]
            pairs = [np.stack([held_fps[near], held_fps[near + 1]])]
            for a, n in zip(starts[whole][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                if n > tree:
                    out.append((None, None, int(held_keys[a])))
                elif found := joined_up(held_fps[a : a + n], None, radius):
                    pairs.append(np.array(found, np.uint64).T)
            both = np.concatenate(pairs, axis=1).view(np.int64)
            n = both.shape[1]
            if n or out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[0].tolist() + [None] * len(out), pa.int64()), pa.array(both[1].tolist() + [None] * len(out), pa.int64()), pa.array([None] * n + [x[2] for x in out], pa.int64())], names=["a", "b", "key"]
                )
            # Of a shard that goes on, no more is held than shows that it is too large for one tree.
            a = starts[-1] if batch is not None else len(held_keys)
            held_keys, held_fps = held_keys[a:][: tree + 1], held_fps[a:][: tree + 1]

    found = rows.repartition(deals(spark), "key").sortWithinPartitions("key").mapInArrow(small, "a long, b long, key long")
    found = written(found, "links")
    large = found.where("key is not null").select("key").distinct()
    if large.isEmpty():
        return found.where("key is null").select("a", "b")

    # Too large for one tree: the shard's fingerprints are dealt to trees, and each goes as a query to all of them.
    rows = rows.join(large, "key")
    trees = rows.groupBy("key").agg(F.ceil(F.count("*") / tree).alias("trees"))
    rows = rows.join(trees, "key").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("trees")))
    rows = rows.select("key", "own", "fp", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("to"))
    rows = rows.select("key", "to", (F.col("own") != F.col("to")).alias("asks"), "fp")

    def shared(batches):
        now, members, built = None, [], None
        for batch in batches:
            key, to, asks, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            fp = fp.view(np.uint64)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (to[1:] != to[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, e in itertools.pairwise([0, *cuts.tolist(), len(key)]):
                here, out = (key[a], to[a]), []
                if here != now:
                    if members and built is None:
                        out += joined_up(np.concatenate(members), None, radius)
                    now, members, built = here, [], None
                if not asks[a]:
                    members.append(fp[a:e])
                else:
                    if built is None:
                        built = np.concatenate(members) if members else fp[:0]
                        out += joined_up(built, None, radius) if len(built) else []
                    if len(built):
                        for k in range(a, e, tree):
                            out += joined_up(built, fp[k : min(e, k + tree)], radius)
                if out:
                    both = np.array(out, np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])
        if members and built is None and (out := joined_up(np.concatenate(members), None, radius)):
            both = np.array(out, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    more = rows.repartition(deals(spark), "key", "to").sortWithinPartitions("key", "to", "asks").mapInArrow(shared, "a long, b long")
    every = written(found.where("key is null").select("a", "b").union(more), "links")
    dropped(found)
    return every


def grouped(fps: DataFrame, first: Column, radius: int, tree: int) -> DataFrame:
    """fp, first, component (a fingerprint that stands for all linked ones) for every distinct fingerprint; ``first`` is an aggregate of its rows."""
    nodes = written(fps.groupBy("fp").agg(first.alias("first")), "nodes")
    found = links(nodes.select("fp"), radius, blocks_for(nodes.count(), radius), tree)
    parts = components(found)
    dropped(found)
    return nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, tree: int = TREE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable over links) for every row of ``docs``.

    A null or blank text has fingerprint zero and is linked like any other; rows with equal ids or texts
    each give a row; a null id takes part in links and is never a component's id unless it has no
    other; a text of any length is read whole, and of a bit that half the shingles set it is 0; an empty
    table gives an empty one; other columns are left out.  Equal fingerprints are one
    node, so a group of copies, however large, is one row of a partial aggregate.
    """
    fps = written(fingerprints(docs, width), "fingerprints")
    named = grouped(fps, F.min("doc_id"), radius, tree)
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.where("component <> fp").select("fp", "component").join(lowest, "component").select("fp", "component_id").union(lowest.select(F.col("component").alias("fp"), "component_id"))
    return fps.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, radius: int = 4, width: int = 4, tree: int = TREE) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each component stays: the one with the smallest id, nulls last, then the smallest hash of its text.

    A row is known by its id and its text's hash, so rows that share an id or have none stay or go each
    with its own component; of rows equal in both, any one stands for all.
    """
    mark = F.coalesce(F.md5("text"), F.lit(""))
    fps = written(fingerprints(docs.select("doc_id", "text", mark.alias("mark")), width, "mark"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "mark"))
    named = grouped(fps, first, radius, tree)
    stay = named.groupBy("component").agg(F.min("first").alias("first"))
    names = ["id of the row", "no id", "mark of the text"]
    stay = written(stay.select(F.coalesce("first.id", F.lit(0)).alias(names[0]), F.col("first.no_id").alias(names[1]), F.col("first.mark").alias(names[2])), "stay")
    dropped(fps, named)
    number = F.col("doc_id").cast("long")
    rows = docs.withColumns({names[0]: F.coalesce(number, F.lit(0)), names[1]: number.isNull(), names[2]: mark})
    return rows.dropDuplicates(names).join(stay, names, "left_semi").drop(*names)
