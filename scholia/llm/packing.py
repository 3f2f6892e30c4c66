"""Packing along a space-filling curve: neighbouring documents of a Hilbert order share sequences."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder, slices, with_end
from .shared import parts_for, pick, written

#: Dimensions and bits of each in the curve's key; buckets of the hashed document vector.
DIMENSIONS, BITS, BUCKETS = 4, 8, 1024
#: Ids of one row on the way to its range; a longer document is several rows, so ranges of rows are even in bytes.
CHUNK = 32_768
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


@lru_cache(2)
def projection(buckets: int = BUCKETS, dimensions: int = DIMENSIONS, seed: int = 20240607) -> np.ndarray:
    """A fixed Gaussian projection of hashed vectors."""
    return np.random.default_rng(seed).normal(size=(buckets, dimensions)).astype(np.float32)


def vectors(ids: list[np.ndarray], buckets: int = BUCKETS) -> np.ndarray:
    """Few-dimensional vectors of documents: root counts of hashed ids, at unit length, projected.  No ids: the origin."""
    out = np.zeros((len(ids), DIMENSIONS), np.float32)
    for k, x in enumerate(ids):
        if len(x):
            hashed = (x.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - buckets.bit_length() + 1)
            v = np.sqrt(np.bincount(hashed, minlength=buckets).astype(np.float32))
            out[k] = (v / np.sqrt((v * v).sum())) @ projection(buckets)
    return out


def cells(v: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Grid cells of projected vectors: a logistic curve spreads each coordinate, about normal, over 2**bits cells."""
    u = 1 / (1 + np.exp(-1.702 * v.astype(np.float64)))
    return np.minimum((u * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def hilbert_key(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions of grid cells (rows of ``x``) on the Hilbert curve of as many dimensions as ``x`` has columns.

    Skilling's transform (2004), over all rows at once: from the highest bit down, undo the excess
    rotation of each axis, then Gray decode, then interleave the bits.
    """
    x = x.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= np.where(flip & (i > 0), 0, swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, curve (Hilbert key), tie (a sum over the ids), nth (tells equal rows of a task apart), start, doc_tokens, ids (little-endian unsigned 32-bit, with ``end_id``) of every whole text, CHUNK ids a row."""

    def encode(batches):
        encode, before = encoder(vocabulary).encode, 0
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids, n = encode(batch.column(1).slice(a, b - a))
                ends = np.cumsum(n)
                curve = hilbert_key(cells(vectors([ids[e - k : e] for e, k in zip(ends.tolist(), n.tolist())])))
                ids, n = with_end(ids, n, end_id)
                ends, raw = np.cumsum(n), memoryview(ids).cast("B")
                tie = np.array([zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())], np.int64)
                rows = -(-n // CHUNK)
                row = np.repeat(np.arange(b - a), rows)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(rows) - rows, rows)) * CHUNK
                offsets = np.append(4 * ((ends - n)[row] + start), 4 * len(ids)).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(curve[row]), pa.array(tie[row]), pa.array(before + row), pa.array(start), pa.array(n[row]), blobs], names=["doc_id", "curve", "tie", "nth", "start", "doc_tokens", "ids"])
                before += b - a

    return pick(docs, doc_id="long", text="string").mapInArrow(encode, "doc_id long, curve long, tie long, nth long, start long, doc_tokens long, ids binary")


def cut(lengths: list[int], at: int, room: int):
    """Pieces of documents laid end to end from place ``at`` of a sequence of ``room``: (document, start, length, sequence, offset)."""
    sequence, offset = divmod(at, room)
    for k, n in enumerate(lengths):
        start = 0
        while start < n:
            take = min(n - start, room - offset)
            yield k, start, take, sequence, offset
            start += take
            offset += take
            if offset == room:
                sequence, offset = sequence + 1, 0


def pack(docs: DataFrame, vocabulary: str, end_id: int, room: int = 2048, partitions: int | None = None) -> DataFrame:
    """Packs every document's ids, ``end_id`` after each, into sequences of at most ``room``; one row per piece (PIECES).

    Documents are sorted by range of their Hilbert key, ties (copies) by id, and laid end to end along
    the curve within each range, cut where a sequence is full.  What is left at a range's end (under
    ``room``) is cut into sequences whose lengths are falling powers of two, so nothing is padded where
    ``room`` is a power of two.  ``sequence_id`` holds the range in its upper bits, so ids are unique
    and order follows the curve.  A null text counts as empty (its piece is ``end_id``); null ids are
    kept; a very long text travels in rows of CHUNK ids; repeated rows are each packed; an empty table
    gives an empty table; other columns are left out.
    """
    rows, order = written(encoded(docs, vocabulary, end_id), "encoded"), ["curve", "doc_id", "tie", "nth", "start"]
    rows = rows.repartitionByRange(partitions or parts_for(rows), *order).sortWithinPartitions(*order).select("doc_id", "start", "doc_tokens", "ids")

    def lay(batches):
        from pyspark import TaskContext

        base, at, held = TaskContext.get().partitionId() << 40, 0, []

        def batch_of(pieces):
            cols = list(zip(*pieces)) if pieces else [()] * 8
            kinds = [pa.int64()] * 7 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            docs, starts, totals, blobs = (batch.column(k).to_pylist() for k in range(4))
            lengths, out = [len(x) // 4 for x in blobs], []
            for k, start, n, sequence, offset in cut(lengths, at, room):
                ids = blobs[k][4 * start : 4 * (start + n)]
                held.append((docs[k], starts[k] + start, n, zlib.crc32(ids), totals[k], base + sequence, offset, ids))
                if offset + n == room:
                    out += held
                    held = []
            at += sum(lengths)
            yield batch_of(out)
        yield batch_of(tail(held, at % room))

    return rows.mapInArrow(lay, PIECES)


def tail(held: list[tuple], left: int) -> list[tuple]:
    """The pieces of a last sequence with ``left`` ids, dealt to sequences of falling powers of two."""
    out, sizes = [], [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
    if not sizes:
        return out
    k, offset, first = 0, 0, held[0][5]
    for doc, start, n, _, total, _, _, ids in held:
        done = 0
        while done < n:
            take = min(n - done, sizes[k] - offset)
            part = ids[4 * done : 4 * (done + take)]
            out.append((doc, start + done, take, zlib.crc32(part), total, first + k, offset, part))
            done, offset = done + take, offset + take
            if offset == sizes[k]:
                k, offset = k + 1, 0
    return out
