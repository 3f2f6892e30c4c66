import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scholia.llm import packing, token_output
from scholia.llm.encoding import encoder, slices
from scholia.llm.shared import fresh_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [(1, "Hello there, world's  end.\n\n New line"), (2, "a  b   c "), (3, " lead"), (4, "tab\tand nbsp x"), (5, "emoji \U0001f600 <|endoftext|> ok"), (7, "trail \n"), (8, "\n "), (10, "x")]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


LIBRARY = Tokenizer.from_file(PATH)


def same(path, library, texts):
    flat, counts = encoder(path).encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    assert [flat[e - n : e].tolist() for e, n in zip(ends.tolist(), counts.tolist())] == [library.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert len(flat) == (ends[-1] if len(ends) else 0)


PIECES = st.sampled_from(["a", "b", " ", " ", "\n", "\t", ",", ".", "'s", "#", "é", "Ħ", "中", "1", "²", "\u00a0", "\u3000", "\x1c", "\x85", "\r", "<|endoftext|>", "<|", "|>", "_", "ß", "\u0301", "\U0001f600"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab ,.'s\n\t \u3000é1\x1c", max_size=30), st.lists(PIECES, max_size=25).map("".join)), max_size=6))
def test_cached_words_give_the_librarys_ids(texts):
    same(PATH, LIBRARY, texts)


def test_special_strings_long_words_and_a_full_cache(monkeypatch):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\ny z", "w" * 5000 + " end" + "!" * 300, None, "", "plain words, here.\nand there"]
    same(PATH, LIBRARY, texts)
    assert LIBRARY.encode("a <|endoftext|> b", add_special_tokens=False).ids.count(50256) == 1
    monkeypatch.setattr("scholia.llm.encoding.CACHED_WORDS", 3)
    for k in range(5):
        same(PATH, LIBRARY, [*texts, f"other{k} words{k}, of round {k}"])


def test_another_kind_of_tokenizer_is_left_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    same(path, Tokenizer.from_file(path), ["Hello there, <|endoftext|> World  end.\n", None, "", "naïve café"])


def test_slices_cover_every_row():
    for texts in ([], ["a"], ["x" * 10, None, "y" * 50, "", "z" * 3]):
        for size in (1, 7, 1000):
            cut = list(slices(pa.array(texts, pa.string()), size))
            assert [k for a, b in cut for k in range(a, b)] == list(range(len(texts))) and all(a < b for a, b in cut)


def test_token_files(spark, docs, plain):
    df = docs(TEXTS)
    path = fresh_path(spark, "t")
    got = token_output.token_positions(token_output.write_tokens(df, path, PATH, 0, 3)).collect()
    rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    start, want = 0, []
    for doc, text in rows:
        ids = [*plain(text), 0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert [r.doc_id for r in token_output.read_tokens(spark, path, [905]).collect()] == [905]
    assert [r.tokens for r in token_output.read_tokens(spark, path, [10]).collect()] == [[*plain("x"), 0]]


def test_token_files_of_no_documents(spark, docs):
    df = docs([], extra=False)
    assert token_output.token_positions(token_output.write_tokens(df, fresh_path(spark, "t"), PATH, 0)).count() == 0


@pytest.mark.parametrize("chunk", [100, packing.CHUNK])
def test_packing(spark, docs, plain, monkeypatch, chunk):
    monkeypatch.setattr(packing, "CHUNK", chunk)
    df = docs([(k, f"text number {k} " * (k % 40)) for k in range(100)])
    got = packing.pack(df, PATH, 1, room=256, partitions=3).collect()
    ids = defaultdict(list)
    for r in df.collect():
        ids[r.doc_id].append([*plain(r.text), 1])
    pieces, fill = defaultdict(Counter), defaultdict(list)
    for r in got:
        part = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.length == len(part) > 0 and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        assert any(x[r.start : r.start + r.length] == part and len(x) == r.doc_tokens for x in ids[r.doc_id])
        pieces[r.doc_id].update(range(r.start, r.start + r.length))
        fill[r.sequence_id].append((r.offset, r.length))
    for doc, copies in ids.items():
        assert pieces[doc] == Counter({k: len(copies) for k in range(len(copies[0]))})
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 256 or at < 256 and at & (at - 1) == 0
    assert packing.pack(docs([], extra=False), PATH, 1).count() == 0


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_keys_walk_the_grid(dimensions, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), -1).reshape(-1, dimensions)
    key = packing.hilbert_key(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    steps = np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_lookups_skip_row_groups(spark):
    """A lookup by id reads a row group of the stride or less, though the file holds many; an id in no group's Bloom filter reads none."""
    df = spark.range(0, 24_000, 2).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    path = fresh_path(spark, "t")
    token_output.write_tokens(df, path, PATH, 0, 1)

    def rows_read(doc):
        found = token_output.read_tokens(spark, path, [doc])
        got = [r.doc_id for r in found.collect()]
        plan = found._jdf.queryExecution().executedPlan()
        leaf = plan.collectLeaves().head()
        return got, leaf.metrics().apply("numOutputRows").value()

    got, read = rows_read(15_000)
    assert got == [15_000] and 0 < read <= int(token_output.ORC["orc.row.index.stride"])
    got, read = rows_read(15_001)
    assert got == [] and read <= int(token_output.ORC["orc.row.index.stride"])
    assert rows_read(99_999_999) == ([], 0)
