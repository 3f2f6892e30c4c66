"""Token ids of whole texts by the tokenizers library, with a cache of words."""

from __future__ import annotations

import codecs
import json
import os
import re
import string
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words, and ids of words, that a worker holds; beyond either the cache starts anew, so memory stays bounded.
CACHED_WORDS, CACHED_IDS = 600_000, 5_000_000
#: Longer pieces are held for one batch only.
LONG_WORD = 100
#: Marks that end words, of which runs are held apart from them.
MARKS = string.punctuation
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
#: White space of any kind, as RE2 writes it; it may name more characters than the library's, not fewer.
_BLANK = r"[\t-\r\x1c- \x{85}\p{Z}]"
#: Words of Latin letters alone, which the pre-tokenizer never cuts.
_LETTERS = r"^[A-Za-zÀ-ÖØ-öø-ɏ]+$"


def _alphabet() -> str:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in own else next(others)) for b in range(256))


_BYTES = _alphabet()


def listed(texts: pa.Array) -> list[str]:
    """Strings of an array, by way of numpy, which makes them far sooner than ``to_pylist``."""
    return texts.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of texts as the library gives them with ``add_special_tokens=False``.

    The byte-level pre-tokenizer always cuts before a single space or line break between two visible
    characters, and between a letter or digit and a run of marks at a word's end.  So a text is the sum
    of its pieces between such spaces and breaks: the ids of a piece depend on nothing around it and are
    asked of the library once per worker.  Texts with other runs of white space are cut at single spaces
    only; a text that holds an added token's string, and any text under another kind of tokenizer file,
    is encoded by the library as a whole.  Words of Latin letters are one pre-token each, so they go
    straight to the library's BPE model.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        cutter, model, after = spec["pre_tokenizer"] or {}, spec["model"], spec["post_processor"] or {"type": "ByteLevel"}
        self.by_words = (
            cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space") and after["type"] == "ByteLevel"
            and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and not any(spec[k] for k in ("normalizer", "truncation", "padding"))
        )
        self.added = [t["content"] for t in spec["added_tokens"]]
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.breaks = self.opens.copy()
        for token, k in vocabulary.items():
            self.opens[k], self.breaks[k] = token.startswith("Ġ"), token.startswith("Ċ")
        # The library's own cache of words gains nothing: each word is asked for once.
        self.tokenizer.model._resize_cache(0)
        self.tokenize, self.line = self.tokenizer.model.tokenize, self._by_library(["\n"])[0]
        probe = ["a", "Straße", "naïveté", "PŘÍKLAD"]
        self.letters = self.by_words and [x.tolist() for x in self._by_library([" " + w for w in probe])] == [[t.id for t in self.tokenize(codecs.charmap_decode(f" {w}".encode(), "strict", _BYTES)[0])] for w in probe]
        self._clear()

    def _clear(self) -> None:
        """Starts the cache anew.  A piece's number leads to its place and length in ``ids``; number 0 marks pieces that cannot stand alone."""
        self.words: dict[str, int] = {}
        self.firsts: dict[str, int] = {}
        self.tails: dict[str, int] = {"": 1}
        self.ids, self.start, self.n = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.held, self.used = 2, 0

    def _by_library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _hold(self, flat: np.ndarray, n: np.ndarray) -> range:
        """Numbers of pieces whose ids stand one after the other in ``flat``."""
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.held + len(n) > len(self.n):
            self.start, self.n = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.n, np.zeros_like(self.n)])
        first, last = self.held, self.held + len(n)
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[first:last], self.n[first:last] = self.used + np.cumsum(n) - n, n
        self.held, self.used = last, self.used + len(flat)
        return range(first, last)

    def _hold_each(self, known: dict[str, int], pieces: list[str], before: str = "") -> None:
        if pieces:
            found = self._by_library([before + p for p in pieces])
            known.update(zip(pieces, self._hold(np.concatenate(found), np.array([len(x) for x in found], np.int64)), strict=True))

    def _hold_several(self, pieces: list[str], before: str, opens: np.ndarray, key: str = "") -> None:
        """Learns pieces that each follow ``before``: encoded in one text, cut where a token opens with it."""
        for k in range(0, len(pieces), 2000):
            part = pieces[k : k + 2000]
            ids = self._by_library([before + before.join(part)])[0]
            starts = np.flatnonzero(opens[ids])
            if len(starts) == len(part):
                n = np.diff(np.append(starts, len(ids)))
            else:
                found = self._by_library([before + w for w in part])
                ids, n = np.concatenate(found), np.array([len(x) for x in found], np.int64)
            self.words.update(zip([key + w for w in part] if key else part, self._hold(ids, n), strict=True))

    def _hold_letters(self, pieces: list[str], key: str = "") -> None:
        """As ``_hold_several``, for words of Latin letters: each is one pre-token, so the model alone is asked."""
        mark, tokenize = _BYTES[10], self.tokenize
        opening = "" if key else _BYTES[32]
        for k in range(0, len(pieces), 5000):
            part = pieces[k : k + 5000]
            coded = codecs.charmap_decode("\n".join(part).encode(), "strict", _BYTES)[0].split(mark)
            tokens = [tokenize(opening + w) for w in coded]
            n = np.fromiter(map(len, tokens), np.int64, len(tokens))
            ids = np.array([t.id for each in tokens for t in each], "<u4")
            if key:
                ids, n = np.insert(ids, np.repeat(np.cumsum(n) - n, len(self.line)), np.tile(self.line, len(n))), n + len(self.line)
            self.words.update(zip([key + w for w in part] if key else part, self._hold(ids, n), strict=True))

    def _gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces laid end to end, and how many each has."""
        n = self.n[numbers]
        ends = np.cumsum(n)
        at = np.repeat(self.start[numbers] - ends + n, n)
        at += np.arange(len(at))
        return self.ids[at], n

    def _learn(self, pieces: pa.Array) -> None:
        """Holds distinct pieces that are not held: with a line break in front, or else as if a space stood there."""
        line = pc.starts_with(pieces, "\n")
        core = pc.if_else(line, pc.utf8_slice_codeunits(pieces, 1), pieces)
        odd = pc.or_(pc.match_substring_regex(core, _BLANK), pc.equal(core, ""))
        apart = listed(pieces.filter(odd))
        self.words.update((w, 0) for w in apart if not w or w[0].isspace() or w[-1].isspace())
        self._hold_each(self.words, [w for w in apart if w not in self.words], " ")
        usual = pc.invert(odd)
        pieces, core, line = pieces.filter(usual), core.filter(usual), line.filter(usual)
        body = pc.utf8_rtrim(core, MARKS)
        ended = pc.and_(pc.utf8_is_alnum(pc.utf8_slice_codeunits(body, -1)), pc.not_equal(body, core))
        body = pc.if_else(ended, body, core)
        for mark, before, opens in ((pc.invert(line), " ", self.opens), (line, "\n", self.breaks)):
            key, new = "\n" if before == "\n" else "", body.filter(mark).unique()
            known = self.words
            plain = pc.and_(pc.match_substring_regex(new, _LETTERS), self.letters)
            self._hold_letters([w for w in listed(new.filter(plain)) if key + w not in known], key)
            self._hold_several([w for w in listed(new.filter(pc.invert(plain))) if key + w not in known], before, opens, key)
        # A piece that ends in marks is its body's ids and the marks'.
        whole, inner, cut = (listed(x.filter(ended)) for x in (pieces, core, body))
        lined = np.asarray(line.filter(ended)).tolist()
        tails = [w[len(b) :] for w, b in zip(inner, cut)]
        self._hold_each(self.tails, [t for t in dict.fromkeys(tails) if t not in self.tails])
        numbers = np.empty((len(whole), 2), np.int64)
        numbers[:, 0] = [self.words["\n" + b if x else b] for b, x in zip(cut, lined)]
        numbers[:, 1] = [self.tails[t] for t in tails]
        flat, n = self._gathered(numbers.ravel())
        self.words.update(zip(whole, self._hold(flat, n.reshape(-1, 2).sum(1)), strict=True))

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """The number of each of distinct ``pieces``."""
        words = listed(pieces)
        get = self.words.get
        found = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        if len(new):
            self._learn(pieces.take(pa.array(new)))
            found[new] = [get(words[k]) for k in new.tolist()]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (little-endian unsigned 32-bit) of texts laid end to end, and how many each text has.  A null text has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_words:
            apart = dict(enumerate(self._by_library(texts.to_pylist())))
            return np.concatenate([np.zeros(0, "<u4"), *apart.values()]), np.array([len(x) for x in apart.values()], np.int64)
        if len(self.words) > CACHED_WORDS or self.used > CACHED_IDS:
            self._clear()
        apart = {}
        for token in self.added:
            for k in np.flatnonzero(np.asarray(pc.match_substring(texts, token))).tolist():
                apart[k] = self._by_library([texts[k].as_py()])[0]
        if apart:
            hidden = np.zeros(len(texts), bool)
            hidden[list(apart)] = True
            split = pc.if_else(pa.array(hidden), "", texts)
        else:
            split = texts
        split = pc.split_pattern(pc.replace_substring(split, "\n", " \n"), " ")
        pieces, offsets = split.flatten(), np.asarray(split.offsets).astype(np.int64)
        offsets -= offsets[0]
        opening = listed(pieces.take(pa.array(offsets[:-1])))
        self._hold_each(self.firsts, [w for w in dict.fromkeys(opening) if w not in self.firsts])
        later = np.ones(len(pieces), bool)
        later[offsets[:-1]] = False
        coded = pieces.filter(pa.array(later)).dictionary_encode()
        numbers = np.empty(len(pieces), np.int64)
        numbers[offsets[:-1]] = [self.firsts[w] for w in opening]
        numbers[later] = self._numbers(coded.dictionary)[np.asarray(coded.indices)]
        lost = np.flatnonzero(numbers == 0)
        if len(lost):
            for k in np.unique(np.searchsorted(offsets, lost, "right") - 1).tolist():
                apart[k] = self._apart(texts[k].as_py())
                numbers[offsets[k] : offsets[k + 1]] = 1
        flat, n = self._gathered(numbers)
        ends = np.concatenate([[0], np.cumsum(n)])[offsets]
        counts = np.diff(ends)
        if apart:
            parts, at = [], 0
            for k, ids in sorted(apart.items()):
                parts += [flat[at : ends[k]], ids]
                at, counts[k] = ends[k + 1], len(ids)
            flat = np.concatenate([*parts, flat[at:]])
        for known in (self.words, self.firsts):
            for w in [w for w in (opening if known is self.firsts else coded.dictionary.filter(pc.greater(pc.binary_length(coded.dictionary), LONG_WORD)).to_pylist()) if len(w) > LONG_WORD]:
                known.pop(w, None)
        return flat, counts

    def _apart(self, text: str) -> np.ndarray:
        units = _BOUNDARY.split(text)
        if len(units) == 1:
            return self._by_library(units)[0]
        first, last = self._by_library([units[0], " " + units[-1]])
        coded = pa.array(units[1:-1], pa.string()).dictionary_encode()
        return np.concatenate([first, self._gathered(self._numbers(coded.dictionary)[np.asarray(coded.indices)])[0], last])


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One per worker and vocabulary file."""
    return Encoder(path)


def slices(texts: pa.Array, most_bytes: int = 4_000_000):
    """Runs of ``texts`` of about ``most_bytes`` each, as (start, end); a longer text is a run of its own end."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // most_bytes
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)] if len(texts) else [0]
    return zip(edges, edges[1:])


def with_end(flat: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids and ``end_id`` after them."""
    return np.insert(flat, np.cumsum(counts), end_id).astype("<u4"), counts + 1
