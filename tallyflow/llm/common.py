"""What several operators share: texts as byte arrays, hashed words and shingles, memoised tokenising."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 18


def per_process(name: str, make: Callable[[], Any]) -> Any:
    """An object that all tasks of one Python worker share; functions travel by value, so module globals would not last."""
    kept = sys.__dict__.setdefault("_tallyflow_llm", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


# --- texts as bytes ----------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a batch one after another and where each begins; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """A batch of texts in pieces of about ``most`` bytes, so that work on it stays small beside the batch; a longer text is a piece of its own."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset + 1 : column.offset + len(column) + 1] if len(column) else np.zeros(0, np.int64)
    at, base = 0, int(np.frombuffer(column.buffers()[1], np.int64)[column.offset]) if len(column) else 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield column.slice(at, stop - at)
        at, base = stop, int(ends[stop - 1])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MULTIPLIER
    return h ^ (h >> np.uint64(29))


def byte_table(members: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(members.encode("latin1"), np.uint8)] = True
    return table


#: What separates words in the contracts: space and the controls 9 to 13.
WHITE = byte_table(" \t\n\v\f\r")
#: For words without punctuation: every ASCII byte that is no letter or digit.
MARKS = byte_table("".join(chr(b) for b in range(128) if not chr(b).isalnum()))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def make(size):
        rng = np.random.default_rng(20240131)
        base = int(rng.integers(1, 2**62)) * 2 + 1
        inverse = pow(base, -1, 2**64)
        letters = rng.integers(0, 2**64, 256, dtype=np.uint64, endpoint=False)
        letters[65:91] = letters[97:123]  # A-Z as a-z
        up, down = np.full(size + 1, base, np.uint64), np.full(size + 1, inverse, np.uint64)
        up[0] = down[0] = 1
        return letters, np.cumprod(up), np.cumprod(down)

    tables = per_process("powers", lambda: make(4 * BLOCK))
    return tables if n < len(tables[1]) else make(n)


def word_spans(raw: np.ndarray, bounds: np.ndarray, apart: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, A-Z taken as a-z, where the word begins and where it ends.

    A word is a run of bytes outside ``apart``; none spans two texts. Runs in
    blocks, so memory beyond the words themselves does not follow the text.
    """
    found, at = [], 0
    total = len(raw)
    while at < total:
        stop = min(at + BLOCK, total)
        if stop < total:  # up to the next separator or text boundary
            limit = int(bounds[np.searchsorted(bounds, stop)])
            while stop < limit:
                white = np.flatnonzero(apart[raw[stop : min(stop + 4096, limit)]])
                if len(white):
                    stop += int(white[0])
                    break
                stop = min(stop + 4096, limit)
        part = raw[at:stop]
        n = len(part)
        inner = ~apart[part]
        first, last = np.searchsorted(bounds, [at, stop], "left")
        cuts = bounds[first:last] - at
        begins = np.empty(n, bool)
        begins[0], begins[1:] = True, ~inner[:-1]
        begins[cuts] = True
        ends = np.empty(n, bool)
        ends[-1], ends[:-1] = True, ~inner[1:]
        ends[cuts[cuts > 0] - 1] = True
        starts, stops = np.flatnonzero(inner & begins), np.flatnonzero(inner & ends) + 1
        letters, up, down = _powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(letters[part] * up[:n], out=sums[1:])
        found.append((mixed((sums[stops] - sums[starts]) * down[starts]), starts + at, stops + at))
        at = stop
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def hashed_words(raw: np.ndarray, bounds: np.ndarray, apart: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the words before each text."""
    words, starts, _ = word_spans(raw, bounds, apart)
    return words, np.searchsorted(starts, bounds)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; fewer words make one shingle of the whole sequence."""
    odd = [np.uint64(0xD6E8FEB86659FD93 + 2 * k * 0x51ED270B) for k in range(width)]
    for piece in slices(column):
        words, before = hashed_words(*text_bytes(piece))
        rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            rolled += mixed(words[k : k + len(rolled)] * odd[k])
        rolled = mixed(rolled)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                whole = np.uint64(b - a)
                for k in range(b - a):
                    whole = whole + mixed(words[a + k : a + k + 1] * odd[k])
                yield mixed(mixed(whole))
            else:
                yield np.zeros(0, np.uint64)


# --- tokens ------------------------------------------------------------------

#: UTF-8 forms of white space above ASCII, by their length.
_WIDE_WHITE = {2: ["\x85", "\xa0"], 3: ["\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]}
#: Letters that composing and lower-casing turn into one letter each: ASCII and U+00C0 to U+017F, without the signs
#: for times and division and without U+0130, which becomes a letter and a mark.
_PLAIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"


def _white(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are part of white space, and for the last byte of white space above ASCII its length, else 1."""
    white, width = WHITE[raw], np.ones(len(raw), np.int8)
    for size, members in _WIDE_WHITE.items():
        codes = np.array([int.from_bytes(m.encode(), "big") for m in members])
        lead = np.isin(raw[: len(raw) - size + 1], np.unique(codes >> 8 * (size - 1)))
        at = np.flatnonzero(lead)
        code = sum(raw[at + k].astype(np.int64) << 8 * (size - 1 - k) for k in range(size))
        at = at[np.isin(code, codes)]
        for k in range(size):
            white[at + k] = True
        width[at + size - 1] = size
    return white, width


def _behind_letter(raw: np.ndarray) -> np.ndarray:
    """ASCII marks right behind a plain letter. No pre-tokenizer here joins a letter with such a mark."""
    at = np.flatnonzero(_POINTS[raw])
    at = at[at > 0]
    last, lead = raw[at - 1], raw[at - 2]
    two = (lead >= 0xC3) & (lead <= 0xC5) & (last >= 0x80) & (last <= 0xBF)
    two &= ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7))) & ~((lead == 0xC4) & (last == 0xB0)) & (at > 1)
    return at[_LETTERS[last] | two]


_POINTS = byte_table("".join(chr(b) for b in range(33, 127) if not chr(b).isalnum()))
_LETTERS = byte_table("".join(chr(b) for b in range(128) if chr(b).isalpha()))


def chunk_starts(raw: np.ndarray, bounds: np.ndarray, keep_white: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks of all texts begin, and which bytes belong to none.

    With ``keep_white`` chunks tile the texts: a run without white space takes the one
    space before it, of other white space before a run the last character is a chunk and
    the rest another. Otherwise white space belongs to no chunk. A mark behind a plain
    letter begins a chunk.
    """
    n = len(raw)
    white, width = _white(raw)
    first = np.zeros(n, bool)
    first[bounds[bounds < n]] = True
    begins = first.copy()
    before = np.empty(n, bool)  # white space of the same text before it
    if n:
        before[0], before[1:] = False, white[:-1]
    before &= ~first
    words = np.flatnonzero(~white & before)
    begins[_behind_letter(raw)] = True
    if keep_white:
        begins |= white & ~before
        begins[words - width[words - 1]] = True
        begins[words[raw[words - 1] != 32]] = True
        begins[words[raw[words - 1] == 32]] = False
        return np.flatnonzero(begins), np.zeros(n, bool)
    begins[words] = True
    return np.flatnonzero(begins & ~white), white


class Chunked:
    """Token ids of whole texts, encoded chunk by chunk and remembered.

    A text's ids are those of its chunks in order: both kinds of vocabulary split
    where chunks begin, whatever stands around. A batch's distinct chunks are found by
    Arrow; those not met before go to the library, plain words straight to its model, as
    its normalizing and splitting leave them whole. The memory knows a chunk of up to 64 bytes by
    two 64-bit hashes, one to look it up and one to check it; it begins anew beyond ``most`` of them. Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.keep_white, self.lower = bool(self._ids([" "])[0]), self._ids(["A"]) == self._ids(["a"])
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.as_byte = {b: 256 + i for i, b in enumerate(hidden)}  # how byte-level vocabularies write bytes that do not print
        self.most = most
        self.hash, self.check, self.number = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.ends, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0

    def _ids(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(chunks), 20_000) for e in self.tokenizer.encode_batch_fast(chunks[at : at + 20_000], add_special_tokens=False)]

    def _word(self, word: str) -> list[int]:
        """The ids of a plain word, with a space before it or not."""
        word = word.lower() if self.lower else word
        word = word.replace(" ", "\u0120") if word.isascii() else word.encode().decode("latin1").translate(self.as_byte)
        return [t.id for t in self.model.tokenize(word)]

    def _add(self, lists: list[list[int]]) -> np.ndarray:
        """Puts ids at the end of the store and returns their numbers there."""
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        first, used = self.count, int(self.ends[self.count])
        self.count += len(lists)
        ends = used + np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else used
        while total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[used:total] = np.fromiter((i for ids in lists for i in ids), np.uint32, total - used)
        self.ends[first + 1 : self.count + 1] = ends
        return np.arange(first, self.count)

    def _hashes(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each chunk, from running sums over the bytes of all."""
        letters = per_process("letters", lambda: np.random.default_rng(20240229).integers(0, 2**64, (2, 256), dtype=np.uint64, endpoint=False))
        raw, bounds = text_bytes(chunks)
        _, up, down = _powers(len(raw))
        out = []
        for table in letters:
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(table[raw] * up[: len(raw)], out=sums[1:])
            out.append(mixed((sums[bounds[1:]] - sums[bounds[:-1]]) * down[bounds[:-1]]))
        return out[0], out[1]

    def _numbers(self, chunks: pa.Array) -> np.ndarray:
        """For each distinct chunk its number in the store; long chunks are last there, to be forgotten."""
        if len(self.hash) + len(chunks) > self.most:
            self.hash, self.check, self.number, self.count = self.hash[:0], self.check[:0], self.number[:0], 0
        found, check = self._hashes(chunks)
        place = np.searchsorted(self.hash, found)
        near = np.minimum(place, max(0, len(self.hash) - 1))
        known = (self.hash[near] == found) & (self.check[near] == check) if len(self.hash) else np.zeros(len(found), bool)
        numbers = np.full(len(found), -1, np.int64)
        numbers[known] = self.number[near[known]]
        new = np.flatnonzero(~known)
        if len(new):
            values = chunks.take(pa.array(new))
            plain = pc.match_substring_regex(values, f"^ ?[{_PLAIN}]+$").to_numpy(zero_copy_only=False)
            short = pc.binary_length(values).to_numpy(zero_copy_only=False) <= 64
            spelled = np.array(values.to_pylist(), object)
            words, others, long = (np.flatnonzero(x) for x in (plain & short, ~plain & short, ~short))
            numbers[new[words]] = self._add([self._word(w) for w in spelled[words]])
            numbers[new[others]] = self._add(self._ids(spelled[others].tolist()))
            kept = new[short]
            kept = kept[np.argsort(found[kept])]
            at = place[kept]
            self.hash, self.check = np.insert(self.hash, at, found[kept]), np.insert(self.check, at, check[kept])
            self.number = np.insert(self.number, at, numbers[kept].astype(np.int32))
            numbers[new[long]] = self._add(self._ids(spelled[long].tolist()))
        return numbers

    def encode(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin."""
        starts, dropped = chunk_starts(raw, bounds, self.keep_white)
        before = np.searchsorted(starts, bounds)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        if dropped.any():
            kept = ~dropped
            places = np.cumsum(kept)
            starts, raw = places[starts] - 1, raw[kept]
        offsets = np.append(starts, len(raw))
        chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
        coded = chunks.dictionary_encode()
        numbers = self._numbers(coded.dictionary)
        at = self.ends[numbers]
        size = self.ends[numbers + 1] - at
        codes = coded.indices.to_numpy()
        sizes = size[codes]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(at[codes] - (ends - sizes), sizes) + np.arange(ends[-1])]
        self.count = len(self.hash)  # long chunks leave the store
        return ids, np.append(0, ends)[before]


def token_ids(path: str, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of a batch of texts, some megabytes at a time: all ids, and where each text's begin; null counts as empty."""
    encode = per_process(f"tokens {path}", lambda: Chunked(path))
    for piece in slices(texts):
        yield encode.encode(*text_bytes(piece))


def token_bytes(path: str, texts: pa.Array) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit bytes; null counts as empty."""
    for ids, bounds in token_ids(path, texts):
        data = ids.astype("<u4").tobytes()
        yield from (data[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
