"""Whole-text encoding with the tokenizers library, once per distinct piece of text.

Both kinds of file split a text into pre-tokens and encode each by itself, so a pre-token's ids may
be kept and used again. The library encodes every new pre-token; this module only finds them, and
only in texts whose characters it classes surely: below U+0250, without the separators U+001C to
U+001F and without special strings. All other texts go to the library whole.

Pre-tokens are found in arrays of code points and told apart by 64-bit hashes. What is known lies in
a table of fixed size, with two places for a hash, and a pool of ids, so a worker's memory is bounded.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np

from ._shared import span_hashes

LIMIT = 0x250
SLOTS = 1 << 19
POOL_IDS = 2 << 20
SPLIT_CHARS = 50_000
TEXT_CHARS = 1 << 19
_U = np.uint64
_SPACE = "\\t-\\r \\x85\\xa0"
_OTHER, _LETTER, _DIGIT, _BLANK = range(4)


def _classes() -> np.ndarray:
    """Class of each character below LIMIT; what lies beyond is never looked up."""
    out = np.full(LIMIT, _OTHER, dtype=np.uint8)
    for c in range(LIMIT):
        kind = unicodedata.category(chr(c))[0]
        out[c] = _LETTER if kind == "L" else _DIGIT if kind == "N" else _OTHER
    out[[*range(9, 14), 0x20, 0x85, 0xA0]] = _BLANK
    return out


_CLASS = _classes()
_UNSURE = re.compile("[^\\x00-\\x1b -\\u024f]")
#: Endings after an apostrophe that are pre-tokens of their own.
_SHORT, _LONG = "stmd", ("re", "ve", "ll")


def pre_tokens(codes: np.ndarray, heads: np.ndarray, keep_blanks: bool) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each pre-token in code points of sure texts that begin at heads, the first at 0.

    A run of letters, of digits (or, without blanks, each digit), of other characters; an apostrophe
    with an ending is one. With keep_blanks a space before one belongs to it, and so no apostrophe
    after a space has an ending; the rest of a run of blanks is one, its last character by itself
    unless the text ends there.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[codes]
    head = np.zeros(n + 1, dtype=bool)
    head[heads[heads < n]] = True
    head[n] = True
    first = head[:-1].copy()
    first[1:] |= kind[1:] != kind[:-1]
    if not keep_blanks:
        first |= kind == _DIGIT
    quotes = np.flatnonzero((codes == 39) & first)
    if keep_blanks:
        quotes = quotes[(quotes == 0) | head[quotes] | (codes[quotes - 1] != 32)]
    if len(quotes):
        at = lambda k: np.where(quotes + k < n, codes[np.minimum(quotes + k, n - 1)], 0) * ~np.logical_or.reduce([head[np.minimum(quotes + i, n)] for i in range(1, k + 1)])
        one, two = at(1), at(2)
        size = np.isin(one, [ord(c) for c in _SHORT]).astype(np.int64)
        for a, b in _LONG:
            size[(one == ord(a)) & (two == ord(b))] = 2
        quotes, size = quotes[size > 0], size[size > 0]
        first[quotes + 1] = False
        after = quotes + 1 + size
        inside = after < n
        first[after[inside]] = True
    if not keep_blanks:
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], n)
        solid = kind[starts] != _BLANK
        return starts[solid], ends[solid]
    blank = kind == _BLANK
    last = blank.copy()  # the last of a run of blanks that something follows in its text
    last[:-1] &= ~blank[1:]
    last &= ~head[1:]
    spot = np.flatnonzero(last)
    first[spot] = True
    glued = spot[codes[spot] == 32]
    first[glued + 1] = False
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], n)


class Encoder:
    """Encodes texts as the file's library does, without added special tokens; one of a file serves for ids and for counts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, self.specials)) or "(?!)")
        pre = spec["pre_tokenizer"] or {}
        self.kind = "library"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"]:
            self.kind = "byte"
        elif [x.get("type") for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.kind = "word"
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 0x10000 else "<u4")
        self.last = None
        if self.kind == "word" and spec["model"].get("end_of_word_suffix"):
            self.last = np.zeros(self.library.get_vocab_size(with_added_tokens=True), dtype=bool)
            self.last[[i for w, i in self.library.get_vocab(with_added_tokens=False).items() if w.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.code = "HI"[self.dtype.itemsize == 4]
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(SLOTS, dtype=_U)
        self.places = np.zeros(SLOTS, dtype=np.int64)
        self.sizes = np.zeros(SLOTS, dtype=np.int32)
        self.pool = np.zeros(POOL_IDS // 4, dtype=self.dtype)
        self.used = 0

    def whole(self, text: str, counting: bool) -> bytes | int:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return len(ids) if counting else array(self.code, ids).tobytes()

    def sure(self, text: str) -> bool:
        if self.kind == "library" or _UNSURE.search(text) or self.special.search(text):
            return False
        return self.kind == "byte" or text.isascii() or not _UNSURE.search(text.lower())

    def _encode(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens in a row, number of each)."""
        ids, sizes = [], []
        for a in range(0, len(new), 4000):
            part = new[a : a + 4000]
            got = self._joined(part) if self.last is not None else None
            if got is None:
                e = self.library.encode(part, is_pretokenized=True, add_special_tokens=False)
                words = np.array(e.word_ids, dtype=np.int64)
                got = np.array(e.ids, dtype=self.dtype), np.bincount(words, minlength=len(part))
            ids.append(got[0])
            sizes.append(got[1])
        return np.concatenate(ids), np.concatenate(sizes)

    def _joined(self, part: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Pre-tokens encoded as one text, if each ends with an id that ends a word."""
        ids = np.array(self.library.encode(" ".join(part), add_special_tokens=False).ids, dtype=self.dtype)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(part) or ends[-1] != len(ids):
            return None
        return ids, np.diff(ends, prepend=0)

    def _resolve(self, text: str, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the pool, number of ids) of each pre-token of a text."""
        h = np.maximum(span_hashes(codes, starts, ends), _U(1))
        slot = (h & _U(SLOTS - 1)).astype(np.int64)
        other = ((h >> _U(40)) & _U(SLOTS - 1)).astype(np.int64)
        known = self.keys[slot] == h
        missing = np.flatnonzero(~known)
        slot[missing] = other[missing]
        missing = missing[self.keys[other[missing]] != h[missing]]
        places, sizes = self.places[slot], self.sizes[slot]
        if len(missing):
            fresh, where, code = np.unique(h[missing], return_index=True, return_inverse=True)
            where = missing[where]
            ids, count = self._encode([text[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            place = self.used + np.cumsum(count) - count
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], ids, np.zeros(POOL_IDS // 4, dtype=self.dtype)])
            else:
                self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            places[missing], sizes[missing] = place[code], count[code]
            spot = (fresh & _U(SLOTS - 1)).astype(np.int64)
            spot = np.where(self.keys[spot] == 0, spot, ((fresh >> _U(40)) & _U(SLOTS - 1)).astype(np.int64))
            spot, one = np.unique(spot, return_index=True)  # one for each place
            self.keys[spot], self.places[spot], self.sizes[spot] = fresh[one], place[one], count[one]
        return places, sizes

    def ids(self, texts: list[str | None], counting: bool = False) -> list:
        """The ids of each text, as bytes of dtype, or, if counting, their number; a null text has none."""
        out: list = [0 if counting else b""] * len(texts)
        plain: list[int] = []
        chars = 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.sure(t):
                out[i] = self.whole(t, counting)
                continue
            plain.append(i)
            chars += len(t)
            if chars >= TEXT_CHARS:
                self._plain(texts, plain, out, counting)
                plain, chars = [], 0
        self._plain(texts, plain, out, counting)
        return out

    def _plain(self, texts: list, which: list[int], out: list, counting: bool) -> None:
        """ids() of sure texts that hold something."""
        if not which:
            return
        if self.used > POOL_IDS:
            self.forget()
        joined = "".join([texts[i] for i in which])
        if self.kind == "word":
            joined = joined.lower()  # keeps the lengths, as sure() saw to it
        bounds = np.cumsum([0, *(len(texts[i]) for i in which)])
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        starts, ends = pre_tokens(codes, bounds[:-1], self.kind == "byte")
        places, sizes = self._resolve(joined, codes, starts, ends)
        end = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        cut = end[np.searchsorted(starts, bounds)]
        if counting:
            for i, n in zip(which, np.diff(cut).tolist(), strict=True):
                out[i] = n
            return
        ids = self.pool[np.repeat(places - end[:-1], sizes) + np.arange(end[-1])]
        for i, x, y in zip(which, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            out[i] = ids[x:y].tobytes()

    # -- huge texts ------------------------------------------------------------------------------

    def cut(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(end of each pre-token or special string, its number of ids) for byte-level files."""
        ends, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = 0
        for m in [*self.special.finditer(text), None]:
            end = m.start() if m else len(text)
            part = text[at:end]
            if part and not _UNSURE.search(part):
                codes = np.frombuffer(part.encode("utf-32-le"), dtype=np.uint32)
                a, b = pre_tokens(codes, np.zeros(1, np.int64), True)
                ends.append(b + at)
                sizes.append(self._resolve(part, codes, a, b)[1])
            elif part:
                spans = [b for _, (_, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
                names = [part[a:b] for a, b in zip([0, *spans], spans)]
                ends.append(np.array(spans, dtype=np.int64) + at)
                sizes.append(np.array([len(e.ids) for e in self.library.encode_batch(names, add_special_tokens=False)], dtype=np.int64))
            if m:
                ends.append(np.array([m.end()]))
                sizes.append(np.array([len(self.library.encode(m[0], add_special_tokens=False).ids)]))
                at = m.end()
        return np.concatenate(ends), np.concatenate(sizes)

    def count_spliced(self, text: str, chunk: int = SPLIT_CHARS, overlap: int = 512) -> int:
        """Number of ids of a huge text, from overlapping chunks.

        Two chunks are joined at a position that both cut between pre-tokens. The left chunk cuts
        there as the whole text does, as it sees what stands before and margin characters behind;
        what follows depends on nothing before a cut, so the right chunk goes on as the whole text
        does. If the chunks share no such cut, the overlap is widened; at last the right chunk
        starts at the last proven cut itself and reaches farther.
        """
        margin = max([16, *(len(s) + 2 for s in self.specials)])
        total, proven = 0, 0
        a, b = 0, min(len(text), chunk)
        ends, counts = self.cut(text[a:b])
        ends = ends + a
        while b < len(text):
            width, found = overlap, None
            while found is None and b - width > proven:
                c, d = b - width, min(len(text), b - width + chunk + overlap)
                right, right_counts = self.cut(text[c:d])
                right = right + c
                common = np.intersect1d(ends, right, assume_unique=True)
                common = common[(common > proven) & (common <= b - margin)]
                if len(common):
                    found = int(common[-1])
                width *= 2
            if found is None:
                c, d = proven, min(len(text), b + chunk)
                chunk *= 2
                found = proven
                right, right_counts = self.cut(text[c:d])
                right = right + c
            total += int(counts[(ends > proven) & (ends <= found)].sum())
            proven, ends, counts, b = found, right, right_counts, d
        return total + int(counts[ends > proven].sum())

    def counts(self, texts: list[str | None], chunk: int = SPLIT_CHARS) -> list[int]:
        long = [self.kind == "byte" and t is not None and len(t) > chunk for t in texts]
        short = self.ids([None if x else t for x, t in zip(long, texts, strict=True)], counting=True)
        return [self.count_spliced(t, chunk) if x else s for x, t, s in zip(long, texts, short, strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder of a file per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
