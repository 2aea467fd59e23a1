"""Token ids of whole texts, through the public ``tokenizers`` library.

BPE works on one pre-token (a word) at a time, so equal words have equal ids.
A batch's words are found with NumPy by the tokenizer's own split rule, each
distinct word goes to the library once, and the ids are gathered back; a worker
keeps what it has learned, within a bound. The NumPy rule covers ASCII and the
Latin letters U+00C0 to U+017F; a text with anything else goes to the library
whole, so ids are the library's in every case.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from scholia.llm.common import held, mix, span_hashes, text_bytes

#: Most words that a worker remembers; beyond it, it starts afresh.
REMEMBER = 1_500_000

#: Texts that the library encodes at once.
AT_ONCE = 1024

_L, _N, _S, _P, _X = 0, 1, 2, 3, 4  # letter, digit, space, other, not covered
_CLASS = np.full(256, _X, np.uint8)
_CLASS[33:127] = _P
_CLASS[65:91] = _CLASS[97:123] = _L
_CLASS[48:58] = _N
_CLASS[[32, 9, 10, 13]] = _S
_CLASS[128:192] = _L  # inside a letter, if its first byte is covered
_CLASS[[0xC3, 0xC4, 0xC5]] = _L


class Vocabulary:
    """One tokenizer file. style: "gpt" keeps white space and puts a single
    space with the word after it; "words" lower-cases and drops white space."""

    def __init__(self, path: str, style: str):
        # a task has one core; the library's threads would hold memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.style = style
        self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that begin with a space
        for token, i in self.tokenizer.get_vocab().items():
            self.begins[i] = token.startswith("\u0120")
        self.forget()

    def forget(self):
        self.known = np.zeros(0, np.uint64)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def library(self, texts: list[str]) -> list[list[int]]:
        found: list[list[int]] = []
        for lo in range(0, len(texts), AT_ONCE):  # an encoding is far larger than its ids
            found += [x.ids for x in self.tokenizer.encode_batch_fast(texts[lo:lo + AT_ONCE], add_special_tokens=False)]
        return found

    def _learn(self, words: list[str]):
        """(ids of distinct words one after the other, number of ids of each,
        their turn). Words that begin with their space are put together, many a
        text: the split rule parts them there, and an id whose token begins
        with a space begins a word."""
        spaced, rest = [], list(range(len(words)))
        if self.style == "gpt":
            is_spaced = [len(x) > 1 and x[0] == " " and not x[1].isspace() for x in words]
            spaced, rest = [i for i in rest if is_spaced[i]], [i for i in rest if not is_spaced[i]]
        flat, length, turn = [], [], []
        for lo in range(0, len(spaced), AT_ONCE):
            some = spaced[lo:lo + AT_ONCE]
            (ids,) = self.library(["".join([words[i] for i in some])])
            ids = np.array(ids, np.uint32)
            begin = np.flatnonzero(self.begins[ids])
            if len(begin) != len(some) or begin[0]:
                rest += some
                continue
            flat.append(ids)
            length.append(np.diff(begin, append=len(ids)))
            turn += some
        got = self.library([words[i] for i in rest])
        length.append(np.fromiter(map(len, got), np.int64, len(got)))
        flat.append(np.fromiter((i for x in got for i in x), np.uint32, int(length[-1].sum())))
        return np.concatenate(flat), np.concatenate(length), np.array(turn + rest, np.int64)

    # ------------------------------------------------------------ words

    def _prepare(self, raw: np.ndarray, offsets: np.ndarray):
        """Bytes as the rule sees them, and the rows that it doesn't cover."""
        kind = _CLASS[raw]
        bad = kind == _X
        after = np.empty(len(raw), np.uint8)
        after[1:], after[:1] = raw[:-1], 0
        c3 = after == 0xC3
        bad |= c3 & ((raw == 0x97) | (raw == 0xB7))
        if self.style == "words":
            bad |= (raw == 0xC4) | (raw == 0xC5)
            raw = raw.copy()
            upper = (raw >= 65) & (raw <= 90) | c3 & (raw >= 0x80) & (raw <= 0x9E)
            raw[upper] += 32
        rows = np.unique(np.searchsorted(offsets, np.flatnonzero(bad), side="right") - 1)
        return raw, kind, rows

    def _spans(self, raw: np.ndarray, kind: np.ndarray, offsets: np.ndarray):
        n = len(raw)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        new = np.empty(n, bool)
        new[1:] = kind[1:] != kind[:-1]
        new[:1] = True
        new |= first[:n]
        begin = new.copy()
        follow = np.zeros(n, np.uint8)
        follow[:-1] = raw[1:]
        follow2 = np.zeros(n, np.uint8)
        follow2[:-2] = raw[2:]
        last = np.ones(n, bool)  # last byte of its run
        last[:-1] = new[1:]
        row_end = first[1:]
        if self.style == "words":
            begin |= kind == _N
            glued = np.zeros(n, bool)
        else:
            space_end = (kind == _S) & last & ~row_end  # a white-space byte before a word
            begin |= space_end
            glued = space_end & (raw == 32)
            at = np.flatnonzero(glued)
            begin[at + 1] = False
        # 's 't 'm 'd 're 've 'll at the start of a token
        quote = np.flatnonzero((raw == 39) & new & last & ~row_end)
        if len(quote):
            if self.style != "words":
                before = np.maximum(quote - 1, 0)
                quote = quote[~(glued[before] & (quote > 0)) | first[quote]]
            a, b = follow[quote], follow2[quote]
            inside = ~row_end[np.minimum(quote + 1, n - 1)]
            one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
            two = inside & ((a == 114) & (b == 101) | (a == 118) & (b == 101) | (a == 108) & (b == 108))
            size = np.where(one, 1, np.where(two, 2, 0))
            quote, size = quote[size > 0], size[size > 0]
            begin[quote + 1] = False
            rest = quote + 1 + size
            rest = rest[rest < n]
            begin[rest] |= (kind[rest] == _L) & ~first[rest]
        s = np.flatnonzero(begin)
        e = np.append(s[1:], n)
        if self.style == "words":
            keep = kind[s] != _S
            s, e = s[keep], e[keep]
        return s, e

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text)."""
        raw, offsets = text_bytes(column)
        n = len(column)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        raw, kind, odd = self._prepare(raw, offsets)
        s, e = self._spans(raw, kind, offsets)
        rows = np.searchsorted(offsets, s, side="right") - 1
        is_odd = np.zeros(n, bool)
        is_odd[odd] = True
        if len(odd):
            keep = ~is_odd[rows]
            s, e, rows = s[keep], e[keep], rows[keep]
        word, at = self._lookup(raw, s, e)
        lengths = self.length[word][at]
        counts = np.bincount(rows, weights=lengths, minlength=n).astype(np.int64) if len(rows) else np.zeros(n, np.int64)
        extra = {}
        if len(odd):
            whole = self.library([column[int(i)].as_py() or "" for i in odd])
            extra = {int(i): np.array(x, np.uint32) for i, x in zip(odd, whole)}
            counts[odd] = [len(extra[int(i)]) for i in odd]
        total = int(counts.sum())
        ids = np.empty(total, np.uint32)
        base = np.concatenate(([0], np.cumsum(counts)))
        if len(s):
            before = np.concatenate(([0], np.cumsum(lengths)))
            where = np.arange(before[-1]) - np.repeat(before[:-1], lengths)
            got = self.pool[np.repeat(self.start[word][at], lengths) + where]
            if not len(odd):
                ids[:] = got
            else:
                ids[~np.repeat(is_odd, counts)] = got
        for i, x in extra.items():
            ids[base[i]:base[i] + len(x)] = x
        return ids, counts

    def _lookup(self, raw, s, e):
        """Places in ``known`` of the distinct words, and each word's among them."""
        h = span_hashes(raw, s, e)
        h = mix(h)
        distinct, one, at = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        found = np.zeros(len(distinct), bool)
        if len(self.known):
            inside = np.minimum(place, len(self.known) - 1)
            found = self.known[inside] == distinct
        if not found.all():
            if len(self.known) > REMEMBER:
                self.forget()
                return self._lookup(raw, s, e)
            miss = np.flatnonzero(~found)
            data = raw.tobytes()
            flat, length, turn = self._learn([data[a:b].decode() for a, b in zip(s[one[miss]].tolist(), e[one[miss]].tolist())])
            miss = miss[turn]
            if self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate((self.pool[:self.used], flat, np.zeros(max(len(self.pool), len(flat)), np.uint32)))
            self.pool[self.used:self.used + len(flat)] = flat
            start = self.used + np.cumsum(length) - length
            self.used += len(flat)
            back = np.argsort(miss)  # in the order of ``known``
            miss = miss[back]
            spot = place[miss]
            self.known = np.insert(self.known, spot, distinct[miss])
            self.start = np.insert(self.start, spot, start[back])
            self.length = np.insert(self.length, spot, length[back])
            place = np.searchsorted(self.known, distinct)
        return place, at


_LOADED: dict[tuple[str, str], Vocabulary] = held()


def vocabulary(path: str, style: str) -> Vocabulary:
    """This process's copy; Spark reuses Python workers, so what one task has
    learned serves the next."""
    if (path, style) not in _LOADED:
        _LOADED[(path, style)] = Vocabulary(path, style)
    return _LOADED[(path, style)]
