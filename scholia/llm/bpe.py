"""BPE encoding and decoding over contiguous arrays of parts and ranks.

A word's parts lie side by side in one array, and beside them the rank of each
pair of neighbours. A step scans the ranks for the smallest (the leftmost of
equals), deletes the boundary between that pair, and looks up the two ranks
that the new part has with its neighbours; a word is done when no pair has a
rank. Words of the same length take the same steps, so NumPy carries them
through together as the rows of one matrix, which loses a column a step. Words
above SHORT bytes, for which a scan a step is quadratic, keep their pairs in a
heap over linked parts instead; the merges are the same ones.

Normalising and splitting are the tokenizer file's own. Encoding is a map over
the documents: no shuffle, and no state but each worker's bounded memory of
words. Equal words have equal ids, so a worker merges each distinct word once.

Results for special input: a null or empty text has no ids (and decodes to an
empty text); the strings of special tokens inside a text are those tokens,
unless ``specials`` is False; text of any length is encoded whole, one word
without a break included; repeated rows are encoded each; an empty table stays
empty; other columns pass through, but for one that has the name of the output.
Ids that the vocabulary doesn't have are left out when decoding.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import held, slices_by_bytes, table, tidy
from scholia.llm.tokens import Vocabulary

#: Bytes up to which a word is scanned.
SHORT = 96
#: Words after which a worker forgets what it has merged (some 40 bytes each).
MOST_WORDS = 500_000
#: Parts of the matrices that are merged at a time.
CELLS = 1 << 20
NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself
    where it prints, else the next one from U+0100 on."""
    prints = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 for b in range(256)]
    return [chr(b) if p else chr(256 + prints[:b].count(False)) for b, p in enumerate(prints)]


class Merges:
    """Ranks of pairs, and the part that each rank's merge makes."""

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.key, pair)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == pair, self.rank[at], NONE)

    def scan(self, parts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """[(rows, their parts)] for words of one length, a row of ``parts`` each."""
        done, rows = [], np.arange(len(parts))
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        while len(rows) and ranks.shape[1]:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            live = best != NONE
            if not live.all():
                done.append((rows[~live], parts[~live]))
                rows, parts, ranks, at, best = rows[live], parts[live], ranks[live], at[live], best[live]
                if not len(rows):
                    return done
            every = np.arange(len(rows))
            # the boundary after ``at`` goes: what lies behind it moves up
            behind = np.arange(parts.shape[1] - 1) > at[:, None]
            parts = np.where(behind, parts[:, 1:], parts[:, :-1])
            parts[every, at] = self.made[best]
            ranks = np.where(behind[:, :-1], ranks[:, 1:], ranks[:, :-1])
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < parts.shape[1] - 1)
            a = at[before]
            ranks[before, a - 1] = self.ranks(parts[before, a - 1], parts[before, a])
            a = at[after]
            ranks[after, a] = self.ranks(parts[after, a], parts[after, a + 1])
        return [*done, (rows, parts)]

    def long(self, parts: np.ndarray) -> np.ndarray:
        """The parts of one long word: pairs in a heap, stale ones passed over."""
        n = len(parts)
        part, left, right = parts.tolist(), list(range(-1, n - 1)), [*range(1, n), -1]
        first = self.ranks(parts[:-1], parts[1:])
        heap = [(int(r), i, part[i], part[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if part[i] != a or j < 0 or part[j] != b:
                continue
            part[i], part[j] = int(self.made[rank]), -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := int(self.ranks(np.array([part[x]]), np.array([part[y]]))[0])) != NONE:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return np.array([p for p in part if p >= 0], np.int32)

    def words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        lo = int(np.searchsorted(size[order], 1))
        while lo < len(order):
            n = int(size[order[lo]])
            hi = int(np.searchsorted(size[order], n, side="right"))
            hi = min(hi, lo + max(1, CELLS // n)) if n <= SHORT else lo + 1
            at = order[lo:hi]
            raw = np.frombuffer(b"".join([words[i] for i in at.tolist()]), np.uint8).reshape(-1, n)
            parts = self.inner[raw]
            parts[:, -1] = self.last[raw[:, -1]]
            if n <= SHORT:
                for rows, ids in self.scan(parts):
                    for i, x in zip(at[rows].tolist(), ids):
                        out[i] = x
            else:
                out[at[0]] = self.long(parts[0])
            lo = hi
        return out


class RankArrays(Vocabulary):
    """A tokenizer file whose words are merged here. The library splits texts
    beyond the NumPy rule of ``Vocabulary``, and texts with special tokens."""

    def __init__(self, path: str, style: str, specials: bool = True):
        super().__init__(path, style)
        with open(path) as f:
            file = json.load(f)
        self.merges = Merges(file["model"])
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]} if specials else {}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.byte_of = {ord(c): b for b, c in enumerate(byte_letters())}
        size = max([*file["model"]["vocab"].values(), *(t["id"] for t in file["added_tokens"])]) + 1
        self.spelling = np.array([self.tokenizer.id_to_token(i) for i in range(size)], object)
        self.spaced = file["decoder"] is None
        self.in_words = False

    def _prepare(self, raw, offsets):
        out, kind, odd = super()._prepare(raw, offsets)
        if self.special:
            opens = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
            odd = np.union1d(odd, np.searchsorted(offsets, opens, side="right") - 1)
        return out, kind, odd

    def _lookup(self, raw, s, e):
        if len(self.known) > MOST_WORDS:
            self.forget()
        self.in_words = True
        try:
            return super()._lookup(raw, s, e)
        finally:
            self.in_words = False

    def library(self, texts: list[str]) -> list:
        if self.in_words:
            return self.merges.words([t.encode() for t in texts])
        return [self._whole(t) for t in texts]

    def _pieces(self, text: str) -> list[bytes]:
        t = self.tokenizer
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        return [bytes(self.byte_of[ord(c)] for c in piece) for piece, _ in t.pre_tokenizer.pre_tokenize_str(text)]

    def _whole(self, text: str) -> np.ndarray:
        out, at = [], 0
        for hit in [*(self.cut.finditer(text) if self.cut else ()), None]:
            out += self.merges.words(self._pieces(text[at:hit.start() if hit else len(text)]))
            if hit:
                out.append(np.array([self.special[hit.group()]], np.int32))
                at = hit.end()
        return np.concatenate([np.zeros(0, np.int32), *out])

    def decode(self, ids: np.ndarray) -> str:
        found = self.spelling[ids[ids < len(self.spelling)]].tolist()
        found = [t for t in found if t is not None]
        if self.spaced:
            return " ".join(found)
        special = set(self.special)
        raw = b"".join(t.encode() if t in special else bytes(self.byte_of[ord(c)] for c in t) for t in found)
        return raw.decode(errors="replace")


_LOADED: dict[tuple, RankArrays] = held()


def arrays(path: str, style: str, specials: bool) -> RankArrays:
    """This process's copy; what one task has learned serves the next."""
    if (path, style, specials) not in _LOADED:
        _LOADED[path, style, specials] = RankArrays(path, style, specials)
    return _LOADED[path, style, specials]


def _schema(df: DataFrame, into: str, kind: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{into}` {kind}"])


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids", style: str = "words", specials: bool = True, back: str | None = None) -> DataFrame:
    """``docs`` with the ids of each text: binary, four bytes an id, little-endian.
    style: "words" or "gpt", see ``tokens.Vocabulary``. ``back``: a further
    column for the text that those ids decode to, made by the same worker."""
    docs = docs.drop(into, *([back] if back else []))

    def run(batches):
        known = arrays(path, style, specials)
        for batch in batches:
            for piece in slices_by_bytes(batch, text):
                ids, counts = known.encode(piece.column(text))
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = (np.cumsum(counts) * 4).tolist()
                new = [pa.array([raw[a:b] for a, b in zip([0, *ends], ends)], pa.binary())]
                if back:
                    new.append(_texts(known, new[0]))
                yield pa.RecordBatch.from_arrays([*piece.columns, *new], names=[*piece.schema.names, into, *([back] if back else [])])

    return docs.mapInArrow(tidy(run, holds=True), _schema(docs, into, "binary") + (f", `{back}` string" if back else ""))


def _texts(known: RankArrays, ids: pa.Array) -> pa.Array:
    return pa.array((None if x is None else known.decode(np.frombuffer(x, "<u4")) for x in ids.to_pylist()), pa.string())


def decode(encoded: DataFrame, path: str, ids: str = "ids", into: str = "decoded", style: str = "words", specials: bool = True) -> DataFrame:
    """``encoded`` with the text of each row's ids: tokens joined by spaces where
    the file names no decoder, else their bytes. Null ids decode to null."""
    encoded = encoded.drop(into)

    def run(batches):
        known = arrays(path, style, specials)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _texts(known, batch.column(ids))], names=[*batch.schema.names, into])

    return encoded.mapInArrow(tidy(run, holds=True), _schema(encoded, into, "string"))


def op11(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    both = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, back="decoded")
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
