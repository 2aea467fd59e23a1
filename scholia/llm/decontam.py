"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become templates: numbers (digits or number words),
units after a number and names (capitalised words inside a sentence; runs of
them are one) turn into typed placeholders, everything else into lower-case
words. Windows of five template tokens are hash-joined. An aligned run of joined
windows (same distance between the two texts) must also fill its slots
consistently: where an item repeats a value, the text must repeat the one that
stands for it. An item has leaked into a text when consistent runs cover
``share`` of the item's windows; numbers or names may all have been changed.

An item has leaked as well where its whole sequence of words (lower-cased, no
placeholders) stands anywhere in a text. This finds items with few template
tokens or plain words, and copies whose capitals read otherwise in the text.

The benchmark is the stated query set. It is joined in blocks of at most
``BLOCK`` windows (12 bytes each, checked before it is broadcast); each block
meets every document in one map over the whole texts, so no window of the
corpus is shuffled, and windows that very many texts share cost nothing extra.

Results for special input: null and empty texts and items hold no windows and
match nothing; fewer than five tokens are one window; windows with fewer than
three plain words say nothing as templates, and an item without others is found
word for word only (one window, if it has none that tells); an item of one word
is found in each text that has the word; repeated rows give repeated results; an empty table on either side gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import _ODD, LOWER, U64, _inverse, mix, shingle_hashes, slices_by_bytes, span_hashes, table, text_bytes, tidy, word_spans

WIDTH = 5
#: Windows of the benchmark that are broadcast at a time.
BLOCK = 2_000_000
SHARE = 0.5
CONSISTENT = 0.75

NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
dozen half twice double""".split()
UNITS = """kg kgs g mg lb lbs oz ton tons kilogram kilograms gram grams pound pounds ounce ounces km m cm mm mile miles
meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet yard yards second seconds
minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent
liter liters litre litres ml gallon gallons mph kmh degree degrees celsius fahrenheit volt volts watt watts""".split()

_BREAKS = np.ones(256, bool)
_BREAKS[48:58] = _BREAKS[65:91] = _BREAKS[97:123] = _BREAKS[128:] = False
_POINT = np.zeros(256, bool)
_POINT[[46, 44]] = True  # . and , between digits
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".?!:;\n\"(")] = True
PLAIN, NUMBER, UNIT, NAME = 0, 1, 2, 3
_KIND = mix(np.arange(101, 105, dtype=np.uint64))
_GATE = U64((1 << 22) - 1)


def _hashes(words: list[str]) -> np.ndarray:
    raw, offsets = text_bytes(pa.array(words))
    s, e, _ = word_spans(raw, offsets, _BREAKS)
    return np.sort(span_hashes(raw, s, e))


_NUMBER_WORDS, _UNITS = _hashes(NUMBER_WORDS), _hashes(UNITS)


def template(column: pa.Array):
    """(template hash, value hash, kind, row) of each template token, and (value
    hash, row) of each word."""
    raw, offsets = text_bytes(column)
    n = len(column)
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not len(raw):
        return none
    inner = np.zeros(len(raw), bool)
    inner[1:-1] = _POINT[raw[1:-1]] & _DIGIT[raw[:-2]] & _DIGIT[raw[2:]]
    bounds = offsets[(offsets > 0) & (offsets < len(raw))]
    inner[bounds] = inner[bounds - 1] = False  # digits of two texts
    seen = np.where(inner, np.uint8(48), raw)
    s, e, rows = word_spans(seen, offsets, _BREAKS)
    if not len(s):
        return none
    low = LOWER[raw]
    latin = np.flatnonzero((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)) + 1
    low[latin] += 32  # the capitals from U+00C0 to U+00DE
    value = span_hashes(low, s, e)
    kind = np.full(len(s), PLAIN)
    number = _DIGIT[raw[s]] | np.isin(value, _NUMBER_WORDS)
    kind[number] = NUMBER
    same = np.concatenate(([False], rows[1:] == rows[:-1]))
    after_number = np.concatenate(([False], number[:-1])) & same
    kind[after_number & np.isin(value, _UNITS)] = UNIT
    # names
    second = np.zeros(len(raw) + 1, np.uint8)
    second[:-1] = raw
    first, nxt = raw[s], second[np.minimum(s + 1, len(raw))]
    capital = (first >= 65) & (first <= 90) | (first == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E)
    stops = np.concatenate(([0], np.cumsum(_STOP[raw] & ~inner)))
    before = np.concatenate(([0], e[:-1]))
    inside = same & (stops[s] == stops[before])
    upper = np.concatenate(([0], np.cumsum((raw >= 65) & (raw <= 90))))
    letters = np.concatenate(([0], np.cumsum(~_BREAKS[raw] & ~_DIGIT[raw])))
    per = lambda t: t[offsets[1:]] - t[offsets[:-1]]
    loud = 2 * per(upper) > per(letters)
    kind[capital & inside & (kind == PLAIN) & ~loud[rows]] = NAME
    run = (kind == NAME) & np.concatenate(([False], kind[:-1] == NAME)) & same
    keep = ~run
    words, word_rows = value, rows
    kind, value, rows = kind[keep], value[keep], rows[keep]
    return np.where(kind == PLAIN, value, _KIND[kind]), value, kind, rows, words, word_rows


class Words:
    """The words of some texts; hashes of any runs of them from running sums."""

    def __init__(self, words: np.ndarray, rows: np.ndarray, n: int):
        self.row = rows
        self.count = np.bincount(rows, minlength=n)
        self.first = np.cumsum(self.count) - self.count
        power, self.inverse = (np.multiply.accumulate(np.append(U64(1), np.full(len(words), x, np.uint64))) for x in (_ODD, _inverse(_ODD)))
        self.total = np.append(U64(0), np.cumsum(mix(words) * power[:-1], dtype=np.uint64))

    def hashes(self, at: np.ndarray, size) -> np.ndarray:
        return mix((self.total[at + size] - self.total[at]) * self.inverse[at] + np.asarray(size).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


class Verbatim:
    """The items' whole word sequences, to be found under their first words:
    each length that items under one such anchor have is looked up once."""

    def __init__(self, items: Words):
        self.item = np.flatnonzero(items.count)
        size = items.count[self.item]
        anchor = items.hashes(items.first[self.item], np.minimum(size, WIDTH))
        whole = items.hashes(items.first[self.item], size)
        order = np.argsort(whole, kind="stable")
        self.item, self.whole = self.item[order], whole[order]
        order = np.lexsort((size, anchor))
        anchor, size = anchor[order], size[order]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (size[1:] != size[:-1])
        self.anchor, self.size = anchor[new], size[new]
        self.widths = np.unique(np.minimum(size, WIDTH)).tolist()
        self.gate = _gate(self.anchor)

    def found(self, docs: Words) -> np.ndarray:
        """(row, item) of the items that stand in the texts, sorted, once each."""
        parts = [np.zeros((2, 0), np.int64)]
        ends = (docs.first + docs.count)[docs.row]
        for k in self.widths:
            at = np.flatnonzero(np.arange(len(ends)) + k <= ends)
            h = docs.hashes(at, k)
            near = self.gate[(h & _GATE).astype(np.int64)]
            at, h = at[near], h[near]
            which, place = _matches(self.anchor, h)
            at, size = at[which], self.size[place]
            fits = at + size <= ends[at]
            at, size = at[fits], size[fits]
            which, place = _matches(self.whole, docs.hashes(at, size))
            parts.append(np.unique(np.stack((docs.row[at[which]], self.item[place])), axis=1))
        return np.unique(np.concatenate(parts, axis=1), axis=1)


def _gate(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 22, bool)
    out[(hashes & _GATE).astype(np.int64)] = True
    return out


def _matches(known: np.ndarray, h: np.ndarray):
    """Places (in h, in sorted ``known``) of equal hashes."""
    lo = np.searchsorted(known, h, side="left")
    n = np.searchsorted(known, h, side="right") - lo
    return np.repeat(np.arange(len(h)), n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Windows:
    """The windows of some texts: hash, row, and place of the first token."""

    def __init__(self, column: pa.Array):
        n = len(column)
        self.token, self.value, self.kind, self.row_of, words, word_rows = template(column)
        self.words = Words(words, word_rows, n)
        self.h, self.row = shingle_hashes(self.token, self.row_of, n, WIDTH)
        count = np.bincount(self.row_of, minlength=n) if len(self.row_of) else np.zeros(n, np.int64)
        self.first = np.cumsum(count) - count
        per = np.where(count >= WIDTH, count - WIDTH + 1, (count > 0).astype(np.int64))
        at = np.arange(len(self.h)) - np.repeat(np.cumsum(per) - per, per)
        self.pos, self.start = at, self.first[self.row] + at
        self.size = np.minimum(count[self.row], WIDTH)
        plain = np.concatenate(([0], np.cumsum(self.kind == PLAIN)))
        self.telling = plain[self.start + self.size] - plain[self.start] >= np.minimum(3, self.size)


def _shares(docs: Windows, items: Windows, index: tuple[np.ndarray, np.ndarray], totals: np.ndarray, share: float):
    """(row, item, windows covered, slots, changed slots) of leaked items."""
    known, order = index
    lo = np.searchsorted(known, docs.h, side="left")
    hi = np.searchsorted(known, docs.h, side="right")
    hit = np.flatnonzero((hi > lo) & docs.telling)
    none = [np.zeros(0, np.int64)] * 5
    if not len(hit):
        return none
    n = hi[hit] - lo[hit]
    d = np.repeat(hit, n)
    w = order[np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    row, item, shift = docs.row[d], items.row[w], docs.pos[d] - items.pos[w]
    _, run = np.unique(np.stack((row, item, shift)), axis=1, return_inverse=True)
    run = run.ravel()
    # slots: how often the value that stands for an item's value is the usual one
    parts = []
    for k in range(WIDTH):
        ok = (items.size[w] > k)
        a, b = items.start[w[ok]] + k, docs.start[d[ok]] + k
        slot = items.kind[a] != PLAIN
        parts.append(np.stack((run[ok][slot], a[slot], b[slot])))
    slots = np.unique(np.concatenate(parts, axis=1), axis=1)
    runs = int(run.max()) + 1
    total, usual, changed = np.zeros(runs), np.zeros(runs), np.zeros(runs)
    if slots.shape[1]:
        r, iv, dv = slots[0], items.value[slots[1]], docs.value[slots[2]]
        order_ = np.lexsort((dv, iv, r))
        r, iv, dv = r[order_], iv[order_], dv[order_]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (iv[1:] != iv[:-1]) | (dv[1:] != dv[:-1])
        at = np.flatnonzero(new)
        freq = np.diff(np.append(at, len(r)))
        group = np.ones(len(at), bool)
        group[1:] = (r[at][1:] != r[at][:-1]) | (iv[at][1:] != iv[at][:-1])
        best = np.maximum.reduceat(freq, np.flatnonzero(group))
        usual = np.bincount(r[at][group], weights=best, minlength=runs)
        total = np.bincount(r, minlength=runs)
        changed = np.bincount(r, weights=iv != dv, minlength=runs)
    fine = usual >= CONSISTENT * total
    keep = fine[run]
    if not keep.any():
        return none
    cover = np.unique(np.stack((row[keep], item[keep], items.pos[w[keep]])), axis=1)
    pair, count = np.unique(cover[:2], axis=1, return_counts=True)
    good = count >= np.maximum(share * totals[pair[1]], 1)
    pair, count = pair[:, good], count[good]
    runs_of = np.unique(np.stack((row[keep], item[keep], run[keep])), axis=1)
    where = {(a, b): i for i, (a, b) in enumerate(pair.T.tolist())}
    n_slots, n_changed = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
    for a, b, c in runs_of.T.tolist():
        if (i := where.get((a, b))) is not None:
            n_slots[i] += int(total[c])
            n_changed[i] += int(changed[c])
    return [pair[0], pair[1], count, n_slots, n_changed]


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, slots, changed_slots) for each
    document and each item that has leaked into it."""
    spark = docs.sparkSession
    kind, ikind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {ikind}, windows long, item_windows long, slots long, changed_slots long"
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    base = docs.select("doc_id", text)
    out = None
    for ids, texts in _blocks(benchmark.select("item_id", text)):
        sent = spark.sparkContext.broadcast((ids, texts))
        found = base.mapInArrow(tidy(_matcher(sent, share)), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _blocks(items: DataFrame):
    """The query set in runs of at most ``BLOCK`` windows (about as many words)."""
    ids, texts, size = [], [], 0
    for r in items.toLocalIterator(prefetchPartitions=False):
        ids.append(r[0])
        texts.append(r[1])
        size += r[1].count(" ") + 2
        if size >= BLOCK:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _matcher(sent, share: float):
    def run(batches):
        ids, texts = sent.value
        items = Windows(pa.array(texts, pa.string()))
        usable = np.flatnonzero(items.telling)
        order = usable[np.argsort(items.h[usable], kind="stable")]
        known = items.h[order]
        totals = np.bincount(items.row[usable], minlength=len(ids))
        least = np.maximum(totals, 1)
        gate = _gate(known)
        verbatim = Verbatim(items.words)
        item_slots = np.bincount(items.row_of[items.kind != PLAIN], minlength=len(ids))
        item_ids = pa.array(ids)
        for whole in batches:
            for batch in slices_by_bytes(whole, "text"):
                w = Windows(batch.column("text"))
                w.telling &= gate[(w.h & _GATE).astype(np.int64)]
                near = np.flatnonzero(w.telling)
                for name in ("h", "row", "pos", "start", "size", "telling"):
                    setattr(w, name, getattr(w, name)[near])
                row, item, count, slots, changed = _shares(w, items, (known, order), totals, share)
                r, i = verbatim.found(w.words)
                more = ~np.isin(r * len(ids) + i, row * len(ids) + item)
                r, i = r[more], i[more]
                row, item, count = np.append(row, r), np.append(item, i), np.append(count, least[i])
                slots, changed = np.append(slots, item_slots[i]), np.append(changed, np.zeros(len(i), np.int64))
                if len(row):
                    yield pa.RecordBatch.from_arrays([
                        batch.column("doc_id").take(pa.array(row)), item_ids.take(pa.array(item)), pa.array(count), pa.array(least[item]), pa.array(slots), pa.array(changed)],
                        names=["doc_id", "item_id", "windows", "item_windows", "slots", "changed_slots"])
    return run


def op7(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
