"""Quality rules: a learned decision list over text statistics.

One pass over the whole texts makes some counts per row, each a running sum
over the bytes of an Arrow batch (no loop over words or characters). Ratios of
them, all plain Column expressions, are the conditions' subjects. A decision
list is learned by sequential covering: grow a conjunction of thresholds by
FOIL gain on two thirds of the labelled rows that no rule covers yet, prune it
on the last third, keep it if it is precise there, and go on with what is left.
The list becomes one ordered ``CASE WHEN`` that Catalyst evaluates; nothing
learned runs in Python at scoring time.

Labelled rows for fitting: at most ``SAMPLE`` (the smallest hashes of doc_id);
this bound is the learner's only limit, and every row of the table is scored.

Results for special input: null and empty texts have no words, so the base
test fails and they aren't kept; without labels the list is empty and the
base test alone decides; repeated rows get equal results; an empty table gives
an empty result; the labels are joined by doc_id, further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import U64, WORD_BREAKS, materialize, mix, shingle_hashes, slices_by_bytes, span_hashes, table, text_bytes, tidy, word_spans

#: Most labelled rows that a fit looks at.
SAMPLE = 20_000
SYMBOLS = b"#*$%&|<>"


def _set(chars) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_NL = _set(b"\n")
_SYMBOL, _UPPER, _LOWER, _DIGIT = _set(SYMBOLS), _set(range(65, 91)), _set(range(97, 123)), _set(range(48, 58))
_POINT = ~_set(range(128, 192))  # not a continuation byte
_STOP, _BANG, _PIPE = _set(b".?:"), _set(b"!"), _set(b"|")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_distinct_words", "n_upper", "n_lower", "n_digits", "n_stops", "n_bangs", "n_pipes", "n_top_word"]


def text_stats(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text, as int64 arrays."""
    raw, offsets = text_bytes(column)
    n = len(column)
    total = np.zeros(len(raw) + 1, np.int64)

    def per_row(mask):
        np.cumsum(mask, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    def rows_of(r, weights=None):
        return np.bincount(r, weights=weights, minlength=n).astype(np.int64) if len(r) else np.zeros(n, np.int64)

    word = ~WORD_BREAKS[raw]
    s, e, rows = word_spans(raw, offsets)
    words = span_hashes(raw, s, e)
    out = {"n_words": rows_of(rows), "word_chars": per_row(word & _POINT[raw])}
    for name, chars in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_lower", _LOWER), ("n_digits", _DIGIT), ("n_stops", _STOP), ("n_bangs", _BANG), ("n_pipes", _PIPE), ("n_chars", _POINT)):
        out[name] = per_row(chars[raw])
    # lines with a word
    np.cumsum(word, out=total[1:])
    ls, le, lr = word_spans(raw, offsets, _NL)
    full = total[le] > total[ls]
    ls, le, lr = ls[full], le[full], lr[full]
    out["n_lines"] = rows_of(lr)
    out["n_dup_lines"] = out["n_lines"] - rows_of(_distinct(span_hashes(raw, ls, le), lr)[0])
    r, freq = _distinct(words, rows)
    out["n_distinct_words"] = rows_of(r)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, r, freq)
    out["n_top_word"] = top
    # words inside 5-word windows that stand twice or more in the row
    count = out["n_words"]
    first = np.concatenate(([0], np.cumsum(count)[:-1])) if n else np.zeros(0, np.int64)
    at = np.flatnonzero(np.arange(len(rows)) - first[rows] + 5 <= count[rows]) if len(rows) else np.zeros(0, np.int64)
    long = np.flatnonzero(count >= 5)
    repeat = np.zeros(len(rows) + 1, np.int64)
    if len(at):
        keep = np.isin(rows, long)
        h, hr = shingle_hashes(words[keep], rows[keep], n)
        _, inverse, freq = np.unique(mix(h + hr.astype(np.uint64) * U64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        twice = at[freq[inverse] >= 2]
        np.add.at(repeat, twice, 1)
        np.add.at(repeat, twice + 5, -1)
    out["n_repeat_words"] = rows_of(rows, (np.cumsum(repeat)[:-1] > 0).astype(float))
    return out


def _distinct(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and count of each distinct (row, hash)."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((h, rows))
    h, r = h[order], rows[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(fresh)
    return r[at], np.diff(np.append(at, len(h)))


def _run(batches):
    for whole in batches:
        for batch in slices_by_bytes(whole, "text"):
            stats = text_stats(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(stats[c]) for c in COUNTS)], names=["doc_id", *COUNTS])


def with_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(tidy(_run), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def _per(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))




def subjects() -> dict[str, Column]:
    return {
        "words": F.col("n_words").cast("double"), "word_length": _per("word_chars", "n_words"), "symbols_per_word": _per("n_symbols", "n_words"),
        "duplicate_lines": _per("n_dup_lines", "n_lines"), "repeated_words": _per("n_repeat_words", "n_words"), "distinct_words": _per("n_distinct_words", "n_words"),
        "top_word": _per("n_top_word", "n_words"), "upper_case": F.col("n_upper") / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1)), "digits": _per("n_digits", "n_chars"),
        "stops_per_word": _per("n_stops", "n_words"), "bangs_per_word": _per("n_bangs", "n_words"), "pipes_per_word": _per("n_pipes", "n_words"), "words_per_line": _per("n_words", "n_lines"),
    }


Rule = list[tuple[int, bool, float]]  # (subject, at least?, threshold)


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for i, least, t in rule:
        ok &= (x[:, i] >= t) if least else (x[:, i] <= t)
    return ok


def _grow(x: np.ndarray, y: np.ndarray, most: int) -> Rule:
    rule: Rule = []
    inside = np.ones(len(x), bool)
    while len(rule) < most:
        p0, n0 = int(y[inside].sum()), int((~y[inside]).sum())
        if not p0 or not n0:
            break
        best, choice = 1e-9, None
        for i in range(x.shape[1]):
            v = x[inside, i]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, 65)[1:-1]))
            cuts = np.union1d(cuts, np.unique(np.quantile(v[y[inside]], np.linspace(0, 1, 17))))
            order = np.argsort(v)
            v, yy = v[order], y[inside][order]
            pos = np.concatenate(([0], np.cumsum(yy)))
            for least in (True, False):
                k = np.searchsorted(v, cuts, side="left" if least else "right")
                p = pos[-1] - pos[k] if least else pos[k]
                m = (len(v) - k if least else k) - p
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = p * (np.log2(p / np.maximum(p + m, 1)) - np.log2(p0 / (p0 + n0)))
                gain = np.where(p > 0, gain, -1)
                j = int(np.argmax(gain)) if len(gain) else 0
                if len(gain) and gain[j] > best:
                    best, choice = gain[j], (i, least, float(cuts[j]))
        if choice is None:
            break
        rule.append(choice)
        inside &= covers([choice], x)
    return rule


def learn(x: np.ndarray, y: np.ndarray, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.75, support: int = 3, seed: int = 0) -> list[tuple[Rule, float]]:
    """An ordered list of (rule, its precision) for the rows where ``y``."""
    y = y.astype(bool)
    part = np.random.default_rng(seed).permutation(len(x)) % 3
    left = np.ones(len(x), bool)
    out: list[tuple[Rule, float]] = []

    def worth(rule, rows):
        hit = covers(rule, x[rows])
        p = int(y[rows][hit].sum())
        return (p - int(hit.sum() - p)) / max(int(hit.sum()), 1), p, int(hit.sum())

    while len(out) < most_rules and (left & y).sum() >= support:
        grow, prune = left & (part < 2), left & (part == 2)
        rule = _grow(x[grow], y[grow], most_conditions)
        while len(rule) > 1 and worth(rule[:-1], prune)[0] >= worth(rule, prune)[0]:
            rule = rule[:-1]
        _, p, hits = worth(rule, left)
        _, pp, ph = worth(rule, prune)
        if not rule or p < support or p < precision * hits or ph and pp < 0.5 * ph:
            break
        out.append((rule, p / hits))
        left &= ~covers(rule, x)
    return out


def as_column(rules: list[tuple[Rule, float]], cols: dict[str, Column], otherwise: bool = True) -> Column:
    """The list as one ordered conditional: false where a rule rejects."""
    names, out = list(cols), None
    for rule, _ in rules:
        test = None
        for i, least, t in rule:
            one = cols[names[i]] >= F.lit(t) if least else cols[names[i]] <= F.lit(t)
            test = one if test is None else test & one
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[Rule, float]]:
    """Rules for rows labelled with quality 0."""
    cols = subjects()
    marked = labels.filter("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("_q"))
    rows = stats.join(marked, "doc_id").select(F.xxhash64("doc_id").alias("_h"), "doc_id", "_q", *[c.cast("double").alias(f"_{i}") for i, c in enumerate(cols.values())])
    got = rows.orderBy("_h", "doc_id").limit(sample).toArrow()  # the documented bound
    if not got.num_rows:
        return []
    x = np.column_stack([got.column(f"_{i}").to_numpy() for i in range(len(cols))])
    return learn(x, pc.equal(got.column("_q"), 0).to_numpy(zero_copy_only=False))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def op5(spark, sf_dir: str) -> DataFrame:
    stats = materialize(with_stats(table(spark, sf_dir, "documents").select("doc_id", "text")), "text-stats")
    rules = fit(stats, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    verdict = as_column(rules, subjects())
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), F.when(base_failed(), False).otherwise(verdict).alias("kept"))
