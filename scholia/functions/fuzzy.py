"""Fuzzy string scorers, as Arrow-batched pandas UDFs over *pairs* that a
blocking join has already narrowed down."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel rows (Hyyrö 2004)."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - bin(s).count("1")


def ratio(a: str, b: str) -> float:
    """Normalised indel similarity, 0 to 100."""
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    only = [" ".join(sorted(x - y)), " ".join(sorted(y - x))]
    if both and not (only[0] and only[1]):
        return 100.0
    whole = [(both + " " + o).strip() for o in only]
    scores = [ratio(*whole)]
    if both:
        scores += [ratio(both, w) for w in whole]
    return max(scores)


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one;
    windows may overhang the ends."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    windows = {long[max(0, i):i + n] for i in range(1 - n, len(long))}
    return max(ratio(short, w) for w in windows if w)


def blend(a: str, b: str) -> float:
    """.5 token sort, .3 token set, .2 partial; 0 to 1."""
    return 1.0 if a == b else (0.5 * token_sort_ratio(a, b) + 0.3 * token_set_ratio(a, b) + 0.2 * partial_ratio(a, b)) / 100


def blend_rest(a: str, b: str) -> float:
    """.4 token sort, .3 token set, .2 partial, .1 ratio; 0 to 1."""
    return (0.4 * token_sort_ratio(a, b) + 0.3 * token_set_ratio(a, b) + 0.2 * partial_ratio(a, b) + 0.1 * ratio(a, b)) / 100


def blend_wide(a: str, b: str) -> float:
    """1 if equal, .98 if one contains the other, else ``blend_rest``."""
    if a == b:
        return 1.0
    return 0.98 if a and b and (a in b or b in a) else blend_rest(a, b)


# What may follow a last name.
NAME_SUFFIX = r"\b(jr|sr|iii|ii|iv|v)\.?$"


def name_parts(name: str) -> tuple[str, str]:
    """(first initial, last name), "Last, First" understood; a last name that is
    a suffix only is empty."""
    if "," in name:
        last, _, first = name.lower().partition(",")
        last, first = last.strip(), first.split()
    else:
        *first, last = name.lower().split() or [""]
    return (first[0].rstrip(".")[:1] if first else ""), re.sub(NAME_SUFFIX, "", last).strip()


def author_overlap(one: list[str], two: list[str]) -> float | None:
    """Authors with a last name, the shorter list's matched in order to the
    first free one of the longer with the same last name and initial (a missing
    initial fits any): matches over the smaller of the first list's length and
    the second's with the matches added. None if that is 0."""
    a, b = ([p for p in map(name_parts, names) if p[1]] for names in (one, two))
    few, free = (a, list(b)) if len(a) <= len(b) else (b, list(a))
    hits = 0
    for initial, last in few:
        fits = next((j for j, (i, n) in enumerate(free) if n == last and (not initial or not i or i == initial)), None)
        if fits is not None:
            free.pop(fits)
            hits += 1
    least = min(len(a), len(b) + hits)
    return hits / least if least else None


def plain_name(name: str) -> str:
    return " ".join(re.sub(r"\.\s*", " ", name.lower()).split())


def initials_match(a: str, b: str) -> bool:
    """Word by word equal, or one an initial of the other."""
    x, y = a.split(), b.split()
    return len(x) == len(y) and all(p == q or (len(p) == 1 and q.startswith(p)) or (len(q) == 1 and p.startswith(q)) for p, q in zip(x, y))


def author_similarity(one: list[str], two: list[str]) -> float:
    """Equal names first, one to one, 1 each. Then, for each name left of the
    first list, the names left of the second in order: the first that matches by
    initials counts .9 and ends the search; the best ratio met on the way counts
    itself if it is above .85. Over the longer list, 1 at most."""
    if not one or not two:
        return 0.0
    a, b = list(map(plain_name, one)), list(map(plain_name, two))
    free, rest, score = dict(enumerate(b)), [], 0.0
    for name in a:
        same = next((j for j, other in free.items() if other == name), None)
        if same is None:
            rest.append(name)
        else:
            del free[same]
            score += 1
    for name in rest:
        best, at, taken = 0.0, None, None
        for j, other in free.items():
            if initials_match(name, other):
                taken = j
                break
            if (r := ratio(name, other) / 100) > best:
                best, at = r, j
        if taken is not None:
            score += 0.9
            del free[taken]
        if best > 0.85:
            score += best
            del free[at]
    return min(1.0, score / max(len(a), len(b)))


def _pairwise(f, kind="double"):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")
    return run


def similarity(name: str):
    """A Column function of two columns by scorer name."""
    known = {"ratio": lambda a, b: ratio(a, b) / 100, "token_sort": lambda a, b: token_sort_ratio(a, b) / 100, "token_set": lambda a, b: token_set_ratio(a, b) / 100,
             "partial": lambda a, b: partial_ratio(a, b) / 100, "title": blend, "title_wide": blend_wide, "difflib": lambda a, b: difflib.SequenceMatcher(None, a, b).ratio(),
             "authors": lambda a, b: author_similarity(list(a), list(b)), "author_overlap": lambda a, b: author_overlap(list(a), list(b)), "title_rest": blend_rest}
    return _pairwise(known[name])
