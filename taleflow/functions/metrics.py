"""Character and word error rates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

COUNTS = StructType().add("hits", LongType()).add("substitutions", LongType()).add("deletions", LongType()).add("insertions", LongType())


#: An error outweighs any number of insertions.
_ERROR = 1 << 31
#: Cells of the distance tables that are worked on at once.
_CELLS = 1 << 20


def _common(a: list, b: list) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def align(refs: list[list], hyps: list[list]) -> np.ndarray:
    """(hits, substitutions, deletions, insertions) per pair, of the alignment with the fewest errors and then the fewest insertions.

    This fixes all four numbers, whatever path an alignment takes. Equal
    beginnings and ends are matched first, which costs neither. The pairs of a
    block are worked on together, one row of all their tables at a time,
    so a table is never held as a whole.
    """
    out = np.zeros((len(refs), 4), np.int64)
    codes: dict = {}
    rest = []
    refs, hyps = list(refs), list(hyps)
    for k, (r, h) in enumerate(zip(refs, hyps)):
        same = _common(r, h)
        r, h = r[same:], h[same:]
        tail = _common(r[::-1], h[::-1])
        refs[k], hyps[k] = r[: len(r) - tail], h[: len(h) - tail]
        out[k, 0] = same + tail
        if r or h:
            rest.append(k)
    rest.sort(key=lambda k: (len(hyps[k]), len(refs[k])))
    at = 0
    while at < len(rest):
        width = len(hyps[rest[at]]) + 1
        end = at + 1
        while end < len(rest) and (end - at + 1) * (len(hyps[rest[end]]) + 1) <= _CELLS and len(hyps[rest[end]]) <= 1.25 * width + 8:
            end += 1
        block = rest[at:end]
        at = end
        n = np.array([len(refs[k]) for k in block])
        m = np.array([len(hyps[k]) for k in block])
        a, b = np.full((len(block), n.max()), -1, np.int32), np.full((len(block), m.max()), -2, np.int32)
        for row, k in enumerate(block):
            a[row, : n[row]] = [codes.setdefault(x, len(codes)) for x in refs[k]]
            b[row, : m[row]] = [codes.setdefault(x, len(codes)) for x in hyps[k]]
        inserted = np.arange(m.max() + 1, dtype=np.int64) * (_ERROR + 1)
        d = np.repeat(inserted[None, :], len(block), axis=0)
        rows = np.arange(len(block))
        cost = np.where(n == 0, d[rows, m], 0)
        for i in range(n.max()):
            new = d + _ERROR
            np.minimum(new[:, 1:], d[:, :-1] + np.where(b == a[:, i : i + 1], 0, _ERROR), out=new[:, 1:])
            # insertions along the row: a running minimum of what is left without them
            d = np.minimum.accumulate(new - inserted, axis=1) + inserted
            done = n == i + 1
            if done.any():
                cost[done] = d[rows[done], m[done]]
        errors, ins = cost // _ERROR, cost % _ERROR
        deleted = ins + n - m
        replaced = errors - deleted - ins
        out[block] += np.stack([n - replaced - deleted, replaced, deleted, ins], axis=1)
    return out


def _counts(split) -> object:
    @F.pandas_udf(COUNTS)
    def count(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
        known = (ref.notna() & hyp.notna()).to_numpy()
        out = pd.DataFrame(np.zeros((len(ref), 4), np.int64), columns=COUNTS.names, dtype="Int64")
        out.loc[known] = align([split(x) for x in ref[known]], [split(x) for x in hyp[known]])
        out.loc[~known] = pd.NA
        return out

    return count


char_counts = _counts(list)
word_counts = _counts(str.split)


def errors_of(counts: Column) -> Column:
    return counts["substitutions"] + counts["deletions"] + counts["insertions"]


def total_of(counts: Column, normalise: bool = True) -> Column:
    """Length of the reference; normalised rates add the insertions, so that they never exceed 1."""
    length = counts["hits"] + counts["substitutions"] + counts["deletions"]
    return length + counts["insertions"] if normalise else length


def row_rate(counts: Column, normalise: bool = True) -> Column:
    """The rate of one row; null where both texts are empty."""
    return F.try_divide(errors_of(counts), total_of(counts, normalise))


def error_rate(counts: str | None = None, normalise: bool = True) -> Column:
    """Corpus rate from columns of counts: the sum of errors over the sum of lengths, null for no length."""
    c = F.col(counts) if counts else F.struct(*COUNTS.names)
    return F.try_divide(F.sum(errors_of(c)), F.sum(total_of(c, normalise)))


def raw_character_rate(ref: Column, hyp: Column) -> Column:
    """Un-normalised corpus rate, all in generated code; can exceed 1."""
    return F.try_divide(F.sum(F.levenshtein(ref, hyp)), F.sum(F.length(ref)))
