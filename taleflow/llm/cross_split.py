"""Same or near-same records across splits.

A text's fingerprint has two parts: a 64-bit similarity hash, in which every
word flips one bit, and code blocks, the hashes of the successive segments the
words are cut into. A text of n words is cut into K(n) segments, one more than
the edits that any near text may have, so that at least one block of a near
pair is equal. The blocks of the training texts are joined with the blocks at
the admissible shifts of the evaluation texts; a pair goes on where the
similarity hashes lie within the Hamming radius that its edits allow (a word
replaced flips two bits, a word added or dropped one), and is verified by the
edit distance of the words. Neither step can lose a near pair.

Copies of a text are one class, and only classes have blocks. A block that very
many training texts share (a common opening) would pair all of them with all
evaluation texts that have it; for such hot blocks the rest of the text is cut
again, into one segment more than the edits that are left, and the join is by
the hot block together with a block of the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise, release
from . import columns as C
from .normalise import words

#: At most one word in this many is added, dropped or replaced.
WORDS_PER_EDIT = 6
MIN_WORDS = 4
#: Training texts from which on a block counts as hot.
HOT = 1000
_MUL = np.uint64(0x9E3779B97F4A7C15)


def edits_allowed(n: int, m: int, per: int = WORDS_PER_EDIT) -> int:
    return max(n, m) // per


@lru_cache(maxsize=None)
def partners(n: int, per: int = WORDS_PER_EDIT) -> tuple[int, int]:
    """Least and greatest number of words of a text that can be near one of ``n`` words."""
    least = n
    while least > 1 and n - (least - 1) <= edits_allowed(n, least - 1, per):
        least -= 1
    most, m = n, n
    while m <= 2 * n + per:
        m += 1
        if m - n <= edits_allowed(n, m, per):
            most = m
    return least, most


@lru_cache(maxsize=None)
def segments(n: int, per: int = WORDS_PER_EDIT) -> tuple[tuple[int, int], ...]:
    """(start, length) of the segments of a text of ``n`` words: one more than the most edits of any partner."""
    k = min(edits_allowed(n, partners(n, per)[1], per) + 1, n)
    cuts = [i * n // k for i in range(k + 1)]
    return tuple((a, b - a) for a, b in zip(cuts, cuts[1:]))


@lru_cache(maxsize=None)
def probes(m: int, per: int = WORDS_PER_EDIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, slot) of every block a text of ``m`` words is probed with.

    For each length n of a partner and each of its segments: the starts at
    which that segment can lie unchanged within n's edit bound.
    """
    found = set()
    for n in range(MIN_WORDS, 2 * m + per + 1):
        if not partners(n, per)[0] <= m <= partners(n, per)[1]:
            continue
        cut, shift = segments(n, per), m - n
        k = len(cut)
        for i, (p, length) in enumerate(cut):
            low = max(p - i, p + shift - (k - 1 - i), 0)
            high = min(p + i, p + shift + (k - 1 - i), m - length)
            found.update((q, length, (n << 8) | i) for q in range(low, high + 1))
    rows = np.array(sorted(found), dtype=np.int64).reshape(-1, 3)
    return rows[:, 0], rows[:, 1], rows[:, 2]


@lru_cache(maxsize=None)
def own_blocks(n: int, per: int = WORDS_PER_EDIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, slot) of a text's own code blocks."""
    cut = np.array(segments(n, per), dtype=np.int64)
    return cut[:, 0], cut[:, 1], (n << 8) | np.arange(len(cut))


@lru_cache(maxsize=None)
def rest_segments(n: int, i: int, per: int = WORDS_PER_EDIT) -> tuple[tuple[int, int, bool], ...]:
    """(start, length, before) of the segments of the words around segment ``i``: as many as there are segments, none empty.

    With segment ``i`` unchanged, the edits fall into the rest, which has one
    segment more than they are. Empty where the rest has too few words.
    """
    cut = segments(n, per)
    k, (p, length) = len(cut), cut[i]
    left, right = p, n - p - length
    if left + right < k:
        return ()
    a = min(max(round(k * left / (left + right)), k - right, 0), left)
    out = [(j * left // a, (j + 1) * left // a, True) for j in range(a)]
    b = k - a
    out += [(p + length + j * right // b, p + length + (j + 1) * right // b, False) for j in range(b)]
    return tuple((x, y - x, before) for x, y, before in out)


@lru_cache(maxsize=1 << 17)
def _short_word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def word_hash(word: str) -> int:
    # words of no language do not fill the cache
    return _short_word_hash(word) if len(word) <= 64 else xxhash.xxh64_intdigest(word)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes(hashes: np.ndarray, start: np.ndarray, length: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Codes of word segments of texts of one length (rows of ``hashes``), by rolling prefix hashes."""
    n = hashes.shape[1]
    prefix = np.zeros((hashes.shape[0], n + 1), np.uint64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(n, _MUL, np.uint64)], dtype=np.uint64)
        for i in range(n):
            prefix[:, i + 1] = prefix[:, i] * _MUL + hashes[:, i]
        seg = prefix[:, start + length] - prefix[:, start] * power[length]
        return _mix(seg ^ _mix(slot.astype(np.uint64) * _MUL)[None, :]).view(np.int64)


def similarity_hash(hashes: list[int]) -> int:
    """64 bits; every occurrence of a word flips the bit that its hash names."""
    out = 0
    for h in hashes:
        out ^= 1 << (h >> 58)
    return out - (1 << 64) if out >> 63 else out


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {c: [] for c in ("id_recording", "role", "split", "source", "words", "n", "c1", "c2", "simhash")}
        for rec, role, split, source, text in zip(*(batch.column(c).to_pylist() for c in ("id_recording", "role", "split", "source", "t"))):
            ws = words(text)
            if len(ws) < MIN_WORDS:
                continue
            joined = " ".join(ws)
            d = xxhash.xxh3_128_intdigest(joined)
            cols["id_recording"].append(rec), cols["role"].append(role), cols["split"].append(split), cols["source"].append(source)
            cols["words"].append(joined), cols["n"].append(len(ws))
            cols["c1"].append((d >> 64) - (1 << 63)), cols["c2"].append((d & (1 << 64) - 1) - (1 << 63))
            cols["simhash"].append(similarity_hash([word_hash(w) for w in ws]))
        types = {"n": pa.int32(), "c1": pa.int64(), "c2": pa.int64(), "simhash": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.string())) for k, v in cols.items()], names=list(cols))


def prepare(samples: DataFrame) -> DataFrame:
    """Texts of training and evaluation rows with class (c1, c2), number of words and similarity hash.

    The text is text, or sentence where text is null. Rows without an
    id_recording, of other splits, or with fewer than four words are left out.
    """
    rows = samples.select("id_recording", C.split_role(F.col("split")).alias("role"), C.squeezed(F.col("split")).alias("split"), F.coalesce(C.source(F.col("source")), F.lit("")).alias("source"), F.coalesce("text", "sentence").alias("t"))
    rows = rows.filter("role is not null and t is not null and id_recording is not null")
    return rows.mapInArrow(_prepare, "id_recording string, role string, split string, source string, words string, n int, c1 long, c2 long, simhash long")


def _blocks(probe: bool):
    layout = probes if probe else own_blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("n").to_numpy()
            texts = batch.column("words").to_pylist()
            fixed = {c: batch.column(c).to_numpy() for c in ("c1", "c2", "simhash")}
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                start, length, slot = layout(int(n))
                if not len(start):
                    continue
                hashes = np.array([[word_hash(w) for w in texts[i].split(" ")] for i in at], dtype=np.uint64)
                code = codes(hashes, start, length, slot)
                k = len(start)
                arrays = [pa.array(code.ravel()), *(pa.array(np.repeat(fixed[c][at], k)) for c in ("c1", "c2", "simhash")), pa.array(np.full(k * len(at), n, np.int32))]
                arrays += [pa.array(np.tile(slot.astype(np.int32), len(at))), pa.array(np.tile(start.astype(np.int32), len(at)))]
                yield pa.RecordBatch.from_arrays(arrays, names=["code", "c1", "c2", "simhash", "n", "slot", "start"])

    return run


_BLOCK = "code long, c1 long, c2 long, simhash long, n int, slot int, start int"


def _rest_blocks(probe: bool):
    """Blocks of the rest of the text around a hot block, joined with its code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, keys = [], []
            cols = (batch.column(c).to_pylist() for c in ("code", "slot", "start", "words"))
            for row, (code, slot, start, text) in enumerate(zip(*cols)):
                ws = text.split(" ")
                n, i = slot >> 8, slot & 255
                edits = len(segments(n)) - 1
                parts = rest_segments(n, i)
                p, length = segments(n)[i]
                found = set() if parts else {code}
                for j, (s, size, before) in enumerate(parts):
                    if not probe:
                        at = (s,)
                    elif before:
                        at = range(max(s - edits, 0), min(s + edits, start - size) + 1)
                    else:
                        at = range(max(s - p + start - edits, start + length), min(s - p + start + edits, len(ws) - size) + 1)
                    for a in at:
                        found.add(xxhash.xxh64_intdigest(f"{code} {j} {' '.join(ws[a : a + size])}") - (1 << 63))
                take += [row] * len(found)
                keys += found
            out = batch.select(["c1", "c2", "simhash", "n"]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *out.columns], names=["code", "c1", "c2", "simhash", "n"])

    return run


def _distance(a: list[str], b: list[str], most: int) -> int:
    """Edit distance of word lists within ``most`` (more: most + 1), by a banded table."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    far = most + 1
    prev = [j if j <= most else far for j in range(m + 1)]
    for i in range(1, n + 1):
        low, high = max(1, i - most), min(m, i + most)
        cur = [far] * (m + 1)
        if i <= most:
            cur[0] = i
        x = a[i - 1]
        for j in range(low, high + 1):
            d = prev[j - 1] + (x != b[j - 1])
            if prev[j] + 1 < d:
                d = prev[j] + 1
            if cur[j - 1] + 1 < d:
                d = cur[j - 1] + 1
            cur[j] = d
        if min(cur[max(0, low - 1) : high + 1]) > most:
            return far
        prev = cur
    return min(prev[m], far)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, dist = [], []
        for i, (a, b) in enumerate(zip(batch.column("words_e").to_pylist(), batch.column("words_t").to_pylist())):
            x, y = a.split(" "), b.split(" ")
            most = edits_allowed(len(x), len(y))
            d = 0 if a == b else _distance(x, y, most)
            if d <= most:
                keep.append(i), dist.append(d)
        out = batch.select(["e1", "e2", "t1", "t2"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(dist, pa.int32())], names=["e1", "e2", "t1", "t2", "edits"])


def text_classes(prepared: DataFrame) -> DataFrame:
    """One row per distinct normalised text and role: role, c1, c2, words, n, simhash."""
    return prepared.groupBy("role", "c1", "c2").agg(*[F.first(c).alias(c) for c in ("words", "n", "simhash")])


def near_classes(classes: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs of text classes, evaluation (e1, e2) and training (t1, t2), with their word edits.

    A class is one normalised text; copies are not expanded into pairs.
    ``classes`` is read several times and should be a written table.
    """
    ev, tr = (classes.filter(F.col("role") == r).select("words", "n", "c1", "c2", "simhash") for r in ("eval", "train"))
    own, probe = tr.mapInArrow(_blocks(False), _BLOCK), ev.mapInArrow(_blocks(True), _BLOCK)
    hot_codes = materialise(own.groupBy("code").agg(F.count("*").alias("k")).filter(F.col("k") >= hot).select("code"), "hot-codes")
    names = {"c1": "1", "c2": "2", "simhash": "s", "n": "n"}
    named = lambda df, side: df.select("code", *[F.col(c).alias(side + x) for c, x in names.items()])
    allowed = F.floor(F.greatest("tn", "en") / WORDS_PER_EDIT)
    gap = F.abs(F.col("tn") - F.col("en"))
    near = (gap <= allowed) & (F.bit_count(F.col("ts").bitwiseXOR(F.col("es"))) <= 2 * allowed - gap)
    meet = lambda a, b: named(a, "t").join(named(b, "e"), "code").filter(near).select("e1", "e2", "t1", "t2")
    if hot_codes.isEmpty():
        pairs = meet(own, probe)
    else:
        cold = [df.join(hot_codes, "code", "left_anti") for df in (own, probe)]
        rest = []
        for df, texts, is_probe in ((own, tr, False), (probe, ev, True)):
            rows = df.join(hot_codes, "code", "left_semi").join(texts.select("c1", "c2", "words"), ["c1", "c2"])
            rest.append(rows.select("code", "c1", "c2", "simhash", "n", "slot", "start", "words").mapInArrow(_rest_blocks(is_probe), "code long, c1 long, c2 long, simhash long, n int"))
        pairs = meet(*cold).union(meet(*rest))
    pairs = pairs.distinct()
    text = lambda rows, side: rows.select(F.col("c1").alias(side + "1"), F.col("c2").alias(side + "2"), F.col("words").alias("words_" + side))
    both = pairs.join(text(ev, "e"), ["e1", "e2"]).join(text(tr, "t"), ["t1", "t2"])
    return both.select("e1", "e2", "t1", "t2", "words_e", "words_t").mapInArrow(_verify, "e1 long, e2 long, t1 long, t2 long, edits int")


def _prepared(samples: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """The members of the classes, and the near pairs of classes, both as written tables."""
    rows = materialise(prepare(samples), "cross-split")
    classes = materialise(text_classes(rows), "text-classes")
    near = materialise(near_classes(classes, hot), "near-classes")
    release(classes)
    return rows.select("role", "split", "source", "id_recording", "c1", "c2"), near


def overlapping_pairs(samples: DataFrame, hot: int = HOT) -> DataFrame:
    """All pairs of one evaluation and one training recording with nearly the same text.

    Columns id_recording_1 < id_recording_2. Null texts and ids give nothing,
    repeated rows change nothing, an empty table gives an empty result,
    further columns are not read.
    """
    member, classes = _prepared(samples, hot)
    classes = classes.select("e1", "e2", "t1", "t2")
    ev = member.filter("role = 'eval'").select(F.col("c1").alias("e1"), F.col("c2").alias("e2"), F.col("id_recording").alias("a"))
    tr = member.filter("role = 'train'").select(F.col("c1").alias("t1"), F.col("c2").alias("t2"), F.col("id_recording").alias("b"))
    pairs = classes.join(ev, ["e1", "e2"]).join(tr, ["t1", "t2"]).filter("a <> b")
    return pairs.select(F.least("a", "b").alias("id_recording_1"), F.greatest("a", "b").alias("id_recording_2")).distinct()


def overlap_report(samples: DataFrame, hot: int = HOT) -> DataFrame:
    """Per split and source of both sides: recordings that recur and the number of pairs, exact and near.

    Counted from class pairs and the classes' members per split and source, so
    that copies are never expanded.
    """
    member, classes = _prepared(samples, hot)
    members = member.select("role", "split", "source", "c1", "c2", "id_recording").distinct().groupBy("role", "split", "source", "c1", "c2").agg(F.count("*").alias("k"))
    ev = members.filter("role = 'eval'").select(F.col("c1").alias("e1"), F.col("c2").alias("e2"), F.col("split").alias("eval_split"), F.col("source").alias("eval_source"), F.col("k").alias("n_eval"))
    tr = members.filter("role = 'train'").select(F.col("c1").alias("t1"), F.col("c2").alias("t2"), F.col("source").alias("train_source"), F.col("k").alias("n_train"))
    tr = tr.groupBy("t1", "t2", "train_source").agg(F.sum("n_train").alias("n_train"))
    rows = classes.join(ev, ["e1", "e2"]).join(tr, ["t1", "t2"])
    # an evaluation text counts once, however many training texts it meets
    per_text = rows.groupBy("e1", "e2", "eval_split", "eval_source", "train_source").agg(
        F.max("n_eval").alias("n_eval"), F.sum(F.when(F.col("edits") == 0, F.col("n_eval") * F.col("n_train")).otherwise(0)).alias("exact"), F.sum(F.col("n_eval") * F.col("n_train")).alias("pairs"),
    )
    return per_text.groupBy("eval_split", "eval_source", "train_source").agg(F.sum("n_eval").alias("n_eval_recordings"), F.sum("exact").alias("n_exact_pairs"), F.sum("pairs").alias("n_pairs"))
