"""Evaluation texts that leak into a corpus, whole or in part.

Pigeonhole edit matching: every passage of ``min_words`` successive words of an
item is cut into ``errors + 1`` pieces that share no letter and no blank, so a
document that holds the passage with at most ``errors`` edits holds one of its
pieces exactly. Pieces begin at words; the blank at a cut belongs to the piece
after it, so a piece may end within a longer word of the document. Exact piece
hits come from one automaton over all pieces. Of three times as many disjoint
pieces all but ``errors`` must lie in the place that a hit points to; every
passage left is verified with Myers' bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.prefix import prefix_sum
from ..plans.storage import materialise, release
from .normalise import words

try:
    import ahocorasick
except ImportError:  # pieces are then looked up at every word, length by length
    ahocorasick = None

#: Letters of the items of one pass over the corpus. Larger item sets take further passes, each with its own automaton.
PASS_LETTERS = 4_000_000
#: Longer items are searched in parts that overlap by a passage less a word, so that every passage lies in a part.
PART_LETTERS = 100_000

_BUILT: dict = {}


def piece_cuts(passage: list[str], errors: int) -> list[int]:
    """Where the ``errors + 1`` pieces of " w1 ... wn " begin, and its length; within words only if the words are too few."""
    starts = [0]
    for w in passage:
        starts.append(starts[-1] + len(w) + 1)
    k, n = errors + 1, len(passage)
    if k <= n:
        return [starts[i * n // k] for i in range(k)] + [starts[-1] + 1]
    size = starts[-1] + 1
    if k > size:
        raise ValueError(f"{errors} errors in a passage of {size} letters")
    return [i * size // k for i in range(k + 1)]


def myers(pattern: str, text: str, most: int) -> int:
    """Least edit distance of ``pattern`` to any substring of ``text``; ``most + 1`` if greater than ``most``."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best = score
            if not best:
                break
    return best if best <= most else most + 1


class Pieces:
    """The pieces of all passages of a block of item texts, with the passages they belong to.

    ``items`` are pairs of an item and its words; an item may have several texts.
    """

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int, errors: int) -> None:
        self.min_words, self.errors = min_words, errors
        #: Whether every piece begins with the blank before a word.
        self.at_words = errors < min_words
        self.item_of: list[int] = []
        self.passages: list[str] = []
        #: piece -> (passage, letters of the passage before the piece)
        self.places: dict[str, list[tuple[int, int]]] = {}
        self._fine: dict[int, list[str]] = {}
        for item, ws in items:
            for first in range(len(ws) - min_words + 1):
                passage = ws[first : first + min_words]
                cuts, letters = piece_cuts(passage, errors), " " + " ".join(passage) + " "
                at = len(self.passages)
                self.item_of.append(item), self.passages.append(letters)
                for lead, end in zip(cuts, cuts[1:]):
                    self.places.setdefault(letters[lead:end], []).append((at, lead))
        self.lengths = sorted({len(p) for p in self.places})
        self.automaton = None
        if ahocorasick and self.places:
            self.automaton = ahocorasick.Automaton()
            for p in self.places:
                self.automaton.add_word(p, p)
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, str]]:
        """(offset, piece) of every exact hit in ``text``, which has blanks around every word."""
        if self.automaton:
            return [(end - len(p) + 1, p) for end, p in self.automaton.iter(text)]
        starts = (i for i, c in enumerate(text) if c == " " or not self.at_words)
        return [(at, text[at : at + n]) for at in starts for n in self.lengths if text[at : at + n] in self.places and at + n <= len(text)]

    def can_be_near(self, passage: int, window: str) -> bool:
        """Whether enough disjoint pieces of the passage lie in the window; each edit destroys one at most."""
        fine = self._fine.get(passage)
        if fine is None:
            letters = self.passages[passage]
            k = min(3 * (self.errors + 1), len(letters))
            if len(self._fine) > 1 << 18:
                self._fine.clear()
            fine = self._fine[passage] = [letters[i * len(letters) // k : (i + 1) * len(letters) // k] for i in range(k)]
        missing = 0
        for p in fine:
            if p not in window:
                missing += 1
                if missing > self.errors:
                    return False
        return True


def leaks_of(ws: list[str], pieces: Pieces, min_words: int, errors: int) -> dict[int, int]:
    """Items of which a passage of ``min_words`` words lies in the text with at most ``errors`` edits, with the least edits."""
    text = " " + " ".join(ws) + " "
    found: dict[int, int] = {}
    open_: dict[tuple[int, int], None] = {}
    for at, piece in pieces.hits(text):
        for passage, lead in pieces.places[piece]:
            item = pieces.item_of[passage]
            if item in found:
                continue
            if at >= lead and text.startswith(pieces.passages[passage], at - lead):
                found[item] = 0
            elif errors:
                open_[passage, at - lead] = None
    for passage, start in open_:
        item = pieces.item_of[passage]
        most = min(errors, found.get(item, errors + 1) - 1)
        if most < 1:
            continue
        letters = pieces.passages[passage]
        window = text[max(0, start - errors) : max(0, start) + len(letters) + errors]
        if pieces.can_be_near(passage, window):
            d = myers(letters, window, most)
            if d <= most:
                found[item] = d
    return found


def _search(key: str, items: list[tuple[int, str]], min_words: int, errors: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _BUILT.get(key)
        if pieces is None:
            _BUILT.clear()
            pieces = _BUILT[key] = Pieces([(i, t.split(" ")) for i, t in items], min_words, errors)
        for batch in batches:
            docs, found, edits = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ws = words(text)
                if len(ws) < min_words - errors:
                    continue
                for item, d in leaks_of(ws, pieces, min_words, errors).items():
                    docs.append(doc), found.append(item), edits.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64()), pa.array(edits, pa.int32())], names=["doc_id", "item_id", "edits"])

    return run


def _parts(min_words: int, part_letters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, parts = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                ws, a = words(text), 0
                while len(ws) - a >= min_words:
                    b, size = a, 0
                    while b < len(ws) and (size < part_letters or b - a < min_words):
                        size += len(ws[b]) + 1
                        b += 1
                    items.append(item), parts.append(" ".join(ws[a:b]))
                    if b == len(ws):
                        break
                    a = b - min_words + 1
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(parts, pa.string())], names=["item_id", "part"])

    return run


def leaked_passages(documents: DataFrame, items: DataFrame, min_words: int = 10, errors: int = 2, pass_letters: int = PASS_LETTERS, part_letters: int = PART_LETTERS) -> DataFrame:
    """Documents that hold a passage of ``min_words`` successive words of an item within ``errors`` letter edits.

    Columns doc_id, item_id, edits (least found). Case, punctuation, blanks,
    entities, invisible characters and the encoding of letters are ignored.
    Items go to the tasks in blocks of about ``pass_letters`` letters, one pass
    over the documents per block; a further block is collected only after the
    pass before is written, so the driver never holds more than one.
    Documents are never shuffled, so a hot source costs nothing extra. An item
    given several times with different texts is searched with each of them.
    Null and short texts match nothing, a document given twice is reported
    once, empty tables give an empty result.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    parts = wanted.mapInArrow(_parts(min_words, part_letters), "item_id long, part string").distinct().withColumns({"size": F.length("part"), "h": F.xxhash64("part", "item_id")})
    letters = parts.agg(F.sum("size").alias("n")).first().n or 0
    if letters > pass_letters:
        placed = prefix_sum(parts, [], "h", ["item_id", "part"], "size", "before")
        parts = materialise(placed.select("item_id", "part", F.floor(F.col("before") / pass_letters).cast("int").alias("block")), "items")
        blocks = -(-letters // pass_letters)
    else:
        parts, blocks = parts.withColumn("block", F.lit(0)), 1
    out = None
    for b in range(blocks):
        own = [(r.item_id, r.part) for r in parts.filter(F.col("block") == b).orderBy("item_id", "part").collect()]
        key = f"{hash(str(own))}-{min_words}-{errors}"
        found = docs.mapInArrow(_search(key, own, min_words, errors), "doc_id long, item_id long, edits int")
        if blocks > 1:
            found = materialise(found, "leaks")
        out = found if out is None else out.union(found)
    if blocks > 1:
        release(parts)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def leaking_documents(documents: DataFrame, items: DataFrame, min_words: int = 10, errors: int = 2) -> DataFrame:
    """Documents that hold at least ``min_words`` consecutive words of an item: doc_id, item_id.

    The search runs with its error budget; of what it finds the passages
    without an edit are kept.
    """
    return leaked_passages(documents, items, min_words, errors).filter("edits = 0").select("doc_id", "item_id")


def leaked_items(documents: DataFrame, items: DataFrame, min_words: int = 10, errors: int = 2) -> DataFrame:
    """Per item: documents that hold a passage exactly, and within ``errors`` edits; items without any have zeros."""
    found = leaked_passages(documents, items, min_words, errors)
    per = found.groupBy("item_id").agg(F.sum((F.col("edits") == 0).cast("int")).alias("n_exact"), F.count("*").alias("n_near"))
    return items.select("item_id", "source", "split").dropDuplicates(["item_id"]).join(per, "item_id", "left").fillna(0, ["n_exact", "n_near"])
