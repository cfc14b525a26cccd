"""Mixing sources to target weights.

Pfair scheduling: with weight w, a source's j-th block (from 0) is released at
slot floor(j / w) and due at slot ceil((j + 1) / w); earliest deadline first
over the slots keeps every source within less than one block of its share.

A mix has far more slots than one task can go through, so it is cut into frames
of F slots, which are scheduled independently: systematic rounding of the
cumulated weights tells how many blocks each source has given before any frame
(within less than one block of its share, and never falling, as F is at least
1 / w), and inside a frame the windows follow from the source's number of
blocks there. Both deviations together are less than two slots; a slot is half
a block, so a source is never a whole block away from its share. The weights
are used as they are, for any number of sources.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..plans.prefix import prefix_sum
from ..plans.storage import materialise
from . import columns as C

try:
    import regex
except ImportError:  # texts then go to the tokenizer whole
    regex = None

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BLOCK_TOKENS = 4096
FRAME = 1000
#: Sources of less weight are placed by their own deadlines alone, between the slots of the others.
RARE = 2.0**-20
#: Entries of a worker's cache of token counts.
CACHE = 1 << 20
#: Longer pieces are not remembered.
LONG_PIECE = 64

# Fixed value: how byte-level BPE of this kind cuts a text before it merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict = {}


def _local(path: str) -> str:
    """The tokenizer file as this worker has it: shipped with the job, or at the path itself."""
    from os.path import basename, exists

    from pyspark import SparkFiles

    try:
        shipped = SparkFiles.get(basename(path))
    except Exception:  # outside of a job
        return path
    return shipped if exists(shipped) else path


class TokenCounter:
    """Exact token counts of texts under a tokenizer file.

    Where the tokenizer cuts a text into pieces that are encoded each by
    itself, every distinct piece is encoded once and its count remembered.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("truncation")
        self.pieces = regex.compile(PIECES) if regex and plain else None
        self.of_piece: dict[str, int] = {}
        self.of_chunk: dict[str, int] = {}

    def _count(self, text: str) -> int:
        ps, known = self.pieces.findall(text), self.of_piece
        new = [p for p in set(ps) if p not in known]
        fresh = {p: len(e.ids) for p, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False))}
        known.update((p, n) for p, n in fresh.items() if len(p) <= LONG_PIECE)
        return sum(fresh[p] if p in fresh else known[p] for p in ps)

    def __call__(self, texts: list[str]) -> list[int]:
        if self.pieces is None:
            return [len(e.ids) for i in range(0, len(texts), 256) for e in self.tokenizer.encode_batch(texts[i : i + 256], add_special_tokens=False)]
        if len(self.of_piece) > CACHE:
            self.of_piece.clear()
        if len(self.of_chunk) > CACHE:
            self.of_chunk.clear()
        out = []
        for text in texts:
            if "  " in text:  # a run of blanks is cut before its last one
                out.append(self._count(text))
                continue
            # no piece crosses a single blank: it begins one
            head, *rest = text.split(" ")
            n = self._count(head) if head else 0
            known = self.of_chunk
            for chunk in rest:
                k = known.get(chunk)
                if k is None:
                    k = self._count(" " + chunk)
                    if len(chunk) <= LONG_PIECE:
                        known[chunk] = k
                n += k
            out.append(n)
        return out


def token_counter(tokenizer: str = TOKENIZER):
    """A pandas UDF: tokens of a text under the tokenizer file; null and empty texts have none."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        if tokenizer not in _LOADED:
            _LOADED[tokenizer] = TokenCounter(_local(tokenizer))
        return pd.Series(_LOADED[tokenizer](["" if t is None else t for t in texts]), dtype="int64")

    return count


def sized(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, canonical source (null stays null) and n_tokens of every document. The tokenizer file is shipped to the executors."""
    documents.sparkSession.sparkContext.addFile(tokenizer)
    return documents.select("doc_id", C.source(F.col("source")).alias("source"), token_counter(tokenizer)(F.col("text")).alias("n_tokens"))


def budgets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: size, want (tokens it should give) and most (tokens it can give).

    ``sizes`` has source and n_tokens; a source without documents has size 0.
    Of a source given several times the weights add up and the greatest cap
    counts.
    """
    per = sizes.groupBy("source").agg(F.sum("n_tokens").alias("size"))
    total = per.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    t = targets.select(C.source(F.col("source")).alias("source"), F.col("target_weight").cast("double").alias("target_weight"), F.col("max_repeats").cast("int").alias("max_repeats")).filter("source is not null")
    t = t.groupBy("source").agg(F.sum("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    out = t.join(per, "source", "left").crossJoin(total).fillna(0, ["size"])
    return out.withColumns({"want": F.col("target_weight") * F.col("total"), "most": F.coalesce(F.col("max_repeats"), F.lit(0)) * F.col("size")})


def given_before(cumulated: np.ndarray, slot: int) -> np.ndarray:
    """Blocks that each source has given before ``slot``, by systematic rounding of the cumulated weights (the last is 1)."""
    edges = np.floor(cumulated * slot + 0.5).astype(np.int64)
    edges[-1] = slot
    return np.diff(edges, prepend=0)


def pfair(counts: list[int]) -> list[tuple[int, int]]:
    """(source, its block) of every slot of a frame of ``sum(counts)`` slots, by earliest deadline first."""
    n = sum(counts)
    waiting: list[list[int]] = [[] for _ in range(n + 1)]
    done = [0] * len(counts)
    waiting[0] = [s for s, a in enumerate(counts) if a]
    heap: list[tuple[int, int]] = []
    out = []
    for t in range(n):
        for s in waiting[t]:
            heapq.heappush(heap, (-(-(done[s] + 1) * n // counts[s]), s))
        _, s = heapq.heappop(heap)
        out.append((s, done[s]))
        done[s] += 1
        if done[s] < counts[s]:
            waiting[max(done[s] * n // counts[s], t + 1)].append(s)
    return out


def frame_length(weights: list[float], least: int = FRAME) -> int:
    return max(least, ceil(1 / min(weights)) + 1)


def _frames(cumulated: np.ndarray, length: int, names: list[str], blocks: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                before = given_before(cumulated, k * length)
                counts = given_before(cumulated, (k + 1) * length) - before
                rows = [(names[s], int(before[s]) + j, k * length + t) for t, (s, j) in enumerate(pfair(counts.tolist())) if before[s] + j < blocks[s]]
                cols = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()))], names=["source", "block", "slot"])

    return run


def schedule(spark, plan: list[tuple[str, float, int]], least: int = FRAME) -> DataFrame:
    """The slot of every block: source, block, slot, from (source, weight, number of blocks) of each source.

    Frames are independent of one another and spread over the tasks.
    """
    schema = "source string, block long, slot long"
    total = sum(w for _, w, _ in plan)
    often = [(s, w, n) for s, w, n in plan if w >= RARE * total]
    rare = [(s, w / total, n) for s, w, n in plan if w < RARE * total]
    if not often:
        return spark.createDataFrame([], schema)
    share = sum(w for _, w, _ in often)
    weights = [w / share for _, w, _ in often]
    cumulated = np.cumsum(weights)
    cumulated[-1] = 1.0
    length = frame_length(weights, least)
    frames = max(ceil(max((n + 1) / w for w, (_, _, n) in zip(weights, often)) / length), 1)
    run = _frames(cumulated, length, [s for s, *_ in often], [n for *_, n in often])
    out = spark.range(frames).mapInArrow(run, schema)
    if rare:
        few = spark.createDataFrame(rare, "source string, w double, n long").filter("n > 0")
        out = out.unionByName(few.select("source", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block")).select("source", "block", F.floor((F.col("block") + 0.5) / F.col("w")).cast("long").alias("slot")))
    return out


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block_tokens: int = BLOCK_TOKENS, seed: int = 42, buckets: int = 64) -> DataFrame:
    """The mixed corpus: source, doc_id, repeat (from 0), slot, offset, n_tokens; ordered by (slot, offset, doc_id).

    Each source of the targets gives ``target_weight`` of the tokens of all
    documents, or all it has ``max_repeats`` times over. Every repeat has its
    own random order. A slot holds half a block of one source; a document lies
    in the slot in which it begins, so a source exceeds its tokens by less
    than one document. Documents of sources without a target, and of null
    source, count for the total only; texts without tokens carry nothing and
    are left out; ties of the order are broken by doc_id. The targets are
    collected to the driver, the documents never. Empty tables give an empty
    mix.
    """
    return _mix_sized(materialise(sized(documents, tokenizer), "sizes"), targets, block_tokens, seed, buckets)


def _mix_sized(sizes: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 42, buckets: int = 64) -> DataFrame:
    half = max(block_tokens // 2, 1)
    plan = budgets(sizes, targets).filter("size > 0 and target_weight > 0 and max_repeats > 0").orderBy("source").collect()  # as many rows as targets
    spark = sizes.sparkSession
    quota = [min(r.want, float(r.most)) for r in plan]
    rows = [(r.source, r.size, q, int(ceil(q / r.size))) for r, q in zip(plan, quota)]
    small = spark.createDataFrame(rows, "source string, size long, quota double, repeats int")
    docs = sizes.filter("n_tokens > 0 and source is not null").join(small.select("source", "repeats"), "source")
    docs = docs.select("source", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)).alias("repeat"))
    docs = docs.withColumn("h", F.xxhash64("doc_id", "repeat", F.lit(seed)))
    placed = prefix_sum(docs, ["source", "repeat"], "h", ["doc_id"], "n_tokens", "before", buckets)
    placed = placed.join(small.select("source", "size", "quota"), "source").withColumn("at", F.col("repeat") * F.col("size") + F.col("before")).filter("at < quota")
    placed = placed.withColumn("block", F.floor(F.col("at") / half).cast("long"))
    slots = schedule(spark, [(r.source, r.target_weight, int(ceil(q / half))) for r, q in zip(plan, quota)])
    out = placed.join(slots, ["source", "block"])
    return out.select("source", "doc_id", "repeat", "slot", (F.col("at") - F.col("block") * half).cast("long").alias("offset"), "n_tokens")


def mix_report(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per source: tokens it has, should give and gives in the mix, its target and actual share, repeats, and whether it falls short.

    A source that can reach its target gives at least that, as its last
    document begins below it; so a source is short exactly where the mix holds
    fewer of its tokens than wanted.
    """
    counted = materialise(sized(documents, tokenizer), "sizes")
    mixed = _mix_sized(counted, targets)
    per = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count("*").alias("n_rows"), (F.max("repeat") + 1).alias("n_repeats"))
    out = budgets(counted, targets).join(per, "source", "left").fillna(0, ["mixed_tokens", "n_rows", "n_repeats"])
    all_ = out.agg(F.sum("mixed_tokens").alias("of_all"))
    return out.crossJoin(all_).select(
        "source", "size", F.round("want", 3).alias("want"), "mixed_tokens", "n_rows", "n_repeats", "target_weight",
        F.round(F.try_divide("mixed_tokens", "of_all"), 6).alias("actual_share"), (F.col("mixed_tokens") < F.col("want")).alias("short"),
    )


def short_sources(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Sources that fall short of their target share in the mix even at full repetition: source."""
    return mix_report(documents, targets, tokenizer).filter("short").select("source")
