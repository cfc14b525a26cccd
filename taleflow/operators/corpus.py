"""Sentence corpora: mixing, order, decontamination, n-grams."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.prefix import dense_numbers, prefix_sum
from ..plans.storage import materialise, release

#: Evaluation sentences of one pass; more take further passes.
MAX_SENTENCES = 20_000


def probabilities(n: int, given: list[float] | None = None) -> list[float]:
    """Uniform by default (the last is one less the rest); given ones must be n and sum to one."""
    if given is None:
        p = [1 / n] * (n - 1)
        return [*p, 1 - sum(p)]
    if len(given) != n:
        raise ValueError("one probability per data set is needed")
    if sum(given) != 1:
        raise ValueError("probabilities must sum to one")
    return given


def interleave(frames: list[DataFrame], key: str, given: list[float] | None = None, seed: int = 4242) -> DataFrame:
    """Mix until every source is exhausted once, small sources starting over.

    The expectation of drawing source i with probability p_i: with
    T = max(n_i / p_i), source i gives p_i * T rows, the last round its first
    rows in hash order. Adds source_no, repeat and the order column mix_order,
    a seeded hash. A source of probability 0, or without rows, gives none.
    """
    p = probabilities(len(frames), given)
    if len(frames) == 1:
        return frames[0].withColumns({"source_no": F.lit(0), "repeat": F.lit(0), "mix_order": F.xxhash64(F.col(key), F.lit(0), F.lit(0), F.lit(seed))})
    sizes = [f.count() for f in frames]
    total = max((n / q for n, q in zip(sizes, p) if q > 0), default=0)
    out = None
    for i, (f, n, q) in enumerate(zip(frames, sizes, p)):
        full, rest = divmod(round(q * total), n) if n else (0, 0)
        rounds = F.sequence(F.lit(0), F.lit(full + (1 if rest else 0) - 1)) if full or rest else F.array().cast("array<int>")
        rows = f.withColumns({"source_no": F.lit(i), "repeat": F.explode(rounds)})
        rows = rows.withColumn("mix_order", F.xxhash64(F.col(key), F.lit(i), F.col("repeat"), F.lit(seed)))
        if rest:
            last = prefix_sum(rows.filter(F.col("repeat") == full).withColumn("__one", F.lit(1)), ["source_no"], "mix_order", [key], "__one", "__rank")
            rows = rows.filter(F.col("repeat") < full).unionByName(last.filter(F.col("__rank") < rest).drop("__one", "__rank"))
        out = rows if out is None else out.unionByName(rows)
    return out


def seeded_shuffle(df: DataFrame, key: str, seed: int = 4242) -> DataFrame:
    """A reproducible order whatever the partitioning: sorted by a seeded hash."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def _delete(sentences: list[str]):
    """Deletion of sentences in the order given, each wherever it stands by then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for i, x in enumerate(sentences):
                automaton.add_word(x, i)
            automaton.make_automaton()
        except ImportError:
            automaton = None

        def found(t: str) -> set[int]:
            if automaton:
                return {i for _, i in automaton.iter(t)} if sentences else set()
            return {i for i, x in enumerate(sentences) if x in t}

        for batch in batches:
            texts, changed = [], []
            for t in batch.column("__text").to_pylist():
                new = t
                todo = sorted(found(t)) if t else []
                while todo:
                    i = heapq.heappop(todo)
                    if sentences[i] in new:
                        new = new.replace(sentences[i], "")
                        # what is left may join to a later sentence
                        for k in found(new) - set(todo):
                            if k > i:
                                heapq.heappush(todo, k)
                texts.append(new), changed.append(new != t)
            cols = {n: batch.column(n) for n in batch.schema.names if n != "__text"}
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(texts, pa.string()), pa.array(changed, pa.bool_())], names=[*cols, "clean_text", "changed"])

    return run


def decontaminate(df: DataFrame, text: str, key: str, sentences: DataFrame, column: str, max_sentences: int = MAX_SENTENCES) -> DataFrame:
    """Delete every occurrence of the evaluation sentences: key, clean_text, changed.

    The sentences go to the tasks in passes of ``max_sentences``, longest
    first, ties by text; a pass is written before the next is collected, so
    the driver never holds more than one. Rows are never shuffled. Null texts
    stay null.
    """
    todo = sentences.select(F.col(column).alias("s")).filter("s is not null and s <> ''").distinct()
    passes = max(1, math.ceil(todo.count() / max_sentences))
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, F.col(text).alias("__text"))
    if passes == 1:
        block = sorted((r.s for r in todo.collect()), key=lambda x: (-len(x), x))
        return rows.mapInArrow(_delete(block), f"{key} {kind}, clean_text string, changed boolean")
    ordered = todo.orderBy(F.desc(F.length("s")), "s")
    fixed = materialise(ordered.select(F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__id"), "s"), "sentences")
    numbered = dense_numbers(fixed, "__part", "__id", "no").withColumn("pass", F.floor((F.col("no") - 1) / max_sentences))
    rows, before = rows.withColumn("__changed", F.lit(False)), None
    for i in range(passes):
        block = sorted((r.s for r in numbered.filter(F.col("pass") == i).collect()), key=lambda x: (-len(x), x))
        done = rows.mapInArrow(_delete(block), f"{key} {kind}, __changed boolean, clean_text string, changed boolean")
        done = materialise(done.select(key, "clean_text", (F.col("changed") | F.col("__changed")).alias("changed")), "deleted")
        if before is not None:
            release(before)
        before, rows = done, done.select(key, F.col("clean_text").alias("__text"), F.col("changed").alias("__changed"))
    release(fixed)
    return done


def ngrams(df: DataFrame, text: str, n: int = 3, prune: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Counts of all n-grams up to order ``n``: size, gram, count; those not above their order's prune count are left out."""
    tokens = df.select(F.filter(F.split(F.col(text), "(?U)\\s+"), lambda w: w != "").alias("t")).filter(F.size("t") > 0)
    grams = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.least(F.lit(n), F.size("t"))),
            lambda k: F.transform(F.sequence(F.lit(1), F.size("t") - k + 1), lambda i: F.struct(k.alias("size"), F.array_join(F.slice("t", i, k), " ").alias("gram"))),
        )
    )
    out = tokens.select(F.explode(grams).alias("g")).groupBy("g.size", "g.gram").agg(F.count("*").alias("count"))
    least = F.when(F.col("size") == 1, prune[0]).otherwise(prune[-1])
    return out.filter(F.col("count") > least)


def edit_arpa(lines: DataFrame, number: str = "line_no", text: str = "line") -> DataFrame:
    """An ARPA file's lines with the unigram count raised and an end-of-sentence line after the start-of-sentence line.

    Of each kind only the first line of the file is edited. Columns: the
    number, part (1 for an added line, else 0) and the line.
    """
    is_count = F.col(text).rlike(r"^ngram 1=\d+\s*$")
    is_start = F.col(text).rlike("(?:^|\\t)<s>(?:\\t|$)")
    first = lines.agg(F.min(F.when(is_count, F.col(number))).alias("__count"), F.min(F.when(is_start, F.col(number))).alias("__start"))
    raised = F.concat(F.lit("ngram 1="), (F.regexp_extract(text, r"^ngram 1=(\d+)", 1).try_cast("long") + 1).cast("string"))
    line = F.when(F.col(number) == F.col("__count"), raised).otherwise(F.col(text))
    copies = F.when(F.col(number) == F.col("__start"), F.array(line, F.replace(F.col(text), F.lit("<s>"), F.lit("</s>")))).otherwise(F.array(line))
    return lines.crossJoin(first).select(number, F.posexplode(copies).alias("part", text))  # one row
