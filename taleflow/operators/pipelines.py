"""Whole pipelines, each one lazy plan composed of the operators: evaluation, validation, loading, metadata, corpora."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import demographics, metrics, numerals, text
from . import corpus, filters
from .cube import pruned_cube

CATEGORIES = ("age_group", "gender", "dialect")


@dataclass(frozen=True)
class CleanSpec:
    """How texts are cleaned; references, predictions and corpora share one."""

    lower: bool = True
    keep: str | None = None
    numerals: bool = True
    nfkc: bool = False
    conversions: dict[str, str] = field(default_factory=lambda: text.CONVERSIONS)

    def apply(self, df: DataFrame, *columns: str) -> DataFrame:
        """``df`` with the columns cleaned in place; numerals become words before anything else."""
        for c in columns:
            raw = numerals.in_words(F.col(c)) if self.numerals else F.col(c)
            df = df.withColumn(c, text.clean(raw, self.lower, self.keep, self.conversions, self.nfkc))
        return df


def with_counts(df: DataFrame, reference: str, prediction: str, once: bool = False) -> DataFrame:
    """Add the alignment counts of characters and words as ``chars`` and ``words``.

    ``once`` where a filter on them follows: the optimizer would put it below, with
    copies of the alignment and of the cleaning, and texts would be worked on twice.
    What depends on the partition, as the condition here does by its form, is not copied.
    """
    counts = {"chars": metrics.char_counts(reference, prediction), "words": metrics.word_counts(reference, prediction)}
    return df.withColumns({k: F.when(F.spark_partition_id() >= 0, c) for k, c in counts.items()} if once else counts)


def with_groups(df: DataFrame, dialect_map: DataFrame, strict: bool = False) -> DataFrame:
    """Add the age group of the scores and replace the sub-dialect by its dialect, or by Non-native."""
    return demographics.main_dialect(df, dialect_map, strict=strict).withColumn("age_group", demographics.evaluation_age_group(F.col("age"), strict))


def evaluate(samples: DataFrame, dialect_map: DataFrame, spec: CleanSpec, reference: str = "text", prediction: str = "asr_prediction", categories: tuple[str, ...] = CATEGORIES, normalise: bool = True) -> DataFrame:
    """The score cube of a model: categories (null for all), n_rows, cer and wer.

    Both texts are cleaned alike, errors and lengths are counted per row, and
    every cell divides the sum of its errors by the sum of its lengths. Rows
    without a reference or prediction are left out; a cell without any letter
    has null rates; an empty table gives no cell.
    """
    rows = with_groups(samples, dialect_map).select(*categories, F.col(reference).alias("ref"), F.col(prediction).alias("hyp")).filter("ref is not null and hyp is not null")
    rows = with_counts(spec.apply(rows, "ref", "hyp"), "ref", "hyp")
    sums = {}
    for c in ("chars", "words"):
        sums |= {f"{c}_errors": metrics.errors_of(F.col(c)), f"{c}_total": metrics.total_of(F.col(c), normalise)}
    rows = rows.select(*categories, *[v.alias(k) for k, v in sums.items()])
    cells = pruned_cube(rows, list(categories), {k: k for k in sums})
    return cells.select(*categories, "n_rows", F.try_divide("chars_errors", "chars_total").alias("cer"), F.try_divide("words_errors", "words_total").alias("wer"))


def validate(samples: DataFrame, spec: CleanSpec, model: str, reference: str = "text", prediction: str = "asr_prediction", max_cer: float | None = 0.6, array: str | None = None, rate: int = 16_000) -> DataFrame:
    """Samples with a model's opinion of them: asr_prediction, asr_label, asr_validation_model, asr_cer, asr_wer.

    Rows of a quarter of a second to an hour (where there is an ``array``) with
    text and not rejected are kept; label and prediction are cleaned alike;
    the rates are those of the row, null where there is no prediction. With
    ``max_cer`` only rows strictly below stay.
    """
    rows = filters.filter_samples(samples, reference, array, rate, 0.25, 3600.0)
    if max_cer is not None:
        # without a prediction there is no rate below the limit
        rows = rows.filter(F.col(prediction).isNotNull())
    own = [c for c in rows.columns if c not in (prediction, "asr_label", "asr_validation_model", "asr_cer", "asr_wer", "asr_prediction")]
    rows = rows.select(*own, F.col(prediction).alias("asr_prediction"), F.col(reference).alias("asr_label"))
    rows = with_counts(spec.apply(rows, "asr_prediction", "asr_label"), "asr_label", "asr_prediction", once=max_cer is not None)
    rows = rows.withColumns({"asr_validation_model": F.lit(model), "asr_cer": metrics.row_rate(F.col("chars")), "asr_wer": metrics.row_rate(F.col("words"))}).drop("chars", "words")
    return rows if max_cer is None else filters.below_error(rows, "asr_cer", max_cer)


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """n_before and n_after of two stages of a pipeline, one row."""
    return before.agg(F.count("*").alias("n_before")).crossJoin(after.agg(F.count("*").alias("n_after")))


@dataclass(frozen=True)
class Corpus:
    """One data set of a mix: its rows, the names of its columns and its probability."""

    rows: DataFrame
    key: str
    text: str
    audio: str | None = None
    probability: float | None = None


def load_training(corpora: list[Corpus], spec: CleanSpec, seed: int = 4242, rate: int = 16_000, low: float = 0.0, high: float = float("inf")) -> DataFrame:
    """The training rows of several corpora in one plan: key, text, audio (where any has it), source_no, repeat, mix_order.

    Each corpus is renamed, filtered (duration, text, not rejected) and
    pruned; the corpora are interleaved by their probabilities, small ones
    starting over; the texts are cleaned last. Rows in the order of mix_order
    are a seeded shuffle; a single corpus passes through.
    """
    frames = []
    with_audio = any(c.audio for c in corpora)
    for c in corpora:
        rows = filters.filter_samples(c.rows, c.text, c.audio, rate, low, high)
        audio = [F.col(c.audio).alias("audio") if c.audio else F.lit(None).cast("array<float>").alias("audio")] if with_audio else []
        frames.append(rows.select(F.col(c.key).cast("string").alias("key"), F.col(c.text).alias("text"), *audio))
    given = [c.probability for c in corpora]
    mixed = corpus.interleave(frames, "key", None if None in given else given, seed)
    return spec.apply(mixed, "text")


def load_evaluation(samples: DataFrame, spec: CleanSpec, reference: str = "text", array: str | None = None, rate: int = 16_000, low: float = 0.0, high: float = float("inf")) -> DataFrame:
    """Evaluation rows filtered like training rows and cleaned, all columns kept, the reference as ``text``."""
    rows = filters.filter_samples(samples, reference, array, rate, low, high).withColumnRenamed(reference, "text")
    return spec.apply(rows, "text")


def validation_split_name(dataset: str | Column, subset: str | Column) -> Column:
    """``val_<last part of the id>_<subset>`` in lower case, hyphens as underscores."""
    d, s = (x if isinstance(x, Column) else F.lit(x) for x in (dataset, subset))
    return F.lower(F.replace(F.concat(F.lit("val_"), F.substring_index(d, "/", -1), F.lit("_"), s), F.lit("-"), F.lit("_")))


def split_metadata(splits: list[DataFrame] | DataFrame, dialect_map: DataFrame, max_cer: float = 0.6, drop: tuple[str, ...] = ("audio",), strict: bool = False) -> DataFrame:
    """Metadata for a split search out of the rows of all splits.

    Main dialect (an unknown sub-dialect is an error if ``strict``), age group,
    no nonbinary speakers, neither rejected nor doubtful recordings, and only
    those below the error limit. Waveforms are dropped first.
    """
    parts = splits if isinstance(splits, list) else [splits]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    rows = demographics.main_dialect(rows.drop(*drop), dialect_map, strict=strict)
    rows = rows.filter(filters.none_of(F.col("gender"), "nonbinary") & filters.none_of(F.col("validated"), "rejected", "maybe"))
    return filters.below_error(rows.withColumn("age_group", demographics.age_group(F.col("age"))), "asr_cer", max_cer)


def sentence_corpus(texts: list[tuple[DataFrame, str]], evaluation: list[tuple[DataFrame, str]], spec: CleanSpec, seed: int = 4242, keep_empty: bool = False) -> DataFrame:
    """Distinct cleaned sentences without the evaluation sentences in them: text, changed, order.

    Corpus and evaluation sentences are cleaned alike. Every occurrence of an
    evaluation sentence is deleted, longest first; what is left of it is
    trimmed, and dropped if empty unless ``keep_empty``. Rows by ``order`` are
    a seeded shuffle. An empty corpus stays empty.
    """
    union = None
    for part in ([df.select(F.col(c).alias("text")) for df, c in texts], [df.select(F.col(c).alias("text")) for df, c in evaluation]):
        rows = part[0]
        for p in part[1:]:
            rows = rows.unionByName(p)
        rows = spec.apply(rows.filter("text is not null"), "text").filter("text <> ''").distinct()
        union = rows if union is None else (union, rows)
    sentences, held_out = union
    out = corpus.decontaminate(sentences.withColumn("key", F.col("text")), "text", "key", held_out, "text")
    out = out.select(text.tidy(text.strip(F.col("clean_text"))).alias("text"), "changed")
    if not keep_empty:
        out = out.filter("text <> ''")
    return out.withColumn("order", F.xxhash64("text", F.lit(seed)))


def token_error_rates(df: DataFrame, scores: str, labels: str, vocabulary: list[str], pad: int, normalise: bool = True) -> DataFrame:
    """Error rates of a model's scores per step against label ids: n, cer, wer.

    Steps scored -100 throughout are padding, label -100 is padding; both are
    decoded by the vocabulary, runs of one prediction collapsed, padding left
    out, the word delimiter read as a blank.
    """
    from ..functions import audio

    names = F.array(*[F.lit(" " if v == "|" else v) for v in vocabulary])
    best = audio.argmax(F.transform(scores, lambda x: F.when(F.forall(x, lambda v: v == -100), F.transform(x, lambda v, i: F.when(i == pad, F.lit(0.0)).otherwise(F.lit(-1.0)))).otherwise(x.cast("array<double>"))))
    runs = F.filter(F.transform("__best", lambda t, i: F.when((i > 0) & (F.get("__best", i - 1) == t), F.lit(None)).otherwise(t)), lambda t: t.isNotNull() & (t != pad))
    spell = lambda ids: F.array_join(F.transform(ids, lambda t: F.get(names, t)), "")
    said = F.filter(labels, lambda t: (t != -100) & (t != pad))
    rows = df.withColumn("__best", best).select(spell(said).alias("ref"), spell(runs).alias("hyp"))
    rows = with_counts(rows, "ref", "hyp")
    return rows.agg(F.count("*").alias("n"), metrics.error_rate("chars", normalise).alias("cer"), metrics.error_rate("words", normalise).alias("wer"))
