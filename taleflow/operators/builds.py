"""Composite builds of published tables out of raw metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.audio import time_slice
from ..functions.demographics import safe_int
from ..functions.text import blank_to_null, original_filename, strip, strip_unknown
from ..plans.prefix import dense_numbers
from ..plans.storage import materialise
from .filters import usable_segment
from .utterances import id_parts, recording_file, to_ms


def one_per(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key: of several the least by all other columns in their order, nulls first."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, "__r.*").select(*df.columns)


def read_aloud(recordings: DataFrame, sentences: DataFrame, speakers: DataFrame, sentence_key: str, speaker_key: str, left_speaker: str, files: DataFrame | None = None, stem: str | None = None) -> DataFrame:
    """Recordings with their sentence and speaker (inner joins; each key once on the right side).

    With ``files`` (stem, path) only recordings that have a file stay, with its
    path; of several files of one stem the last by path counts.
    """
    out = recordings.join(one_per(sentences, sentence_key), sentence_key)
    p = one_per(speakers, speaker_key)
    out = out.join(p, out[left_speaker] == p[speaker_key])
    if files is not None:
        last = files.groupBy("stem").agg(F.max("path").alias("audio_path"))
        out = out.join(last, out[stem] == last["stem"]).drop(last["stem"])
    return out


def known_conversations(conversations: DataFrame, speakers: DataFrame, ids: list[str], key: str) -> DataFrame:
    """Conversations of which any of the id columns is a known speaker."""
    known = speakers.select(F.col(key).alias("__k")).distinct()
    spread = conversations.select("id_conversation", F.explode(F.array(*ids)).alias("__k")).join(known, "__k", "left_semi").select("id_conversation").distinct()
    return conversations.join(spread, "id_conversation", "left_semi")


def conversation_segments(events: DataFrame, conversations: DataFrame, speakers: DataFrame) -> DataFrame:
    """Usable segments of speakers A and B with the conversation's and the speaker's fields.

    ``events`` has id_conversation, event_no, start_ms, end_ms, name and text.
    """
    tag = F.upper(strip(F.col("name")))
    seg = events.withColumn("tag", tag).filter(F.col("tag").isin("A", "B") & usable_segment(F.col("text")))
    conv = one_per(conversations, "id_conversation")
    seg = seg.join(conv, "id_conversation").withColumn("id_speaker", F.when(F.col("tag") == "A", F.col("id_speaker_a")).otherwise(F.col("id_speaker_b")))
    out = seg.join(one_per(speakers, "id_speaker"), "id_speaker")
    return out.select("id_conversation", "location", "location_roomdim", "noise_level", "noise_type", "id_speaker", "age", "gender", "dialect", "country_birth", "education", "occupation", F.col("event_no").alias("id_segment"), strip(F.col("text")).alias("text"), "start_ms", "end_ms")


def with_clips(segments: DataFrame, recordings: DataFrame, rate: int, key: str = "stem") -> DataFrame:
    """Segments (key, start_ms, end_ms) with their slice of the recording (key, array) as ``audio``; segments without one are dropped.

    The waveforms are the large side: segments of one recording are put
    together first, so that each waveform is moved once and sliced in place.
    """
    own = [c for c in segments.columns if c != key]
    grouped = segments.groupBy(key).agg(F.collect_list(F.struct(*own)).alias("__s"))
    out = grouped.join(recordings.select(key, "array"), key).select(key, F.explode(F.transform("__s", lambda x: F.struct(x.alias("s"), time_slice(F.col("array"), x["start_ms"], x["end_ms"], rate).alias("audio")))).alias("__x"))
    return out.select(key, "__x.s.*", "__x.audio")


def parliament(utterances: DataFrame, folder: str = "processed_audio") -> DataFrame:
    """Utterances with cleaned text, speaker, source file, slice bounds and path; empty transcripts stay empty."""
    u = one_per(utterances, "utterance_id")
    return u.select(
        "utterance_id", F.get(id_parts(F.col("utterance_id")), 0).alias("speaker_id"), recording_file(F.col("utterance_id")).alias("src_fname"), strip_unknown(F.col("transcript")).alias("text"),
        to_ms(F.col("start_time")).alias("start_ms"), to_ms(F.col("end_time")).alias("end_ms"), F.concat(F.lit(folder + "/"), "utterance_id", F.lit(".wav")).alias("audio_path"), "split",
    )


# From this id of the speaker on, the id is moved by so much.
MOVED = ((11100, -101), (11200, 1))


def spoken_lines(files: DataFrame, lines: DataFrame, speaker: str = "mic", moved: tuple[tuple[int, int], ...] = MOVED) -> DataFrame:
    """Files named ``<speaker>_<1-based id>`` with their transcription line: place, stem, speaker_id, transcription_id, text.

    The ids of one speaker are moved by the rules, one after the other, each
    looking at the id as it is by then. Negative ids, and ids without a line,
    are left out. ``place`` is the rank of the stem by its parts.
    """
    parts = F.split("stem", "_")
    f = files.withColumns({"speaker_id": F.get(parts, 0), "id": F.get(parts, 1).try_cast("int")})
    for least, by in moved:
        f = f.withColumn("id", F.when((F.col("speaker_id") == speaker) & (F.col("id") >= least), F.col("id") + by).otherwise(F.col("id")))
    out = f.filter("id >= 0").join(lines.withColumnRenamed("line_no", "id"), "id")
    out = out.select("stem", "speaker_id", F.col("id").alias("transcription_id"), F.col("line").alias("text"))
    return by_stem_parts(out)


def by_stem_parts(df: DataFrame) -> DataFrame:
    """Rows with ``place``, the rank of their stem among all as lists of parts, part by part.

    The ranks come from a range-partitioned sort, not from one task.
    """
    ordered = df.withColumn("__parts", F.split("stem", "_")).orderBy("__parts", "stem").drop("__parts")
    # the sort is fixed by writing it: one file per sorted partition
    rows = materialise(ordered.select(F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__id"), "*"), "ordered")
    return dense_numbers(rows, "__part", "__id", "place")


def match_by_name(rows: DataFrame, row_key: str, files: DataFrame, file_name: str, seed: int = 4242) -> DataFrame:
    """Rows with the file whose name has the row's key; of several one by a seeded hash, of none null."""
    hit = files.groupBy("key").agg(F.min_by(file_name, F.struct(F.md5(F.concat(F.col(file_name), F.lit(str(seed)))), F.col(file_name))).alias(file_name), F.count("*").alias("n_files"))
    return rows.join(hit.withColumnRenamed("key", row_key), row_key, "left")


def dictation(metadata: DataFrame, names: dict[str, str], files: DataFrame, text: str = "text", age: str = "age", time: str = "recorded_at", time_format: str = "dd MMM yyyy'T'HH:mm:ss", name: str = "file_name", seed: int = 4242) -> DataFrame:
    """Recordings of a metadata table with the audio file of their time and original name.

    Columns are kept and renamed by ``names``. The age becomes an integer or
    null, placeholder texts null, and rows with any null are dropped. A file
    belongs to a row if its name begins with the hour and minute of the row's
    time, ``-`` or ``_``, and the row's original file name; of several one is
    taken by a seeded hash, and rows without one are dropped. The columns
    become recording_time (ISO), audio_path and n_files beside those named.
    """
    rows = metadata.select(*[F.col(k).alias(v) for k, v in names.items()])
    rows = rows.withColumns({age: safe_int(F.col(age).cast("string")), text: blank_to_null(F.col(text))}).na.drop()
    at = F.to_timestamp(F.col(time), time_format)
    rows = rows.withColumns({"recording_time": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), "__key": F.concat_ws("_", F.date_format(at, "HHmm"), original_filename(F.col(name)))}).drop(time)
    stem_ = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    keyed = files.select(F.col("path").alias("audio_path"), F.regexp_replace(F.lower(stem_), "^(\\d{4})[-_]", "$1_").alias("key"))
    return match_by_name(rows, "__key", keyed, "audio_path", seed).filter("audio_path is not null").drop("__key")
