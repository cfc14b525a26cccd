"""Speech transcripts into clean, ordered speaker turns.

Lines are cut out of the raw text and their fields extracted with SQL
expressions; untimed lines take time and speaker from the line before by a
forward-filling window; marked noise is removed; successive lines of one
speaker become a turn by gaps-and-islands identifiers.

Two shuffles carry the data: the chunks, before they are cut into lines, so
that the windows over a chunk's lines need no other; and the spoken lines, by
conversation and block of time, for repeats and islands alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialise
from . import columns as C

#: Stands between the fields that a pattern has found; blanked in the texts.
CUT = "\x01"
_CLOCK = r"(?:\d+:)?\d{1,3}:\d{1,2}(?:[.,]\d+)?"
_LABEL = r"[ \t]?[^\s:(\[<\-][^:(\[<\t\n]{0,24}?"

#: ``[00:01:16] A: words``
BRACKET = rf"^\s*\[\s*({_CLOCK})(?:\s*[-–—]+>?\s*({_CLOCK}))?\s*\]\s*({_LABEL})\s*:(.*)$"
#: ``A (00:16) words``
ROUND = rf"^({_LABEL})\s*\(({_CLOCK})\)(.*)$"
#: ``Dialogue: 0,0:00:02.44,0:00:04.93,Default,A,0,0,0,,words``
EVENT = r"^\s*Dialogue:[^,]*,([^,]*),([^,]*),[^,]*,([^,]*),[^,]*,[^,]*,[^,]*,[^,]*,(.*)$"
#: ``(3,4–9,6 s) A – words``
SECONDS = r"^\s*\(\s*(\d+(?:[.,]\d+)?)\s*[-–—]\s*(\d+(?:[.,]\d+)?)\s+s(?:ek\.?|\.)?\s*\)\s*(.{1,24}?)\s+[-–—:]\s?(.*)$"
#: start, end in milliseconds, label and words between tabs
TABBED = r"^\s*(\d+)\t(\d+)\t([^\t]*)\t(.*)$"
#: ``00:00:02,493 --> 00:00:06,012``; label and words are on the next line
CUE = rf"^\s*({_CLOCK})\s*-+>\s*({_CLOCK}).*$"
#: ``A: words`` or ``<v A>words``, below a cue
CUE_TEXT = r"^\s*(?:<v(?:\.[^\s>]*)?\s+([^>]*)>|([^:<>]{1,24}?)\s*:)(.*)$"

#: A or B by letter or number, alone or after a word such as Taler or Speaker.
SPEAKER_LABEL = r"^(?:\p{L}+[\s_.-]+([ab])|\p{L}*[\s_.-]*0*([12])|([ab]))[.:]?$"

#: Sound annotations between paired signs, inner time marks, markup.
NOISE = r"\{[^{}]*\}|\[[^\[\]]*\]|\(+[^()]*\)+|<[^<>]*>|\*+(?=[^\s*])[^*\n]*(?<=[^\s*])\*+|#(?=\S)[^#\n]*(?<=\S)#|♪[^♪\n]*♪|(?<!\S)\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?(?!\S)|\\[NnhH]"
#: What every annotation, mark or tag has.
NOISE_SIGN = r"[{\[(<*#♪\\]|\d:\d\d"
#: Tokens of nothing but hesitation or punctuation.
HESITATION = r"(?:[øæe]+h+m*|[uå]h+m+|[øæ]{2,}m*|h+m+|m+h+m*|m{2,}|a+h+m+|ö+h+m*)"
NO_WORD = rf"(?iu)(?<!\S)[^\p{{L}}\p{{N}}\s]*+(?:{HESITATION}[^\p{{L}}\p{{N}}\s]*+)?(?!\S)"


def _ms(clock: Column) -> Column:
    """Milliseconds of ``h:mm:ss.fff``, ``mm:ss`` or seconds; comma or point before fractions."""
    parts = F.transform(F.split(F.replace(F.trim(clock), F.lit(","), F.lit(".")), ":"), lambda x: x.try_cast("decimal(18,6)"))
    total = F.aggregate(parts, F.lit(0).cast("decimal(30,6)"), lambda a, x: (a * 60 + F.coalesce(x, F.lit(0))).cast("decimal(30,6)"))
    return F.when(clock != "", F.round(total * 1000).cast("long"))


def speaker_of(label: Column) -> Column:
    """'A', 'B', or null for any other or several voices."""
    bare = F.lower(F.trim(F.regexp_replace(label, C.BLANKS, " ")))
    hit = F.regexp_replace(bare, SPEAKER_LABEL, "$1$2$3")
    return F.when(hit.isin("a", "1"), "A").when(hit.isin("b", "2"), "B")


def spoken_words(text: Column) -> Column:
    """Array of the blank-separated tokens that hold a letter or digit and are not mere hesitation."""
    marked = F.when(text.rlike(NOISE_SIGN), F.regexp_replace(text, NOISE, " ")).otherwise(text)
    bare = F.regexp_replace(marked, C.BLANKS, " ")
    return F.filter(F.split(F.regexp_replace(bare, NO_WORD, ""), " "), lambda t: t != "")


def _fields(sign: str, pattern: str, groups: tuple[int, ...]) -> Column:
    """The groups of a pattern as an array, by one run of it; null where the line is of another format.

    ``sign`` stands in every line of the format and is looked for first.
    """
    parts = F.split(F.regexp_replace("line", pattern, CUT.join(f"${g}" if g else "" for g in groups)), CUT)
    return F.when(F.contains("line", F.lit(sign)), F.when(F.size(parts) == len(groups), parts))


#: Formats in order of precedence: start, end, label and words, each as the number of its group or 0.
FORMATS = {
    "cue": ("->", CUE, (1, 2, 0, 0)),
    "bracket": ("]", BRACKET, (1, 2, 3, 4)),
    "event": ("Dialogue:", EVENT, (1, 2, 3, 4)),
    "seconds": (" s", SECONDS, (1, 2, 3, 4)),
    "tabbed": ("\t", TABBED, (1, 2, 3, 4)),
    "round": ("(", ROUND, (2, 0, 1, 3)),
}


def transcript_lines(transcripts: DataFrame) -> DataFrame:
    """One row per line of speaker A or B, in any of the known formats, repeats and lines without words included.

    Columns: id_conversation, start_ms, end_ms, chunk_no, line_no, speaker,
    text (raw, wrapped parts joined), words.
    """
    raw = transcripts.select(C.conversation(F.col("id_conversation")).alias("id_conversation"), "chunk_no", F.translate(F.regexp_replace("text", "\\r\\n?", "\n"), CUT, " ").alias("text"))
    raw = raw.filter("id_conversation is not null and text is not null and text <> ''").withColumn("doc", F.xxhash64("text", F.length("text")))
    keys = ["id_conversation", "chunk_no", "doc"]
    once = raw.groupBy(*keys).agg(F.first("text").alias("text"))
    lines = once.select(*keys, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter("trim(line) <> ''")
    found = lines.select(*keys, "line_no", "line", *[_fields(*f).alias(f"f_{k}") for k, f in FORMATS.items()])
    kind = F.coalesce(*[F.when(F.col(f"f_{k}").isNotNull(), k) for k in FORMATS])
    found = found.select(*keys, "line_no", "line", kind.alias("kind"), F.coalesce(*[f"f_{k}" for k in FORMATS]).alias("f"))
    w = Window.partitionBy(*keys).orderBy("line_no")
    found = found.withColumns({"last_kind": F.lag("kind").over(w), "last_f": F.lag("f").over(w), "next_kind": F.lead("kind").over(w)})
    # a cue's number is no text; the line below a cue carries label and words under the cue's time
    found = found.filter(~(F.col("next_kind").eqNullSafe("cue") & F.col("line").rlike(r"^\s*\d+\s*$")))
    found = found.withColumn("kind", F.when(F.col("kind").isNull() & (F.col("last_kind") == "cue"), "cue_text").otherwise(F.col("kind"))).filter("kind is null or kind <> 'cue'")
    below = F.col("kind") == "cue_text"
    parts = F.split(F.regexp_replace("line", CUE_TEXT, f"$1$2{CUT}$3"), CUT)
    found = found.withColumn("cue", F.when(below, parts))
    timed = F.col("kind").isNotNull()
    label = F.when(below, F.when(F.size("cue") == 2, F.col("cue")[0]).otherwise("")).otherwise(F.col("f")[2])
    said = F.when(below, F.element_at("cue", -1)).when(timed, F.col("f")[3]).otherwise(F.col("line"))
    time = lambda i: F.when(F.col("kind") == "tabbed", F.col("f")[i].try_cast("long")).otherwise(_ms(F.when(below, F.col("last_f")[i]).otherwise(F.col("f")[i])))
    fields = found.select(*keys, "line_no", timed.alias("timed"), time(0).alias("start_ms"), time(1).alias("end_ms"), F.when(timed, F.coalesce(speaker_of(label), F.lit("?"))).alias("speaker"), said.alias("text"))
    # forward fill: an untimed line belongs to the timed line before it
    filled = fields.withColumns({c: F.last(F.when(F.col("timed"), F.col(v)), ignorenulls=True).over(w) for c, v in (("of_line", "line_no"), ("start_ms", "start_ms"), ("speaker", "speaker"))})
    # most lines stand alone; only wrapped ones are put together
    alone = filled.withColumn("more", F.coalesce(~F.lead("timed").over(w), F.lit(False)))
    alone = alone.filter("of_line is not null and start_ms is not null and speaker in ('A', 'B')")
    cols = [*keys, "of_line", "start_ms", "end_ms", "speaker", "text"]
    joined = alone.groupBy(*keys, "of_line").agg(
        F.max("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.max("speaker").alias("speaker"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.trim("text").alias("text")))), lambda x: x["text"]), " ").alias("text"),
    )
    whole = joined.select(*cols).withColumn("text", F.trim(F.regexp_replace("text", C.BLANKS, " ")))
    return whole.select("id_conversation", "start_ms", "end_ms", "chunk_no", F.col("of_line").alias("line_no"), "speaker", "text", spoken_words(F.col("text")).alias("words"))


def turn_pieces(lines: DataFrame, block_ms: int, item: dict[str, Column], total: dict[str, Column]) -> DataFrame:
    """The runs of one speaker's lines within blocks of ``block_ms`` of a conversation, numbered per block.

    A line given twice (same time, label and text) counts once, one without
    words not at all. ``item`` are
    columns of a line, ``total`` the aggregates of them per run. Repeats,
    order and runs all need the lines of one block only, so they share one
    shuffle, and a conversation of any length is never sorted by one task.
    """
    block = ["id_conversation", "block"]
    rows = lines.withColumn("block", F.floor(F.col("start_ms") / block_ms)).select(*block, "start_ms", "end_ms", "speaker", F.xxhash64("text", F.length("text")).alias("said"), "chunk_no", "line_no", F.size("words").alias("n"), *[c.alias(k) for k, c in item.items()])
    rows = rows.repartition(*block)
    w = Window.partitionBy(*block).orderBy("start_ms", F.coalesce("end_ms", "start_ms"), "end_ms", "chunk_no", "line_no", "speaker", "said")
    once = rows.groupBy(*block, "start_ms", "end_ms", "speaker", "said").agg(F.min_by(F.struct("chunk_no", "line_no", "n", *item), F.struct("chunk_no", "line_no")).alias("x"))
    # filtered only here: further down the words would be looked for twice
    once = once.select(*block, "start_ms", "end_ms", "speaker", "said", "x.*").filter("n > 0")
    once = once.withColumn("new", F.coalesce((F.lag("speaker").over(w) != F.col("speaker")).cast("int"), F.lit(1)))
    once = once.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return once.groupBy(*block, "island").agg(F.first("speaker").alias("speaker"), *[c.alias(k) for k, c in total.items()])


def number_turns(pieces: DataFrame) -> DataFrame:
    """Add turn_no to the runs of the blocks: a run goes on into the next block where the speaker stays.

    The blocks' own rows (first and last speaker, number of runs) are chained
    by a window.
    """
    per = pieces.groupBy("id_conversation", "block").agg(F.max("island").alias("n"), F.max_by("speaker", "island").alias("last"), F.min_by("speaker", "island").alias("first"))
    b = Window.partitionBy("id_conversation").orderBy("block")
    per = per.withColumn("joined", F.coalesce((F.lag("last").over(b) == F.col("first")).cast("int"), F.lit(0)))
    per = per.withColumn("shift", F.coalesce(F.sum(F.col("n") - F.col("joined")).over(b.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("joined"))
    out = pieces.join(per.select("id_conversation", "block", "shift"), ["id_conversation", "block"])
    return out.withColumn("turn_no", (F.col("island") + F.col("shift")).cast("int")).drop("shift")


def speaker_turns(transcripts: DataFrame, block_ms: int = 600_000) -> DataFrame:
    """Turns of each conversation: id_conversation, turn_no, speaker, n_words.

    Null or blank conversations and texts give nothing; text before the first
    timed line is header; an empty table gives an empty result; further
    columns are not read.
    """
    pieces = turn_pieces(transcript_lines(transcripts), block_ms, {}, {"n_words": F.sum("n")})
    turns = number_turns(materialise(pieces, "turns"))
    return turns.groupBy("id_conversation", "turn_no").agg(F.first("speaker").alias("speaker"), F.sum("n_words").cast("int").alias("n_words"))


def turn_texts(transcripts: DataFrame, block_ms: int = 600_000) -> DataFrame:
    """Turns with start, end and the spoken words: id_conversation, turn_no, speaker, start_ms, end_ms, n_lines, text."""
    end = F.coalesce("end_ms", "start_ms")
    said = F.struct("start_ms", end.alias("e"), "chunk_no", "line_no", "words")
    join = lambda c, f: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x[f]), " ")
    total = {"start": F.min("start_ms"), "end": F.max(end), "lines": F.count("*"), "text": join(said, "words")}
    pieces = turn_pieces(transcript_lines(transcripts), block_ms, {"words": F.array_join("words", " ")}, total)
    turns = number_turns(materialise(pieces, "turns"))
    return turns.groupBy("id_conversation", "turn_no").agg(
        F.first("speaker").alias("speaker"), F.min("start").alias("start_ms"), F.max("end").alias("end_ms"), F.sum("lines").cast("int").alias("n_lines"), join(F.struct("block", "island", "text"), "text").alias("text")
    )
