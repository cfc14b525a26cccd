"""Queries of the core operators over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import audio, demographics, metrics, numerals, text
from .operators import builds, collate, corpus, cube, filters, pipelines, speaker_splits
from .operators.pipelines import CleanSpec, Corpus
from .operators.utterances import file_periods, id_parts, recording_file
from .plans.registry import Registry
from .sources import readers, sinks
from .sources.tables import table
from .streaming import clean as streams

REGISTRY = Registry()
query = REGISTRY.query

# ---------------------------------------------------------------- intervals

_P3_SPANS = r"""
with u as (
  select regexp_replace(upper(regexp_replace(utterance_id, '\s+', '', 'g')), '[-_]+', '_', 'g') i,
         cast(round(start_time * 1000) as bigint) s, cast(round(end_time * 1000) as bigint) e
  from utterances
  where start_time is not null and end_time is not null and not isnan(start_time) and not isnan(end_time)),
v as (select split_part(i, '_', 2) || '_' || split_part(i, '_', 3) f, s, e from u where e > s),
w as (select *, max(e) over (partition by f order by s, e rows between unbounded preceding and 1 preceding) r from v),
x as (select *, sum(case when r is null or s > r then 1 else 0 end) over (partition by f order by s, e rows unbounded preceding) g from w),
p as (select f, min(s) s, max(e) e from x group by f, g),
q as (select f, e, lead(s) over (partition by f order by s) n from p)
"""

query("p3_found", _P3_SPANS + "select f as src_fname, 'period' as kind, s as start_ms, e as end_ms from p union all select f, 'gap', e, n from q where n is not null")(
    lambda s, d: file_periods(table(s, d, "utterances"))
)

# ---------------------------------------------------------------- text

_STRIP = r"regexp_replace({}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')"


def _sql_convert(expr: str) -> str:
    for old, new in text.CONVERSIONS.items():
        expr = f"replace({expr}, '{old}', '{new}')"
    return expr


def _sql_clean(expr: str, keep: str | None) -> str:
    filler = r"'(^|[^\p{L}\p{N}_])(?:eh+m*|øh+m*|h+m+|m+h+)($|[^\p{L}\p{N}_])'"
    e = f"lower({expr})"
    for _ in range(3):  # neighbours share a boundary
        e = rf"regexp_replace({e}, {filler}, '\1\2', 'g')"
    e = _STRIP.format(_sql_convert(e))
    if keep:
        e = rf"regexp_replace({e}, '[^{keep} |]', ' ', 'g')"
    e = rf"regexp_replace({e}, ' +', ' ', 'g')"
    lines = _STRIP.format("x")
    return rf"regexp_replace(array_to_string(list_transform(string_split({e}, chr(10)), lambda x: {lines}), chr(10)), '^\n+|\n+$', '', 'g')"


_KEEP = "abcdefghijklmnopqrstuvwxyzæøåéü0123456789.,?!:;'"

query("clean_native", f"select doc_id, {_sql_clean('text', _KEEP.replace(chr(39), chr(39) * 2))} as clean_text from documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", text.clean(F.col("text"), keep=_KEEP).alias("clean_text"))
)
query("stream_clean", f"select id_recording, {_sql_clean('text', _KEEP.replace(chr(39), chr(39) * 2))} as clean_text from samples where length({_STRIP.format('text')}) > 0 and validated is distinct from 'rejected'")(
    lambda s, d: streams.run_available(streams.clean_stream(streams.stream_table(s, d, "samples"), kept=_KEEP).select("id_recording", "clean_text"))
)
query("stream_counts", "with m as (select max(ts) - interval 1 day t from events) select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events, m group by 1, 2, m.t having time_bucket(interval 1 hour, ts) + interval 1 hour <= m.t")(
    lambda s, d: streams.run_available(streams.windowed_counts(streams.stream_table(s, d, "events"), "ts", "1 hour", "1 day", "event_type")).withColumn("start", F.col("start").cast("timestamp_ntz"))
)
query("clean_nfkc")(lambda s, d: table(s, d, "documents").select("doc_id", text.clean(F.col("text"), keep=_KEEP, nfkc=True).alias("clean_text")))


_WORDS = """
u as (select ['nul','en','to','tre','fire','fem','seks','syv','otte','ni','ti','elleve','tolv','tretten','fjorten','femten','seksten','sytten','atten','nitten'] a,
  ['','','tyve','tredive','fyrre','halvtreds','tres','halvfjerds','firs','halvfems'] t),
h as (select n, case when n < 20 then a[n + 1] when n % 10 = 0 then t[n // 10 + 1] else a[n % 10 + 1] || 'og' || t[n // 10 + 1] end w from u, range(100) r(n)),
k as (select n.n, case when n.n < 100 then h.w else (case when n.n // 100 = 1 then 'et' else a[n.n // 100 + 1] end) || ' hundrede' || (case when n.n % 100 = 0 then '' else ' og ' || h.w end) end w
  from range(1000) n(n) join h on h.n = n.n % 100, u)
"""
_SPELL = """
z as (select v, v // 1000000 m, (v // 1000) % 1000 k, v % 1000 u, v % 1000000 low from values_),
j as (select z.*, km.w wm, kk.w wk, ku.w wu from z join k km on km.n = z.m join k kk on kk.n = z.k join k ku on ku.n = z.u),
l as (select *, case when k > 0 then (case when k = 1 then 'et' else wk end) || ' tusind' || (case when u = 0 then '' when u < 100 then ' og ' || wu else ' ' || wu end) else wu end lw from j),
spelt as (select v, case when v = 100 then 'hundrede' when v = 1000 then 'tusind' when v < 1000000 then lw
  else wm || (case when m = 1 then ' million' else ' millioner' end) || (case when low = 0 then '' when low < 100 then ' og ' || lw else ' ' || lw end) end w from l)
"""
_NUMBERS = f"with {_WORDS}, values_ as (select distinct o_orderkey v from orders), {_SPELL} select v as o_orderkey, w as spoken from spelt"


def _sql_verbalised(source: str) -> str:
    """CTEs that turn the rows (id, t) of ``source`` into ``verbal`` (id, t), every numeral in words."""
    pattern = r"\b(0|[1-9]\d{0,2}(?:(?:\.\d{3})*|\d*)(?:,\d+)?)\b"
    return rf"""{_WORDS},
    found as (select id, t, regexp_extract_all(t, '{pattern}') n, string_split_regex(t, '{pattern}') g from {source}),
    forms as (select n, replace(split_part(n, ',', 1), '.', '') whole, split_part(n, ',', 2) dec from (select distinct unnest(n) n from found)),
    values_ as (select distinct cast(whole as bigint) v from forms where length(whole) <= 9), {_SPELL},
    said as (select n, coalesce(spelt.w, whole) || case when dec = '' then '' else ' komma ' || array_to_string(list_transform(string_split(dec, ''), lambda d: case when d = '1' then 'et' else a[cast(d as int) + 1] end), ' ') end w
      from forms left join spelt on length(whole) <= 9 and spelt.v = try_cast(whole as bigint), u),
    spread as (select id, unnest(g) g, unnest(range(len(g))) i, unnest(list_resize(n, len(g))) n from found),
    verbal as (select s.id, string_agg(s.g || coalesce(said.w, ''), '' order by s.i) t from spread s left join said using (n) group by 1)"""


_NUMERALS = f"with src as (select doc_id id, text t from documents where text is not null), {_sql_verbalised('src')} select doc_id, verbal.t as spoken from documents left join verbal on doc_id = id"


@query("numerals_in_text", _NUMERALS)
def _numerals_in_text(s, d):
    t = numerals.with_words(table(s, d, "documents").select("doc_id", "text"))
    return t.select("doc_id", numerals.verbalise(F.col("text"), F.col("number_words")).alias("spoken"))


@query("numerals_to_words", _NUMBERS)
def _numerals(s, d):
    t = numerals.with_words(table(s, d, "orders").select("o_orderkey").distinct())
    return t.select("o_orderkey", numerals.spoken(F.col("o_orderkey").cast("string"), F.col("number_words")).alias("spoken"))


query("strip_unk", f"select utterance_id, case when not isnan(start_time) then start_time end as start_time, {_STRIP.format("replace(transcript, '<UNK>', '')")} as text from utterances")(
    lambda s, d: table(s, d, "utterances").select("utterance_id", F.nanvl("start_time", F.lit(None)).alias("start_time"), text.strip_unknown(F.col("transcript")).alias("text"))
)
query("fix_text", f"select id_recording, case when text not in ('', '{text.SILENCE}') then text end as text from samples")(
    lambda s, d: table(s, d, "samples").select("id_recording", text.blank_to_null(F.col("text")).alias("text"))
)
query("original_filename", "select utterance_id, case when not isnan(end_time) then end_time end as end_time, replace(list_extract(string_split(list_extract(string_split(lower(utterance_id || '.wav'), '-'), -1), '_'), -1), '.wav', '') as original from utterances")(
    lambda s, d: table(s, d, "utterances").select("utterance_id", F.nanvl("end_time", F.lit(None)).alias("end_time"), text.original_filename(F.concat("utterance_id", F.lit(".wav"))).alias("original"))
)
query("extract_links", "select id_recording, list_extract(regexp_extract_all('<p><a href=\"' || source_url || '\">lyd</a></p>', '<a href=\"(.+?)\">', 1), 1) as link from samples")(
    lambda s, d: table(s, d, "samples").select("id_recording", F.get(text.links(F.concat(F.lit('<p><a href="'), "source_url", F.lit('">lyd</a></p>'))), 0).alias("link"))
)
query("display_names", "select distinct source, lower(replace(replace(source, 'oe', 'ø'), 'ae', 'æ')) as display from documents")(
    lambda s, d: table(s, d, "documents").select("source", F.lower(F.replace(F.replace("source", F.lit("oe"), F.lit("ø")), F.lit("ae"), F.lit("æ"))).alias("display")).distinct()
)
query("filename_mangling", "select distinct source_url, replace(replace(replace(source_url, '/', '--'), '::', '-'), '.', '-') as mangled from samples")(
    lambda s, d: table(s, d, "samples").select("source_url", text.mangle(F.col("source_url")).alias("mangled")).distinct()
)


@query(
    "dataset_names",
    r"""with n as (select distinct event_type || ':' || (user_id % 7)::varchar || '@' || (user_id % 3)::varchar n from events), m as (select n, regexp_replace(n, ':', '::') k from n)
    select n as name, split_part(k, '::', 1) as id, split_part(split_part(k, '::', 2), '@', 1) as subset, split_part(k, '@', 2) as revision from m""",
)
def _dataset_names(s, d):
    n = table(s, d, "events").select(F.concat("event_type", F.lit(":"), (F.col("user_id") % 7).cast("string"), F.lit("@"), (F.col("user_id") % 3).cast("string")).alias("name")).distinct()
    return n.select("name", *[c.alias(k) for k, c in text.dataset_name_columns(F.col("name")).items()])


query("corpus_key", "select md5(string_agg(source, ',' order by source)) as key from (select distinct source from mix_targets)")(
    lambda s, d: table(s, d, "mix_targets").agg(F.md5(F.array_join(F.array_sort(F.collect_set("source")), ",")).alias("key"))
)

# ---------------------------------------------------------------- scalar functions

query("safe_int", "select id_recording, try_cast(regexp_replace(noise_type, '^v', '1') as int) as level, try_cast(cast(age as varchar) as int) as age from samples")(
    lambda s, d: table(s, d, "samples").select("id_recording", demographics.safe_int(F.regexp_replace("noise_type", "^v", "1")).alias("level"), demographics.safe_int(F.col("age").cast("string")).alias("age"))
)
query(
    "timestamp_parse",
    """select event_id, strftime(strptime(strftime(ts, '%d %b %YT%H:%M:%S'), '%d %b %YT%H:%M:%S'), '%Y-%m-%dT%H:%M:%S') as iso, strftime(ts, '%H%M') as hhmm from events""",
)(
    lambda s, d: table(s, d, "events").select("event_id", F.to_timestamp(F.date_format("ts", "dd MMM yyyy'T'HH:mm:ss"), "dd MMM yyyy'T'HH:mm:ss").alias("t"))
    .select("event_id", F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format("t", "HHmm").alias("hhmm"))
)
query(
    "age_groups",
    """select age, case when age >= 0 and age < 25 then '0-24' when age >= 25 and age < 50 then '25-49' when age >= 50 then '50-' end as split_group,
    case when age >= 0 and age < 25 then '0-25' when age >= 25 and age < 50 then '25-50' when age >= 50 then '50+' end as score_group, count(*) as n from samples group by 1, 2, 3""",
)(
    lambda s, d: table(s, d, "samples").select("age", demographics.age_group(F.col("age")).alias("split_group"), demographics.evaluation_age_group(F.col("age")).alias("score_group")).groupBy("age", "split_group", "score_group").agg(F.count("*").alias("n"))
)
query(
    "dialect_lookup",
    """select case when coalesce(country_birth, 'DK') <> 'DK' then 'Non-native' else m.dialect end as dialect, count(*) as n
    from samples s left join dialect_map m on s.dialect = m.sub_dialect group by 1""",
)(lambda s, d: demographics.main_dialect(table(s, d, "samples"), table(s, d, "dialect_map")).groupBy("dialect").agg(F.count("*").alias("n")))

# ---------------------------------------------------------------- filters

query("filter_null_safe", "select id_recording from samples where validated is distinct from 'rejected' and validated is distinct from 'maybe' and gender is distinct from 'nonbinary'")(
    lambda s, d: table(s, d, "samples").filter(filters.none_of(F.col("validated"), "rejected", "maybe") & filters.none_of(F.col("gender"), "nonbinary")).select("id_recording")
)
query("filter_samples", f"select id_recording from samples where length({_STRIP.format('text')}) > 0 and validated is distinct from 'rejected'")(
    lambda s, d: filters.filter_samples(table(s, d, "samples"), "text").select("id_recording")
)
query("filter_duration", "select vec_id from embeddings where len(list_filter(embedding, lambda x: x > 0)) > 16 * 1.75 and len(list_filter(embedding, lambda x: x > 0)) < 16 * 2.25")(
    lambda s, d: table(s, d, "embeddings").withColumn("a", F.filter("embedding", lambda x: x > 0)).filter(filters.within_duration(F.col("a"), 16, 1.75, 2.25)).select("vec_id")
)
query("filter_max_cer", "select id_recording, asr_cer from samples where asr_cer < 0.6")(lambda s, d: filters.below_error(table(s, d, "samples")).select("id_recording", "asr_cer"))
query("filter_usable_segments", rf"select id_conversation, chunk_no from raw_transcripts where length({_STRIP.format('text')}) > 0 and not regexp_matches(text, '\*\*\*(.*?)\*\*\*') and not regexp_matches(text, '\[(.*?)\]')")(
    lambda s, d: table(s, d, "raw_transcripts").filter(filters.usable_segment(F.col("text"))).select("id_conversation", "chunk_no")
)
query("drop_nulls", "select id_recording from samples where asr_cer is not null and asr_prediction is not null and gender is not null and dialect is not null")(
    lambda s, d: table(s, d, "samples").na.drop(subset=["asr_cer", "asr_prediction", "gender", "dialect"]).select("id_recording")
)
query("removed_rows", f"select count(*) as n_before, count(*) filter (where length({_STRIP.format('text')}) > 0 and validated is distinct from 'rejected') as n_after from samples")(
    lambda s, d: table(s, d, "samples").agg(F.count("*").alias("n_before"), F.count_if(filters.has_text(F.col("text")) & filters.none_of(F.col("validated"), "rejected")).alias("n_after"))
)
query("filter_files", "select utterance_id, end_time from utterances where end_time * 1000 >= 8192 and not isnan(end_time) and not utterance_id like 'S0001%' and not utterance_id like 's0001%'")(
    lambda s, d: filters.large_enough(table(s, d, "utterances").filter(~F.isnan("end_time")).withColumn("size", F.col("end_time") * 1000), "size", "utterance_id", ("S0001", "s0001")).select("utterance_id", "end_time")
)
query(
    "banned_speakers",
    "select distinct id_speaker from speakers where id_speaker is not null and id_speaker not in (select distinct speaker_id from samples where asr_wer > 0.5 and speaker_id is not null)",
)(
    lambda s, d: table(s, d, "speakers").filter("id_speaker is not null").select("id_speaker").distinct()
    .join(table(s, d, "samples").filter("asr_wer > 0.5").select(F.col("speaker_id").alias("id_speaker")), "id_speaker", "left_anti")
)

# ---------------------------------------------------------------- joins and sets


@query(
    "join_recordings",
    """select r.id_recording, r.text, p.occupation from samples r
    join (select id_speaker, min(occupation) occupation from speakers group by 1) p on r.speaker_id = p.id_speaker join (select distinct id_sentence from samples where validated = 'accepted') s using (id_sentence)""",
)
def _join_recordings(s, d):
    r = table(s, d, "samples")
    sentences = r.filter("validated = 'accepted'").select("id_sentence").distinct()
    speakers = table(s, d, "speakers").groupBy("id_speaker").agg(F.min("occupation").alias("occupation"))
    return builds.read_aloud(r, sentences, speakers, "id_sentence", "id_speaker", "speaker_id").select("id_recording", "text", "occupation")


query("table_counts", "select (select count(*) from samples) as n_samples, (select count(*) from speakers) as n_speakers, (select count(*) from conversation_meta) as n_conversations")(
    lambda s, d: table(s, d, "samples").agg(F.count("*").alias("n_samples")).crossJoin(table(s, d, "speakers").agg(F.count("*").alias("n_speakers"))).crossJoin(table(s, d, "conversation_meta").agg(F.count("*").alias("n_conversations")))
)


@query("semi_union", "select distinct id_speaker from speakers where id_speaker in (select id_speaker_a from conversation_meta union select id_speaker_b from conversation_meta union select id_recorder from conversation_meta)")
def _semi_union(s, d):
    c = table(s, d, "conversation_meta")
    ids = c.select(F.explode(F.array("id_speaker_a", "id_speaker_b", "id_recorder")).alias("id_speaker")).distinct()
    return table(s, d, "speakers").select("id_speaker").distinct().join(ids, "id_speaker", "left_semi")


query(
    "exists_or",
    "select distinct id_conversation from conversation_meta where id_speaker_a in (select id_speaker from speakers) or id_speaker_b in (select id_speaker from speakers) or id_recorder in (select id_speaker from speakers)",
)(lambda s, d: builds.known_conversations(table(s, d, "conversation_meta").filter("id_conversation is not null"), table(s, d, "speakers"), ["id_speaker_a", "id_speaker_b", "id_recorder"], "id_speaker").select("id_conversation").distinct())


def _stems(s, d):
    u = table(s, d, "utterances").select("utterance_id", "split").dropDuplicates(["utterance_id"])
    return u.filter("utterance_id is not null").select("utterance_id", F.concat(F.lit("/lyd/"), F.lower("split"), F.lit("/"), "utterance_id", F.lit(".wav")).alias("path"))


_STEMS = "with u as (select distinct utterance_id from utterances where utterance_id is not null), e as (select distinct utterance_id from utterances where transcript is not null and transcript <> '') "
query("match_files", _STEMS + "select utterance_id, regexp_extract('/lyd/' || utterance_id || '.wav', '([^/]*)\\.wav$', 1) as stem from e join u using (utterance_id)")(
    lambda s, d: table(s, d, "utterances").filter("transcript is not null and transcript <> ''").select("utterance_id").distinct()
    .join(readers.last_listed(_stems(s, d).withColumn("stem", readers.stem(F.col("path"))).drop("utterance_id")), F.col("utterance_id") == F.col("stem")).select("utterance_id", "stem")
)
query("missing_files", _STEMS + "select utterance_id from u where utterance_id not in (select utterance_id from e)")(
    lambda s, d: _stems(s, d).select("utterance_id").join(table(s, d, "utterances").filter("transcript is not null and transcript <> ''").select("utterance_id"), "utterance_id", "left_anti")
)


@query(
    "key_join_tiebreak",
    """with f as (select distinct strftime(ts, '%H%M') k, event_type || '_' || event_id file from events), r as (select id_recording, strftime(recorded_at, '%H%M') k from samples),
    g as (select k, arg_min(file, md5(file || '4242')) file, count(*) n from f group by 1) select r.id_recording, g.file, g.n as n_files from r left join g using (k)""",
)
def _key_join(s, d):
    f = table(s, d, "events").select(F.date_format("ts", "HHmm").alias("key"), F.concat_ws("_", "event_type", F.col("event_id").cast("string")).alias("file")).distinct()
    r = table(s, d, "samples").select("id_recording", F.date_format("recorded_at", "HHmm").alias("hhmm"))
    return builds.match_by_name(r, "hhmm", f, "file").select("id_recording", "file", "n_files")


query("files_without_rows", _STEMS + "select '/lyd/' || utterance_id || '.wav' as path from u where utterance_id not in (select utterance_id from e where utterance_id is not null)")(
    lambda s, d: _stems(s, d).select(F.concat(F.lit("/lyd/"), "utterance_id", F.lit(".wav")).alias("path"), "utterance_id")
    .join(table(s, d, "utterances").filter("transcript is not null and transcript <> ''").select("utterance_id"), "utterance_id", "left_anti").select("path")
)
_SQL_SCAN = "select t.location, count(distinct t.id_conversation) as n from conversation_meta t where t.id_speaker_a in (select id_speaker from speakers) group by t.location"
query("sql_scan", _SQL_SCAN)(lambda s, d: readers.read_sql(s, d, _SQL_SCAN))
query(
    "file_paths",
    r"""with p as (select distinct '/arkiv/' || coalesce(split, 'x') || '_da/lyd/' || replace(replace(utterance_id, ' ', ''), '.', '') || '.tar.gz' path from utterances where utterance_id is not null)
    select path, nullif(lower(regexp_extract(path, '(?i)/(train|val|test)[^/]*/(?:.*/)?[^/]*$', 1)), '') as split, regexp_extract(path, '([^/.]+)[^/]*$', 1) as stem, '.tar.gz' as suffix from p""",
)(
    lambda s, d: table(s, d, "utterances").filter("utterance_id is not null").select(F.concat(F.lit("/arkiv/"), F.coalesce("split", F.lit("x")), F.lit("_da/lyd/"), F.translate("utterance_id", " .", ""), F.lit(".tar.gz")).alias("path")).distinct()
    .select("path", *[c.alias(k) for k, c in readers.path_parts(F.col("path")).items()])
)
query("validation_split_names", "select distinct 'val_' || lower(replace(event_type, '-', '_')) || '_del_' || (user_id % 5) as name from events")(
    lambda s, d: table(s, d, "events").select(pipelines.validation_split_name(F.concat(F.lit("hus/"), "event_type"), F.concat(F.lit("Del-"), (F.col("user_id") % 5).cast("string"))).alias("name")).distinct()
)


@query("set_operations", "select 'union' as op, count(*) as n from (select id_speaker from speakers union select speaker_id from samples) union all select 'intersect', count(*) from (select id_speaker from speakers intersect select speaker_id from samples) union all select 'except', count(*) from (select id_speaker from speakers except select speaker_id from samples)")
def _set_operations(s, d):
    a, b = table(s, d, "speakers").select(F.col("id_speaker").alias("x")), table(s, d, "samples").select(F.col("speaker_id").alias("x"))
    n = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return n(a.union(b).distinct(), "union").union(n(a.intersect(b), "intersect")).union(n(a.subtract(b), "except"))


@query(
    "split_by_speaker",
    """with v as (select distinct speaker_id, case when split like 'test%' then 'test' when split like 'val%' then 'val' end k from samples where speaker_id is not null),
    t as (select distinct speaker_id from v where k = 'test'), w as (select distinct speaker_id from v where k = 'val' and speaker_id not in (select * from t))
    select case when speaker_id in (select * from t) then 'test' when speaker_id in (select * from w) then 'val' else 'train' end as split, count(*) as n_rows, count(distinct speaker_id) as n_speakers from samples group by 1""",
)
def _split_by_speaker(s, d):
    r = table(s, d, "samples")
    t = r.filter("split like 'test%' and speaker_id is not null").select("speaker_id").distinct()
    v = r.filter("split like 'val%' and speaker_id is not null").select("speaker_id").distinct().join(t, "speaker_id", "left_anti")
    return speaker_splits.split_by_speaker(r.drop("split"), "speaker_id", t, v).groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("speaker_id").alias("n_speakers"))


# ---------------------------------------------------------------- builds

_EVENTS = r"""
with l as (select id_conversation, chunk_no, unnest(string_split(replace(text, chr(13), ''), chr(10))) line from raw_transcripts),
e as (select id_conversation, chunk_no, regexp_extract(line, '^Dialogue:[^,]*,([^,]*),([^,]*),[^,]*,([^,]*),[^,]*,[^,]*,[^,]*,[^,]*,(.*)$', ['a', 'b', 'name', 'text']) x from l where line like 'Dialogue:%'),
f as (select id_conversation, chunk_no, ((split_part(x.a, ':', 1)::int * 60 + split_part(x.a, ':', 2)::int) * 60 + split_part(split_part(x.a, ':', 3), '.', 1)::int) * 1000 + split_part(x.a, '.', 2)::int * 10 as start_ms,
  ((split_part(x.b, ':', 1)::int * 60 + split_part(x.b, ':', 2)::int) * 60 + split_part(split_part(x.b, ':', 3), '.', 1)::int) * 1000 + split_part(x.b, '.', 2)::int * 10 as end_ms, x.name as name, x.text as text from e)
"""


def _events(s, d):
    return readers.subtitle_events(table(s, d, "raw_transcripts"), "text", "id_conversation", "chunk_no")


query("subtitle_events", _EVENTS + "select * from f")(lambda s, d: _events(s, d).drop("event_no"))
query(
    "conversation_build",
    _EVENTS
    + rf"""
, c as (select id_conversation, min(id_speaker_a) a, min(id_speaker_b) b, min(location) location from conversation_meta group by 1), p as (select id_speaker, min(dialect) dialect from speakers group by 1),
g as (select f.*, c.location, case when upper({_STRIP.format("name")}) = 'A' then a else b end id_speaker from f join c using (id_conversation) where upper({_STRIP.format("name")}) in ('A', 'B')
  and length({_STRIP.format("text")}) > 0 and not regexp_matches(text, '\*\*\*(.*?)\*\*\*') and not regexp_matches(text, '\[(.*?)\]'))
select id_conversation, location, id_speaker, dialect, start_ms, end_ms, {_STRIP.format("text")} as text from g join p using (id_speaker)""",
)(
    lambda s, d: builds.conversation_segments(
        _events(s, d),
        table(s, d, "conversation_meta").groupBy("id_conversation").agg(*[F.min(c).alias(c) for c in ("id_speaker_a", "id_speaker_b", "location", "location_roomdim", "noise_type", "noise_level")]),
        table(s, d, "speakers").groupBy("id_speaker").agg(*[F.min(c).alias(c) for c in ("age", "gender", "dialect", "country_birth", "education", "occupation")]),
    ).select("id_conversation", "location", "id_speaker", "dialect", "start_ms", "end_ms", "text")
)
query(
    "parliament_build",
    rf"""with u as (select *, regexp_replace(regexp_replace(utterance_id, '\s+', '', 'g'), '[-_]+', '_', 'g') i from utterances
      qualify row_number() over (partition by utterance_id order by transcript nulls first, start_time nulls first, end_time nulls first, split nulls first) = 1)
    select utterance_id, upper(split_part(i, '_', 1)) as speaker_id, upper(split_part(i, '_', 2) || '_' || split_part(i, '_', 3)) as src_fname, {_STRIP.format("replace(transcript, '<UNK>', '')")} as text,
    case when not isnan(start_time) then cast(round(start_time * 1000) as bigint) end as start_ms, case when not isnan(end_time) then cast(round(end_time * 1000) as bigint) end as end_ms, 'processed_audio/' || utterance_id || '.wav' as audio_path, split from u""",
)(lambda s, d: builds.parliament(table(s, d, "utterances")))


@query(
    "read_aloud_build",
    """with p as (select id_speaker, min(occupation) occupation from speakers group by 1), s as (select distinct id_sentence from samples where validated = 'accepted'),
    f as (select id_recording stem, max('/lyd/' || coalesce(split, 'x') || '/' || id_recording || '.wav') path from samples where noise_type is not null group by 1)
    select r.id_recording, r.text, p.occupation, f.path as audio_path from samples r join s using (id_sentence) join p on r.speaker_id = p.id_speaker join f on f.stem = r.id_recording""",
)
def _read_aloud(s, d):
    r = table(s, d, "samples")
    speakers = table(s, d, "speakers").groupBy("id_speaker").agg(F.min("occupation").alias("occupation"))
    files = r.filter("noise_type is not null").select(F.col("id_recording").alias("stem"), F.concat(F.lit("/lyd/"), F.coalesce("split", F.lit("x")), F.lit("/"), "id_recording", F.lit(".wav")).alias("path"))
    sentences = r.filter("validated = 'accepted'").select("id_sentence").distinct()
    return builds.read_aloud(r, sentences, speakers, "id_sentence", "id_speaker", "speaker_id", files, "id_recording").select("id_recording", "text", "occupation", "audio_path")


@query(
    "dictation_build",
    f"""with r as (select id_recording id, case when text not in ('', '{text.SILENCE}') then text end t, age, recorded_at x, gender, length(source_url) % 20 n from samples),
    f as (select distinct '/lyd/' || event_type || '/' || strftime(ts, '%H%M') || '-' || (user_id % 20) || '.wav' path, strftime(ts, '%H%M') || '_' || (user_id % 20) k from events),
    g as (select k, arg_min(path, md5(path || '4242')) path, count(*) n from f group by 1)
    select id, t as text, age, gender as sex, strftime(x, '%Y-%m-%dT%H:%M:%S') as recording_time, g.path as audio_path, g.n as n_files from r join g on g.k = strftime(x, '%H%M') || '_' || r.n where t is not null and age is not null and gender is not null""",
)
def _dictation(s, d):
    rows = table(s, d, "samples").withColumns({"time": F.date_format("recorded_at", "dd MMM yyyy'T'HH:mm:ss"), "file": F.concat(F.lit("Opt-A_"), (F.length("source_url") % 20).cast("string"), F.lit(".WAV"))})
    files = table(s, d, "events").select(F.concat(F.lit("/lyd/"), "event_type", F.lit("/"), F.date_format("ts", "HHmm"), F.lit("-"), (F.col("user_id") % 20).cast("string"), F.lit(".wav")).alias("path")).distinct()
    names = {"id_recording": "id", "text": "text", "age": "age", "gender": "sex", "time": "recorded_at", "file": "file_name"}
    return builds.dictation(rows, names, files).drop("file_name")


@query(
    "voice_lines",
    """with l as (select row_number() over (order by item_id) n, text from eval_items), f as (select distinct case when user_id % 3 = 0 then 'mic' else 'spk' end speaker_id, user_id::int id, user_id::int raw from events),
    g as (select speaker_id, raw, case when speaker_id = 'mic' and id >= 100 then id - 7 else id end id from f), h as (select speaker_id, raw, case when speaker_id = 'mic' and id >= 150 then id + 1 else id end id from g)
    select speaker_id || '_' || raw as stem, speaker_id, h.id as transcription_id, l.text, row_number() over (order by speaker_id, raw::varchar) as place from h join l on l.n = h.id where h.id >= 0""",
)
def _voice_lines(s, d):
    lines = table(s, d, "eval_items").select(F.row_number().over(Window.orderBy("item_id")).alias("line_no"), F.col("text").alias("line"))  # a fixed table of 300
    files = table(s, d, "events").select(F.concat(F.when(F.col("user_id") % 3 == 0, "mic").otherwise("spk"), F.lit("_"), F.col("user_id").cast("string")).alias("stem")).distinct()
    return builds.spoken_lines(files, lines, moved=((100, -7), (150, 1)))


query("utterance_ids", r"select split, count(distinct upper(regexp_replace(regexp_replace(utterance_id, '\s+', '', 'g'), '[-_]+', '_', 'g'))) as n_ids, count(*) as n from utterances group by 1")(
    lambda s, d: table(s, d, "utterances").select("split", F.array_join(id_parts(F.col("utterance_id")), "_").alias("i")).groupBy("split").agg(F.countDistinct("i").alias("n_ids"), F.count("*").alias("n"))
)

# ---------------------------------------------------------------- error rates and scores

# one ASCII character for each other letter that occurs: the SQL engine's edit distance counts bytes
_PLAIN = r"translate({}, 'æøåéüöäñ–«»’', '{{}}~^`\\|@#$%&')"

query(
    "cer_raw",
    f"""with p as (select source, {_PLAIN.format('lower(coalesce(text, sentence))')} r, {_PLAIN.format('lower(asr_prediction)')} h from samples where asr_prediction is not null and coalesce(text, sentence) is not null)
    select source, count(*) as n, round(sum(levenshtein(r, h)) / sum(length(r)), 9) as cer from p group by 1""",
)(
    lambda s, d: table(s, d, "samples").select("source", F.lower(F.coalesce("text", "sentence")).alias("r"), F.lower("asr_prediction").alias("h")).filter("r is not null and h is not null")
    .groupBy("source").agg(F.count("*").alias("n"), F.round(metrics.raw_character_rate(F.col("r"), F.col("h")), 9).alias("cer"))
)

_ERR = 1 << 31


def _sql_aligned(source: str, keys: str) -> str:
    """CTEs: the rows (keys, r, h) of ``source`` as ``aligned``, with errors, insertions and reference length of characters (c) and words (w).

    A row of the distance table per step of a recursion, for all distinct pairs at once.
    """
    step = f"[least(x[j + 1] + {_ERR}, x[j] + case when a[i + 1] = b[j] then 0 else {_ERR} end)]"
    row = f"list_reduce(list_prepend([x[1] + {_ERR}], list_transform(range(1, len(b) + 1), lambda j: {step})), lambda c, y: list_append(c, least(y[1], c[len(c)] + {_ERR + 1})))"
    return rf"""pair as (select r, h, row_number() over () p from (select distinct r, h from {source})),
    unit as (select 2 * p q, case when r = '' then [] else string_split(r, '') end a, case when h = '' then [] else string_split(h, '') end b from pair
      union all select 2 * p + 1, list_filter(regexp_split_to_array(r, '[\s\x{{a0}}]+'), lambda x: x <> ''), list_filter(regexp_split_to_array(h, '[\s\x{{a0}}]+'), lambda x: x <> '') from pair),
    dp(q, i, x) as (select q, 0, list_transform(range(0, len(b) + 1), lambda j: j * {_ERR + 1}) from unit
      union all select dp.q, i + 1, {row} from dp join unit using (q) where i < len(a)),
    cost as (select q, x[len(x)] // {_ERR} e, x[len(x)] % {_ERR} ins, len(a) n from dp join unit using (q) where i = len(a)),
    aligned as (select {keys}, c.e ce, c.ins ci, c.n cn, w.e we, w.ins wi, w.n wn from {source} join pair using (r, h) join cost c on c.q = 2 * p join cost w on w.q = 2 * p + 1)"""


_LOWER_STRIP = "lower(" + _STRIP + ")"


@query(
    "error_rates",
    f"""with recursive src as (select source, {_LOWER_STRIP.format('coalesce(text, sentence)')} r, {_LOWER_STRIP.format('asr_prediction')} h from samples where asr_prediction is not null and coalesce(text, sentence) is not null),
    {_sql_aligned('src', 'source')}
    select source, count(*) as n, round(sum(ce) / nullif(sum(cn + ci), 0), 9) as cer, round(sum(we) / nullif(sum(wn + wi), 0), 9) as wer, round(sum(we) / nullif(sum(wn), 0), 9) as wer_raw from aligned group by 1""",
)
def _error_rates(s, d):
    r = table(s, d, "samples").select("source", F.lower(text.strip(F.coalesce("text", "sentence"))).alias("r"), F.lower(text.strip(F.col("asr_prediction"))).alias("h")).filter("r is not null and h is not null")
    r = r.select("source", metrics.char_counts("r", "h").alias("c"), metrics.word_counts("r", "h").alias("w"))
    rates = {"cer": metrics.error_rate("c"), "wer": metrics.error_rate("w"), "wer_raw": metrics.error_rate("w", normalise=False)}
    return r.groupBy("source").agg(F.count("*").alias("n"), *[F.round(v, 9).alias(k) for k, v in rates.items()])


_SPEC = CleanSpec(keep=_KEEP)
_KEEP_SQL = _KEEP.replace(chr(39), chr(39) * 2)


def _sql_scored(where: str = "true") -> str:
    """CTEs up to ``aligned``: id_recording, categories, source, role and counts of the cleaned texts of samples."""
    return rf"""
m as (select sub_dialect, min(dialect) d from dialect_map group by 1),
base as (select row_number() over () k, samples.*, case when age >= 0 and age < 25 then '0-25' when age >= 25 and age < 50 then '25-50' when age >= 50 then '50+' end age_group,
  case when coalesce(country_birth, 'DK') <> 'DK' then 'Non-native' else m.d end main from samples left join m on samples.dialect = m.sub_dialect where {where}),
raw as (select 2 * k id, text t from base where text is not null and asr_prediction is not null union all select 2 * k + 1, asr_prediction from base where text is not null and asr_prediction is not null),
{_sql_verbalised('raw')},
clean as (select id, {_sql_clean('t', _KEEP_SQL)} t from verbal),
src as (select base.*, coalesce(r.t, '') r, coalesce(h.t, '') h from base join clean r on r.id = 2 * k join clean h on h.id = 2 * k + 1),
{_sql_aligned('src', "src.id_recording, src.age_group, src.gender, src.main dialect, src.source, src.split, r, h")}"""


_CATEGORIES = list(pipelines.CATEGORIES)
_CUBE_CELLS = """
c as (select age_group a, gender g, dialect d, grouping_id(age_group, gender, dialect) i, count(*) n, sum(ce) ce, sum(cn + ci) ct, sum(we) we, sum(wn + wi) wt from aligned group by cube (age_group, gender, dialect)),
k2 as (select * from c where (i & 4 > 0 or a is not null) and (i & 2 > 0 or g is not null) and (i & 1 > 0 or d is not null)),
j2 as (select k2.*, p0.n n0, p1.n n1, p2.n n2 from k2 join k2 p0 on p0.i = 7
  join k2 p1 on p1.i = (k2.i | 3) and p1.a is not distinct from k2.a
  join k2 p2 on p2.i = (k2.i | 1) and p2.a is not distinct from k2.a and p2.g is not distinct from k2.g)
"""

query(
    "score_cube",
    f"with recursive {_sql_scored()}, {_CUBE_CELLS} select a as age_group, g as gender, d as dialect, n as n_rows, round(ce / nullif(ct, 0), 9) as cer, round(we / nullif(wt, 0), 9) as wer from j2 where (i & 4 > 0 or n1 < n0) and (i & 2 > 0 or n2 < n1) and (i & 1 > 0 or n < n2)",
)(
    lambda s, d: pipelines.evaluate(table(s, d, "samples"), table(s, d, "dialect_map"), _SPEC)
    .select(*_CATEGORIES, "n_rows", F.round("cer", 9).alias("cer"), F.round("wer", 9).alias("wer"))
)
query(
    "validation",
    f"""with recursive {_sql_scored(f"length({_STRIP.format('text')}) > 0 and validated is distinct from 'rejected'")}
    select id_recording, h as asr_prediction, r as asr_label, 'model' as asr_validation_model, round(ce / nullif(cn + ci, 0), 9) as asr_cer, round(we / nullif(wn + wi, 0), 9) as asr_wer from aligned where ce / nullif(cn + ci, 0) < 0.6""",
)(
    lambda s, d: pipelines.validate(table(s, d, "samples"), _SPEC, "model")
    .select("id_recording", "asr_prediction", "asr_label", "asr_validation_model", F.round("asr_cer", 9).alias("asr_cer"), F.round("asr_wer", 9).alias("asr_wer"))
)


@query(
    "validation_counts",
    f"""with recursive {_sql_scored(f"length({_STRIP.format('text')}) > 0 and validated is distinct from 'rejected'")}
    select (select count(*) from base) as n_before, count(*) as n_after from aligned where ce / nullif(cn + ci, 0) < 0.6""",
)
def _validation_counts(s, d):
    rows = table(s, d, "samples")
    return pipelines.removed(pipelines.validate(rows, _SPEC, "model", max_cer=None), pipelines.validate(rows, _SPEC, "model"))


_ROLE = "case when lower(trim(split)) like 'train%' then 'train' when lower(trim(split)) like 'val%' or lower(trim(split)) like 'dev%' or lower(trim(split)) like 'test%' then 'eval' end"


@query(
    "comparison_table",
    f"""with m as (select sub_dialect, min(dialect) d from dialect_map group by 1), s as (select source, {_ROLE} ds, gender, asr_cer from samples where asr_cer is not null and source is not null),
    t as (select source, ds, 'overall' k, avg(asr_cer) v from s where ds is not null group by all union all select source, ds, gender, avg(asr_cer) from s where ds is not null and gender is not null group by all),
    n as (select count(distinct ds) n from t), o as (select source, k, avg(v) mean, count(distinct ds) c from t group by all),
    w as (select source as model, max(mean) filter (where k = 'overall') as overall, max(mean) filter (where k = 'male') as male, max(mean) filter (where k = 'female') as female from o, n where c = n group by 1)
    select *, cast(row_number() over (order by overall desc nulls last, model) as int) as place from w""",
)
def _comparison(s, d):
    r = table(s, d, "samples").filter("asr_cer is not null and source is not null").withColumn("ds", F.expr(_ROLE)).filter("ds is not null")
    # the rows that a comparison shows of each data set's scores: overall, and one category fixed
    t = r.groupBy("source", "ds").agg(F.lit("overall").alias("k"), F.avg("asr_cer").alias("v")).unionByName(r.filter("gender is not null").groupBy("source", "ds", F.col("gender").alias("k")).agg(F.avg("asr_cer").alias("v")))
    o = cube.comparison(t, "source", "ds", "k", "v", strict=False)
    return cube.model_table(o.select(F.col("source").alias("model"), F.col("k").alias("group"), "mean"), "model", ["overall", "male", "female"])


query(
    "selected_scores",
    """with m as (select sub_dialect, min(dialect) d from dialect_map group by 1),
    s as (select case when age >= 0 and age < 25 then '0-25' when age >= 25 and age < 50 then '25-50' when age >= 50 then '50+' end a, gender g, case when coalesce(country_birth, 'DK') <> 'DK' then 'Non-native' else m.d end d, asr_cer from samples left join m on samples.dialect = m.sub_dialect where asr_cer is not null),
    n as (select count(*) n from s), k as (select 'overall' as "group", count(*) as n_rows, sum(asr_cer) c from s union all select a, count(*), sum(asr_cer) from s where a is not null group by 1 union all select g, count(*), sum(asr_cer) from s where g is not null group by 1 union all select d, count(*), sum(asr_cer) from s where d is not null group by 1)
    select "group", n_rows, round(c, 6) as cer_sum from k, n where "group" = 'overall' or n_rows < n""",
)(
    lambda s, d: cube.selected_scores(cube.pruned_cube(pipelines.with_groups(table(s, d, "samples").filter("asr_cer is not null"), table(s, d, "dialect_map")), _CATEGORIES, {"c": "asr_cer"}), _CATEGORIES)
    .select("group", "n_rows", F.round("c", 6).alias("cer_sum"))
)


@query(
    "token_error_rates",
    """with t as (select vec_id, list_transform(range(0, 8), lambda i: list_position(embedding[i * 8 + 1:i * 8 + 8], list_max(embedding[i * 8 + 1:i * 8 + 8])) - 1) k, list_transform(range(0, 6), lambda i: case when (vec_id + i) % 5 = 0 then -100 else (vec_id * (i + 3)) % 8 end) l from embeddings),
    d as (select array_to_string(list_transform(list_filter(l, lambda x: x not in (-100, 7)), lambda x: ['a','b','c','d','e','f',' ','_'][x + 1]), '') r,
      array_to_string(list_transform(list_filter(list_transform(range(1, 9), lambda i: case when i > 1 and k[i] = k[i - 1] then null else k[i] end), lambda x: x is not null and x <> 7), lambda x: ['a','b','c','d','e','f',' ','_'][x + 1]), '') h from t)
    select count(*) as n, round(sum(case when r = '' or h = '' then greatest(length(r), length(h)) else levenshtein(r, h) end) / sum(length(r)), 9) as cer from d""",
)
def _token_error_rates(s, d):
    r = table(s, d, "embeddings").select(
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8)).alias("scores"),
        F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.when((F.col("vec_id") + i) % 5 == 0, F.lit(-100)).otherwise((F.col("vec_id") * (i + 3)) % 8).cast("int")).alias("labels"),
    )
    out = pipelines.token_error_rates(r, "scores", "labels", [*"abcdef", "|", "_"], 7, normalise=False)
    return out.select("n", F.round("cer", 9).alias("cer"))


query("worst_samples", "select id_recording, asr_cer from (select distinct id_recording, asr_cer from samples where asr_cer is not null) order by asr_cer desc, id_recording limit 100")(
    lambda s, d: table(s, d, "samples").filter("asr_cer is not null").select("id_recording", "asr_cer").distinct().orderBy(F.desc("asr_cer"), "id_recording").limit(100)
)

# ---------------------------------------------------------------- speakers and splits


def _metadata(s, d):
    return pipelines.split_metadata(table(s, d, "samples"), table(s, d, "dialect_map"))


query(
    "split_metadata",
    """with m as (select sub_dialect, min(dialect) d from dialect_map group by 1)
    select id_recording, speaker_id, gender, case when coalesce(country_birth, 'DK') <> 'DK' then 'Non-native' else m.d end as dialect, case when age >= 0 and age < 25 then '0-24' when age >= 25 and age < 50 then '25-49' when age >= 50 then '50-' end as age_group, asr_cer
    from samples left join m on samples.dialect = m.sub_dialect where gender is distinct from 'nonbinary' and validated is distinct from 'rejected' and validated is distinct from 'maybe' and asr_cer < 0.6""",
)(lambda s, d: _metadata(s, d).select("id_recording", "speaker_id", "gender", "dialect", "age_group", "asr_cer"))
query(
    "listed_speakers",
    """with l as (select distinct speaker_id from samples where asr_wer > 0.5 and speaker_id is not null)
    select id_recording, split from samples join l using (speaker_id) where asr_cer < 0.6 and (split like 'train%' or validated is distinct from 'maybe') and validated is distinct from 'rejected'""",
)(
    lambda s, d: filters.below_error(table(s, d, "samples")).filter(filters.none_of(F.col("validated"), "rejected") & (F.col("split").startswith("train") | filters.none_of(F.col("validated"), "maybe")))
    .join(table(s, d, "samples").filter("asr_wer > 0.5").select("speaker_id").distinct(), "speaker_id", "left_semi").select("id_recording", "split")
)
query(
    "speaker_profile",
    """select speaker_id, count(*) as n, round(sum(asr_cer), 6) as cer_sum, min(id_recording) as first_row, arg_min_null(location, id_recording) as location from (select distinct speaker_id, id_recording, asr_cer, location, gender from samples) where speaker_id is not null group by 1""",
)(
    lambda s, d: table(s, d, "samples").select("speaker_id", "id_recording", "asr_cer", "location", "gender").distinct().withColumns({"dialect": F.col("location"), "age_group": F.lit("x")})
    .transform(speaker_splits.speaker_profile).select("speaker_id", "n", F.round("cer_sum", 6).alias("cer_sum"), "first_row", F.col("dialect").alias("location"))
)


@query(
    "feature_spread",
    """with r as (select gender, dialect, cast(cast(floor(age / 25) as bigint) as varchar) a from samples), t as (select 'gender' f, gender v, count(*) n from r group by 2 union all select 'dialect', dialect, count(*) from r group by 2
    union all select 'age_group', a, count(*) from r group by 2), p as (select f, n / sum(n) over (partition by f) x from t), q as (select f, var_pop(x) y from p group by 1) select round(sum(y), 9) as spread from q""",
)
def _feature_spread(s, d):
    r = table(s, d, "samples").select("gender", "dialect", F.floor(F.col("age") / 25).cast("string").alias("age_group")).groupBy("gender", "dialect", "age_group").agg(F.count("*").alias("n"))
    return speaker_splits.share_spread(speaker_splits.feature_shares(r)).select(F.round("spread", 9).alias("spread"))


query("split_report", "select split, gender, count(*) as n, round(count(*) / sum(count(*)) over (partition by split), 9) as share from samples group by 1, 2")(
    lambda s, d: table(s, d, "samples").groupBy("split", "gender").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("split")), 9))
)
query("split_totals", "select split, count(distinct speaker_id) as n_speakers, count(distinct id_sentence) as n_sentences, round(count(*) * 4.5 / 3600, 9) as hours from samples group by 1")(
    lambda s, d: table(s, d, "samples").groupBy("split").agg(F.countDistinct("speaker_id").alias("n_speakers"), F.countDistinct("id_sentence").alias("n_sentences"), F.round(F.count("*") * 4.5 / 3600, 9).alias("hours"))
)


@query(
    "rank_sum",
    """with p as (select source, count(*) n, avg(asr_cer) c, count(distinct speaker_id) k from samples group by 1)
    select source, row_number() over (order by c desc nulls last, source) + row_number() over (order by n, source) + row_number() over (order by k, source) as rank from p""",
)
def _rank_sum(s, d):
    p = table(s, d, "samples").groupBy("source").agg(F.count("*").alias("n"), F.avg("asr_cer").alias("c"), F.countDistinct("speaker_id").alias("k"))
    return speaker_splits.rank_sum(p, [F.desc_nulls_last("c"), F.asc("n"), F.asc("k")], "source").select("source", F.col("rank").cast("long").alias("rank"))


@query("split_search")
def _split_search(s, d):
    # the spellings of a speaker are one speaker, else it could land in both splits
    bare = F.regexp_replace(F.regexp_replace(F.lower("speaker_id"), "[^0-9a-z]+", ""), "^spe", "")
    rows = builds.one_per(_metadata(s, d).select("id_recording", "speaker_id", "gender", "dialect", "age_group", "asr_cer"), "id_recording").withColumn("speaker_id", F.when(bare != "", F.concat(F.lit("spe_"), bare)))
    profile = speaker_splits.speaker_profile(rows)
    n = profile.agg(F.sum("n").alias("n")).first().n or 0
    wanted = {"gender": {"female": 0.3, "male": 0.3}, "age_group": {"0-24": 0.05, "25-49": 0.1, "50-": 0.1}}
    limits = (wanted, int(0.05 * n), int(0.25 * n))
    return speaker_splits.search_splits(s, profile, limits, limits, seeds=32)


# ---------------------------------------------------------------- corpora

query(
    "decontaminate",
    """with e as (select list(t order by length(t) desc, t) l from (select distinct text t from eval_items where text <> '')),
    c as (select doc_id, text, list_reduce(list_prepend(text, l), lambda a, b: replace(a, b, '')) k from documents, e where text is not null)
    select doc_id, k as clean_text, k <> text as changed from c union all select doc_id, null, false from documents where text is null""",
)(lambda s, d: corpus.decontaminate(table(s, d, "documents"), "text", "doc_id", table(s, d, "eval_items"), "text"))
query(
    "sentence_corpus",
    f"""with raw as (select 3 * row_number() over () id, text t from samples where text is not null union all select 3 * row_number() over () + 1, transcript from utterances where transcript is not null union all select 3 * row_number() over () + 2, text from eval_items where text is not null),
    {_sql_verbalised('raw')}, clean as (select id % 3 = 2 held, {_sql_clean('t', _KEEP_SQL)} t from verbal),
    e as (select list(t order by length(t) desc, t) l from (select distinct t from clean where held and t <> '')), c as (select distinct t from clean where not held and t <> ''),
    d as (select t, list_reduce(list_prepend(t, l), lambda a, b: replace(a, b, '')) k from c, e), f as (select k <> t as changed, {_STRIP.format("regexp_replace(k, ' +', ' ', 'g')")} as text from d)
    select text, changed from f where text <> ''""",
)(
    lambda s, d: pipelines.sentence_corpus([(table(s, d, "samples"), "text"), (table(s, d, "utterances"), "transcript")], [(table(s, d, "eval_items"), "text")], _SPEC).select("text", "changed")
)
def _sql_cleaned(key: str) -> str:
    rows = f"from samples where length({_STRIP.format('text')}) > 0 and validated is distinct from 'rejected'"
    return f"""with raw as (select row_number() over () id, text t {rows}), ids as (select row_number() over () id, id_recording {rows}),
    {_sql_verbalised('raw')} select id_recording as {key}, {_sql_clean('t', _KEEP_SQL)} as text from verbal join ids using (id)"""


query("evaluation_load", _sql_cleaned("id_recording"))(lambda s, d: pipelines.load_evaluation(table(s, d, "samples"), _SPEC).select("id_recording", "text"))
query("training_load_single", _sql_cleaned("key"))(
    lambda s, d: pipelines.load_training([Corpus(table(s, d, "samples"), "id_recording", "text")], _SPEC).select("key", "text")
)


def _corpora(s, d):
    return [Corpus(table(s, d, "documents"), "doc_id", "text", probability=0.5), Corpus(table(s, d, "utterances"), "utterance_id", "transcript", probability=0.3), Corpus(table(s, d, "samples"), "id_recording", "text", probability=0.2)]


query("training_load")(lambda s, d: pipelines.load_training(_corpora(s, d), _SPEC))
query(
    "training_load_counts",
    f"""with c as (select 0 i, 0.5 p, count(*) n from documents where length({_STRIP.format('text')}) > 0 union all select 1, 0.3, count(*) from utterances where length({_STRIP.format('transcript')}) > 0
      union all select 2, 0.2, count(*) from samples where length({_STRIP.format('text')}) > 0 and validated is distinct from 'rejected'),
    t as (select max(n / p) t from c), w as (select i, n, cast(round(p * t) as bigint) k from c, t), r as (select i, n, k, unnest(range(0, (k + n - 1) // n)) r from w)
    select i as source_no, cast(r as int) as repeat, least(n, k - r * n) as n from r""",
)(lambda s, d: pipelines.load_training(_corpora(s, d), CleanSpec(numerals=False)).groupBy("source_no", "repeat").agg(F.count("*").alias("n")))
query(
    "ngram_counts",
    r"""with t as (select list_filter(regexp_split_to_array(lower(transcript), '\s+'), lambda x: x <> '') w from utterances where transcript is not null),
    g as (select unnest(flatten([list_transform(range(1, len(w) - k + 2), lambda i: {'size': k, 'gram': array_to_string(w[i:i + k - 1], ' ')}) for k in [1, 2, 3] if k <= len(w)])) x from t)
    select x.size as size, x.gram as gram, count(*) as count from g group by 1, 2 having count(*) > case when x.size = 1 then 0 else 1 end""",
)(lambda s, d: corpus.ngrams(table(s, d, "utterances").select(F.lower("transcript").alias("t0")).filter("t0 is not null"), "t0"))


@query("mix_datasets")
def _mix(s, d):
    parts = [table(s, d, t).select(F.col(k).cast("string").alias("key"), F.col(c).alias("text")) for t, k, c in (("documents", "doc_id", "text"), ("eval_items", "item_id", "text"), ("utterances", "utterance_id", "transcript"))]
    return corpus.interleave(parts, "key", [0.5, 0.25, 0.25])


query("shuffle_seeded", "select doc_id, lang from documents")(lambda s, d: corpus.seeded_shuffle(table(s, d, "documents").select("doc_id", "lang"), "doc_id"))

# ---------------------------------------------------------------- arrays

query("peak_normalise", "select vec_id, round(list_max(list_transform(embedding, lambda x: abs(x::double))), 6) as peak, list_transform(embedding, lambda x: round(x::double / list_max(list_transform(embedding, lambda y: abs(y::double))), 5)) as wave from embeddings")(
    lambda s, d: table(s, d, "embeddings").withColumn("e", F.col("embedding").cast("array<double>")).select(
        "vec_id", F.round(F.array_max(F.transform("e", F.abs)), 6).alias("peak"), F.transform(audio.peak_normalise(F.col("e")), lambda x: F.round(x, 5)).alias("wave"))
)
query("duration", "select vec_id, len(embedding) / 16.0 as seconds from embeddings")(lambda s, d: table(s, d, "embeddings").select("vec_id", audio.duration(F.col("embedding"), 16).alias("seconds")))
query("slice_audio", "select vec_id, embedding[(500 + vec_id % 1000) * 16 // 1000 + 1:(1500 + vec_id % 1000) * 16 // 1000] as wave from embeddings")(
    lambda s, d: table(s, d, "embeddings").select("vec_id", audio.time_slice(F.col("embedding"), 500 + F.col("vec_id") % 1000, 1500 + F.col("vec_id") % 1000, 16).alias("wave"))
)
query(
    "segment_clips",
    """with u as (select distinct utterance_id, length(utterance_id) % 40 v, 100 * (length(transcript) % 20) a from utterances where utterance_id is not null and transcript is not null)
    select utterance_id, embedding[a * 16 // 1000 + 1:(a + 1000) * 16 // 1000] as audio from u join embeddings on vec_id = v""",
)(
    lambda s, d: builds.with_clips(
        table(s, d, "utterances").filter("utterance_id is not null and transcript is not null").select("utterance_id", (F.length("utterance_id") % 40).cast("long").alias("stem"), (100 * (F.length("transcript") % 20)).alias("start_ms")).distinct().withColumn("end_ms", F.col("start_ms") + 1000),
        table(s, d, "embeddings").select(F.col("vec_id").alias("stem"), F.col("embedding").alias("array")), 16,
    ).select("utterance_id", "audio")
)
query("mono", "select vec_id, list_transform(range(1, 33), lambda i: round((embedding[i]::double + embedding[i + 32]::double) / 2, 6)) as wave from embeddings")(
    lambda s, d: table(s, d, "embeddings").select("vec_id", F.transform(audio.mono(F.slice(F.col("embedding").cast("array<double>"), 1, 32), F.slice(F.col("embedding").cast("array<double>"), 33, 32)), lambda x: F.round(x, 6)).alias("wave"))
)
query("resample", "select vec_id, list_transform(range(0, len(embedding) // 2), lambda i: embedding[2 * i + 1]) as wave from embeddings")(lambda s, d: table(s, d, "embeddings").select("vec_id", audio.resampler(8)("embedding", F.lit(16)).alias("wave")))
query("augment")(lambda s, d: table(s, d, "embeddings").select("vec_id", audio.augmenter(4242)("embedding", F.col("vec_id"), F.reverse("embedding")).alias("wave")))
query(
    "argmax_decode",
    "select vec_id, list_transform(range(0, 8), lambda i: list_position(embedding[i * 8 + 1:i * 8 + 8], list_max(embedding[i * 8 + 1:i * 8 + 8])) - 1) as tokens from embeddings",
)(lambda s, d: table(s, d, "embeddings").select("vec_id", audio.argmax(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))).alias("tokens")))

query("vocabulary", "with c as (select distinct unnest(string_split(replace(lower(text), ' ', '|'), '')) k from eval_items) select k as char, cast(row_number() over (order by k) - 1 as int) as id from c where k <> ''")(
    lambda s, d: collate.vocabulary(table(s, d, "eval_items").select(F.lower("text").alias("t")), "t")
)
query(
    "vocabulary_json",
    """with c as (select distinct unnest(string_split(replace(lower(text), ' ', '|'), '')) k from eval_items), v as (select k, row_number() over (order by k) - 1 id from c where k <> '')
    select '{' || string_agg('"' || replace(replace(k, '\\', '\\\\'), '"', '\\"') || '":' || id, ',' order by id) || '}' as json from v""",
)(lambda s, d: sinks.vocabulary_json(collate.vocabulary(table(s, d, "eval_items").select(F.lower("text").alias("t")), "t")))

_ALPHABET = list("|abcdefghijklmnopqrstuvwxyzæøå")


@query(
    "collate_labels",
    f"""with v as (select string_split('{''.join(_ALPHABET)}', '') a), l as (select item_id, item_id % 8 b, list_transform(string_split(replace(lower(text), ' ', '|'), ''), lambda c: coalesce(list_position(a, c) - 1, {len(_ALPHABET)})) k from eval_items, v),
    c as (select item_id, b, list_slice(k, 1, 512) k from l), m as (select b, max(len(k)) n from c group by 1)
    select item_id, b as batch, list_concat(k, list_transform(range(0, n - len(k)), lambda x: -100)) as labels from c join m using (b)""",
)
def _collate(s, d):
    r = table(s, d, "eval_items").select("item_id", (F.col("item_id") % 8).alias("batch"), F.lower("text").alias("t"))
    return collate.collate(collate.label_ids(r, "t", _ALPHABET), "batch").select("item_id", "batch", "labels")


@query(
    "arpa_edit",
    r"""with g as (select unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) w from eval_items), c as (select w, count(*) n from g group by 1),
    l as (select 1 line_no, 'ngram 1=' || (select count(*) + 2 from c) line union all select 2, 'ngram 1=7' union all select 3, '-1.0' || chr(9) || '<s>' || chr(9) || '0' union all select 3 + row_number() over (order by w), '-1.0' || chr(9) || w || chr(9) || '0' from c)
    select line_no, 0 as part, case when line_no = 1 then 'ngram 1=' || (select count(*) + 3 from c) else line end as line from l union all select 3, 1, '-1.0' || chr(9) || '</s>' || chr(9) || '0'""",
)
def _arpa(s, d):
    one = corpus.ngrams(table(s, d, "eval_items"), "text", 1)
    # a fixed table of 300 items: its words fit into one task
    rows = one.select(F.row_number().over(Window.orderBy("gram")).alias("n"), "gram").select((F.col("n") + 3).alias("line_no"), F.concat(F.lit("-1.0\t"), "gram", F.lit("\t0")).alias("line"))
    head = one.agg(F.concat(F.lit("ngram 1="), (F.count("*") + 2).cast("string")).alias("line")).select(F.lit(1).alias("line_no"), "line")
    more = s.createDataFrame([(2, "ngram 1=7"), (3, "-1.0\t<s>\t0")], "line_no int, line string")
    return corpus.edit_arpa(head.unionByName(more).unionByName(rows))


query("audio_hours", "select sum(len(embedding)) / (16 * 3600.0) as hours, cast(floor(sum(len(embedding)) / (16 * 3600.0) * 3600 / 4.5) as bigint) as n_samples from embeddings")(
    lambda s, d: table(s, d, "embeddings").agg(audio.hours(F.col("embedding"), 16).alias("hours")).select("hours", audio.samples_of_hours(F.col("hours"), 4.5).alias("n_samples"))
)
query("source_files", r"select distinct upper(split_part(regexp_replace(regexp_replace(utterance_id, '\s+', '', 'g'), '[-_]+', '_', 'g'), '_', 2) || '_' || split_part(regexp_replace(regexp_replace(utterance_id, '\s+', '', 'g'), '[-_]+', '_', 'g'), '_', 3)) as src_fname from utterances")(
    lambda s, d: table(s, d, "utterances").select(recording_file(F.col("utterance_id")).alias("src_fname")).distinct()
)
