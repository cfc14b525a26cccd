import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taleflow.functions import audio, demographics
from taleflow.operators import builds, corpus, cube, pipelines
from taleflow.operators.pipelines import CleanSpec, Corpus
from taleflow.sources import readers, sinks

SAMPLE = "id_recording string, text string, asr_prediction string, age int, gender string, dialect string, country_birth string, validated string, asr_cer double"
MAP = [("sønder", "Sør"), ("nord", "Nor"), ("nord", "Xnor")]
SPEC = CleanSpec(keep="abcdefghijklmnopqrstuvwxyzæøå ")


def rates(pairs):
    """(cer, wer) as sums of errors over sums of lengths, by the definition."""
    out = []
    for cut in (list, str.split):
        errors = total = 0
        for r, h in pairs:
            a, b = cut(r), cut(h)
            d = [(j, j) for j in range(len(b) + 1)]
            for i, x in enumerate(a, 1):
                p = [(i, 0)]
                for j, y in enumerate(b, 1):
                    p.append(min((d[j][0] + 1, d[j][1]), (p[-1][0] + 1, p[-1][1] + 1), (d[j - 1][0] + (x != y), d[j - 1][1])))
                d = p
            errors, total = errors + d[-1][0], total + len(a) + d[-1][1]
        out.append(errors / total if total else None)
    return out


def test_evaluation_is_a_micro_average(spark):
    rng = random.Random(4)
    ws = ["hund", "kat", "mus", "stol", "bord"]
    rows = []
    for i in range(60):
        ref = " ".join(rng.choice(ws) for _ in range(rng.randrange(1, 9)))
        hyp = " ".join(w[:-1] if rng.random() < 0.3 else w for w in ref.split())
        rows.append((f"r{i}", ref.upper() + "!", hyp, rng.choice([20, 30, 70]), rng.choice("mf"), rng.choice(["nord", "sønder", None]), None, None, None))
    rows += [("x", None, "hund", 20, "m", "nord", None, None, None), ("y", "hund", None, 20, "m", "nord", None, None, None), ("z", "", "", 20, "m", "nord", None, None, None)]
    df = spark.createDataFrame(rows, SAMPLE).withColumns({"n_rows": F.lit(1), "chars": F.lit("a")})
    got = {(r.age_group, r.gender, r.dialect): r for r in pipelines.evaluate(df, spark.createDataFrame(MAP, "sub_dialect string, dialect string"), SPEC).collect()}
    kept = [r for r in rows if r[1] is not None and r[2] is not None]
    for key, want in {(None, None, None): kept, (None, "m", None): [r for r in kept if r[4] == "m"], (None, None, "Nor"): [r for r in kept if r[5] == "nord"]}.items():
        cer, wer = rates([(r[1].lower().rstrip("!"), r[2]) for r in want])
        assert got[key].n_rows == len(want) and got[key].cer == pytest.approx(cer) and got[key].wer == pytest.approx(wer)
    assert pipelines.evaluate(df.limit(0), spark.createDataFrame(MAP, "sub_dialect string, dialect string"), SPEC).collect() == []


def test_validation(spark):
    rows = [("a", "En hund", "en hund", None, None, None, None, None, 9.0), ("b", "en kat", "xx yyy zzzzz", None, None, None, None, None, None), ("c", "to", "to", None, None, None, None, "rejected", None), ("d", " ", "x", None, None, None, None, None, None), ("e", "2 mus", "to mus", None, None, None, None, "maybe", None), ("f", "hov", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SAMPLE)
    got = {r.id_recording: r for r in pipelines.validate(df, SPEC, "min/model", max_cer=None).collect()}
    assert set(got) == {"a", "b", "e", "f"} and got["a"].asr_cer == got["e"].asr_cer == 0.0 and got["e"].asr_label == "to mus" and got["f"].asr_cer is None and 0.6 < got["b"].asr_cer <= 1
    assert {r.asr_validation_model for r in got.values()} == {"min/model"}
    kept = pipelines.validate(df, SPEC, "min/model")
    assert sorted(r.id_recording for r in kept.collect()) == ["a", "e"]
    assert tuple(pipelines.removed(df, kept).first()) == (6, 2)
    short = df.withColumn("wave", F.array_repeat(F.lit(0.0), 5))
    assert pipelines.validate(short, SPEC, "m", array="wave", rate=16).count() == 2 and pipelines.validate(short, SPEC, "m", array="wave", rate=20).count() == 0


def waiting(df):
    """For every step of Python workers in the plan, the columns of the rows that wait for them."""
    out, nodes = [], [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        n = nodes.pop()
        kids = [n.children().apply(i) for i in range(n.children().size())]
        if n.nodeName() == "ArrowEvalPython":
            columns = kids[0].output()
            out.append({columns.apply(i).name() for i in range(columns.size())})
        nodes += kids
    return out


def test_validation_aligns_cleaned_texts_once(spark):
    rows = [("a", "En hund", "en hund", None, None, None, None, None, None), ("b", "2 mus", None, None, None, None, None, None, None)]
    got = pipelines.validate(spark.createDataFrame(rows, SAMPLE), SPEC, "m").select("id_recording", "asr_prediction", "asr_label", "asr_cer", "asr_wer")
    assert waiting(got) == [{"id_recording", "asr_prediction", "asr_label"}]
    assert [tuple(r) for r in got.collect()] == [("a", "en hund", "en hund", 0.0, 0.0)]


def test_validation_counts_carry_no_word_table(spark):
    rows = [("a", "I alt 1.234,51 kroner", "i alt et tusind to hundrede og fireogtredive komma fem et kroner", None, None, None, None, None, None), ("b", "2 mus", "xx yyy zzzzz", None, None, None, None, None, None), ("c", "2 mus", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SAMPLE)
    got = pipelines.removed(pipelines.validate(df, SPEC, "m", max_cer=None), pipelines.validate(df, SPEC, "m"))
    assert tuple(got.first()) == (3, 1)
    # nor do rows that are validated without a limit
    for plan in (got, pipelines.validate(df, SPEC, "m", max_cer=None).select("asr_cer")):
        assert ["number_words" in columns for columns in waiting(plan)] == [False]


def test_training_load(spark):
    a = spark.createDataFrame([(1, "EN 2", None), (2, " ", None), (3, "tre", "rejected"), (4, "fire", None)], "id int, t string, validated string")
    b = spark.createDataFrame([("x", "hunden")], "k string, tekst string")
    one = pipelines.load_training([Corpus(a, "id", "t")], SPEC)
    assert sorted(r.text for r in one.collect()) == ["en to", "fire"]
    both = pipelines.load_training([Corpus(a, "id", "t"), Corpus(b, "k", "tekst")], SPEC).collect()
    assert sorted((r.source_no, r.repeat, r.text) for r in both) == [(0, 0, "en to"), (0, 0, "fire"), (1, 0, "hunden"), (1, 1, "hunden")]
    none = pipelines.load_training([Corpus(a, "id", "t", probability=1.0), Corpus(b, "k", "tekst", probability=0.0)], SPEC).collect()
    assert sorted(r.text for r in none) == ["en to", "fire"]
    wave = a.withColumn("w", F.array_repeat(F.lit(0.5).cast("float"), 40))
    mixed = pipelines.load_training([Corpus(wave, "id", "t", "w"), Corpus(b, "k", "tekst")], SPEC, rate=16, low=1.0, high=4.0)
    assert {len(r.audio) if r.audio else None for r in mixed.collect()} == {40, None}
    assert spark.range(1).select(pipelines.validation_split_name("hus/Mit-Sæt", "Del-A")).first()[0] == "val_mit_sæt_del_a"


def test_partial_rounds_are_exact(spark):
    a, b = (spark.range(n).select(F.lit("same" if n == 7 else "k").alias("k"), "id") for n in (7, 100))
    got = {(r.source_no, r.repeat): r["count"] for r in corpus.interleave([a, b], "k", [0.5, 0.5]).groupBy("source_no", "repeat").count().collect()}
    assert sum(n for (s, _), n in got.items() if s == 0) == 100 and got[0, 14] == 2  # although all keys of the source are equal


def test_metadata_and_strict_dialects(spark):
    rows = [("a", "x", None, 24, "f", "nord", None, None, 0.1), ("b", "x", None, 25, "nonbinary", "nord", None, None, 0.1), ("c", "x", None, 50, None, "nord", "SE", None, 0.1), ("d", "x", None, 50, "m", "ukendt", None, "maybe", 0.1), ("e", "x", None, 50, "m", None, None, None, 0.6)]
    df, m = spark.createDataFrame(rows, SAMPLE), spark.createDataFrame(MAP, "sub_dialect string, dialect string")
    got = {r.id_recording: (r.dialect, r.age_group) for r in pipelines.split_metadata([df.limit(2), df.filter("id_recording > 'b'").drop("text")], m).collect()}
    assert got == {"a": ("Nor", "0-24"), "c": ("Non-native", "50-")}
    with pytest.raises(Exception, match="no dialect for ukendt"):
        demographics.main_dialect(df, m, strict=True).collect()
    assert demographics.main_dialect(df.filter("id_recording <> 'd'"), m, strict=True).count() == 4


def test_sentence_corpus(spark):
    a = spark.createDataFrame([("En hund løber",), ("en HUND løber!",), (None,), ("  ",), ("Katten siger: en mus",)], "t string")
    b = spark.createDataFrame([("En mus",), ("løber katten",)], "s string")
    got = {(r.text, r.changed) for r in pipelines.sentence_corpus([(a, "t")], [(b, "s")], SPEC).collect()}
    assert got == {("en hund løber", False), ("katten siger", True)}
    gone = pipelines.sentence_corpus([(b, "s")], [(b, "s")], SPEC, keep_empty=True).collect()
    assert {r.text for r in gone} == {""} and pipelines.sentence_corpus([(a.limit(0), "t")], [(b, "s")], SPEC).collect() == []


def test_deletion_in_several_passes(spark):
    rng = random.Random(3)
    held = spark.createDataFrame([("".join(rng.choice("ab ") for _ in range(rng.randrange(1, 7))),) for _ in range(60)], "s string")
    docs = spark.createDataFrame([(i, "".join(rng.choice("abc ") for _ in range(40))) for i in range(80)] + [(99, None)], "id int, t string")
    order = sorted({r.s for r in held.collect() if r.s}, key=lambda x: (-len(x), x))
    want = {}
    for r in docs.collect():
        t = r.t
        for x in order:
            t = t.replace(x, "") if t else t
        want[r.id] = (t, t != r.t)
    for size in (1000, 7):
        got = {r.id: (r.clean_text, r.changed) for r in corpus.decontaminate(docs, "t", "id", held, "s", max_sentences=size).collect()}
        assert got == want


def test_arpa_edits_the_first_lines_only(spark):
    lines = spark.createDataFrame([(1, "ngram 1=4"), (2, "ngram 1=9"), (3, "-1\t<s>\t0"), (4, "-2\t<s>\t0")], "line_no int, line string")
    got = [(r.line_no, r.part, r.line) for r in corpus.edit_arpa(lines).orderBy("line_no", "part").collect()]
    assert got == [(1, 0, "ngram 1=5"), (2, 0, "ngram 1=9"), (3, 0, "-1\t<s>\t0"), (3, 1, "-1\t</s>\t0"), (4, 0, "-2\t<s>\t0")]
    assert corpus.edit_arpa(lines.limit(0)).collect() == []


def test_builds(spark):
    files = spark.createDataFrame([(x,) for x in ("mic_11101", "mic_3", "spk_2", "mic_11300", "spk_-1", "spk_x", "mic_10")], "stem string")
    lines = spark.createDataFrame([(i, f"linje {i}") for i in (2, 3, 10, 11000, 11200)], "line_no int, line string")
    got = [(r.place, r.stem, r.transcription_id) for r in builds.spoken_lines(files, lines).orderBy("place").collect()]
    assert got == [(1, "mic_10", 10), (2, "mic_11101", 11000), (3, "mic_3", 3), (4, "spk_2", 2)]
    assert builds.spoken_lines(files.limit(0), lines).collect() == []
    moved = builds.spoken_lines(spark.createDataFrame([("mic_11300",)], "stem string"), lines, moved=((11100, -101), (11199, 1))).collect()
    assert [r.transcription_id for r in moved] == [11200]
    meta = spark.createDataFrame([("1", "hej", "30", "02 Jan 2020T10:05:00", "a-b_7.wav"), ("2", "hov", "x", "02 Jan 2020T10:05:00", "7.wav"), ("3", "", "3", "02 Jan 2020T10:05:00", "7.wav"), ("4", "nej", "4", "02 Jan 2020T11:05:00", "8.wav")], "nr string, tekst string, alder string, tid string, fil string")
    wavs = spark.createDataFrame([("/a/1005-7.wav",), ("/b/1005_7.wav",), ("/c/1006_7.wav",)], "path string")
    names = {"nr": "id", "tekst": "text", "alder": "age", "tid": "recorded_at", "fil": "file_name"}
    r = builds.dictation(meta, names, wavs).collect()
    assert [(x.id, x.age, x.recording_time, x.n_files) for x in r] == [("1", 30, "2020-01-02T10:05:00", 2)] and r[0].audio_path in ("/a/1005-7.wav", "/b/1005_7.wav")
    assert r == builds.dictation(meta.repartition(3), names, wavs.repartition(3)).collect()
    dup = spark.createDataFrame([(1, "b", None), (1, "a", 2), (1, "a", None), (None, "z", 1)], "k int, x string, y int")
    assert sorted(map(str, builds.one_per(dup, "k").collect())) == ["Row(k=1, x='a', y=None)", "Row(k=None, x='z', y=1)"]


def test_comparison_of_models(spark):
    rows = [("m1", "d1", "overall", 0.2), ("m1", "d2", "overall", 0.4), ("m2", "d1", "overall", 0.5), ("m2", "d2", "overall", 0.1), ("m1", "d1", "male", 0.1)]
    df = spark.createDataFrame(rows, "model string, ds string, grp string, v double")
    means = cube.comparison(df, "model", "ds", "grp", "v")
    table = cube.model_table(means.withColumnRenamed("grp", "group"), "model", ["overall", "male"]).orderBy("place").collect()
    assert [(r.model, round(r.overall, 9), r.male, r.place) for r in table] == [("m1", 0.3, None, 1), ("m2", 0.3, None, 2)]
    with pytest.raises(ValueError, match="m2"):
        cube.comparison(df.filter("not (model = 'm2' and ds = 'd2')"), "model", "ds", "grp", "v")


def test_token_metric(spark):
    hot = lambda i: [1.0 if j == i else 0.0 for j in range(4)]
    df = spark.createDataFrame([([hot(0), hot(0), hot(3), hot(0), hot(2), hot(1), [-100.0] * 4], [0, 0, 2, 1, -100])], "scores array<array<double>>, labels array<int>")
    r = pipelines.token_error_rates(df, "scores", "labels", ["a", "b", "|", "_"], 3).first()
    assert (r.n, r.cer, r.wer) == (1, 0.0, 0.0)
    assert pipelines.token_error_rates(df.limit(0), "scores", "labels", ["a"], 3).first().cer is None


def test_cache_sql_and_clips(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for inputs in ({"name": "a", "split": "test"}, {"split": "test", "name": "a"}, {"name": "a", "split": "val"}):
        assert readers.cached(spark, str(tmp_path / "cache"), inputs, build).count() == 3
    assert len(calls) == 2
    spark.range(5).write.parquet(str(tmp_path / "t" / "tal.parquet"))
    assert readers.read_sql(spark, str(tmp_path / "t"), "select count(*) n from tal where id > 1").first().n == 3
    wave = [0.0, 0.5, -1.0, 0.25]
    sinks.write_clips(spark.createDataFrame([("klip", wave), ("tom", None)], "name string, array array<double>"), str(tmp_path / "wav"), rate=8000)
    got = readers.read_wavs(spark, str(tmp_path / "wav")).collect()
    assert [(r.stem, list(r.array), r.sampling_rate) for r in got] == [("klip", wave, 8000)]
    (tmp_path / "many.txt").write_text("\n".join(f" linje {i} " for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = readers.read_lines(spark, str(tmp_path / "many.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.line_no, r.line) for r in lines) == [(i + 1, f"linje {i}") for i in range(5000)]
    parts = spark.createDataFrame([("/x/Train_da/a/fil.tar.gz",), ("/x/y/fil",)], "p string").select(*[c.alias(k) for k, c in readers.path_parts(F.col("p")).items()]).collect()
    assert [tuple(r) for r in parts] == [("train", "fil", ".tar.gz"), (None, "fil", "")]


def test_augmentation(spark):
    x = np.sin(np.arange(512) / 5)
    make = lambda s, **o: audio.augment_array(x, np.random.default_rng(s), x[::-1], **o)
    assert (make(1) == make(1)).all() and not (make(1) == make(2)).all()
    plain = make(3, background_p=0, noise_p=0, filter_p=0)
    gain = plain[1:] / (x / np.abs(x).max())[1:]
    assert np.std(gain) < 1e-3 and 10 ** (-6 / 20) <= np.mean(gain) <= 10 ** (6 / 20)
    for kind in audio.FILTERS:
        y = audio._filtered(np.random.default_rng(0).normal(size=512), kind, 0.3, 0.6)
        power = np.abs(np.fft.rfft(y))
        f = np.linspace(0, 1, len(power))
        gone = {"low": f > 0.62, "high": f < 0.28, "band": (f < 0.28) | (f > 0.62), "stop": (f > 0.32) & (f < 0.58)}[kind]
        assert power[gone].max() < 1e-9 < power[~gone].max()
    slope = {}
    for name, p in audio.COLOURS.items():
        power = np.abs(np.fft.rfft(audio._coloured(1 << 15, p, np.random.default_rng(1)))) ** 2
        slope[name] = np.polyfit(np.log(np.arange(10, 10_000)), np.log(power[10:10_000]), 1)[0]
        assert slope[name] == pytest.approx(p, abs=0.1)
    df = spark.createDataFrame([(x.tolist(), 1, None), (None, 2, None), ([], 3, None)], "a array<double>, k int, b array<double>")
    got = [r[0] for r in df.select(audio.augmenter(7)("a", "k", "b")).collect()]
    assert len(got[0]) == 512 and got[1] is None and got[2] == []


def test_clips_of_segments(spark):
    seg = spark.createDataFrame([("a", 0, 500, "x"), ("a", 250, 750, "y"), ("b", 0, 1, "z")], "stem string, start_ms int, end_ms int, id string")
    rec = spark.createDataFrame([("a", [float(i) for i in range(8)])], "stem string, array array<double>")
    assert {r.id: r.audio for r in builds.with_clips(seg, rec, 8).collect()} == {"x": [0.0, 1.0, 2.0, 3.0], "y": [2.0, 3.0, 4.0, 5.0]}




def test_late_rows_and_closed_windows(spark, tmp_path):
    from taleflow.streaming import clean as streams

    rows = [(f"2024-01-01 {h:02d}:30:00", k) for h in (1, 1, 2, 5) for k in "ab"] + [(None, "a")]
    spark.createDataFrame(rows, "t string, k string").select(F.to_timestamp("t").alias("t"), "k").coalesce(1).write.parquet(str(tmp_path / "x" / "haendelser.parquet"))
    # a table of the stream is one file beside others
    part = next((tmp_path / "x" / "haendelser.parquet").glob("*.parquet"))
    (tmp_path / "y").mkdir()
    part.rename(tmp_path / "y" / "haendelser.parquet")
    (tmp_path / "y" / "andet.parquet").write_bytes(b"")
    got = streams.run_available(streams.windowed_counts(streams.stream_table(spark, str(tmp_path / "y"), "haendelser"), "t", "1 hour", "2 hours", "k")).collect()
    assert sorted((r.start.hour, r.k, r.n) for r in got) == [(1, "a", 2), (1, "b", 2), (2, "a", 1), (2, "b", 1)]


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "en\u00f8", 0.5), ("b", "to", None)], "id string, text string, cer double")
    sinks.write_scores(df, str(tmp_path / "scores"))
    sinks.write_metadata(df, str(tmp_path / "meta"))
    sinks.write_sentences(df, "text", str(tmp_path / "text"))
    for name in ("scores", "meta"):
        back = readers.read_csv(spark, str(tmp_path / name), "id string, text string, cer double").collect()
        assert sorted(map(tuple, back), key=str) == [("a", "enø", 0.5), ("b", "to", None)]
    assert len(list((tmp_path / "scores").glob("*.csv"))) == 1
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "text")).collect()) == ["enø", "to"]


def test_tables_are_released(spark):
    import os

    from taleflow.plans import storage

    with storage.scratch():
        a = storage.materialise(spark.range(3))
        b = storage.materialise(spark.range(4))
        storage.release(a)
        assert not os.path.exists(a._taleflow_path) and b.count() == 4
    assert not os.path.exists(b._taleflow_path)
