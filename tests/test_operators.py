import io
import itertools
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from taleflow.functions import audio, demographics, metrics
from taleflow.operators import collate, corpus, cube, filters, speaker_splits
from taleflow.sources import readers, sinks


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p = [i]
        for j, y in enumerate(b, 1):
            p.append(min(d[j] + 1, p[-1] + 1, d[j - 1] + (x != y)))
        d = p
    return d[-1]


def fewest(a, b):
    """(errors, insertions) by the definition, cell by cell."""
    d = [(j, j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        p = [(i, 0)]
        for j, y in enumerate(b, 1):
            p.append(min((d[j][0] + 1, d[j][1]), (p[-1][0] + 1, p[-1][1] + 1), (d[j - 1][0] + (x != y), d[j - 1][1])))
        d = p
    return d[-1]


def test_alignment_counts():
    rng = random.Random(3)
    pairs = [tuple(["abc"[rng.randrange(3)] for _ in range(rng.randrange(9))] for _ in range(2)) for _ in range(400)] + [(list("ab"), list("ba")), ([], []), ([], list("ab")), (list("ab"), [])]
    got = metrics.align(*map(list, zip(*pairs)))
    for (a, b), (h, s, d, i) in zip(pairs, got.tolist()):
        assert (s + d + i, i) == fewest(a, b) and s + d + i == distance(a, b) and h + s + d == len(a) and h + s + i == len(b) and min(h, s, d, i) >= 0
    assert got[400].tolist() == [0, 2, 0, 0]
    long = metrics.align([list("ab" * 3000)], [list("ba" * 3000)])
    assert long.tolist() == [[5999, 0, 1, 1]]
    assert metrics.align([], []).shape == (0, 4)


def test_error_rates(spark):
    df = spark.createDataFrame([("en to tre", "en tre"), ("ja", ""), (None, "x")], "r string, h string")
    got = df.select(metrics.word_counts("r", "h").alias("w")).agg(metrics.error_rate("w").alias("a"), metrics.error_rate("w", False).alias("b")).first()
    assert got.a == got.b == 0.5
    assert df.filter("r = 'z'").select(metrics.char_counts("r", "h").alias("w")).agg(metrics.error_rate("w")).first()[0] is None


def test_cube_against_rule(spark):
    rng = random.Random(5)
    cats = ["a", "g", "d"]
    for _ in range(4):
        rows = [(rng.choice(["x", "y", None]), rng.choice(["m", "f"]), rng.choice(["p", "q", "r"][: rng.randrange(1, 4)]), 1.0) for _ in range(rng.randrange(1, 14))]
        got = {tuple(r)[:4] for r in cube.pruned_cube(spark.createDataFrame(rows, "a string, g string, d string, v double"), cats, {"s": "v"}).collect()}
        want = set()
        values = [[None, *sorted({r[i] for r in rows} - {None})] for i in range(3)]
        for combo in itertools.product(*values):
            left, ok = rows, True
            for i, v in enumerate(combo):
                if v is not None:
                    new = [r for r in left if r[i] == v]
                    ok &= 0 < len(new) < len(left)
                    left = new
            if ok:
                want.add((*combo, len(left)))
        assert got == want


def test_null_safe_filters(spark):
    df = spark.createDataFrame([("rejected", "a"), ("maybe", "b"), (None, "  "), (None, "c"), ("ok", None)], "validated string, t string")
    assert [r.t for r in filters.filter_samples(df, "t").collect()] == ["b", "c"]
    assert df.filter(filters.none_of(F.col("validated"), "rejected", "maybe")).count() == 3
    a = spark.createDataFrame([([0.0] * n,) for n in (8, 9, 15, 16)], "a array<double>")
    assert a.filter(filters.within_duration(F.col("a"), 8, 1, 2)).count() == 2


def test_ages(spark):
    df = spark.createDataFrame([(x,) for x in (0, 24, 25, 26, 49, 50, None)], "age int")
    assert [r[0] for r in df.select(demographics.age_group(F.col("age"))).collect()] == ["0-24", "0-24", "25-49", "25-49", "25-49", "50-", None]
    assert [r[0] for r in df.select(demographics.evaluation_age_group(F.col("age"))).collect()] == ["0-25", "0-25", "25-50", "25-50", "25-50", "50+", None]
    with pytest.raises(Exception):
        df.select(demographics.age_group(F.col("age"), strict=True)).collect()


def test_decontaminate_longest_first(spark):
    docs = spark.createDataFrame([(1, "x ab cd y"), (2, "ab"), (3, None), (4, "")], "id int, t string")
    ev = spark.createDataFrame([("ab",), ("ab cd",), (None,)], "s string")
    got = {r.id: (r.clean_text, r.changed) for r in corpus.decontaminate(docs, "t", "id", ev, "s").collect()}
    assert got == {1: ("x  y", True), 2: ("", True), 3: (None, False), 4: ("", False)}


def test_interleave_shares(spark):
    a, b = (spark.range(n).select(F.col("id").cast("string").alias("k")) for n in (90, 10))
    n = {r.source_no: r["count"] for r in corpus.interleave([a, b], "k", [0.5, 0.5]).groupBy("source_no").count().collect()}
    assert n == {0: 90, 1: 90}
    with pytest.raises(ValueError):
        corpus.probabilities(2, [0.5, 0.4])


def test_ngrams_and_arpa(spark):
    df = spark.createDataFrame([("a b a b",), (None,), ("",)], "t string")
    got = {(r.size, r.gram): r["count"] for r in corpus.ngrams(df, "t").collect()}
    assert got == {(1, "a"): 2, (1, "b"): 2, (2, "a b"): 2}
    lines = spark.createDataFrame([(1, "ngram 1=4"), (2, "-1\t<s>\t0"), (3, "-1\ta\t0")], "line_no int, line string")
    out = corpus.edit_arpa(lines).orderBy("line_no", "part").collect()
    assert [r.line for r in out] == ["ngram 1=5", "-1\t<s>\t0", "-1\t</s>\t0", "-1\ta\t0"]


def test_split_search(spark):
    rows = [(f"s{i}", f"r{i}{j}", 0.1 * i, "female" if i % 2 else "male", "x", "0-24") for i in range(20) for j in range(5)]
    df = spark.createDataFrame(rows, "speaker_id string, id_recording string, asr_cer double, gender string, dialect string, age_group string")
    c = speaker_splits.split_candidates(spark, speaker_splits.speaker_profile(df), {"gender": {"female": 0.4}}, 20, 60, seeds=8)
    best = speaker_splits.best_split(c, 2).collect()
    assert best and all(20 <= r.n < 60 and len(set(r.speakers)) == len(r.speakers) for r in best)
    t, v = (spark.createDataFrame([(x,)], "speaker_id string") for x in ("s1", "s2"))
    assert speaker_splits.split_by_speaker(df, "speaker_id", t, v).groupBy("split").count().count() == 3
    with pytest.raises(ValueError):
        speaker_splits.split_by_speaker(df, "speaker_id", t, t)


def test_split_search_of_many_speakers_with_validation(spark):
    many = spark.range(200_001).selectExpr("concat('s', id) as speaker_id", "5L as n", "id % 7 * 0.1D as cer_sum", "if(id % 2 = 0, 'male', 'female') as gender", "'x' as dialect", "'0-24' as age_group", "cast(id as string) as first_row")
    wanted = {"gender": {"female": 0.4}}
    c = speaker_splits.split_candidates(spark, many, wanted, 50, 100, seeds=2).collect()
    assert len(c) == 2 and all(r.ok for r in c)
    few = many.filter("n > 0").limit(40)
    best = {r.split: r for r in speaker_splits.search_splits(spark, few, (wanted, 50, 100), (wanted, 30, 90), seeds=8).collect()}
    assert set(best) == {"test", "val"} and not set(best["test"].speakers) & set(best["val"].speakers)
    assert 50 <= best["test"].n < 100 and 30 <= best["val"].n < 90
    assert speaker_splits.search_splits(spark, few, (wanted, 50, 100), (wanted, 190, 250), seeds=4).collect() == []


def test_arrays(spark):
    df = spark.createDataFrame([([0.5, -2.0, 1.0],), ([0.0, 0.0],)], "a array<double>")
    assert [r[0] for r in df.select(audio.peak_normalise(F.col("a"))).collect()] == [[0.25, -1.0, 0.5], [0.0, 0.0]]
    steps = spark.createDataFrame([([[0.1, 0.9], [3.0, 2.0]],)], "x array<array<double>>")
    assert steps.select(audio.argmax(F.col("x"))).first()[0] == [1, 0]
    labels = spark.createDataFrame([(1, [7, 1]), (1, [7, 2, 3])], "b int, labels array<int>")
    assert sorted(r.labels for r in collate.collate(labels, "b", drop_start=7).collect()) == [[1, -100], [2, 3]]


def test_files(spark, tmp_path):
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.array([[16384, 0], [-32768, -32768]], "<i2").tobytes())
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.wav").write_bytes(buf.getvalue())
    (tmp_path / "a" / "bad.wav").write_bytes(b"no")
    got = {r.stem: r for r in readers.read_wavs(spark, str(tmp_path)).collect()}
    assert list(got["x"]["array"]) == [0.25, -1.0] and got["x"].sampling_rate == 8000 and got["bad"].error
    assert {r.stem: r.length for r in readers.list_files(spark, str(tmp_path)).collect()}["bad"] == 2
    (tmp_path / "t.txt").write_text(" en \nto\n")
    assert sorted(tuple(r) for r in readers.read_lines(spark, str(tmp_path / "t.txt")).collect()) == [(1, "en"), (2, "to")]
    assert readers.read_whole_texts(spark, str(tmp_path / "t.txt")).first().stem == "t"
    for s in ("train", "test"):
        (tmp_path / f"{s}.tsv").write_text("id\tx\n1\t2\n")
    assert readers.read_splits_tsv(spark, {s: str(tmp_path / f"{s}.tsv") for s in ("train", "test")}, "id int, x int").count() == 2
    sinks.write_dataset(spark.createDataFrame([(1, "train"), (2, "val")], "id int, split string"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    sinks.write_dataset(spark.createDataFrame([(1, "train")], "id int, split string"), str(tmp_path / "hub" / "d" / "train"))
    assert readers.read_dataset(spark, str(tmp_path / "hub"), "d", "test").count() == 1
    assert sinks.score_file_name("a/b.c", "d::e", True) == "a--b-c-no-lm.d-e.csv"


def test_stream_equals_batch(spark, tmp_path):
    from taleflow.streaming.clean import clean_stream

    df = spark.createDataFrame([("Øh Hej  du", None), ("nej", "rejected"), (" ", "ok")], "text string, validated string")
    df.write.parquet(str(tmp_path / "in"))
    q = clean_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("cleaned").start()
    q.processAllAvailable()
    q.stop()
    assert [r.clean_text for r in spark.sql("select clean_text from cleaned").collect()] == ["hej du"]
