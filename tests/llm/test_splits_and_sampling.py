import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from taleflow.llm import columns as C
from taleflow.llm import sampling, splits

SAMPLE = "id_recording string, speaker_id string, id_conversation string, dialect string, gender string, age int"


def spk(i, style=0):
    h = f"{i:032x}"
    return [f"spe_{h}", f" SPE-{h.upper()}", h, f"spe_{h}\t"][style % 4]


def test_components_against_union_find(spark):
    rng = random.Random(2)
    for n, m in ((30, 20), (60, 90), (1, 0)):
        edges = [(f"n{rng.randrange(n):03d}", f"n{rng.randrange(n):03d}") for _ in range(m)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
        edges = [(a, b) for a, b in edges if a != b]
        up = {}

        def root(a):
            while up.setdefault(a, a) != a:
                a = up[a]
            return a

        for a, b in edges:
            up[root(a)] = root(b)
        want = defaultdict(set)
        for a in list(up):
            want[root(a)].add(a)
        got = defaultdict(set)
        for r in splits.components(spark.createDataFrame(edges, "u string, v string")).collect():
            got[r.component].add(r.node)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
        assert all(k == min(v) for k, v in got.items())


def test_tied_speakers(spark):
    rows = [("r1", spk(1), "con_1"), ("r2", spk(2, 1), "CON_1 "), ("r3", spk(2, 2), "con_2"), ("r4", spk(3, 3), "con_2"), ("r5", spk(4), None), ("r6", None, "con_1"), ("r1", spk(1), "con_1"), ("r7", spk(5), "con_9")]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SAMPLE).withColumns({"node": F.lit("x"), "component": F.lit("y"), "u": F.lit(1)})
    assert sorted(tuple(r) for r in splits.tied_speakers(df).collect()) == [(spk(1), spk(2)), (spk(1), spk(3)), (spk(2), spk(3))]
    assert splits.tied_speakers(df.limit(0)).collect() == []


def test_assigned_splits(spark):
    rng = random.Random(1)
    rows = [(f"r{i}", spk(rng.choice([0] * 30 + list(range(1, 400))), i), f"con_{rng.randrange(60)}" if i % 9 == 0 else None, rng.choice(["a", "b", " A ", None]), None, None) for i in range(4000)]
    rows += [("r0x", None, None, None, None, None), (None, None, None, None, None, None), rows[0]]
    df = spark.createDataFrame(rows, SAMPLE)
    m = spark.createDataFrame([("a", "Aa"), ("b", "Bb")], "sub_dialect string, dialect string")
    out = splits.assign_splits(df, m).collect()
    assert len(out) == len(rows)
    of = defaultdict(set)
    for r in out:
        of[r.component].add(r.split)
    assert all(len(x) == 1 for x in of.values())
    of_speaker = defaultdict(set)
    for r in out:
        if r.speaker_id:
            of_speaker[r.speaker_id].add(r.split)
    assert all(len(x) == 1 for x in of_speaker.values())
    n = Counter(r.split for r in out)
    assert abs(n["train"] / len(out) - 0.8) < 0.03 and abs(n["val"] / len(out) - 0.1) < 0.02 and abs(n["test"] / len(out) - 0.1) < 0.02
    assert splits.assign_splits(df.limit(0), m).collect() == []


def test_shares_of_every_dialect(spark):
    # few speakers of very different sizes, and one of a third of all rows
    rng = random.Random(7)
    rows = [(f"h{i}", spk(0), None, "a", None, None) for i in range(2500)]
    for d, speakers, size in (("a", 60, 60), ("b", 25, 40), ("c", 14, 50)):
        for k in range(speakers):
            rows += [(f"{d}{k}_{i}", spk(ord(d) * 1000 + k + 1), f"con_{d}{k // 3}" if k % 7 == 0 else None, d, None, None) for i in range(max(1, int(size * rng.random() ** 2)))]
    df = spark.createDataFrame(rows, SAMPLE)
    m = spark.createDataFrame([(x, x.upper()) for x in "abc"], "sub_dialect string, dialect string")
    got = splits.split_report(splits.assign_splits(df, m)).collect()
    share = {(r.dialect, r.split): r.share_of_dialect for r in got}
    for d in "BC":
        for s, p in splits.SPLITS:
            assert abs(share.get((d, s), 0) - p) < 0.05, (d, s, share)
    assert share["A", "train"] > 0.75  # the large speaker fills it


def test_canonical_fields(spark):
    df = spark.createDataFrame([("Kvinde", 0, "Training ", "NST-stor_lyd "), ("non-binary", 110, "dev_x", "forum_da"), ("ukendt", 111, "x", None), (None, None, None, "")], "g string, a int, s string, o string")
    got = df.select(C.gender(F.col("g")), C.age_group(F.col("a")), C.split_role(F.col("s")), C.source(F.col("o"))).collect()
    assert [tuple(r) for r in got] == [("female", None, "train", "nst_stor_lyd"), ("nonbinary", "50-", "eval", "forum"), (None, None, None, None), (None, None, None, "")]


TARGETS = "plan_id int, category string, cat_value string, target_share double, min_count int, draw_share double"


def test_sample_matches_targets(spark):
    rng = random.Random(4)
    rows = [(f"r{i}", None, None, rng.choice(["a", "b"]), rng.choice(["f", "M", "m", "mand"]) if i % 50 else "nb", rng.choice([20, 30, 60, None, 999])) for i in range(3000)]
    df = spark.createDataFrame(rows + rows[:40] + [(None, None, None, "a", "f", 20)], SAMPLE)
    m = spark.createDataFrame([("a", "Aa"), ("b", "Bb")], "sub_dialect string, dialect string")
    t = spark.createDataFrame([(1, "gender", "female", 0.5, 1, 0.2), (1, "gender", "male", 0.4, 1, 0.2), (1, "gender", "nonbinary", 0.1, 90, 0.2), (2, "age_group", "50-", 0.1, 25, 0.01), (2, "dialect", "Zz", 0.1, 1, 0.1)], TARGETS)
    assert sorted(tuple(r) for r in sampling.unmet_targets(df, t, m).collect()) == [(1, "nonbinary"), (2, "Zz")]
    drawn = sampling.draw(df, t, m, buckets=8).collect()
    assert len({(r.plan_id, r.id_recording) for r in drawn}) == len(drawn)
    n = Counter((r.plan_id, r.cat_value) for r in drawn)
    assert abs(n[1, "female"] - 300) <= 1 and abs(n[1, "male"] - 240) <= 1 and n[1, "nonbinary"] == 60 and n[2, "50-"] == 25
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, sampling.draw(df.repartition(7), t, m, buckets=8).collect()))
    assert sampling.draw(df.limit(0), t, m).collect() == []
    assert {(r.plan_id, r.cat_value) for r in sampling.sample_report(df, t, m).filter("not met").collect()} == {(1, "nonbinary"), (2, "Zz")}


def test_shares_hold_where_a_value_is_short(spark):
    rows = [(f"r{i}", None, None, None, "f" if i % 10 == 0 else "m", 30) for i in range(2000)]
    df = spark.createDataFrame(rows, SAMPLE)
    m = spark.createDataFrame([("a", "Aa")], "sub_dialect string, dialect string")
    t = spark.createDataFrame([(1, "gender", "female", 0.5, 1, 0.5), (1, "gender", "male", 0.5, 1, 0.5), (1, "gender", "male", 0.5, 1, 0.5), (2, "gender", "nonbinary", 0.5, 3, 0.1), (2, "gender", "male", 0.5, 3, 0.1)], TARGETS)
    loose = {(r.plan_id, r.cat_value): r for r in sampling.sample_report(df, t, m).collect()}
    assert loose[1, "female"].n_drawn == 200 and loose[1, "male"].n_drawn == 500 and not loose[1, "female"].met and loose[1, "male"].met
    kept = {(r.plan_id, r.cat_value): r for r in sampling.sample_report(df, t, m, keep_shares=True).collect()}
    assert kept[1, "female"].n_drawn == 200 == kept[1, "male"].n_drawn and kept[1, "male"].actual_share == 0.5 and not kept[1, "male"].met
    assert kept[2, "male"].n_drawn in (99, 100, 101) and kept[2, "nonbinary"].n_drawn == 0 and not kept[2, "nonbinary"].met


def test_sampling_of_disagreeing_repeats_and_many_targets(spark):
    rows = [(f"r{i}", None, None, None, g, 30) for i in range(300) for g in ("f", "m")]
    df = spark.createDataFrame(rows, SAMPLE)
    m = spark.createDataFrame([("a", "Aa")], "sub_dialect string, dialect string")
    t = spark.createDataFrame([(1, "gender", "female", 0.5, 300, 1.0), (1, "gender", "male", 0.5, 301, 1.0)], TARGETS)
    assert [tuple(r) for r in sampling.unmet_targets(df, t, m).collect()] == [(1, "male")]
    many = spark.range(100_500).selectExpr("cast(id as int) as plan_id", "'gender' as category", "if(id % 2 = 0, 'male', 'zz') as cat_value", "0.01D as target_share", "0 as min_count", "1.0D as draw_share")
    r = sampling.sample_report(df, many, m).groupBy("met").agg(F.count("*").alias("n"), F.sum("n_drawn").alias("k")).collect()
    assert {x.met: x.n for x in r} == {True: 50_250, False: 50_250} and abs(sum(x.k for x in r) - 3 * 50_250) < 50_250
