"""Splits by speaker membership and the search for split speakers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ("gender", "dialect", "age_group")


def split_by_speaker(df: DataFrame, speaker: str, test: DataFrame, val: DataFrame) -> DataFrame:
    """Column split: test, val, else train. The speaker sets (one column each) must not meet."""
    t, v = (x.toDF(speaker).distinct() for x in (test, val))
    if not t.join(v, speaker, "left_semi").isEmpty():
        raise ValueError("speakers in both test and val")
    marks = t.withColumn("__split", F.lit("test")).union(v.withColumn("__split", F.lit("val")))
    return df.join(marks, speaker, "left").withColumn("split", F.coalesce("__split", F.lit("train"))).drop("__split")


def speaker_profile(samples: DataFrame, speaker: str = "speaker_id", order: str = "id_recording", error: str = "asr_cer") -> DataFrame:
    """Per speaker: rows, sum of the error rate, and the features of its first row by ``order``."""
    first = [F.min_by(f, order).alias(f) for f in FEATURES]
    return samples.filter(F.col(speaker).isNotNull()).groupBy(speaker).agg(F.count("*").alias("n"), F.sum(error).alias("cer_sum"), F.min(order).alias("first_row"), *first)


def feature_shares(profile: DataFrame) -> DataFrame:
    """Count and share of every value of every feature: feature, value, n, share."""
    long = profile.select("n", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])).alias("x"))
    per = long.select("x.feature", "x.value", "n").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("feature")  # a few values per feature
    return per.withColumn("share", F.col("n") / F.sum("n").over(w))


def share_spread(shares: DataFrame) -> DataFrame:
    """Sum over features of the population variance of the shares."""
    return shares.groupBy("feature").agg(F.var_pop("share").alias("v")).agg(F.sum("v").alias("spread"))


def _draw(requirements: dict[str, dict[str, float]], low: int, high: int, with_replacement: bool):
    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(int(key[0]))
        rows = rows.sort_values("first_row", ignore_index=True)
        n_of, speakers = rows["n"].to_numpy(), rows["speaker_id"].to_numpy()
        # speakers of equal features have equal scores: draw the cell, then a speaker of the cell evenly
        groups = rows.groupby(list(FEATURES), dropna=False, sort=True)
        code = groups.ngroup().to_numpy()
        order = np.argsort(code, kind="stable")
        members = np.split(order, np.cumsum(np.bincount(code))[:-1])
        cells = [tuple(rows[f].iloc[m[0]] for f in FEATURES) for m in members]
        left = np.array([len(m) for m in members])
        counts = {f: dict.fromkeys(requirements.get(f, {}), 0.0) for f in FEATURES}
        chosen, n = [], 0

        def unmet():
            return n < low or any(counts[f][v] < n * r for f in FEATURES for v, r in requirements.get(f, {}).items())

        while unmet() and len(chosen) < len(rows) and n < high:
            score = np.zeros(len(cells))
            for i, f in enumerate(FEATURES):
                weight = {v: max(1 - (counts[f][v] / n if n else 0) / r, 1e-6) if r else 1e-6 for v, r in requirements.get(f, {}).items()}
                score += np.array([weight.get(c[i], 1e-6) for c in cells])
            score *= left
            cell = int(rng.choice(len(cells), p=score / score.sum()))
            at, m = int(rng.integers(left[cell])), members[cell]
            i = m[at]
            if not with_replacement:
                left[cell] -= 1
                m[at], m[left[cell]] = m[left[cell]], m[at]
            chosen.append(i)
            n += int(n_of[i])
            for f, v in zip(FEATURES, cells[cell]):
                if v in counts[f]:
                    counts[f][v] += n_of[i]
        picked = rows.iloc[chosen]
        # every value of the table counts for the spread, also one that was not drawn
        spread = sum(np.var([picked.loc[picked[f] == v, "n"].sum() / max(n, 1) for v in rows[f].dropna().unique()] or [0.0]) for f in FEATURES)
        difficulty = picked["cer_sum"].sum() / n if n else 0.0
        out = (int(key[0]), sorted(speakers[chosen]), n, float(difficulty), float(spread), bool(n < high and not unmet()))
        return pd.DataFrame([out], columns=["seed", "speakers", "n", "difficulty", "spread", "ok"])

    return search


def split_candidates(
    spark, profile: DataFrame, requirements: dict[str, dict[str, float]], low: int, high: int, seeds: int = 64, banned: list[str] | DataFrame | None = None, with_replacement: bool = False
) -> DataFrame:
    """Greedy candidates, one per seed: seed, speakers, n, difficulty, spread, ok.

    The profile has one row per speaker. It is never collected: each seed is
    a group of its own that holds the profile once. A speaker is drawn once
    unless ``with_replacement``; a candidate is not ok if it reached ``high``
    or ran out of speakers. ``banned`` speakers (a list, or a table with the
    column speaker_id) are never drawn.
    """
    if isinstance(banned, list):
        banned = spark.createDataFrame([(x,) for x in banned], "speaker_id string")
    if banned is not None:
        profile = profile.join(banned.select("speaker_id"), "speaker_id", "left_anti")
    rows = profile.select("speaker_id", "n", F.coalesce("cer_sum", F.lit(0.0)).alias("cer_sum"), *FEATURES, "first_row")
    schema = "seed long, speakers array<string>, n long, difficulty double, spread double, ok boolean"
    each = rows.withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(seeds - 1).cast("long"))))
    return each.groupBy("seed").applyInPandas(_draw(requirements, low, high, with_replacement), schema)


def search_splits(spark, profile: DataFrame, test: tuple, val: tuple, seeds: int = 64, k: int = 5) -> DataFrame:
    """Test and validation speakers: split, and the columns of ``best_split``; two rows, or none.

    ``test`` and ``val`` are (requirements, low, high). Of the ``k`` best test
    candidates the first wins that leaves a valid validation candidate without
    its speakers; of its validation candidates the best is taken.
    """
    tests = best_split(split_candidates(spark, profile, *test, seeds=seeds), k)
    # one small row per candidate, fixed so that no later action draws again
    for t in tests.collect():
        fixed = spark.createDataFrame([t], tests.schema)
        banned = fixed.select(F.explode("speakers").alias("speaker_id"))
        v = best_split(split_candidates(spark, profile, *val, seeds=seeds, banned=banned), 1)
        found = v.collect()
        if found:
            if set(t.speakers) & set(found[0].speakers):
                raise ValueError("speakers in both test and val")
            both = fixed.withColumn("split", F.lit("test")).union(spark.createDataFrame(found, v.schema).withColumn("split", F.lit("val")))
            return both.select("split", *tests.columns)
    return tests.limit(0).withColumn("split", F.lit("test")).select("split", *tests.columns)


def rank_sum(candidates: DataFrame, keys: list, tie: str, out: str = "rank") -> DataFrame:
    """Sum of the positions under several orders (Columns), ties by ``tie``. For tables as small as the candidates."""
    total = F.lit(0)
    for k in keys:
        total = total + F.row_number().over(Window.orderBy(k, tie))
    return candidates.withColumn(out, total)


def best_split(candidates: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best valid candidates: hard, short, even; equal speaker sets count once."""
    ok = candidates.filter("ok").groupBy("speakers").agg(F.min_by(F.struct("seed", "n", "difficulty", "spread"), "seed").alias("x")).select("speakers", "x.*")
    return rank_sum(ok, [F.desc("difficulty"), F.asc("n"), F.asc("spread")], "seed").orderBy("rank", "seed").limit(k)
