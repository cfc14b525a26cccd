"""Samples whose category shares match target proportions.

Systematic sampling with unequal probabilities: the records of a plan lie in
random (hashed) order within their sorted category values; a record's place is
the prefix sum of the inclusion probabilities before it; one random start per
plan selects every record in whose probability an integer falls. A value that
then holds fewer than its floor is filled up in its random order. A target is
unmet where the draw took every record of its value and still has too few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.prefix import prefix_sum
from ..plans.storage import materialise
from . import columns as C

CATEGORIES = ("gender", "dialect", "age_group")


def category_values(samples: DataFrame, dialect_map: DataFrame) -> DataFrame:
    """One row per distinct id_recording with the sets of its gender, dialect and age_group values.

    Values that fit nothing, and nulls, are left out; a null id_recording is
    no record. Repeats of a record are combined before the shuffle.
    """
    dialects = dialect_map.select(C.squeezed(F.col("sub_dialect")).alias("sub"), F.col("dialect").alias("to")).groupBy("sub").agg(F.min("to").alias("to"))
    rows = samples.filter("id_recording is not null").select("id_recording", C.gender(F.col("gender")).alias("gender"), C.age_group(F.col("age")).alias("age_group"), C.squeezed(F.col("dialect")).alias("sub"))
    rows = rows.join(dialects, "sub", "left").withColumnRenamed("to", "dialect")
    sets = [F.array_sort(F.collect_set(c)).alias(c) for c in CATEGORIES]
    return rows.groupBy("id_recording").agg(*sets)


def _long(values: DataFrame) -> DataFrame:
    """One row per record and value: id_recording, category, cat_value."""
    x = values.select("id_recording", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("vs")) for c in CATEGORIES])).alias("x"))
    return x.select("id_recording", "x.category", F.explode("x.vs").alias("cat_value"))


def _plan(targets: DataFrame, values: DataFrame, keep_shares: bool, seed: int) -> DataFrame:
    """Targets with what there is and what is wanted, the inclusion probability and the place of the value on the plan's line.

    As many rows as targets, and written before use, so that its size decides
    how it is joined: the records have few values, and a shuffle by value
    would put a third of them into one task. A target given twice counts once, with its
    greatest share and floor.
    """
    counts = _long(values).groupBy("category", "cat_value").agg(F.count("*").alias("n_have"))
    n_all = values.agg(F.count("*").alias("n_all"))
    t = targets.groupBy("plan_id", "category", "cat_value").agg(
        F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("min_count"), F.lit(0)).alias("min_count"), F.coalesce(F.max("draw_share"), F.lit(0.0)).alias("draw_share")
    )
    out = t.join(counts, ["category", "cat_value"], "left").crossJoin(n_all).fillna(0, ["n_have"])
    share = F.col("target_share") * F.col("draw_share") * F.col("n_all")
    out = out.withColumn("n_want", F.greatest(F.col("min_count").cast("double"), share))
    if keep_shares:
        # the draw shrinks until its scarcest value suffices, so that all shares hold
        most = F.when((share > 0) & (F.col("n_have") > 0), F.col("n_have") / share)
        share = share * F.least(F.lit(1.0), F.coalesce(F.min(most).over(Window.partitionBy("plan_id", "category")), F.lit(1.0)))
    p = F.when(F.col("n_have") > 0, F.least(F.lit(1.0), share / F.col("n_have"))).otherwise(0.0)
    line = Window.partitionBy("plan_id").orderBy("category", "cat_value").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("p", p).withColumn("base", F.coalesce(F.sum(F.col("p") * F.col("n_have")).over(line), F.lit(0.0)))
    start = F.pmod(F.xxhash64("plan_id", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return out.withColumn("base", F.col("base") + start)


def _drawn(values: DataFrame, plan: DataFrame, seed: int, buckets: int) -> DataFrame:
    wanted = plan.filter("n_have > 0").select("plan_id", "category", "cat_value", "p", "base", "min_count", "n_have")
    long = _long(values).join(wanted.select("category", "cat_value").distinct(), ["category", "cat_value"], "left_semi")
    long = long.withColumns({"h": F.xxhash64("id_recording", F.lit(seed)), "one": F.lit(1)})
    ranked = prefix_sum(long, ["category", "cat_value"], "h", ["id_recording"], "one", "rank", buckets)
    rows = ranked.join(wanted, ["category", "cat_value"])
    # what was summed before the record, and with it; an integer between the two selects it
    at = F.floor(F.col("base") + F.col("rank") * F.col("p"))
    crossed = F.floor(F.col("base") + (F.col("rank") + 1) * F.col("p")) > at
    first = F.floor("base")
    taken = F.floor(F.col("base") + F.col("n_have") * F.col("p")) - first
    # the floor's missing records are the first of the value that were not selected
    missing = F.greatest(F.least(F.col("min_count"), F.col("n_have")) - taken, F.lit(0))
    repaired = ~crossed & (F.col("rank") - (at - first) < missing)
    rows = rows.withColumns({"hit": crossed, "repaired": repaired}).filter("hit or repaired")
    return rows.select("plan_id", "category", "cat_value", "id_recording", "repaired")


def draw(samples: DataFrame, targets: DataFrame, dialect_map: DataFrame, seed: int = 42, buckets: int = 64, keep_shares: bool = False) -> DataFrame:
    """The drawn records: plan_id, category, cat_value, id_recording, repaired (added for a floor).

    Each value of a plan gets ``target_share * draw_share * N`` records, never
    more than it has and, where it has them, at least ``min_count``. A value
    that has too few leaves the sample smaller and its share too low; with
    ``keep_shares`` the whole draw of that category shrinks in proportion
    instead, so that the shares hold (a value without any record cannot be
    made up for). A record with several values of a category (repeats that
    disagree) stands under each of them. Ties of the hash are broken by
    id_recording. An empty table gives an empty sample.
    """
    values = materialise(category_values(samples, dialect_map), "category-values")
    return _drawn(values, materialise(_plan(targets, values, keep_shares, seed), "plan"), seed, buckets)


def sample_report(samples: DataFrame, targets: DataFrame, dialect_map: DataFrame, seed: int = 42, buckets: int = 64, keep_shares: bool = False) -> DataFrame:
    """Per target: records there are, wanted and drawn, the drawn share of its plan and category, and whether it is met.

    A target is met unless the draw took all records of the value and they are
    fewer than wanted. With ``keep_shares`` the shrunk draw decides.
    """
    values = materialise(category_values(samples, dialect_map), "category-values")
    plan = materialise(_plan(targets, values, keep_shares, seed), "plan")
    drawn = _drawn(values, plan, seed, buckets).groupBy("plan_id", "category", "cat_value").agg(F.count("*").alias("n_drawn"), F.sum(F.col("repaired").cast("int")).alias("n_repaired"))
    out = plan.join(drawn, ["plan_id", "category", "cat_value"], "left").fillna(0, ["n_drawn", "n_repaired"])
    out = out.withColumn("of_plan", F.sum("n_drawn").over(Window.partitionBy("plan_id", "category")))
    short = (F.col("n_drawn") < F.col("n_want")) & (F.lit(keep_shares) | (F.col("n_drawn") == F.col("n_have")))
    return out.select(
        "plan_id", "category", "cat_value", "n_have", F.round("n_want", 3).alias("n_want"), "n_drawn", "n_repaired", "target_share",
        F.round(F.try_divide(F.col("n_drawn"), F.col("of_plan")), 6).alias("actual_share"), (~short).alias("met"),
    )


def unmet_targets(samples: DataFrame, targets: DataFrame, dialect_map: DataFrame) -> DataFrame:
    """Targets that the draw could not meet: plan_id, cat_value."""
    return sample_report(samples, targets, dialect_map).filter("not met").select("plan_id", "cat_value").distinct()
