"""Splits that keep related records together.

Records that share an entity, directly or through a chain, form a component,
found by alternating large-star and small-star. A component goes to one split
as a whole: by the place of its hashed identifier among the components of its
stratum, cut into proportional ranges. A component that is large for its
stratum would burst any range it falls into; the few there can be are placed
first, where most room is left, and the ranges share out the rest. The price:
the split of those components follows from their size, not from their hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.prefix import prefix_sum
from ..plans.storage import materialise, release
from . import columns as C

SPLITS = (("train", 0.8), ("val", 0.1), ("test", 0.1))


def star_edges(rows: DataFrame, node: str, entity: str) -> DataFrame:
    """Edges (u, v) from every node of an entity to the entity's least node; linear in the rows."""
    pairs = rows.select(F.col(node).alias("u"), F.col(entity).alias("e")).filter("u is not null and e is not null").distinct()
    least = pairs.groupBy("e").agg(F.min("u").alias("v"))
    return pairs.join(least, "e").filter("u <> v").select("u", "v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Component of every node that has an edge: columns node, component (its least node).

    Alternates large-star and small-star until the edges are a set of stars,
    every node linked to its component's least node. Each round is written to
    the shared folder and replaces the one before; nothing is collected but
    one count and one hash sum.
    """
    edges = materialise(_small_star(edges.select("u", "v")), "edges")
    seen = None
    for _ in range(max_rounds):
        before, edges = edges, materialise(_small_star(_large_star(edges)), "edges")
        release(before)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v"))).distinct()


def speaker_components(samples: DataFrame) -> DataFrame:
    """Components of speakers tied by shared conversations; only speakers with a tie have a row."""
    rows = samples.filter("id_conversation is not null and speaker_id is not null").select(C.speaker(F.col("speaker_id")).alias("s"), C.conversation(F.col("id_conversation")).alias("c"))
    return components(star_edges(rows, "s", "c"))


def tied_speakers(samples: DataFrame) -> DataFrame:
    """All pairs of distinct speakers that must share a split: speaker_id_1 < speaker_id_2."""
    c = speaker_components(samples)
    a, b = (c.select(F.col("component"), F.col("node").alias(f"speaker_id_{i}")) for i in (1, 2))
    return a.join(b, "component").filter("speaker_id_1 < speaker_id_2").select("speaker_id_1", "speaker_id_2")


def assign_splits(samples: DataFrame, dialect_map: DataFrame, splits: tuple[tuple[str, float], ...] = SPLITS, large: float = 0.25) -> DataFrame:
    """One split per row: id_recording, speaker_id (canonical), component, dialect, split.

    All rows of a speaker, and of speakers tied by conversations, get one
    split; a row without a speaker is its own component by its id_recording
    (rows without either share one). Components are stratified by their most
    frequent dialect. A component's place is the running sum of rows over the
    hashed identifiers of its stratum, and the split is the range of the
    proportions that this place falls into. Components with more than
    ``large`` of the rows that the smallest split should get from the stratum
    (so at most 1 / (large * proportion) of them per stratum, at every size of
    the table) are placed first, largest first, where the stratum has most
    room left; the ranges are those of what is left. So a split misses its
    share of a stratum by little more than half of the largest component that
    is placed by its hash, unless a single component exceeds its split.
    Repeated rows stay and get the same split; an empty input gives an empty
    result; other columns are not read.
    """
    dialects = dialect_map.select(C.squeezed(F.col("sub_dialect")).alias("sub"), F.col("dialect").alias("to")).groupBy("sub").agg(F.min("to").alias("to"))
    rows = samples.select("id_recording", C.speaker(F.col("speaker_id")).alias("speaker_id"), C.squeezed(F.col("dialect")).alias("sub"))
    rows = rows.join(dialects, "sub", "left").select("id_recording", "speaker_id", F.coalesce("to", F.lit("unknown")).alias("dialect"))
    rows = rows.withColumn("unit", F.coalesce("speaker_id", F.concat(F.lit("row:"), F.coalesce("id_recording", F.lit("")))))
    # rows -> (unit, dialect) counts, combined before the shuffle
    counts = materialise(rows.groupBy("unit", "dialect").agg(F.count("*").alias("n")), "counts")
    comp = speaker_components(samples)
    units = counts.join(comp, counts.unit == comp.node, "left").withColumn("component", F.coalesce("component", "unit"))
    per = units.groupBy("component", "dialect").agg(F.sum("n").alias("n"))
    # a dialect that is known goes before a missing one
    whole = per.groupBy("component").agg(F.sum("n").alias("n"), F.max_by("dialect", F.struct(F.col("dialect") != "unknown", F.col("n"), F.col("dialect"))).alias("stratum"))
    whole = materialise(whole.withColumn("h", F.xxhash64("component")), "components")
    strata = {r.stratum: r.n for r in whole.groupBy("stratum").agg(F.sum("n").alias("n")).collect()}  # one row per dialect of the map
    spark = samples.sparkSession
    least = min(p for _, p in splits)
    limits = spark.createDataFrame([(s, large * least * n) for s, n in strata.items()], "stratum string, most double")
    sized = whole.join(limits, "stratum")
    big = sized.filter("n > most").orderBy(F.desc("n"), "component").collect()
    left = {(s, stratum): p * n for stratum, n in strata.items() for s, p in splits}
    placed = []
    for r in big:
        best = max(splits, key=lambda s: (left[s[0], r.stratum], s[1], s[0]))[0]
        left[best, r.stratum] -= r.n
        placed.append((r.component, best))
    # the ranges: shares of what is left per stratum
    ranges = []
    for stratum in strata:
        open_ = {s: max(left[s, stratum], 0.0) for s, _ in splits}
        whole_left = sum(open_.values()) or 1.0
        low = 0.0
        for i, (s, _) in enumerate(splits):
            high = low + open_[s] / whole_left if i + 1 < len(splits) else 2.0
            ranges.append((stratum, s, low, high))
            low = high
    range_df = spark.createDataFrame(ranges, "stratum string, split string, low double, high double")
    big_df = spark.createDataFrame(placed, "component string, split string")
    small = prefix_sum(sized.filter("n <= most").select("component", "stratum", "n", "h"), ["stratum"], "h", ["component"], "n", "before", buckets=64, total="all")
    at = (F.col("before") + F.col("n") / 2) / F.col("all")
    small = small.withColumn("at", at).join(range_df, "stratum").filter("at >= low and at < high").select("component", "split")
    choice = small.union(big_df)
    unit_split = units.select("unit", "component").distinct().join(choice, "component")
    return rows.join(unit_split, "unit").select("id_recording", "speaker_id", "component", "dialect", "split")


def split_report(assigned: DataFrame) -> DataFrame:
    """Rows per split and dialect, with the split's share of the dialect and of all rows."""
    per = assigned.groupBy("dialect", "split").agg(F.count("*").alias("n_rows"))
    by_dialect = per.groupBy("dialect").agg(F.sum("n_rows").alias("of_dialect"))
    by_split = per.groupBy("split").agg(F.sum("n_rows").alias("of_split"))
    return (
        per.join(by_dialect, "dialect")
        .join(by_split, "split")
        .crossJoin(by_split.agg(F.sum("of_split").alias("of_all")))
        .select("split", "dialect", "n_rows", F.round(F.col("n_rows") / F.col("of_dialect"), 6).alias("share_of_dialect"), F.round(F.col("of_split") / F.col("of_all"), 6).alias("split_share"))
    )


def split_check(assigned: DataFrame, samples: DataFrame, splits: tuple[tuple[str, float], ...] = SPLITS, tolerance: float = 0.02) -> DataFrame:
    """One row: n_rows assigned, speakers and conversations in more than one split, and whether every split's share is within the tolerance."""
    speakers = assigned.filter("speaker_id is not null").groupBy("speaker_id").agg(F.countDistinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_split_speakers"))
    ties = samples.select(C.speaker(F.col("speaker_id")).alias("speaker_id"), C.conversation(F.col("id_conversation")).alias("c")).filter("speaker_id is not null and c is not null").distinct()
    of = assigned.filter("speaker_id is not null").select("speaker_id", "split").distinct()
    conversations = ties.join(of, "speaker_id").groupBy("c").agg(F.countDistinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_split_conversations"))
    near = F.lit(True)
    for s, p in splits:
        near = near & (F.abs(F.count_if(F.col("split") == s) / F.count("*") - p) <= tolerance)
    whole = assigned.agg(F.count("*").alias("n_rows"), near.alias("shares_hold"))
    return whole.crossJoin(speakers).crossJoin(conversations).select("n_rows", "n_split_speakers", "n_split_conversations", "shares_hold")
