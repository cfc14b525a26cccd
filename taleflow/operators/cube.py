"""Score cube over categories, without redundant cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pruned_cube(df: DataFrame, categories: list[str], sums: dict[str, str]) -> DataFrame:
    """Sums per combination of category values or all (null), leaving out cells that repeat a larger one.

    A cell stays if fixing its categories one after the other, in order, each
    time strictly shrinks the rows. One scan: the rows are first counted per
    combination of values, and all cells, and the prefixes they are compared
    with, come from that small table. Rows with a null category count in the
    cells where that category is all, and give no cell of their own. Columns:
    the categories, n_rows and the sums.
    """
    k = len(categories)
    base = df.groupBy(*categories).agg(F.count("*").alias("n_rows"), *[F.sum(v).alias(o) for o, v in sums.items()])
    cells = base.cube(*categories).agg(F.sum("n_rows").alias("n_rows"), *[F.sum(o).alias(o) for o in sums], F.grouping_id().alias("__gid"))
    fixed = [F.col("__gid").bitwiseAND(1 << (k - 1 - i)) == 0 for i in range(k)]
    for c, f in zip(categories, fixed):
        cells = cells.filter(~f | F.col(c).isNotNull())
    # the prefix with the first i categories as in the cell and the rest all is the largest cell that agrees on those
    for i in range(k):
        agrees = Window.partitionBy(F.shiftright("__gid", k - i), *categories[:i])
        cells = cells.withColumn(f"__n_{i}", F.max("n_rows").over(agrees))
    keep = F.lit(True)
    for i in range(k):
        after = F.col(f"__n_{i + 1}") if i + 1 < k else F.col("n_rows")
        keep = keep & (~fixed[i] | (after < F.col(f"__n_{i}")))
    return cells.filter(keep).select(*categories, "n_rows", *sums)


def comparison(scores: DataFrame, model: str, dataset: str, group: str, value: str, strict: bool = True) -> DataFrame:
    """Mean over the data sets of each (model, group) that every data set has: model, group, mean.

    If ``strict``, models that are missing from a data set are an error.
    """
    models = scores.select(dataset, model).distinct()
    n = scores.agg(F.countDistinct(dataset).alias("n")).first().n  # a handful of data sets
    if strict:
        missing = models.groupBy(model).agg(F.count("*").alias("k")).filter(F.col("k") < n).orderBy(model).limit(5).collect()
        if missing:
            raise ValueError(f"not in every data set: {', '.join(str(r[0]) for r in missing)}")
    return scores.groupBy(model, group).agg(F.avg(value).alias("mean"), F.countDistinct(dataset).alias("n")).filter(F.col("n") == n).drop("n")


def selected_scores(cube: DataFrame, categories: list[str]) -> DataFrame:
    """group, and the sums of the cube, of the overall row and of the rows with one category fixed."""
    values = [c for c in cube.columns if c not in categories]
    n_fixed = sum((F.col(c).isNotNull().cast("int") for c in categories), F.lit(0))
    return cube.filter(n_fixed <= 1).select(F.coalesce(*[F.col(c) for c in categories], F.lit("overall")).alias("group"), *values)


def model_table(means: DataFrame, model: str, groups: list[str], order: str = "overall") -> DataFrame:
    """One row per model, one column per group, and the model's place by ``order``, greatest first, ties by name."""
    wide = means.groupBy(model).pivot("group", groups).agg(F.first("mean"))
    return wide.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(order), model)))  # one row per model
