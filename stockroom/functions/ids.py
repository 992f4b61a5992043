"""New keys above a table's largest, numbered without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

# number_within: so many rows of a key at most in one cell of a join.
RUN_ROWS = 100_000


def largest(df: DataFrame, column: str = "id") -> int:
    """The largest value of a key column (0 for an empty table): one partial-aggregate job."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).cast("bigint")).first()[0]


def number_within(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Add ``name`` = 0, 1, ... in ``order`` among the rows of one ``key``.

    The rows of a key may lie in any number of tasks: they are numbered as one
    range-sorted run (:func:`number_rows`), less the key's first number, which
    meets them in runs of RUN_ROWS numbers. Rows without a key are left out.
    """
    placed = (number_rows(df.filter(F.col(key).isNotNull()), [key, *order], "_number")
              .withColumn("_run", F.expr(f"_number div {RUN_ROWS}")))
    first = placed.groupBy(key, "_run").agg(F.min("_number").alias("_first"))
    first = first.withColumn("_first", F.min("_first").over(Window.partitionBy(key)))
    return (placed.join(first, [key, "_run"]).withColumn(name, (F.col("_number") - F.col("_first")).cast("bigint"))
            .drop("_number", "_first", "_run"))


def number_rows(df: DataFrame, order: list[str | Column] | None, name: str, above: int = 0,
                weight: str | None = None) -> DataFrame:
    """Add ``name`` = ``above`` + 1, 2, ... in ``order`` (None: any order, and no shuffle).

    The rows are range-sorted and checkpointed, so the numbers can't change
    when a lost task is run again. A row's number is its partition's offset --
    a running sum over one row per partition -- plus its place there. With
    ``weight``, ``{weight}_before`` is that column's sum over all rows with lower
    numbers, found the same way.
    """
    if order is not None:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(df.withColumn("_place", F.monotonically_increasing_id()))  # partition << 33 | place
    placed = placed.withColumn("_part", F.shiftright("_place", 33).cast("int"))
    sums = [F.count(F.lit(1)).alias("_n")] + ([F.sum(weight).alias("_w")] if weight else [])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(*sums).select("_part", *[
        F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_offset") for c in ("_n", "_w")[:len(sums)]])
    number = F.lit(above) + F.col("_n_offset") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    out = placed.join(offsets, "_part").withColumn(name, number.cast("bigint"))
    if weight:
        inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        inner = F.coalesce(F.sum(weight).over(inside), F.lit(0))
        out = out.withColumn(f"{weight}_before", (F.col("_w_offset") + inner).cast("bigint")).drop("_w_offset")
    return out.drop("_place", "_part", "_n_offset")
