"""Pages of ordered rows per group, the first ones and far ones.

A page near the start comes from a window whose ``row_number <= k`` Spark turns
into a limit per group before the shuffle. Far from the start that limit would
gather all rows before the page in one task (and ``OFFSET`` all of them on the
driver), so a far page is found by rank: the order's columns are range-partitioned
into runs, the rows of each run are counted per group, and only the runs that the
page touches are ranked, each by itself. Both ways give the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import check_paging
from .lineage import cut

# Pages that end beyond this rank of their group are found by range partitions.
NEAR_ROWS = 1_000


def page_of_each(df: DataFrame, part: list[str], order: list[Column], columns: list[str], page_no: int, limit: int,
                 near_rows: int = NEAR_ROWS) -> DataFrame:
    """Rows ``(page-1)*limit+1 .. page*limit`` of each ``part`` group (all rows, if empty) in ``order``.

    ``columns`` are those that ``order`` reads; the last of them is a unique key
    of ``df``. A group that ends before the page gives no row.
    """
    page_no, limit = check_paging(page_no, limit)
    lo, hi = (page_no - 1) * limit, page_no * limit
    if hi > near_rows:
        return _by_rank(df, part, order, columns, lo, hi)
    w = Window.partitionBy(*part).orderBy(*order)
    return (df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= hi)
            .filter(F.col("_rn") > lo).drop("_rn"))


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"{c}__"]) for c in columns])


def _by_rank(df: DataFrame, part: list[str], order: list[Column], columns: list[str], lo: int, hi: int) -> DataFrame:
    # only the order's columns are moved; checkpointed, so that all uses see the same runs
    keys = df.select(*dict.fromkeys([*part, *columns]))
    keys = cut(keys.repartitionByRange(*part, *order).withColumn("_run", F.spark_partition_id()))
    sizes = keys.groupBy("_run", *part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*part).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    touched = sizes.filter((F.col("_before") < hi) & (F.col("_before") + F.col("_n") > lo))
    touched = touched.select("_before", *[F.col(c).alias(f"{c}__") for c in ("_run", *part)])
    rows = keys.join(touched, _same(keys, touched, ["_run", *part]))
    # explicitly by (run, group): rows that lie by group would otherwise be ranked where a hot group lies whole
    rank = F.row_number().over(Window.partitionBy("_run", *part).orderBy(*order)) + F.col("_before")
    rows = rows.repartition("_run", *part).withColumn("_rank", rank)
    page = rows.filter((F.col("_rank") > lo) & (F.col("_rank") <= hi)).select(F.col(columns[-1]).alias(f"{columns[-1]}__"))
    return df.join(page, _same(df, page, columns[-1:]), "left_semi")
