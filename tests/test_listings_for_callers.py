"""A listing for its callers: the rows of a plain join, given by many tasks however few the stores."""

from collections import Counter

from pyspark.sql import functions as F

from stockroom.operators import access as A


def test_one_store_is_listed_by_several_tasks(spark):
    listing = spark.range(0, 3_000, 1, 1).select("id", F.lit(1).cast("bigint").alias("store_id"))
    callers = spark.range(0, 600, 1, 1).select(F.col("id").alias("user_id"), F.lit(1).cast("bigint").alias("store_id"))
    rows, _ = A.for_callers(listing, callers, callers.withColumn("role", F.lit("staff")), "list_products")
    tasks = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 1_800_000 and max(tasks) <= 900_000


def test_blocks_give_the_rows_of_a_plain_join(spark):
    # store 1 in many blocks, 2 in one, 3 without callers, 4 without rows, null nowhere; rows and ids repeat
    left = ([(i % 150, 1, f"n{i % 70}") for i in range(300)] + [(None, 1, None)] * 40 + [(1, 2, "a"), (2, 3, "b")]
            + [(3, None, "c")])
    right = [(u, 1) for u in range(95)] + [(None, 1), (7, 2), (8, 2), (8, 4), (9, None)] + [(5, 1)] * 3
    got = A.pairs_by_blocks(spark.createDataFrame(left, "id long, store_id long, name string"),
                            spark.createDataFrame(right, "caller_id long, store_id long"), "store_id", 20, 30)
    want = Counter((c, i, s, n) for i, s, n in left for c, q in right if s is not None and s == q)
    assert Counter(map(tuple, got.select("caller_id", "id", "store_id", "name").collect())) == want


def test_empty_sides_give_no_rows(spark):
    rows = spark.createDataFrame([(1, 1)], "id long, store_id long")
    callers = spark.createDataFrame([(1, 1)], "caller_id long, store_id long")
    for left, right in ((rows.limit(0), callers), (rows, callers.limit(0))):
        got = A.pairs_by_blocks(left, right, "store_id")
        assert got.collect() == [] and set(got.columns) == {"id", "store_id", "caller_id"}
