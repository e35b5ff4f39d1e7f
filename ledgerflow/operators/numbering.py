"""Row numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A group up to this size is numbered in one task.
GROUP_ROWS = 1_000_000
# Keys are first counted together in this many buckets.
KEY_BUCKETS = 1 << 16


def crowded_keys(df: DataFrame, key: str, group_rows: int) -> DataFrame:
    """The keys with more than ``group_rows`` rows, at most one per ``group_rows`` rows of ``df``.

    Only a bucket that is crowded itself can hold such a key, so the keys of all other buckets
    are never shuffled.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).alias("_bucket")
    full = df.groupBy(bucket).count().filter(F.col("count") > group_rows).select("_bucket")
    inside = df.select(key, bucket).join(F.broadcast(full), "_bucket", "left_semi")
    return inside.groupBy(key).count().filter(F.col("count") > group_rows).select(key)


def number_rows(
    df: DataFrame, key: str, order: list[str], part: str, name: str, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Add ``name``: the place of a row in its group, from 0, in the given order.

    A group with more than ``group_rows`` rows is numbered in parts. ``part`` is an
    expression that never falls along the order, so the parts of a group follow each
    other and a row's place is its place in the part plus the rows of the parts
    before, which come from one small row per part. All other groups are dealt by
    ``key`` alone, so where none is crowded a join on ``key`` needs no further shuffle.
    """
    crowded = F.broadcast(crowded_keys(df, key, group_rows))
    usual = df.join(crowded, key, "left_anti")
    large = df.join(crowded, key, "left_semi").withColumn("_part", F.expr(part))
    before = (
        large.groupBy(key, "_part")
        .count()
        .selectExpr(
            f"{key} AS _key",
            "_part AS _of",
            f"""coalesce(sum(count) OVER (PARTITION BY {key} ORDER BY _part
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before""",
        )
    )

    def place(within: str) -> Column:
        return F.expr(f"row_number() OVER (PARTITION BY {within} ORDER BY {', '.join(order)}) - 1")

    in_parts = large.withColumn("_place", place(f"{key}, _part")).join(
        before, (F.col(key) == F.col("_key")) & F.col("_part").eqNullSafe(F.col("_of"))
    )
    return usual.select(*df.columns, place(key).cast("int").alias(name)).unionByName(
        in_parts.select(*df.columns, (F.col("_place") + F.col("_before")).cast("int").alias(name))
    )
