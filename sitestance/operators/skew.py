"""Joins and windows that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_KEYS = 64
SALTS = 32
# Keys counted per sketch, and tasks that merge sketches.
TRACKED_KEYS = 512
MERGERS = 256
# Below this many rows one task can hold them all.
PLAIN_ROWS = 200_000

_ATOMIC = (
    T.StringType, T.LongType, T.IntegerType, T.TimestampType, T.DateType, T.BooleanType,
    T.DoubleType, T.BinaryType,
)


def hot_keys(df: DataFrame, key: str, k: int = HOT_KEYS) -> list:
    """At most ``k`` of the most frequent keys, merged in two levels.

    Every task keeps a sketch of bounded size, a few hundred tasks merge those, and
    their best candidates are added up; so no single task merges all sketches.  An
    estimate is enough, since it only decides which keys are spread out and never
    which rows are kept.  The list becomes part of the plan, so both sides of a join
    spread the same keys even when a lost executor makes Spark work a side out again.
    """
    dealt = df.select(key, F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("_part"))
    tops = dealt.groupBy("_part").agg(
        F.expr(f"approx_top_k(`{key}`, {k}, {TRACKED_KEYS})").alias("top")
    )
    items = tops.select(F.explode("top").alias("t")).select(
        F.col("t.item").alias(key), F.col("t.count").alias("_n")
    )
    best = (
        items.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.sum("_n").alias("_n"))
        .orderBy(F.desc("_n"))
        .limit(k)
    )
    return [row[key] for row in best.collect()]


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    salts: int = SALTS,
    spread: list[str] | None = None,
    hot: list | None = None,
) -> DataFrame:
    """Join many ``left`` rows to the one ``right`` row with the same key.

    The most frequent keys of ``left`` are spread over ``salts`` partitions and
    their (at most ``HOT_KEYS``) ``right`` rows are copied to each.  Rows without a
    key are spread too.  Whether the small side is broadcast is left to the size
    check of the optimizer, at run time as well.  ``hot`` takes the keys when the
    caller has them already.
    """
    names = spread or [
        f.name for f in left.schema if isinstance(f.dataType, _ATOMIC) and f.name != key
    ] or [key]
    hot = hot_keys(left, key) if hot is None else hot
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    draw = F.pmod(F.xxhash64(*[F.col(n) for n in names]), F.lit(salts)).cast("int")
    salted_left = left.withColumn(
        "_salt", F.when(is_hot | F.col(key).isNull(), draw).otherwise(F.lit(0))
    )
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_right = right.withColumn("_salt", F.explode(copies))
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")


def counted_join(
    left: DataFrame, left_rows: int, right: DataFrame, key: str, spread: list[str]
) -> DataFrame:
    """Left join; keys are spread only when ``left`` has rows enough to be uneven."""
    if left_rows <= PLAIN_ROWS:
        return left.join(right, key, "left")
    return lookup_join(left, right, key, spread=spread)


def broadcast_if_small(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """Mark ``df`` for broadcast only after counting at most ``max_rows`` rows of it."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df), True) if small else (df, False)


def small_or_lookup_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "left", max_rows: int = 200_000
) -> DataFrame:
    """Broadcast ``right`` when its size is proven small, otherwise :func:`lookup_join`."""
    hinted, small = broadcast_if_small(right, max_rows)
    return left.join(hinted, key, how) if small else lookup_join(left, right, key, how)


def with_chunk(df: DataFrame, position: Column, size: int) -> DataFrame:
    """Adds ``chunk``: the stretch of ``size`` positions a row falls into."""
    return df.withColumn("chunk", F.floor(position / F.lit(size)).cast("bigint"))


def next_value(df: DataFrame, group: str, position: str, chunk_size: int) -> DataFrame:
    """Adds ``next_position``: the following position in the same group.

    A window over (group, stretch) finds it inside a stretch; the last row of a
    stretch takes the first position of the following one, from a table with one
    row per stretch.  No task sees a whole group.
    """
    chunked = with_chunk(df, F.col(position), chunk_size)
    firsts = chunked.groupBy(group, "chunk").agg(F.min(position).alias("_first"))
    following = firsts.withColumn(
        "_next_first",
        F.lead("_first").over(Window.partitionBy(group).orderBy("chunk")),
    ).drop("_first")
    inside = F.lead(position).over(Window.partitionBy(group, "chunk").orderBy(position))
    return (
        chunked.withColumn("_inside", inside)
        .join(following, [group, "chunk"], "left")
        .withColumn("next_position", F.coalesce("_inside", "_next_first"))
        .drop("_inside", "_next_first", "chunk")
    )


def last_before(
    df: DataFrame, group: str, position: str, value: Column, chunk_size: int, name: str
) -> DataFrame:
    """Adds ``name``: the latest non-null ``value`` before a row in its group.

    Same two levels as :func:`next_value`: inside a stretch by window, otherwise the
    last value of the stretches before it.
    """
    chunked = with_chunk(df, F.col(position), chunk_size).withColumn("_value", value)
    per_chunk = chunked.groupBy(group, "chunk").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(position))).alias("_last")
    )
    earlier = Window.partitionBy(group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).drop(
        "_last"
    )
    inside = (
        Window.partitionBy(group, "chunk")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        chunked.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
        .join(carried, [group, "chunk"], "left")
        .withColumn(name, F.coalesce("_inside", "_carried"))
        .drop("_inside", "_carried", "_value", "chunk")
    )
