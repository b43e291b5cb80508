"""Sketches kept per crawl: distinct counts and size quantiles over many crawls (Q7, Q12).

A crawl is summed up once; any later table over crawls merges the stored rows and reads no
document again.  A rerun of a crawl replaces that crawl's sketches only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitestance.functions.rows import exploded

# Leading bits of a size that are kept: values below 256 are exact, others off by 1/256 at most.
SIZE_BITS = 8
# log2 of the registers of a distinct sketch: standard error about 0.8 %.
DISTINCT_BITS = 14


def agent_sketches(profiles: DataFrame) -> DataFrame:
    """Q12: one mergeable sketch of the agents named, per crawl; crawls that name none have no row."""
    named = exploded(profiles, ["crawl"], "useragents", "agent").where(F.col("agent").isNotNull())
    # The sketch takes no notice of empty text; an empty name is a name here.
    name = F.concat(F.lit("="), F.col("agent"))
    return named.groupBy("crawl").agg(F.hll_sketch_agg(name, DISTINCT_BITS).alias("agents"))


def distinct_over(sketches: DataFrame, *dimensions: str) -> DataFrame:
    """Estimated number of different agents by any of the sketches' dimensions; none: over all."""
    merged = sketches.groupBy(*dimensions).agg(F.hll_union_agg("agents").alias("agents"))
    return merged.withColumn("agents", F.hll_sketch_estimate("agents"))


def size_bucket(size: Column) -> Column:
    """The bucket of a size: its leading bits and how many bits were cut off; in the order of sizes.

    Sizes below zero count as zero; NULL has no bucket.
    """
    size = F.greatest(size.cast("bigint"), F.when(size.isNotNull(), F.lit(0).cast("bigint")))
    cut = F.greatest(F.length(F.bin(size)) - SIZE_BITS, F.lit(0))
    return cut * (1 << SIZE_BITS) + F.call_function("shiftright", size, cut)


def bucket_size(bucket: Column) -> Column:
    """The middle of a bucket."""
    cut = F.floor(bucket / (1 << SIZE_BITS)).cast("int")
    one = F.lit(1).cast("bigint")
    lead = F.call_function("shiftleft", (bucket % (1 << SIZE_BITS)).cast("bigint"), cut)
    return lead + F.when(cut > 0, F.call_function("shiftleft", one, cut - 1)).otherwise(0)


def size_sketches(profiles: DataFrame, *dimensions: str) -> DataFrame:
    """Q7: documents per size bucket, by crawl and the given dimensions.

    Rows are the sketch, so merging is a sum.  A group has at most some 7,000 rows, whatever
    the number of its documents.  Documents without size are in a bucket NULL.
    """
    bucket = size_bucket(F.col("content_length")).cast("bigint")
    return profiles.groupBy("crawl", *dimensions, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quantiles_over(sketches: DataFrame, *dimensions: str, ranks: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """Q7: documents and size quantiles for the dimensions rolled up, from stored sketches only.

    A quantile is the size of the document of rank ``ceil(rank * n)`` among those with a size,
    off by 1/256 at most; NULL where none has a size.  ``level`` is the grouping id.
    """
    sets = [[*(F.col(d) for d in dimensions[:k]), F.col("bucket")] for k in range(len(dimensions), -1, -1)]
    level = F.lit(0)
    for d in dimensions:
        level = level * 2 + F.grouping(d)
    summed = sketches.groupingSets(sets, *dimensions, "bucket").agg(
        F.sum("n").alias("n"), level.cast("bigint").alias("level")
    )
    group = [*dimensions, "level"]
    sized = F.when(F.col("bucket").isNotNull(), F.col("n"))
    everything = Window.partitionBy(*group)
    ordered = everything.orderBy(F.col("bucket").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    run = summed.withColumns({"upto": F.sum(sized).over(ordered), "sized": F.sum(sized).over(everything)})

    def quantile(rank: float) -> Column:
        reached = F.col("upto") >= F.greatest(F.ceil(F.lit(rank) * F.col("sized")), F.lit(1))
        return F.min(F.when(reached, F.col("bucket")))

    found = run.groupBy(*group).agg(
        F.sum("n").alias("docs"), *[quantile(r).alias(f"p{round(r * 100)}") for r in ranks]
    )
    return found.withColumns({f"p{round(r * 100)}": bucket_size(F.col(f"p{round(r * 100)}")) for r in ranks})


def store(sketches: DataFrame, path: str) -> DataFrame:
    """Sketches written under their crawls, in place of those of the same crawls; returns all stored ones."""
    (
        sketches.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("crawl")
        .parquet(path)
    )
    return sketches.sparkSession.read.schema(sketches.schema).parquet(path)
