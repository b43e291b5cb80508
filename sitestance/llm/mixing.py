"""Mixing sources to target weights (operator 10); DataFrame functions only.

Every document has a hash; a source takes whole rounds of all its documents and, from one
more round, those whose hash lies below a threshold.  The threshold comes from histograms:
words are summed by source and hash bucket, the bucket in which the budget ends is found,
and only that bucket is looked at again with finer ones, until it holds a single hash.
Nothing is sorted; the passes read a narrow table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitestance.llm.common import WORD, fresh, look_up, stored

# Weights by the rank of a source, repeating.
WEIGHTS = (5, 2, 1)
# A document is taken so many times at most.
MOST_ROUNDS = 3
# Bits of the hash, and bits that one pass adds.
HASH_BITS = 60
STEP_BITS = 10


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _draw() -> Column:
    """60 bits of a hash of the id (of the text where there is no id)."""
    name = F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.col("text"), F.lit(""))
    return F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` for the rows ``source, source_size``.

    All sizes are shared by weight; a target stops at MOST_ROUNDS times its source's size
    and the excess is shared again.  So a target is the lesser of that bound and its weight
    times one level, which follows from the sources in the order in which they stop.
    """
    everything = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int"))
    ranked = sizes.withColumn("rank", rank).withColumn("weight", weight)
    bound = MOST_ROUNDS * F.col("source_size")
    stop = everything.orderBy(bound / F.col("weight"), "rank")
    before = stop.rowsBetween(Window.unboundedPreceding, -1)
    after = stop.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum(bound).over(before), F.lit(0))
    level = ranked.withColumn("level", left / F.sum("weight").over(after)).withColumn(
        "free", F.col("level") * F.col("weight") <= bound
    )
    common = F.min(F.when(F.col("free"), F.struct(bound / F.col("weight"), "rank", "level"))).over(everything)
    target = F.least(bound.cast("double"), common["level"] * F.col("weight"))
    return level.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _thresholds(narrow: DataFrame, goals: DataFrame) -> DataFrame:
    """``source, rounds, below``: whole rounds, and the hash below which one more is taken."""
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    open_ = goals.withColumn("rounds", F.least(rounds, F.lit(MOST_ROUNDS)).cast("int")).withColumns(
        {"rest": F.col("target") - F.col("rounds") * F.col("source_size"), "prefix": F.lit(0).cast("bigint")}
    )
    open_ = stored(open_.select("source", "rounds", "rest", "prefix"), "mix-open")
    done = None
    rows = narrow
    for used in range(STEP_BITS, HASH_BITS + 1, STEP_BITS):
        width = HASH_BITS - used
        inside = look_up(rows, open_, ["source"], spread=["hash"], how="inner").where(
            F.shiftright("hash", width + STEP_BITS) == F.col("prefix")
        )
        cells = inside.groupBy("source", "rounds", "rest", F.shiftright("hash", width).alias("cell")).agg(
            F.sum("size").alias("size"), F.min("hash").alias("lo"), F.max("hash").alias("hi")
        )
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("cell"))
        ended = cells.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
        first = ended.groupBy("source", "rounds").agg(
            F.min_by(F.struct("cell", "lo", "hi", "size", (F.col("rest") - F.col("upto") + F.col("size")).alias("rest")), "cell").alias("c")
        )
        found = stored(first.select("source", "rounds", "c.*"), "mix-boundary")
        single = found.where("lo = hi").select(
            "source",
            "rounds",
            # The boundary document is taken if that comes nearer the target.
            F.when(F.col("size") <= 2 * F.col("rest"), F.col("hi") + 1).otherwise(F.col("hi")).alias("below"),
        )
        whole = open_.join(found.select(F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s")), "left_anti")
        # Sources whose budget no bucket exceeds take every document of the round.
        whole = whole.select("source", "rounds", F.lit(1 << HASH_BITS).cast("bigint").alias("below"))
        ends = whole.union(single)
        done = ends if done is None else done.union(ends)
        open_ = found.where("lo < hi").select("source", "rounds", "rest", F.col("cell").alias("prefix"))
        if open_.isEmpty():
            break
    return stored(done, "mix-thresholds")


def _plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    narrow = stored(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), "source", _size(F.col("text")).alias("size"), _draw().alias("hash")
        ),
        "mix-sizes",
    )
    goals = stored(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    limits = _thresholds(narrow, goals)
    joined = goals.join(
        limits.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))
    ).drop("_s")
    return narrow, stored(joined, "mix-plan")


def _times(hash_: str) -> Column:
    return F.least(F.col("rounds") + (F.col(hash_) < F.col("below")).cast("int"), F.lit(MOST_ROUNDS))


def mix(docs: DataFrame) -> DataFrame:
    """How many words the mix takes of every row.

    Null texts have size 0; rows without source are one source, ranked last.  Rows that
    share an id share their hash and are taken alike.  Other columns are not looked at.
    """
    narrow, plan = _plan(docs)
    return look_up(narrow, plan, ["source"], spread=["hash"]).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _times("hash")).cast("bigint").alias("taken")
    )


def apply(docs: DataFrame) -> DataFrame:
    """The documents with their columns, each as often as the mix takes it."""
    _, plan = _plan(docs)
    names = {c: fresh(docs, f"_mix_{c}") for c in ("rounds", "below", "hash", "times")}
    plan = plan.select("source", *[F.col(c).alias(names[c]) for c in ("rounds", "below")])
    drawn = docs.withColumn(names["hash"], _draw())
    joined = look_up(drawn, plan, ["source"], spread=[names["hash"]])
    once = (F.col(names["hash"]) < F.col(names["below"])).cast("int")
    times = F.least(F.col(names["rounds"]) + once, F.lit(MOST_ROUNDS))
    repeated = joined.withColumn(names["times"], F.explode(F.array_repeat(F.lit(1), times)))
    return repeated.select(*docs.columns)


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, CAST(doc_id AS BIGINT) AS doc_id, source,
    CAST(len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15) AS BIGINT) AS hash
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r),
l AS (SELECT *, 3 * source_size AS bound, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
    ORDER BY 3 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY 3 * source_size / weight, rank
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, (bound / weight, rank)) AS level FROM l WHERE level * weight <= bound),
t AS (SELECT source, source_size, coalesce(least(CAST(bound AS DOUBLE), f.level * weight), 0.0) AS target
  FROM l CROSS JOIN f),
g AS (SELECT *, CAST(least(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END, 3) AS BIGINT)
    AS rounds FROM t),
h AS (SELECT source, hash, sum(size) AS size FROM d GROUP BY source, hash),
c AS (SELECT source, hash, size, sum(size) OVER (PARTITION BY source ORDER BY hash) AS upto FROM h),
k AS (SELECT c.source, c.hash, CASE WHEN c.upto <= g.target - g.rounds * g.source_size THEN 1
    WHEN c.upto - c.size <= g.target - g.rounds * g.source_size
      AND c.size <= 2 * (g.target - g.rounds * g.source_size - (c.upto - c.size))
    THEN 1 ELSE 0 END AS more FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source)
SELECT d.doc_id, d.size, g.source_size, g.target, CAST(d.size * least(g.rounds + k.more, 3) AS BIGINT) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.hash = k.hash
"""
