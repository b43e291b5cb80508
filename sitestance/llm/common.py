"""Helpers that several operators share: stored tables, size-checked joins, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitestance.session import shared_dir

# Words are runs of anything but ASCII white space, as ``bytes.split()`` finds them.
WORD = r"[^\x20\x09-\x0D]+"
# A looked-up side goes to every executor only if it was counted and has at most so many rows.
BROADCAST_ROWS = 1_000_000
SALTS = 32
# A key is spread over SALTS partitions from so many rows on; at most so many keys, the hottest, are.
HOT_ROWS = 10_000
MOST_HOT = 100_000


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def stored(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read from there.

    This cuts the lineage and survives lost executors, and later passes do not work
    the rows out again.
    """
    folder = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **(options or {})).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not got yet, whatever columns it brings along."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def salt_of(*columns: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def look_up(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    spread: list[str],
    how: str = "left",
    salts: int = SALTS,
    most: int = BROADCAST_ROWS,
    weight: Column | None = None,
) -> DataFrame:
    """Join many ``rows`` to the one row of ``table`` with the same keys (null equals null).

    ``table`` is counted first and sent to every executor if it has at most ``most`` rows
    (or values, where rows hold arrays and ``weight`` counts them).
    Otherwise both sides are shuffled (``join_spread``).  Both ways give the same rows.
    """
    if (table.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0) <= most:
        other = F.broadcast(_renamed(table, keys))
        return rows.join(other, _same(keys), how).drop(*[f"_k_{k}" for k in keys])
    return join_spread(rows, table, keys, spread, how, salts)


def join_spread(
    rows: DataFrame, table: DataFrame, keys: list[str], spread: list[str], how: str = "left", salts: int = SALTS
) -> DataFrame:
    """Join ``rows`` to the one row of ``table`` with the same keys, both sides shuffled.

    Rows of a hot key are dealt over ``salts`` partitions by the columns ``spread``, and only
    that key's row of ``table`` is copied as often; so the copies follow the number of hot rows.
    """
    many = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= HOT_ROWS)
    hot = stored(many.orderBy(F.desc("_n")).limit(MOST_HOT).select(*keys, F.lit(True).alias("_hot")), "hot-keys")
    if hot.isEmpty():
        return rows.join(_renamed(table, keys), _same(keys), how).drop(*[f"_k_{k}" for k in keys])
    listed = F.broadcast(_renamed(hot, keys))
    names = [f"_k_{k}" for k in keys]
    salted = rows.join(listed, _same(keys), "left").drop(*names)
    draw = F.when(F.col("_hot"), salt_of(*[F.col(c) for c in spread], salts=salts)).otherwise(F.lit(0))
    salted = salted.withColumn("_salt", draw).drop("_hot")
    copies = table.join(listed, _same(keys), "left").drop(*names)
    last = F.when(F.col("_hot"), F.lit(salts - 1)).otherwise(F.lit(0))
    copies = _renamed(copies.withColumn("_k__salt", F.explode(F.sequence(F.lit(0), last))).drop("_hot"), keys)
    joined = salted.join(copies, _same(keys) & (F.col("_salt") == F.col("_k__salt")), how)
    return joined.drop("_salt", "_k__salt", *names)


def _renamed(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.withColumnsRenamed({k: f"_k_{k}" for k in keys})


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(values: Column, block: int = 128) -> Column:
    """Sums of the first 1, 2, … values of an array column of longs.

    Folding a whole array would copy it for each element, so blocks are folded on their
    own and lifted by the sums of the blocks before.
    """
    none = F.array().cast("array<bigint>")

    def fold(array: Column) -> Column:
        def step(done: Column, x: Column) -> Column:
            return F.concat(done, F.array(x + F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0))))

        return F.aggregate(array, none, step)

    def cut(array: Column) -> Column:
        last = F.floor((F.size(array) - 1) / block).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last), lambda b: fold(F.slice(array, b * block + 1, F.lit(block)))
        )

    def lift(blocks: Column) -> Column:
        def add(totals: Column) -> Column:
            def before(i: Column) -> Column:
                return F.when(i == 0, F.lit(0)).otherwise(F.element_at(totals, F.greatest(i, F.lit(1))))

            return F.flatten(
                F.transform(blocks, lambda b, i: let(before(i), lambda y: F.transform(b, lambda x: x + y)))
            )

        return let(fold(F.transform(blocks, lambda b: F.element_at(b, -1))), add)

    return let(values, lambda v: F.when(F.size(v) > 0, let(cut(v), lift)).otherwise(none))


def components(edges: DataFrame, name: str) -> DataFrame:
    """``(node, root)`` of every node of ``edges (a, b)``; the root is the least node.

    Stars are joined in turns: every node hands its larger neighbours to its least
    neighbour, then its smaller ones, until all is stars.  The number of turns grows
    with the logarithm of the longest chain; every turn is written to the shared folder.
    """
    current = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct(),
        name,
    )
    edges, stars = _shape(current)
    while not stars:
        both = current.union(current.select("b", "a"))
        large = _to_least(both, 2 * edges).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), name)
        small = _to_least(large, 2 * edges).select(F.col("v").alias("a"), F.col("m").alias("b"))
        own = large.groupBy("a").agg(F.min("b").alias("b"))
        current = stored(small.union(own).where("a <> b").distinct(), name)
        edges, stars = _shape(current)
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(current.select("b", "b").distinct())


def _to_least(pairs: DataFrame, most: int) -> DataFrame:
    """For each pair (u, v): u, v and the least of u and its partners; ``most`` pairs at most.

    Nodes of many partners are spread; where no node can have that many, nothing is.
    """
    u, v = pairs.columns
    pairs = pairs.select(F.col(u).alias("u"), F.col(v).alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if most < HOT_ROWS:
        return pairs.join(least, "u").select("u", "v", "m")
    return join_spread(pairs, least, ["u"], ["v"], "inner").select("u", "v", "m")


def _shape(edges: DataFrame) -> tuple[int, bool]:
    """The number of distinct ``edges (a, b)``, a > b, and whether every node is the centre or has just one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    found = nodes.agg(F.sum("up"), F.max((F.col("up") + F.col("down") > 1).cast("int"))).first()
    return found[0] or 0, not found[1]
