"""Sharding by sampled splitters (operator 3); DataFrame functions only.

Records are ordered by the hash of their text, then of their id, so equal texts lie
together.  A sample, weighted by size, gives splitters at its quantiles, and these cut the
order into many ranges of about equal size; a large group of copies is cut by id.  Sizes of
the ranges, measured over all records, say where each shard begins and ends; the ranges
that lie across such a place are cut at a record.  So shards differ in bytes by about a
record, and no task holds more than one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitestance.llm.common import fresh, stored

SHARDS = 16
LAW = "bytes"
# Ranges (a power of two) and expected sample records for each.
RANGES = 1024
SAMPLED = 16


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def _keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        _size(F.col("text")).alias("size"),
        F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.xxhash64(F.col("doc_id").cast("bigint"), F.lit(7)).alias("tie"),
    )


def splitters(keys: DataFrame, ranges: int = RANGES, sampled: int = SAMPLED) -> list[tuple[int, int]]:
    """At most ``ranges - 1`` places in the order, at the quantiles of a sample weighted by size.

    The sample is drawn by a hash, so reruns agree.  It has about ``ranges * sampled``
    records at any size of the input; only their keys and weights come to the driver.
    """
    total = keys.agg(F.sum("size")).first()[0]
    if not total:
        return []
    rate = ranges * sampled / total
    weight = F.col("size") * rate
    draw = (F.shiftrightunsigned(F.xxhash64("key", "tie", F.lit(11)), 11)) / float(1 << 53)
    sample = keys.where(draw < weight).select("key", "tie", F.greatest(weight, F.lit(1.0)).alias("w"))
    rows = sorted((r["key"], r["tie"], r["w"]) for r in sample.collect())
    step = sum(w for *_, w in rows) / ranges
    found: list[tuple[int, int]] = []
    seen = 0.0
    for key, tie, w in rows:
        if seen >= step * (len(found) + 1) and len(found) < ranges - 1 and (not found or (key, tie) > found[-1]):
            found.append((key, tie))
        seen += w
    return found


def _range(places: list[tuple[int, int]], ranges: int) -> Column:
    """Number of splitters at or before a record: a search that halves, in an expression."""
    if not places:
        return F.lit(0)
    padded = places + [((1 << 63) - 1, (1 << 63) - 1)] * (ranges - 1 - len(places))
    keys = F.expr("array(" + ", ".join(_long(k) for k, _ in padded) + ")")
    ties = F.expr("array(" + ", ".join(_long(t) for _, t in padded) + ")")
    steps = F.array(*[F.lit(ranges >> (i + 1)) for i in range(ranges.bit_length() - 1)])

    def halve(at: Column, step: Column) -> Column:
        key, tie = F.element_at(keys, at + step), F.element_at(ties, at + step)
        before = (key < F.col("key")) | ((key == F.col("key")) & (tie <= F.col("tie")))
        return F.when(before, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), halve)


def _long(value: int) -> str:
    return f"{value}L" if value > -(1 << 63) else "cast('-9223372036854775808' as bigint)"


def assign(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """Size, checksum, shard and slot of every row.

    Null texts have size 1 and the checksum of the empty text; rows without id are one id.
    Repeated rows follow each other.  An empty table gives no rows.  Other columns are not
    looked at.
    """
    keys = stored(_keys(docs), "shard-keys")
    places = splitters(keys, ranges)
    placed = stored(keys.withColumn("range", _range(places, ranges).cast("int")), "shard-ranges")
    measured = placed.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    sums = {r["range"]: (r["n"], r["size"]) for r in measured.collect()}
    total = sum(size for _, size in sums.values())
    if not total:
        return _out(placed.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("bigint")}))
    at_rows, at_bytes, n, size = [], [], 0, 0
    for i in range(ranges):
        at_rows.append(n)
        at_bytes.append(size)
        n, size = n + sums.get(i, (0, 0))[0], size + sums.get(i, (0, 0))[1]

    def start(values: list[int]) -> Column:
        return F.element_at(F.expr("array(" + ", ".join(f"{v}L" for v in values) + ")"), F.col("range") + 1)

    order = Window.partitionBy("range").orderBy("key", "tie", "doc_id")
    rows = placed.withColumns(
        {
            "row": start(at_rows) + F.row_number().over(order) - 1,
            "byte": start(at_bytes)
            + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
            - F.col("size"),
        }
    ).withColumn("shard", F.least(F.floor(F.col("byte") * shards / total), F.lit(shards - 1)).cast("int"))
    # A shard's first row lies in the range that holds its first byte, or opens the next one.
    full = [i for i in range(ranges) if i in sums]
    begins = set()
    for byte in (-(-k * total // shards) for k in range(shards)):
        at = max(n for n, i in enumerate(full) if at_bytes[i] <= byte)
        begins |= set(full[at : at + 2])
    firsts = rows.where(F.col("range").isin(sorted(begins))).groupBy("shard").agg(F.min("row").alias("first"))
    found = {r["shard"]: r["first"] for r in firsts.collect()}
    first = F.element_at(F.array(*[F.lit(found.get(i, 0)).cast("bigint") for i in range(shards)]), F.col("shard") + 1)
    return _out(rows.withColumn("slot", (F.col("row") - first).cast("bigint")))


def _out(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write(docs: DataFrame, folder: str, shards: int = SHARDS) -> None:
    """Write the documents with their columns into one folder for each shard."""
    name, n = fresh(docs, "shard"), fresh(docs, "_n")
    plan = assign(docs, shards).groupBy(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"))
    plan = plan.agg(F.min("shard").alias(name))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("bigint")
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (F.col(n) == F.col("_crc"))
    joined = docs.withColumn(n, crc).join(plan, same)
    joined.drop(n, "_id", "_crc").write.partitionBy(name).parquet(folder)
