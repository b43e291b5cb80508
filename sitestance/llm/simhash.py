"""SimHash near-duplicates by meeting in the middle (operator 8).

Fingerprints link at three or fewer differing bits.  The 64 bits are cut into three
blocks.  Of three differing bits one block holds exactly one, or one block holds all
three; so two cases find every link:

* *One block left out.*  On the other two blocks at most two bits differ, and balls of
  half that radius meet: every fingerprint emits its word without the block and all its
  one-bit variants (132 rows altogether).  Members that meet and whose left-out blocks
  differ in at most one bit are linked.
* *Two blocks equal.*  All differing bits lie in one block; there balls of radius one and
  two meet, for the few fingerprints that share both other blocks.

Members that meet are never paired with each other: each meeting point names the least
of its central members, which lies within the distance of all the others.  So a group
of m fingerprints gives links in proportion to m.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitestance.llm.alike import near_links, sketch
from sitestance.llm.common import components, fresh, look_up, stored

SHINGLE = 3
SEED = 42
RADIUS = 3
BLOCKS = ((0, 21), (21, 42), (42, 64))
CHUNK = 1 << 15


def fingerprint(text: str | None) -> bytes:
    """Eight bytes, most significant first; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))))
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), CHUNK):
        hashes = b"".join([digest(s, SEED) for s in shingles[at : at + CHUNK]])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(shingles)).tobytes()


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = b"".join([fingerprint(t) for t in batch.column(1).to_pylist()])
        values = np.frombuffer(prints, ">i8").astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the 64-bit fingerprint as a long, one row per row of ``docs``."""
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return narrow.mapInArrow(_batches, "doc_id bigint, fp bigint")


def links(prints: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` that connect all within RADIUS."""
    found = _one_left_out(prints).union(_two_equal(prints))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    return found.where("a <> b").distinct().where(near)


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose (word, block) at least two fingerprints have."""
    group = Window.partitionBy("word", "block")
    return (
        rows.withColumn("_lo", F.min("fp").over(group))
        .withColumn("_hi", F.max("fp").over(group))
        .where("_lo < _hi")
        .drop("_lo", "_hi")
    )


def _bit(position: str) -> Column:
    """The word with this one bit; none for position -1."""
    return F.expr(f"if({position} < 0, 0L, shiftleft(1L, {position}))")


def _mask() -> Column:
    """The bits of the row's ``block``."""
    masks = [(1 << hi) - (1 << lo) for lo, hi in BLOCKS]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.element_at(F.array(*[F.lit(m) for m in signed]), F.col("block") + 1)


def _limits() -> list[Column]:
    """First and last bit of the row's ``block``."""
    return [
        F.element_at(F.array(*[F.lit(x[end] - end) for x in BLOCKS]), F.col("block") + 1)
        for end in (0, 1)
    ]


def _words(prints: DataFrame) -> DataFrame:
    """Every fingerprint three times, each time without another block."""
    rows = prints.select("fp", F.explode(F.expr(f"sequence(0, {len(BLOCKS) - 1})")).alias("block"))
    return rows.withColumn("word", F.col("fp").bitwiseAND(F.bitwise_not(_mask())))


def _ball(rows: DataFrame, name: str, first: Column, last: Column) -> DataFrame:
    """Every row once as it is (``name`` -1) and once for each bit from first to last."""
    bits = F.concat(F.array(F.lit(-1)), F.sequence(first, last))
    return rows.withColumn(name, F.explode(bits))


def _meet(points: DataFrame) -> DataFrame:
    """Link what meets to the least central member of the meeting point."""
    group = Window.partitionBy("word", "left_out", "block")
    centre = F.min(F.when(F.col("central"), F.col("fp"))).over(group)
    return points.select(centre.alias("a"), F.col("fp").alias("b")).where("a is not null")


def _one_left_out(prints: DataFrame) -> DataFrame:
    ball = _ball(_words(prints), "i", F.lit(0), F.lit(63))
    first, last = _limits()
    outside = ball.where(~F.col("i").between(first, last))
    words = outside.select(
        "fp", F.col("block").cast("tinyint").alias("block"), F.col("word").bitwiseXOR(_bit("i")).alias("word")
    )
    points = _ball(_shared(words), "i", *_limits())
    left_out = F.col("fp").bitwiseAND(_mask()).bitwiseXOR(_bit("i"))
    return _meet(points.select("fp", "block", "word", left_out.alias("left_out"), F.expr("i < 0").alias("central")))


def _two_equal(prints: DataFrame) -> DataFrame:
    ball = _ball(_shared(_words(prints)), "i", *_limits())
    pairs = ball.withColumn(
        "j",
        F.explode(
            F.concat(
                F.array(F.lit(-1)),
                F.when(F.col("i") > _limits()[0], F.sequence(_limits()[0], F.col("i") - 1)).otherwise(
                    F.array().cast("array<int>")
                ),
            )
        ),
    )
    left_out = F.col("fp").bitwiseAND(_mask()).bitwiseXOR(_bit("i")).bitwiseXOR(_bit("j"))
    return _meet(pairs.select("fp", "block", "word", left_out.alias("left_out"), F.expr("j < 0").alias("central")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Each document with its fingerprint and the least ``doc_id`` it is linked to.

    Null texts count as empty; texts without words have the fingerprint zero and link like
    any other.  Rows without ``doc_id`` take part and have the least id of their group, or
    null if no member has one.  Repeated rows are kept.  Other columns are not looked at.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    least = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "least-ids")
    nodes = components(links(least.select("fp")), "components")
    grouped = nodes.join(least, F.col("node") == F.col("fp"))
    roots = grouped.groupBy("root").agg(F.min("least_id").alias("group_id"))
    joined = stored(
        nodes.join(roots.withColumnRenamed("root", "_root"), F.col("root") == F.col("_root")).select(
            F.col("node").alias("fp"), "group_id"
        ),
        "groups",
    )
    named = stored(
        least.join(joined, "fp", "left").select(
            "fp", F.coalesce("group_id", "least_id").alias("component_id")
        ),
        "component-ids",
    )
    return look_up(rows, named, ["fp"], spread=["doc_id"]).select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """The query's form: the fingerprint as 16 lower-case hex digits."""
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _row_batches(likeness: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            prints = np.frombuffer(b"".join(map(fingerprint, texts)), ">i8").astype(np.int64)
            sketches = [
                None if likeness is None else sketch((t or "").encode("utf-8", "surrogatepass")) for t in texts
            ]
            columns = [batch.column(0), batch.column(1), pa.array(prints), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "content", "fp", "sketch"])

    return run


def one_of_each(docs: DataFrame, likeness: float | None = None) -> DataFrame:
    """The documents, with their columns, but only the one of least id of every group.

    Groups are those of fingerprints; with ``likeness``, texts that share at least so much of
    their five-word shingles (estimated, see ``alike``) are linked as well.  One row stays of
    every group, also where its id comes again with another text.  A row without id stays only
    if nobody in its group has an id.
    """
    content = F.xxhash64(F.coalesce("text", F.lit("")))
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), content.alias("content"), "text")
    schema = "doc_id bigint, content bigint, fp bigint, sketch binary"
    rows = stored(narrow.mapInArrow(_row_batches(likeness), schema), "near-rows")
    texts = rows.groupBy("content").agg(
        F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch")
    )
    texts = stored(texts, "near-texts")
    nodes = stored(components(links(rows.select("fp").distinct()), "components"), "near-nodes")
    # A group goes by its root, the least of its fingerprints.
    named = look_up(texts, nodes.withColumnRenamed("node", "fp"), ["fp"], spread=["content"])
    named = stored(named.withColumn("root", F.coalesce("root", "fp")), "near-roots")
    if likeness is not None:
        scoped = stored(named.select(F.col("content").alias("node"), F.lit(None).cast("string").alias("scope"), "sketch"), "near-sketches")
        found = stored(near_links(scoped, likeness), "near-links")
        ends = named.select(F.col("content").alias("end"), F.col("root").alias("of_end"))
        edges = found.join(ends, F.col("a") == F.col("end")).select(F.col("of_end").alias("a"), "b")
        edges = look_up(edges.withColumnRenamed("b", "end"), ends, ["end"], spread=["a"], how="inner")
        merged = components(edges.select("a", F.col("of_end").alias("b")), "near-merged")
        merged = stored(merged.select(F.col("node").alias("root"), F.col("root").alias("whole")), "near-wholes")
        named = look_up(named, merged, ["root"], spread=["content"])
        named = named.withColumn("root", F.coalesce("whole", "root"))
    first = F.min(F.struct(F.col("least").isNull(), "least", "content")).alias("first")
    stays = named.groupBy("root").agg(first).select(
        F.col("first.least").alias("_id"), F.col("first.content").alias("_content")
    )
    stays = stored(stays, "near-stays")
    one = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content"))
    goes = stored(rows.select("doc_id", "content").distinct().join(stays, one, "left_anti"), "dropped")
    names = {n: fresh(docs, n) for n in ("_id", "_content", "_dropped")}
    keys = [names["_id"], names["_content"]]
    tagged = docs.withColumns({names["_id"]: F.col("doc_id").cast("bigint"), names["_content"]: content})
    goes = goes.select(
        F.col("doc_id").alias(names["_id"]), F.col("content").alias(names["_content"]), F.lit(True).alias(names["_dropped"])
    )
    left = look_up(tagged, goes, keys, spread=keys).where(F.col(names["_dropped"]).isNull())
    if not rows.groupBy("doc_id", "content").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(keys)
    return left.select(*docs.columns)
