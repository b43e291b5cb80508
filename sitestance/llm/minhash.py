"""Document fingerprints by MinHash (operator 1).

A text's shingles of five words are hashed, and each of 128 universal hash functions
``(a * x + b mod 2^64) >> 32`` keeps its least value over the shingles.  The share of equal
values estimates the Jaccard likeness of two texts.  ``search`` joins bands of the
signatures of a stated query set with those of all documents and verifies each meeting by
the Jaccard likeness of the shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitestance.llm.common import stored

SHINGLE = 5
FUNCTIONS = 128
BANDS = 32
THRESHOLD = 0.8
BLOCK = 2048
SEED = 1

_RNG = np.random.default_rng(SEED)
_A = _RNG.integers(0, 1 << 64, FUNCTIONS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 64, FUNCTIONS, dtype=np.uint64)
_NONE = np.full(FUNCTIONS, 0xFFFFFFFF, np.uint32)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """32-bit hashes of the shingles; of the whole sequence if it is shorter than one."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    digest = xxhash.xxh32_digest
    return np.frombuffer(b"".join([digest(s) for s in shingles]), ">u4").astype(np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of every hash function; all ones if there are no shingles."""
    least = _NONE
    for at in range(0, len(hashes), BLOCK):
        values = hashes[at : at + BLOCK, None] * _A + _B
        values >>= np.uint64(32)
        least = np.minimum(least, values.min(axis=0).astype(np.uint32))
    return least


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(text: str, edited: str) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a text and of its edited form; shingles at their common start count once."""
    own, other = words_of(text), words_of(edited)
    if min(len(own), len(other)) < SHINGLE:
        return signature(shingle_hashes(own)), signature(shingle_hashes(other))
    same = next((i for i, (a, b) in enumerate(zip(own, other)) if a != b), min(len(own), len(other)))
    shared = max(0, same - SHINGLE + 1)
    hashes = shingle_hashes(own)
    start = signature(hashes[:shared])
    ends = signature(hashes[shared:]), signature(shingle_hashes(other[shared:]))
    return np.minimum(start, ends[0]), np.minimum(start, ends[1])


def edit(text: str, following: str) -> str:
    """The last quarter gives way to the start of the next document."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_OUT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64())]
    + [(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _hex(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of an ordered part with the row after it; the last row is a copy of the next part's first."""
    before = None
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            if before is not None:
                out.append(before + (text,))
            before = (doc_id, text)
        rows, pending = [], None
        for doc_id, text, following in out:
            edited = edit(text, following)
            sig, sig_edited = fingerprints(text, edited)
            if pending is not None:
                rows.append(pending + (likeness(pending_sig, sig),))
            digest = sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            pending = (doc_id, len(text), digest, _hex(sig), _hex(sig_edited), likeness(sig, sig_edited))
            pending_sig = sig
        if pending is not None:
            rows.append(pending + (likeness(pending_sig, signature(shingle_hashes(words_of(out[-1][2])))),))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(zip(*rows), _ARROW)], schema=_ARROW
            )


def _ordered(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in parts of ascending id, each followed by the first row of the next part.

    Parts begin at quantiles of the ids, so that equal ids share a part and every plan cuts
    alike; one row for each part comes to the driver, without its text.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    quantiles = [i / parts for i in range(1, parts)]
    cuts = sorted({int(q) for q in narrow.approxQuantile("doc_id", quantiles, 1 / (20 * parts))})
    below = F.expr("array(" + ", ".join(f"{c}L" for c in cuts) + ")").cast("array<bigint>")
    part = F.coalesce(F.size(F.filter(below, lambda c: c <= F.col("doc_id"))), F.lit(0))
    rows = narrow.withColumns({"part": F.when(F.col("doc_id").isNull(), 0).otherwise(part), "h": F.xxhash64("text")})
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63) + 1)).alias("o"), "h", "doc_id")).alias("f")
    heads = sorted((r["part"], r["f"]["doc_id"], r["f"]["h"]) for r in rows.groupBy("part").agg(first).collect())
    if not heads:
        return rows.select("doc_id", "text")
    ends = [(heads[i - 1][0], doc_id, h) for i, (_, doc_id, h) in enumerate(heads)]
    table = spark.createDataFrame(ends, "to int, f_id bigint, f_h bigint")
    copies = rows.join(
        F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h"))
    ).dropDuplicates(["to"])
    marked = rows.select("part", F.lit(0).alias("copy"), "doc_id", "h", "text").union(
        copies.select(F.col("to").alias("part"), F.lit(1), "doc_id", "h", "text")
    )
    dealt = marked.repartitionById(len(cuts) + 1, F.col("part").cast("int"))
    return dealt.sortWithinPartitions("copy", F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text")


def digest(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, as the query returns them.

    Null texts count as empty.  Rows without id come first; rows that share an id are
    ordered by the hash of their text.  A single document follows itself.  Texts without
    words share the fingerprint of all ones.
    """
    return _ordered(docs).mapInArrow(_follow, _OUT)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id``, the shingle hashes and the band keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = FUNCTIONS // BANDS
        for batch in batches:
            sets, bands = [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(words_of(text or ""))
                rows = signature(hashes).reshape(BANDS, width)
                sets.append(np.unique(hashes).astype(np.int64).tolist())
                bands.append([xxhash.xxh64_intdigest(r.tobytes(), i) >> 1 for i, r in enumerate(rows)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "shingles", "bands"],
            )

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id bigint, shingles array<bigint>, bands array<bigint>")


def search(queries: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``query_id, doc_id, jaccard`` of all meetings of a query set with documents that are alike.

    Equal shingle sets are searched once and their ids attached afterwards, so groups of
    copies do not multiply.  Texts without words are alike to each other.
    """
    def classes(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        rows = stored(signatures(df).withColumn("content", F.xxhash64("shingles")), name)
        one = rows.groupBy("content").agg(F.first("shingles").alias("shingles"), F.first("bands").alias("bands"))
        return rows.select("doc_id", "content"), stored(one, f"{name}-classes")

    q_rows, q = classes(queries, "minhash-queries")
    d_rows, d = classes(docs, "minhash-docs")
    keys = [df.select("content", F.explode("bands").alias("band")) for df in (q, d)]
    met = keys[0].withColumnRenamed("content", "a").join(keys[1].withColumnRenamed("content", "b"), "band")
    pairs = met.select("a", "b").distinct()
    sets = pairs.join(q.select(F.col("content").alias("a"), F.col("shingles").alias("s")), "a").join(
        d.select(F.col("content").alias("b"), F.col("shingles").alias("t")), "b"
    )
    shared = F.size(F.array_intersect("s", "t"))
    union = F.size("s") + F.size("t") - shared
    jaccard = F.when(union == 0, F.lit(1.0)).otherwise(shared / union)
    alike = sets.select("a", "b", jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold)
    named = alike.join(q_rows.select(F.col("doc_id").alias("query_id"), F.col("content").alias("a")), "a")
    return named.join(d_rows.withColumnRenamed("content", "b"), "b").select("query_id", "doc_id", "jaccard")
