"""Removal of long repeated byte strings by a difference cover, block by block (operator 9).

A byte goes if a string of 400 bytes that covers it also starts anywhere else.

1. *Cover sample.*  Positions whose remainder modulo 273 lies in a perfect difference set of
   17 are sampled.  For any two positions some shift below 273 moves both into the sample;
   so wherever 400 bytes repeat, two sampled positions share at least 128 bytes.  Sampled
   positions are ranked by these 128 bytes (by their hash), bucket by bucket, and those that
   share their rank are marked.  A starting place with no marked position within reach
   cannot repeat and needs no more work.
2. *Suffix buckets.*  The remaining starting places are dealt into buckets by the hash of
   their 400 bytes and one bucket after another is sorted; long ties are never compared byte
   by byte, since equal strings have equal hashes.  Places that meet another one are marked.
3. *Spans.*  Marked places of a text become its removed spans.

Texts are handled once however many copies there are; a copy's bytes all repeat.  A sampled
or starting place travels as a few bytes in packed arrays, one row for each batch and bucket.
Equality is that of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitestance.llm.common import look_up, stored

LENGTH = 400
MODULUS = 273
# A perfect difference set modulo 273; every remainder is a difference of two.
COVER = (1, 2, 4, 8, 16, 32, 64, 91, 117, 128, 137, 182, 195, 205, 234, 239, 256)
SAMPLE = LENGTH - MODULUS + 1

_MULTIPLIER = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(9).integers(0, 1 << 64, 256, dtype=np.uint64)


class _Powers:
    """Powers of the multiplier and of its inverse, as far as the longest text needs them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 14)
            for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = _Powers()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(data: bytes) -> np.ndarray:
    n = len(data)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[np.frombuffer(data, np.uint8)] * _POWERS.upto(n + 1)[0][:n], out=out[1:])
    return out


def _hashes(sums: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the strings of this length that start at the places ``at``."""
    return _mixed((sums[at + length] - sums[at]) * _POWERS.upto(len(sums))[1][at])


def cover_sample(n_bytes: int) -> np.ndarray:
    """Sampled positions of a text that have SAMPLE bytes after them."""
    last = n_bytes - SAMPLE
    if n_bytes < LENGTH:
        return np.zeros(0, np.int64)
    blocks = np.arange(0, last + 1, MODULUS)[:, None] + np.array(COVER)[None, :]
    at = blocks.ravel()
    return at[at <= last]


def near_marks(marks: np.ndarray, n_bytes: int) -> np.ndarray:
    """Starting places that have a marked position within reach."""
    last = n_bytes - LENGTH
    edge = np.zeros(n_bytes + 2, np.int32)
    np.add.at(edge, np.maximum(marks - MODULUS + 1, 0), 1)
    np.add.at(edge, marks + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: last + 1] > 0)


_PACKED = "bucket int, keys binary, at binary, texts binary, counts binary"


class _Packer:
    """Gathers hashed places and hands them out as one row for each bucket."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.texts: list[int] = []
        self.sizes: list[int] = []
        self.n = 0

    def add(self, text: int, places: np.ndarray, hashes: np.ndarray) -> None:
        if len(places):
            self.hashes.append(hashes)
            self.places.append(places.astype(np.uint32))
            self.texts.append(text)
            self.sizes.append(len(places))
            self.n += len(places)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        hashes, places = np.concatenate(self.hashes), np.concatenate(self.places)
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        texts = np.array(self.texts, np.int64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=self.buckets))
        columns: list[list] = [[], [], [], [], []]
        for b, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends)):
            if lo == hi:
                continue
            own = order[lo:hi]
            who, counts = np.unique(owner[own], return_counts=True)
            values = (b, (hashes[own] // np.uint64(self.buckets)).tobytes(), _packed_places(places[own], counts))
            values += (texts[who].tobytes(), counts.astype(np.uint32).tobytes())
            for column, value in zip(columns, values):
                column.append(value)
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "keys", "at", "texts", "counts"]
        )
        self.clear()


def _packed_places(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending places of several texts as steps, in two bytes each where these suffice."""
    steps = places.copy()
    steps[1:] -= places[:-1]
    firsts = np.cumsum(counts) - counts
    steps[firsts] = places[firsts]
    small = bool(len(steps) == 0 or steps.max() < 1 << 16)
    return bytes([small]) + steps.astype(np.uint16 if small else np.uint32).tobytes()


def _places(packed: bytes, counts: np.ndarray) -> np.ndarray:
    steps = np.frombuffer(packed, np.uint16 if packed[0] else np.uint32, offset=1).astype(np.int64)
    total = np.cumsum(steps)
    firsts = np.cumsum(counts) - counts
    return total - np.repeat(total[firsts] - steps[firsts], counts)


def _sample_batches(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets)
        for batch in batches:
            for text, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = value.encode("utf-8", "surrogatepass")
                at = cover_sample(len(data))
                if len(at):
                    packer.add(text, at, _hashes(_sums(data), at, SAMPLE))
                if packer.n > 4_000_000:
                    yield from packer.rows()
        yield from packer.rows()

    return run


def _start_batches(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets)
        for batch in batches:
            for text, value, marks in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = value.encode("utf-8", "surrogatepass")
                at = near_marks(_unpacked(marks), len(data))
                if len(at):
                    packer.add(text, at, _hashes(_sums(data), at, LENGTH))
                if packer.n > 4_000_000:
                    yield from packer.rows()
        yield from packer.rows()

    return run


def _meeting(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sort one bucket at a time; the places that share their key with another place."""
        rows: list[tuple] = []
        bucket = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket is not None and row[0] != bucket:
                    yield from _sorted_bucket(rows, groups)
                    rows = []
                bucket = row[0]
                rows.append(row[1:])
        if rows:
            yield from _sorted_bucket(rows, groups)

    return run


def _spelled(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The text and the place of each entry of packed ``(at, texts, counts)`` rows."""
    counts = [np.frombuffer(r[2], np.uint32).astype(np.int64) for r in rows]
    texts = np.concatenate([np.repeat(np.frombuffer(r[1], np.int64), c) for r, c in zip(rows, counts)])
    return texts, np.concatenate([_places(r[0], c) for r, c in zip(rows, counts)])


def _sorted_bucket(rows: list[tuple], groups: int) -> Iterator[pa.RecordBatch]:
    keys = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows])
    texts, at = _spelled([r[1:] for r in rows])
    order = np.argsort(keys)
    keys, texts, at = keys[order], texts[order], at[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    # Copies of a text bring the same place again; that is no other place.
    place = _mixed(texts.astype(np.uint64) + _mixed(at.astype(np.uint64)))
    several = np.minimum.reduceat(place, starts) != np.maximum.reduceat(place, starts)
    keep = np.repeat(several, sizes)
    texts, at = texts[keep], at[keep]
    if not len(texts):
        return
    group = (_mixed(texts.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((at, texts, group))
    group, texts, at = group[order], texts[order], at[order]
    columns: list[list] = [[], [], [], []]
    ends = np.cumsum(np.bincount(group, minlength=groups))
    for g, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends)):
        if lo < hi:
            who, counts = np.unique(texts[lo:hi], return_counts=True)
            values = (g, _packed_places(at[lo:hi].astype(np.uint32), counts))
            values += (who.tobytes(), counts.astype(np.uint32).tobytes())
            for column, value in zip(columns, values):
                column.append(value)
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], ["texts_of", "at", "texts", "counts"]
    )


def _by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All marked places of a group of texts, one row for each text."""
    rows: list[tuple] = []
    for batch in batches:
        rows += zip(*(c.to_pylist() for c in batch.columns[1:]))
    if not rows:
        return
    texts, at = _spelled(rows)
    order = np.lexsort((at, texts))
    texts, at = texts[order], at[order]
    fresh = np.concatenate([[True], (texts[1:] != texts[:-1]) | (at[1:] != at[:-1])])
    texts, at = texts[fresh], at[fresh]
    firsts = np.flatnonzero(np.concatenate([[True], texts[1:] != texts[:-1]]))
    parts = np.split(at.astype(np.uint32), firsts[1:])
    values = [_packed_places(p, np.array([len(p)])) for p in parts]
    for lo in range(0, len(values), 4096):
        own = slice(lo, lo + 4096)
        yield pa.RecordBatch.from_arrays(
            [pa.array(texts[firsts][own]), pa.array(values[own], pa.binary())], ["text_key", "at"]
        )


def _unpacked(packed: bytes) -> np.ndarray:
    n = (len(packed) - 1) // (2 if packed[0] else 4)
    return _places(packed, np.array([n]))


def _met(packed: DataFrame, buckets: int, name: str) -> DataFrame:
    """``text_key`` and the packed places of each text that share their key with another place.

    What a bucket finds goes back by groups of texts, packed like the way there, so the
    rows between tasks number as the tasks do and not as texts times buckets.
    """
    dealt = packed.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    found = dealt.mapInArrow(_meeting(buckets), "texts_of int, at binary, texts binary, counts binary")
    back = found.repartitionById(buckets, F.col("texts_of"))
    return stored(back.mapInArrow(_by_text, "text_key bigint, at binary"), name)


def _span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = []
        for packed in batch.column(1).to_pylist():
            at = _unpacked(packed)
            gaps = np.flatnonzero(np.diff(at) > LENGTH)
            starts, ends = at[np.append(0, gaps + 1)], at[np.append(gaps, len(at) - 1)] + LENGTH
            spans.append([{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist())])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["text_key", "spans"])


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``text_key, copies, spans`` of the texts that have copies or repeated strings.

    ``spans`` are those shared with other places of different texts or of the text itself.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("doc_id", _text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    long = texts.where(F.octet_length("text") >= LENGTH)
    classes = long.groupBy("text_key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least_id"))
    classes = stored(classes, "suffix-classes")
    sample = long.select("text_key", "text").mapInArrow(_sample_batches(buckets), _PACKED)
    marks = _met(sample, buckets, "suffix-marks")
    wanted = stored(
        marks.select("text_key").join(classes, "text_key").select("text_key", F.col("least_id")), "suffix-wanted"
    )
    chosen = look_up(long, wanted, ["text_key"], spread=["doc_id"], how="inner")
    # One row of each text is enough; repeated rows of one id do no harm.
    chosen = chosen.where(F.col("doc_id").eqNullSafe(F.col("least_id"))).select("text_key", "text")
    starts = chosen.join(marks, "text_key").select("text_key", "text", "at")
    met = _met(starts.mapInArrow(_start_batches(buckets), _PACKED), buckets, "suffix-meetings")
    spans = met.mapInArrow(
        _span_batches, "text_key bigint, spans array<struct<start:bigint,end:bigint>>"
    )
    found = classes.where("copies > 1").select("text_key", "copies").join(spans, "text_key", "full")
    return stored(found, "suffix-spans")


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _cut(data: bytes, spans: list[dict]) -> tuple[int, bytes]:
    kept, at, removed = [], 0, 0
    for s in spans:
        kept.append(data[at : s["start"]])
        removed += s["end"] - s["start"]
        at = s["end"]
    return removed, b"".join([*kept, data[at:]])


def _result_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, copies, spans in zip(*(c.to_pylist() for c in batch.columns)):
            data = (text or "").encode("utf-8", "surrogatepass")
            if copies and len(data) >= LENGTH:
                spans = [{"start": 0, "end": len(data)}]
            removed, kept = _cut(data, spans or [])
            rows.append((doc_id, len(data), removed, len(spans or []), sha256(kept).hexdigest()))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            names = "doc_id n_bytes n_removed n_spans kept_sha256".split()
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)


def dedup(docs: DataFrame) -> DataFrame:
    """What is removed from every document and what is kept.

    Null texts count as empty; texts under 400 bytes lose nothing.  Repeated rows are copies
    of each other, as are rows without id.  Other columns are not looked at.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = repeated_spans(narrow)
    keyed = narrow.withColumn("text_key", _text_key())
    weight = F.size(F.coalesce("spans", F.array())) + 1
    joined = look_up(keyed, found, ["text_key"], spread=["doc_id"], weight=weight)
    return joined.select("doc_id", "text", "copies", "spans").mapInArrow(_result_batches, _RESULT)
