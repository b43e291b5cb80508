"""Packing documents into token windows (operator 6).

Every document is cut into whole windows and a rest shorter than a window.  The rests are
counted by length; shallow combinations of two or three lengths that fill a window exactly
are enumerated, and how often each is used is the non-negative least-squares solution
against that histogram, rounded down.  Rests left over are packed greedily, longest first,
each window filled up with a cut of the next rest.  Only the histogram (a number for each
length under the window) is handled on the driver, whatever the size of the corpus; rests
find their place by their number among the rests of their length.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitestance.llm.common import stored

WINDOW = 1024
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
# Combinations of three lengths that are tried, and steps of the least-squares solver.
TRIPLES = 4096
STEPS = 400
# Bytes of chunks and ids that a task remembers, each entry with what it costs beside them.
REMEMBERED, ENTRY = 32 << 20, 200
# Rows that are taken out of an Arrow batch at once, and bytes of ids that are handed on together.
ROWS, HANDED = 256, 4 << 20

# White space as the tokenizer's expression has it; ids never span a chunk's edge.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_ROWS = "part bigint, row bigint, doc_id bigint, doc_tokens bigint, crcs array<bigint>, rest int, number bigint, ids binary"


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a chunk: by the same vocabulary as ranks where it lies beside the tokenizer.

    Both give the same ids; ranks need no offsets and take a chunk several times faster.
    """
    ranks = Path(path).with_suffix(".tiktoken")
    if not ranks.exists():
        return lambda chunk: _tokenizer(path).encode(chunk, add_special_tokens=False).ids
    from public_tokenizers import PATTERN
    from tiktoken import Encoding

    lines = (line.split() for line in ranks.read_bytes().splitlines() if line)
    table = {base64.b64decode(a): int(b) for a, b in lines}
    return Encoding("packing", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary


class _Ids(dict):
    """Ids of a chunk as little-endian 32-bit numbers, remembered within a bound."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode, self.room = encode, REMEMBERED

    def __missing__(self, chunk: str) -> bytes:
        ids = array("I", self.encode(chunk)).tobytes()
        cost = ENTRY + len(chunk) + len(ids)
        if cost <= self.room:
            self.room -= cost
            self[chunk] = ids
        return ids


@cache
def _remembered(path: str) -> _Ids:
    return _Ids(_encoder(path))


@cache
def _special(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as file:
        return tuple(t["content"] for t in json.load(file)["added_tokens"])


def token_ids(text: str, path: str) -> bytes:
    """The text's ids and the end id, four bytes each.

    The tokenizer cuts a text at white space before it merges anything, so the ids of a
    text are those of its chunks.  Texts with a special token's string are encoded whole.
    """
    if any(s in text for s in _special(path)):
        ids = np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    else:
        ids = b"".join(map(_remembered(path).__getitem__, _CHUNK.findall(text)))
    return ids + END_ID.to_bytes(4, "little")


def _tokenize(path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0
        numbers = [0] * window
        size = 4 * window
        kinds = (
            pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary()
        )
        names = "part row doc_id doc_tokens crcs rest number ids".split()

        def handed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)

        for piece in (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
            out: list[tuple] = []
            held = 0
            for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                ids = token_ids(text or "", path)
                whole = len(ids) // size
                crcs = [zlib.crc32(ids[i * size : (i + 1) * size]) for i in range(whole)]
                left = ids[whole * size :]
                rest = len(left) // 4
                out.append((part, row, doc_id, len(ids) // 4, crcs, rest, numbers[rest], left))
                numbers[rest] += 1
                row += 1
                held += len(left) + 8 * whole
                if held >= HANDED:
                    yield handed(out)
                    out, held = [], 0
            if out:
                yield handed(out)

    return run


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Shallow combinations of lengths that fill a window: all pairs, and triples of frequent ones."""
    have = set(lengths.tolist())
    found = [(a, window - a) for a in have if a <= window - a and window - a in have]
    often = lengths[np.argsort(-counts, kind="stable")]
    for a in often.tolist():
        if len(found) >= TRIPLES:
            break
        for b in often.tolist():
            c = window - a - b
            if a <= b <= c and c in have:
                found.append((a, b, c))
    return found


def repeats(histogram: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """How often each combination is used: non-negative least squares, rounded down.

    ``histogram[n]`` rests have length n.  The multiplicative steps keep counts positive
    and lessen the squared error; what rounding takes from a length it does not have is
    given back, so no length is used more often than it occurs.
    """
    lengths = np.flatnonzero(histogram[1:]) + 1
    combos = combinations(lengths, histogram[lengths].astype(float), window)
    if not combos:
        return [], np.zeros(0, np.int64)
    depth = max(map(len, combos))
    # One more column stands for "no length"; its demand is never counted.
    table = np.array([list(c) + [window] * (depth - len(c)) for c in combos])
    real = table < window
    demand = histogram.astype(float)[: window + 1]
    demand = np.pad(demand, (0, window + 1 - len(demand)))
    wanted = np.where(real, demand[table], 0).sum(1)
    share = np.bincount(table[real], minlength=window + 1)
    x = np.where(real, demand[table] / np.maximum(share[table], 1), np.inf).min(1) + 1e-9
    for _ in range(STEPS):
        used = np.zeros(window + 1)
        np.add.at(used, table[real], np.repeat(x, real.sum(1)))
        x *= wanted / np.maximum(np.where(real, used[table], 0).sum(1), 1e-12)
    times = np.floor(x + 1e-6).astype(np.int64)
    free = histogram.astype(np.int64).copy()
    for i in np.argsort(-x, kind="stable"):
        own, need = np.unique(table[i][real[i]], return_counts=True)
        times[i] = max(0, min(times[i], int((free[own] // need).min())))
        free[own] -= need * times[i]
    # Rounded-off fractions: use what still fits, one combination after the other.
    for i in np.argsort(-(x - np.floor(x)), kind="stable"):
        own, need = np.unique(table[i][real[i]], return_counts=True)
        more = int((free[own] // need).min())
        times[i] += more
        free[own] -= need * more
    return combos, times


def _layout(histogram: np.ndarray, window: int) -> tuple[list[tuple], list[tuple], int]:
    """Runs of rest numbers and where they go, both bounded by the number of lengths.

    Placed runs are (rest, first number, last, first sequence, offset): one rest in each of
    consecutive sequences.  Left runs are (rest, first number, first place): they lie end to
    end on a line of ids that is cut into windows.
    """
    combos, times = repeats(histogram, window)
    taken = [0] * (window + 1)
    placed, sequence = [], 0
    for combo, n in zip(combos, times.tolist()):
        if not n:
            continue
        offset = 0
        for rest in combo:
            placed.append((rest, taken[rest], taken[rest] + n - 1, sequence, offset))
            taken[rest] += n
            offset += rest
        sequence += n
    left, place = [], 0
    for rest in range(window - 1, 0, -1):
        n = int(histogram[rest]) - taken[rest]
        if n:
            left.append((rest, taken[rest], place))
            place += rest * n
    return placed, left, sequence


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row for each piece: whose ids it holds and where they lie.

    Null texts count as empty and are the end id alone; repeated rows are packed like
    others.  Sequences are numbered from 0 without gaps; all but the last are full.  Other
    columns are not looked at.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = stored(narrow.mapInArrow(_tokenize(tokenizer, window), _ROWS), "pack-ids")
    parts = rows.groupBy("part", "rest").agg(
        F.count("*").alias("n"), F.sum(F.size("crcs")).alias("whole")
    )
    counts = stored(parts, "pack-counts")
    totals = counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()
    histogram = np.zeros(window + 1, np.int64)
    for r in totals:
        histogram[r["rest"]] = r["n"]
    histogram[0] = 0
    placed, left, n_placed = _layout(histogram, window)
    n_left = -(-sum(r * (int(histogram[r]) - first) for r, first, _ in left) // window)
    return _full(rows, window, n_placed + n_left).union(
        _rests(rows, counts, placed, left, n_placed, window)
    )


_OUT = "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()


def _full(rows: DataFrame, window: int, first: int) -> DataFrame:
    """Pieces that fill a window; numbered by part, then by row and piece."""
    whole = rows.where(F.size("crcs") > 0).select("part", "row", "doc_id", "doc_tokens", "crcs")
    blocks = whole.withColumn("block", F.floor(F.col("row") / 1024))
    sums = blocks.groupBy("part", "block").agg(F.sum(F.size("crcs")).alias("n"))
    by_part = sums.groupBy("part").agg(F.sum("n").alias("n"))
    parts = by_part.select(
        "part", (F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("part")) - F.col("n")).alias("base")
    )
    before = F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n")
    bases = sums.withColumn("before", before).join(parts, "part").select(
        "part", "block", (F.col("base") + F.col("before")).alias("base")
    )
    inside = F.sum(F.size("crcs")).over(Window.partitionBy("part", "block").orderBy("row")) - F.size("crcs")
    numbered = blocks.withColumn("inside", inside).join(bases, ["part", "block"])
    pieces = numbered.select("*", F.posexplode("crcs").alias("piece", "crc"))
    return pieces.select(
        "doc_id",
        (F.col("piece").cast("bigint") * window).alias("start"),
        F.lit(window).cast("bigint").alias("length"),
        F.col("crc").alias("ids_crc32"),
        "doc_tokens",
        (F.col("base") + F.col("inside") + F.col("piece") + first).cast("bigint").alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    ).select(*_OUT)


def _table(spark, runs: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame(
        [tuple(map(int, r)) for r in runs], ", ".join(f"{n} bigint" for n in names.split())
    )


def _rests(
    rows: DataFrame, counts: DataFrame, placed: list, left: list, n_placed: int, window: int
) -> DataFrame:
    spark = rows.sparkSession
    upto = F.sum("n").over(Window.partitionBy("rest").orderBy("part")) - F.col("n")
    bases = counts.where("rest > 0").select("part", "rest", upto.alias("base"))
    numbered = (
        rows.where("rest > 0")
        .select("part", "row", "doc_id", "doc_tokens", "rest", "number", "ids")
        .join(bases, ["part", "rest"])
        .withColumn("number", F.col("number") + F.col("base"))
        .drop("base")
    )
    start = (F.col("doc_tokens") - F.col("rest")).cast("bigint")
    # At most a few thousand runs, whatever the corpus: bounded by lengths and combinations.
    run = F.broadcast(_table(spark, placed, "_rest lo hi sequence offset"))
    inside = (F.col("rest") == F.col("_rest")) & F.col("number").between(F.col("lo"), F.col("hi"))
    combined = numbered.join(run, inside).select(
        "doc_id",
        start.alias("start"),
        F.col("rest").cast("bigint").alias("length"),
        F.crc32("ids").cast("bigint").alias("ids_crc32"),
        "doc_tokens",
        (F.col("sequence") + F.col("number") - F.col("lo")).alias("sequence_id"),
        "offset",
    )
    line = F.broadcast(_table(spark, left, "_rest lo place"))
    over = numbered.join(line, (F.col("rest") == F.col("_rest")) & (F.col("number") >= F.col("lo")))
    at = F.col("place") + (F.col("number") - F.col("lo")) * F.col("rest")
    over = over.withColumn("at", at).withColumn(
        "cut",
        F.explode(F.expr(f"sequence(floor(at / {window}), floor((at + rest - 1) / {window}))")),
    )
    first = F.greatest("at", F.col("cut") * window)
    end = F.least(F.col("at") + F.col("rest"), (F.col("cut") + 1) * window)
    over = over.withColumn("first", first).withColumn("len", end - first)
    ids = F.expr("substring(ids, cast((first - at) * 4 + 1 as int), cast(len * 4 as int))")
    cut = over.select(
        "doc_id",
        (start + F.col("first") - F.col("at")).alias("start"),
        F.col("len").cast("bigint").alias("length"),
        F.crc32(ids).cast("bigint").alias("ids_crc32"),
        "doc_tokens",
        (F.col("cut") + n_placed).cast("bigint").alias("sequence_id"),
        (F.col("first") - F.col("cut") * window).cast("bigint").alias("offset"),
    )
    return combined.select(*_OUT).union(cut.select(*_OUT))
