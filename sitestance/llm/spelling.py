"""Spelling variants by asymmetric q-chunks (operator 11).

Two words are near if one edit of one code point makes one the other.  The shorter word (either,
if they are as long) contributes two disjoint chunks, its halves; the longer one its positional
grams of the same lengths.  One edit touches one chunk at most, so the other is a gram of the
longer word, at its own place or one further on.  Which of the two is known beforehand: an
edit in or after the second chunk leaves the first where it is, and one before it moves
the second by the difference in length.  So of all positional grams only those four are
written that a partner of either length could meet.

Halves of short words are common.  What a preserved chunk leaves over differs by one edit as
well, so it is chunked in the same way, and words meet on about three quarters of their code
points.  Every meeting is verified.  A meeting point is bounded by the alphabet: its words
differ only in the last quarter.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitestance.llm.common import look_up, stored

LEAST_LENGTH = 6
LEAST_COUNT = 5
# How many times as frequent a word's form is.
RATIO = 5
# A run loses a code point if this divides its hash.
DELETES = 199
# Different words, and their code points, that a task counts before it hands them on.
HELD, HELD_CHARS = 300_000, 1 << 24

# Letters as one byte each: A-Z, a-z and U+00C0 to U+00FF; anything else is a blank.
_LETTERS = bytes(b if chr(b).isascii() and chr(b).isalpha() or b >= 0xC0 else 32 for b in range(256))


def words_of(doc_id: int | None, text: str) -> Iterator[bytes]:
    """The text's words in Latin-1, some with a code point deleted; those too short left out."""
    prefix = zlib.crc32(("" if doc_id is None else str(doc_id)).encode() + b":")
    runs = Counter(text.encode("latin-1", "replace").lower().translate(_LETTERS).split(b" "))
    for run, n in runs.items():
        if len(run) < LEAST_LENGTH:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
        if h % DELETES == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        yield run, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, int] = {}
    size = 0

    def hand_over() -> pa.RecordBatch:
        names = [w.decode("latin-1") for w in held]
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"]
        )

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word, n in words_of(doc_id, text or ""):
                known = held.get(word)
                if known is None:
                    size += len(word)
                held[word] = n + (known or 0)
            if len(held) > HELD or size > HELD_CHARS:
                yield hand_over()
                held, size = {}, 0
    yield hand_over()


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of every word of LEAST_COUNT occurrences or more."""
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counts = narrow.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counts.where(F.col("n") >= LEAST_COUNT), "spelling-words")


def halves(word: str) -> list[tuple[int, str, str]]:
    """The two chunks, each with what it leaves over."""
    half = len(word) // 2
    return [(0, word[:half], word[half:]), (1, word[half:], word[:half])]


def grams(word: str, length: int) -> list[tuple[int, str, str]]:
    """The grams that a chunk of a word of that length, equal or less by one, can meet."""
    half, shift = length // 2, len(word) - length
    second = half + shift
    return [(0, word[:half], word[half:]), (1, word[second:], word[:second])]


def _key(length: int, first: int, second: int, chunk: str, inner: str) -> int:
    key = xxhash.xxh64_intdigest(f"{length} {first} {second} {chunk} {inner}".encode())
    return key - (1 << 64) if key >> 63 else key


def chunk_keys(word: str) -> set[int]:
    """Where a word waits for longer ones and for those as long."""
    return {
        _key(len(word), first, second, chunk, inner)
        for first, chunk, rest in halves(word)
        for second, inner, _ in halves(rest)
    }


def gram_keys(word: str) -> set[int]:
    """Where a word looks for shorter ones and for those as long."""
    return {
        _key(length, first, second, chunk, inner)
        for length in (len(word), len(word) - 1)
        for first, chunk, rest in grams(word, length)
        for second, inner, _ in grams(rest, length - len(chunk))
    }


def _keyed(keys):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(key, w, n) for w, n in zip(words, counts) for key in keys(w)]
            kinds = (pa.int64(), pa.string(), pa.int64())
            columns = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "w", "n"])

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: every pair of near words once."""
    def meeting(keys, side: str) -> DataFrame:
        return words.select("word", "n").mapInArrow(_keyed(keys), f"key bigint, {side} string, n_{side} bigint")

    met = meeting(chunk_keys, "a").join(meeting(gram_keys, "b"), "key")
    # Words as long as each other meet both ways.
    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    near = met.where(once & (F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    return near.select("a", "n_a", "b", "n_b").distinct()


def _weight(name: str):
    return F.length(name) / 64 + 1


def variants(docs: DataFrame) -> DataFrame:
    """Every word with its form and root, as the query returns them.

    Null and empty texts have no words.  A row without id hashes its runs behind an empty id; repeated
    rows count again.  Of forms of equal count the least in code-point order is taken.  Other
    columns are not looked at; without words the result is empty.
    """
    words = vocabulary(docs)
    pairs = stored(near_pairs(words), "spelling-pairs")
    both = pairs.select("a", F.col("b").alias("other"), F.col("n_b").alias("n_other")).union(
        pairs.select("b", "a", "n_a")
    )
    best = F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best")
    found = both.groupBy(F.col("a").alias("near_of")).agg(F.count("*").alias("n_near"), best)
    rows = words.join(found, F.col("word") == F.col("near_of"), "left")
    has = -F.col("best.less") >= RATIO * F.col("n")
    rows = stored(
        rows.select(
            "word",
            F.when(has, F.col("best.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(has, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    # Counts grow RATIO-fold along a chain, so its length is known; each turn doubles what is followed.
    steps = rows.where("form is not null").select("word", F.col("form").alias("root"))
    most = rows.agg(F.max("n")).first()[0] or LEAST_COUNT
    longest = int(math.log(most / LEAST_COUNT, RATIO)) + 1
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        steps = stored(steps, "spelling-steps")
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        joined = look_up(steps, ahead, ["root"], ["word"], weight=_weight("ahead"))
        steps = joined.select("word", F.coalesce("ahead", "root").alias("root"))
    steps = steps.select("word", F.col("root").alias("_root"))
    named = rows.join(steps, "word", "left")
    return named.select(
        "word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n"
    )
