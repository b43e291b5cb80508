"""Phrase collocation mining by SON partitioning (operator 13).

The documents of a language are dealt into SHARDS shards.  A phrase that has SUPPORT
occurrences has, in one shard at least, its share of them by the shard's size; so every shard
is mined completely at that lowered support, level by level (words, then phrases of two
words whose words are frequent there, and so on).  The union over the shards holds every
frequent phrase; one more pass counts all of it exactly, over all documents, and scores it.

A shard is any number of tasks: each gathers partial counts of a bounded number of positions,
and Spark sums them by shard and phrase.  The number of shards is fixed, since more of them
would lower the support until nothing is pruned.  While shards are mined, phrases go by 64-bit
hashes, and a level is pruned by a Bloom filter of the level below, of bounded size; a false hit
costs a count and drops nothing.  Words are taken apart once for all levels: each shard's are stored
as hashes and numbers.  The last pass counts the words themselves, not hashes.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitestance.llm.common import look_up, salt_of, stored

SUPPORT = 100
LONGEST = 5
# Lengths that are mined together; few phrases pass the third level.
LEVELS = ((1,), (2,), (3,), (4, 5))
TOP = 2000
SHARDS = 8
# Positions whose counts a task gathers before it hands them on.
POSITIONS = 1 << 21
# Words a task remembers, and their bytes.
WORDS, WORD_BYTES = 400_000, 1 << 24
# Bits of a filter for each phrase, and of the largest filter (16 MB); a larger corpus is pruned less.
BITS, MOST_BITS = 16, 1 << 27
PROBES = 3

_BREAK = b"."
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _BREAK * 10 + b" ")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def tokens(text: str) -> list[bytes]:
    """Words of a text with a full stop wherever a piece ends; no word holds one."""
    data = text.encode("utf-8", "surrogatepass").lower().translate(_PIECES)
    return data.replace(_BREAK, b" . ").split()


class Words(dict):
    """Numbers of words, 0 for the end of a piece, and their hashes."""

    def __init__(self) -> None:
        super().__init__({_BREAK: 0})
        self.names, self.hashes, self.size = [_BREAK], array("Q", [0]), 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.names)
        self.names.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word) | 1)
        self.size += len(word)
        return number

    def full(self) -> bool:
        return len(self) > WORDS or self.size > WORD_BYTES


def phrase_hashes(words: np.ndarray, seed: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For phrases of 1, 2, … words: the hash of each position's phrase, and whether a piece holds it."""
    h, whole = mix(words + np.uint64(seed)), words != 0
    yield h, whole
    for k in range(2, longest + 1):
        n = max(0, len(words) - k + 1)
        after = words[k - 1 :]
        h, whole = mix(h[:n] * _ODD + after), whole[:n] & (after != 0)
        yield h, whole


def shard_key(h: np.ndarray, shard: int) -> np.ndarray:
    return mix(h ^ np.uint64((shard + 1) * int(_ODD) % (1 << 64)))


def _bits_of(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    out = []
    for _ in range(PROBES):
        out.append(keys & np.uint64(bits - 1))
        keys = mix(keys + _ODD)
    return out


class Filter:
    """A Bloom filter: whatever was put in is found."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        self.bits = 8 * len(data)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where the keys are that may have been put in; a further bit is read only where those before are set."""
        found = np.arange(len(keys))
        for probe in range(PROBES):
            if probe:
                keys = mix(keys + _ODD)
            at = keys & np.uint64(self.bits - 1)
            hit = (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
            found, keys = found[hit], keys[hit]
        return found

    def holds(self, keys: np.ndarray) -> np.ndarray:
        held = np.zeros(len(keys), bool)
        held[self.places(keys)] = True
        return held


def bloom(rows: DataFrame, by_shard: bool) -> bytes:
    """The filter of stored phrase hashes ``(shard, h)``; at most MOST_BITS go to the driver."""
    count = rows.count()
    bits = min(MOST_BITS, 1 << max(6, (BITS * count - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(1).to_numpy().view(np.uint64)
            if by_shard:
                shards = batch.column(0).to_numpy(zero_copy_only=False)
                h = mix(h ^ ((shards.astype(np.uint64) + np.uint64(1)) * _ODD))
            at = np.unique(np.concatenate(_bits_of(h, bits)))
            slots, first = np.unique(at >> np.uint64(6), return_index=True)
            ones = np.uint64(1) << (at & np.uint64(63))
            values = np.bitwise_or.reduceat(ones, first) if len(at) else ones
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots.astype(np.int64)), pa.array(values.view(np.int64))], ["slot", "bits"]
            )

    parts = rows.select("shard", "h").mapInArrow(run, "slot bigint, bits bigint")
    found = parts.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    data = np.zeros(bits // 64, np.int64)
    data[found.column("slot").to_numpy()] = found.column("bits").to_numpy()
    return data.tobytes()


def _gather(
    emit: Callable[[Words, str, int, int, np.ndarray], Iterator[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``(lang, shard, need, text)``: hands over the positions of each (lang, shard), so many at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Words(), {}, 0

        def hand_over() -> Iterator[pa.RecordBatch]:
            for (lang, shard, need), parts in held.items():
                yield from emit(words, lang, shard, need, np.concatenate(parts))

        for batch in batches:
            for lang, shard, need, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = tokens(text)
                found.append(_BREAK)
                ids = np.fromiter(map(words.__getitem__, found), np.int32, len(found))
                held.setdefault((lang, shard, need), []).append(ids)
                size += len(ids)
                if size >= POSITIONS or words.full():
                    yield from hand_over()
                    held, size = {}, 0
                    if words.full():
                        words = Words()
        yield from hand_over()

    return run


def _lang_seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))


def _counts(ids: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different words of some positions: numbers, hashes and counts."""
    counts = np.bincount(ids, minlength=1)
    counts[0] = 0
    found = np.flatnonzero(counts)
    return found, np.array(words.hashes)[found], counts[found]


def _numbered(words: Words, lang: str, shard: int, need: int, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row: the hashes of the different words, and each position's place among them (from 1, 0 ends a piece)."""
    found, own, _ = _counts(ids, words)
    width = 2 if len(found) < 1 << 16 else 4
    places = np.zeros(len(words.names), f"<u{width}")
    places[found] = np.arange(1, len(found) + 1)
    row = (lang, shard, need, width, own.astype("<u8").tobytes(), places[ids].tobytes())
    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _CHUNK)], schema=_CHUNK)


_CHUNK = pa.schema(
    [("lang", pa.string()), ("shard", pa.int32()), ("need", pa.int64()), ("width", pa.int32())]
    + [("words", pa.binary()), ("places", pa.binary())]
)


def chunks(rows: DataFrame) -> DataFrame:
    """The positions of ``rows (lang, shard, need, text)``, a stored row for so many of a language and shard."""
    parts = rows.mapInArrow(
        _gather(_numbered), "lang string, shard int, need bigint, width int, words binary, places binary"
    )
    # Rows are large: readers take a row group's at once.
    return stored(parts, "phrases-chunks", {"parquet.block.size": 1 << 25})


def _local(levels: tuple[int, ...], below: bytes | None):
    """Partial counts ``(shard, h, need, n)`` of phrases of so many words, from ``chunks``.

    Their parts of the length under the first of ``levels`` must all be in the filter ``below``.
    """
    names = ["shard", "h", "need", "n"]

    def partial(parts: list[tuple], lang: str, shard: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        seed = np.uint64(_lang_seed(lang))
        if below is None:
            h = mix(np.concatenate([own for own, _ in parts]) + seed)
            counts = np.concatenate([np.bincount(at, minlength=len(own) + 1)[1:] for own, at in parts])
            order = np.argsort(h)
            h, counts = h[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            yield h[first], np.add.reduceat(counts, first) if len(h) else counts
            return
        often = None
        words = np.concatenate([np.concatenate([np.zeros(1, np.uint64), own])[at] for own, at in parts])
        for k, (h, whole) in enumerate(phrase_hashes(words, int(seed), levels[-1]), 1):
            if k == levels[0] - 1 == 1:
                # Words are looked up once each, not at each of their places.
                known = (Filter(below).holds(shard_key(mix(own + seed), shard)) for own, _ in parts)
                often = np.concatenate([np.concatenate([[False], held])[at] for held, (_, at) in zip(known, parts)])
            elif k == levels[0] - 1:
                often = Filter(below).holds(shard_key(h, shard))
            elif k in levels:
                often = often[: len(h)] & often[1 : len(h) + 1]
                h = np.sort(h[whole & often])
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                yield h[first], np.diff(np.append(first, len(h)))

    def emit(group: tuple[str, int, int], parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        lang, shard, need = group
        for h, counts in partial(parts, lang, shard):
            fixed = [pa.array(np.full(len(h), v, t)) for v, t in ((shard, np.int32), (need, np.int64))]
            columns = [fixed[0], pa.array(h.view(np.int64)), fixed[1], pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple]] = {}
        size = 0
        for batch in batches:
            fixed = zip(*(batch.column(c).to_pylist() for c in range(4)))
            for (lang, shard, need, width), words, places in zip(fixed, batch.column(4), batch.column(5)):
                own, at = np.frombuffer(words.as_buffer(), "<u8"), np.frombuffer(places.as_buffer(), f"<u{width}")
                held.setdefault((lang, shard, need), []).append((own, at))
                size += len(at)
                if size >= POSITIONS:
                    for group, parts in held.items():
                        yield from emit(group, parts)
                    held, size = {}, 0
        for group, parts in held.items():
            yield from emit(group, parts)

    return run


def _exact(candidates: bytes):
    """Partial counts ``(lang, phrase, k, n)`` of phrases that the filter holds; k = 0 counts all words."""
    names = ["lang", "phrase", "k", "n"]
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("n", pa.int64())])

    def emit(words: Words, lang: str, shard: int, need: int, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        wanted, seed = Filter(candidates), _lang_seed(lang)
        name = words.names.__getitem__
        found, own, counts = _counts(ids, words)
        known = wanted.holds(mix(own + np.uint64(seed)))
        phrases = [""] + [name(i).decode("utf-8", "surrogatepass") for i in found[known].tolist()]
        sizes = [0] + [1] * (len(phrases) - 1)
        counts = [int(counts.sum())] + counts[known].tolist()
        # Other words end a piece as well; of the ends that follow each other one stays.
        kept = np.zeros(len(words.names), np.int32)
        kept[found[known]] = found[known]
        ids = kept[ids]
        ids = ids[(ids > 0) | np.concatenate([[True], ids[:-1] > 0])]
        held = ids > 0
        for k, (h, _) in enumerate(phrase_hashes(np.array(words.hashes)[ids], seed, LONGEST), 1):
            if k == 1:
                continue
            # A candidate's first and last k - 1 words are candidates as well.
            at = np.flatnonzero(held[: len(h)] & held[1 : len(h) + 1])
            at = at[wanted.places(h[at])]
            held = np.zeros(len(h), bool)
            held[at] = True
            order = np.argsort(h[at], kind="stable")
            same, rows = h[at[order]], ids[at[order][:, None] + np.arange(k)]
            differs = (rows[1:] != rows[:-1]).any(axis=1)
            if (differs & (same[1:] == same[:-1])).any():  # two phrases with one hash
                rows = rows[np.lexsort(rows.T)]
                differs = (rows[1:] != rows[:-1]).any(axis=1)
            first = np.flatnonzero(np.concatenate([[True], differs])) if len(rows) else np.zeros(0, np.int64)
            counts += np.diff(np.append(first, len(rows))).tolist()
            sizes += [k] * len(first)
            phrases += [b" ".join(map(name, row)).decode("utf-8", "surrogatepass") for row in rows[first].tolist()]
        columns = [[lang] * len(counts), phrases, sizes, counts]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], names)

    return _gather(emit)


def dealt(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS) -> DataFrame:
    """``lang, shard, need, text`` of every document; ``need`` is the support lowered to the shard's share of bytes."""
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        salt_of(F.col("text"), F.col("doc_id"), salts=shards).alias("shard"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    sizes = rows.groupBy("lang", "shard").agg(F.sum(F.octet_length("text").cast("bigint")).alias("size"))
    total = sizes.groupBy("lang").agg(F.sum("size").alias("total")).withColumnRenamed("lang", "_lang")
    share = F.expr(f"(cast({support} as decimal(20,0)) * size + total - 1) div total")
    needs = sizes.join(total, F.col("lang") == F.col("_lang")).select(
        "lang", "shard", F.when(F.col("total") > 0, F.greatest(share, F.lit(1))).otherwise(1).alias("need")
    )
    with_need = look_up(rows, stored(needs, "phrase-shards"), ["lang", "shard"], ["text"], weight=F.length("lang") + 1)
    return with_need.select("lang", "shard", F.col("need").cast("bigint").alias("need"), "text")


def mined(rows: DataFrame) -> DataFrame:
    """``shard, h`` of every phrase that is frequent in a shard."""
    found, below, parts = [], None, chunks(rows)
    for levels in LEVELS:
        partial = parts.mapInArrow(_local(levels, below), "shard int, h bigint, need bigint, n bigint")
        summed = partial.groupBy("shard", "h").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
        often = stored(summed.where("n >= need").select("shard", "h"), f"phrases-of-{levels[0]}")
        found.append(often)
        if often.isEmpty():
            break
        below = bloom(often, by_shard=True)
    return reduce(DataFrame.union, found)


def counted(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS) -> DataFrame:
    """``lang, phrase, k, n``: exact counts of every phrase of 1 to LONGEST words with that support.

    Rows of k = 0 hold the number of all words of a language.
    """
    rows = dealt(docs, support, shards)
    candidates = bloom(mined(rows), by_shard=False)
    partial = rows.mapInArrow(_exact(candidates), "lang string, phrase string, k int, n bigint")
    summed = partial.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n"))
    return stored(summed.where((F.col("n") >= support) | (F.col("k") == 0)), "phrase-counts")


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """The first ``top`` phrases of each language, as the query returns them.

    Null texts have no words; a null language is ``und``.  Repeated rows count again, rows
    without id like others, and ties end with the phrase itself, so ranks are without gaps.  A language without
    candidates has no rows.  Other columns are not looked at.
    """
    counts = counted(docs, support, shards)
    found = counts.where("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"))
    # A phrase inside a longer one of equal count lies inside one with a single word more as well.
    parts = F.array(
        F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)")
    )
    inside = found.where("k >= 3").select("lang", F.explode(parts).alias("phrase"), "a").distinct()
    kept = found.join(inside, ["lang", "phrase", "a"], "left_anti")
    cuts = kept.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    cuts = cuts.withColumns(
        {
            "first": F.expr("substring_index(phrase, ' ', cut)"),
            "rest": F.expr("substring_index(phrase, ' ', cut - k)"),
        }
    )
    parts = counts.where("k between 1 and 4").select("lang", F.col("phrase").alias("part"), "n")
    cuts = look_up(
        cuts, parts.select("lang", F.col("part").alias("first"), F.col("n").alias("l")),
        ["lang", "first"], ["phrase"], "inner", weight=F.length("first") / 64 + 1,
    )
    cuts = look_up(
        cuts, parts.select("lang", F.col("part").alias("rest"), F.col("n").alias("r")),
        ["lang", "rest"], ["phrase"], "inner", weight=F.length("rest") / 64 + 1,
    )
    totals = counts.where("k = 0").select("lang", F.col("n").alias("total"))
    cuts = look_up(cuts, totals, ["lang"], ["phrase"], "inner", weight=F.length("lang") + 1)
    wide = "cast({} as decimal(38,0))"
    score = F.expr(
        f"({wide.format('1000')} * {wide.format('a')} * {wide.format('total')}) div "
        f"({wide.format('l')} * {wide.format('r')})"
    )
    least = F.min(F.struct(score.alias("score"), "cut", "l", "r", F.col("total").alias("n"))).alias("m")
    scored = cuts.groupBy("lang", "phrase", "a").agg(least).select("lang", "phrase", "a", "m.l", "m.r", "m.n", "m.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each part of a language first, so that no task orders a whole one.
    spread = Window.partitionBy("lang", salt_of(F.col("phrase"))).orderBy(*order)
    best = scored.withColumn("rank", F.row_number().over(spread)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_GRAMS = "\n    UNION ALL\n    ".join(
    f"SELECT lang, array_to_string(w[i:i + {k - 1}], ' ') AS phrase, {k} AS k "
    f"FROM (SELECT lang, w, unnest(generate_series(1, len(w) - {k - 1})) AS i FROM pieces WHERE len(w) >= {k})"
    for k in range(1, LONGEST + 1)
)
ORACLE_SQL = f"""
WITH pieces AS (
    SELECT lang, string_split_regex(piece, '[ \\t]+') AS w FROM (
        SELECT lang, trim(unnest(string_split_regex(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]'
        )), ' ' || chr(9)) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents)
    ) WHERE piece <> ''
), grams AS (
    {_GRAMS}
), counts AS (
    SELECT lang, phrase, k, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= {SUPPORT}
), totals AS (
    SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang
), found AS (
    SELECT lang, phrase, string_split(phrase, ' ') AS w, k, n AS a FROM counts WHERE k >= 2
), inside AS (
    SELECT DISTINCT lang, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase, a
    FROM found WHERE k >= 3
), kept AS (
    SELECT f.* FROM found f ANTI JOIN inside i ON f.lang = i.lang AND f.phrase = i.phrase AND f.a = i.a
), cuts AS (
    SELECT *, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:k], ' ') AS rest
    FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM kept)
), scored AS (
    SELECT c.lang, c.phrase, c.a, x.n AS l, y.n AS r, t.n, c.cut,
        (1000::HUGEINT * c.a * t.n) // (x.n::HUGEINT * y.n) AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first
        JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang
), least AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
    a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM least QUALIFY rank <= {TOP}
"""
