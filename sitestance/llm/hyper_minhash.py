"""Near-duplicates by HyperMinHash (operator 12).

A document's set holds the hashes of its distinct four-word shingles.  The first seven bits of
a hash choose one of 128 registers; of the least value in a register the number of leading
zeros (six bits) and the ten bits after the first one are stored.  Registers of large sets
are banded in fours: two of likeness 0.8 share none of the 32 bands once in 2 * 10^7 pairs.

Texts that share a band are candidates.  Their likeness is estimated from equal registers, less
the matches that chance makes among registers so compressed, and only a pair that could still
reach 0.8 (four standard errors off) is verified, by the full sets of both texts.

Bands are as wide as a set's size allows: of two small sets that are alike few registers differ, so
few and wide bands will do, and short texts do not meet by a single line that they share.

Candidates are compared without forming all pairs.  First each text meets the head of each
of its bands; its likeliest head is verified, and what is linked forms a component.  Texts that
likely pairs join, through heads or others, are kin.  A band whose texts are all kin needs nothing more; in the
others the texts outside the band's largest family are compared with all of the band, block by
block and in registers of four bits, and one likely pair is enough to join two families.  So no likely pair
lies in two families.  In each, the full sets of the texts outside the largest component meet those of all,
block by block; what they share is counted by products of matrices.  Rows follow the texts, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitestance.llm.common import components, look_up, stored

SHINGLE = 4
# Likeness in hundredths.
THRESHOLD = 80
REGISTER_BITS, MANTISSA_BITS = 7, 10
REGISTERS = 1 << REGISTER_BITS
# Least sizes of the classes of sets, and how many bands each has: the fewer shingles, the fewer
# registers can differ and the wider a band may be.
CLASSES = ((1, 1), (5, 32), (10, 16), (16, 12), (24, 12), (36, 14), (52, 18), (76, 24), (111, 32))
# An estimate may be off by so many standard errors before a pair is given up.
ERRORS = 4.0
# Texts of a band that are compared at once.
BLOCK = 256
# Pairs of blocks that are looked at together.
COMPARED = 1 << 15
# Sets that are compared at once with those of a block, and texts of a block.
CELL, MOST = 512, 4096
REMEMBERED = 200_000
# Shingles of a block of texts, and of the sets that a task of the verification remembers.
HELD = 1 << 20
# A shingle that sets have in one of so many pairs is counted by matrices of so many columns.
DENSE, COLUMNS = 128, 1024

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STARTS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - REGISTER_BITS)
# Text weighs so many characters a row where a table is measured before it is broadcast.
_CHARS = 64


class _Hashes(dict):
    """64-bit hashes of words, remembered within a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < REMEMBERED and len(word) < 64:
            self[word] = h
        return h


_HASHES = _Hashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The text's set: sorted distinct 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(w))
    n = len(w) - width + 1 if width else 0
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = _mix(h * _ODD + w[i : n + i])
    return np.unique(h)


def sketch(hashes: np.ndarray) -> bytes:
    """Two bytes for each register, zero where it is empty."""
    first = np.searchsorted(hashes, _STARTS)
    filled = first < np.append(first[1:], len(hashes))
    # 53 bits are exact as floating-point numbers, whose exponent counts the leading zeros.
    least = (hashes[first[filled]] << np.uint64(REGISTER_BITS)) >> np.uint64(11)
    mantissa, exponent = np.frexp(least.astype(np.float64))
    after = np.maximum((2 * mantissa - 1) * (1 << MANTISSA_BITS), 0).astype(np.int64)
    registers = np.zeros(REGISTERS, "<u2")
    registers[filled] = ((54 - exponent) << MANTISSA_BITS) + after
    return registers.tobytes()


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The share of registers in which two sets of n and m members with nothing in common agree."""
    a, b = n[:, None] / REGISTERS, m[:, None] / REGISTERS
    low = 0.5 ** np.arange(1, 54)
    within = np.exp(-(a + b) * low) - np.exp(-(a + b) * 2 * low)
    return (a * b / (a + b) * within * low / (1 << MANTISSA_BITS)).sum(axis=1)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard likeness of rows of registers, and the registers it rests on."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    sizes, which = np.unique(np.stack([n, m]), axis=1, return_inverse=True)
    by_chance = np.minimum(chance(*sizes)[which.reshape(-1)] * REGISTERS / used, 0.5)
    return (same / used - by_chance) / (1 - by_chance), used


def likely(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows could reach the threshold, and the estimates of those that sizes and registers allow.

    Sizes and the registers that differ must allow it: each of those holds a shingle that only one
    set has.  Within that the estimate may be off by ERRORS; the fewer shingles the union can
    have, the more of them the registers show and the smaller is the error.
    """
    least = THRESHOLD / 100
    keep = 100 * np.minimum(n, m) >= THRESHOLD * np.maximum(n, m)
    keep &= np.count_nonzero(a != b, axis=1) * (100 + THRESHOLD) <= (100 - THRESHOLD) * (n + m)
    near, left = np.zeros(len(keep)), np.flatnonzero(keep)
    if not len(left):
        return keep, near
    n, m = n[left], m[left]
    found, used = estimate(a[left], b[left], n, m)
    union = (n + m) / (1 + least)
    unseen = np.clip((union - used) / np.maximum(union - 1, 1), 0, 1)
    error = np.sqrt(least * (1 - least) / used * unseen) + 1 / (n + m)
    near[left], keep[left] = found, found >= least - ERRORS * error
    return keep, near


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, sketches = [], []
        for text in batch.column(2).to_pylist():
            hashes = shingles(text)
            sizes.append(len(hashes))
            sketches.append(sketch(hashes) if len(hashes) else None)
        columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "content", "n", "sketch"])


def _narrow(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(text)).alias("content"), "text")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _estimated(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, near`` of the ``pairs (a, b)`` that could be alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in (2, 3))
            if not len(n):
                continue
            keep, near = likely(_registers(batch.column(4)), _registers(batch.column(5)), n, m)
            columns = [batch.column(0), batch.column(1), pa.array(near)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in columns], ["a", "b", "near"])

    one = texts.select(F.col("node").alias("a"), "n", "sketch")
    other = texts.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("of_b"))
    used = stored(other.join(pairs.select("b").distinct(), "b", "left_semi"), "hyper-heads")
    both = look_up(pairs.join(one, "a"), used, ["b"], ["a"], "inner", weight=F.lit(2 * REGISTERS // _CHARS))
    return both.select("a", "b", "n", "m", "sketch", "of_b").mapInArrow(run, "a bigint, b bigint, near double")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    size = 0

    def known(node: int, text: str) -> np.ndarray:
        nonlocal size
        found = held.get(node)
        if found is None:
            found = shingles(text)
            if size > HELD:
                held.clear()
                size = 0
            held[node] = found
            size += len(found)
        return found

    for batch in batches:
        keep = []
        for a, b, one, other in zip(*(batch.column(c).to_pylist() for c in range(4))):
            own, of_b = known(a, one), known(b, other)
            shared = len(np.intersect1d(own, of_b, assume_unique=True))
            keep.append(100 * shared >= THRESHOLD * (len(own) + len(of_b) - shared))
        alike = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(alike) for c in (0, 1)], ["a", "b"])


def _bodies(used: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, text`` of the nodes ``used``."""
    named = stored(texts.select("node", "content").join(used, "node", "left_semi"), "hyper-used")
    found = look_up(_narrow(docs), named, ["content"], ["doc_id"], "inner")
    return stored(found.groupBy("node").agg(F.first("text").alias("text")), "hyper-texts-used")


def verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """The stored ``pairs (a, b)`` whose full sets are alike."""
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    bodies = _bodies(used, texts, docs)
    one = bodies.select(F.col("node").alias("a"), "text")
    other = bodies.select(F.col("node").alias("b"), F.col("text").alias("of_b"))
    other = other.join(pairs.select("b").distinct(), "b", "left_semi")
    weight = F.length("of_b") / _CHARS + 1
    both = look_up(pairs.join(one, "a"), stored(other, "hyper-others"), ["b"], ["a"], "inner", weight=weight)
    both = both.select("a", "b", "text", "of_b").sortWithinPartitions("b")
    return both.mapInArrow(_verify, "a bigint, b bigint")


def _members(texts: DataFrame) -> DataFrame:
    """``node, band, key`` of every text and each of its bands that is not empty.

    A text belongs to the class of its size, and to the next one if a text there may be alike.
    """
    classes = []
    for (low, bands), above in zip(CLASSES, [c[0] for c in CLASSES[1:]] + [1 << 62]):
        joins = (100 * F.col("n") >= THRESHOLD * low) & (F.col("n") < above)
        classes.append(F.when(joins, F.struct(F.lit(low).alias("low"), F.lit(bands).alias("bands"))))
    rows = texts.select("node", "sketch", F.explode(F.array(*classes)).alias("of")).where("of is not null")
    rows = rows.select("node", "sketch", "of.*").withColumn("band", F.explode(F.expr("sequence(0, bands - 1)")))
    first, end = (f"({i} * {REGISTERS}) div bands" for i in ("band", "(band + 1)"))
    band, zeros = (
        F.expr(f"substring({of}, cast(2 * ({first}) as int) + 1, cast(2 * (({end}) - ({first})) as int))")
        for of in ("sketch", f"X'{'00' * 2 * REGISTERS}'")
    )
    key = F.when(band != zeros, F.xxhash64(band, "band", "low"))
    return rows.select("node", "band", key.alias("key")).where("key is not null")


def _headed(rows: DataFrame) -> DataFrame:
    """``node, band, key, head`` of the members of shared bands.

    The head is the text that has most company in all its bands: of a group of near copies, the
    one from which the others stem.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(look_up(rows, stored(sizes, "hyper-keys"), ["key"], ["node"], "inner"), "hyper-shared")
    company = met.groupBy("node").agg(F.sum("n").alias("company"))
    known = met.select("node", "key").join(company, "node")
    heads = known.groupBy("key").agg(F.max(F.struct("company", "node")).alias("top")).select("key", "top.node")
    heads = stored(heads.withColumnRenamed("node", "head"), "hyper-band-heads")
    return stored(look_up(met.drop("n"), heads, ["key"], ["node"], "inner"), "hyper-met")


def _coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, n, coarse`` of rows ``node, n, sketch``: four bits for a register, zero where it is empty."""
    for batch in batches:
        if not len(batch):
            continue
        registers = _registers(batch.column(2))
        small = np.where(registers > 0, 1 + _mix(registers.astype(np.uint64)) % np.uint64(15), 0).astype(np.uint8)
        packed = (small[:, ::2] << 4) | small[:, 1::2]
        columns = [batch.column(0), batch.column(1), pa.array(map(bytes, packed), pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["node", "n", "coarse"])


class _Members:
    """The members of a batch's lists, field by field, and where each list begins."""

    def __init__(self, lists: pa.ListArray):
        sizes = lists.value_lengths().fill_null(0).to_numpy()
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        flat = lists.flatten()
        self.node, self.comp, self.n = (flat.field(f).to_numpy() for f in ("node", "comp", "n"))
        self.few = flat.field("few").to_numpy(zero_copy_only=False)
        packed = np.frombuffer(b"".join(flat.field("coarse").to_pylist()), np.uint8).reshape(-1, REGISTERS // 2)
        self.coarse = np.stack([packed >> 4, packed & 15], axis=2).reshape(-1, REGISTERS)


def _lists(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Pairs as rows ``a, bs``: the smaller end of each pair once, with the larger ones."""
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    ends, first = np.unique(pairs[0], return_index=True)
    bs = pa.ListArray.from_arrays(pa.array(np.append(first, pairs.shape[1]), pa.int32()), pa.array(pairs[1], pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), bs], ["a", "bs"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Likely pairs of blocks ``others`` and ``some``; where that is null, the few among the others.

    Coarse registers that differ are of registers that differ, so no pair is given up that whole
    registers would keep.
    """
    for batch in batches:
        if not len(batch):
            continue
        some, others = (_Members(batch.column(c)) for c in (0, 1))
        alone = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        found, held = [], 0

        def kept() -> Iterator[pa.RecordBatch]:
            a, b, n, m, one, other = (np.concatenate(x) for x in zip(*found))
            keep, _ = likely(one, other, n, m)
            if keep.any():
                yield _lists(a[keep], b[keep])

        for row in range(len(batch)):
            own, all_ = (some, others) if not alone[row] else (others, others)
            i = np.arange(own.starts[row], own.ends[row])
            i = i[own.few[i]]
            j = np.arange(all_.starts[row], all_.ends[row])
            n, m = own.n[i][:, None], all_.n[j]
            met = (own.comp[i][:, None] != all_.comp[j]) & (~all_.few[j] | (all_.node[j] > own.node[i][:, None]))
            met &= 100 * np.minimum(n, m) >= THRESHOLD * np.maximum(n, m)
            x, y = np.nonzero(met)
            if len(x):
                x, y = i[x], j[y]
                found.append((own.node[x], all_.node[y], own.n[x], all_.n[y], own.coarse[x], all_.coarse[y]))
                held += len(x)
            if held >= COMPARED:
                yield from kept()
                found, held = [], 0
        if found:
            yield from kept()


class _Forest:
    """Which labels are joined so far."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.top(a), self.top(b)
        self.above[a] = b
        return a != b

    def top(self, label: int) -> int:
        above = self.above
        while (up := above.get(label, label)) != label:
            above[label] = label = above.get(up, up)
        return label


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the likely pairs of blocks so many ``a, b`` as join what they all join."""
    forest = _Forest()
    for batch in _compare(batches):
        rows = zip(*(batch.column(c).to_pylist() for c in (0, 1)))
        found = [(a, b) for a, bs in rows for b in bs if forest.join(a, b)]
        if found:
            columns = [pa.array(c, pa.int64()) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b"])


def _across(met: DataFrame, kin: DataFrame, texts: DataFrame) -> DataFrame:
    """Likely pairs ``a, b`` that join what all likely pairs join of texts that share a band and are not yet ``kin``.

    ``met`` has rows (node, key), ``kin`` the node and root of texts that likely pairs join already.
    """
    labelled = look_up(met, kin, ["node"], ["key"]).select("key", "node", F.coalesce("root", "node").alias("comp"))
    labelled = stored(labelled, "hyper-labelled")
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    mixed = stored(mixed.select("key"), "hyper-mixed")
    rows = look_up(labelled, mixed, ["key"], ["node"], "inner")
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("size"))
    largest = F.max(F.struct("size", "comp")).alias("top")
    groups = sizes.groupBy("key").agg(largest, F.sum("size").alias("whole")).select(
        "key", F.col("top.comp").alias("top"), "whole", (F.col("whole") - F.col("top.size")).alias("rest")
    )
    rows = look_up(rows, stored(groups, "hyper-groups"), ["key"], ["node"], "inner")
    rows = rows.withColumn("few", F.col("comp") != F.col("top"))
    coarse = texts.select("node", "n", "sketch").mapInArrow(_coarse, "node bigint, n bigint, coarse binary")
    rows = stored(rows.join(coarse, "node"), "hyper-rows-across")
    member = F.struct("node", "comp", "n", "coarse", "few")

    def blocks(part: DataFrame, size: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("node"), F.ceil(F.col(size) / BLOCK)).alias("block")
        return part.groupBy("key", block).agg(F.collect_list(member).alias(name)).drop("block")

    # Most bands are a single block.
    one = rows.where(F.col("whole") <= BLOCK).groupBy("key").agg(F.collect_list(member).alias("others"))
    large = rows.where(F.col("whole") > BLOCK)
    pairs = blocks(large.where("few"), "rest", "some").join(blocks(large, "whole", "others"), "key")
    pairs = pairs.select("some", "others").unionByName(one.select("others"), allowMissingColumns=True)
    return pairs.select("some", "others").mapInArrow(_joining, "a bigint, b bigint")


def _shared(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many members each set of ``one`` shares with each of ``other``.

    Members that many sets hold are counted by products of matrices, the others one by one.
    """
    sizes = np.array([len(s) for s in (*one, *other)])
    _, member = np.unique(np.concatenate((*one, *other)), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    cut = int(sizes[: len(one)].sum())
    times, of_other = (np.bincount(x, minlength=member.max() + 1) for x in (member[:cut], member[cut:]))
    met = times * of_other
    common = met * DENSE > len(one) * len(other)
    shared = np.zeros((len(one), len(other)), np.float32)
    place = np.where(common, np.cumsum(common) - 1, -1)[member]
    order = np.argsort(place, kind="stable")
    ends = np.searchsorted(place[order], np.arange(0, int(common.sum()) + COLUMNS, COLUMNS))
    for lo, hi in zip(ends[:-1], ends[1:]):
        at = order[lo:hi]
        if len(at):
            held = np.zeros((len(sizes), COLUMNS), np.float32)
            held[row[at], place[at] % COLUMNS] = 1
            shared += held[: len(one)] @ held[len(one) :].T
    rare = (met > 0) & ~common
    left = np.flatnonzero(rare[member[:cut]])
    by_member = np.argsort(member[cut:], kind="stable")
    owner = row[cut:][by_member] - len(one)
    starts = np.cumsum(of_other) - of_other
    counts = of_other[member[left]]
    parts = np.searchsorted(np.cumsum(counts), np.arange(0, int(counts.sum()) + COMPARED, COMPARED) + 1)
    flat = shared.reshape(-1)
    for lo, hi in zip(parts, np.append(parts[1:], len(left))):
        n = counts[lo:hi]
        if len(n):
            at = np.repeat(starts[member[left[lo:hi]]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            pair = np.repeat(row[left[lo:hi]], n) * len(other) + owner[at]
            pair, found = np.unique(pair, return_counts=True)
            flat[pair] += found
    return shared


def _confirm(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links ``a, b`` of texts ``kin, comp, node, text`` on both sides, less those that others imply."""
    found = []
    one, other = ({c: t.column(c).to_numpy() for c in ("kin", "comp", "node")} for t in (left, right))
    texts = [t.column("text").to_pylist() for t in (left, right)]
    orders = [np.argsort(t["kin"], kind="stable") for t in (one, other)]
    for kin in np.unique(one["kin"]):
        i, j = (o[slice(*np.searchsorted(t["kin"][o], [kin, kin + 1]))] for t, o in zip((one, other), orders))
        if not len(j):
            continue
        held = [shingles(texts[1][k]) for k in j]
        sizes, comp = np.array([len(x) for x in held]), other["comp"][j]
        forest = _Forest()
        for lo in range(0, len(i), CELL):
            some = i[lo : lo + CELL]
            own = [shingles(texts[0][k]) for k in some]
            shared = _shared(own, held).astype(np.int64)
            least = THRESHOLD * (np.array([len(x) for x in own])[:, None] + sizes)
            x, y = np.nonzero((shared * (100 + THRESHOLD) >= least) & (one["comp"][some][:, None] != comp))
            pairs = np.stack([one["comp"][some[x]], comp[y]])
            _, first = np.unique(pairs, axis=1, return_index=True)
            ends = zip(*(p[first].tolist() for p in (*pairs, one["node"][some[x]], other["node"][j[y]])))
            found += [(a, b) for of_a, of_b, a, b in ends if forest.join(of_a, of_b)]
    columns = zip(*found) if found else ([], [])
    return pa.table({name: pa.array(c, pa.int64()) for name, c in zip("ab", columns)})


def _within(kin: DataFrame, roots: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """Links ``a, b`` that join the components (``roots``) of texts that are ``kin``, confirmed on full sets.

    The texts outside the largest component meet all texts that are kin, block by block.  A block
    holds about HELD shingles, so rows follow the texts and the blocks, not the pairs.  Texts with few
    kin share the groups of others.
    """
    rows = look_up(kin.withColumnRenamed("root", "kin"), roots, ["node"], ["kin"])
    rows = rows.select("node", "kin", F.coalesce("root", "node").alias("comp"))
    rows = stored(rows.join(texts.select("node", "n"), "node"), "hyper-kin")
    sizes = rows.groupBy("kin", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("load"))
    groups = sizes.groupBy("kin").agg(
        F.max(F.struct("size", "comp", "load")).alias("top"), F.sum("size").alias("size"), F.sum("load").alias("load"),
        F.count("*").alias("comps"),
    ).where("comps > 1")

    def blocks(size: Column, load: Column) -> Column:
        return F.ceil(F.greatest(load / HELD, size / MOST))

    groups = groups.select(
        "kin", F.col("top.comp").alias("top"), "load", blocks(F.col("size"), F.col("load")).alias("blocks"),
        blocks(F.col("size") - F.col("top.size"), F.col("load") - F.col("top.load")).alias("parts"),
    )
    groups = stored(groups, "hyper-kin-groups")
    bins = 1 + (groups.where("blocks = 1").agg(F.sum("load")).first()[0] or 0) // HELD
    rows = look_up(rows, groups.drop("load"), ["kin"], ["node"], "inner")
    rows = stored(rows.withColumn("draw", F.xxhash64("node")), "hyper-kin-rows")
    rows = rows.join(_bodies(rows.select("node"), texts, docs), "node")
    one = rows.where("comp <> top").withColumn("part", F.pmod("draw", "parts"))
    one = one.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    other = rows.withColumn("block", F.pmod("draw", "blocks"))
    other = other.withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))
    few = F.col("blocks") == 1
    alone = F.when(few, F.pmod(F.xxhash64("kin"), F.lit(bins))).otherwise(F.col("kin")).alias("cell")
    fields = [F.col(c).alias(c) for c in ("block", "part", "kin", "comp", "node", "text")]
    sides = [t.select(few.alias("few"), alone, *fields) for t in (one, other)]
    left, right = (t.groupBy("few", "cell", "block", "part") for t in sides)
    return left.cogroup(right).applyInArrow(_confirm, "a bigint, b bigint")


def _united(roots: DataFrame, more: DataFrame) -> DataFrame:
    """``node, root`` after further links ``a, b``: components are joined by their roots alone.

    The turns of this second search pass over linked roots, not over all members again.
    """
    one = look_up(more.select(F.col("a").alias("node"), "b"), roots, ["node"], ["b"])
    one = one.select(F.coalesce("root", "node").alias("one"), F.col("b").alias("node"))
    both = look_up(one, roots, ["node"], ["one"]).select("one", F.coalesce("root", "node").alias("other"))
    over = components(both.select(F.col("one").alias("a"), F.col("other").alias("b")).distinct(), "hyper-components")
    over = stored(over.select(F.col("node").alias("label"), F.col("root").alias("top")), "hyper-over")
    ends = more.select(F.col("a").alias("node")).union(more.select("b")).distinct()
    new = ends.join(roots, "node", "left_anti").select("node", F.col("node").alias("label"))
    every = roots.select("node", F.col("root").alias("label")).union(new)
    return look_up(every, over, ["label"], ["node"]).select("node", F.coalesce("top", "label").alias("root"))


def links(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, root`` of every text that is linked to another."""
    met = _headed(stored(_members(texts), "hyper-bands"))
    pairs = met.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    near = stored(_estimated(stored(pairs, "hyper-pairs"), texts), "hyper-near")
    best = near.groupBy("a").agg(F.max(F.struct("near", "b")).alias("best")).select("a", "best.b")
    # A pair may be each other's best.
    best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = stored(verified(stored(best, "hyper-best"), texts, docs), "hyper-links")
    roots = stored(components(found, "hyper-components"), "hyper-roots")
    # Texts are kin at least to what their likeliest head is linked to.
    heads = near.groupBy("a").agg(F.max_by("b", F.struct("near", "b")).alias("head"))
    heads = look_up(heads, roots.withColumnRenamed("node", "head"), ["head"], ["a"])
    heads = heads.select(F.col("a").alias("node"), F.coalesce("root", "head").alias("root"))
    alone = roots.join(heads, "node", "left_anti")
    across = stored(_across(met.select("node", "key"), stored(heads.unionByName(alone), "hyper-heads-of"), texts), "hyper-across")
    kin = stored(_united(roots, near.select("a", "b").union(across)), "hyper-kin-roots")
    more = stored(_within(kin, roots, texts, docs), "hyper-more")
    if more.isEmpty():
        return roots
    return stored(_united(roots, more), "hyper-roots")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Each document with its set's size and the least ``doc_id`` it is linked to, as the query returns them.

    Null and empty texts have an empty set and are linked with nothing, not even each other.  Equal
    texts are one text: a repeated id or row shares its component, and a row without id takes part,
    with the least id of its component, or null if no member has one.  ``kept`` holds for rows whose id is
    the component's.  Other columns are not looked at.
    """
    rows = stored(_narrow(docs).mapInArrow(_measure, "doc_id bigint, content binary, n bigint, sketch binary"), "hyper-rows")
    texts = rows.where("n > 0").groupBy("content").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    texts = stored(texts.withColumn("node", F.monotonically_increasing_id()), "hyper-texts")
    roots = links(texts, docs)
    named = texts.select("node", "content", "least", "copies").join(roots, "node", "left")
    named = stored(named.where("root is not null or copies > 1").withColumn("root", F.coalesce("root", "node")), "hyper-named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(ids, "root").select("content", "component_id", F.lit(True).alias("linked"))
    out = look_up(rows.drop("sketch"), stored(ids, "hyper-ids"), ["content"], ["doc_id"])
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
