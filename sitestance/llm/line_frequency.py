"""Quality rules by cross-document line frequency (operator 2).

Every line is normalised (lower case, white space squeezed) and hashed.  A line that many
documents of one host have is boilerplate and is removed; a document that loses more than
half of its words that way is depleted and rejected.  ``source`` stands for the host.

Copies of a text are not different documents, and their lines are not boilerplate.  So equal
texts of a host have one vote for a line, and so have near copies: texts that are linked by
four fifths of equal shingles (``alike``).  A line's documents are its distinct classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitestance.llm.alike import near_links, sketch
from sitestance.llm.common import components, fresh, look_up, stored

# Documents of one host, at least, that share a line which is removed.
MIN_DOCUMENTS = 10
# Share of a document's words that removed lines may hold.
MAX_REMOVED = 0.5
MIN_WORDS = 50
MAX_REPEATED = 0.5
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
WINDOW = 3
SEED = 42

_SCHEMA = (
    "row bigint, doc_id bigint, source string, content bigint, sketch binary, n_words bigint, word_chars bigint, "
    "n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "lines array<struct<line:bigint,words:bigint,at:array<int>>>"
)
_LINE = pa.struct([("line", pa.int64()), ("words", pa.int64()), ("at", pa.list_(pa.int32()))])
_ARROW = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("source", pa.string()), ("content", pa.int64()), ("sketch", pa.binary())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("lines", pa.list_(_LINE))]
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that the text has twice or more."""
    if len(words) <= WINDOW:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    known = len(numbers)
    windows = ids[:-2] * known + ids[1:-1]
    if known**3 >= 1 << 63:
        windows = np.unique(windows, return_inverse=True)[1]
    windows = windows * known + ids[2:]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(WINDOW):
        covered[shift : len(words) - WINDOW + 1 + shift] |= again
    return int(covered.sum())


def _measure(text: str | None) -> tuple:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n_white = len(data) - len(data.translate(None, WHITE))
    seen: set[bytes] = set()
    n_dup = 0
    found: dict[int, list] = {}
    for at, line in enumerate(data.split(b"\n")):
        parts = line.split()
        if not parts:
            continue
        n_dup += line in seen
        seen.add(line)
        norm = b" ".join(parts).decode("utf-8", "surrogatepass").lower()
        key = xxhash.xxh64_intdigest(norm.encode("utf-8", "surrogatepass"), SEED)
        entry = found.setdefault(key, [0, []])
        entry[0] += len(parts)
        entry[1].append(at)
    hashes = np.fromiter(found, np.uint64, len(found))
    lines = [
        {"line": h, "words": w, "at": at}
        for h, (w, at) in zip(hashes.astype(np.int64).tolist(), found.values())
    ]
    n_repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or n_repeat > MAX_REPEATED * len(words)
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    content = SEED if text is None else xxhash.xxh64_intdigest(data, SEED)
    signed = content - (1 << 64) if content >> 63 else content
    chars = len(text or "") - n_white
    return signed, sketch(data), len(words), chars, n_symbols, n_dup, n_repeat, failed, lines


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        measured = list(zip(*map(_measure, batch.column(2).to_pylist())))
        if not measured:
            continue
        rows = pa.array(range(row, row + batch.num_rows), pa.int64())
        row += batch.num_rows
        columns = [rows, batch.column(0), batch.column(1)]
        columns += [pa.array(v, f.type) for v, f in zip(measured, list(_ARROW)[3:])]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def measures(docs: DataFrame) -> DataFrame:
    """Stored figures and lines of every row; ``row`` tells equal rows apart."""
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    return stored(narrow.mapInArrow(_batches, _SCHEMA), "line-measures")


def frequent_lines(figures: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``(source, line)`` of the lines that at least so many documents of the host have."""
    node = F.xxhash64("source", "content").alias("node")
    lines = figures.select("source", node, F.explode("lines.line").alias("line"))

    def often(votes: DataFrame, name: str) -> DataFrame:
        counted = votes.distinct().groupBy("source", "line").agg(F.count("*").alias("n"))
        return stored(counted.where(F.col("n") >= min_documents).select("source", "line"), name)

    # A line has no more classes than different texts, so near copies are sought for few texts.
    likely = often(lines, "likely-lines")
    carriers = look_up(lines, likely, ["source", "line"], spread=["node"], how="inner")
    carriers = stored(carriers.select("source", "line", "node").distinct(), "line-carriers")
    texts = figures.select(node, "source", "sketch").groupBy("node").agg(
        F.first("source").alias("scope"), F.first("sketch").alias("sketch")
    )
    texts = stored(texts.join(carriers.select("node").distinct(), "node", "left_semi"), "line-texts")
    roots = stored(components(near_links(texts), "line-classes"), "line-roots")
    named = look_up(carriers, roots, ["node"], spread=["line"])
    return often(named.select("source", "line", F.coalesce("root", "node").alias("class")), "frequent-lines")


def verdicts(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Figures of every row, its removed lines and words, and whether it is kept.

    Null texts have no words and fail the base rules; rows without source form one host.
    Repeated rows are kept and count as copies.  Other columns are not looked at.
    """
    figures = measures(docs)
    lines = figures.select("row", "source", F.explode("lines").alias("l")).select(
        "row", "source", "l.line", "l.words", "l.at"
    )
    frequent = frequent_lines(figures, min_documents).withColumn("_frequent", F.lit(True))
    removed = (
        look_up(lines, frequent, ["source", "line"], spread=["row"], how="inner")
        .groupBy("row")
        .agg(F.sum("words").alias("removed_words"), F.flatten(F.collect_list("at")).alias("removed_lines"))
    )
    joined = figures.drop("lines", "sketch").join(removed, "row", "left")
    n_removed = F.coalesce("removed_words", F.lit(0))
    depleted = n_removed > MAX_REMOVED * F.col("n_words")
    return joined.withColumns(
        {
            "removed_words": n_removed.cast("bigint"),
            "removed_lines": F.coalesce("removed_lines", F.array().cast("array<int>")),
            "kept": ~F.col("base_failed") & ~depleted,
        }
    )


def digest(docs: DataFrame) -> DataFrame:
    """The query's form."""
    return verdicts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "removed_words",
    )


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents with their columns, without their frequent lines.

    ``n_chars``, if there is one, follows the text.  Texts without such lines stay as they are.
    """
    found = verdicts(docs).where("not kept or size(removed_lines) > 0")
    keys = ["doc_id", "source", "content"]
    changes = stored(
        found.groupBy(*keys).agg(
            F.first("kept").alias("_kept"), F.first("removed_lines").alias("_removed")
        ),
        "line-changes",
    )
    names = {n: fresh(docs, n) for n in ("_kept", "_removed", "_content", "_id")}
    changes = changes.withColumnsRenamed(
        {"_kept": names["_kept"], "_removed": names["_removed"], "content": names["_content"], "doc_id": names["_id"]}
    )
    tagged = docs.withColumns(
        {names["_content"]: F.xxhash64("text"), names["_id"]: F.col("doc_id").cast("bigint")}
    )
    joined = look_up(
        tagged,
        changes,
        [names["_id"], "source", names["_content"]],
        spread=[names["_id"]],
        weight=F.size(names["_removed"]) + 1,
    ).where(F.coalesce(names["_kept"], F.lit(True)))
    removed = F.col(names["_removed"])
    left = F.filter(F.split("text", "\n", -1), lambda line, at: ~F.array_contains(removed, at))
    changed = F.coalesce(F.size(removed), F.lit(0)) > 0
    text = F.when(changed, F.array_join(left, "\n")).otherwise(F.col("text"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", length)
    return out.select(*docs.columns)
