"""Secret scans over a trigram inverted index (operator 4); DataFrame functions only.

A Boolean query over trigrams is derived from each rule's expression: any of some sets of
trigrams must be in a text that matches.  The index maps each of these trigrams to the
texts that hold it; intersected postings name the candidate texts of a rule, and only those
are searched with the expression.  A rule without mandatory trigrams searches every text.

Texts are known by their hash here: equal texts share their postings, and two texts with
one hash merely become candidates of each other's rules.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitestance.llm.common import fresh, let, look_up, running_sums, stored

# Strings that a derivation may branch into, and characters of a class that it spells out.
MAX_STRINGS = 64
MAX_CLASS = 8
REDACTED = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """``least`` characters of group ``group`` make a match count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    # A run of 24 or more is found whole, so shorter runs need not be found and dropped.
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = BASE + (
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)


def _exact(op, arg) -> set[str] | None:
    """All strings that a node of a parsed expression stands for; None if too many."""
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        found: set[str] = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                found.add(chr(value).lower())
            elif kind is C.RANGE and value[1] - value[0] < MAX_CLASS:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= MAX_CLASS else None
    if op is C.SUBPATTERN:
        return _exact_all(arg[-1])
    if op is C.BRANCH:
        options = [_exact_all(branch) for branch in arg[1]]
        return None if None in options else set().union(*options)
    if op is C.MAX_REPEAT and arg[:2] == (0, 1):
        inner = _exact_all(arg[2])
        return None if inner is None else inner | {""}
    return None


def _exact_all(nodes) -> set[str] | None:
    strings = {""}
    for op, arg in nodes:
        options = _exact(op, arg)
        if options is None or len(options) * len(strings) > MAX_STRINGS:
            return None
        strings = {a + b for a, b in product(strings, options)}
    return strings


def trigrams(pattern: str) -> frozenset[frozenset[str]] | None:
    """Sets of trigrams of which a matching text, in lower case, holds one whole; None if unbound."""
    best: set[str] = set()
    strings = {""}
    for op, arg in [*_parser.parse(pattern), (C.ANY, None)]:
        options = _exact(op, arg)
        if options is None or len(options) * len(strings) > MAX_STRINGS:
            if min(map(len, strings)) >= 3 and min(map(len, strings)) > min(map(len, best), default=0):
                best = strings
            strings = {""}
        else:
            strings = {a + b for a, b in product(strings, options)}
    sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in best]
    # A set that holds another one whole asks for nothing the other does not.
    return frozenset(s for s in sets if not any(t < s for t in sets)) or None


def _queries(rules: tuple[Rule, ...]) -> list[tuple[str, list[str]]]:
    """``(kind, trigrams)`` for each alternative of each rule that has mandatory trigrams."""
    found = ((rule.kind, trigrams(rule.pattern)) for rule in rules)
    return [(kind, sorted(t)) for kind, sets in found if sets for t in sorted(sets, key=sorted)]


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(trigram, content)``: the texts, by hash, that hold each trigram the rules ask for."""
    wanted = sorted({t for _, found in _queries(rules) for t in found})
    low = docs.where("text is not null").select(
        F.xxhash64("text").alias("content"), F.lower("text").alias("low")
    )
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted]))
    return low.select("content", F.explode(held).alias("trigram")).distinct()


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(content, kinds)``: the rules whose Boolean query the postings of a text meet."""
    queries = _queries(rules)
    uses: dict[str, list[int]] = {}
    for n, (_, found) in enumerate(queries):
        for trigram in found:
            uses.setdefault(trigram, []).append(n)

    def spelled(values: list) -> Column:
        return F.array(*[F.lit(v) for v in values])

    asked = F.map_from_arrays(spelled(list(uses)), F.array(*[spelled(v) for v in uses.values()]))
    listed = postings(docs, rules).select(
        "content", F.explode(F.element_at(asked, F.col("trigram"))).alias("query")
    )
    met = (
        listed.groupBy("content", "query")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") == F.element_at(spelled([len(t) for _, t in queries]), F.col("query") + 1))
        .select("content", F.element_at(spelled([k for k, _ in queries]), F.col("query") + 1).alias("kind"))
    )
    return stored(met.groupBy("content").agg(F.collect_set("kind").alias("kinds")), "secret-candidates")


def _matches(text: Column, rule: Rule, order: int) -> Column:
    """Spans of the rule in a text: leftmost, non-overlapping, those that count."""
    def starts(found: Column, between: Column) -> Column:
        steps = F.transform(
            found,
            lambda _, i: F.length(F.element_at(between, i + 1)).cast("bigint")
            + F.when(i == 0, F.lit(0)).otherwise(F.length(F.element_at(found, F.greatest(i, F.lit(1))))),
        )
        return running_sums(steps)

    def span(match: Column, start: Column) -> Column:
        counts = F.regexp_extract(match, rule.pattern, rule.group) if rule.group else match
        return F.struct(
            start.alias("start"),
            F.lit(order).alias("rank"),
            (start + F.length(match)).alias("end"),
            F.lit(rule.kind).alias("kind"),
            F.length(counts).alias("size"),
        )

    def spans(found: Column) -> Column:
        between = F.split(text, rule.pattern, -1)
        return let(between, lambda parts: F.zip_with(found, starts(found, parts), span))

    every = let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), spans)
    return F.filter(every, lambda s: s["size"] >= rule.least)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, name: str = "secrets") -> DataFrame:
    """The documents with their columns and an array of spans, ordered by start, then rule.

    Null texts have no spans.  Repeated rows stay; ``content`` of equal texts is looked up
    over salted keys, so a large group of copies does not meet in one task.
    """
    key, kinds = fresh(docs, "_content"), fresh(docs, "_kinds")
    table = candidates(docs, rules).select(F.col("content").alias(key), F.col("kinds").alias(kinds))
    tagged = docs.withColumn(key, F.xxhash64("text"))
    spread = [c for c in ("doc_id",) if c in docs.columns] or [key]
    joined = look_up(tagged, table, [key], spread=spread, weight=F.size(kinds))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,size:int>>")
    parts = []
    for order, rule in enumerate(rules):
        if trigrams(rule.pattern):
            asked = F.array_contains(kinds, rule.kind)
        else:
            asked = F.col("text").rlike(rule.pattern)
        parts.append(F.when(asked, _matches(F.col("text"), rule, order)).otherwise(none))
    return joined.withColumn(name, F.array_sort(F.concat(*parts))).drop(key, kinds)


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def digest(docs: DataFrame) -> DataFrame:
    """The query's form."""
    found = scan(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))

    def count(kind: str) -> Column:
        spans = F.filter("secrets", lambda s: s["kind"] == kind)
        return F.size(spans).cast("bigint").alias(f"n_{kind}")

    counts = [count(rule.kind) for rule in BASE]
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans")
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their columns; every secret in a text gives way to a mark.

    Overlapping spans become one.  ``n_chars``, if there is one, follows the text.
    """
    name = fresh(docs, "_spans")
    found = scan(docs, name=name)
    spans = F.col(name)

    def cut(start: Column, end: Column) -> Column:
        return F.substring(F.col("text"), (start + 1).cast("int"), (end - start).cast("int"))

    def gap(i: Column) -> Column:
        """From the furthest end so far to the start of the next span, or to the text's end."""
        ends = F.transform(F.slice(spans, F.lit(1), i), lambda s: s["end"])
        to = F.when(i < F.size(spans), F.try_element_at(spans, i + 1)["start"]).otherwise(F.length("text"))
        return F.struct(F.coalesce(F.array_max(ends), F.lit(0)).alias("from"), to.cast("bigint").alias("to"))

    gaps = F.transform(F.sequence(F.lit(0), F.size(spans)), gap)
    # Spans that start before the furthest end so far belong to the span before.
    apart = F.filter(gaps, lambda g, i: (i == 0) | (i == F.size(spans)) | (g["to"] >= g["from"]))
    pieces = F.transform(apart, lambda g: cut(g["from"], g["to"]))
    changed = F.size(spans) > 0
    out = found.withColumn(
        "text", F.when(changed, F.array_join(pieces, REDACTED)).otherwise(F.col("text"))
    )
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn(
            "n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        )
    return out.select(*docs.columns)


def _oracle() -> str:
    """DuckDB SQL for the query's rows."""
    parts = []
    for order, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        size = f"regexp_extract(m, '{pattern}', {rule.group})"
        parts.append(
            f"""SELECT doc_id, row, {order} AS rank, '{rule.kind}' AS kind, length({size}) AS size, length(m) AS n,
            sum(p + coalesce(before, 0)) OVER (PARTITION BY row ORDER BY i) AS start
            FROM (SELECT doc_id, row, i, found[i] AS m, length(between[i]) AS p, length(found[i - 1]) AS before
              FROM (SELECT doc_id, row, found, string_split_regex(text, '{pattern}') AS between,
                unnest(range(1, len(found) + 1)) AS i
                FROM (SELECT doc_id, row, text, regexp_extract_all(text, '{pattern}') AS found FROM d
                  WHERE regexp_matches(text, '{pattern}'))))"""
        )
    counted = " UNION ALL ".join(
        f"SELECT * FROM ({part}) WHERE size >= {rule.least}" for part, rule in zip(parts, RULES)
    )
    sums = ", ".join(
        f"CAST(count(*) FILTER (kind = '{rule.kind}') AS BIGINT) AS n_{rule.kind}" for rule in BASE
    )
    span = "concat(kind, ':', CAST(start AS BIGINT), ':', CAST(start + n AS BIGINT))"
    listed = f"string_agg({span}, ',' ORDER BY start, rank)"
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
        s AS ({counted})
        SELECT d.doc_id, {sums},
          sha256(coalesce({listed} FILTER (rank < {len(BASE)}), '')) AS base_sha256,
          coalesce({listed} FILTER (rank IS NOT NULL), '') AS spans
        FROM d LEFT JOIN s ON d.row = s.row GROUP BY d.row, d.doc_id"""


ORACLE_SQL = _oracle()
