"""Page-level metadata: host, registered domain, headers, directives, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitestance import config
from sitestance.functions import text, url
from sitestance.operators import captures, skew

SUFFIX_ROWS = 50_000


def with_host(pages: DataFrame) -> DataFrame:
    """M1."""
    return pages.withColumn("host", url.host(F.col("url")))


def with_domain(
    pages: DataFrame, suffixes: DataFrame, depth: int | None = None
) -> DataFrame:
    """M2: the label before the longest public suffix, plus that suffix.

    ``suffixes(suffix, is_wildcard, is_exception)`` holds the rules without ``*.``
    and ``!``; its deepest rule gives ``depth``.  Each of the last ``depth`` stretches of the host is looked up.
    Up to SUFFIX_ROWS rules, counted first, the table is broadcast and no page is shuffled.  A larger
    table is looked up once for each distinct host, not for each page: hosts are narrow and few, and
    pages are shuffled once, to take their host's domain, hot hosts spread out.
    """
    if depth is None:
        labels = F.size(F.split("suffix", r"\.", -1))
        # The look-ups need one rung at least, two for their greatest().
        depth = max(2, suffixes.agg(F.max(labels)).first()[0] or 0)
    _, small = skew.broadcast_if_small(suffixes, SUFFIX_ROWS)
    if not small:
        hosts = pages.select("host").where(F.col("host").isNotNull()).distinct()
        return skew.lookup_join(pages, _domains_by_host(hosts, suffixes, depth), "host")
    flags = suffixes.groupBy("suffix").agg(
        F.bool_or(~F.col("is_wildcard") & ~F.col("is_exception")).alias("plain"),
        F.bool_or("is_wildcard").alias("wild"),
        F.bool_or("is_exception").alias("exempt"),
    )
    out = pages.withColumn("_labels", F.split("host", r"\.", -1))
    for n in range(1, depth + 1):
        key = f"_s{n}"
        stretch = F.when(
            F.size("_labels") >= n, F.array_join(F.slice("_labels", -n, n), ".")
        )
        named = flags.select(
            F.col("suffix").alias(key), *[F.col(c).alias(f"_{c}{n}") for c in ("plain", "wild", "exempt")]
        )
        out = out.withColumn(key, stretch).join(F.broadcast(named), key, "left")
    total = F.size("_labels")
    # Number of labels in the public suffix: an exception shortens its rule by one,
    # a wildcard covers one label more; without any rule the last label counts.
    exempt = F.greatest(*[F.when(F.col(f"_exempt{n}"), n - 1) for n in range(1, depth + 1)])
    plain = F.greatest(*[F.when(F.col(f"_plain{n}"), n) for n in range(1, depth + 1)])
    wild = F.greatest(
        *[F.when(F.col(f"_wild{n}") & (total > n), n + 1) for n in range(1, depth + 1)]
    )
    size = F.coalesce(exempt, F.greatest(plain, wild), F.lit(1))
    domain = _domain(size)
    helpers = ["_labels"] + [
        f"_{c}{n}" for c in ("s", "plain", "wild", "exempt") for n in range(1, depth + 1)
    ]
    return out.withColumn("domain", domain).drop(*helpers)


def _domain(size: Column) -> Column:
    """One label more than the public suffix's ``size``; addresses stay whole."""
    address = F.col("host").rlike(r"^[0-9.]+$|^\[")
    owned = F.array_join(F.slice("_labels", -(size + 1), size + 1), ".")
    return F.when((F.size("_labels") > size) & ~address, owned).when(address, F.col("host"))


def _domains_by_host(hosts: DataFrame, suffixes: DataFrame, depth: int) -> DataFrame:
    """M2 for distinct hosts: every stretch of labels is a row, and one join finds its rules."""
    labels = F.split("host", r"\.", -1)
    lengths = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth)))
    stretches = hosts.select("host", F.size(labels).alias("total"), F.explode(lengths).alias("n"))
    stretches = stretches.withColumn("suffix", F.array_join(F.slice(labels, -F.col("n"), F.col("n")), "."))
    found = skew.lookup_join(stretches, suffixes.dropDuplicates(), "suffix", spread=["host"])
    rule = ~F.col("is_wildcard") & ~F.col("is_exception")
    wild = F.col("is_wildcard") & (F.col("total") > F.col("n"))
    size = F.coalesce(
        F.max(F.when(F.col("is_exception"), F.col("n") - 1)),
        F.max(F.when(wild, F.col("n") + 1).when(rule, F.col("n"))),
        F.lit(1),
    )
    sizes = found.groupBy("host").agg(size.alias("_size")).withColumn("_labels", labels)
    return sizes.select("host", _domain(F.col("_size")).alias("domain"))


def pick_headers(headers: Column, fields: dict[str, str] | None = None) -> Column:
    """M3: the wanted headers as ``array<struct<key, values>>``, absent ones left out."""
    chosen = config.HEADER_FIELDS if fields is None else fields
    picked = F.array(
        *[
            F.struct(
                F.lit(key).alias("key"),
                captures.header_values(headers, F.lit(name)).alias("values"),
            )
            for key, name in chosen.items()
        ]
    )
    return F.filter(picked, lambda p: F.size(p["values"]) > 0)


def split_commas(values: Column) -> Column:
    """M4: every value split at commas, pieces trimmed, blanks dropped."""
    pieces = F.flatten(F.transform(values, lambda v: F.split(v, ",", -1)))
    return F.filter(F.transform(pieces, text.control_trim), lambda p: p != "")


def normalise_directives(values: Column) -> Column:
    """M5: lower case, no blanks around colons, distinct, sorted."""

    def one(value: Column) -> Column:
        # Trailing empty pieces of a split at ":" vanish.
        body = F.regexp_replace(F.lower(value), ":+$", "")
        return F.array_join(F.transform(F.split(body, ":", -1), text.control_trim), ":")

    return F.array_sort(
        F.array_distinct(F.transform(F.filter(values, lambda v: v.isNotNull()), one))
    )


def refine(annotations: Column) -> Column:
    """M4 and M5 over all annotations of a page, in that order."""

    def one(a: Column) -> Column:
        split = F.when(a["key"].isin(*config.COMMA_SPLIT_KEYS), split_commas(a["values"])).otherwise(
            a["values"]
        )
        return F.struct(
            a["key"].alias("key"),
            F.when(a["key"] == config.DIRECTIVE_KEY, normalise_directives(split))
            .otherwise(split)
            .alias("values"),
        )

    return F.filter(F.transform(annotations, one), lambda a: F.size(a["values"]) > 0)


def with_label(pages: DataFrame, labels: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """M6: label of the exact host, NULL without one.

    Larger label tables than ``max_rows`` are joined with hot hosts spread out.
    """
    return skew.small_or_lookup_join(
        pages, labels.select("host", "label"), "host", "left", max_rows
    )


def quarantine(rows: DataFrame, is_bad: Column) -> tuple[DataFrame, DataFrame]:
    """M8: good rows and set-aside rows; nothing is lost silently."""
    bad = F.coalesce(is_bad, F.lit(True))
    return rows.where(~bad), rows.where(bad)
