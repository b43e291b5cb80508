"""Projection of page metadata into typed index documents."""

from __future__ import annotations

from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitestance import config
from sitestance.functions.rows import multimap

_SPARK_TYPES = {
    "integer": "int", "boolean": "boolean", "date": "timestamp", "keyword": "string", "text": "string",
}


def project(metadata: Column, mapping: list[str] | None = None) -> Column:
    """The multimap reduced to the mapped fields.

    ``a=b`` renames, ``a`` keeps, ``a.*`` keeps every key with that start; fields
    without values are left out, and fields renamed to one name put their values together.  No document is dropped (E1).
    """
    rules = [m.strip() for m in (config.FIELD_MAPPING if mapping is None else mapping)]
    exact, prefixes = {}, []
    for rule in rules:
        source, _, target = (part.strip() for part in rule.partition("="))
        if source.endswith("*"):
            prefixes.append(source[:-1])
        else:
            exact[source] = target or source
    filled = F.filter(
        F.map_entries(metadata),
        lambda e: e["value"].isNotNull() & (F.size(e["value"]) > 0),
    )
    names = F.create_map(*[F.lit(x) for pair in exact.items() for x in pair]) if exact else None

    def field(key: Column) -> Column:
        named = F.try_element_at(names, key) if exact else F.lit(None).cast("string")
        kept = F.lit(False)
        for p in prefixes:
            kept = kept | F.startswith(key, F.lit(p))
        return F.coalesce(named, F.when(kept, key))

    renamed = F.transform(
        filled, lambda e: F.struct(field(e["key"]).alias("key"), e["value"].alias("value"))
    )
    return multimap(F.filter(renamed, lambda e: e["key"].isNotNull()))


def field_type(path: str) -> str:
    """Index type of one path; the first fitting pattern decides."""
    for pattern, kind in config.FIELD_TYPES:
        if fnmatchcase(path, pattern):
            return kind
    return "keyword"


def typed(value: Column, kind: str) -> Column:
    """Text values in the type of their field; what does not fit becomes NULL."""

    def one(v: Column) -> Column:
        if kind == "date":
            return F.timestamp_millis(v.try_cast("bigint"))
        return v.try_cast(_SPARK_TYPES[kind])

    return F.transform(value, one)


def typed_columns(docs: DataFrame, paths: list[str], doc: str = "doc", *carry: str) -> DataFrame:
    """E4 for a known list of fields: one typed column each.

    Single-valued types give the first value, keyword and text all of them.
    """
    columns = []
    for path in paths:
        kind = field_type(path)
        values = typed(F.try_element_at(F.col(doc), F.lit(path)), kind)
        many = kind in ("keyword", "text")
        value = values if many else F.try_element_at(values, F.lit(1))
        columns.append(value.alias(path))
    return docs.select(*carry, *columns)


def type_of(path: Column) -> Column:
    """E4 as an expression, for fields whose names are data."""
    kinds = F
    for pattern, kind in config.FIELD_TYPES:
        regex = "^" + pattern.replace(".", r"\.").replace("*", ".*") + "$"
        kinds = kinds.when(path.rlike(regex), F.lit(kind))
    return kinds.otherwise(F.lit("keyword"))


def typed_maps(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """E4 for dynamic fields: one map per type, so per-agent fields need no pivot."""
    staged = docs.withColumn(
        "_fields",
        F.transform(
            F.map_entries(doc),
            lambda e: F.struct(
                e["key"].alias("key"), e["value"].alias("value"), type_of(e["key"]).alias("kind")
            ),
        ),
    )

    def of(*kinds: str) -> Column:
        return F.filter("_fields", lambda f: f["kind"].isin(*kinds))

    def single(kind: str) -> Column:
        return F.map_from_entries(
            F.transform(
                of(kind),
                lambda f: F.struct(f["key"], F.try_element_at(typed(f["value"], kind), F.lit(1))),
            )
        )

    return staged.withColumns(
        {
            "integers": single("integer"),
            "booleans": single("boolean"),
            "dates": single("date"),
            "strings": F.map_from_entries(
                F.transform(of("keyword", "text"), lambda f: F.struct(f["key"], f["value"]))
            ),
        }
    ).drop("_fields", doc)


def newest_per_url(docs: DataFrame, *order: str) -> DataFrame:
    """One row per URL and index, the last one written wins.

    ``max_by`` merges before the shuffle, so a URL captured very often is no burden.
    """
    keys = [c for c in ("dataset", "crawl", "url") if c in docs.columns]
    rest = [c for c in docs.columns if c not in keys]
    return (
        docs.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
        .select(*keys, "r.*")
    )


def write_index(docs: DataFrame, path: str, rows_per_file: int = 2_000_000) -> None:
    """E5: one partition per dataset and crawl; a rerun replaces its own partitions only."""
    (
        docs.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("dataset", "crawl")
        .parquet(path)
    )
