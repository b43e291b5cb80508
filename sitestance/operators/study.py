"""Study queries over the long tables (Q1 - Q12).

All of them explode pre-reduced arrays and aggregate with mergeable functions, so
what is shuffled is one row per group and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitestance import config
from sitestance.functions.rows import exploded, inlined
from sitestance.operators.robots import agent_label, agent_rows


def _with_totals(counts: DataFrame, docs: DataFrame, count: str) -> DataFrame:
    totals = docs.groupBy("crawl").agg(F.count("*").alias("total"))
    # One row per crawl.
    return counts.join(F.broadcast(totals), "crawl").withColumn(
        "share", F.round(F.col(count) / F.col("total"), 6)
    )


def agents_named(profiles: DataFrame) -> DataFrame:
    """Q1: share of parsed robots.txt files naming each agent, per crawl."""
    parsed = profiles.where(F.col("is_parsed"))
    counts = (
        exploded(parsed, ["crawl"], "useragents", "agent")
        .groupBy("crawl", "agent")
        .agg(F.count("*").alias("docs"))
    )
    return _with_totals(counts, parsed, "docs").drop("total")


def agents_blocked(profiles: DataFrame, k: int | None = None) -> DataFrame:
    """Q2: blanket bans per crawl and agent, ranked; ``k`` keeps the top of each crawl."""
    counts = (
        agent_rows(profiles)
        .groupBy("crawl", agent_label(F.col("agent")).alias("agent"))
        .agg(F.count_if("disallow_all").alias("blocked"))
        .where(F.col("blocked") > 0)
    )
    # At most one row per crawl and tracked agent by now.
    order = Window.partitionBy("crawl").orderBy(F.desc("blocked"), "agent")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def bias_summary(profiles: DataFrame) -> DataFrame:
    """Q3: average bias and its sign, per crawl and agent."""
    bias = F.col("bias")
    return (
        agent_rows(profiles)
        .where(bias.isNotNull())
        .groupBy("crawl", "agent")
        .agg(
            F.count("*").alias("docs"),
            F.round(F.avg(bias), 6).alias("avg_bias"),
            F.count_if(bias < 0).alias("negative"),
            F.count_if(bias == 0).alias("neutral"),
            F.count_if(bias > 0).alias("positive"),
        )
    )


def change_over_crawls(counts: DataFrame, key: str, value: str) -> DataFrame:
    """Q4: adds the previous crawl's value and the difference, per key."""
    # ``counts`` has one row per key and crawl, so a partition holds one per crawl.
    order = Window.partitionBy(key).orderBy("crawl")
    previous = F.lag(value).over(order)
    return counts.withColumn("previous", previous).withColumn(
        "change", F.round(F.col(value) - F.col("previous"), 6)
    )


def annotation_prevalence(annotated: DataFrame) -> DataFrame:
    """Q5: pages per annotation key and crawl.

    Keys are unique within a page, so no distinct count is needed.
    """
    counts = (
        exploded(annotated, ["crawl"], "annotations.key", "key")
        .groupBy("crawl", "key")
        .agg(F.count("*").alias("urls"))
    )
    return _with_totals(counts, annotated, "urls").drop("total")


def directive_frequency(annotated: DataFrame, keys: list[str]) -> DataFrame:
    """Q6: how often each directive value occurs under ``keys``, per crawl."""
    wanted = inlined(annotated, ["crawl"], "annotations", "key").where(F.col("key").isin(*keys))
    return (
        exploded(wanted, ["crawl", "key"], "values", "directive")
        .groupBy("crawl", "key", "directive")
        .agg(F.count("*").alias("n"))
    )


def status_breakdown(profiles: DataFrame, exact: bool = False) -> DataFrame:
    """Q7: documents by status and content type with subtotals, and size quantiles.

    ``exact`` sorts all sizes of a group; the default keeps a mergeable sketch.
    """
    quantile = F.percentile if exact else F.percentile_approx
    size = F.col("content_length")
    return (
        profiles.rollup("crawl", "status", "content_type")
        .agg(
            F.count("*").alias("docs"),
            F.round(quantile(size, F.lit(0.5)).cast("double"), 6).alias("p50"),
            F.round(quantile(size, F.lit(0.95)).cast("double"), 6).alias("p95"),
            F.grouping_id().cast("bigint").alias("level"),
        )
    )


def size_buckets(profiles: DataFrame) -> DataFrame:
    """Q7: documents per power-of-two size bucket and status."""
    size = F.col("content_length")
    bucket = F.when(size > 0, F.length(F.bin(size)) - 1).otherwise(F.lit(-1)).cast("int")
    return profiles.groupBy("crawl", "status", bucket.alias("bucket")).agg(
        F.count("*").alias("docs")
    )


def by_dimension(rows: DataFrame, *dimensions: str) -> DataFrame:
    """Q8: any of the tables counted over a cube of dimensions."""
    return rows.cube(*dimensions).agg(
        F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level")
    )


def sitemap_and_delay(profiles: DataFrame) -> DataFrame:
    """Q9: adoption of sitemaps and crawl delays per crawl."""
    return profiles.groupBy("crawl").agg(
        F.count("*").alias("docs"),
        F.count_if(F.col("num_sitemaps") > 0).alias("with_sitemap"),
        F.count_if(F.col("crawldelay").isNotNull()).alias("with_delay"),
        F.max("crawldelay").alias("max_delay"),
    )


def restricts(directive: Column) -> Column:
    """Whether one robots directive forbids something, possibly for one bot only."""
    low = F.lower(directive)
    return low.rlike(config.RESTRICTS) & ~F.startswith(low, F.lit("max-"))


def mechanisms(pages: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Q10: pages per combination of control mechanisms.

    The pages already carry meta, header, robots and TDM columns after the single
    origin join, so a combination is a row-local text.
    """
    parts = [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()]
    combination = F.concat_ws("+", *parts)
    return pages.groupBy(
        "crawl", F.when(combination == "", F.lit("none")).otherwise(combination).alias("combination")
    ).agg(F.count("*").alias("pages"))


def licences_linked(annotated: DataFrame) -> DataFrame:
    """Q11: Creative Commons licence kinds linked, per crawl."""
    wanted = inlined(annotated, ["crawl"], "annotations", "key").where(
        F.col("key").isin("parse.creativecommons", "parse.rel.license")
    )
    links = exploded(wanted, ["crawl", "key"], "values", "link")
    kind = F.regexp_extract(
        F.lower("link"), r"creativecommons\.org/(?:licenses|publicdomain)/([a-z0-9+-]+)", 1
    )
    return links.groupBy(
        "crawl", "key", F.when(kind != "", kind).otherwise(F.lit("other")).alias("licence")
    ).agg(F.count("*").alias("links"))


def distinct_agents(profiles: DataFrame, approximate: bool = False) -> DataFrame:
    """Q12: number of different agents named, per crawl."""
    named = exploded(profiles, ["crawl"], "useragents", "agent")
    count = F.approx_count_distinct if approximate else F.count_distinct
    return named.groupBy("crawl").agg(count("agent").alias("agents"))
