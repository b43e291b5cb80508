"""The subpackage's queries, ``name -> (spark, sf_dir)``, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitestance.llm import (
    hyper_minhash,
    line_frequency,
    minhash,
    mixing,
    packing,
    phrases,
    secrets,
    sharding,
    simhash,
    site_tree,
    spelling,
    suffix_dedup,
    toxicity,
)
from sitestance.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(read(spark, sf_dir, table))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_minhash": _over("documents", minhash.digest),
    "op2_line_frequency": _over("documents", line_frequency.digest),
    "op3_sharding": _over("documents", sharding.assign),
    "op4_secrets": _over("documents", secrets.digest),
    "op5_toxicity": op5_toxicity,
    "op6_packing": _over("documents", packing.pack),
    "op7_site_tree": _over("pages", site_tree.extract),
    "op8_simhash": _over("documents", simhash.digest),
    "op9_suffix_dedup": _over("documents", suffix_dedup.dedup),
    "op10_mixing": _over("documents", mixing.mix),
    "op11_spelling": _over("documents", spelling.variants),
    "op12_hyperminhash": _over("documents", hyper_minhash.near_duplicates),
    "op13_phrases": _over("documents", phrases.collocations),
}
ORACLE: dict[str, str] = {
    "op4_secrets": secrets.ORACLE_SQL,
    "op10_mixing": mixing.ORACLE_SQL,
    "op13_phrases": phrases.ORACLE_SQL,
}
