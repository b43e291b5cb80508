"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from sitestance.operators import html, metadata, policy, robots, skew
from sitestance.plans import catalog, corpora


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_robots_profile_needs_no_exchange(spark, sf_dir):
    assert "Exchange" not in plan(robots.profile(corpora.robots(spark, sf_dir)))


def test_annotations_need_no_exchange_and_read_two_columns(spark, sf_dir):
    text = plan(html.annotate(corpora.annotated_pages(spark, sf_dir)).select("page_id", "annotations"))
    assert "Exchange" not in text
    assert "ReadSchema: struct<page_id:bigint,html:string>" in text


def test_domains_move_no_page(spark, sf_dir):
    pages = metadata.with_host(corpora.read(spark, sf_dir, "pages"))
    text = plan(metadata.with_domain(pages, corpora.suffixes(spark)))
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text


def test_large_suffix_tables_shuffle_pages_once(spark, monkeypatch):
    """However deep the rules are, pages meet one table: their hosts'."""
    monkeypatch.setattr(metadata, "SUFFIX_ROWS", 0)
    monkeypatch.setattr(skew, "hot_keys", lambda *_: [])
    rules = spark.createDataFrame(
        [("uk", False, False), ("co.uk", False, False), ("a.b.c.d.e", True, False)],
        "suffix string, is_wildcard boolean, is_exception boolean",
    )
    hosts = ["x.y.co.uk", "y.uk", "uk", "1.2.3.4", None, "v.w.a.b.c.d.e", "a.b.c.d.e", "." .join("z" * 400)]
    pages = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "id int, host string")
    deep = metadata.with_domain(pages, rules)
    joins = re.findall(r"^.*(?:HashJoin|MergeJoin|LoopJoin)", plan(deep), re.M)
    assert len(joins) == 2  # pages with hosts, and hosts' stretches with rules
    monkeypatch.setattr(metadata, "SUFFIX_ROWS", 100)
    assert sorted(map(str, deep.collect())) == sorted(map(str, metadata.with_domain(pages, rules).select(deep.columns).collect()))


@pytest.mark.parametrize(
    "name",
    ["h0_annotations", "m2_domain", "m6_labels", "r14_verdicts", "r19_profile", "s8_record_lengths",
     "f4_work_list", "q1_agents_named", "q4_change", "q5_annotation_prevalence", "e6_robots_documents"],
)
def test_no_pairing_and_no_python(spark, sf_dir, name):
    text = plan(catalog.CATALOG[name](spark, sf_dir))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "SinglePartition"):
        assert word not in text, (name, word)


def test_study_counts_shuffle_once(spark, sf_dir):
    text = plan(catalog.CATALOG["q6_directive_frequency"](spark, sf_dir))
    assert text.count("Exchange hashpartitioning") == 1


def test_verdicts_build_no_pattern_from_rows(spark, sf_dir):
    """Every expression that is matched is a constant of the plan."""
    probes = corpora.read(spark, sf_dir, "pages").selectExpr("page_id AS doc_id", "url AS path")
    sets = robots.rule_sets(robots.parse(corpora.robots(spark, sf_dir))).select("doc_id", "rule_sets")
    judged = probes.join(sets, "doc_id").select(robots.judge(F.col("path"), F.col("rule_sets")).alias("denied"))
    text = judged._jdf.queryExecution().optimizedPlan().toString()
    judging = text[: text.index("Join")]
    assert "position" in judging or "locate" in judging
    assert not re.search(r"RLIKE\([^,]*, (?:concat|lambda|namedlambda)", judging, re.I)
    assert "regexp_extract(" not in judging


@pytest.mark.parametrize("few", [True, False])
def test_redirects_shuffle_the_stored_log_never(spark, tmp_path, monkeypatch, few):
    """Open rows are shuffled into its buckets; many of them are spread by key as well."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    log = spark.range(3000).selectExpr("concat('robots http://h', id, '/') AS fetch_key", "named_struct('status', 200) AS _log")
    stored = policy._bucketed(log, "fetch_key", str(tmp_path / "log"), f"log_{few}")
    rows = spark.range(9000).selectExpr(
        "id AS origin", "CASE WHEN id % 3 = 0 THEN 'robots http://h1/' ELSE concat('robots http://h', id, '/') END AS fetch_key"
    )
    monkeypatch.setattr(skew, "PLAIN_ROWS", 10_000 if few else 100)
    joined = policy._looked_up(rows, 9000, stored)
    text = plan(joined)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in text
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    expected = rows.join(log, "fetch_key", "left")
    assert joined.exceptAll(expected.select(joined.columns)).isEmpty() and joined.count() == 9000
