from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sitestance.functions import url
from sitestance.operators import policy, skew

FETCH = "url string, kind string, ts timestamp, status int, location string, content_type string, content binary, error string"
T0 = datetime(2024, 1, 1)
R01 = (
    b"User-agent: *\nDisallow: /wp-admin/\nUser-agent: CCBot\nDisallow: /\nUser-agent: Google-Extended\nDisallow: /\n"
)


def row(address, status=200, location=None, content=b"", error=None, kind="robots", ts=T0):
    return (address, kind, ts, status, location, "text/plain", content, error)


def test_validation(spark):
    df = spark.createDataFrame([("",), ("test",), ("http://h/a|b",), (None,)], "url string")
    found = {r["url"]: r["error"] for r in policy.validate(df).collect()}
    assert found == {"test": "test is a malformed URL", "http://h/a|b": None}


def test_origins(spark):
    urls = ["HTTP://Ex.org/x", "https://ex.org/", "https://ex.org:8443/", "http://u:p@a_b.org?x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r["origin"] for r in policy.with_origin(df).collect()] == [
        "http:ex.org:80", "https:ex.org:443", "https:ex.org:8443", "http:a_b.org:80"
    ]
    assert df.select(url.path_query(F.col("url"))).collect()[3][0] == "/?x"


def test_references_against_a_base(spark):
    cases = [
        ("http://a/b/c?d", "e", "http://a/b/e"), ("http://a/b/c", "/e", "http://a/e"), ("http://a/b/c", "//x/y", "http://x/y"),
        ("http://a/b/c", "../e", "http://a/e"), ("http://a/b/c", "./e/..", "http://a/b/"), ("http://a", "e", "http://a/e"),
        ("http://a/b/c", "?q", "http://a/b/c?q"), ("http://a/b", "https://z/../w?x", "https://z/w?x"),
    ]
    df = spark.createDataFrame(cases, "base string, ref string, expected string")
    for r in url.resolver("base", "ref", "found")(df).collect():
        assert r["found"] == r["expected"], r


def test_redirects(spark):
    def chain(host, n):
        hops = [row(f"http://{host}/" + ("robots.txt" if i == 0 else f"h{i}"), 301, f"/h{i + 1}") for i in range(n)]
        return [*hops, row(f"http://{host}/" + (f"h{n}" if n else "robots.txt"))]

    log = [
        *chain("zero", 0), *chain("one", 1), *chain("five", 5), *chain("six", 6),
        row("http://lost/robots.txt", 302), row("http://gone/robots.txt", 302, "http://nowhere/"),
        row("http://mail/robots.txt", 302, "mailto:a@b"), row("http://fail/robots.txt", None, error="timeout"),
        row("http://rel/robots.txt", 307, "x/../r"), row("http://rel/r"),
    ]
    hosts = ["zero", "one", "five", "six", "lost", "gone", "mail", "fail", "rel"]
    starts = spark.createDataFrame(
        [(f"http:{h}:80", "robots", f"http://{h}/robots.txt") for h in hosts], "origin string, kind string, url string"
    )
    done = policy.resolve_redirects(spark.createDataFrame(log, FETCH), starts)
    r = {x["origin"].split(":")[1]: x for x in done.collect()}
    assert len(r) == len(hosts)
    assert [r[h]["num_redirects"] for h in ("zero", "one", "five", "rel")] == [0, 1, 5, 1]
    assert r["six"]["error"] == "Too many redirects" and r["six"]["final_url"] is None
    assert r["lost"]["error"] == "Got redirect response 302 for http://lost/robots.txt without location"
    assert r["gone"]["error"] and r["gone"]["final_url"] == "http://nowhere/"
    assert r["mail"]["error"] == "unknown protocol: mailto" and r["fail"]["error"] == "timeout"
    assert r["rel"]["final_url"] == "http://rel/r"


def test_known_origin_is_reused(spark):
    log = spark.createDataFrame([row("http://a/robots.txt", 301, "https://b/robots.txt")], FETCH)
    starts = spark.createDataFrame([("http:a:80", "robots", "http://a/robots.txt")], "origin string, kind string, url string")
    known = spark.createDataFrame(
        [("robots", "https:b:443", "https://c/r", 200, 4, None)],
        "kind string, origin string, final_url string, code int, num_redirects int, error string",
    )
    r = policy.resolve_redirects(log, starts, known).first()
    assert (r["final_url"], r["code"], r["num_redirects"], r["error"]) == ("https://c/r", 200, 4, None)


def test_known_rules_are_reused(spark):
    names = "origin string, robots_url string, tdmrep_url string"

    def starts(host):
        site = f"http://{host}"
        return spark.createDataFrame([(f"http:{host}:80", f"{site}/robots.txt", f"{site}/.well-known/tdmrep.json")], names)

    first = [
        row("http://b/robots.txt", content=b"User-agent: *\nDisallow: /\n"),
        row("http://b/.well-known/tdmrep.json", content=b'[{"location":"/","tdm-reservation":1}]', kind="tdmrep"),
    ]
    known = policy.as_known(policy.origin_policies(spark.createDataFrame(first, FETCH), starts("b")))
    second = [
        row("http://a/robots.txt", 301, "http://b/robots.txt"),
        row("http://a/.well-known/tdmrep.json", 301, "http://b/.well-known/tdmrep.json", kind="tdmrep"),
    ]
    policies = policy.origin_policies(spark.createDataFrame(second, FETCH), starts("a"), known=known)
    r = policy.page_policies(spark.createDataFrame([("http://a/x",)], "url string"), policies).first()
    assert len(r["denied"]) == 15 and r["tdmrep"]["file"]["num_groups"] == 1


def test_cache(spark):
    days = [0, 3, 8, 9, 16, 17]
    rows = [("o", T0 + timedelta(days=d), i) for i, d in enumerate(days)] + [("p", T0, 9), ("p", T0, 10)]
    hits = policy.cache_hits(spark.createDataFrame(rows, "origin string, ts timestamp, page_id long"))
    found = {r["page_id"]: r["cached"] for r in hits.collect()}
    assert [found[i] for i in range(6)] == [False, True, False, True, False, True]
    assert (found[9], found[10]) == (False, True)


def test_cache_over_many_spans_cuts_the_lineage(spark):
    rows = [("o", T0 + timedelta(days=4 * i), i) for i in range(20)]
    hits = policy.cache_hits(spark.createDataFrame(rows, "origin string, ts timestamp, page_id long"))
    assert sorted((r["page_id"], r["cached"]) for r in hits.collect()) == [(i, i % 2 == 1) for i in range(20)]


def judged(spark, log, pages):
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "page_id long, url string")
    starts = policy.work_list(frame, spark.createDataFrame([], "origin string"))
    policies = policy.origin_policies(spark.createDataFrame(log, FETCH), starts)
    return {r["url"]: r for r in policy.page_policies(frame, policies).collect()}


def test_page_verdicts(spark):
    log = [
        row("http://a/robots.txt", content=R01),
        row("http://b/robots.txt", None, error="x"),
        row("http://c/robots.txt", 404, content=b"User-agent: *\nDisallow: /\n"),
        row("http://a/.well-known/tdmrep.json", content=b'[{"location":"/","tdm-reservation":1}]', kind="tdmrep"),
    ]
    r = judged(spark, log, ["http://a/", "http://a/wp-admin/", "http://b/", "http://c/x", "http://d/"])
    assert r["http://a/"]["denied"] == ["ccbot", "google-extended"]
    assert "bingbot" in r["http://a/wp-admin/"]["denied"]
    assert "CompletelyRandomReferenceUserAgent" in r["http://a/wp-admin/"]["denied"]
    assert r["http://b/"]["denied"] == [] and r["http://d/"]["denied"] == []
    assert len(r["http://c/x"]["denied"]) == 15
    assert r["http://a/"]["tdmrep"]["file"]["num_groups"] == 1


def test_newest_fetch_counts(spark):
    log = [
        row("http://a/robots.txt", content=b"User-agent: *\nDisallow: /\n"),
        row("http://a/robots.txt", content=b"", ts=T0 + timedelta(days=1)),
    ]
    assert judged(spark, log, ["http://a/x"])["http://a/x"]["denied"] == []


def test_lookup_join_keeps_every_row_of_a_hot_key(spark):
    left = spark.range(20_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id) END AS k")
    right = left.where("k IS NOT NULL").selectExpr("k", "concat('v', k) AS v").distinct()
    for how in ("left", "inner"):
        salted = skew.lookup_join(left, right, "k", how)
        plain = left.join(right, "k", how)
        assert salted.count() == plain.count()
        assert salted.exceptAll(plain.select(salted.columns)).isEmpty()


def test_hot_key_is_spread(spark):
    left = spark.range(50_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id) END AS k")
    right = left.selectExpr("k", "1 AS v").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.lookup_join(left, right, "k")
        parts = joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(F.col("k") == "hot").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["n"] for r in parts) < 0.5 * sum(r["n"] for r in parts)
