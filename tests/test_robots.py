"""Golden cases for robots.txt documents."""

import random
import re

import pytest

from sitestance.functions import match
from sitestance.operators import robots
from pyspark.sql import functions as F

BAN = "User-agent: *\nDisallow: /\n"
# Inputs and the results they must have.
CASES = {
    1: "User-agent: *\nDisallow: /wp-admin/\nAllow: /wp-admin/admin-ajax.php\nAllow: /wp-content/uploads/\n\n"
    "User-agent: ChatGPT-User\nDisallow: /\nUser-agent: GPTBot\nDisallow: /\nUser-agent: CCBot\nDisallow: /\n"
    "User-agent: Google-Extended\nDisallow: /\nUser-agent: ia_archiver\nDisallow:",
    2: "User-agent: *\nDisallow:\n",
    3: BAN,
    4: "User-agent: CCBot\nCrawl-delay: 5\nUser-agent: GPTBot\nDisallow: /\n",
    5: "Useragent: gptbot\nDisalow: /x/\nDssalow /y/\n",
    6: "User-agent: GPTBot\nUser-agent: GPTBOT\nDisallow: /\n",
    7: "# c\n   \nUser-agent: * # x\r\n\r\nDisallow: /a/*\n",
    8: "User-agent: GPTBot\nCrawl-delay: 10.5\nCrawl-delay: 3\nUser-agent: *\nCrawl-delay: 7\nCrawl-delay: -9\nDisallow: /tmp\n",
    9: "Sitemap: https://Ex.org/S.xml\nsitemaps: https://ex.org/s.xml\nSitemap https://ex.org/t.xml\n",
    10: "User-agent: GPTBot\nAllow:\nUser-agent: CCBot\nDisallow: /p/\n",
    11: "Disallow: /early/\nUser-agent: GPTBot\nAllow: /ok/\n",
    12: "User-agent: *\nDisallow: /pub/\nUser-agent: GPTBot\nAllow: /pub/\nDisallow: /pub/\n",
    13: "User-agent: *\nDisallow: /Admin/\nUser-agent: GPTBot\nDisallow: /admin/\n",
    14: "User-agent: *\nDisallow: /a/\nUser-agent: GPTBot\nDisallow: /4\n",
    15: "User-agent:\nDisallow: /z/\nUser-agent-x: foo\nNoindex: /q\n",
    16: BAN,
    17: "",
    18: b"\xef\xbb\xbf" + BAN.encode(),
    118: b"\xff\xfe" + BAN.encode("utf-16-le"),
    218: b"\xfe\xff" + BAN.encode("utf-16-be"),
    19: b"# \xff\n" + BAN.encode(),
    20: None,
    21: "\tUser-agent\t:\t*\t\nDisallow\t:\t/\t\n",
}
# lines, disallow, empty disallow, allow
COUNTS = {
    1: (14, 5, 1, 2), 2: (2, 0, 1, 0), 3: (2, 1, 0, 0), 4: (4, 1, 0, 0), 5: (3, 2, 0, 0),
    6: (3, 1, 0, 0), 7: (4, 1, 0, 0), 8: (7, 1, 0, 0), 9: (3, 0, 0, 0), 10: (4, 1, 0, 0),
    11: (3, 1, 0, 1), 12: (5, 2, 0, 1), 13: (4, 2, 0, 0), 14: (4, 2, 0, 0), 15: (4, 1, 0, 0),
    16: (None,) * 4, 17: (None,) * 4, 18: (2, 1, 0, 0), 118: (2, 1, 0, 0), 218: (2, 1, 0, 0),
    19: (3, 1, 0, 0), 20: (None,) * 4, 21: (2, 1, 0, 0),
}
BANS = {
    1: {"ccbot", "google-extended", "gptbot", "chatgpt-user"}, 3: {"*"}, 4: {"ccbot", "gptbot"},
    14: {"gptbot"}, 18: {"*"}, 118: {"*"}, 218: {"*"}, 19: {"*"}, 21: {"*"},
}
BIAS = {
    1: {"ccbot": -2, "ia_archiver": 1}, 4: {"ccbot": -1, "gptbot": -1}, 5: {"gptbot": -2},
    6: {"gptbot": -1}, 8: {"gptbot": 0}, 10: {"ccbot": -1, "gptbot": 0}, 11: {"gptbot": 0},
    12: {"gptbot": 1}, 13: {"gptbot": -1}, 14: {"gptbot": 1},
}
SCHEMA = "doc_id long, url string, status int, content_type string, content binary"


def documents(spark, cases):
    rows = []
    for key, value in cases.items():
        body = value.encode() if isinstance(value, str) else value
        kind = "text/HTML; charset=utf-8" if key == 16 else "text/plain"
        rows.append((key, "http://ex.org/robots.txt", 200, kind, body))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def profiles(spark):
    rows = robots.profile(documents(spark, CASES)).collect()
    return {r["doc_id"]: r for r in rows}


def test_counts(profiles):
    for key, expected in COUNTS.items():
        r = profiles[key]
        found = (r["num_lines"], r["num_disallow"], r["num_disallow_empty"], r["num_allow"])
        assert found == expected, key


def test_bans(profiles):
    for key, r in profiles.items():
        found = {a["agent"] for a in r["agents"] or [] if a["disallow_all"]}
        assert found == BANS.get(key, set()), key


def test_bias(profiles):
    for key, expected in BIAS.items():
        found = {a["agent"]: a["bias"] for a in profiles[key]["agents"]}
        assert {k: found[k] for k in expected} == expected, key
        assert all(abs(b) <= len(profiles[key]["directories"]) for b in found.values() if b is not None)


def test_further_fields(profiles):
    assert profiles[4]["crawldelay"] == 5 and profiles[8]["crawldelay"] == 7
    assert profiles[1]["crawldelay"] is None
    assert sorted(profiles[1]["directories"]) == ["/", "/wp-admin/", "/wp-content/uploads/"]
    assert profiles[7]["directories"] == ["/a/"] and profiles[13]["directories"] == ["/admin/"]
    assert profiles[9]["num_sitemaps"] == 3
    assert profiles[9]["sitemaps"] == ["https://ex.org/s.xml", "https://ex.org/t.xml"]
    assert profiles[9]["useragents"] is None and profiles[9]["num_useragents"] == 0
    assert profiles[15]["useragents"] == [""] and profiles[15]["num_useragents"] == 1
    assert profiles[6]["num_useragents"] == 1
    assert [a["num_disallow"] for a in profiles[6]["agents"] if a["agent"] == "gptbot"] == [2]
    assert profiles[17]["content_length"] == 0 and profiles[17]["content_type"] is None
    assert profiles[20]["content_length"] is None
    assert profiles[16]["content_type"].startswith("text/HTML")
    assert profiles[118]["content_length"] == 2 + 2 * len(BAN)


def test_untracked_agents_are_left_out(spark):
    rows = robots.profile(documents(spark, {1: CASES[1]}), ["CCBot", "Google-Extended", "Bingbot"]).collect()
    assert {a["agent"] for a in rows[0]["agents"]} == {"*", "ccbot", "google-extended"}


def test_agent_without_rules_has_no_count_row(spark):
    rows = robots.agent_counts(robots.profile(documents(spark, {10: CASES[10]}))).collect()
    assert {r["agent"] for r in rows} == {"ccbot"}


def test_directive_names(spark):
    text = "Host: a\nno-index: b\nACAP-x: c\nrequest-rate 1\nhttps://d\n: e\nwhat\nuser agent: f\n"
    parsed = robots.parse(documents(spark, {1: text}))
    found = [(r["directive"], r["value"]) for r in robots.lines(parsed).orderBy("n").collect()]
    assert found == [
        ("host", "a"), ("no-index", "b"), ("acap-", "c"), ("request-rate", "1"), ("http", "//d"),
        ("unknown", ": e"), ("missing", "what"), ("user-agent", "f"),
    ]


def test_partitioning_does_not_matter(spark, sf_dir):
    from sitestance.plans import corpora

    docs = corpora.robots(spark, sf_dir)
    one = robots.profile(docs.coalesce(1)).drop("tokens").collect()
    many = robots.profile(docs.repartition(7)).drop("tokens").collect()
    assert sorted(map(repr, one)) == sorted(map(repr, many))


MATCHES = [
    # rules (allow?, pattern), path, allowed
    ([(False, "/a")], "/abc", False),
    ([(False, "/a")], "/b", True),
    ([(False, "/a*c")], "/abbbc/d", False),
    ([(False, "/a*c$")], "/abbbc/d", True),
    ([(False, "/a*c$")], "/abbbc", False),
    ([(False, "/*.pdf$")], "/x/y.pdf", False),
    ([(False, "/*.pdf$")], "/x/y.pdf?z", True),
    ([(False, "/*?")], "/x?y=1", False),
    ([(False, "/a.b(c)/")], "/a.b(c)/d", False),
    ([(False, "/a.b(c)/")], "/axb(c)/d", True),
    ([(False, "/"), (True, "/ok")], "/ok/1", True),
    ([(True, "/"), (False, "/no")], "/no", False),
    ([(True, "/p"), (False, "/p")], "/p", True),
    ([(False, "/p*"), (True, "/p")], "/p", False),
    ([(False, "*")], "/x", False),
    ([(False, "/$")], "/", False),
    ([(False, "/$")], "/x", True),
    ([(False, "*$")], "/x", False),
    ([(False, "/a**b")], "/a-b", False),
    ([(False, "/[x]\\d")], "/[x]\\d", False),
    ([(False, "/")], "/robots.txt", True),
    ([(False, "x")], "/x", True),
    ([], "/x", True),
    # One octet has several spellings; a reserved one stays apart from its encoding.
    ([(False, "/%7Ejoe/")], "/~joe/x", False),
    ([(False, "/~joe/")], "/%7ejoe/x", False),
    ([(False, "/ä/")], "/%C3%A4/x", False),
    ([(False, "/%c3%a4/")], "/ä/x", False),
    ([(False, "/a%2Fb")], "/a/b", True),
    ([(False, "/a%2fb")], "/a%2Fb", False),
    ([(False, "/100%")], "/100%", False),
]


def test_rule_matching(spark):
    rows = [(i, [{"allow": a, "pattern": p} for a, p in rules], path) for i, (rules, path, _) in enumerate(MATCHES)]
    df = spark.createDataFrame(rows, "i int, rules array<struct<allow:boolean,pattern:string>>, path string")
    compiled = match.in_priority_order(
        F.transform("rules", lambda r: match.compile_rule(r["pattern"], r["allow"]))
    )
    judged = df.withColumn("c", compiled).select(
        "i",
        match.verdict(match.normalised(F.col("path")), match.index(F.col("c"))).alias("walked"),
        match.passes(match.normalised(F.col("path")), match.program(F.col("c"))).alias("folded"),
    )
    for r in judged.collect():
        expected = MATCHES[r["i"]][2]
        assert (r["walked"], r["folded"]) == (expected, expected), MATCHES[r["i"]]


def test_hostile_rule_is_linear(spark):
    rule = [{"allow": False, "pattern": "/" + "*a" * 40 + "$"}]
    df = spark.createDataFrame([(rule, "/" + "a" * 3000 + "b")], "rules array<struct<allow:boolean,pattern:string>>, path string")
    compiled = match.in_priority_order(F.transform("rules", lambda r: match.compile_rule(r["pattern"], r["allow"])))
    assert df.select(match.passes(F.col("path"), match.program(compiled)).alias("ok")).first()["ok"]
    assert df.select(match.verdict(F.col("path"), match.index(compiled)).alias("ok")).first()["ok"]


def brute_verdict(rules, path):
    """Every pattern as an expression; the longest decides, allow before disallow."""
    fitting = [
        (-len(p), not allow)
        for allow, p in rules
        if p and re.match(re.escape(p.removesuffix("$")).replace(r"\*", ".*") + (r"\Z" if p.endswith("$") else ""), path, re.S)
    ]
    return path == "/robots.txt" or not min(fitting, default=(0, False))[1]


@pytest.mark.parametrize("size", [0, 1, 6, 40, 300])
def test_verdicts_against_single_patterns(spark, size):
    """Small sets are read through, large ones searched; many rules begin one another."""
    draw = random.Random(size)

    def pattern():
        text = "/" + "".join(draw.choices("ab/", k=draw.randint(0, 7)))
        if draw.random() < 0.4:
            for _ in range(draw.randint(1, 3)):
                at = draw.randint(0, len(text))
                text = text[:at] + "*" + text[at:]
        return text + "$" * (draw.random() < 0.15)

    cases = []
    for i in range(60):
        rules = [(draw.random() < 0.5, pattern()) for _ in range(size)]
        cases += [(10 * i + j, rules, "/" + "".join(draw.choices("ab/", k=draw.randint(0, 9)))) for j in range(10)]
    rows = [(i, [{"allow": a, "pattern": p} for a, p in rules], path) for i, rules, path in cases]
    df = spark.createDataFrame(rows, "i int, rules array<struct<allow:boolean,pattern:string>>, path string")
    compiled = match.in_priority_order(F.transform("rules", lambda r: match.compile_rule(r["pattern"], r["allow"])))
    found = df.select("i", match.verdict(F.col("path"), match.index(compiled)).alias("ok")).collect()
    for r in found:
        assert r["ok"] == brute_verdict(*cases[r["i"]][1:]), cases[r["i"]]


def test_long_file(spark):
    text = "User-agent: GPTBot\n" + "".join(f"Disallow: /d{i}/\n" for i in range(5000)) + "Allow: /d7/x\n"
    row = robots.profile(documents(spark, {1: text})).first()
    assert row["num_disallow"] == 5000 and len(row["directories"]) == 5000
    assert [a["bias"] for a in row["agents"] if a["agent"] == "gptbot"] == [-5000]
