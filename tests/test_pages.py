import pytest
from pyspark.sql import functions as F

from sitestance import config
from sitestance.functions import text
from sitestance.operators import html, metadata
from sitestance.sources import tables


def annotations(spark, source, **options):
    df = spark.createDataFrame([(1, source)], "page_id long, html string")
    row = html.annotate(df, **options).first()
    return {a["key"]: a["values"] for a in row["annotations"]}


def test_every_key_has_selectors():
    assert len(config.SELECTORS) == 29


def test_first_selector_wins(spark):
    found = annotations(spark, '<meta property="og:title" content="og"><h1>h <b>1</b></h1>')
    assert found["parse.title"] == ["og"]
    found = annotations(spark, '<title> a &amp;\n b </title><meta property="og:title" content="og"><h1>h</h1>')
    assert found["parse.title"] == ["a & b"]
    assert annotations(spark, "<h1 id=x>h <b>1</b></h1>")["parse.title"] == ["h 1"]
    assert annotations(spark, "<title> </title><h1>h</h1>")["parse.title"] == ["h"]


def test_attribute_forms(spark):
    found = annotations(spark, "<meta content='x' name=ROBOTS><a rel=\"license nofollow\" href=/l>")
    assert found == {"parse.meta.robots": ["x"]}
    assert annotations(spark, '<!-- <meta name="robots" content="a"> --><script>"<meta name=robots content=b>"</script>') == {}
    assert annotations(spark, '<meta name="robots" content="a > b"/><meta data-x="1" name=robots content=c>') == {
        "parse.meta.robots": ["a > b", "c"]
    }
    assert annotations(spark, '<meta content="x name=robots" name="author">') == {"parse.meta.author": ["x name=robots"]}
    assert annotations(spark, '<link rel="Canonical" href="/c"><meta property="og:url" content="/o">') == {
        "parse.canonical": ["/c"]
    }
    assert annotations(spark, "<html lang=en><meta name=robots content=>") == {"parse.html.language": ["en"]}


def test_spellings_switch(spark):
    page = '<meta name="ROBOTS" content="a"><meta name="robots" content="b"><meta name="RoBots" content="c">'
    assert annotations(spark, page)["parse.meta.robots"] == ["a", "b", "c"]
    assert annotations(spark, page, fold_case=False)["parse.meta.robots"] == ["b"]


def test_mixed_schemes_lose_links(spark):
    page = '<a href="https://creativecommons.org/a">1</a><a href="http://creativecommons.org/b">2</a>'
    assert annotations(spark, page)["parse.creativecommons"] == ["http://creativecommons.org/b"]


def test_unclosed_comment_and_long_tag(spark):
    assert annotations(spark, "<title>t</title><!-- <meta name=robots content=x>") == {"parse.title": ["t"]}
    long_tag = '<meta name="robots" ' + " ".join(f'data-a{i}="{i}"' for i in range(20000)) + ' content="z">'
    assert annotations(spark, long_tag)["parse.meta.robots"] == ["z"]


def test_references(spark):
    df = spark.createDataFrame([("a&eacute;&#233;&#xE9;&lt;&nope;&amp;lt;&#0;& b",)], "s string")
    assert df.select(text.decode_references(F.col("s"))).first()[0] == "aééé<&nope;&lt;\ufffd& b"


def test_directives(spark):
    given = ["noindex", "Noindex", "Noindex ", " Noindex", "max-image-preview:large", " max-image-preview  :  large "]
    df = spark.createDataFrame([(given,), (["noindex:", ":", None],)], "v array<string>")
    rows = [r[0] for r in df.select(metadata.normalise_directives(F.col("v"))).collect()]
    assert rows == [["max-image-preview:large", "noindex"], ["", "noindex"]]


def test_comma_split(spark):
    df = spark.createDataFrame([(["a, b ,,c", "d"],)], "v array<string>")
    assert df.select(metadata.split_commas(F.col("v"))).first()[0] == ["a", "b", "c", "d"]


def test_headers(spark):
    rows = [([("x-robots-tag", "all"), ("X-ROBOTS-TAGS", "no"), ("TDM-Policy", "p1"), ("tdm-policy", "p2")],)]
    df = spark.createDataFrame(rows, "h array<struct<name:string,value:string>>")
    found = {r["key"]: r["values"] for r in df.select(metadata.pick_headers(F.col("h"))).first()[0]}
    assert found == {"parse.http.x-robots-tag": ["all"], "parse.http.tdm-policy": ["p1", "p2"]}


def test_labels(spark, tmp_path):
    (tmp_path / "l.csv").write_text("host,label\na.org,X, Y\n b.org , Z \nc.org\n,Q\nwww.albanywoodworks.com,Business\na.org,W\n")
    loaded = tables.labels(spark, str(tmp_path / "l.csv"))
    assert {r["host"]: r["label"] for r in loaded.collect()} == {
        "a.org": "W", "b.org": "Z", "www.albanywoodworks.com": "Business"
    }
    urls = ["http://albanywoodworks.com/", "https://www.albanywoodworks.com/x", "http://x.org", "http://www.a.org/"]
    pages = metadata.with_host(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string"))
    for limit in (100, 0):  # broadcast, and spread join
        found = metadata.with_label(pages, loaded, max_rows=limit).orderBy("i").collect()
        assert [r["label"] for r in found] == [None, "Business", None, None]


@pytest.mark.parametrize("small", [True, False])
def test_domains(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(metadata, "SUFFIX_ROWS", 0)
    rules = [("es", False, False), ("com.es", False, False), ("ck", True, False), ("www.ck", False, True), ("com", False, False)]
    suffixes = spark.createDataFrame(rules, "suffix string, is_wildcard boolean, is_exception boolean")
    expected = {
        "historia.nationalgeographic.com.es": "nationalgeographic.com.es", "com.es": None, "a.b.ck": "a.b.ck",
        "x.a.b.ck": "a.b.ck", "www.ck": "www.ck", "y.www.ck": "www.ck", "a.b.unknown": "b.unknown",
        "10.0.0.1": "10.0.0.1", "ex.com": "ex.com",
    }
    pages = spark.createDataFrame([(h,) for h in expected], "host string")
    found = {r["host"]: r["domain"] for r in metadata.with_domain(pages, suffixes).collect()}
    assert found == expected
