"""Functions against expected values."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import html, text, urls, vectors

BAD = ["http://169.254.169.254/latest/meta-data/", "http://127.0.0.1:6333/", "http://10.0.0.1/admin", "http://metadata.google.internal/", "file:///etc/passwd", "http://[::1]/", "http://[fe80::1]/x", "http://[fc00::2]:80/", "http://[::ffff:10.0.0.1]/",
       "http://100.64.1.1/", "http://2130706433/", "http://0x7f.1/", "http://0177.0.0.1/", "http://0/", "https://metadata.azure.com/", "http://LOCALHOST./", "http://a.localhost/", "http://user:pw@192.168.1.1/", "http:///x", "", "http://224.0.0.1/", "http://1.2.3/"]
GOOD = ["https://example.com/a?b=1", "http://8.8.8.8/", "http://user@example.org:8080/", "http://[2606:4700::1111]/", "http://100.63.1.1/", "https://1password.com/", "http://172.32.0.1/"]


def test_url_policy(spark):
    df = spark.createDataFrame([(u, u in GOOD) for u in BAD + GOOD] + [(None, False)], "u string, good boolean")
    assert df.where(urls.url_allowed(F.col("u")) != F.col("good")).count() == 0


def test_domains(spark):
    want = {"https://a.b.co.uk/x": "b.co.uk", "https://x.github.io": "github.io", "https://ghost.io/a": "ghost.io", "http://[2606:4700::1]:8/": "2606:4700::1", "http://10.1.1.1/": "10.1.1.1", "": ""}
    df = spark.createDataFrame(list(want.items()), "u string, d string").select("d", urls.registrable_domain(F.col("u")).alias("g"))
    assert all(r.d == r.g for r in df.collect())
    platform = {r.g: r.p for r in df.select("g", urls.is_platform(F.col("g")).alias("p")).collect()}
    assert platform["ghost.io"] and platform["github.io"] and not platform["b.co.uk"] and len(urls.PLATFORMS) == 19
    assert urls.robots_allowed(None, "https://a/x", "me") and not urls.robots_allowed("User-agent: *\nDisallow: /x", "https://a/x/y", "me") and urls.robots_allowed("User-agent: *\nDisallow: /x", "https://a/y", "me")


@pytest.mark.parametrize("page,said", [
    ("<div hidden><div>a</div>LEAK</div>shown", "shown"),
    ("<ul><li hidden>no<li>yes</ul>", "yes"),
    ('<article style="DISPLAY : none"><p>no</p><section>no</section></article><p>yes', "yes"),
    ("<p style='visibility:hidden'>no<p>yes</p>", "yes"),
    ("<script>if (a < b) {x}</script><style>p{}</style><noscript><p>no</p></noscript>a<!-- no -->b", "ab"),
    ("<nav>no <a>no</a></nav><main>x &amp; y&nbsp;&lt;z&#39;</main><footer>no</footer>", "x & y <z'"),
    ("<table><tr hidden><td>no<tr><td>yes</table>", "yes"),
    ("<div hidden><br><img src=x>no</div>a<br hidden>b", "a b"),
    ("a</div></p>b <b>c", "a b c"), ("", ""), (None, ""),
])
def test_page_text(page, said):
    assert html.page_text(page) == said


def test_sanitize(spark):
    page = """<!DOCTYPE html><p TITLE="x" class="k" alt='y z'>a<img alt="no" src="s"><a aria-label=q href="h">l</a><span hidden><span>n</span>n</span><!-- n --></p>"""
    want = """<!DOCTYPE html><p class="k">a<img src="s"><a href="h">l</a></p>"""
    df = spark.createDataFrame([(page, None), (None, "m"), ("<p>" + "w " * 300 + "</p>", ""), ("<p>short</p>", None)], "p string, m string")
    assert df.select(html.sanitize(F.col("p"))).first()[0] == want
    assert [r[0] for r in df.select(html.body_of(F.col("m"), F.col("p"))).collect()] == ["", "m", ("w " * 300).strip(), ""]


def test_unfinished_references(spark):
    """A cut title ends in a reference without its end: neither completed nor decoded.  A null page stays null."""
    page = "<title>a&amp;b&amp</title><p hidden>&amp</p><p style='display&#58;none'>no</p><p>&am &ampx; &lt &#39 &quot;\ue000&nosuch;"
    assert html.sanitize_page(page) == "<title>a&amp;b&amp</title><p>&am &ampx; &lt &#39 &quot;\ue000&nosuch;"
    assert html.page_text(page) == 'a&b&amp &am &ampx; &lt &#39 "\ue000&nosuch;'
    df = spark.createDataFrame([(page,), (None,)], "p string")
    assert [tuple(r) for r in df.select(html.sanitize(F.col("p")), html.extract(F.col("p"), 0)).collect()] == [(html.sanitize_page(page), html.page_text(page)), (None, None)]


def test_secrets(spark):
    keys = ["sk-ant-api03-" + "a" * 20, "sk-proj-" + "B" * 24, "sk-or-v1-" + "0" * 20, "tvly-" + "x" * 20, "lmnr_" + "y" * 20, ".".join(["eyJ" + "a" * 12, "eyJ" + "b" * 12, "c" * 12]), "AKIA" + "Q" * 16, "ASIA" + "7" * 16, "ya29.abc-DEF_9", "ghp_" + "g" * 36]
    plain = ["sk-short", "skating", "AKIAlower" + "q" * 12, "ghp_short", "a@b.example"]
    df = spark.createDataFrame([(f"x {k} y", "x SCRUBBED y") for k in keys] + [(p, p) for p in plain], "t string, w string")
    assert all(r.g == r.w for r in df.select("w", text.scrub_secrets(F.col("t")).alias("g")).collect())


def test_cosines(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 1)
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (100, [0.0, 2.0]), (4, [1.0])], "id long, v array<double>")
    got = {(r.a, r.b): round(r.cosine, 9) for r in vectors.cosines(rows.where("id % 100 = 0"), rows, "id", "v").collect()}
    assert got == {(0, 1): 0.6, (0, 2): 0, (0, 3): 0, (0, 100): 0, (0, 4): 0, (100, 0): 0, (100, 1): 0.8, (100, 2): 0, (100, 3): 0, (100, 4): 0}
    assert vectors.cosines(rows.where("id < 0"), rows, "id", "v").count() == 0


def test_urls_that_parsers_read_differently(spark):
    allowed = {"HTTP://ok.com/": True, "HttpS://ok.com": True, "http://10.0.0.1\\@x.com/": False, "http://x.com\\@10.0.0.1/": False, "http://x.com/a b": False, "http://x.com/\t": False, "http://x.com/\x07": False, "ftp://x.com": False, "http://x.com/é": True}
    df = spark.createDataFrame([(u,) for u in allowed], "u string")
    assert {r.u: r.ok for r in df.select("u", urls.url_allowed(F.col("u")).alias("ok")).collect()} == allowed


def test_suffix_rules(spark):
    rules = spark.createDataFrame([("com",), ("uk",), ("co.uk",), ("*.ck",), ("!www.ck",), ("*.kawasaki.jp",), ("!city.kawasaki.jp",), ("jp",), ("github.io",), ("io",)], "rule string")
    want = {
        "https://a.b.example.com/": "example.com", "https://x.co.uk/": "x.co.uk", "https://a.x.co.uk": "x.co.uk", "https://co.uk": "co.uk", "https://b.c.ck/": "b.c.ck", "https://a.b.c.ck/": "b.c.ck", "https://c.ck": "c.ck",
        "https://www.ck/": "www.ck", "https://a.www.ck/": "www.ck", "https://city.kawasaki.jp": "city.kawasaki.jp", "https://a.city.kawasaki.jp": "city.kawasaki.jp", "https://x.y.z.kawasaki.jp": "y.z.kawasaki.jp",
        "https://me.github.io/": "me.github.io", "https://a.me.github.io/": "me.github.io", "https://a.b.unlisted/": "b.unlisted", "https://localhost/": "localhost", "http://10.1.2.3/": "10.1.2.3", "http://[2606:4700::1]/": "2606:4700::1", "none": "",
    }
    rows = spark.createDataFrame([(u, 1) for u in want], "url string, domain int").drop("domain")
    assert {r.url: r.domain for r in urls.registrable_domains(rows, "url", rules).collect()} == want
    assert urls.registrable_domains(rows.limit(0), "url", rules).count() == 0


def test_judged_head(spark):
    from siltstone.functions.jsonx import judged_head

    assert spark.range(1).select(judged_head(F.lit("é" * 7000)).alias("x")).first().x == "é" * 6000
