"""Pages with their subpages, link samples, and the paged source."""

import json

from pyspark.sql import functions as F

from quernstone.operators import extract
from quernstone.sources.paged import PagedRoster

HOME = '<title>Ann Lee</title><div class="post mbox"><div class="tt">Biography</div><div class="con">I work on graphs here.</div></div><a href="/research">Research interests</a><a href="papers.html">Publications</a><a href="/about">About me</a><a href="https://other.org/research">research</a><a href="/research">Research interests</a>'
RESEARCH = '<title>r</title><div class="post mbox"><div class="tt">Research Interests</div><div class="con">graph mining and causal inference</div></div>'
PAPERS = "<title>p</title><p>Neural machine translation with long contexts, ACL 2021</p>"
ABOUT = '<title>a</title><div class="post mbox"><div class="tt">Biography</div><div class="con">Another life story.</div></div>'


def pages(spark):
    rows = [(1, "https://a.example.org/", HOME), (2, "https://a.example.org/research", RESEARCH), (3, "https://a.example.org/papers.html", PAPERS), (4, "https://a.example.org/about", ABOUT), (5, None, None)]
    return extract.walked(spark.createDataFrame(rows, "page_id long, url string, html string"))


def test_subpages_fill_what_a_page_lacks(spark):
    records = {r.page_id: r for r in extract.page_records(pages(spark), hosts=["example"]).collect()}
    assert len(records) == 5
    home = records[1]
    assert home.sections == {"intro": "I work on graphs here.", "research": "graph mining and causal inference", "papers": "Neural machine translation with long contexts, ACL 2021"}
    assert home.full_text.index("graph mining") < home.full_text.index("Neural machine") and "Another life story" not in home.full_text
    alone = {r.page_id: r for r in extract.page_records(pages(spark)).collect()}
    assert alone[1].sections == {"intro": "I work on graphs here."} and alone[5].sections == {} == records[5].sections


def test_link_samples(spark):
    got = pages(spark).where("page_id = 1").select(extract.link_samples(F.col("links")).alias("x")).first()["x"]
    assert got == ["Research interests", "Publications", "About me", "research"]


def test_paged_source(spark, tmp_path):
    rows = [{"title": f"t{i}", "career": "c", "department": "d", "cnUrl": f"u{i}", "siteId": i % 3, "language": "1", "published": "1" if i % 2 else "0"} for i in range(25)]
    for k in range(3):
        (tmp_path / f"page_{k + 1}.json").write_text(json.dumps({"data": rows[k * 10 : k * 10 + 10], "lastPageNum": 3}))
    spark.dataSource.register(PagedRoster)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = spark.read.format("paged_roster").load(str(tmp_path))
    assert found.rdd.getNumPartitions() == 3 and found.count() == 25
    some = found.where("published = '1' AND siteId > 0").select("title", "siteId")
    assert sorted(r.title for r in some.collect()) == sorted(r["title"] for r in rows if r["published"] == "1" and r["siteId"] > 0)
    assert spark.read.format("paged_roster").load(str(tmp_path / "none")).count() == 0


def test_links_of_all_pages(spark, data):
    """The first link of each kind to another page of the host, page by page in plain Python."""
    import re
    from urllib.parse import urljoin, urlsplit

    from quernstone.plans.records import QUERIES

    def normal(url):
        return re.sub("/+$", "", re.sub("(?s)[?#].*$", "", url.strip())).lower()

    want = set()
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    own = '<p><a href="/research">Research</a><a href="pub.html">Publications</a><a href="https://b.org/about">about</a><a href="#top">home</a>'
    for page, url, html in [*rows, (1, "https://a.example.org/x/", own)]:
        found = {}
        for href, text in re.findall(r'<a href="([^"]*)">([^<]*)</a>', html or ""):
            link, low = normal(urljoin(url or "", href)), f"{text} {href}".lower()
            parts, base = urlsplit(link), urlsplit((url or "").lower())
            if not href or re.match("javascript:|#|mailto:|tel:", href) or parts.netloc != base.netloc or link == normal(url or "") or "example" not in parts.netloc:
                continue
            if re.search(r"\.html?$", parts.path) or re.match(r"^/[0-9A-Za-z_-]+/?$", parts.path):
                for field, hints in extract.SUBPAGES:
                    if any(h in low for h in hints):
                        found.setdefault(field, link)
        want |= {(page, field, link) for field, link in found.items()}
    assert {tuple(r) for r in QUERIES["html_links"](spark, data).collect()} == want
