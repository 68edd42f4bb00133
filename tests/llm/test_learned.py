"""Learned operators: held-out accuracy, rules, and the pipeline."""

import pytest
from pyspark.sql import functions as F

from cellweave.llm import html_extract, quality, url_filter


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.classified(docs, labels).join(labels, "doc_id").filter("held_out").select("predicted", "quality").collect()
    assert len(rows) > 40
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93
    assert all(r.predicted for r in rows if r.quality)


def test_quality_does_not_read_held_out_labels(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda t: {r.doc_id: r.score for r in quality.classified(docs, t).collect()}
    assert score(labels) == score(turned)


def test_rules(spark):
    urls = [
        ("https://A.Example.com/en/7?x#y", "a.example.com", "/en/7", "example.com/en/7", "allow"), ("http://other.com/en/x", "other.com", "/en/x", "com/en/", "block"), ("http://x.example.net/de/81", "x.example.net", "/de/81", "example.net/de/8", "block"),
        ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"), ("http://x.org/es/", "x.org", "/es/", "org/es/", "block"), ("http://x.org/es", "x.org", "/es", None, None), ("http://h?a/b", "h", "", None, None), (None, "", "", None, None), ("no scheme", "", "", None, None),
    ]
    df = spark.createDataFrame([(k, u[0], "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    for r in url_filter.judged(df).collect():
        _, host, path, rule, verdict = urls[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)


def test_urls_not_trained_on(spark):
    hosts = [("www.megacasino-win.example.net", 1), ("cheap-pillshop.example.org", 1), ("free-bets4u.example.com", 1), ("ads-trackers.example.net", 1), ("spamfarm-links.example.org", 1), ("thering.example.com", 0), ("blog.ontheriver.example.org", 0), ("m.science-notes.example.net", 0), ("www.history-park.example.org", 0)]
    df = spark.createDataFrame([(k, f"https://{h}/fr/{k}") for k, (h, _) in enumerate(hosts)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judged(df).collect()}
    assert [got[k] == "block" for k in range(len(hosts))] == [bool(b) for _, b in hosts]


def test_url_scores_agree_with_the_model(spark):
    import math

    weights, bias = url_filter.model()
    host, path = "www.some-host.example.com", "/en/12"
    slots = url_filter.grams("www.some-host.example", "^") + url_filter.grams(path, "|")
    expected = 1 / (1 + math.exp(-(sum(weights[s] for s in slots) / len(slots) + bias)))
    got = url_filter.judged(spark.createDataFrame([(1, f"http://{host}{path}")], "page_id long, url string")).first().score
    assert got == pytest.approx(expected, rel=1e-9)


def test_blocks():
    page = '<html><head><title>t</title><script>x="</p>"</script></head><body><nav><a href="/a>b">m &amp; n</a></nav><p>one<b> two</b><br>three<p>four &lt;x&gt;<!-- <p>no</p> --><ul><li>five<li>six</ul>tail'
    assert [t for t, _, _ in html_extract.blocks(page)] == ["m & n", "one two three", "four <x>", "five", "six", "tail"]
    assert html_extract.blocks("") == [] and html_extract.blocks("<script>never closed") == []


def test_held_out_pages():
    w = html_extract.model()
    hit = miss = wrong = 0
    pages = html_extract.training_pages(80, seed=99)
    for found, (_, main) in zip(html_extract.labelled([p for p, _ in pages], w), pages, strict=True):
        left = list(main)
        for text, p in found:
            if text in left:
                left.remove(text)
                hit += p >= 0.5
                miss += p < 0.5
            else:
                wrong += p >= 0.5
    assert hit / (hit + miss) > 0.97 and wrong / (hit + wrong) < 0.04


def test_extraction_of_the_table(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_extract.extracted(pages.withColumn("text", F.lit("clash"))).collect():
        inside = source[r.page_id].split("<article>")[1].split("</article>")[0]
        found = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?p>|</?h1>", inside)]
        assert r.text == "\n".join(x for x in found if x) and r.n_chars == len(r.text)


def test_pipeline(spark):
    from cellweave.llm import pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, docs.count()
    from cellweave.llm.common import Workspace

    space = Workspace(spark, "test")
    for name, stage in pipeline.STAGES[:-1]:
        docs = space.save(stage(spark, docs, d), name)
        assert docs.columns == columns
        assert docs.count() <= before
        before = docs.count()
    pieces = pipeline.run(spark, d)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_every_rule_says_the_contract_s_word(spark):
    said = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert dict(url_filter.RULES) == said
    hosts = ("casino-win.", "the-garden.")  # the method would block one and allow the other
    urls = [(f"https://{h}{rule}1", rule) for rule in said for h in hosts]
    df = spark.createDataFrame([(k, url) for k, (url, _) in enumerate(urls)], "page_id long, url string")
    assert {(r.page_id, r.rule, r.verdict) for r in url_filter.judged(df).collect()} == {(k, rule, said[rule]) for k, (_, rule) in enumerate(urls)}
