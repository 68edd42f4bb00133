"""Nulls, repeated ids, very long texts, empty tables and clashing columns, for every operator."""

import hashlib

import pytest

from cellweave.llm import decontaminate, html_extract, packing, pii, quality, simhash, substring_dedup, suffix_dedup, syncmers, url_filter


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, "same text here twice over for ties"), (None, None)], "item_id long, text string")


def operators(labels, items):
    return {
        "substring": lambda d: substring_dedup.substring_dedup(d, 5), "suffix": lambda d: suffix_dedup.suffix_dedup(d, 20), "simhash": simhash.near_duplicates, "one_of_each": simhash.one_of_each, "quality": lambda d: quality.classified(d, labels),
        "accepted": lambda d: quality.accepted(d, labels), "packing": packing.packed, "pii": pii.detected, "redacted": pii.redacted, "contamination": lambda d: decontaminate.contamination(d, items), "clean": lambda d: decontaminate.clean(d, items), "syncmers": syncmers.fingerprinted,
    }


NAMES = list(operators(None, None))
FILTERS = {"one_of_each", "accepted", "redacted", "clean"}


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(name, frame, odd_rows, labels, items):
    df = frame(odd_rows)
    out = operators(labels, items)[name](df)
    rows = out.collect()
    if name in FILTERS:
        assert out.columns == df.columns
        assert all(r.quality == df.first().quality for r in rows)
    elif name != "packing":
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in odd_rows)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, frame, labels, items):
    df = frame([])
    out = operators(labels, items)[name](df)
    assert out.collect() == []
    assert name not in FILTERS or out.columns == df.columns


def test_repeated_ids_keep_their_text(frame, odd_rows):
    rows = substring_dedup.substring_dedup(frame(odd_rows), 5).collect()
    own = {(r.doc_id, r.kept_sha256): r.n_removed for r in rows}
    plain = lambda t: hashlib.sha256(b" ".join(t.encode().split())).hexdigest()
    assert own[4, plain("same text here twice over for ties")] == 0
    assert own[None, plain(odd_rows[0][1])] == 0
    assert next(r.n_removed for r in rows if r.doc_id == 5) == 7
    rows = suffix_dedup.suffix_dedup(frame(odd_rows), 20).collect()
    assert sorted(r.n_removed for r in rows if r.doc_id == 4) == [0, 0, 0]
    assert next(r.n_removed for r in rows if r.doc_id == 5) == len("same text here twice over for ties")


def test_near_duplicates_of_nulls(frame, odd_rows):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(frame(odd_rows)).collect()}
    assert got[1, "0" * 16] == got[2, "0" * 16] == 1
    assert next(c for (i, _), c in got.items() if i == 5) == 4
    assert sorted(str(r.doc_id) for r in simhash.one_of_each(frame(odd_rows)).collect()) == ["1", "3", "4", "4", "4", "None"]


def test_no_labels_and_no_items(spark, frame, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.predicted for r in quality.classified(frame(odd_rows), none).collect()} == {1}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in decontaminate.contamination(frame(odd_rows), empty).collect()} == {False}


def test_pages(spark):
    rows = [(None, None, None), (1, "http://a.b/c", ""), (1, "http://a.b/c", "<p>"), (2, "x", "<article>" + "<p>word</p>" * 3000 + "</article>")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, text string, host string")
    assert {(r.page_id, r.n_chars > 0) for r in html_extract.extracted(df).collect()} == {(None, False), (1, False), (2, True)}
    assert len(url_filter.judged(df).collect()) == 4
    assert html_extract.extracted(df.limit(0)).collect() == [] and url_filter.judged(df.limit(0)).collect() == []
