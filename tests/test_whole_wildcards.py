"""Queries over all rows of their tables, against brute force: wildcards."""

from cellweave.operators import joins
from cellweave.plans import catalog


def test_wildcards_of_every_part(spark, data):
    parts = spark.read.parquet(f"{data}/part.parquet").orderBy("p_partkey").collect()
    expected = {p.p_partkey: next(q.p_brand for q in parts if q.p_type.lower().startswith(p.p_type[:2].lower())) for p in parts}
    assert {r.p_partkey: r.p_brand for r in catalog.queries()["wildcard_lookup"](spark, data).collect()} == expected


def test_wildcards_keep_repeated_rows(spark):
    probes = spark.createDataFrame([("a*",), ("a*",), (None,), ("z?",)], "pat string")
    keys = spark.createDataFrame([("abc", 2, "two"), ("AB", 1, "one")], "t string, ord int, v string")
    got = [(r.pat, r.v) for r in joins.wildcard_lookup(probes, "pat", keys, "t", ["v"], "ord").collect()]
    assert sorted(got, key=str) == sorted([("a*", "one"), ("a*", "one"), (None, None), ("z?", None)], key=str)
