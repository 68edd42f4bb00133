"""Queries over all rows of their tables, against brute force: asof."""

from pyspark.sql import functions as F

from cellweave.operators import joins
from cellweave.plans import catalog


def test_asof_of_every_event(spark, data):
    rows = spark.read.parquet(f"{data}/events.parquet").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("s")).collect()
    of = {}
    for r in rows:
        of.setdefault(r.user_id, []).append((r.s, r.event_id))
    expected = {r.event_id: max((x for x in of[r.user_id] if x[0] < r.s), default=(0, None))[1] for r in rows}
    assert {r.event_id: r.before_id for r in catalog.queries()["match_asof"](spark, data).collect()} == expected


def test_asof_ties_among_many_keys(spark):
    keys = spark.range(60_000).select((F.col("id") % 7).alias("g"), F.floor(F.col("id") / 70).alias("k"), ((F.col("id") * 7919) % 60_000).alias("v"))
    probes = keys.select("g", F.col("k").alias("x")).distinct()
    last = {}
    for r in keys.collect():
        last[r.g, r.k] = max(last.get((r.g, r.k), -1), r.v)
    got = joins.asof(probes, "x", keys, "k", ["v"], ["g"], strict=True).collect()
    assert all(r.v == last.get((r.g, r.x - 1)) for r in got)
