"""Queries over all rows of their tables, against brute force: networkdays."""

from datetime import timedelta

from pyspark.sql import functions as F

from cellweave.plans import catalog


def test_networkdays_of_every_order(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("day")).collect()
    expected = {o.o_orderkey: sum((o.day + timedelta(k)).weekday() < 5 for k in range(30)) for o in orders}
    assert {r.o_orderkey: r.days for r in catalog.queries()["networkdays"](spark, data).collect()} == expected
