"""Recalculation and streams."""

import pytest
from pyspark.sql import functions as F

from cellweave.plans.evaluator import Workbook
from cellweave.streaming import recalc


def test_columns_in_waves(spark):
    m = recalc.Model({"total": "=[@net]+[@tax]", "net": "=[@q]*[@p]", "tax": "=[@net]*0.1"})
    assert m.levels() == [["net"], ["tax"], ["total"]]
    assert m.affected({"p"}) == ["net", "tax", "total"]
    out = m.recalculate(spark.createDataFrame([(2.0, 5.0)], "q double, p double")).first()
    assert (out.net, out.tax, out.total) == (10.0, 1.0, 11.0)
    with pytest.raises(recalc.Cycle):
        recalc.Model({"a": "=[@b]", "b": "=[@a]"}).levels()


def test_dirty_cells():
    b = Workbook()
    for (s, r, c), v in {("First", 1, 1): 2, ("First", 2, 1): 3, ("First", 3, 1): "=A1+A2", ("First", 4, 1): "=A3*10", ("First", 1, 2): "=7*6", ("Second", 1, 1): "=First!A3+1"}.items():
        b.set(s, r, c, v)
    assert recalc.dirty(b, [("First", 1, 1)]) == {("First", 3, 1), ("First", 4, 1), ("Second", 1, 1)}
    assert recalc.recalculate(b)["Second", 1, 1] == 6.0


def test_stream_totals(spark, tmp_path, data):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = recalc.keep_totals(stream, ["event_type"], "value", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = {r.event_type: (round(r.total, 6), r.n) for r in recalc.current_totals(spark, str(tmp_path / "out"), ["event_type"]).collect()}
    assert got == {r.event_type: (round(r.t, 6), r.n) for r in events.groupBy("event_type").agg(F.sum("value").alias("t"), F.count("*").alias("n")).collect()}
    q = recalc.streaming_totals(stream, "ts", ["event_type"], "value").writeStream.outputMode("update").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from totals").first()[0] == events.count()
    assert recalc.sessions(events, "ts", "user_id").agg(F.sum("n")).first()[0] == events.count()
