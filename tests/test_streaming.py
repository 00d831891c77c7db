"""Streams against their batch forms."""

import shutil

from paperloom.operators.sessions import admission
from paperloom.plans import fixtures as fx
from paperloom.streaming.ingest import watch_inbox
from paperloom.streaming.sessions import hourly_totals, sliding_counts

from .test_extraction import TEI


def test_sliding_counts_replay_the_batch(spark, tmp_path):
    r = fx.requests(spark, "/root/testdata/sf0.001").orderBy("ts")
    r.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(r.schema).parquet(str(tmp_path / "in"))
    q = sliding_counts(stream).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda x: (x.user_id, x.ts, x.n_before, x.admitted)
    assert sorted(map(key, spark.table("counts").collect())) == sorted(map(key, admission(r).collect()))


def test_hourly_totals_emit_closed_hours(spark, tmp_path):
    r = fx.requests(spark, "/root/testdata/sf0.001")
    r.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(r.schema).parquet(str(tmp_path / "in"))
    q = hourly_totals(stream).writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    total = spark.table("hours").agg({"requests": "sum"}).first()[0]
    assert 0 < total <= r.count()


def test_inbox_takes_each_file_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "one.xml").write_text(TEI)
    args = (spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "cp"))
    watch_inbox(*args).awaitTermination()
    first = spark.read.parquet(str(tmp_path / "out" / "entities")).count()
    (inbox / "two.xml").write_text(TEI.replace("A study", "Another"))
    watch_inbox(*args).awaitTermination()
    papers = {r.paper_id for r in spark.read.parquet(str(tmp_path / "out" / "entities")).select("paper_id").distinct().collect()}
    assert first > 0 and papers == {"one", "two"}
    shutil.rmtree(tmp_path / "out")
