"""Settings, the service connector, signals, metrics, the command line, and busy flags."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paperloom.__main__ import main
from paperloom.config import load_settings
from paperloom.operators.metrics import error_message
from paperloom.operators.signals import signal_counts
from paperloom.sources.service import HttpParseService, parse_files, read_files
from paperloom.streaming.sessions import busy_flags

from .test_extraction import TEI


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"batch_size": 7, "types": {"fact": {"top_k": 3, "sections": ["abstract"]}}}))
    s = load_settings(str(path), {"batch_size": 9})
    assert s.batch_size == 7 and s.types["fact"].top_k == 3 and s.types["fact"].sections == ("abstract",) and s.types["method"].top_k == 12
    assert load_settings().batch_size == 5
    for wrong in ({"batchsize": 1}, {"types": {"thing": {}}}):
        with pytest.raises(ValueError):
            load_settings(values=wrong)


class Service:
    def parse(self, name, content):
        if content == b"bad":
            raise ConnectionError("refused")
        return f"<x>{name}</x>"


def test_files_go_through_the_service(spark, tmp_path):
    for name, content in (("a.pdf", b"ok"), ("b.pdf", b"bad"), ("c.pdf", b"x" * 2000), ("d.txt", b"ok")):
        (tmp_path / name).write_bytes(content)
    rows = {r.paper_id: (r.xml, r.error) for r in parse_files(read_files(spark, str(tmp_path), "*"), Service(), max_bytes=1000).collect()}
    assert rows == {"a": ("<x>a.pdf</x>", None), "b": (None, "ConnectionError: refused"), "c": (None, "file too large"), "d": (None, "unsupported format")}
    kind, body = HttpParseService("http://host/parse", options={"k": "1"}).form("a.pdf", b"%PDF")
    edge = kind.split("boundary=")[1].encode()
    assert body.count(b"--" + edge) == 3 and b'name="k"\r\n\r\n1' in body and b"%PDF" in body


def test_signals_and_messages(spark):
    df = spark.createDataFrame([("We found that growth increased by 5% (p < 0.01).",), ("Nothing.",), (None,)], "text string")
    got = [{s.entity_type: s.n for s in r.signals} for r in signal_counts(df).collect()]
    assert got == [{"result": 2, "analysis": 1}, {}, {}]
    e = spark.createDataFrame([("busy",), ("malformed XML: x",), ("odd",), (None,)], "e string").select(error_message(F.col("e")).alias("m")).collect()
    assert [bool(r.m) for r in e] == [True, True, True, False] and len({r.m for r in e}) == 4


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.xml").write_text(TEI)
    main([str(tmp_path / "in"), str(tmp_path / "out")], spark)
    assert spark.read.parquet(str(tmp_path / "out" / "entities")).count() > 0
    metrics = spark.read.parquet(str(tmp_path / "out" / "metrics")).first()
    assert metrics.paper_id == "one" and metrics.entities > 0 and {p.phase for p in metrics.phases} == {"keywords", "validation"}
    assert "<svg" in "".join(r.value for r in spark.read.text(str(tmp_path / "out" / "svg")).collect())


def test_a_refused_start_does_not_free_the_running_job(spark, tmp_path):
    t = datetime(2024, 1, 1)
    at = lambda m: t + timedelta(minutes=m)
    rows = [(1, at(0), "start"), (1, at(1), "start"), (1, at(2), "start"), (1, at(3), "finish"), (1, at(3), "start"), (2, at(1), "start"), (1, at(70), "start")]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, event string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = busy_flags(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("busy").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.user_id, r.ts, r.accepted) for r in spark.table("busy").collect())
    assert got == [(1, at(0), True), (1, at(1), False), (1, at(2), False), (1, at(3), True), (1, at(70), True), (2, at(1), True)]
