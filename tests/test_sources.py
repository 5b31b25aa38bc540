"""Sources, sinks and the streaming extension."""

import json

import pytest
from plumbline.operators.ledger import stock
from plumbline.sources import readers
from plumbline.streaming import ledger as stream


def test_documents_of_another_version_fail(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema": "observe/1", "n": 1}))
    assert readers.documents(spark, str(tmp_path), "schema string, n long", "observe/1").first().n == 1
    with pytest.raises(Exception, match="unknown schema version"):
        readers.documents(spark, str(tmp_path), "schema string, n long", "observe/2").collect()


def test_sweep_goes_down_and_matches(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.json").write_text("{}")
    (tmp_path / "b.txt").write_text("x")
    assert [(r.bytes, r.error) for r in readers.sweep(spark, str(tmp_path)).collect()] == [(2, None)]


def test_publish_moves_the_pointer(spark, tmp_path):
    root = str(tmp_path)
    readers.publish(spark.range(3), root, "t")
    readers.publish(spark.range(5), root, "t")
    assert readers.current(spark, root, "t").count() == 5
    (tmp_path / "t.lock").write_text("")
    with pytest.raises(Exception, match="(?i)exist"):
        readers.publish(spark.range(7), root, "t")
    assert readers.current(spark, root, "t").count() == 5
    (tmp_path / "t.lock").unlink()
    assert len((tmp_path / "t.current").read_text().split("\n")) == 2


def test_truth_sheet_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "present")], "caseId string, truth string")
    readers.write_truth_sheet(rows, str(tmp_path / "t"))
    assert readers.truth_sheet(spark, str(tmp_path / "t")).collect() == rows.collect()


def test_stream_equals_batch(spark, tmp_path):
    moves = spark.createDataFrame([(1, "in", 5.0), (1, "out", 2.0), (2, "in", 1.0)], "m long, direction string, qty double")
    moves.write.parquet(str(tmp_path / "moves"))
    query = stream.run_available(stream.stock_stream(stream.read_moves(spark, str(tmp_path / "moves")), "m"), "stock_now", str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("stock_now").collect())) == sorted(map(tuple, stock(moves, ["m"]).select("m", "stock", "movements").collect()))
