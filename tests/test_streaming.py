"""Row functions give a stream and a table the same result."""

from __future__ import annotations

from textassay.streaming import annotate


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Ch #225;vez"), (2, "plain"), (3, "")], "doc_id BIGINT, text STRING")
    rows.write.parquet(str(tmp_path / "in"))
    stream = annotate(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
             .trigger(availableNow=True).start(str(tmp_path / "out")))
    query.awaitTermination(120)
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).orderBy("doc_id").collect()
    assert got == annotate(rows).orderBy("doc_id").collect()
    assert got[0].repaired == "Chávez" and got[0].corrupt and got[2].rejected
