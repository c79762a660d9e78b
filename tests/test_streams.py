"""Tables read as streams."""

from doubtline.queries.streams import stream_of
from doubtline.streaming.judge import drain


def test_a_stream_reads_a_file_and_a_folder(spark, tmp_path):
    rows = spark.range(30).selectExpr("id", "id * 2 AS v")
    whole, parts = tmp_path / "whole", tmp_path / "parts"
    rows.repartition(3).write.parquet(str(parts / "t.parquet"))
    rows.repartition(2).write.parquet(str(parts / "other.parquet"))
    whole.mkdir()
    rows.toPandas().to_parquet(whole / "t.parquet")
    for no, folder in enumerate((whole, parts)):
        got = drain(stream_of(spark, str(folder), "t"), str(tmp_path / f"out{no}"), str(tmp_path / f"state{no}"))
        assert sorted(tuple(r) for r in got.collect()) == [(i, 2 * i) for i in range(30)]
