import pytest
from pyspark.sql import functions as F

from aerostrata.session import scratch_dir
from aerostrata.sources import frame_source
from aerostrata.sources.frames import decode_frames

ROWS = [(i - 5, None if i % 9 == 8 else bytes((i * 7 + k) % 256 for k in range(9 if i % 5 else 4))) for i in range(200)]


def _write(spark, rows, path, parts=3):
    df = spark.createDataFrame(rows, frame_source.SCHEMA).repartition(parts)
    df.write.format(frame_source.register(spark)).mode("append").save(path)


def _rows(df):
    return sorted(((r["event_id"], None if r["frame"] is None else bytes(r["frame"])) for r in df.collect()), key=repr)


def test_frames_come_back_in_ranges(spark):
    path = scratch_dir(spark, "frames")
    _write(spark, ROWS, path)
    read = spark.read.format(frame_source.register(spark)).option("rangeBytes", 200).load(path)
    assert _rows(read) == sorted(ROWS, key=repr)
    assert read.rdd.getNumPartitions() >= len(ROWS) * frame_source.RECORD // 200
    short = decode_frames(read).filter(F.octet_length("frame") < 9)
    assert short.filter("co2_ppm IS NOT NULL").count() == 0 and short.count() == sum(f is not None and len(f) < 9 for _, f in ROWS)
    assert _rows(spark.read.format(frame_source.NAME).load(scratch_dir(spark, "none"))) == []


def test_a_stream_takes_each_file_once(spark):
    path, out, progress = (scratch_dir(spark, n) for n in ("frames", "out", "progress"))
    for lo in (0, 80, 150):
        _write(spark, ROWS[lo:{0: 80, 80: 150, 150: 200}[lo]], path, 2)
        stream = spark.readStream.format(frame_source.register(spark)).load(path)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
        query.awaitTermination()
    assert _rows(spark.read.parquet(out)) == sorted(ROWS, key=repr)


def test_a_cut_file_and_a_long_frame_are_errors(spark, tmp_path):
    (tmp_path / f"0{frame_source.SUFFIX}").write_bytes(b"\0" * (frame_source.RECORD + 1))
    with pytest.raises(Exception, match="whole records"):
        spark.read.format(frame_source.register(spark)).load(f"file:{tmp_path}").collect()
    with pytest.raises(Exception, match="10 bytes"):
        _write(spark, [(1, b"0123456789")], scratch_dir(spark, "frames"))
