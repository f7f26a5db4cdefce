from pyspark.sql import functions as F

from weftline.streaming import segments


def stream_of(spark, tmp_path, name="in"):
    return spark.readStream.schema("stream_id string, url string, ts timestamp, value double").parquet(str(tmp_path / name))


def add(spark, tmp_path, rows, name="in"):
    df = spark.createDataFrame(rows, "stream_id string, url string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / name))


def run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    return query


def test_segments_are_stored_once(spark, tmp_path):
    add(spark, tmp_path, [("a", "s1", "2024-01-01 00:00:00", 1.0)])
    query = run(segments.once(stream_of(spark, tmp_path), ["stream_id", "url"], "ts"), "once")
    add(spark, tmp_path, [("a", "s1", "2024-01-01 00:00:02", 1.0), ("a", "s2", "2024-01-01 00:00:02", 1.0)])
    query.processAllAvailable()
    query.stop()
    assert sorted(r.url for r in spark.table("once").collect()) == ["s1", "s2"]


def test_windows_equal_batch(spark, tmp_path):
    add(spark, tmp_path, [("a", f"s{i}", f"2024-01-01 {i:02d}:00:00", float(i)) for i in range(24)])
    stream = segments.windowed(stream_of(spark, tmp_path), "ts", ["stream_id"], "value", "6 hours")
    run(stream, "win", "complete").stop()
    batch = spark.read.parquet(str(tmp_path / "in")).groupBy(F.window("ts", "6 hours").alias("window"), "stream_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert sorted(map(tuple, spark.table("win").collect())) == sorted(map(tuple, batch.collect()))


def test_sessions(spark, tmp_path):
    add(spark, tmp_path, [("a", "x", f"2024-01-01 00:{m:02d}:00", 1.0) for m in (0, 10, 59)])
    run(segments.sessions(stream_of(spark, tmp_path), "ts", ["stream_id"]), "sess", "complete").stop()
    assert sorted(r.n for r in spark.table("sess").collect()) == [1, 2]


def test_store_replaces_a_repeated_batch(spark, tmp_path):
    add(spark, tmp_path, [("a", "s1", "2024-01-01 00:00:00", 1.0), ("a", "s1", "2024-01-01 00:00:00", 1.0)])
    query = segments.store(stream_of(spark, tmp_path), str(tmp_path / "out"), str(tmp_path / "cp"), ["url"]).start()
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_bad_rows_do_not_end_the_stream(spark, tmp_path):
    def decode(row):
        if row["value"] < 0:
            raise ValueError("negative")
        return {"url": row["url"], "double": row["value"] * 2}

    add(spark, tmp_path, [("a", "s1", "2024-01-01 00:00:00", 1.0), ("a", "s2", "2024-01-01 00:00:00", -1.0)])
    run(segments.decode_rows(stream_of(spark, tmp_path), decode, "url string, double double"), "dec").stop()
    found = {r.url: (r.double, r.error) for r in spark.table("dec").collect()}
    assert found["s1"] == (2.0, None) and "negative" in found[None][1]


def test_playlist(spark, tmp_path):
    playlist = tmp_path / "live.m3u8"
    playlist.write_text("#EXTM3U\ns1\ns2\n")
    spark.dataSource.register(segments.Playlist)
    query = run(spark.readStream.format("weftline_playlist").load(str(playlist)), "live")
    playlist.write_text("#EXTM3U\ns2\ns3\n")
    query.processAllAvailable()
    query.stop()
    assert sorted(r.url for r in spark.table("live").collect()) == ["s1", "s2", "s3"]
