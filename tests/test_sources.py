import io
import tarfile

from kinloom.sources import files, recordio, sinks


def test_text_sources(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a.jpg 1 2 3 4 5 6 7 8 9 10 0.5\nb.jpg 1 2 3 4 5 6 7 8 9 10\nbad 1\n\n")
    assert [(r.name, len(r.landmark), r.score) for r in files.landmark_lines(spark, str(tmp_path / "l.txt")).orderBy("name").collect()] == [("a.jpg", 10, 0.5), ("b.jpg", 10, 1.0)]
    (tmp_path / "i.txt").write_text("1 2\n3\nx\n3\n")
    assert sorted(r.id for r in files.id_lines(spark, str(tmp_path / "i.txt")).collect()) == [1, 2, 3]
    (tmp_path / "p.txt").write_text("n1 4 5\n")
    assert files.spaced_text(spark, str(tmp_path / "p.txt"), "name string, template int, media int").first() == ("n1", 4, 5)


def test_recordio_round_trip_and_header(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 3), bytes([i]) * (i + 1)) for i in range(50)], "label double, payload binary").repartition(3)
    written = recordio.write_records(df, f"file://{tmp_path}/rec").collect()
    assert sum(r.n_records for r in written) == 50
    back = recordio.read_records(spark, [r.rec_path for r in written])
    assert {(r.label, bytes(r.payload)) for r in back.collect()} == {(r.label, bytes(r.payload)) for r in df.collect()}
    body = [recordio.pack(0, 0, b"", (3.0, 9.0)), recordio.pack(1, 1, b"one"), recordio.pack(2, 2, b"two"), recordio.pack(0, 3, b"", (1.0, 2.0))]
    at, idx = 0, ""
    for i, b in enumerate(body):
        idx, at = f"{idx}{i}\t{at}\n", at + len(b)
    (tmp_path / "h.rec").write_bytes(b"".join(body))
    (tmp_path / "h.idx").write_text(idx)
    assert [(r.rec_idx, r.label, bytes(r.payload)) for r in recordio.read_records(spark, [str(tmp_path / "h.rec")]).collect()] == [(1, 1.0, b"one"), (2, 2.0, b"two")]


def test_archives_members_and_ranges(spark, tmp_path):
    df = spark.createDataFrame([(i % 2, f"m{i}.jpg", f"body{i}".encode()) for i in range(9)], "id int, name string, body binary")
    out = sinks.write_archives(df, f"file://{tmp_path}/tars", "id", "name", "body", rows=3).collect()
    assert sum(r.n_members for r in out) == 9 and len(out) > 2
    m = files.tar_members(spark, f"file://{tmp_path}/tars", ".jpg")
    got = files.byte_ranges(m, "tar_path", "start_byte", "length").collect()
    assert {(r.member_name, bytes(r.payload)) for r in got} == {(f"m{i}.jpg", f"body{i}".encode()) for i in range(9)}
    assert files.listing(spark, f"file://{tmp_path}/tars", ".tar").count() == len(out)
    with tarfile.open(fileobj=io.BytesIO((tmp_path / "tars" / out[0].tar_path.rsplit("/", 1)[1]).read_bytes())) as t:
        assert t.getnames() == sorted(t.getnames())


def test_publish_and_chunks(spark, tmp_path):
    p = f"{tmp_path}/t"
    sinks.publish(spark.range(5), p)
    sinks.publish(spark.read.parquet(p).where("id > 2"), p)
    assert sorted(r.id for r in spark.read.parquet(p).collect()) == [3, 4]
    sinks.write_chunks(spark.range(0, 10, 1, 1), f"{tmp_path}/c", 4)
    assert len(list((tmp_path / "c").glob("*.parquet"))) == 3
