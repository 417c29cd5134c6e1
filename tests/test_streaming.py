from pathlib import Path

from tagloom.header import Header
from tagloom.sources.codec import encode
from tagloom.streaming.append import running_barcode_counts, stream_records


def test_appended_records_come_once(spark, tmp_path):
    path = tmp_path / "grows"
    path.write_bytes(Header(16, 12).to_bytes() + encode([(1, 2, 3), (1, 5, 6)]) + b"part")
    checkpoint = str(tmp_path / "checkpoint")

    def run():
        query = running_barcode_counts(stream_records(spark, str(path)), str(tmp_path / "seen"), checkpoint)
        assert query.awaitTermination(120)
        return {r["barcode"]: r["n_records"] for r in spark.read.parquet(str(tmp_path / "seen")).collect()}

    assert run() == {1: 2}
    with path.open("r+b") as out:
        out.truncate(32 + 48)
        out.seek(0, 2)
        out.write(encode([(2, 0, 0), (1, 0, 0)]))
    again = stream_records(spark, str(path), start=2).writeStream.format("memory").queryName("rest")
    query = again.option("checkpointLocation", str(tmp_path / "other")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert [tuple(r) for r in spark.table("rest").collect()] == [(2, 0, 0), (1, 0, 0)]


def test_header_only_file(spark, tmp_path):
    path = tmp_path / "empty"
    path.write_bytes(Header(16, 12).to_bytes())
    query = stream_records(spark, str(path)).writeStream.format("memory").queryName("none")
    query = query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert spark.table("none").count() == 0


def test_release_removes_intermediate_tables(spark):
    from tagloom.session import marked, release, written

    point = marked()
    df = written(spark.range(10))
    assert df.count() == 10
    path = df.inputFiles()[0].removeprefix("file://")
    release(spark, point)
    assert marked() == point and not Path(path).exists()
