import bz2
import gzip
import io
import lzma
import random
import sys

import pytest
from pyspark.sql import functions as F

from tagloom import errors as E
from tagloom.functions.unsigned import MASK, from_bits, to_bits
from tagloom.header import Header
from tagloom.operators.records import FIELDS, verify_sorted
from tagloom.sources import binary
from tagloom.sources.binary import append_into, count_records, load_all, read_records, write_records
from tagloom.sources.codec import decode, encode
from tagloom.sources.files import read_header
from tagloom.sources.generators import patterned_records, random_records
from tagloom.sources.standard import encode_to_bytes, read_optional, write_optional
from tests.compare import check

HEADER = Header(16, 12)
FEW = [(1, 2, 3), (4, 5, 6), (7, 8, 9)]


def put(path, triples, header=HEADER, cut=0):
    raw = (header.to_bytes() if header else b"") + encode(triples)
    path.write_bytes(raw[: len(raw) - cut])
    return str(path)


def got(df):
    return [tuple(from_bits(x) for x in r[:3]) for r in df.collect()]


def frame(spark, triples):
    return spark.createDataFrame([tuple(map(to_bits, t)) for t in triples], "barcode bigint, umi bigint, index bigint")


@pytest.mark.parametrize("access", binary.ACCESS)
def test_reads_in_file_order(spark, tmp_path, access):
    many = [(i, 2 * i, 3 * i) for i in range(60_000)]
    path = put(tmp_path / "r", many)
    for partitions in (1, 2, 7, 64):
        assert got(read_records(spark, path, access=access, partitions=partitions)) == many
    assert got(read_records(spark, path, access=access, batch_records=1_000)) == many
    assert count_records(path) == 60_000


def test_schema_isnt_null(spark, tmp_path):
    df = read_records(spark, put(tmp_path / "r", FEW))
    assert df.dtypes == [(f, "bigint") for f in FIELDS]
    assert got(df) == FEW


def test_fewer_records_than_partitions_and_none(spark, tmp_path):
    assert got(read_records(spark, put(tmp_path / "r", FEW), partitions=4)) == FEW
    empty = put(tmp_path / "e", [])
    assert got(read_records(spark, empty)) == [] and count_records(empty) == 0
    assert got(read_records(spark, put(tmp_path / "h", FEW, None), header=False)) == FEW


def test_extreme_values(spark, tmp_path):
    rows = [(0x123456789ABCDEF0, 0xFEDCBA9876543210, MASK), (0, 0, 0), (MASK, MASK, MASK), (1 << 63, (1 << 63) - 1, 1)]
    path = str(tmp_path / "w")
    write_records(frame(spark, rows).coalesce(1), path, HEADER)
    assert got(read_records(spark, path)) == rows
    assert (tmp_path / "w").read_bytes() == HEADER.to_bytes() + encode(rows)


def test_slices(spark, tmp_path):
    path = put(tmp_path / "r", [(i, 2 * i, 3 * i) for i in range(100)])
    part = got(read_records(spark, path, start=10, end=20, partitions=3))
    assert part[0] == (10, 20, 30) and part[-1] == (19, 38, 57) and len(part) == 10
    assert got(read_records(spark, path, start=50, end=51)) == [(50, 100, 150)]
    placed = read_records(spark, path, start=40, end=60, partitions=4, with_position=True)
    assert [(r["_pos"], r["barcode"]) for r in placed.collect()] == [(i, i) for i in range(40, 60)]


@pytest.mark.parametrize("start, end, idx", [(0, 2, 2), (1, 1, 1), (1, 0, 0)])
def test_bad_slices(spark, tmp_path, start, end, idx):
    path = put(tmp_path / "r", FEW[:1])
    with pytest.raises(E.InvalidIndex) as e:
        read_records(spark, path, start=start, end=end)
    assert (e.value.idx, e.value.max) == (idx, 1)


def test_every_slice_of_an_empty_file_fails(spark, tmp_path):
    path = put(tmp_path / "r", [])
    for bounds in ((0, 0), (0, 1)):
        with pytest.raises(E.InvalidIndex):
            read_records(spark, path, start=bounds[0], end=bounds[1])


def test_truncation_by_access(spark, tmp_path):
    for n in (1, 50_000):
        path = put(tmp_path / f"r{n}", [(i, i, i) for i in range(n)], cut=5)
        with pytest.raises(E.TruncatedRecord) as e:
            read_records(spark, path)
        assert e.value.pos == 32 + 24 * (n - 1)
        for access in ("bulk", "mmap"):
            with pytest.raises(E.InvalidMapSize):
                read_records(spark, path, access=access)


@pytest.mark.parametrize("size", [0, 31])
def test_short_files(spark, tmp_path, size):
    (tmp_path / "s").write_bytes(bytes(size))
    for access in binary.ACCESS:
        with pytest.raises(E.RecordIOError):
            read_records(spark, str(tmp_path / "s"), access=access)


def test_bad_headers(spark, tmp_path):
    (tmp_path / "z").write_bytes(bytes(32))
    with pytest.raises(E.InvalidMagicNumber):
        read_records(spark, str(tmp_path / "z"))
    with pytest.raises(E.InvalidUmiLength):
        read_records(spark, put(tmp_path / "u", FEW, Header(16, 33)))
    with pytest.raises(E.InvalidBarcodeLength):
        write_records(frame(spark, FEW), str(tmp_path / "w"), Header(0, 12))
    assert not (tmp_path / "w").exists()
    with pytest.raises(E.RecordIOError):
        read_records(spark, str(tmp_path / "missing"))


def _zstd(parts):
    import zstandard

    return b"".join(zstandard.ZstdCompressor().compress(p) for p in parts)


PACKERS = {
    "gzip": lambda parts: b"".join(map(gzip.compress, parts)),
    "bzip2": lambda parts: b"".join(map(bz2.compress, parts)),
    "xz": lambda parts: b"".join(map(lzma.compress, parts)),
    "zstd": _zstd,
}


@pytest.mark.parametrize("kind", PACKERS)
@pytest.mark.parametrize("cut", [None, 40])
def test_compressed_files(spark, tmp_path, kind, cut):
    many = [(i, 2 * i, 3 * i) for i in range(60_000)]
    raw = HEADER.to_bytes() + encode(many)
    path = tmp_path / "data.any"
    path.write_bytes(PACKERS[kind]([raw] if cut is None else [raw[:cut], raw[cut:]]))
    assert got(read_records(spark, str(path), batch_records=7_000)) == many
    assert read_header(str(path)) == HEADER
    with pytest.raises(E.RecordFileError):
        read_records(spark, str(path), start=0, end=1)
    with pytest.raises(E.RecordFileError):
        read_records(spark, str(path), access="bulk")


def test_truncated_compressed_file_gives_no_result(spark, tmp_path):
    path = tmp_path / "t.gz"
    path.write_bytes(gzip.compress(HEADER.to_bytes() + encode(FEW)[:-3]))
    with pytest.raises(E.TruncatedRecord) as e, E.typed_errors():
        read_records(spark, str(path)).collect()
    assert e.value.pos == 80 and e.value.__cause__ is not None
    path.write_bytes(gzip.compress(HEADER.to_bytes() + encode(FEW * 5_000))[:-200])
    with pytest.raises(E.CompressionError), E.typed_errors():
        read_records(spark, str(path)).collect()
    with pytest.raises(ZeroDivisionError), E.typed_errors():
        1 / 0


def test_load_all(spark, tmp_path):
    header, records = load_all(spark, put(tmp_path / "r", FEW, Header(20, 10, flags=5)))
    assert header == Header(20, 10, flags=5) and got(records) == FEW


def test_filter_then_no_filter(spark, tmp_path):
    df = read_records(spark, put(tmp_path / "r", [(i % 100, i, i) for i in range(10_000)]))
    assert df.where("barcode = 1").count() == 100
    assert df.count() == 10_000 == df.count()


def test_write_sorted(spark, tmp_path):
    rows = [(random.Random(i).getrandbits(64), random.Random(-i).getrandbits(64), i) for i in range(3_000)] + [(0, 0, MASK), (0, MASK, 0)] * 2
    path = str(tmp_path / "w")
    write_records(frame(spark, rows).repartition(5), path, HEADER, sort=True)
    assert read_header(path).sorted
    assert decode((tmp_path / "w").read_bytes()[32:]) == sorted(rows)
    assert verify_sorted(read_records(spark, path, partitions=6))


def test_claim_without_order_is_seen(spark, tmp_path):
    path = str(tmp_path / "w")
    write_records(patterned_records(spark, 1_500_000), path, HEADER, claim_sorted=True)
    assert read_header(path).sorted
    assert not verify_sorted(read_records(spark, path))
    assert verify_sorted(read_records(spark, path, start=0, end=1_000_000))


def test_modes(spark, tmp_path):
    path = str(tmp_path / "w")
    assert write_records(frame(spark, FEW[:1]), path, HEADER, sort=True) == 1
    assert write_records(frame(spark, FEW[1:]).coalesce(1), path, HEADER, mode="append") == 2
    assert got(read_records(spark, path)) == FEW and not read_header(path).sorted
    with pytest.raises(E.RecordIOError, match="differ in barcode or UMI length"):
        write_records(frame(spark, FEW), path, Header(10, 12), mode="append")
    with pytest.raises(E.RecordIOError):
        write_records(frame(spark, FEW), path, HEADER, mode="error")
    write_records(frame(spark, []), path, HEADER, mode="ignore")
    assert count_records(path) == 3
    write_records(frame(spark, []), path, HEADER)
    assert (tmp_path / "w").read_bytes() == HEADER.to_bytes()
    assert [p.name for p in tmp_path.iterdir()] == ["w"]


def test_nulls_and_failures_leave_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 3)], "barcode bigint, umi bigint, index bigint")
    with pytest.raises(Exception, match="has nulls"):
        write_records(df, str(tmp_path / "w"), HEADER)
    assert list(tmp_path.iterdir()) == []


def test_extra_columns_are_left_out(spark, tmp_path):
    df = frame(spark, FEW).coalesce(1).withColumn("_pos", F.lit(1)).withColumn("header", F.lit("x"))
    write_records(df, str(tmp_path / "w"), HEADER)
    assert got(read_records(spark, str(tmp_path / "w"))) == FEW


def test_directory_layout(spark, tmp_path):
    path = str(tmp_path / "d")
    write_records(patterned_records(spark, 10_000).repartition(4), path, HEADER, layout="directory")
    assert len(list((tmp_path / "d").glob("part-*"))) == 4
    assert sorted(r["index"] for r in read_records(spark, path, partitions=3).collect()) == list(range(10_000))
    write_records(patterned_records(spark, 5), path, HEADER, layout="directory", mode="append")
    assert count_records(path) == 10_005
    put(tmp_path / "d" / "part-x", FEW, Header(9, 9))
    with pytest.raises(E.RecordIOError):
        read_records(spark, path)


def test_directory_appends(spark, tmp_path):
    """Names stay short, an append comes in as a whole, the claim to be sorted goes, other lengths and layouts are refused before a row is written."""
    path = str(tmp_path / "d")
    for i in range(15):
        n = write_records(frame(spark, [(i, j, 0) for j in range(3)]).coalesce(2), path, HEADER, layout="directory", mode="append", sort=True)
        assert n == 3 and read_header(path).sorted == (i == 0)
    assert [(r[0], r[1]) for r in got(read_records(spark, path))] == [(i, j) for i in range(15) for j in range(3)]
    assert max(len(p.name) for p in (tmp_path / "d").rglob("*")) < 20
    before = sorted(tmp_path.rglob("*"))
    for header, layout in ((Header(20, 12), "auto"), (HEADER, "file"), (None, "auto")):
        with pytest.raises(E.RecordIOError):
            write_records(frame(spark, FEW), path, header, mode="append", layout=layout)
    put(tmp_path / "f", FEW)
    with pytest.raises(E.RecordIOError):
        write_records(frame(spark, FEW), str(tmp_path / "f"), HEADER, mode="append", layout="directory")
    assert sorted(tmp_path.rglob("*")) == sorted([*before, tmp_path / "f"])
    write_records(frame(spark, FEW).coalesce(1), path, HEADER, layout="file")
    assert got(read_records(spark, path)) == FEW and (tmp_path / "d").is_file()


def test_layout_by_size(spark, tmp_path, monkeypatch):
    from tagloom.sources.binary import RecordWriter

    path = str(tmp_path / "w")
    monkeypatch.setattr(binary, "JOINED_BYTES", 24 * 100)
    for n, directory in ((100, False), (101, True)):
        writer = RecordWriter({"path": path, "headerhex": HEADER.to_bytes().hex()}, True)
        (tmp_path / writer.parts.split("/")[-1] / "part-000000-7").write_bytes(HEADER.to_bytes() + encode([(i, 0, 0) for i in range(n)]))
        message = binary.WriterCommitMessage()
        message.place, message.name, message.count = 0, "part-000000-7", n
        writer.commit([message])
        assert (tmp_path / "w").is_dir() == directory and count_records(path) == n


def test_failed_append_to_a_file_leaves_it_as_it_was(spark, tmp_path, monkeypatch):
    path = put(tmp_path / "t", FEW, HEADER.with_sorted())
    before = (tmp_path / "t").read_bytes()
    real = binary._copy

    def broken(fs, source, out, skip=0):
        real(fs, source, out, skip)
        raise OSError("disk full")

    monkeypatch.setattr(binary, "_copy", broken)
    with pytest.raises(OSError):
        append_into(path, put(tmp_path / "p", FEW, None))
    assert (tmp_path / "t").read_bytes() == before


def test_schemes(monkeypatch):
    from tagloom.sources import files

    seen = []
    monkeypatch.setattr(files, "pafs", type("P", (), {"FileSystem": type("F", (), {"from_uri": staticmethod(seen.append)})}))
    for path in ("s3a://b/x", "s3n://b/x", "s3://b/x", "file:/t/x", "file:///t/x", "gs://b/x"):
        files.located(path)
    assert seen == ["s3://b/x"] * 3 + ["file:///t/x"] * 2 + ["gs://b/x"]


def test_errors_by_their_messages():
    for error in (E.TruncatedRecord(80), E.InvalidMapSize(7), E.InvalidIndex(3, 2), E.InvalidMagicNumber(0x21554249, 1), E.InvalidVersion(2, 1),
                  E.InvalidBarcodeLength(0), E.InvalidUmiLength(-1), E.CompressionError("a: b")):
        text = f"Traceback: \n tagloom.errors.{type(error).__name__}: {error}\n"
        again = E.record_error(RuntimeError(text))
        assert type(again) is type(error) and str(again) == str(error) and vars(again) == vars(error)
    assert E.record_error(error) is error
    cause = KeyError("x")
    assert isinstance(E.record_error(cause), E.ProcessError) and E.record_error(cause).__cause__ is cause
    assert isinstance(E.record_error(PermissionError("x")), E.RecordIOError)


def test_append_into(spark, tmp_path):
    target, part = put(tmp_path / "t", []), put(tmp_path / "p", FEW[:2], None)
    assert append_into(target, part) == 2
    assert got(read_records(spark, target)) == FEW[:2]
    assert (tmp_path / "p").read_bytes() == b""
    with pytest.raises(E.RecordIOError):
        append_into(target, put(tmp_path / "headed", FEW))


def test_append_into_a_directory(spark, tmp_path):
    """As large writes are directories: the part comes last, as one file, the claim to be sorted goes, and no header is lost or taken as a record."""
    target, header = str(tmp_path / "d"), Header(16, 12, reserved=b"reserved")
    write_records(frame(spark, FEW).coalesce(1), target, header, layout="directory", sort=True)
    for i, end in enumerate(("", "/")):
        part = put(tmp_path / "p", FEW[: 2 - i], None)
        assert append_into(target + end, part) == 2 - i and (tmp_path / "p").read_bytes() == b""
    assert append_into(target, part) == 0
    write_records(frame(spark, FEW[2:]), target, header, mode="append")
    assert got(read_records(spark, target)) == FEW + FEW[:2] + FEW[:1] + FEW[2:] and count_records(target) == 7
    assert read_header(target) == header
    assert sorted(p.name for p in tmp_path.iterdir()) == ["d", "p"]


def test_refused_or_failed_append_into_a_directory_leaves_it_as_it_was(spark, tmp_path, monkeypatch):
    target, part = tmp_path / "d", put(tmp_path / "p", FEW, None)
    target.mkdir()
    with pytest.raises(E.RecordIOError):  # no file has a header
        append_into(str(target), part)
    put(target / "part-0", FEW, HEADER.with_sorted())
    before = sorted(tmp_path.rglob("*"))
    with pytest.raises(E.RecordIOError):
        append_into(str(target), put(tmp_path / "p", FEW))
    with pytest.raises(E.InvalidMapSize):
        append_into(str(target), put(tmp_path / "p", FEW, None, cut=5))
    put(tmp_path / "p", FEW, None)
    real = binary._copy

    def broken(fs, source, out, skip=0):
        real(fs, source, out, skip)
        raise OSError("disk full")

    with monkeypatch.context() as m:
        m.setattr(binary, "_copy", broken)
        with pytest.raises(OSError):
            append_into(str(target), part)
    assert sorted(tmp_path.rglob("*")) == before and count_records(part, header=False) == 3
    assert got(read_records(spark, str(target))) == FEW and read_header(str(target)).sorted
    put(target / "part-1", FEW, Header(9, 9))
    with pytest.raises(E.RecordIOError):
        append_into(str(target), part)


def test_large_target_of_ingest_concat(spark, monkeypatch):
    """The query where its target is beyond the size of one file."""
    from tagloom.plans import records

    real = binary.write_records
    monkeypatch.setattr(records, "write_records", lambda df, path, header: real(df, path, header, layout="directory" if header else "auto"))
    check(spark, records.ingest_concat, records.ORACLE["ingest_concat"])


def test_bytes_and_standard_streams(spark, tmp_path, monkeypatch, capfdbinary):
    df = frame(spark, FEW).coalesce(1)
    raw = HEADER.to_bytes() + encode(FEW)
    assert encode_to_bytes(df, HEADER) == raw
    assert encode_to_bytes(df, None) == encode(FEW) and len(encode_to_bytes(df.limit(1), None)) == 24
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(gzip.compress(raw))))
    assert got(read_optional(spark, None)) == FEW
    out = io.TextIOWrapper(io.BytesIO())
    monkeypatch.setattr(sys, "stdout", out)
    write_optional(df, None, HEADER)
    assert out.buffer.getvalue() == raw
    write_optional(df, str(tmp_path / "w"), HEADER)
    assert got(read_optional(spark, str(tmp_path / "w"))) == FEW


def test_generators(spark):
    header, df = random_records(spark, 5_000, barcodes=50, max_index=9, seed=3)
    assert header.umi_len == 12 and df.count() == 5_000
    low, high, top = df.agg(F.min("barcode"), F.max("barcode"), F.max("index")).first()
    assert low >= 0 and high < 50 and top < 9
    assert df.where("umi < 0 or umi >= 16777216").count() > 4_000
    assert df.collect() == random_records(spark, 5_000, barcodes=50, max_index=9, seed=3)[1].collect()
    with pytest.raises(E.InvalidBarcodeLength):
        random_records(spark, 1, bc_len=40)
