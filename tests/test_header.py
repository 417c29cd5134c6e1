import pytest

from tagloom import errors as E
from tagloom.header import HEADER_SIZE, MAGIC, RECORD_SIZE, VERSION, Header, header_error


def test_constants_and_bytes():
    assert (HEADER_SIZE, RECORD_SIZE, VERSION) == (32, 24, 2)
    raw = Header(16, 12).to_bytes()
    assert raw.hex() == "49425521020000001000000" + "00c000000" + "0" * 32
    assert Header(16, 12).with_sorted().to_bytes()[16] == 1


def test_sorted_flag():
    h = Header(16, 12)
    assert not h.sorted
    assert h.with_sorted().sorted and h.with_sorted().with_sorted() == h.with_sorted()
    assert Header(16, 12, flags=0b110).with_sorted().flags == 0b111


def test_unknown_bits_and_reserved_bytes_survive():
    h = Header(16, 12, flags=(1 << 63) | 64, reserved=b"reserved")
    assert Header.from_bytes(h.to_bytes()) == h
    assert Header.from_json(h.to_json()) == h
    assert h.validate() is h


@pytest.mark.parametrize("lengths", [(1, 1), (32, 32)])
def test_valid_lengths(lengths):
    Header(*lengths).validate()


@pytest.mark.parametrize(
    "header, error",
    [
        (Header(16, 12, magic=0x12345678, version=1), E.InvalidMagicNumber),
        (Header(16, 12, version=1), E.InvalidVersion),
        (Header(0, 33), E.InvalidBarcodeLength),
        (Header(33, 12), E.InvalidBarcodeLength),
        (Header(16, 0), E.InvalidUmiLength),
        (Header(16, 33), E.InvalidUmiLength),
    ],
)
def test_first_failure_wins(header, error):
    with pytest.raises(error):
        header.validate()


def test_errors_carry_values():
    with pytest.raises(E.InvalidMagicNumber) as e:
        Header.from_bytes(bytes(32)).validate()
    assert (e.value.expected, e.value.actual) == (MAGIC, 0)
    assert "0x21554249" in str(e.value)
    assert "1-32" in str(E.InvalidUmiLength(40))
    assert (E.InvalidIndex(5, 3).idx, E.InvalidIndex(5, 3).max) == (5, 3)
    assert all(issubclass(x, E.RecordFileError) for x in (E.TruncatedRecord, E.InvalidMapSize, E.ProcessError, E.CompressionError))


def test_from_bytes_needs_32():
    for n in (0, 31, 33):
        with pytest.raises(ValueError):
            Header.from_bytes(bytes(n))


def test_hash_and_equality():
    assert len({Header(16, 12), Header(16, 12), Header(16, 11), Header(16, 12, flags=1)}) == 3


def test_header_table(spark):
    data = [(MAGIC, 2, 16, 12), (1, 1, 0, 0), (MAGIC, 3, 0, 0), (MAGIC, 2, None, 12), (MAGIC, 2, 16, 64), (None, 2, 16, 12)]
    df = spark.createDataFrame(data, "magic bigint, version int, bc_len int, umi_len int")
    found = [r[0] for r in df.select(header_error()).collect()]
    assert found == [None, "InvalidMagicNumber", "InvalidVersion", "InvalidBarcodeLength", "InvalidUmiLength", "InvalidMagicNumber"]
