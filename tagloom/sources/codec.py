"""Records as bytes, numpy arrays and Arrow batches."""

import numpy as np
import pyarrow as pa

from tagloom.header import RECORD_SIZE

FIELDS = ("barcode", "umi", "index")
#: Always little-endian, whatever the machine.
LAYOUT = np.dtype([(f, "<u8") for f in FIELDS])
assert LAYOUT.itemsize == RECORD_SIZE
ARROW = pa.schema([pa.field(f, pa.int64(), nullable=False) for f in FIELDS])


def to_batch(raw: np.ndarray, first: int | None = None) -> pa.RecordBatch:
    """An Arrow batch of the records, as BIGINT bits; with ``first``, their positions in a column ``_pos``."""
    columns = [pa.array(np.ascontiguousarray(raw[f]).view("<i8")) for f in FIELDS]
    if first is None:
        return pa.RecordBatch.from_arrays(columns, schema=ARROW)
    position = pa.array(np.arange(first, first + len(raw), dtype=np.int64))
    return pa.RecordBatch.from_arrays([*columns, position], schema=ARROW.append(pa.field("_pos", pa.int64(), nullable=False)))


def from_batch(batch: pa.RecordBatch) -> np.ndarray:
    """The records of a batch with the columns barcode, umi and index; the format has no nulls."""
    out = np.empty(batch.num_rows, LAYOUT)
    for f in FIELDS:
        column = batch.column(f)
        if column.null_count:
            raise ValueError(f"{f} has nulls, which a record file can't hold")
        out[f] = column.cast(pa.int64()).to_numpy(zero_copy_only=False).view("<u8")
    return out


#: Records that are added side by side, and those of a piece that stays in a core's cache.
_LANES, _PIECE = 256, 32_768


def totals(raw: np.ndarray) -> tuple[list[int], list[int], int]:
    """Sums of the low and of the high halves of each field's values, and the XOR of all fields, of up to 2^32 records."""
    words = raw.view(np.uint64)
    whole, high, mixed = np.zeros(3, np.uint64), np.zeros(3, np.uint64), np.uint64(0)
    half, step = np.uint64(32), 3 * _LANES
    for at in range(0, len(words), 3 * _PIECE):
        piece = words[at : at + 3 * _PIECE]
        even = len(piece) // step * step
        for part in (piece[:even].reshape(-1, step), piece[even:].reshape(-1, 3)):
            whole += part.sum(axis=0).reshape(-1, 3).sum(axis=0)  # modulo 2^64
            high += (part >> half).sum(axis=0).reshape(-1, 3).sum(axis=0)
        mixed ^= np.bitwise_xor.reduce(piece)
    # The low halves add up to less than 2^64, so they follow from the sum of the values modulo that.
    return (whole - (high << half)).tolist(), high.tolist(), int(mixed)


def encode(rows: list[tuple[int, int, int]]) -> bytes:
    """Bytes of records given as unsigned integers."""
    return np.array(rows, LAYOUT).tobytes()


def decode(raw: bytes) -> list[tuple[int, int, int]]:
    """Records, as unsigned integers, of a whole number of records in bytes."""
    if len(raw) % RECORD_SIZE:
        raise ValueError(f"{len(raw)} bytes are no whole number of records")
    return [tuple(map(int, r)) for r in np.frombuffer(raw, LAYOUT)]
