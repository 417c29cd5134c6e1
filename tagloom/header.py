"""The header of a record file."""

import json
import struct
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.errors import InvalidBarcodeLength, InvalidMagicNumber, InvalidUmiLength, InvalidVersion

# Fixed values of the format: four little-endian 32-bit fields, 64 flag bits, 8 reserved bytes.
MAGIC = 0x21554249
VERSION = 2
HEADER_SIZE = 32
RECORD_SIZE = 24
SORTED_BIT = 1
_LAYOUT = "<IIIIQ8s"
_LENGTHS = range(1, 33)


@dataclass(frozen=True)
class Header:
    """Lengths, in bases, and flags of a file. Construction doesn't validate; unknown flags and reserved bytes are kept."""

    bc_len: int
    umi_len: int
    flags: int = 0
    reserved: bytes = bytes(8)
    magic: int = MAGIC
    version: int = VERSION

    @property
    def sorted(self) -> bool:
        """Whether the file claims to be sorted; nothing relies on the claim."""
        return bool(self.flags & SORTED_BIT)

    def with_sorted(self, claim: bool = True) -> "Header":
        return replace(self, flags=self.flags | SORTED_BIT if claim else self.flags & ~SORTED_BIT)

    def validate(self) -> "Header":
        """Itself, or the error of the first bad field, in the order of the layout."""
        if self.magic != MAGIC:
            raise InvalidMagicNumber(MAGIC, self.magic)
        if self.version != VERSION:
            raise InvalidVersion(VERSION, self.version)
        if self.bc_len not in _LENGTHS:
            raise InvalidBarcodeLength(self.bc_len)
        if self.umi_len not in _LENGTHS:
            raise InvalidUmiLength(self.umi_len)
        return self

    def to_bytes(self) -> bytes:
        return struct.pack(_LAYOUT, self.magic, self.version, self.bc_len, self.umi_len, self.flags, self.reserved)

    def to_json(self) -> str:
        """An object by field name; reserved bytes as a list of numbers."""
        return json.dumps(asdict(self) | {"reserved": list(self.reserved)})

    @classmethod
    def from_json(cls, text: str) -> "Header":
        fields = json.loads(text)
        return cls(**fields | {"reserved": bytes(fields["reserved"])})

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Header":
        """Decode exactly 32 bytes, without validation."""
        if len(raw) != HEADER_SIZE:
            raise ValueError(f"a header has {HEADER_SIZE} bytes, not {len(raw)}")
        magic, version, bc_len, umi_len, flags, reserved = struct.unpack(_LAYOUT, raw)
        return cls(bc_len, umi_len, flags, reserved, magic, version)


def header_error(magic: str = "magic", version: str = "version", bc_len: str = "bc_len", umi_len: str = "umi_len") -> Column:
    """Of a table of headers: the name of the first failing check, null for a valid row; a null field fails its check."""

    def fails(name: str, good: Column) -> Column:
        return F.col(name).isNull() | ~good

    return (
        F.when(fails(magic, F.col(magic) == MAGIC), "InvalidMagicNumber")
        .when(fails(version, F.col(version) == VERSION), "InvalidVersion")
        .when(fails(bc_len, F.col(bc_len).between(1, 32)), "InvalidBarcodeLength")
        .when(fails(umi_len, F.col(umi_len).between(1, 32)), "InvalidUmiLength")
    )
