"""Files by path or URI, compressed ones by their content."""

import bz2
import gzip
import io
import lzma
from concurrent.futures import ThreadPoolExecutor
from typing import BinaryIO

import pyarrow.fs as pafs

from tagloom.errors import CompressionError, RecordIOError
from tagloom.header import HEADER_SIZE, Header

# The first bytes of compressed files.
_SIGNS = {b"\x1f\x8b": "gzip", b"\x28\xb5\x2f\xfd": "zstd", b"BZh": "bzip2", b"\xfd7zXZ\x00": "xz"}


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it; a path without scheme is local. Hadoop's schemes of S3 are taken as S3."""
    if "://" in path or path.startswith("file:/"):
        scheme, _, rest = path.partition(":")
        if scheme == "file":
            rest = "//" + rest.removeprefix("//")
        return pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")
    return pafs.LocalFileSystem(), path


def sized_files(path: str) -> list[tuple[str, int]]:
    """``path`` itself, or the files below a directory in order of their names, hidden ones left out; paths like ``path`` with sizes."""
    fs, inner = located(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise RecordIOError(f"{path}: no such file")
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    below = ((f.path[len(info.path) :].strip("/"), f) for f in fs.get_file_info(pafs.FileSelector(inner, recursive=True)))
    found = [(name, f.size) for name, f in below if f.type == pafs.FileType.File and not any(x[0] in "._" for x in name.split("/"))]
    return [(f"{path.rstrip('/')}/{name}", size) for name, size in sorted(found)]


def size_of(path: str) -> int:
    fs, inner = located(path)
    return fs.get_file_info(inner).size


def read_at(path: str, start: int, length: int) -> bytes:
    fs, inner = located(path)
    try:
        with fs.open_input_file(inner) as f:
            f.seek(start)
            return f.read(length)
    except OSError as e:
        raise RecordIOError(f"{path}: {e}") from e


def compression_of(path: str, head: bytes | None = None) -> str | None:
    head = read_at(path, 0, 6) if head is None else head
    return next((kind for sign, kind in _SIGNS.items() if head.startswith(sign)), None)


def open_plain(path: str) -> BinaryIO:
    """The file's content, unpacked if it is compressed; files of several members or frames are read through."""
    fs, inner = located(path)
    kind = compression_of(path)
    raw = fs.open_input_stream(inner, compression=None)
    if kind == "gzip":
        return gzip.GzipFile(fileobj=io.BufferedReader(_Raw(raw)))
    if kind == "bzip2":
        return bz2.BZ2File(io.BufferedReader(_Raw(raw)))
    if kind == "xz":
        return lzma.LZMAFile(io.BufferedReader(_Raw(raw)))
    if kind == "zstd":
        try:
            import zstandard
        except ImportError as e:
            raise CompressionError(f"{path}: the module zstandard is needed") from e
        return zstandard.ZstdDecompressor().stream_reader(_Raw(raw), read_across_frames=True)
    return io.BufferedReader(_Raw(raw))


class _Raw(io.RawIOBase):
    """A pyarrow stream as Python's raw input."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def read_full(stream: BinaryIO, size: int, path: str) -> bytes:
    """``size`` bytes, fewer only at the end."""
    parts, left = [], size
    try:
        while left and (part := stream.read(left)):
            parts.append(part)
            left -= len(part)
    except (OSError, EOFError, lzma.LZMAError) as e:
        raise CompressionError(f"{path}: {e}") from e
    except Exception as e:
        if type(e).__name__ == "ZstdError":
            raise CompressionError(f"{path}: {e}") from e
        raise
    return b"".join(parts)


def header_of(path: str, packed: bool) -> tuple[Header, str | None]:
    """The valid header of one file, and how it is compressed, which only counts if ``packed``; an uncompressed file is opened once."""
    raw = read_at(path, 0, HEADER_SIZE)
    kind = compression_of(path, raw) if packed else None
    if kind:
        with open_plain(path) as stream:
            raw = read_full(stream, HEADER_SIZE, path)
    if len(raw) < HEADER_SIZE:
        raise RecordIOError(f"{path}: {len(raw)} bytes are too few for a header")
    return Header.from_bytes(raw).validate(), kind


def each(function, items: list) -> list:
    """``function`` of all items, on the driver, several at a time, as each waits for a file system."""
    if len(items) < 2:
        return [function(x) for x in items]
    with ThreadPoolExecutor(min(32, len(items))) as pool:
        return list(pool.map(function, items))


def read_header(path: str) -> Header:
    """The valid header of a file, compressed or not; of a directory that of its first file, which claims to be sorted if all of them do."""
    files = sized_files(path)
    if not files:
        raise RecordIOError(f"{path}: no files")
    headers = each(lambda f: header_of(f[0], True)[0], files)
    return headers[0].with_sorted(all(h.sorted for h in headers))
