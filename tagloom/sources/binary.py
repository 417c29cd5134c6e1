"""The data source of record files: reader, stream reader and writer.

Filters are not pushed into the source: in this version of Spark pushed filters of a Python source stay with the
DataFrame and change later queries on it. Ranges of records are taken by the options ``start`` and ``end``.
"""

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import LongType, StructField, StructType

from tagloom.errors import InvalidIndex, InvalidMapSize, RecordFileError, RecordIOError, TruncatedRecord, typed_errors
from tagloom.functions.unsigned import record_keys
from tagloom.header import HEADER_SIZE, RECORD_SIZE, Header
from tagloom.sources.codec import FIELDS, LAYOUT, from_batch, to_batch
from tagloom.sources.files import compression_of, each, header_of, located, open_plain, read_at, read_full, read_header, size_of, sized_files

FORMAT = "tagrecords"
#: Records of a partition, about 128 MB, and of a batch, unless the options say otherwise.
PARTITION_RECORDS, BATCH_RECORDS = 5_592_405, 262_144
ACCESS = ("sequential", "bulk", "mmap")
LAYOUTS = ("auto", "file", "directory")
#: Bytes up to which the parts of a written file are joined, unless the layout is asked for; more stay as the files of a directory.
JOINED_BYTES = 1 << 28
SCHEMA = StructType([StructField(f, LongType(), False) for f in FIELDS])


def _true(options: dict, name: str, default: bool) -> bool:
    return str(options.get(name, default)).lower() == "true"


def _offset(options: dict) -> int:
    return HEADER_SIZE if _true(options, "header", True) else 0


def records_in(path: str, options: dict, size: int | None = None) -> int:
    """Records of one uncompressed file by its size; an incomplete one is the error of the way of access."""
    size, skip = size_of(path) if size is None else size, _offset(options)
    if size < skip:
        raise RecordIOError(f"{path}: {size} bytes are too few for a header")
    full, rest = divmod(size - skip, RECORD_SIZE)
    if rest:
        if options.get("access", "sequential") == "sequential":
            raise TruncatedRecord(skip + full * RECORD_SIZE)
        raise InvalidMapSize(size - skip)
    return full


def check_range(start: int, end: int, length: int) -> None:
    """Half-open ranges lie within the file and aren't empty; the error names ``end`` whichever bound is bad."""
    if start < 0 or start >= length or end > length or end <= start:
        raise InvalidIndex(end, length)


def plan(path: str, options: dict) -> list[tuple[str, int, int | None, int]]:
    """(file, first record, end, position of the first among all files); end is None for compressed files, read as a whole.

    Headers and sizes are checked here, before any row is read. Files of a directory must agree in their lengths.
    """
    access = options.get("access", "sequential")
    if access not in ACCESS:
        raise ValueError(f"access is one of {', '.join(ACCESS)}")
    packed, headed = access == "sequential", bool(_offset(options))

    def looked_at(file: tuple[str, int]) -> tuple[Header | None, str | None]:
        if headed:
            return header_of(file[0], packed)
        return None, compression_of(file[0]) if packed else None

    files = sized_files(path)
    found = each(looked_at, files)
    lengths = {(h.bc_len, h.umi_len) for h, _ in found if h}
    sizes = [(f, None if kind else records_in(f, options, size)) for (f, size), (_, kind) in zip(files, found)]
    parts: list[tuple[str, int, int | None, int]] = []
    known = 0
    if len(lengths) > 1:
        raise RecordIOError(f"{path}: the files differ in barcode or UMI length")
    if any(n is None for _, n in sizes):
        if "start" in options or "end" in options or (len(files) > 1 and _true(options, "withposition", False)):
            raise RecordIOError(f"{path}: compressed files have no positions by which to take a range")
        return [(f, 0, n, 0) for f, n in sizes]
    total = sum(n for _, n in sizes)
    start, end = int(options.get("start", 0)), int(options.get("end", total))
    if "start" in options or "end" in options:
        check_range(start, end, total)
    wanted = max(0, end - start)
    step = max(1, -(-wanted // int(options["numpartitions"]))) if "numpartitions" in options else PARTITION_RECORDS
    for f, n in sizes:
        low, high = max(start - known, 0), min(end - known, n)
        for at in range(low, high, step):
            parts.append((f, at, min(at + step, high), known + at))
        known += n
    return parts


def _head(path: str) -> bytes:
    raw = read_at(path, 0, HEADER_SIZE)
    if len(raw) < HEADER_SIZE:
        raise RecordIOError(f"{path}: {len(raw)} bytes are too few for a header")
    return raw


def _copy(fs: pafs.FileSystem, path: str, out, skip: int = 0) -> None:
    """The bytes of a file from ``skip`` on, to the end of another."""
    if isinstance(fs, pafs.LocalFileSystem) and hasattr(out, "fileno"):
        out.flush()
        with open(path, "rb") as source:
            at, left = skip, os.fstat(source.fileno()).st_size - skip
            while left > 0 and (n := os.sendfile(out.fileno(), source.fileno(), at, left)):  # without passing through this process
                at, left = at + n, left - n
        return
    with fs.open_input_stream(path, compression=None) as source:
        source.read(skip)
        while chunk := source.read(1 << 24):
            out.write(chunk)


def _created(fs: pafs.FileSystem, path: str):
    return open(path, "wb") if isinstance(fs, pafs.LocalFileSystem) else fs.open_output_stream(path, compression=None)


def _extend(target: str, header: Header | None, parts: list[tuple[pafs.FileSystem, str, int]]) -> None:
    """Add the bytes of ``parts``, each from a place on, to a file, which no longer claims to be sorted.

    A local file is extended in place and cut back if that fails; elsewhere, where files can't be changed, it is written anew.
    """
    fs, inner = located(target)
    kept = header.with_sorted(False).to_bytes() if header else b""
    if isinstance(fs, pafs.LocalFileSystem):
        size = os.path.getsize(inner)
        with open(inner, "r+b") as out:
            try:
                out.seek(size)
                for source, path, skip in parts:
                    _copy(source, path, out, skip)
                out.flush()
                os.pwrite(out.fileno(), kept, 0)
            except BaseException:
                os.ftruncate(out.fileno(), size)
                raise
        return
    joined = f"{inner}.{uuid.uuid4().hex}"
    with _created(fs, joined) as out:
        out.write(kept)
        _copy(fs, inner, out, len(kept))
        for source, path, skip in parts:
            _copy(source, path, out, skip)
    fs.move(joined, inner)


def _add_file(target: str, header: Header, part: tuple[pafs.FileSystem, str]) -> None:
    """Add the bytes of ``part`` to a directory as a file of its own, which doesn't claim to be sorted. One move adds it whole or not at all."""
    fs, inner = located(target.rstrip("/"))
    new = f"{inner}.parts-{uuid.uuid4().hex}"
    try:
        with _created(fs, new) as out:
            out.write(header.with_sorted(False).to_bytes())
            _copy(*part, out)
        RecordWriter._add_numbered(fs, new, inner)
    except BaseException:
        if fs.get_file_info(new).type != pafs.FileType.NotFound:
            fs.delete_file(new)
        raise


def raw_part(part: tuple[str, int, int | None, int], options: dict) -> Iterator[np.ndarray]:
    """The records of one item of ``plan`` as arrays of at most ``batchrecords``; mapped, not copied, on local files."""
    path, start, end, _ = part
    batch = int(options.get("batchrecords", BATCH_RECORDS))
    if end is None:
        with open_plain(path) as stream:
            read_full(stream, _offset(options), path)
            done = 0
            while raw := read_full(stream, batch * RECORD_SIZE, path):
                full, rest = divmod(len(raw), RECORD_SIZE)
                if rest:
                    raise TruncatedRecord(_offset(options) + (done + full) * RECORD_SIZE)
                yield np.frombuffer(raw, LAYOUT)
                done += full
        return
    fs, inner = located(path)
    local = isinstance(fs, pafs.LocalFileSystem)
    for at in range(start, end, batch):
        n = min(batch, end - at)
        place = _offset(options) + at * RECORD_SIZE
        raw = np.memmap(inner, LAYOUT, "r", place, (n,)) if local else np.frombuffer(read_at(path, place, n * RECORD_SIZE), LAYOUT)
        if len(raw) < n:
            raise TruncatedRecord(place + len(raw) * RECORD_SIZE)
        yield raw


def read_part(part: tuple[str, int, int | None, int], options: dict) -> Iterator[pa.RecordBatch]:
    """The same as Arrow batches, with positions if the options ask for them."""
    position = part[3]
    for raw in raw_part(part, options):
        yield to_batch(raw, position if _true(options, "withposition", False) else None)
        position += len(raw)


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in plan(self.options["path"], self.options)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is not None:
            yield from read_part(partition.value, self.options)


class RecordStreamReader(DataSourceStreamReader):
    """Records appended to one uncompressed file; an incomplete one at the end waits for its rest. Offsets count records."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"records": int(self.options.get("start", 0))}

    def latestOffset(self) -> dict:
        size = size_of(self.options["path"])
        return {"records": max(0, (size or 0) - _offset(self.options)) // RECORD_SIZE}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        step = PARTITION_RECORDS
        return [
            InputPartition((self.options["path"], at, min(at + step, end["records"]), at)) for at in range(start["records"], end["records"], step)
        ]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from read_part(partition.value, self.options)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def check_append(path: str, header: Header | None, layout: str) -> None:
    """Whether records with this header can be added to what is at ``path``: an error before anything is written."""
    fs, inner = located(path)
    there = "directory" if fs.get_file_info(inner).type == pafs.FileType.Directory else "file"
    if layout not in ("auto", there):
        raise RecordIOError(f"{path} is a {there}, to which a {layout} can't be appended")
    if there == "directory" and header is None:
        raise RecordIOError(f"{path}: files of a directory need headers")
    plan(path, {"access": "bulk", "header": str(header is not None).lower()})
    if header is not None and sized_files(path):
        old = read_header(path)
        if (old.bc_len, old.umi_len) != (header.bc_len, header.umi_len):
            raise RecordIOError(f"{path}: appended records differ in barcode or UMI length")


class RecordWriter(DataSourceArrowWriter):
    """Tasks write their records as parts beside the target. ``commit`` joins them in order of partitions, or makes them the files of a
    directory, or one more folder of it. ``abort`` removes the parts. The number of records goes to the file ``receipt``, if given."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.target = options["path"].rstrip("/")
        self.parts = f"{self.target}.parts-{uuid.uuid4().hex}"
        self.layout = options.get("layout", "auto")
        self.header = Header.from_bytes(bytes.fromhex(options["headerhex"])) if "headerhex" in options else None
        fs, inner = located(self.target)
        self.kind = fs.get_file_info(inner).type
        self.append = not overwrite and self.kind != pafs.FileType.NotFound
        if self.append:
            check_append(self.target, self.header, self.layout)
            self.header = self.header and self.header.with_sorted(False)
        fs.create_dir(located(self.parts)[1], recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        fs, folder = located(self.parts)
        count = 0
        with _created(fs, f"{folder}/{name}") as out:
            if self.header:
                out.write(self.header.to_bytes())
            for batch in iterator:
                out.write(from_batch(batch))
                count += batch.num_rows
        message = WriterCommitMessage()
        message.place, message.name, message.count = task.partitionId(), name, count
        return message

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        done = sorted((m for m in messages if m is not None), key=lambda m: m.place)
        count = sum(m.count for m in done)
        fs, target = located(self.target)
        folder = located(self.parts)[1]
        directory = self.layout == "directory" or (self.layout == "auto" and self.header is not None and count * RECORD_SIZE > JOINED_BYTES)
        if self.append:
            directory = self.kind == pafs.FileType.Directory
        if directory:
            # Names are bounded, and attempts that weren't taken aren't left behind.
            for info in fs.get_file_info(pafs.FileSelector(folder)):
                if info.base_name not in {m.name for m in done}:
                    fs.delete_file(info.path)
            for m in done:
                fs.move(f"{folder}/{m.name}", f"{folder}/part-{m.place:06d}")
            if self.append:
                self._add_numbered(fs, folder, target)
            else:
                self._replace(fs, folder, target)
        else:
            skip = HEADER_SIZE if self.header else 0
            parts = [(fs, f"{folder}/{m.name}", skip) for m in done]
            if self.append:
                _extend(self.target, Header.from_bytes(_head(self.target)) if self.header else None, parts)
            else:
                joined = f"{folder}/joined"
                with _created(fs, joined) as out:
                    out.write(self.header.to_bytes() if self.header else b"")
                    for part in parts:
                        _copy(*part[:2], out, part[2])
                self._replace(fs, joined, target)
            fs.delete_dir(folder)
        if "receipt" in self.options:
            other, receipt = located(self.options["receipt"])
            with _created(other, receipt) as out:
                out.write(str(count).encode())

    @staticmethod
    def _add_numbered(fs: pafs.FileSystem, new: str, target: str) -> None:
        """One move adds all files of an append, a folder or one file, or none; they are numbered, and stand behind the files in order of names."""
        names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(target))]
        number = 1 + max((int(m.group(1)) for n in names if (m := re.fullmatch(r"parts-(\d+)", n))), default=0)
        fs.move(new, f"{target}/parts-{number:09d}")

    @staticmethod
    def _replace(fs: pafs.FileSystem, new: str, target: str) -> None:
        """Put ``new`` in place of ``target``; what was there is set aside until that has succeeded. A file is replaced by one move."""
        kinds = [fs.get_file_info(p).type for p in (new, target)]
        if kinds[1] == pafs.FileType.NotFound or kinds == [pafs.FileType.File] * 2:
            fs.move(new, target)
            return
        aside = f"{target}.old-{uuid.uuid4().hex}"
        fs.move(target, aside)
        try:
            fs.move(new, target)
        except BaseException:
            fs.move(aside, target)
            raise
        fs.delete_dir(aside) if kinds[1] == pafs.FileType.Directory else fs.delete_file(aside)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = located(self.parts)
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)


class RecordSource(DataSource):
    """``spark.read.format("tagrecords")``; see ``read_records`` and ``write_records`` for the options."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _options(self) -> dict:
        return {k.lower(): v for k, v in dict(self.options).items()}

    def schema(self) -> StructType:
        placed = _true(self._options(), "withposition", False)
        return StructType([*SCHEMA.fields, *([StructField("_pos", LongType(), False)] if placed else [])])

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self._options())

    def streamReader(self, schema: StructType) -> RecordStreamReader:
        return RecordStreamReader(self._options())

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self._options(), overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to the session; may be repeated."""
    spark.dataSource.register(RecordSource)


def read_records(
    spark: SparkSession,
    path: str,
    *,
    access: str = "sequential",
    start: int | None = None,
    end: int | None = None,
    partitions: int | None = None,
    batch_records: int | None = None,
    with_position: bool = False,
    header: bool = True,
) -> DataFrame:
    """The records of a file or directory: ``barcode, umi, index`` as BIGINT bits, and ``_pos`` if asked for.

    Errors of headers, sizes and ranges are raised here, as typed errors. ``sequential`` unpacks compressed files, each of which is one
    partition; ``bulk`` and ``mmap`` take the bytes as they are. ``start`` and ``end`` pick records by position without reading others.
    """
    register(spark)
    given = {
        "access": access, "start": start, "end": end, "numpartitions": partitions, "batchrecords": batch_records,
        "withposition": str(with_position).lower(), "header": str(header).lower(),
    }
    options = {k: str(v) for k, v in given.items() if v is not None}
    plan(path, options)
    return spark.read.format(FORMAT).options(**options).load(path)


def count_records(path: str, access: str = "mmap", header: bool = True) -> int:
    """Records by the sizes of the files, without reading them; compressed files can't be counted so."""
    options = {"access": access, "header": str(header).lower()}
    sizes = [(p[2], p[1]) for p in plan(path, options)]
    if any(end is None for end, _ in sizes):
        raise RecordIOError(f"{path}: a compressed file must be read to be counted")
    return sum(end - start for end, start in sizes)


def load_all(spark: SparkSession, path: str) -> tuple[Header, DataFrame]:
    """Header and records of a whole uncompressed file."""
    return read_header(path), read_records(spark, path, access="bulk")


def write_records(
    df: DataFrame,
    path: str,
    header: Header | None,
    *,
    mode: str = "overwrite",
    sort: bool = False,
    claim_sorted: bool = False,
    layout: str = "auto",
) -> int:
    """Write ``barcode, umi, index`` of ``df``; other columns are left out. The number of records written, as the tasks counted them.

    The header is validated, and compared with what is there, before anything is written; None writes records alone. ``sort`` puts the
    records into unsigned order; the header claims it only then, or if the caller asserts it by ``claim_sorted``. ``layout`` as
    ``file`` joins the tasks' parts on the driver, ``directory`` leaves a file for each task, and ``auto`` does the one up to
    ``JOINED_BYTES`` and the other beyond. Nulls can't be written. ``mode`` as ``append`` adds to the file or directory that is
    there, which doesn't claim to be sorted any more.
    """
    if mode not in ("overwrite", "append", "error", "ignore"):
        raise ValueError(f"unknown mode {mode}")
    if layout not in LAYOUTS:
        raise ValueError(f"layout is one of {', '.join(LAYOUTS)}")
    fs, inner = located(path)
    there = fs.get_file_info(inner).type != pafs.FileType.NotFound
    if there and mode == "ignore":
        return 0
    if there and mode == "error":
        raise RecordIOError(f"{path} exists")
    options = {"layout": layout, "receipt": f"{path.rstrip('/')}.count-{uuid.uuid4().hex}"}
    if header is not None:
        header.validate()
        options["headerhex"] = header.with_sorted(sort or claim_sorted).to_bytes().hex()
    elif layout == "directory":
        raise RecordIOError(f"{path}: files of a directory need headers")
    kept = mode == "append" and there
    if kept:
        check_append(path, header, layout)
    register(df.sparkSession)
    rows = df.select(*(df[f].cast("bigint").alias(f) for f in FIELDS))
    if sort:
        rows = rows.orderBy(*record_keys())
    with typed_errors():
        rows.write.format(FORMAT).options(**options).mode("append" if kept else "overwrite").save(path)
    count = int(read_at(options["receipt"], 0, 32))
    fs.delete_file(located(options["receipt"])[1])
    return count


def append_into(target: str, part: str) -> int:
    """Move the records of ``part``, a file without header, to the end of ``target``; the number of records moved.

    ``target`` is a file, or a directory, as large writes are: that gets one more file, with the header of its first one. A part with a
    header is refused, as its header would become records. The target no longer claims to be sorted.
    """
    raw = read_at(part, 0, HEADER_SIZE)
    if len(raw) == HEADER_SIZE:
        try:
            Header.from_bytes(raw).validate()
        except RecordFileError:
            pass
        else:
            raise RecordIOError(f"{part} has a header")
    moved = records_in(part, {"header": "false", "access": "bulk"})
    fs, inner = located(target)
    directory = fs.get_file_info(inner).type == pafs.FileType.Directory
    if directory:
        plan(target, {"access": "bulk"})
        header = read_header(target)
    else:
        header = Header.from_bytes(_head(target)).validate()
        records_in(target, {"access": "bulk"})
    other, path = located(part)
    if moved and directory:
        _add_file(target, header, (other, path))
    elif moved:
        _extend(target, header, [(other, path, 0)])
    other.open_output_stream(path, compression=None).close()
    return moved
