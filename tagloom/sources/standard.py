"""Standard input and output as record files, through a file in the folder that driver and executors share."""

import sys
import uuid
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession

from tagloom.header import Header
from tagloom.session import remember, shared_dir
from tagloom.sources.binary import read_records, write_records
from tagloom.sources.files import located


def _beside(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/tagloom-{uuid.uuid4().hex}.records"
    remember(spark, path)
    return path


def spooled(spark: SparkSession, stream: BinaryIO | None = None) -> str:
    """A stream, by default standard input, as a file in the shared folder, compressed as it came; removed with the driver program."""
    path = _beside(spark)
    fs, inner = located(path)
    source = sys.stdin.buffer if stream is None else stream
    with fs.open_output_stream(inner, compression=None) as out:
        while chunk := source.read(1 << 22):
            out.write(chunk)
    return path


def read_optional(spark: SparkSession, path: str | None, stream: BinaryIO | None = None, **options) -> DataFrame:
    """Records of the file, or of a stream, by default standard input, if there is no path."""
    return read_records(spark, path if path is not None else spooled(spark, stream), **options)


def write_optional(df: DataFrame, path: str | None, header: Header | None, stream: BinaryIO | None = None, **options) -> None:
    """Write to the file, or to a stream, by default standard output, if there is no path; the bytes don't have to fit memory."""
    if path is not None:
        write_records(df, path, header, **options)
        return
    out = sys.stdout.buffer if stream is None else stream
    for chunk in _encoded(df, header, **options):
        out.write(chunk)
    out.flush()


def _encoded(df: DataFrame, header: Header | None, **options):
    path = _beside(df.sparkSession)
    write_records(df, path, header, **{**options, "layout": "file"})
    fs, inner = located(path)
    with fs.open_input_stream(inner, compression=None) as source:
        while chunk := source.read(1 << 22):
            yield chunk
    fs.delete_file(inner)


def encode_to_bytes(df: DataFrame, header: Header | None, **options) -> bytes:
    """The bytes of a file of these records; they must fit the driver's memory."""
    return b"".join(_encoded(df, header, **options))
