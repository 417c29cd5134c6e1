"""Errors of record files; all of them are ``RecordFileError``."""

import re
from collections.abc import Iterator
from contextlib import contextmanager


class RecordFileError(Exception):
    """Anything wrong with a record file or its processing."""

    #: How many numbers the message holds, in the order of the constructor; 0 if the constructor takes the message.
    numbers = 0

    @classmethod
    def said(cls, message: str) -> "RecordFileError":
        """The error of this class whose message is ``message``."""
        if not cls.numbers:
            return cls(message)
        return cls(*(int(x, 0) for x in re.findall(r"0x[0-9a-f]+|-?\d+", message)[: cls.numbers]))


class RecordIOError(RecordFileError):
    """Reading or writing failed, or a file is too short for a header."""


class CompressionError(RecordFileError):
    """A compressed file can't be unpacked."""


class InvalidMagicNumber(RecordFileError):
    numbers = 2

    def __init__(self, expected: int, actual: int):
        self.expected, self.actual = expected, actual
        super().__init__(f"Invalid magic number: expected {expected:#x}, found {actual:#x}")


class InvalidVersion(RecordFileError):
    numbers = 2

    def __init__(self, expected: int, actual: int):
        self.expected, self.actual = expected, actual
        super().__init__(f"Invalid version: expected {expected}, found {actual}")


class InvalidBarcodeLength(RecordFileError):
    numbers = 1

    def __init__(self, length: int):
        self.length = length
        super().__init__(f"Invalid barcode length {length}: must be 1-32")


class InvalidUmiLength(RecordFileError):
    numbers = 1

    def __init__(self, length: int):
        self.length = length
        super().__init__(f"Invalid UMI length {length}: must be 1-32")


class TruncatedRecord(RecordFileError):
    """The sequential path met an incomplete record at byte ``pos``."""

    numbers = 1

    def __init__(self, pos: int):
        self.pos = pos
        super().__init__(f"Truncated record at byte {pos}")


class InvalidMapSize(RecordFileError):
    """On the bulk and mapped paths the size behind the header is no multiple of a record."""

    numbers = 1

    def __init__(self, size: int):
        self.size = size
        super().__init__(f"{size} bytes behind the header are not a multiple of the record size")


class InvalidIndex(RecordFileError):
    numbers = 2

    def __init__(self, idx: int, max: int):
        self.idx, self.max = idx, max
        super().__init__(f"Invalid index {idx}: must be less than max {max}")


class ProcessError(RecordFileError):
    """A fold's own code failed; the cause is chained."""


_KINDS = {
    c.__name__: c
    for c in (
        RecordIOError, CompressionError, InvalidMagicNumber, InvalidVersion, InvalidBarcodeLength, InvalidUmiLength, TruncatedRecord,
        InvalidMapSize, InvalidIndex, ProcessError,
    )
}
#: How a task's error stands in the text in which Spark brings it to the driver.
_RAISED = re.compile(r"\b(?:tagloom\.)?errors\.(\w+): (.*)")


def _from_task(error: BaseException) -> RecordFileError | None:
    found = [m for m in _RAISED.finditer(str(error)) if m.group(1) in _KINDS]
    return _KINDS[found[-1].group(1)].said(found[-1].group(2).strip()) if found else None


def record_error(error: BaseException) -> RecordFileError:
    """``error`` as one of this module's, with ``error`` as its cause.

    Such an error is given back as it is, one that a task raised is found in Spark's report of it, an error of the
    operating system is a ``RecordIOError``, and any other is a ``ProcessError``.
    """
    if isinstance(error, RecordFileError):
        return error
    out = _from_task(error) or (RecordIOError(str(error)) if isinstance(error, OSError) else ProcessError(f"Processing error: {error}"))
    out.__cause__ = error
    return out


@contextmanager
def typed_errors() -> Iterator[None]:
    """Within it, what a task raised of this module's errors reaches the caller as that error; other errors stay as they are.

    For actions on record files whose faults only a task can see, such as the end of a compressed file.
    """
    try:
        yield
    except RecordFileError:
        raise
    except Exception as e:
        found = _from_task(e)
        if found is None:
            raise
        raise found from e
