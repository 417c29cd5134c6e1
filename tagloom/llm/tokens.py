"""Token ids of texts by a public byte-level BPE vocabulary, through a sentencepiece model built from it.

The vocabulary file lists tokens as bytes with their ranks. Every byte becomes one printable character, every token a piece of
such characters with its negative rank as score, so that sentencepiece merges in the order of the ranks. Texts are split
into pre-tokens by the vocabulary's pattern, pre-tokens are encoded, and ids are decoded by the inverse mapping.
"""

import base64
import re
import struct
import sys
import types
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary lies on the driver; executors get it from there.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pattern by which the vocabulary's texts are split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII characters only, for the faster module re.
_ASCII = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
#: Pre-tokens a worker remembers, and the longest it does.
_REMEMBERED, _LONGEST = 500_000, 40


def byte_characters() -> str:
    """256 characters, one for each byte: printable ones of Latin-1 for themselves, the rest from U+0100 on in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in printable else chr(next(others)) for b in range(256))


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of their ranks, which must be 0, 1, 2 and so on."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError(f"{path}: the ranks have gaps")
    return [t for _, t in ranked]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol buffer: varint, 32-bit float or bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks of ``tokens``; the id after them is "unknown"."""
    names = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, _field(1, "".join(names[b] for b in t).encode()) + _field(2, -float(rank)) + _field(3, normal))
        for rank, t in enumerate(tokens)
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(n, -1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Encodes and decodes texts; made once in a worker process."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.any = regex.compile(PATTERN)
        self.ascii = re.compile(_ASCII, re.ASCII)
        names = byte_characters()
        self.names = dict(enumerate(names))
        self.bytes = {c: b for b, c in enumerate(names)}
        self.known: dict[str, list[int]] = {}
        self.pieces: list[bytes] | None = None

    def split(self, text: str) -> list[str]:
        return (self.ascii if text.isascii() else self.any).findall(text)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        mapped = [w.encode().decode("latin-1").translate(self.names) for w in words]
        return self.processor.encode(mapped, out_type=int, num_threads=1)

    def encode(self, texts: list[str | None]) -> list[list[list[int]]]:
        """Of each text the ids by pre-token; null is taken as empty."""
        known = self.known
        words = [self.split(t) if t else [] for t in texts]
        fresh = list({w for ws in words for w in ws if w not in known})
        if len(known) + len(fresh) > _REMEMBERED:
            known.clear()
            fresh = list({w for ws in words for w in ws})
        known.update(zip(fresh, self.encode_words(fresh)))
        out = [[known[w] for w in ws] for ws in words]
        for w in fresh:
            if len(w) > _LONGEST:
                del known[w]
        return out

    def decode(self, ids: list[int]) -> str:
        if self.pieces is None:
            size = self.processor.get_piece_size() - 1
            self.pieces = [bytes(self.bytes[c] for c in self.processor.id_to_piece(i)) for i in range(size)]
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def _encoder(model) -> Encoder:
    """The worker's encoder for a broadcast model; kept with the process, as functions are unpickled for each task."""
    kept = sys.modules.setdefault("_tagloom_kept", types.ModuleType("_tagloom_kept")).__dict__
    key = f"encoder {hash(model.value)}"
    if key not in kept:
        kept[key] = Encoder(model.value)
    return kept[key]


def _slices(texts: pa.Array) -> Iterator[list[str | None]]:
    """Parts of an array with a bounded sum of text lengths, unless one text is longer."""
    ends = np.cumsum(np.fromiter((len(t) if (t := x.as_py()) else 0 for x in texts), np.int64, len(texts)))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 20), "right")))
        yield texts.slice(start, stop - start).to_pylist()
        start = stop


def model_of(spark: SparkSession, vocabulary: str = VOCABULARY):
    """The serialised model of a vocabulary file, broadcast: about 1 MB, whatever the input."""
    return spark.sparkContext.broadcast(sentencepiece_model(read_ranks(vocabulary)))


def _arrow(function: Callable, kind: str) -> Callable[[Column], Column]:
    return F.arrow_udf(function, kind)


def encode_column(text: Column, model) -> Column:
    """Ids of each text as array<int>: no special tokens, text that looks like one is plain text; null and empty give []."""

    def encode(texts: pa.Array) -> pa.Array:
        encoder, ids, sizes = _encoder(model), [], [np.zeros(1, np.int32)]
        for part in _slices(texts):
            coded = encoder.encode(part)
            flat = [list(chain.from_iterable(x)) for x in coded]
            sizes.append(np.fromiter(map(len, flat), np.int32, len(flat)))
            ids.append(np.fromiter(chain.from_iterable(flat), np.int32))
        return pa.ListArray.from_arrays(np.cumsum(np.concatenate(sizes), dtype=np.int32), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))

    encode.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return _arrow(encode, "array<int>")(text)


def count_column(text: Column, model) -> Column:
    """Number of ids of each text, without the ids; null and empty give 0."""

    def count(texts: pa.Array) -> pa.Array:
        encoder, sizes = _encoder(model), [np.empty(0, np.int64)]
        for part in _slices(texts):
            coded = encoder.encode(part)
            sizes.append(np.fromiter((sum(map(len, x)) for x in coded), np.int64, len(coded)))
        return pa.array(np.concatenate(sizes))

    count.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return _arrow(count, "bigint")(text)


def decode_column(ids: Column, model) -> Column:
    """The text of each array of ids; null gives null. Bytes that are no UTF-8 become U+FFFD."""

    def decode(rows: pa.Array) -> pa.Array:
        encoder = _encoder(model)
        return pa.array([None if r is None else encoder.decode(r) for r in rows.to_pylist()], pa.string())

    decode.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return _arrow(decode, "string")(ids)
