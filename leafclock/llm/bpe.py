"""Byte-level BPE: whole texts to token ids and back.

A rank file lists byte strings and their ranks. The ``tokenizers`` library wants
characters, so every byte stands for one printable character (a fixed one-to-one table),
and every way to put a token together from two others becomes a merge, in the order of
ranks. Text is split by the pattern first. Each distinct piece is handed to the library's
BPE model once and kept while it is in use; a piece that is a token as a whole is that
token, as in the tiktoken library. Decoding looks up the bytes of every id; a character
whose bytes fall into several tokens comes back whole once they are joined.

The rank file (about 1 MB, of a fixed size) is read on the driver and broadcast.

Defined results: a null text counts as empty, an empty text has no tokens and decodes to
no bytes; null ids decode to no bytes, an id outside the table is an error; repeated rows
are encoded once each. Other columns are ignored by ``encode`` and kept by ``decode``.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafclock.llm.common import over_batches


def byte_characters() -> str:
    """Character number b stands for byte b: itself if printable, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in shown else chr(next(hidden)) for b in range(256))


class Decoder:
    """The bytes of every id."""

    def __init__(self, ranks: bytes):
        self.bytes = [b""] * (max(_table(ranks).values(), default=-1) + 1)
        for token, rank in _table(ranks).items():
            self.bytes[rank] = token
        self.lengths = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens, joined."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.bytes)):
            raise ValueError("token id outside the vocabulary")
        n = self.lengths[ids]
        shift = np.repeat(self.starts[ids] - (np.cumsum(n) - n), n)
        return self.flat[shift + np.arange(len(shift))].tobytes()

    def token_texts(self, ids: list[int]) -> list[str]:
        """What each token adds to the text; a split character comes with its last token."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        out = [decoder.decode(self.decode(np.array([i]))) for i in ids]
        if out:
            out[-1] += decoder.decode(b"", final=True)
        return out


def _table(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines()) if t}


class Codec(dict, Decoder):
    """Maps pieces of text to tuples of ids; keeps at most ``keep`` of them."""

    def __init__(self, ranks: bytes, pattern: str, keep: int = 200_000):
        from tokenizers import models

        Decoder.__init__(self, ranks)
        table = _table(ranks)
        self.to_char = dict(enumerate(byte_characters()))
        merges = []
        for token, _ in sorted(table.items(), key=lambda x: x[1]):
            cuts = [(token[:i], token[i:]) for i in range(1, len(token))]
            cuts = [c for c in cuts if c[0] in table and c[1] in table]
            cuts.sort(key=lambda c: (table[c[0]], table[c[1]]))
            merges += [(self.characters(a), self.characters(b)) for a, b in cuts]
        vocab = {self.characters(t): r for t, r in table.items()}
        self.model = models.BPE(vocab=vocab, merges=merges, ignore_merges=True)
        self.split = regex.compile(pattern).findall
        self.keep = keep

    def characters(self, data: bytes) -> str:
        return data.decode("latin-1").translate(self.to_char)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= self.keep:
            self.clear()
        ids = self[piece] = tuple(t.id for t in self.model.tokenize(self.characters(piece.encode())))
        return ids

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.__getitem__, self.split(text))), np.int32)

    def offsets(self, text: str, ids: np.ndarray) -> np.ndarray:
        """First and last-plus-one character of every token; tokens may share a split character."""
        data = np.frombuffer(text.encode(), np.uint8)
        at = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.lengths[ids])
        return np.column_stack([at[ends - self.lengths[ids]], at[ends - 1] + 1]) if len(ids) else np.zeros((0, 2), int)


_codecs: dict[str, Decoder] = {}


class Shared:
    """A codec, or a decoder without a pattern, that each worker builds once from the broadcast rank file."""

    def __init__(self, spark, path: str, pattern: str | None = None):
        with open(path, "rb") as f:
            data = f.read()
        self.data, self.pattern = spark.sparkContext.broadcast(data), pattern
        self.key = hashlib.sha256(data + repr(pattern).encode()).hexdigest()

    def get(self):
        if self.key not in _codecs:
            data = self.data.value
            _codecs[self.key] = Decoder(data) if self.pattern is None else Codec(data, self.pattern)
        return _codecs[self.key]


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """(doc_id, ids) of every row, and with ``offsets`` the characters [start, end) of each token."""
    shared = Shared(docs.sparkSession, path, pattern)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = shared.get()
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids = [codec.encode(t) for t in texts]
        columns = [batch.column("doc_id"), _lists(ids, pa.int32())]
        if offsets:
            spans = [codec.offsets(t, i).astype(np.int32) for t, i in zip(texts, ids)]
            columns += [_lists([s[:, k] for s in spans], pa.int32()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "starts", "ends"][:len(columns)])

    schema = "doc_id long, ids array<int>" + ", starts array<int>, ends array<int>" * offsets
    return over_batches(docs.select("doc_id", "text"), run, schema, slice_bytes=2 << 20)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds the column ``decoded``: the bytes that the column ``ids`` stands for."""
    shared = Shared(encoded.sparkSession, path)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec, ids = shared.get(), batch.column("ids")
        out = [
            codec.decode(row.values.drop_null().to_numpy(zero_copy_only=False)) if row.is_valid else b""
            for row in ids
        ]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return over_batches(encoded, run, schema, slice_bytes=2 << 20)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, through ``encode`` and ``decode``."""
    both = decode(encode(docs, path, pattern), path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
