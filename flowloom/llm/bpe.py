"""BPE encoding and decoding by forced boundaries (operator 10).

Two neighbouring bytes that stand inside no token of the vocabulary can never end up in one token:
the text may be cut between them. Every fragment is encoded on its own, and the ids are concatenated.
Because nearly all fragments are words with their space, a task encodes equal fragments once, as long as it remembers them;
they are compared as bytes.

A cut is made between bytes x and y only if

* no token has x directly followed by y (tokens of the added vocabulary included, so none is broken);
* y starts a character;
* x ends no white space: how a run of spaces is split depends on what follows it;
* y is no apostrophe: after a cut, ``'s`` would be read as a contraction also behind other punctuation.

Then the pre-tokenizer, which reads from left to right, splits both sides as it splits the whole.

Null texts are empty texts and give no ids. Row order, repeated rows and further columns are kept.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.arrays import binary_rows, gather, text_groups
from flowloom.llm.rows import free_name

#: Fragments that a task remembers before it starts anew, and the longest one (in bytes) worth remembering.
REMEMBERED, LONGEST = 1 << 18, 64
#: Last two bytes of the white-space characters beyond ASCII.
WIDE_SPACES = [(0xC2, 0x85), (0xC2, 0xA0), (0x9A, 0x80), *((0x80, x) for x in range(0x80, 0x8B)),
               (0x80, 0xA8), (0x80, 0xA9), (0x80, 0xAF), (0x81, 0x9F)]


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def token_bytes(spec: str) -> list[bytes]:
    """Bytes of every id of a byte-level tokenizer file; missing ids are empty."""
    parsed = json.loads(spec)
    if parsed.get("normalizer") or parsed["pre_tokenizer"]["type"] != "ByteLevel" or parsed["model"]["type"] != "BPE":
        raise ValueError("only byte-level BPE without a normalizer is supported")
    alphabet, added = byte_alphabet(), {t["id"]: t["content"] for t in parsed["added_tokens"]}
    out = [b""] * (1 + max([*parsed["model"]["vocab"].values(), *added]))
    for token, i in parsed["model"]["vocab"].items():
        out[i] = added[i].encode() if i in added else bytes(alphabet[c] for c in token)
    for i, token in added.items():
        out[i] = token.encode()
    return out


def cut_table(tokens: list[bytes]) -> np.ndarray:
    """cut[x, y]: the text may be cut between bytes x and y, whatever stands before x."""
    inside = np.zeros((256, 256), bool)
    for t in tokens:
        b = np.frombuffer(t, np.uint8)
        inside[b[:-1], b[1:]] = True
    cut = ~inside
    cut[:, 0x80:0xC0] = False
    cut[:, 0x27] = False
    cut[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32], :] = False
    return cut


def cuts(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Fragment bounds in the concatenated documents: forced boundaries and document ends."""
    at = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        at[1:-1] = table[data[:-1], data[1:]]
        at[2:-1] &= ~wide[data[:-2], data[1:-1]]
    at[offsets] = True
    return np.flatnonzero(at)


def _wide_spaces() -> np.ndarray:
    wide = np.zeros((256, 256), bool)
    wide[tuple(np.array(WIDE_SPACES).T)] = True
    return wide


class Codec:
    """What a task needs for coding; made once per task from the tokenizer file's text."""

    def __init__(self, spec: str):
        self.spec, self.tokens = spec, token_bytes(spec)
        self.table, self.wide = cut_table(self.tokens), _wide_spaces()
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.known: dict[bytes, bytes] = {}  # fragments and their packed ids

    def learn(self, fragments: list[bytes]) -> None:
        if not hasattr(self, "library"):
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's cores belong to Spark
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
            self.library.no_truncation()
            self.library.no_padding()
        codes = self.library.encode_batch_fast([f.decode() for f in fragments], add_special_tokens=False)
        self.known.update((f, array("I", c.ids).tobytes()) for f, c in zip(fragments, codes))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the concatenated documents and each document's bounds in them."""
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        bounds, raw = cuts(data, offsets, self.table, self.wide), data.tobytes()
        edges = bounds.tolist()
        fragments = [raw[a:b] for a, b in zip(edges[:-1], edges[1:])]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [f for f in set(fragments) if f not in self.known]
        if new:
            self.learn(new)
        packed = list(map(self.known.__getitem__, fragments))
        for f in new:
            if len(f) > LONGEST:
                del self.known[f]
        done = np.zeros(len(bounds), np.int64)
        np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) // 4, out=done[1:])
        return np.frombuffer(b"".join(packed), np.uint32), done[np.searchsorted(bounds, offsets)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the concatenated id rows and each row's bounds in them."""
        done = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.sizes[ids], out=done[1:])
        return gather(self.flat, self.starts[ids], self.sizes[ids]), done[bounds]


def _packed(codec: Codec, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    ids, bounds = codec.encode(data, offsets)
    return [binary_rows(ids.astype("<u4"), bounds * 4).cast(pa.binary())]


def _texts(codec: Codec, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    out, at = codec.decode(ids, bounds)
    raw = out.tobytes()
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])], pa.string())


def _unpacked(codec: Codec, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    return [_texts(codec, np.frombuffer(data.tobytes(), "<u4"), offsets // 4)]


def _both(codec: Codec, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    ids, bounds = codec.encode(data, offsets)
    return [binary_rows(ids.astype("<u4"), bounds * 4).cast(pa.binary()), _texts(codec, ids, bounds)]


def _with_columns(df: DataFrame, spec: str, source: str, new: dict[str, T.DataType], convert) -> DataFrame:
    new = {free_name(df, name): kind for name, kind in new.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(spec)
            for first, end, data, offsets in text_groups(batch.column(batch.schema.names.index(source))):
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*part.columns, *convert(codec, data, offsets)], names=[*part.schema.names, *new])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in new.items())]))


def read_spec(path: str) -> str:
    """The tokenizer file's text, read once on the driver (a few MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_column(df: DataFrame, spec: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add ``ids``: the text's ids as packed little-endian unsigned 32-bit integers. Null and empty texts give no bytes."""
    return _with_columns(df, spec, text, {ids: T.BinaryType()}, _packed)


def decode_column(df: DataFrame, spec: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Add ``text``: what the packed ids stand for; bytes that are no UTF-8 become U+FFFD. Null ids give an empty text."""
    return _with_columns(df, spec, ids, {text: T.StringType()}, _unpacked)


def encode_and_decode(df: DataFrame, spec: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Both columns in one pass over the rows."""
    return _with_columns(df, spec, text, {ids: T.BinaryType(), decoded: T.StringType()}, _both)


def coding_digest(documents: DataFrame, spec: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return encode_and_decode(documents.select("doc_id", "text"), spec).select(
        "doc_id",
        F.expr("octet_length(token_ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
