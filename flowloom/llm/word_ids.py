"""Ids of word-level BPE tokenizers that drop white space (shared by the binary output of operator 11).

Such a tokenizer makes white space one blank and never lets a token cross it, so the text may be cut there: the words between
ASCII white space are coded on their own and their packed ids are joined. A word of plain characters is cut further, since the tokenizer
cuts it there too: into runs of lower-cased letters, digits, and runs of other signs. Texts are cut in groups of some MB as whole
arrays, so Python sees each different word or run of a group once. Equal words and runs are coded once by a
worker, as long as it remembers them; they are compared as bytes, never by a hash.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.arrays import SPACE
from flowloom.llm.bpe import byte_alphabet

#: Words and runs that a worker remembers about, and the longest word (in bytes) worth remembering.
WORDS, RUNS, LONGEST = 1 << 19, 1 << 20, 64
#: Bytes of a text that are split at once; the cut is moved to the next white space. Pieces of any texts are coded together up to the second size.
PIECE, GROUP = 1 << 20, 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Words that normal forms leave alone, lower case changes letter by letter, and no contraction, special token or other script cuts.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_SIGN = r"!-&(-/:-;=-@\[-`{-~"
_PLAIN = re.compile(f"[{_LETTER}0-9{_SIGN}]+")
_PLAIN_TEXT = re.compile(f"[{_LETTER}0-9{_SIGN}\\x20\\x09-\\x0d]*")
#: Kinds of bytes: white space, and what words consist of or, in plain text in lower case, runs; there all bytes beyond ASCII belong to letters.
_BLANK, _DIGIT, _LOWER, _OTHER = range(4)
_IN_WORDS = np.where(SPACE, _BLANK, _OTHER).astype(np.uint8)
_IN_RUNS = _IN_WORDS.copy()
_IN_RUNS[48:58], _IN_RUNS[97:123], _IN_RUNS[128:] = _DIGIT, _LOWER, _LOWER
#: The cuts that the runs follow; another tokenizer's words are coded whole.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_kept: dict[str, WordCoder] = {}


def id_type(spec: str, end_id: int) -> str:
    """NumPy type of packed ids: two bytes where all ids fit, else four."""
    parsed = json.loads(spec)
    added = [t["content"] for t in parsed["added_tokens"]]
    if not re.search(r"\\s\+", json.dumps(parsed["normalizer"])) or any(_SPACE.search(t.encode()) for t in added):
        raise ValueError("only tokenizers that make white space one blank and have none inside a token are supported")
    return "<u2" if max([end_id, *parsed["model"]["vocab"].values(), *(t["id"] for t in parsed["added_tokens"])]) < 1 << 16 else "<u4"


def _cut(texts: list[bytes], kinds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words or runs of all texts, and each text's first one (one more at the end). Texts must not be cut within a word."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    kind = kinds[data]
    inner = kind != _BLANK
    start = inner.copy()
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    kept = data[inner]
    at = np.append(np.flatnonzero(start[inner]), len(kept)).astype(np.int32)
    items = pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(kept)])
    begin = np.cumsum([0, *(len(text) + 1 for text in texts)])
    return items.dictionary_encode(), np.searchsorted(np.flatnonzero(start), begin)


def _names(items: pa.DictionaryArray) -> list[bytes]:
    """The different words or runs."""
    _, offsets, data = items.dictionary.buffers()
    ends = np.frombuffer(offsets, np.int32)[: len(items.dictionary) + 1].tolist()
    raw = data.to_pybytes() if data else b""
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _joined(items: pa.DictionaryArray, bounds: np.ndarray, codes: list[bytes]) -> list[bytes]:
    """Every text's packed ids from those of the different words or runs."""
    if len(items) == 0:
        return [b""] * (len(bounds) - 1)
    taken = pa.array(codes, pa.binary()).take(items.indices)
    _, offsets, data = taken.buffers()
    ends = np.frombuffer(offsets, np.int32)[bounds].tolist()
    packed = memoryview(data)
    return [bytes(packed[a:b]) for a, b in zip(ends[:-1], ends[1:])]


class Memory:
    """Packed ids of words or runs in two halves. When the young half is full, it becomes the old one; what is met again moves back."""

    def __init__(self):
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def codes(self, names: list[bytes], learn: Callable[[list[bytes]], Iterable[bytes]], most: int) -> list[bytes]:
        """Packed ids of different names; ``learn`` makes those of the unknown ones."""
        if len(self.young) > most // 2:
            self.young, self.old = {}, self.young
        codes = list(map(self.young.get, names))
        late = [k for k, ids in enumerate(codes) if ids is None]
        new = []
        for k in late:
            codes[k] = ids = self.old.get(names[k])
            if ids is None:
                new.append(k)
        for k, ids in zip(new, learn([names[k] for k in new])):
            codes[k] = ids
        self.young.update((names[k], codes[k]) for k in late if len(names[k]) <= LONGEST)
        return codes


class WordCoder:
    """Packed ids of whole texts."""

    def __init__(self, spec: str, kind: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's cores belong to Spark
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        self.type = {2: "H", 4: "I"}[int(kind[-1])]
        split = parsed["pre_tokenizer"].get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        steps = [x["type"] for k, many in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")) for x in parsed[k].get(many, [])]
        self.cuts_runs = split == CUTS and steps == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]
        self.whole = Tokenizer.from_str(spec)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model  # runs are in normal form and cut already, so the bare model codes them
        self.alphabet = {byte: char for char, byte in byte_alphabet().items()}
        self.words, self.runs = Memory(), Memory()

    def _coded_run(self, run: bytes) -> bytes:
        letters = run.decode() if run.isascii() else run.decode("latin-1").translate(self.alphabet)
        return array(self.type, [token.id for token in self.model.tokenize(letters)]).tobytes()

    def _coded_runs(self, texts: list[bytes]) -> list[bytes]:
        """Ids of plain texts in lower case."""
        items, bounds = _cut(texts, _IN_RUNS)
        return _joined(items, bounds, self.runs.codes(_names(items), lambda runs: map(self._coded_run, runs), RUNS))

    def _coded_words(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts of any kind."""
        items, bounds = _cut(texts, _IN_WORDS)
        return _joined(items, bounds, self.words.codes(_names(items), self._learned_words, WORDS))

    def _learned_words(self, words: list[bytes]) -> list[bytes]:
        texts = [word.decode() for word in words]
        plain = [self.cuts_runs and _PLAIN.fullmatch(text) is not None for text in texts]
        runs = iter(self._coded_runs([text.lower().encode() for text, cut in zip(texts, plain) if cut]))
        odd = iter(self.whole.encode_batch_fast([text for text, cut in zip(texts, plain) if not cut], add_special_tokens=False))
        return [next(runs) if cut else array(self.type, next(odd).ids).tobytes() for cut in plain]

    def encode_texts(self, texts: Iterable[bytes]) -> list[bytes]:
        """Packed ids of every text."""
        out: list[list[bytes]] = []
        groups = {True: [], False: []}  # waiting pieces of plain and of other text, with their places in ``out``
        held = {True: 0, False: 0}

        def code(plain: bool) -> None:
            found = (self._coded_runs if plain else self._coded_words)([piece for *_, piece in groups[plain]])
            for (parts, k, _), ids in zip(groups[plain], found):
                parts[k] = ids
            groups[plain], held[plain] = [], 0

        for raw in texts:
            parts, at = [], 0
            out.append(parts)
            while at < len(raw):
                cut = _SPACE.search(raw, at + PIECE) if len(raw) - at > PIECE else None
                end = cut.start() if cut else len(raw)
                text = raw[at:end].decode()
                plain = self.cuts_runs and _PLAIN_TEXT.fullmatch(text) is not None
                if held[plain] + end - at > GROUP:  # a larger piece makes a group of its own
                    code(plain)
                groups[plain].append((parts, len(parts), text.lower().encode() if plain else raw[at:end]))
                parts.append(b"")
                held[plain] += end - at
                at = end
        for plain in groups:
            code(plain)
        return [b"".join(parts) for parts in out]

    def encode(self, raw: bytes) -> bytes:
        return self.encode_texts([raw])[0]


def coder(spec: str, kind: str) -> WordCoder:
    """The worker's coder; tasks that follow one another in a worker share it."""
    if spec not in _kept:
        _kept.clear()
        _kept[spec] = WordCoder(spec, kind)
    return _kept[spec]


def encoded(docs: DataFrame, spec: str, end_id: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, ids): packed ids of every text with the end id behind them; null texts give the end id alone."""
    kind = id_type(spec, end_id)
    end = end_id.to_bytes(int(kind[-1]), "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(spec, kind).encode_texts
        for batch in batches:
            ids = [packed + end for packed in code(x.as_py() or b"" for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids binary")
