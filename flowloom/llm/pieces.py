"""Greedy word-piece lengths by a linear longest-match automaton (operator 9).

Word pieces are taken from the left, each the longest of the vocabulary that fits. Instead of trying lengths and
backing up, a word runs once through a trie of all pieces. Every trie node has a failure link: the node that is
reached when the longest pieces at the front of its string are popped. How many are popped is stored with the link, so
the walk counts pieces without ever building one. Each character moves one step down; links are followed at
most as often as pieces are counted.

The first piece of a word carries the marker in front, later ones do not. A word that cannot be cut into pieces counts as
one unknown piece. Words are ``[^\\x20\\x09-\\x0D]+``; null and empty texts have none and count 0. Rows are kept as they
are, repeated ones too, with all their columns.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowloom.llm.arrays import text_groups, word_hashes, words
from flowloom.llm.rows import free_name

MARKER = "▁"
UNKNOWN = -1
#: Words that a task remembers at most; then it starts anew.
REMEMBERED = 1 << 20


def read_pieces(path: str) -> list[str]:
    """The proper pieces of a sentencepiece model: no control, unknown or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(i) for i in range(len(model)) if not any(f(i) for f in special)]


class Automaton:
    """Trie with failure links and popped-piece counts; nodes are numbers, 0 the start and 1 the start of later pieces."""

    def __init__(self, pieces: list[str], marker: str = MARKER):
        self.marker = marker
        self.next: list[dict[str, int]] = [{}, {}]
        final = {}
        for piece in pieces:
            inner = piece[len(marker) :] if piece.startswith(marker) else piece
            if not piece or marker in inner:
                continue
            node = 0 if piece.startswith(marker) else 1
            for c in piece:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                node = self.next[node][c]
            final[node] = True
        n = len(self.next)
        self.link, self.popped = [UNKNOWN] * n, [0] * n
        queue = deque((0, c, v) for c, v in self.next[0].items())
        queue.extend((1, c, v) for c, v in self.next[1].items())
        while queue:  # by depth: a node's link needs those of shorter strings
            parent, c, node = queue.popleft()
            if node in final:
                self.link[node], self.popped[node] = 1, 1
            else:
                at, count = self.link[parent], self.popped[parent]
                while at != UNKNOWN and c not in self.next[at]:
                    at, count = self.link[at], count + self.popped[at]
                if at != UNKNOWN:
                    self.link[node], self.popped[node] = self.next[at][c], count
            queue.extend((node, d, v) for d, v in self.next[node].items())

    def count(self, word: str) -> int:
        """Pieces of a word, or UNKNOWN."""
        step, link, popped = self.next, self.link, self.popped
        node, pieces = 0, 0
        for c in self.marker + word:
            after = step[node].get(c)
            while after is None:
                pieces += popped[node]
                node = link[node]
                if node == UNKNOWN:
                    return UNKNOWN
                after = step[node].get(c)
            node = after
        while node != 1:
            pieces += popped[node]
            node = link[node]
            if node == UNKNOWN:
                return UNKNOWN
        return pieces


def _group_counts(automaton: Automaton, known: dict[bytes, int], data: np.ndarray, offsets: np.ndarray):
    starts, ends, bounds = words(data, offsets)
    if len(starts) == 0:
        none = np.zeros(len(offsets) - 1, np.int64)
        return none, none, none
    distinct, first, which = np.unique(word_hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
    raw, counts = data.tobytes(), np.zeros(len(distinct), np.int64)
    if len(known) > REMEMBERED:
        known.clear()
    for k, (a, b) in enumerate(zip(starts[first].tolist(), ends[first].tolist())):
        word = raw[a:b]
        found = known.get(word)
        if found is None:
            found = known[word] = automaton.count(word.decode("utf-8", "replace"))
        counts[k] = found
    per_word = counts[which]
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
    return np.diff(bounds), sums(np.where(per_word == UNKNOWN, 1, per_word)), sums(per_word == UNKNOWN)


def piece_counts(df: DataFrame, pieces: list[str], text: str = "text", names: tuple[str, str, str] = ("n_words", "n_pieces", "n_unknown")) -> DataFrame:
    """Add the numbers of words, of greedy word pieces and of words outside the vocabulary of every text.

    ``pieces`` is a vocabulary (tens of thousands of strings); it travels with the tasks.
    """
    names = tuple(free_name(df, name) for name in names)
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = None, {}
        for batch in batches:
            automaton = automaton or Automaton(pieces)
            for first, end, data, offsets in text_groups(batch.column(batch.schema.names.index(text))):
                part = batch.slice(first, end - first)
                new = [pa.array(x, pa.int64()) for x in _group_counts(automaton, known, data, offsets)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names])

    return df.mapInArrow(run, schema)
