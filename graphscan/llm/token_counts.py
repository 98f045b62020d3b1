"""Operator 10: word-piece lengths by a linear longest-match automaton.

The vocabulary is a byte trie.  Each trie node has a failure link, the node
to go on from once the pieces that greedy longest-match would emit for the
node's prefix are popped, and the number of those pieces.  Walking a word then
takes one transition per byte, plus failure steps that its bytes pay for, and
only sums popped counts: no piece is ever built.

Words are walked side by side: a step moves every distinct word of a slice by
one byte, each state looked up in the sorted transition table.

Cases.  A null or empty text has no words and no pieces; a word with no
segmentation counts as one unknown piece; words of any length are walked
whole; repeated documents are each reported; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import byte_slices, map_arrow, ragged, span_hashes, true_runs

SCHEMA = "doc_id long, n_words long, n_unknown long, n_tokens long"
_NONE = -1

_BODY = np.zeros(256, bool)
_BODY[0x30:0x3A] = _BODY[0x41:0x5B] = _BODY[0x61:0x7B] = True
_BODY[0x80:] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(9, 14)]] = True


class LongestMatch:
    """Automaton over initial pieces (at a word's start) and continuation pieces."""

    def __init__(self, initial: Iterable[bytes], continuation: Iterable[bytes]):
        children: list[dict[int, int]] = [{}, {}]  # node 0: word start, node 1: inside a word
        final = [False, False]
        for root, pieces in ((0, initial), (1, continuation)):
            for piece in pieces:
                node = root
                for byte in piece:
                    if byte not in children[node]:
                        children[node][byte] = len(children)
                        children.append({})
                        final.append(False)
                    node = children[node][byte]
                final[node] |= node > 1
        fail, popped = [_NONE] * len(children), [0] * len(children)
        level = [(root, byte, child) for root in (0, 1) for byte, child in children[root].items()]
        while level:
            following = []
            for parent, byte, node in level:
                if final[node]:
                    fail[node], popped[node] = 1, 1
                else:
                    at, count = fail[parent], popped[parent]
                    while at != _NONE and byte not in children[at]:
                        count += popped[at]
                        at = fail[at]
                    if at != _NONE:
                        fail[node], popped[node] = children[at][byte], count
                following += [(node, b, c) for b, c in children[node].items()]
            level = following
        pairs = sorted((node * 256 + byte, child) for node, out in enumerate(children) for byte, child in out.items())
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.targets = np.array([t for _, t in pairs], np.int64)
        self.fail, self.popped = np.array(fail, np.int64), np.array(popped, np.int64)

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.targets[at], _NONE) if len(self.keys) else np.full(len(node), _NONE)

    def lengths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each non-empty word data[start:end]; -1 where there is no segmentation."""
        n = len(starts)
        count, node = np.zeros(n, np.int64), np.zeros(n, np.int64)
        order = np.argsort(starts - ends, kind="stable")  # longest first: the live words are a prefix
        sizes = (ends - starts)[order]
        live, at = n, 0
        state, total, first = node[order], count[order], starts[order]
        while live and at < (sizes[0] if n else 0):
            live = int(np.searchsorted(-sizes, -at, "left"))
            self._advance(state[:live], total[:live], data[first[:live] + at])
            at += 1
        left = np.flatnonzero((state > 1) & (state != _NONE))
        while len(left):  # the end pops what is still held
            total[left] += self.popped[state[left]]
            state[left] = self.fail[state[left]]
            left = left[state[left] > 1]
        total[state == _NONE] = -1
        count[order] = total
        return count

    def _advance(self, state: np.ndarray, total: np.ndarray, byte: np.ndarray) -> None:
        todo = np.flatnonzero(state != _NONE)
        while len(todo):
            new = self._step(state[todo], byte[todo].astype(np.int64))
            stuck = new == _NONE
            moved = todo[~stuck]
            state[moved] = new[~stuck]
            todo = todo[stuck]
            total[todo] += self.popped[state[todo]]
            state[todo] = self.fail[state[todo]]
            todo = todo[state[todo] != _NONE]


def greedy_length(word: bytes, initial: set[bytes], continuation: set[bytes]) -> int:
    """The same by building pieces one at a time (for tests): -1 if there is no segmentation."""
    at, n = 0, 0
    while at < len(word):
        pieces = continuation if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        at, n = end, n + 1
    return n


def byte_level_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Initial and continuation pieces from a byte-level vocabulary file.

    A piece that begins with a space starts a word (a word is walked with a
    space before it); the rest continue one.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    with open(path, encoding="utf-8") as source:
        vocabulary = json.load(source)["model"]["vocab"]
    pieces = [bytes(to_byte[c] for c in piece) for piece in vocabulary if all(c in to_byte for c in piece)]
    return [p for p in pieces if p.startswith(b" ")], [p for p in pieces if not p.startswith(b" ")]


def token_counts(documents: DataFrame, initial: list[bytes], continuation: list[bytes], mark: bytes = b" ") -> DataFrame:
    """Words and greedy pieces of every document.

    A word is a run of letters, digits and non-ASCII characters, or one other
    ASCII character that is not white space; ``mark`` is put before it.
    """
    shared = documents.sparkSession.sparkContext.broadcast(LongestMatch(initial, continuation))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = shared.value
        words, unknown, tokens = [], [], []
        for _, _, data, offsets in byte_slices(batch.column(1)):
            starts, ends = true_runs(_BODY[data])
            marks = np.flatnonzero(~_BODY[data] & ~_BLANK[data])
            doc = np.concatenate([np.searchsorted(offsets, starts, "right"), np.searchsorted(offsets, marks, "right")]) - 1
            starts, ends = np.concatenate([starts, marks]), np.concatenate([ends, marks + 1])
            _, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            begin, size = starts[first], (ends - starts)[first]
            held = np.empty(int(size.sum()) + len(mark) * len(size), np.uint8)
            place = np.cumsum(size + len(mark)) - size
            held[ragged(place, size)] = data[ragged(begin, size)]
            for i, byte in enumerate(mark):
                held[place - len(mark) + i] = byte
            length = automaton.lengths(held, place - len(mark), place + size)[back]
            n = len(offsets) - 1
            words.append(np.bincount(doc, minlength=n))
            unknown.append(np.bincount(doc, length < 0, minlength=n).astype(np.int64))
            tokens.append(np.bincount(doc, np.abs(length), minlength=n).astype(np.int64))
        columns = [pa.array(np.concatenate(x) if x else np.empty(0), pa.int64()) for x in (words, unknown, tokens)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_unknown", "n_tokens"])

    return map_arrow(documents.selectExpr("cast(doc_id as long) as doc_id", "text"), work, SCHEMA)
