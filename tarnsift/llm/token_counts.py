"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie over bytes and an end-of-word mark. Failure links lead from a node to where greedy
longest matching goes on after the pieces that are certain by then, and each link carries how many pieces it
pops. A word is read once, byte by byte, and only numbers are added: no piece is ever built.

Defined cases: null or blank text has no tokens; words are split at Unicode white space and lower-cased; a
word with a byte that no piece covers counts as one unknown token; repeated rows are counted each; texts may be of any
length, the words of one are held at a time; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END, SYMBOLS = 256, 257
#: Words whose counts a worker keeps, and characters of the longest of them.
CACHE_WORDS, KEPT_WORD = 400_000, 64


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files of byte-level tokenizers: printable bytes for
    themselves, the others, in order, for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def load_pieces(path: str, mark: str = "</w>") -> set[tuple[int, ...]]:
    """Pieces of a word vocabulary as symbols; special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    special, letters, out = {t["content"] for t in content.get("added_tokens", [])}, byte_of_letter(), set()
    for token in content["model"]["vocab"]:
        body, ends = (token[: -len(mark)], [END]) if token.endswith(mark) else (token, [])
        if token not in special and all(c in letters for c in body):
            out.add(tuple([letters[c] for c in body] + ends))
    return out - {()}


class Automaton:
    def __init__(self, pieces: set[tuple[int, ...]]):
        self.step: dict[int, int] = {}  # node * SYMBOLS + symbol -> node
        is_piece, n = [False], 1
        for piece in pieces:
            node = 0
            for symbol in piece:
                key = node * SYMBOLS + symbol
                if key not in self.step:
                    self.step[key] = n
                    is_piece.append(False)
                    n += 1
                node = self.step[key]
            is_piece[node] = True
        self.fail, self.pops = [-1] * n, [0] * n
        below: dict[int, list[tuple[int, int]]] = {}
        for key, child in self.step.items():
            below.setdefault(key // SYMBOLS, []).append((key % SYMBOLS, child))
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for symbol, child in below.get(node, ()):
                if is_piece[child]:
                    self.fail[child], self.pops[child] = 0, 1
                else:
                    to, popped = self.fail[node], self.pops[node]
                    while to >= 0 and to * SYMBOLS + symbol not in self.step:
                        popped += self.pops[to]
                        to = self.fail[to]
                    if to >= 0:
                        self.fail[child], self.pops[child] = self.step[to * SYMBOLS + symbol], popped
                queue.append(child)
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces of greedy longest-match-first; 1 if the word cannot be cut."""
        step, fail, pops, node, total = self.step, self.fail, self.pops, 0, 0
        for symbol in (*word.encode("utf-8", "surrogatepass"), END):
            while (to := step.get(node * SYMBOLS + symbol, -1)) < 0:
                if fail[node] < 0:
                    return 1
                total += pops[node]
                node = fail[node]
            node = to
        while node:
            if fail[node] < 0:
                return 1
            total += pops[node]
            node = fail[node]
        return total

    def count_text(self, text: str | None) -> tuple[int, int]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, words, total = self.known, (text or "").lower().split(), 0
        for word in words:
            if (k := known.get(word)) is None:
                k = self.count(word)
                if len(word) <= KEPT_WORD:
                    known[word] = k
            total += k
        return len(words), total


_LOADED: dict[str, Automaton] = {}


def loaded(path: str) -> Automaton:
    if path not in _LOADED:
        _LOADED[path] = Automaton(load_pieces(path))
    return _LOADED[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words and n_tokens of every whole text."""

    @F.pandas_udf("struct<n_words:long,n_tokens:long>")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = loaded(path)
        for batch in batches:
            yield pd.DataFrame([automaton.count_text(t) for t in batch], columns=["n_words", "n_tokens"], dtype="int64")

    return docs.select("doc_id", counted("text").alias("c")).select("doc_id", "c.n_words", "c.n_tokens")
