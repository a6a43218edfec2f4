"""Byte-level BPE: encoding of whole texts to ids and back.

Pre-tokenisation works on arrays of code points, without regular expressions. Every code point has a class
(letter, number, blank, other) and, from its neighbours, a symbol: blanks by what follows them, quotes by the
contraction they open. A symbol is a transition function over the states of a small automaton that says where
tokens begin. Composing such functions is associative, so the states of a block of many texts come from a
scan: functions are composed within equal stretches side by side, then over the stretches, and one lookup per
character gives its state and whether it starts a token. The slices go through a cache of merged pieces; their
code-point offsets come along for decoding back to places in the text.

Defined cases: null text is empty and has no ids; every text round-trips byte by byte; very long texts are
taken in parts that end before a lone space, where a token always starts, so memory is bounded by the longest
stretch without one; runs without a boundary are merged with a heap; an empty table gives an empty result.
Repeated rows are encoded each; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Characters of one block of documents, bytes of the cache of pieces, longest piece that it keeps, length
#: from which merging takes a heap.
BLOCK_CHARS, CACHE_BYTES, KEPT_PIECE, LONG_PIECE = 500_000, 48_000_000, 64, 96

#: States: nothing open, in a run of letters, numbers, others or blanks, after a space that goes with what
#: follows, one or two letters of a contraction to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, LED, ONE_MORE, TWO_MORE = range(8)
#: Symbols besides the classes: a space or another blank right before a word, a quote that opens 's or 'll.
#: One more bit marks the first character of a text.
LEADING_SPACE, LAST_BLANK, QUOTE_1, QUOTE_2, BEGINS = 4, 5, 6, 7, 8


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(symbol, state before) -> state after, and whether the character starts a token."""
    after, starts = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, BLANK: IN_BLANKS, LEADING_SPACE: LED, LAST_BLANK: FRESH, QUOTE_1: ONE_MORE, QUOTE_2: TWO_MORE}
    for symbol, opened in run.items():
        after[symbol], after[symbol + BEGINS] = opened, opened
        for state in (IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS):
            starts[symbol, state] = opened != state
        if symbol in (QUOTE_1, QUOTE_2):  # inside a run of others, or after its space, a quote is one of them
            after[symbol, [IN_OTHERS, LED]], starts[symbol, IN_OTHERS] = IN_OTHERS, False
        starts[symbol, [LED, ONE_MORE, TWO_MORE]] = False
        after[symbol, ONE_MORE], after[symbol, TWO_MORE] = FRESH, ONE_MORE
    return after, starts


AFTER, STARTS = _automaton()


def code_point_classes() -> np.ndarray:
    import unicodedata

    first = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode(), np.uint8)
    table = np.full(0x110000, OTHER, np.uint8)
    table[first == ord("L")] = LETTER
    table[first == ord("N")] = NUMBER
    table[WHITE] = BLANK
    return table


def symbols_of(cp: np.ndarray, cls: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The symbol of every character of a block of texts; begins: marks each text's first character."""
    n = len(cp)
    out = cls.copy()
    leads = np.zeros(n, bool)
    leads[:-1] = (cls[:-1] == BLANK) & (cls[1:] != BLANK) & ~begins[1:]
    out[leads] = LAST_BLANK
    out[leads & (cp == 32)] = LEADING_SPACE
    quote = np.flatnonzero(cp == 39)
    if len(quote):
        wide, fresh = np.concatenate((cp, [0, 0])), np.concatenate((begins, [True, True]))
        one, two = wide[quote + 1], wide[quote + 2]
        one = np.where(fresh[quote + 1], 0, one)
        two = np.where(fresh[quote + 1] | fresh[quote + 2], 0, two)
        out[quote[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE_1
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        out[quote[pair]] = QUOTE_2
    out[begins] |= BEGINS
    return out


def token_starts(cp: np.ndarray, cls: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Marks token starts in a block of texts, by a scan over the characters' transition functions."""
    n = len(cp)
    length = max(1, int(np.sqrt(n)))
    rows = -(-n // length)
    symbol = np.full(rows * length, BLANK, np.uint8)
    symbol[:n] = symbols_of(cp, cls, begins)
    side = np.ascontiguousarray(symbol.reshape(rows, length).T).astype(np.int64) * 8  # place in the stretch x stretch
    flat = AFTER.ravel()
    # before[t, r, s]: the state at place t of stretch r if the stretch was entered in state s
    before = np.empty((length + 1, rows, 8), np.uint8)
    before[0] = np.arange(8)
    for t in range(length):
        np.take(flat, side[t][:, None] + before[t], out=before[t + 1])
    entered, state = np.zeros(rows, np.int64), FRESH
    for r, whole in enumerate(before[length].tolist()):
        entered[r] = state
        state = whole[state]
    states = np.take_along_axis(before[:length], entered[None, :, None], 2)[:, :, 0]
    return STARTS.ravel()[side + states].T.ravel()[:n]


class BytePairs:
    """Encoder and decoder for a file of ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.classes = code_point_classes()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.first, self.count = array("I"), array("q"), array("q")
        self.held = 0  # bytes, about

    def merged(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) >= LONG_PIECE:
            return self._merged_by_heap(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(self.pieces)
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merged_by_heap(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        right, left = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if parts[i] is None or j < 0 or parts[i] + parts[j] != pair:
                continue
            parts[i], parts[j] = pair, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a] + parts[b]))
        return [ranks[p] for p in parts if p is not None]

    def _learn(self, piece: bytes) -> int:
        """The number of a piece in the cache; one too long to keep is only there for its block."""
        ids = self.merged(piece)
        number = len(self.first)
        if len(piece) <= KEPT_PIECE:
            self.known[piece] = number
            self.held += 150 + len(piece)
        self.held += 4 * len(ids)
        self.first.append(len(self.flat))
        self.count.append(len(ids))
        self.flat.extend(ids)
        return number

    def encode_block(self, texts: list[str], offsets: bool = False) -> list:
        """ids (uint32) per text; with offsets, pairs of ids and each id's piece's first code point."""
        if self.held > CACHE_BYTES:
            self._forget()
        whole = "".join(texts)
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) for t in texts])
        edges = np.concatenate(([0], np.cumsum(sizes)))
        if not len(cp):
            empty = np.empty(0, np.uint32)
            return [(empty, empty) if offsets else empty for _ in texts]
        begins = np.zeros(len(cp), bool)
        begins[edges[:-1][sizes > 0]] = True
        starts = np.flatnonzero(token_starts(cp, self.classes[cp], begins))
        width = np.ones(len(cp), np.uint8)
        for least in (0x80, 0x800, 0x10000):
            width += cp >= least
        byte_at = np.cumsum(width, dtype=np.int64) - width
        data = whole.encode()
        cuts = [*byte_at[starts].tolist(), len(data)]
        known, learn = self.known, self._learn
        get = known.get
        number = np.array([k if (k := get(p)) is not None else learn(p) for p in [data[a:b] for a, b in zip(cuts, cuts[1:])]])
        count = np.array(np.frombuffer(self.count, np.int64)[number])
        first = np.frombuffer(self.first, np.int64)[number]
        ends = np.cumsum(count)
        flat = np.frombuffer(self.flat, np.uint32)[np.arange(ends[-1]) + np.repeat(first - ends + count, count)]
        token_edges = np.searchsorted(starts, edges)  # pieces before each text
        id_edges = np.concatenate(([0], ends))[token_edges]
        out = [flat[a:b] for a, b in zip(id_edges[:-1], id_edges[1:])]
        if offsets:
            places = np.repeat(starts, count)
            return [(ids, places[a:b] - e) for ids, a, b, e in zip(out, id_edges[:-1], id_edges[1:], edges)]
        return out

    def parts(self, text: str) -> Iterator[str]:
        """A long text in parts of little more than BLOCK_CHARS, cut before spaces that lead a word."""
        begin = 0
        while len(text) - begin > BLOCK_CHARS:
            at = text.find(" ", begin + BLOCK_CHARS)
            while 0 <= at < len(text) - 1 and self.classes[ord(text[at + 1])] == BLANK:
                at = text.find(" ", at + 1)
            if not 0 <= at < len(text) - 1:
                break
            yield text[begin:at]
            begin = at
        yield text[begin:]

    def encode_parts(self, texts: list[str | None]) -> Iterator[tuple[bool, np.ndarray]]:
        """(first part of a text, its ids), a bounded number of characters at a time."""
        block, firsts, chars = [], [], 0
        for text in texts:
            for k, part in enumerate(self.parts(text or "")):
                block.append(part)
                firsts.append(k == 0)
                chars += len(part)
                if chars >= BLOCK_CHARS:
                    yield from zip(firsts, self.encode_block(block))
                    block, firsts, chars = [], [], 0
        yield from zip(firsts, self.encode_block(block) if block else ())

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        held: list[np.ndarray] = []
        for is_first, ids in self.encode_parts(texts):
            if is_first and held:
                yield held[0] if len(held) == 1 else np.concatenate(held)
                held = []
            held.append(ids)
        if held:
            yield held[0] if len(held) == 1 else np.concatenate(held)

    def decoded(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))

    def decode(self, ids: bytes) -> bytes:
        return self.decoded(np.frombuffer(ids, "<u4"))


_LOADED: dict[str, BytePairs] = {}


def loaded(path: str) -> BytePairs:
    """One encoder per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = BytePairs(path)
    return _LOADED[path]


def encoded(text: Column, path: str) -> Column:
    """The ids of a text as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pairs = loaded(path)
        for batch in batches:
            yield pd.Series([ids.astype("<u4").tobytes() for ids in pairs.encode(batch.tolist())], dtype=object)

    return encode.asNondeterministic()(text)


def decoded(ids: Column, path: str) -> Column:
    """The bytes that ids stand for."""

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pairs = loaded(path)
        for batch in batches:
            yield pd.Series([pairs.decode(x) for x in batch], dtype=object)

    return decode.asNondeterministic()(ids)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): ids as bytes, see encoded()."""
    return docs.select("doc_id", encoded(F.col("text"), path).alias("ids"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of what they decode to. One worker encodes and
    decodes a text part by part, so only digests leave it."""

    @F.pandas_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pairs = loaded(path)
        for batch in batches:
            rows: list[list] = []
            for is_first, ids in pairs.encode_parts(batch.tolist()):
                if is_first:
                    rows.append([0, hashlib.sha256(), hashlib.sha256()])
                row = rows[-1]
                row[0] += len(ids)
                row[1].update(ids.astype("<u4").tobytes())
                row[2].update(pairs.decoded(ids))
            yield pd.DataFrame([(n, a.hexdigest(), b.hexdigest()) for n, a, b in rows], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", both.asNondeterministic()("text").alias("r")).select("doc_id", "r.*")
