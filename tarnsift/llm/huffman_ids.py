"""Token ids in files, by canonical length-limited Huffman codes.

Two passes. The first encodes texts, writes their ids and adds up how often each id occurs; package-merge gives
code lengths of at most MAX_BITS, and canonical codes follow from the lengths alone. The second reads the ids in
ascending doc_id order by range partitioning, and writes blocks of whole documents; every block can be decoded by itself,
and bit offsets every STRIDE ids let one table lookup per step serve all stretches at once.

Files: <path>/header (one row: code lengths by id) and <path>/blocks (part, block, doc_ids, sizes, checkpoints,
payload), both Parquet.

Defined cases: null text is empty and has only the end id; an empty table gives an empty file; doc_id repeated
or null: rows stand next to each other in order of a hash of their ids, nulls first; very long texts are encoded
whole, in memory bounded by the longest text and SLICE_CHARS; other columns are not read.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_dir
from .token_counts import byte_of_letter

#: Longest code, ids between bit offsets, ids after which a block ends, the id that ends a document.
MAX_BITS, STRIDE, BLOCK_IDS, END_ID = 16, 256, 262_144, 0
#: Distinct pieces of texts remembered with their ids, slots of their table, longest piece kept in it, longest
#: one remembered at all, and characters of texts encoded at once.
MOST_PIECES, SLOTS, KEY_BYTES, LONGEST_KEPT, SLICE_CHARS = 1_000_000, 1 << 21, 24, 200, 250_000
_LOADED: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


#: Texts with white space beyond ASCII, or with signs that versions of Unicode class differently, go to the library whole.
_ODD = re.compile("[\0\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]")
#: Kinds of bytes: white space and ends of texts, then letters, digits and other signs of ASCII; 0 is all else, with
#: the quote, which may open a contraction.
_WHITE, _KIND = np.zeros(256, bool), np.zeros(256, np.uint8)
_WHITE[[0, *range(9, 14), 32]] = True
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[39] = 0
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _kinds(data: np.ndarray) -> np.ndarray:
    kind = _KIND[data]
    two = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5))  # letters of two bytes up to U+017F, but for two signs
    two = two[(data[two] != 0xC3) | ((data[two + 1] != 0x97) & (data[two + 1] != 0xB7))]
    kind[two] = kind[two + 1] = 1
    return kind


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


class Pieces:
    """Encodes texts by their distinct pieces, each given to the library once while it is remembered.

    The byte-level pre-tokeniser always begins a token at the first blank after a word, at the last blank before
    a word, at a word after a blank that is not a space, and where letters, digits and other signs meet. Cut there,
    a text's ids are those of its parts; a part of one kind goes straight to the library's model. Texts with special tokens or odd white space go to the library whole. The
    others are joined by zero bytes, whose piece is the end id. Pieces of up to KEY_BYTES bytes are looked up all at once: their bytes are
    three integers, which a table of slots finds and compares whole, so no two pieces are ever taken for one."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.model = tokenizer.model.tokenize
        self.letters = {b: ord(c) for c, b in byte_of_letter().items()}
        self._clear()

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _clear(self) -> None:
        self.slots = np.full(SLOTS, -1, np.int32)
        self.keys = np.zeros((1 << 16, 3), np.uint64)
        self.begin, self.size, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self.long: dict[bytes, int] = {}
        self.n = self.used = 0
        self._enter(np.zeros((1, 3), np.uint64), self._store(np.array([END_ID], np.uint32), np.array([1])))

    def _room(self, pieces: int, ids: int) -> None:
        while self.n + pieces > len(self.begin):
            self.keys, self.begin, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.keys, self.begin, self.size))
        while self.used + ids > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new pieces with these ids."""
        self._room(len(sizes), len(ids))
        numbers = np.arange(self.n, self.n + len(sizes))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[numbers], self.size[numbers] = self.used + np.cumsum(sizes) - sizes, sizes
        self.n, self.used = self.n + len(sizes), self.used + len(ids)
        return numbers

    def _enter(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """New pieces, all different, take the first free slot from that of their hash on."""
        self.keys[numbers] = keys
        slot = self._slot(keys)
        while len(numbers):
            free = np.flatnonzero(self.slots[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self.slots[slot[taken]] = numbers[taken]
            rest = np.ones(len(numbers), bool)
            rest[taken] = False
            numbers, slot = numbers[rest], (slot[rest] + 1) % SLOTS

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        h = _mixed(keys[:, 0])
        h = _mixed(h + keys[:, 1])
        return (_mixed(h + keys[:, 2]) % np.uint64(SLOTS)).astype(np.int64)

    def _found(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of pieces by their keys; -1 where unknown."""
        out, at, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._slot(keys)
        while len(at):
            number = self.slots[slot]
            same = (self.keys[number] == keys[at]).all(1) & (number >= 0)
            out[at[same]] = number[same]
            on = ~same & (number >= 0)
            at, slot = at[on], (slot[on] + 1) % SLOTS
        return out

    def _learned(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of new pieces. One of letters, digits or signs only, with or without a space before, is one token
        of the pre-tokeniser and goes to the model; the others go through the whole library."""
        raw = b"".join(pieces)
        data, ends = np.frombuffer(raw, np.uint8), np.cumsum([len(p) for p in pieces])
        begins = np.concatenate(([0], ends[:-1]))
        kind = _kinds(data)
        led = begins[(data[begins] == 32) & (ends - begins > 1)]
        kind[led] = kind[led + 1]
        low, high = np.minimum.reduceat(kind, begins), np.maximum.reduceat(kind, begins)
        letters, model = raw.decode("latin-1").translate(self.letters), self.model
        ids, sizes = [], []
        for piece, a, b, one in zip(pieces, begins.tolist(), ends.tolist(), ((low == high) & (low > 0)).tolist()):
            own = [t.id for t in model(letters[a:b])] if one else self._encode(piece.decode())
            ids += own
            sizes.append(len(own))
        return self._store(np.array(ids, np.uint32), np.array(sizes))

    @staticmethod
    def cuts(data: np.ndarray) -> np.ndarray:
        """Where pieces begin in joined texts."""
        white = _WHITE[data]
        starts = np.zeros(len(data), bool)
        starts[:1] = True
        starts[1:] = white[1:] & ~white[:-1]
        starts[:-1] |= white[:-1] & ~white[1:]
        starts[1:] |= white[:-1] & ~white[1:] & (data[:-1] != 32)
        kind = _kinds(data)
        starts[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        ends = data == 0
        starts |= ends
        starts[1:] |= ends[:-1]
        return np.flatnonzero(starts)

    def _numbers(self, raw: bytes, begin: np.ndarray) -> np.ndarray:
        size = np.diff(np.append(begin, len(raw)))
        eight = np.lib.stride_tricks.as_strided(np.frombuffer(raw + bytes(KEY_BYTES + 8), np.uint64, 1), (len(raw) + KEY_BYTES,), (1,))
        keys = np.empty((len(begin), 3), np.uint64)
        for k in range(3):
            keys[:, k] = eight[begin + 8 * k] & _LOW_BYTES[np.clip(size - 8 * k, 0, 8)]
        short = size <= KEY_BYTES
        out = np.full(len(begin), -1, np.int64)
        out[short] = self._found(keys[short])
        new = np.flatnonzero(short & (out < 0))
        if len(new):
            distinct, first, which = np.unique(keys[new], axis=0, return_index=True, return_inverse=True)
            at = new[first]
            numbers = self._learned([raw[b : b + s] for b, s in zip(begin[at].tolist(), size[at].tolist())])
            self._enter(distinct, numbers)
            out[new] = numbers[which.reshape(-1)]
        long = [(k, raw[begin[k] : begin[k] + size[k]]) for k in np.flatnonzero(~short).tolist()]
        fresh = list({p for _, p in long if p not in self.long})
        now = self.long | dict(zip(fresh, self._learned(fresh).tolist())) if fresh else self.long
        for k, piece in long:
            out[k] = now[piece]
        self.long.update((p, now[p]) for p in fresh if len(p) <= LONGEST_KEPT)
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with the end id."""
        if self.n > MOST_PIECES:
            self._clear()
        odd = [_ODD.search(t) is not None or any(s in t for s in self.special) for t in texts]
        raw = b"".join([b"" if o else t.encode() + b"\0" for o, t in zip(odd, texts)])
        data = np.frombuffer(raw, np.uint8)
        begin = self.cuts(data)
        number = self._numbers(raw, begin) if len(raw) else np.empty(0, np.int64)
        size = self.size[number].astype(np.int64)
        last = np.cumsum(size)
        flat = self.flat[np.arange(last[-1] if len(last) else 0) + np.repeat(self.begin[number] - last + size, size)]
        stops = [0, *last[data[begin] == 0].tolist()]
        plain = zip(stops[:-1], stops[1:])
        return [np.array([*self._encode(t), END_ID], np.uint32) if o else flat[slice(*next(plain))] for o, t in zip(odd, texts)]


def _pieces(path: str) -> Pieces:
    """One memory per Python worker, kept from task to task."""
    if (key := f"pieces {path}") not in _LOADED:
        _LOADED[key] = Pieces(_tokenizer(path))
    return _LOADED[key]


def encoded(docs: DataFrame, path: str) -> tuple[DataFrame, np.ndarray]:
    """A written table (doc_id, ids) of all documents, and how often each id occurs: tasks count for themselves,
    their counts are added by id, so at most the vocabulary comes to the driver."""
    size = _tokenizer(path).get_vocab_size(True)
    kind = _kind(size)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, pieces = np.zeros(size, np.int64), _pieces(path)
        for batch in batches:
            chars = batch["text"].str.len().fillna(0).cumsum() // SLICE_CHARS
            for _, some in batch.groupby(chars):
                ids = pieces.ids([t or "" for t in some["text"]])
                total += np.bincount(np.concatenate(ids), minlength=size)
                yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64"), "ids": [x.astype(kind).tobytes() for x in ids], "counts": None})
        if total.any():
            yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "ids": [None], "counts": [total]})

    table = materialize(docs.select("doc_id", "text").mapInPandas(coded, "doc_id long, ids binary, counts array<long>"), "encoded")
    counted = table.filter(F.col("counts").isNotNull()).select(F.posexplode("counts").alias("id", "n")).filter(F.col("n") > 0)
    counts = np.zeros(size, np.int64)
    for r in counted.groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return table.filter(F.col("counts").isNull()).select("doc_id", "ids"), counts


def _kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most limit bits (package-merge); 0 for ids that do not occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    levels, packages = [], np.empty(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate((weights, packages))
        is_leaf = np.concatenate((np.ones(len(weights), bool), np.zeros(len(packages), bool)))
        by = np.argsort(merged, kind="stable")
        merged, is_leaf = merged[by], is_leaf[by]
        levels.append(is_leaf)
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take = 2 * len(used) - 2
    got = np.zeros(len(order), np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        got[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = got
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id), each one more than the one before."""
    codes = np.zeros(len(lengths), np.uint64)
    code = before = 0
    for k in np.lexsort((np.arange(len(lengths)), lengths)):
        if size := int(lengths[k]):
            code <<= size - before
            codes[k], before = code, size
            code += 1
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Payload (codes from the highest bit on) and the bit offset of every STRIDE-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    words = np.zeros(int(ends[-1]) // 32 + 2, np.uint64)
    word, used = at >> 5, (at & 31) + size
    code = codes[ids]
    high = np.where(used <= 32, code << np.maximum(32 - used, 0).astype(np.uint64), code >> np.maximum(used - 32, 0).astype(np.uint64))
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words[word[first]] = np.add.reduceat(high, first)
    over = np.flatnonzero(used > 32)
    rest = used[over] - 32
    words[word[over] + 1] += (code[over] & ((np.uint64(1) << rest.astype(np.uint64)) - np.uint64(1))) << (32 - rest).astype(np.uint64)
    return words.astype(">u4").tobytes(), at[::STRIDE].astype(np.int64)


class Decoder:
    """Looks up the next MAX_BITS bits of all stretches of a block at once."""

    def __init__(self, lengths: np.ndarray):
        codes = canonical_codes(lengths)
        self.symbol = np.zeros(1 << MAX_BITS, np.uint32)
        self.size = np.zeros(1 << MAX_BITS, np.int64)
        for k in np.flatnonzero(lengths):
            low = int(codes[k]) << (MAX_BITS - int(lengths[k]))
            high = low + (1 << (MAX_BITS - int(lengths[k])))
            self.symbol[low:high], self.size[low:high] = k, lengths[k]

    def unpack(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        data = np.frombuffer(payload, np.uint8).astype(np.int64)
        three = np.concatenate((data, np.zeros(3, np.int64)))
        window = (three[:-2] << 16) | (three[1:-1] << 8) | three[2:]
        at = np.array(checkpoints, np.int64)
        out = np.zeros((STRIDE, len(at)), np.uint32)
        top = len(window) - 1
        for step in range(min(STRIDE, n)):
            key = (window[np.minimum(at >> 3, top)] >> (8 - (at & 7))) & 0xFFFF
            out[step] = self.symbol[key]
            at += self.size[key]
        return out.T.reshape(-1)[:n]


def write(docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Write the ids of all documents in ascending doc_id order."""
    spark = docs.sparkSession
    coded, counts = encoded(docs, tokenizer_path)
    lengths, kind = code_lengths(counts), _kind(len(counts))
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(f"{path}/header")
    shared = spark.sparkContext.broadcast(lengths)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths, number = shared.value, 0
        codes = canonical_codes(lengths)
        names, parts, size = [], [], 0

        def block() -> pd.DataFrame:
            payload, marks = pack(np.concatenate(parts), codes, lengths)
            return pd.DataFrame([{"part": part, "block": number, "doc_ids": names, "sizes": [len(p) for p in parts], "checkpoints": marks, "payload": payload}])

        for batch in batches:
            part = int(batch["part"].iloc[0]) if len(batch) else 0
            for doc, ids in zip(batch["doc_id"], [np.frombuffer(x, kind) for x in batch["ids"]]):
                names.append(None if pd.isna(doc) else int(doc))
                parts.append(ids)
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield block()
                    names, parts, size, number = [], [], 0, number + 1
        if parts:
            yield block()

    # the ids themselves stay out of the range key, whose sample goes to the driver
    ordered = coded.withColumn("_h", F.xxhash64("ids")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "ids")
    ordered = ordered.select("doc_id", "ids", F.spark_partition_id().alias("part"))
    ordered.mapInPandas(blocks, "part int, block int, doc_ids array<long>, sizes array<int>, checkpoints array<long>, payload binary").write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document: start counts the ids before it, ids are little-endian uint32."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/header").first()["lengths"], np.uint8)
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.parquet(f"{path}/blocks")
    n_ids = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    # one row per file part, then blocks within their part
    parts = blocks.groupBy("part").agg(F.sum(n_ids).alias("n"))
    parts = parts.selectExpr("part", "coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    inner = blocks.select("part", "block", n_ids.alias("n")).selectExpr("part", "block", "coalesce(sum(n) OVER (PARTITION BY part ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inner")
    starts = inner.join(parts, "part").select("part", "block", (F.col("before") + F.col("inner")).alias("start"))
    rows = blocks.join(F.broadcast(starts) if starts.limit(100_001).count() <= 100_000 else starts, ["part", "block"])

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for docs, sizes, marks, payload, start in zip(batch["doc_ids"], batch["sizes"], batch["checkpoints"], batch["payload"], batch["start"]):
                sizes = np.array(sizes, np.int64)
                ids = decoder.unpack(payload, marks, int(sizes.sum())).astype("<u4")
                ends = np.cumsum(sizes)
                yield pd.DataFrame({
                    "doc_id": pd.array([None if pd.isna(d) else int(d) for d in docs], "Int64"), "start": start + ends - sizes,
                    "ids": [ids[e - s : e].tobytes() for s, e in zip(sizes, ends)],
                })

    return rows.select("doc_ids", "sizes", "checkpoints", "payload", "start").mapInPandas(decoded, "doc_id long, start long, ids binary")


def write_and_read(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document, read back from files in the shared folder: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = f"{scratch_dir(spark)}/huffman-{uuid.uuid4().hex}"
    write(docs, tokenizer_path, path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    back = read(spark, path)
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
