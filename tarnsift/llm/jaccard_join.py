"""N-gram Jaccard join: connected classes of documents whose sets of word 5-grams are alike.

Exact prefix-filter join with set-relation skipping.

1. Sets that are equal collapse to one by a 128-bit signature and their size.
2. A fixed-size sketch of how often 5-grams occur, counted over all documents, orders every set from rare to
   common (any one order for all sets keeps the join exact). The index holds each set's prefix.
3. Index lists are skipped by position: a pair of entries counts only if both sets still have enough elements
   from there on; in long lists whole blocks of one size and position range are compared before any entry is.
4. Long lists first compare every set with one leader. Then answers are derived: sets in one component need
   no further comparison, and for two sets with a common leader the differences from the leader bound their
   own (Jaccard distance is a metric). What is left is compared pair by pair.
5. Before whole sets are carried together, a profile (counts of a set's elements by hash range, a byte per two
   to four elements) bounds every pair's intersection from above; pairs that the bound decides need no sets.
6. Links make components by minimum labels with pointer jumping, on written tables.

Defined cases: null or blank texts have an empty set and a component of their own; with under five words the
whole sequence is the one element; rows without doc_id take no part and get a null component; rows repeated
get the same answer each; rows of one doc_id with different texts report their own size, and link by the greatest of
these texts; an empty table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, releasing, small_side

N, PART, WHOLE = 5, 80, 100
#: Counters of the sketch; lists longer than LONG_LIST go by way of leaders; positions of one block.
SKETCH_BITS, LONG_LIST, BLOCK = 20, 8, 4
BLOCK_CHARS = 500_000

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_COEFFICIENTS = np.array([pow(0xD6E8FEB86659FD93, 2 * k + 1, 2**64) for k in range(N)], np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted set of 5-gram hashes (uint64) of every text of a block."""
    raw = [t.encode() for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    edges = np.cumsum([0] + [len(r) + 1 for r in raw])
    blank = _BLANK[data]
    before = np.concatenate(([True], blank[:-1]))
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    power = np.cumprod(np.full(len(data), _P))
    summed = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)))
    inverse = np.cumprod(np.full(len(data), _P_INVERSE))
    word = _mixed((summed[ends] - summed[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, edges)  # words before each text
    total = np.zeros(max(0, len(word) - N + 1), np.uint64)
    for k in range(N if len(total) else 0):
        total += word[k : k + len(total)] * _COEFFICIENTS[k]
    grams = _mixed(total + np.uint64(N))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= N:
            out.append(np.unique(grams[a : b - N + 1]))
        elif b > a:
            out.append(_mixed(np.array([(word[a:b] * _COEFFICIENTS[: b - a]).sum(dtype=np.uint64)], np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """doc_ids and sets, a bounded number of characters at a time."""
    for batch in batches:
        texts = [t or "" for t in batch["text"]]
        ids = batch["doc_id"].to_numpy()
        begin = chars = 0
        for k, t in enumerate(texts):
            chars += len(t)
            if chars >= BLOCK_CHARS or k == len(texts) - 1:
                yield ids[begin : k + 1], shingle_sets(texts[begin : k + 1])
                begin, chars = k + 1, 0


def profile(s: np.ndarray) -> bytes:
    """Elements by hash range, up to 255 each, in a power of two of ranges."""
    bits = max(6, (len(s) // 4).bit_length())
    return np.minimum(255, np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)).astype(np.uint8).tobytes()


def apart_at_least(x: bytes, y: bytes) -> int:
    """Lower bound of the symmetric difference of two sets, from their profiles."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    m = min(len(a), len(b))
    return int(np.abs(a.reshape(m, -1).sum(1) - b.reshape(m, -1).sum(1)).sum())


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per document its set's size, signature and profile; at the end of a task one row with the task's sketch."""
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    for ids, sets in _blocks(batches):
        every = np.concatenate(sets)
        sketch += np.bincount((every >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)).astype(np.uint32)
        sizes = np.array([len(s) for s in sets])
        edges = np.concatenate(([0], np.cumsum(sizes)))
        signatures = []
        for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(every ^ np.uint64(salt)))))
            signatures.append((sums[edges[1:]] - sums[edges[:-1]]).view(np.int64))
        yield pd.DataFrame({"doc_id": ids, "n": sizes.astype(np.int64), "s1": signatures[0], "s2": signatures[1], "profile": [profile(s) for s in sets], "sketch": None})
    yield pd.DataFrame({"doc_id": [0], "n": [-1], "s1": [0], "s2": [0], "profile": [None], "sketch": [zlib.compress(sketch.tobytes(), 1)]})


def _levels(described: DataFrame) -> np.ndarray:
    """Quarter-powers of two of the sketch's counts: a fixed number of bytes, whatever the corpus. Sketches are added up in
    tasks, by way of about the square root of as many partial sums; the driver gets one packed array of bytes."""
    read = lambda r: np.frombuffer(zlib.decompress(r["sketch"]), np.uint32).astype(np.uint64)
    add = lambda a, b: a + b
    pack = lambda counts: zlib.compress(np.minimum(255, np.log2(counts + 1.0) * 4).astype(np.uint8).tobytes(), 1)
    rows = described.filter(F.col("n") < 0).select("sketch").rdd
    parts = max(1, math.isqrt(rows.getNumPartitions()))
    partial = rows.mapPartitionsWithIndex(lambda i, part: ((i % parts, read(r)) for r in part)).reduceByKey(add, parts)
    found = partial.map(lambda x: (0, x[1])).reduceByKey(add, 1).map(lambda x: pack(x[1])).collect()
    return np.frombuffer(zlib.decompress(found[0]), np.uint8) if found else np.zeros(1 << SKETCH_BITS, np.uint8)


def _entries(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """The index: (token, id, n, pos) for each set's prefix, rare tokens first."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, sets in _blocks(batches):
            tokens, lengths, positions = [], [], []
            for s in sets:
                length = len(s) - (PART * len(s) + WHOLE - 1) // WHOLE + 1 if len(s) else 0
                if length:
                    order = np.argsort(shared.value[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[:length]
                    tokens.append(s[order])
                    positions.append(np.arange(length, dtype=np.int32))
                lengths.append(length)
            if tokens:
                sizes = np.array([len(s) for s in sets], np.int32)
                yield pd.DataFrame({
                    "token": np.concatenate(tokens).view(np.int64), "id": np.repeat(ids, lengths),
                    "n": np.repeat(sizes, lengths), "pos": np.concatenate(positions),
                })

    return docs.mapInPandas(prefixes, "token long, id long, n int, pos int")


def _needed(n1, n2):
    """Least intersection of linked sets of these sizes: the same integer arithmetic for numpy and columns."""
    return (PART * (n1 + n2) + PART + WHOLE - 1) // (PART + WHOLE)


def _size_class(n: np.ndarray) -> np.ndarray:
    return (np.log(n) * 4).astype(np.int64)


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries sorted by token and id become pairs (a, b) from short lists; entries of long lists come back
    as (a, b: leader, token, n, pos). The leader is the least id of the list and size class, so that the lists
    of one group of similar sets choose the same one; the class leaders themselves follow the list's first.
    Memory is bounded by LONG_LIST entries, a leader per size class and a batch."""
    names = ["token", "id", "n", "pos"]
    held, long_token, leaders = None, None, {}  # entries of the unfinished list; the long list's leaders

    def short(token, ids, n, pos):
        order = np.lexsort((ids, n, token))
        token, ids, n, pos = token[order], ids[order], n[order].astype(np.int64), pos[order]
        out = []
        for step in range(1, LONG_LIST):
            i = np.flatnonzero(token[:-step] == token[step:]) if step < len(token) else np.empty(0, int)
            if not len(i):
                break
            need = _needed(n[i], n[i + step])
            good = (n[i] - pos[i] >= need) & (n[i + step] - pos[i + step] >= need) & (ids[i] != ids[i + step])
            i = i[good]
            out.append((np.maximum(ids[i], ids[i + step]), np.minimum(ids[i], ids[i + step])))
        if out:
            pairs = pd.DataFrame({"a": np.concatenate([x[0] for x in out]), "b": np.concatenate([x[1] for x in out])}).drop_duplicates()
            if len(pairs):
                yield pairs.assign(token=None, n=None, pos=None)

    def long(token, ids, n, pos):
        nonlocal long_token, leaders
        if long_token != token[0]:
            long_token, leaders = token[0], {}
        group = _size_class(n)
        classes, first = np.unique(group, return_index=True)
        for c, at in sorted(zip(classes.tolist(), first.tolist()), key=lambda x: x[1]):
            if c not in leaders:
                top = next(iter(leaders.values()), ids[at])
                leaders[c] = ids[at]
                if top != ids[at]:
                    yield pd.DataFrame({"a": [ids[at]], "b": [top], "token": None, "n": None, "pos": None})
        led = np.array([leaders[c] for c in classes.tolist()])[np.searchsorted(classes, group)]
        yield pd.DataFrame({"a": ids, "b": led, "token": token, "n": n, "pos": pos})

    def lists(token, ids, n, pos, final):
        """Finished lists are answered; the last one may go on and is held."""
        nonlocal held
        cut = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
        begin, size = cut[:-1], np.diff(cut)
        open_ = np.zeros(len(begin), bool)
        open_[-1] = not final
        long_ = size > LONG_LIST
        long_[0] |= long_token is not None and long_token == token[0]
        keep = np.repeat(~long_ & ~open_ & (size > 1), size)
        yield from short(token[keep], ids[keep], n[keep], pos[keep])
        for k in np.flatnonzero(long_):
            at = slice(begin[k], begin[k] + size[k])
            yield from long(token[at], ids[at], n[at], pos[at])
        held = None if final or long_[-1] else [x[begin[-1] :] for x in (token, ids, n, pos)]

    for batch in batches:
        columns = [batch[c].to_numpy() for c in names]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        if len(columns[0]):
            yield from lists(*columns, final=False)
    if held is not None:
        yield from lists(*held, final=True)


_OUT = "a long, b long, token long, n int, pos int"


def _verified(docs: DataFrame, described: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, linked, d0, d1) of pairs: whether they link, and bounds of their distance.

    Profiles come together first; whole sets only where the profiles leave a link possible."""

    @F.pandas_udf("long")
    def least(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([apart_at_least(x, y) for x, y in zip(a, b)], dtype="int64")

    # one of equal rows: a document repeated has the same profile each time
    about = described.filter(F.col("n") > 0).select("doc_id", "n", "profile")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    about = about.join(small_side(materialize(ids, "jaccard-ids")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    side = lambda k: about.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("profile").alias(f"p{k}"))
    bound = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", least("pa", "pb").alias("apart"))
    bound = materialize(bound, "jaccard-bounded")
    most = F.floor((F.col("na") + F.col("nb") - F.col("apart")) / 2)
    open_ = _linked(most)
    shut = bound.filter(~open_).select("a", "b", F.lit(False).alias("linked"), _distance(most).alias("d0"), F.lit(1.0).alias("d1"))
    exact = _intersected(docs, bound.filter(open_).select("a", "b"))
    distance = _distance(F.col("both"))
    exact = exact.select("a", "b", _linked(F.col("both")).alias("linked"), distance.alias("d0"), distance.alias("d1"))
    return materialize(shut.union(exact), "jaccard-verified")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, s): the sets of the wanted documents, sorted, as bytes."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, sets in _blocks(batches):
            yield pd.DataFrame({"doc_id": ids, "s": [x.tobytes() for x in sets]})

    return docs.join(wanted, "doc_id", "left_semi").mapInPandas(packed, "doc_id long, s binary").dropDuplicates(["doc_id"])


def _intersected(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, both, na, nb) of pairs: sets are carried from the b side, which repeats, to the a side."""
    side = lambda c, is_b: pairs.select(F.col(c).alias("doc_id"), F.lit(not is_b).alias("as_a"), F.lit(is_b).alias("as_b"))
    ids = side("a", False).union(side("b", True)).groupBy("doc_id").agg(F.max("as_a").alias("as_a"), F.max("as_b").alias("as_b"))
    wanted = small_side(materialize(ids, "jaccard-ids"))

    sets = materialize(_sets(docs, wanted).join(wanted, "doc_id"), "jaccard-sets")

    @F.pandas_udf("long")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        read = lambda x: np.frombuffer(x, np.uint64)
        return pd.Series([len(np.intersect1d(read(x), read(y), assume_unique=True)) for x, y in zip(a, b)], dtype="int64")

    right = sets.filter("as_b").select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    left = sets.filter("as_a").select(F.col("doc_id").alias("a"), F.col("s").alias("sa"))
    rows = pairs.join(right, "b").join(left, "a")
    size = lambda c: F.length(c).cast("long") / 8
    rows = rows.select("a", "b", common("sa", "sb").alias("both"), size("sa").cast("long").alias("na"), size("sb").cast("long").alias("nb"))
    return rows.dropDuplicates(["a", "b"])


def _linked(both: Column) -> Column:
    return WHOLE * both >= PART * (F.col("na") + F.col("nb") - both)


def _distance(both: Column) -> Column:
    return 1 - both / (F.col("na") + F.col("nb") - both)


def components(links: DataFrame) -> DataFrame:
    """(id, label): the least id of the component, for every id that a link (a, b) names."""
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("least"))
        moved = labels.join(near, "id").select("id", F.least("label", "least").alias("label"), F.col("label").alias("was"))
        moved = materialize(moved, "labels")
        onto = moved.select(F.col("id").alias("label"), F.col("label").alias("next"))
        now = materialize(moved.join(onto, "label", "left").select("id", F.least("label", "next").alias("label"), "was"), "labels")
        if now.filter(F.col("label") < F.col("was")).isEmpty():
            return now.select("id", "label")
        labels = now.select("id", "label")


def _left_over(hot: DataFrame, verified: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of long lists that neither components nor a common leader decide."""
    known = verified.select("a", "b", "d0", "d1")
    known = known.union(known.select("b", "a", "d0", "d1")).distinct()
    rows = hot.select(F.col("a").alias("id"), F.col("b").alias("leader"), "token", "n", "pos")
    rows = rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    split = rows.groupBy("token").agg(F.min("label").alias("l"), F.max("label").alias("m")).filter(F.col("l") < F.col("m")).select("token")
    rows = rows.join(split, "token").join(known.select(F.col("a").alias("id"), F.col("b").alias("leader"), "d0", "d1"), ["id", "leader"], "left")
    rows = rows.withColumns({d: F.when(F.col("id") == F.col("leader"), 0.0).otherwise(F.coalesce(d, F.lit(unknown))) for d, unknown in (("d0", 0.0), ("d1", 1.0))})
    rows = rows.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("int"))
    rows = materialize(rows, "jaccard-open")
    blocks = rows.groupBy("token", "leader", "n", "block").agg(F.min("pos").alias("pos"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("d0").alias("d0"), F.max("d1").alias("d1"))
    x, y = (blocks.select("token", *[F.col(c).alias(f"{c}{k}") for c in ("leader", "n", "block", "pos", "l0", "l1", "d0", "d1")]) for k in "xy")
    need = F.floor((PART * (F.col("nx") + F.col("ny")) + PART + WHOLE - 1) / (PART + WHOLE))
    far = 1 - PART / WHOLE + 1e-9
    led = F.col("leaderx") == F.col("leadery")
    apart = led & ((F.col("d0x") - F.col("d1y") > far) | (F.col("d0y") - F.col("d1x") > far))
    one = (F.col("l0x") == F.col("l1x")) & (F.col("l0x") == F.col("l0y")) & (F.col("l0y") == F.col("l1y"))
    fits = (F.col("nx") <= F.col("ny")) & (PART * F.col("ny") <= WHOLE * F.col("nx"))
    met = x.join(y, "token").filter(fits & (F.col("nx") - F.col("posx") >= need) & (F.col("ny") - F.col("posy") >= need) & ~apart & ~one)
    met = met.select("token", "leaderx", "nx", "blockx", "leadery", "ny", "blocky")
    x, y = (rows.select("token", *[F.col(c).alias(f"{c}{k}") for c in ("leader", "n", "block", "id", "label", "d0", "d1", "pos")]) for k in "xy")
    pairs = met.join(x, ["token", "leaderx", "nx", "blockx"]).join(y, ["token", "leadery", "ny", "blocky"])
    pairs = pairs.filter((F.col("labelx") != F.col("labely")) & (F.col("nx") - F.col("posx") >= need) & (F.col("ny") - F.col("posy") >= need) & ~apart)
    pairs = pairs.select(F.greatest("idx", "idy").alias("a"), F.least("idx", "idy").alias("b")).distinct()
    return materialize(pairs.join(known.select("a", "b"), ["a", "b"], "left_anti"), "jaccard-left")


def classes(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id."""
    with releasing(docs.sparkSession):
        return materialize(_classes(docs), "jaccard-classes", keep=True)


def _classes(docs: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    described = materialize(texts.mapInPandas(_described, "doc_id long, n long, s1 long, s2 long, profile binary, sketch binary"), "jaccard-described")
    sets = described.filter(F.col("n") >= 0).drop("sketch", "profile")
    by = ["n", "s1", "s2"]
    nowhere = docs.filter(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    many = sets.groupBy("doc_id").agg(F.count("*").alias("k"), F.min(F.struct(*by)).alias("low"), F.max(F.struct(*by)).alias("high")).filter("k > 1 AND low <> high").select("doc_id")
    many = materialize(many, "jaccard-many")
    if not many.isEmpty():
        several = texts.join(small_side(many), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
        linked = classes(texts.join(small_side(many), "doc_id", "left_anti").union(several)).select("doc_id", "component_id").distinct()
        return sets.join(linked, "doc_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(nowhere)
    same = sets.filter(F.col("n") > 0).groupBy(by).agg(F.min("doc_id").alias("first"), F.count("*").alias("k")).filter(F.col("k") > 1).drop("k")
    copies = materialize(sets.join(same, by).select("doc_id", "first").distinct(), "jaccard-copies")
    spare = small_side(copies.filter(F.col("doc_id") != F.col("first")).select("doc_id"))
    single = texts.join(spare, "doc_id", "left_anti")
    entries = _entries(single, _levels(described))
    found = entries.repartition("token").sortWithinPartitions("token", "id").mapInPandas(_probe, _OUT)
    found = materialize(found, "jaccard-found")
    hot = found.filter(F.col("token").isNotNull())
    pairs = materialize(found.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "jaccard-pairs")
    verified = _verified(single, described, pairs)
    links = verified.filter("linked")
    labels = components(links)
    rest = _left_over(hot, verified, labels)
    if not rest.isEmpty():
        links = links.union(_verified(single, described, rest).filter("linked"))
        labels = components(links)
    labels = labels.select(F.col("id").alias("first"), "label")
    out = sets.join(copies.withColumnRenamed("doc_id", "copy"), F.col("doc_id") == F.col("copy"), "left")
    out = out.withColumn("first", F.coalesce("first", "doc_id")).join(labels, "first", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "first").alias("component_id"))
    return out.union(nowhere)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns untouched, that come first in their component."""
    with releasing(docs.sparkSession):
        gone = materialize(classes(docs).filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "jaccard-gone", keep=True)
    return docs.join(small_side(gone), "doc_id", "left_anti").select(docs.columns)
