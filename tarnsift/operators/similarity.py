"""Exact cosine retrieval of unit vectors, block against block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one block of queries and of chunks; blocks of queries up to which they are broadcast.
QUERY_BLOCK, CHUNK_BLOCK, BROADCAST_BLOCKS = 1024, 4096, 8
#: Queries of a block that are scored at a time.
SCORED_ROWS = 256
_RESULT = "query_id long, chunk_id long, score double, query_label int, chunk_label int"


def ranked(rows: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """Rank from 1 by descending score, ties by ascending tie column."""
    window = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return rows.withColumn("rank", F.row_number().over(window).cast("long"))


def _blocks(rows: DataFrame, id_: str, vector: str, label: str, most: int, masked: bool) -> tuple[DataFrame, int]:
    """One row per block of about most rows, dealt by a hash of the id: ids, labels and vectors as one array each. masked:
    blocks of one label each, with it as mask."""
    n = rows.count()
    count = max(1, -(-n // most))
    block = F.pmod(F.xxhash64(id_), F.lit(count)).alias("block")
    packed = rows.select(block, F.col(id_).cast("long").alias("id"), F.col(label).cast("int").alias("label"), F.col(vector).alias("v"))
    if masked:
        packed = packed.filter("label IS NOT NULL").withColumn("mask", F.col("label"))
    by = ["mask", "block"] if masked else ["block"]
    return packed.groupBy(*by).agg(F.collect_list(F.struct("id", "label", "v")).alias("rows")).drop("block"), count


def _matrix(rows: pa.StructArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """ids, labels and vectors of a block, taken from Arrow's own buffers; no Python object for a row."""
    ids, lists = rows.field("id").to_numpy(zero_copy_only=False), rows.field("v")
    sizes = pc.list_value_length(lists).fill_null(-1).to_numpy(zero_copy_only=False)
    size = max(int(sizes.max(initial=0)), 0)
    vectors = np.full((len(rows), size), np.nan)
    fits = sizes == size
    vectors[fits] = pc.list_flatten(lists.filter(pa.array(fits))).to_numpy(zero_copy_only=False).reshape(int(fits.sum()), size)
    return ids, rows.field("label"), vectors


def _best(ids: np.ndarray, vectors: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector asked, the places of its k best and their scores, -inf where there is none; ids ascend."""
    scores = np.round(asked @ vectors.T, 6)
    scores[np.isnan(scores)] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return best, np.take_along_axis(scores, best, 1)


def top_cosine(queries: DataFrame, chunks: DataFrame, k: int, masked: bool = False) -> DataFrame:
    """The k best chunks (chunk_id, vector, chunk_label) of every query (query_id, query_vector, query_label), with
    rank; masked: only chunks of the query's label, a mask that goes before any score: blocks are of one label then,
    and meet those of the same one.

    Blocks of queries meet blocks of chunks; each pair of blocks is one matrix product that leaves the k best of the
    block for every query, so what is shuffled is queries x k for each block of chunks. Vectors of other lengths than their
    block's, or null, have no score."""
    left, count = _blocks(queries, "query_id", "query_vector", "query_label", QUERY_BLOCK, masked)
    right, _ = _blocks(chunks, "chunk_id", "vector", "chunk_label", CHUNK_BLOCK, masked)
    left = left.withColumnRenamed("rows", "asked")
    left = F.broadcast(left) if count <= BROADCAST_BLOCKS else left
    pairs = right.join(left, "mask") if masked else right.crossJoin(left)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                ids, labels, vectors = _matrix(batch.column("rows")[n].values)
                q_ids, q_labels, q_vectors = _matrix(batch.column("asked")[n].values)
                if vectors.shape[1] != q_vectors.shape[1]:
                    continue
                order = np.argsort(ids, kind="stable")
                ids, labels, vectors = ids[order], labels.take(pa.array(order)), vectors[order]
                for at in range(0, len(q_ids), SCORED_ROWS):
                    part = slice(at, at + SCORED_ROWS)
                    best, top = _best(ids, vectors, q_vectors[part], k)
                    keep = top > -np.inf
                    line = np.repeat(np.arange(len(top)), keep.sum(1))
                    columns = (pa.array(q_ids[part][line]), pa.array(ids[best[keep]]), pa.array(top[keep]), q_labels.take(pa.array(at + line)), labels.take(pa.array(best[keep])))
                    yield pa.RecordBatch.from_arrays(list(columns), ["query_id", "chunk_id", "score", "query_label", "chunk_label"])

    # Arrow bounds a batch by its bytes; what is made of it here is one pair of blocks, SCORED_ROWS of its queries at a time
    found = pairs.select("rows", "asked").mapInArrow(products, _RESULT)
    return ranked(found, ["query_id"], "score", "chunk_id").filter(F.col("rank") <= k)
