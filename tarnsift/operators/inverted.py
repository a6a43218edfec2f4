"""Keyword retrieval over an inverted index that is built once and searched by any number of queries.

The index is two tables in a folder, or three. postings holds, for each distinct word of each field, lists of the documents that have it; documents
are dealt by a hash of their id into blocks of about as many letters each, and lists into ranges of (word, block), so that no common word makes one
list or one range large; a folder for each range. terms holds each distinct word with the ranges that its postings lie in. documents holds the order
of documents, if one is given. A search looks the distinct words of all its queries up among the beginnings of terms (one equality join: a term has at
most PREFIX of them, longer query words are compared in full after that), reads only the ranges of the terms found, and brings the lists of a block
and the words of all queries into one task. It adds up, a query at a time, the weight of each field that a query word was found in, and gives
the first documents of the block for each query; only these are shuffled, never the pairs of queries and documents. No text is read again, however
many words are searched.

Defined cases: null text has no words; a query without words finds nothing; words shorter than three letters and stop
words are passed over where the tokenizer says so; a word that stands twice in a query counts twice unless the search
is over distinct words; equal scores keep the order of the documents' order column, then of their ids. Documents with one
id are one document; those without an id are not searched. Weights are above zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tarnsift.session import scratch_dir

#: Words that keyword search leaves out.
STOP_WORDS = (
    "the", "and", "for", "with", "how", "does", "can", "that", "this", "from", "are", "was", "were", "has", "have", "not", "but", "you",
    "your", "when", "what", "who", "why", "his", "her", "its", "they", "them", "their", "any", "all", "did", "yes", "get", "one",
)
#: Letters of a term that its beginnings are listed up to; terms of a search that are broadcast once counted.
PREFIX, BROADCAST_TERMS = 24, 200_000
#: Of one task, about: letters of the documents of a block, distinct words of queries, pairs of a query's word and a document that are added up, rows that are ranked.
LETTERS, QUERY_WORDS, PAIRS, RANKED = 32_000_000, 2_000_000, 4_000_000_000, 500_000
#: Rows that a task gives out at a time.
OUT_ROWS = 50_000
LEAST_LETTERS = 3


def search_words(text: Column) -> Column:
    """Lower-case words of Latin letters, digits and apostrophes, of three letters and more, but for stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9']+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) >= LEAST_LETTERS) & ~w.isin(*STOP_WORDS))


def any_words(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores of any script, of three letters and more."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(found, lambda w: F.length(w) >= LEAST_LETTERS)


@dataclass(frozen=True)
class Index:
    """A written index: where it is, how texts are cut into words, the weight of each field, the blocks of documents, whether they have an order of their own."""

    spark: SparkSession
    path: str
    words: Callable[[Column], Column]
    weights: dict[str, int]
    blocks: int
    ordered: bool

    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def documents(self) -> DataFrame:
        """doc_id, place; of an index whose documents have an order."""
        return self.spark.read.parquet(f"{self.path}/documents")


def _block(doc_id: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(blocks)).cast("int")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by term, block, field: the documents of each run of equal ones as a list. A run that goes on in the next batch gives two."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column("term").dictionary_encode().indices.to_numpy(), batch.column("block").to_numpy(), batch.column("field").to_numpy()])
        starts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1])
        docs = pa.ListArray.from_arrays(pa.array(np.append(starts, batch.num_rows), pa.int32()), batch.column("doc_id"))
        first = pa.array(starts)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(first) for c in ("term", "block", "field")), docs, batch.column("range").take(first)], ["term", "block", "field", "docs", "range"])


def build(docs: DataFrame, path: str, weights: dict[str, int], words: Callable[[Column], Column] = search_words, order: Column | None = None, ranges: int | None = None) -> Index:
    """Write the index of docs (doc_id, a text column for each field of weights) to path. order: the order of documents
    of equal score, ascending; by default their ids. ranges: of postings; by default as many as shuffle partitions."""
    spark = docs.sparkSession
    docs = docs.filter("doc_id IS NOT NULL")
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    letters = docs.agg(F.sum(sum(F.coalesce(F.length(f), F.lit(0)) for f in weights))).first()[0] or 0  # one row
    index = Index(spark, path, words, weights, max(-(-letters // LETTERS), spark.sparkContext.defaultParallelism), order is not None)
    fields = F.array(*[F.struct(F.lit(i).alias("field"), F.array_distinct(words(F.col(f))).alias("found")) for i, f in enumerate(weights)])
    rows = docs.select("doc_id", F.explode(fields).alias("f")).select("doc_id", _block("doc_id", index.blocks).alias("block"), "f.field", F.explode("f.found").alias("term"))
    dealt = rows.repartitionByRange(ranges, "term", "block").withColumn("range", F.spark_partition_id()).sortWithinPartitions("term", "block", "field", "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt.select("term", "block", "field", "doc_id", "range").mapInArrow(_listed, f"term string, block int, field int, docs array<{kind}>, range int").write.partitionBy("range").parquet(f"{path}/postings")
    if order is not None:
        docs.groupBy("doc_id").agg(F.min(order).alias("place")).write.parquet(f"{path}/documents")
    of_range = index.postings().groupBy("term", "range").agg(F.sum(F.size("docs")).alias("n"))
    terms = of_range.groupBy("term").agg(F.sum("n").alias("postings"), F.array_sort(F.collect_list("range")).alias("ranges"))  # no more than there are ranges
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    return index


def query_words(queries: DataFrame, words: Callable[[Column], Column], distinct: bool = False) -> DataFrame:
    """query_id, word, n (how often it stands there) of queries (query_id, text)."""
    found = words(F.col("text"))
    return queries.select("query_id", F.explode(F.array_distinct(found) if distinct else found).alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("n"))


def matched_terms(index: Index, wanted: DataFrame) -> DataFrame:
    """word, term, ranges, postings: the terms that begin with each of the words wanted."""
    beginnings = F.transform(F.sequence(F.lit(LEAST_LETTERS), F.least(F.length("term"), F.lit(PREFIX))), lambda n: F.substring(F.col("term"), F.lit(1), n))
    terms = index.terms().select("term", "ranges", "postings", F.explode(beginnings).alias("head"))
    heads = wanted.select("word", F.substring("word", 1, PREFIX).alias("head")).distinct()
    # terms have a row for each of their letters here, many times what their files suggest: never through the driver
    return terms.hint("merge").join(heads.hint("merge"), "head").filter((F.length("word") <= PREFIX) | F.expr("startswith(term, word)")).select("word", "term", "ranges", "postings")


def search(index: Index, queries: DataFrame, limit: int | None = None, distinct: bool = False, newest: bool = False) -> DataFrame:
    """query_id, doc_id, score, place (from 1) of the documents found for queries (query_id, text), limit a query at most.

    The score of a document adds, over the words of the query, the weights of the fields that have a word beginning
    with it. newest: equal scores by descending order instead of ascending."""
    wanted = query_words(queries, index.words, distinct)
    matched_terms(index, wanted).write.parquet(held := f"{scratch_dir(index.spark)}/matched")
    terms = index.spark.read.parquet(held)
    ranges = [r["r"] for r in terms.select(F.explode("ranges").alias("r")).distinct().collect()]  # no more than there are ranges
    postings = index.postings().filter(F.col("range").isin(ranges))
    pairs = terms.select("word", "term")
    if pairs.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        pairs = F.broadcast(pairs)
    lists = postings.join(pairs, "term").select("block", "word", "field", "docs")
    most = terms.groupBy("word").agg(F.sum("postings").alias("hits"))
    counts = F.count("*"), F.count_distinct("query_id"), F.coalesce(F.sum("hits"), F.lit(0))
    asked, n_queries, added = wanted.join(most, "word", "left").agg(*counts).first()  # one row
    parts = max(1, -(-asked // QUERY_WORDS), -(-added // (PAIRS * index.blocks)))
    found = _scores(index, lists, wanted, parts, limit, newest)
    given_out = added if limit is None else min(added, n_queries * limit * index.blocks)
    tasks = max(1, -(-added // PAIRS), -(-given_out // RANKED))
    place = [F.col("place").desc_nulls_last() if newest else F.col("place").asc_nulls_first()] if index.ordered else []
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), *place, F.col("doc_id").desc() if newest else F.col("doc_id")))
    ranked = found.repartition(tasks, "query_id").withColumn("rank", rank)
    return (ranked if limit is None else ranked.filter(F.col("rank") <= limit)).select("query_id", "doc_id", "score", F.col("rank").alias("place"))


def _scores(index: Index, lists: DataFrame, wanted: DataFrame, parts: int, limit: int | None, newest: bool) -> DataFrame:
    """query_id, doc_id, score, place (if documents have an order) of the first limit documents of each block for each query. A task gets
    one block and one of parts of the queries: block, word, field, docs of lists, and words and counts of each query of wanted."""
    blocks = index.blocks
    every = lambda n, by: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(by)
    task = (F.col("block") * parts + F.col("part")).alias("task")
    by_query = wanted.groupBy("query_id").agg(F.collect_list(F.struct("word", "n")).alias("w"))
    by_query = by_query.select("query_id", F.col("w.word").alias("words"), F.col("w.n").alias("counts"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"))
    none = {c: F.array().cast(by_query.schema[c].dataType) for c in ("words", "counts")}  # not null: Arrow's writer goes through all rows before a null list
    rows = lists.select("*", every(parts, "part")).select(task, "word", "field", "docs").withColumns(none)
    no_docs = F.array().cast(lists.schema["docs"].dataType).alias("docs")
    rows = rows.unionByName(by_query.select("*", every(blocks, "block")).select(task, "query_id", no_docs, "words", "counts"), allowMissingColumns=True)
    out = [wanted.schema["query_id"], StructField("doc_id", lists.schema["docs"].dataType.elementType), StructType.fromDDL("score long")["score"]]
    if index.ordered:
        places = index.documents().select(_block("doc_id", blocks).alias("block"), F.array("doc_id").alias("docs"), "place", every(parts, "part"))
        rows = rows.unionByName(places.select(task, "docs", "place", F.lit(True).alias("placed")).withColumns(none), allowMissingColumns=True)
        out.append(places.schema["place"])
    dealt = rows.repartitionById(blocks * parts, "task").drop("task")
    return dealt.mapInArrow(_best_of_block(list(index.weights.values()), limit, newest, index.ordered), StructType(out))


def _best_of_block(weights: list[int], limit: int | None, newest: bool, ordered: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, asked, places = [], [], []
        for batch in batches:
            lists.append(batch.filter(pc.is_valid(batch.column("word"))).select(["word", "field", "docs"]))
            asked.append(batch.filter(pc.greater(pc.list_value_length(batch.column("words")), 0)).select(["query_id", "words", "counts"]))
            if ordered:
                places.append(batch.filter(pc.is_valid(batch.column("placed"))).select(["docs", "place"]))
        if not sum(x.num_rows for x in lists) or not sum(x.num_rows for x in asked):
            return
        vocabulary, starts, docs, weight, ids, place = _block_index(pa.Table.from_batches(lists), pa.Table.from_batches(places) if ordered else None, weights, newest)
        del lists, places
        scores, held, n = np.zeros(len(ids), np.int64), [], 0
        for batch in asked:
            words, counts = batch.column("words"), batch.column("counts").flatten().to_numpy()
            codes, edges = pc.index_in(words.flatten(), value_set=vocabulary).fill_null(-1).to_numpy(), np.append(0, np.cumsum(pc.list_value_length(words).to_numpy()))
            for q in range(batch.num_rows):
                scores[:] = 0
                for code, count in zip(codes[edges[q] : edges[q + 1]].tolist(), counts[edges[q] : edges[q + 1]].tolist()):
                    if code >= 0:
                        of_word = slice(starts[code], starts[code + 1])
                        scores[docs[of_word]] += weight[of_word] * count
                hit = np.flatnonzero(scores)
                if limit is not None and len(hit) > limit:  # documents are numbered in their order: of the last score that is kept the first ones are
                    of_hit = scores[hit]
                    last = np.partition(of_hit, len(hit) - limit)[len(hit) - limit]
                    above = hit[of_hit > last]
                    hit = np.concatenate([above, hit[of_hit == last][: limit - len(above)]])
                if len(hit):
                    held.append((q, hit, scores[hit]))
                    n += len(hit)
                if n >= OUT_ROWS:
                    yield _given_out(batch, held, ids, place)
                    held, n = [], 0
            if held:
                yield _given_out(batch, held, ids, place)
                held, n = [], 0

    return best


def _block_index(lists: pa.Table, places: pa.Table | None, weights: list[int], newest: bool) -> tuple:
    """The distinct words of a block; where each one's documents start; their numbers, in the order that equal scores keep, and weights; the ids
    and places by number."""
    words, fields, docs = (lists.column(c).combine_chunks() for c in ("word", "field", "docs"))
    words, sizes, docs = words.dictionary_encode(), pc.list_value_length(docs).to_numpy(), docs.flatten().dictionary_encode()
    ids = docs.dictionary
    order = pa.table({"id": ids})
    if places is not None:
        of_place = places.column("docs").combine_chunks().flatten()
        order = pa.table({"place": places.column("place").combine_chunks().take(pc.index_in(ids, value_set=of_place)), "id": ids})
    way = "descending" if newest else "ascending"
    first = pc.sort_indices(order, sort_keys=[(c, way) for c in order.column_names], null_placement="at_end" if newest else "at_start")
    number = np.empty(len(ids), np.int64)
    number[first.to_numpy()] = np.arange(len(ids))
    key = np.repeat(words.indices.to_numpy().astype(np.int64), sizes)
    key *= len(ids)
    key += number[docs.indices.to_numpy()]
    key *= len(weights)
    key += np.repeat(fields.to_numpy(), sizes)
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])]  # several terms of a document may begin with one word
    pair, field = np.divmod(key, len(weights))
    del key
    at = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    weight = np.add.reduceat(np.array(weights, np.int64)[field], at)
    word, number = np.divmod(pair[at], len(ids))
    starts = np.searchsorted(word, np.arange(len(words.dictionary) + 1)).tolist()
    return words.dictionary, starts, number, weight, ids.take(first), None if places is None else order.column("place").combine_chunks().take(first)


def _given_out(asked: pa.RecordBatch, held: list[tuple[int, np.ndarray, np.ndarray]], ids: pa.Array, place: pa.Array | None) -> pa.RecordBatch:
    """Rows of the queries of a batch: their number there, the numbers of their documents, the scores."""
    line, hit = np.repeat([q for q, _, _ in held], [len(h) for _, h, _ in held]), pa.array(np.concatenate([h for _, h, _ in held]))
    columns = {"query_id": asked.column("query_id").take(pa.array(line)), "doc_id": ids.take(hit), "score": pa.array(np.concatenate([x for _, _, x in held]))}
    return pa.RecordBatch.from_pydict(columns | ({} if place is None else {"place": place.take(hit)}))


def first_listed(rows: DataFrame, order: Column) -> DataFrame:
    """The first row of each doc_id in the given order."""
    others = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.min_by(F.struct(*others), order).alias("r")).select("doc_id", "r.*")
